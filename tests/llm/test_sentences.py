"""Sentence units of texts whose units are known."""

import pytest
from pyspark.sql import functions as F

from siltbed.llm import sentences

HEAD = "From: a@b.example\nSubject: x. Y.\n"

CASES = {
    "abbreviations": ["Mr. Lee (ext. 740) will call Dr. Fox on Mon. or Tue.", "At 10:17 a.m. Ms. Ray left.", "It closed at 5 p.m.", "See No. 5, fig. 1.5, p. 619."],
    "decimals": ["The limit is .5 s, not 5 s.", "That is version 3.0.", "It cost $843.75 vs. $2.10 before."],
    "hosts": ["Write to a.b@c.example or open https://d.test/q?id=3.4 for details.", "iostat on x.y shows 1.5 % idle.", "z.json grew overnight."],
    "quotes": ['He wrote, "Roll it back first. Ask later."', "Ann asked: “Did it stop? Or did it hang?” and left.", '"That\'s no bug!" said Al.', 'It read "x: no run. Giving up." and nothing else.'],
    "brackets": ["(The old flag is gone, by the way.)", "We go on [as said before.]", "Yes."],
    "initials": ["J. Doe and K. R. Roe signed.", "U r right!!!", "What?!", "Hmm...", "We lost 3 of 4 records ... and nobody noticed."],
    "etc": ["We have logs, runs, etc.", "I checked runs, etc. and left.", "Foo Inc. and Bar Ltd. agree."],
    "blank lost": ["It does not.", "The rest is fine.", "Is it?", "Yes."],
    "german": ["Am 5. Okt. um 4:25 Uhr fiel er aus.", "Das ist der 4. Versuch!", "Läuft es z. B. auf x?", "Das dauerte ca. 59,10 Sek., d. h. etwas länger.", "»Nein!«, rief Eva.", "Sie fragte: „Läuft es? Oder hängt es?“ und ging.", "Fr. Dr. Roth meldet sich u. U. erst später.", "Wir verloren 120.000 Sätze, Läufe usw.", "Ende am 2.3.2025."],
    "french": ["N° 428 : voir l'annexe 4.1 !", "« Ça tourne encore ? » a demandé Luc.", "M. Roux a pris env. 3,5 s, c.-à-d. peu.", "Arrêtez tout de suite !"],
    "spanish": ["La Dra. Paz dijo: «Espera. Luego prueba.»", "D. Gil llegó a las 2:38 a. m. y reinició x.", "¡¿Quién rompió a.log?!", "Véase la pág. 6 del núm. 2."],
    "russian": ["См. рис. 5 и табл. 2.", "Сброс занял 79,44 с, т. е. больше.", "«Всё работает!» — сказала Анна.", "В 2019 г. x работал.", "Мы потеряли 44 тыс. записей, журналы и т. д.", "Почему?"],
    "arabic": ["قال د. سمران إن الإصدار 3.5 سليم.", "هل ما زال هنا؟", "أوقف هذا الآن!"],
    "hindi": ["डॉ. राम ने जाँच की।", "उसने 3.5 जीबी लिखे ।", "क्या यह है?"],
    "armenian": ["Նա տուն գնաց։", "Գրքի 3.5 տարբերակը լավն է։", "Ո՞վ է նա։"],
    "ethiopic": ["ሰላም ለሁሉም።", "ዋጋው 3.5 ነው።", "ማን ነው፧"],
    "burmese": ["ကျွန်တော် သွားမည်။", "သူ လာမည်၊ နေမည်။"],
    "khmer": ["ខ្ញុំទៅផ្សារ។", "គាត់មកផ្ទះ។"],
    "tibetan": ["ང་འགྲོ་གི་ཡིན།", "ཁོང་ཡོང་གི་རེད།"],
    "greek": ["Έρχεσαι αύριο;", "Ναι, στις 3.5 ώρες.", "«Πού είσαι;» ρώτησε η Άννα.", "Εδώ· περίμενε!"],
    "georgian": ["ის წავიდა.", "ვინ არის?"],
    "thai": ["รุ่น 3.5 ไม่มีปัญหานี้ค่ะ", "เหลือไฟล์ 7 ไฟล์ในระดับ 0 ครับ", "ขอบคุณมากครับ"],
}
TIGHT = {
    "japanese": ["v4.1では再現しません。", "担当者は「止めてください。後で確認します。」と言いました。", "何ですか！？", "確認中……少しお待ちください。", "本当ですか？"],
    "khmer without blanks": ["ខ្ញុំទៅផ្សារ។", "គាត់មកផ្ទះ។"],
    "burmese without blanks": ["ကျွန်တော်သွားမည်။", "သူလာမည်။"],
    "chinese": ["版本4.1没有这个问题。", "他说：“先回滚。以后再问。”然后挂断了电话。", "“真的吗？”他问。", "我们丢了3条记录……但是没有人发现。"],
}


def units(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("start_at", F.lit("clash")).withColumn("row", F.lit(1))
    out = [[] for _ in texts]
    for r in sorted(sentences.sentence_units(df).collect(), key=lambda r: (r.doc_id, r.start_at)):
        assert texts[r.doc_id][r.start_at : r.end_at] == r.sentence == r.sentence.strip()
        out[r.doc_id].append(r.sentence)
    return out


def test_known_sentences(spark):
    join = {"blank lost": ""}
    texts, want = [], []
    for name, told in {**CASES, **TIGHT}.items():
        glue = "" if name in TIGHT else join.get(name, " ")
        texts.append(HEAD + "\n" + glue.join(told))
        want.append(told)
        texts.append((HEAD + "\n" + glue.join(told).replace(" ", "\n")).replace("\n", "\r\n"))
        want.append([t.replace(" ", "\r\n") for t in told])
        texts.append(HEAD + "\n" + ("\n" if glue == " " else glue).join(told) + "\n")
        want.append(told)
    for name, got, told in zip([n for n in [*CASES, *TIGHT] for _ in range(3)], units(spark, texts), want, strict=True):
        assert got == told, name


MULTI = HEAD + 'Content-Type: multipart/mixed;\n\tboundary="=_b+1"\n\nThis is no prose. Not at all.\n--=_b+1\nContent-Type: text/plain\n\nOne. Two.\n--=_b+1\nContent-Type: text/html\n\n<p>No. Not this.</p>\n--=_b+1\n\nThree. Four\n--=_b+1\nContent-Type: text/plain\nContent-Disposition: attachment\n\nNo. Not this.\n--=_b+1--\nNo. Epilogue.\n'
STRUCTURE = [
    (HEAD + "\nHello all,\n\nA b.\nC d\n\n- first point\n- second. With two.\n* third\n1. fourth\n\nKind regards\nAnn Lee\n-- \nAnn. Lee.\n", ["Hello all,", "A b.", "C d", "first point", "second.", "With two.", "third", "fourth", "Kind regards\nAnn Lee"]),
    (HEAD + "\nDo so:\n1. one\n2. two\nThe\n4. Okt. came.\n* star\nend\n- - x\n", ["Do so:", "one", "two", "The\n4. Okt. came.", "star", "end", "- x"]),
    (HEAD + "\nYes. No.\nOn 1.2. Ann wrote:\n> Quoted. Text.\n>\n> More.\nAfter it.\n\n    12:00 log. Line.\n    13:00 more.\nLast", ["Yes.", "No.", "After it.", "Last"]),
    (HEAD + "\nOne.\n______\nNo. More.\n", ["One."]),
    (HEAD + "\nOne.\n____\nTwo.\n-----Original Message-----\nNo.\n", ["One.", "____\nTwo."]),
    (HEAD + "\nOne.\n-----Original Message-----\nNo. More.\n", ["One."]),
    ((HEAD + "\nOne.\n\nTwo: \n> q. q.\n\n- a\n- b\n\n-- \nNo.").replace("\n", "\r\n"), ["One.", "a", "b"]),
    (HEAD + "Content-Transfer-Encoding: base64\n\nTm8uIE5vLg==\n", []),
    (HEAD + "Content-Transfer-Encoding: Quoted-Printable\n\nNo. No.\n", []),
    (HEAD + "Content-Type: text/html\n\nNo. No.\n", []),
    (HEAD + "Content-Type:\n text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nYes. Yes.\n", ["Yes.", "Yes."]),
    (MULTI, ["One.", "Two.", "Three.", "Four"]),
    (MULTI.split("--=_b+1\nContent-Type: text/plain\nContent-Disp")[0].rstrip(), ["One.", "Two.", "Three.", "Four"]),
    (HEAD + "\nPrivate\ue0f0\ue0f3. Use \ue0f1 too.", None),
    (HEAD + "\nAm\n4. Okt. war es so.\n", ["Am\n4. Okt. war es so."]),
    ("No header at all", []),
    ("\n\nNo header. But a body.", ["No header.", "But a body."]),
    ("", []),
    ("\n\n", []),
]


def test_names_that_begin_small(spark):
    text = HEAD + "\nIt ran until 5 p.m. iostat shows 3.4 %, etc. iostat and the rest agree."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    cut = lambda names: [r.sentence for r in sentences.sentence_units(docs, names=names).orderBy("start_at").collect()]
    assert cut(()) == [text.split("\n")[-1]]
    assert cut(("iostat",)) == ["It ran until 5 p.m.", "iostat shows 3.4 %, etc.", "iostat and the rest agree."]


def test_long_lists(spark):
    told = [f"{n}. point {n}" for n in (*range(1, 12), 998, 999, 1000, 1001, 123456)]
    assert units(spark, [HEAD + "\nDo:\n" + "\n".join(told) + "\n"]) == [["Do:", *[t.split(". ", 1)[1] for t in told]]]


def test_terminators_come_from_unicode():
    ends = sentences._script_ends()
    assert set("։።။។៕｡。！？᠃꓿꘎") <= set(ends) and not set("၊,;·") & set(ends) and len(ends) > 120


def test_structure(spark):
    texts = [t for t, _ in STRUCTURE if _ is not None]
    for (text, want), got in zip([x for x in STRUCTURE if x[1] is not None], units(spark, texts), strict=True):
        assert got == want, text


@pytest.mark.parametrize("marks", ['""', "„“", "»«", "“”", "«»"])
def test_quotations_of_any_length(spark, marks):
    told = [f"He wrote: {marks[0]}{'Roll it back first. ' * 3_000}Ask later{marks[1]} and left.", f"She wrote: {marks[0]}Stop it. Now{marks[1]} and left.", "Yes."]
    assert units(spark, [HEAD + "\n" + " ".join(told)]) == [told]


def test_own_characters_in_a_text_keep_the_places(spark):
    text = next(t for t, w in STRUCTURE if w is None)
    got = sentences.sentence_units(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("start_at").collect()
    assert [text[r.start_at : r.end_at] for r in got] == ["Private\ue0f0\ue0f3.", "Use \ue0f1 too."]


def test_nulls_repeats_and_long_texts(spark):
    long = HEAD + "\n" + "A short one. " * 60_000
    wide = HEAD + "\n" + '"' * 20_001 + "x" * 300_000 + "."
    df = spark.createDataFrame([(1, "\n\nA. Bc."), (1, "\n\nA. Bc."), (None, "\n\nDe."), (2, None), (3, long), (4, wide)], "doc_id bigint, text string")
    got = sentences.sentence_units(df, with_text=False).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got}[3] == 60_000
    assert {r.doc_id for r in got} == {1, None, 3, 4}
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_units_of_the_archive_are_whole(spark, sf):
    """Units don't overlap, are trimmed, and lie where the text says."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = {}
    found = sorted(sentences.sentence_units(docs).collect(), key=lambda r: (r.doc_id, r.start_at))
    for r in found:
        assert texts[r.doc_id][r.start_at : r.end_at] == r.sentence == r.sentence.strip() != ""
        assert r.start_at >= last.get(r.doc_id, 0)
        last[r.doc_id] = r.end_at
    assert len(last) > len(texts) // 2


@pytest.mark.parametrize("word", ["etc", "Mr", "z.B"])
def test_shared_beginnings(word):
    import re

    assert re.fullmatch(sentences._any(["etc", "eta", "Mr", "Mrs", "z.B"]), word)
