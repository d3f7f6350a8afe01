"""Leaks against a comparison of every stretch with every text."""

import base64
import email
import quopri
import random
import re
import tracemalloc
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltbed.llm import leaks, mail_text


def brute(words, items, run):
    stretches = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
    return {n for n, (_, w) in enumerate(items) if any(tuple(w[i : i + run]) in stretches for i in range(len(w) - run + 1))}


@pytest.mark.parametrize("run", [2, 3, 5, 12])
def test_search_equals_brute_force(run):
    rng = random.Random(run)
    vocabulary = [f"w{i}" for i in range(4 if run < 5 else 9)]
    for _ in range(150):
        items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]) for i in range(4)]
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.7 and items[0][1]:
            at = rng.randrange(len(words) + 1)
            cut = rng.randrange(len(items[0][1]))
            words[at:at] = items[0][1][cut : cut + rng.randrange(20)]
        assert leaks.Patterns(items, run).search(words) == brute(words, items, run)
    with pytest.raises(ValueError):
        leaks.Patterns([], 1)


def test_long_runs_and_common_endings():
    rng = random.Random(1)
    words = [f"w{rng.randrange(900)}" for _ in range(4000)]
    items = [(0, words[100:500]), (1, words[300:301] * 300), (2, [f"x{i}" for i in range(50)])]
    for run in (270, 300):
        patterns = leaks.Patterns(items, run)
        for text in (words, words[:99] + words[120 : 120 + run], words[1:90] * 20, words[300:301] * 400):
            assert patterns.search(text) == brute(text, items, run)
    # Many items with the same two last words: a bucket holds equal stretches only.
    ends = [(i, [f"a{i}", f"b{i}", *["and", "so"] * 8]) for i in range(3000)]
    patterns = leaks.Patterns(ends, 12)
    assert patterns.search(["a7", "b7", *["and", "so"] * 5]) == {7}
    assert patterns.search(["and", "so"] * 6) == set(range(3000))
    assert len(patterns.stretch) == 3000 * 7


def test_tables_stay_small():
    """100,000 items of some 33 words: about 3.3 million words, which is what one pass takes."""
    rng = random.Random(2)
    vocabulary = [f"{rng.randrange(1 << 40):x}" for _ in range(60_000)]
    items = [(i, [vocabulary[int(rng.random() ** 2 * 60_000)] for _ in range(33)]) for i in range(100_000)]
    tracemalloc.start()
    patterns = leaks.Patterns(items, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20
    for i in rng.sample(range(100_000), 200):
        at = rng.randrange(22)
        assert i in patterns.search([*vocabulary[:9], *items[i][1][at : at + 12], *vocabulary[9:19]])


ITEM = "Welcher Kessel trägt den grünen Kahn wenn die Müllerin von Fikelvek ihren Riegel über 1439 Brücken führt"
PART = " ".join(ITEM.split()[2:15])
SHORT = " ".join(ITEM.split()[2:13])


def b64(text):
    return base64.encodebytes(text.encode()).decode()


def qp(text):
    return quopri.encodestring(text.encode()).decode()


PLAIN = "From: a@b\nContent-Type: text/plain; charset=utf-8\n"
HOLDS = {
    "plain": PLAIN + "\n" + PART,
    "no header type": "From: a@b\n\nx " + PART,
    "crlf": (PLAIN + "\n" + PART).replace("\n", "\r\n"),
    "quoted": PLAIN + "\n> > " + PART.replace(" ", "\n> > "),
    "case and marks": PLAIN + "\n" + PART.upper().replace(" ", ' -- "'),
    "composition": PLAIN + "\n" + unicodedata.normalize("NFD", PART),
    "invisible": PLAIN + "\n" + PART.replace("e", "e\u200b").replace("r", "\u00adr"),
    "base64": PLAIN + "Content-Transfer-Encoding: base64\n\n" + b64(PART),
    "base64 cut off": PLAIN + "Content-Transfer-Encoding: BASE64\n\n" + b64(PART + " and more")[:-3],
    "quoted-printable": PLAIN + "Content-Transfer-Encoding: quoted-printable\n\n" + qp(PART),
    "html": "Content-Type: text/html\n\n<p>" + PART.replace(" ", "&nbsp;<br>").replace("trägt", "tr&auml;<b>gt</b>") + "</p>",
    "html said to be plain": PLAIN + "\n<html><body><p>" + PART.replace(" ", " <i>", 3) + "</body>",
    "latin-1": "Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(PART.encode("latin-1")).decode(),
    "unknown charset": "Content-Type: text/plain; charset=x-none\nContent-Transfer-Encoding: base64\n\n" + b64(PART),
    "multipart": "Content-Type: multipart/mixed;\n\tboundary=\"b(1\"\n\n--b(1\nContent-Type: text/html\n\nnone\n--b(1\n\n" + PART + "\n--b(1--\n",
    "not closed, nested": "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary=i\n\n--i\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + b64(PART),
    "attached mail": "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: message/rfc822\n\nSubject: x\n\n" + PART + "\n--o--",
    "subject": "Subject: =?utf-8?B?" + base64.b64encode(PART.encode()).decode() + "?=\n\nx",
    "folded subject": "Subject: " + PART[:30] + "\n " + PART[30:] + "\n\nx",
}
LACKS = {
    "eleven words": PLAIN + "\n" + SHORT + " end",
    "a word between": PLAIN + "\n" + PART.replace(" wenn ", " wenn nun "),
    "over two parts": "Content-Type: multipart/mixed; boundary=b\n\n--b\n\n" + PART[:40] + "\n--b\n\n" + PART[40:],
    "in an image": "Content-Type: image/png\n\n" + PART,
    "empty": "",
    "header only": "Subject: x",
}


def test_mails(spark):
    docs = [(name, text, 1) for name, text in {**HOLDS, **LACKS}.items()] + [("null", None, 1), (None, PLAIN + "\n" + PART, 1), ("plain", HOLDS["plain"], 2), ("long", PLAIN + "\n" + "word " * 300_000 + PART, 1)]
    items = [(1, ITEM, "x"), (2, "Old charts place the marten 1816 miles from here where an obscure mason kindles each frozen loom", "x"), (3, SHORT, "x"), (4, None, "x"), (1, ITEM, "x")]
    d = spark.createDataFrame(docs, "id string, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, item_text string, id string")
    for chars in (10**6, 60):
        got = leaks.leaks(d, "id", "text", i, "item_id", "item_text", block_chars=chars).collect()
        assert sorted((r.id or "", r.item_id) for r in got) == sorted((n or "", 1) for n in [*HOLDS, None, "long"])
    small = i.withColumn("item_id", F.col("item_id").cast("int")).where("item_id = 1")
    assert {r.item_id for r in leaks.leaks(d, "id", "text", small, "item_id", "item_text").collect()} == {1}
    other = i.where("item_id = 1").withColumn("item_id", F.lit("2025-01-01").cast("date"))
    assert leaks.leaks(d, "id", "text", other, "item_id", "item_text").schema["item_id"].dataType.simpleString() == "date"
    assert leaks.leaks(d, "id", "text", other, "item_id", "item_text").count() == len(HOLDS) + 2
    assert leaks.leaks(d, "id", "text", i.limit(0), "item_id", "item_text").count() == 0
    assert leaks.leaks(d.limit(0), "id", "text", i, "item_id", "item_text").count() == 0
    plain = leaks.leaks(d.where(F.col("id") == "base64"), "id", "text", i, "item_id", "item_text", texts_of=lambda t: [t])
    assert plain.count() == 0


def nested(depth, inner):
    for n in range(depth):
        inner = f"Content-Type: multipart/mixed; boundary=n{n}x\n\n--n{n}x\n{inner}\n--n{n}x--\n"
    return inner


MIXED = "Content-Type: multipart/mixed; boundary=o\n\n--o\n"
FIRST, REST = PART[:40].rsplit(" ", 1)[0], PART[len(PART[:40].rsplit(" ", 1)[0]) + 1 :]
ANY_PLACE = {
    "part without header": MIXED + PART + "\n--o--\n",
    "first paragraph of such a part": MIXED + PART + "\n\nmore\n--o--\n",
    "over its first two paragraphs": MIXED + FIRST + "\n\n" + REST + "\n--o--\n",
    "behind the closing boundary": MIXED + "\nx\n--o--\n" + PART,
    "header of an attached mail": MIXED + "Content-Type: message/rfc822\n\nSubject: =?utf-8?B?" + base64.b64encode(PART.encode()).decode() + "?=\nContent-Type: text/plain\n\nx\n--o--\n",
    "nested 9 times": nested(9, "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + b64(PART)),
    "nested 2000 times": nested(2_000, "Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\n" + qp(PART)),
    "attached 2000 times": "Content-Type: message/rfc822\n\n" * 2_000 + "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + b64(PART),
    "mail that begins with a line end": "\n" + PART,
}


@pytest.mark.parametrize("place", ANY_PLACE)
def test_every_text_of_a_mail_is_searched(place):
    want = " ".join(mail_text.words(PART))
    for mail in (ANY_PLACE[place], ANY_PLACE[place].replace("\n", "\r\n")):
        assert any(want in " ".join(mail_text.words(t)) for t in mail_text.texts(mail))


def test_words():
    assert mail_text.words("Ab-c_d 12,5 \ufb01x\u00ad\u200dy STRASSE") == ["ab", "c", "d", "12", "5", "fixy", "strasse"]
    assert mail_text.words("Straße") == ["strasse"] and mail_text.words("") == []
    assert mail_text.words("été") == mail_text.words("été") == ["été"]


def standard_parts(mail):
    """The texts of a mail as the standard library's parser sees them."""
    parsed = email.message_from_bytes(mail.encode("utf-8", "surrogatepass"))
    for part in parsed.walk():
        if part.get_content_maintype() == "text":
            text = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace")
            yield re.sub(r"<[^<>]*>", " ", text) if part.get_content_subtype() == "html" else text


def test_what_the_standard_parser_shows_is_found(spark, sf):
    """Leaks in the texts that another parser gets out of the mails are among ours."""
    d, i = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    items = [(r.item_id, mail_text.words(r.item_text)) for r in i.collect()]
    want = set()
    for r in d.collect():
        for part in standard_parts(r.text or ""):
            want |= {(r.doc_id, items[n][0]) for n in brute(mail_text.words(part), items, 12)}
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert want <= got and len(want) > len(got) / 2


def test_planted_runs_are_found(spark, sf):
    """Every run of the items that a plain search for the decoded texts finds, in all test mails."""
    d, i = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    items = [(r.item_id, mail_text.words(r.item_text)) for r in i.collect()]
    want = set()
    for r in d.collect():
        for part in mail_text.texts(r.text or ""):
            want |= {(r.doc_id, items[n][0]) for n in brute(mail_text.words(part), items, 12)}
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert got == want and got
