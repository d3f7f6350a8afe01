"""Sentence units of texts in many languages and scripts, with their places, in SQL expressions.

Within the prose of a document, full stops that end no sentence (decimals, hosts, file
names, initials, abbreviations, ordinals) are masked with private-use placeholders, marks
inside quotations are tagged, paragraphs and then sentences are cut off with a separator
at the terminators of their script, and the placeholders are turned back. A placeholder
takes the place of one character, so the lengths of the pieces, added up over a document,
are places in it. All of it happens in the row where the text lies.
"""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of our own; if a text has them, they become U+FFFD in the units (places stay).
SEP, SKIP, TAG = "\ue0f0", "\ue0f1", "\ue0f2"
DOT, ASK = "\ue0f3", "\ue0f4"
OPEN, SHUT = "\ue0f5", "\ue0f6"  # straight double quotes, paired
LOW_SHUT = "\ue0f7"  # the closing mark of a quotation opened low
BACK_OPEN, BACK_SHUT = "\ue0f8", "\ue0f9"  # guillemets that point inwards
GREEK_ASK = "\ue0fa"  # a semicolon behind a Greek word asks
_OWN = "\ue0f0-\ue0fa"
_MASKS = {DOT: ".", ASK: "?", OPEN: '"', SHUT: '"', LOW_SHUT: "“", BACK_OPEN: "»", BACK_SHUT: "«", GREEK_ASK: ";"}

# Abbreviations that stand before what they belong to and so never end a sentence.
LEADING = {
    "en": "Mr Mrs Ms Dr Prof Rev Gen Col Capt Lt Sgt Sen Rep Gov Hon St Mt Ft vs cf viz ca Ca approx appr prob esp incl excl ext vol ch chap sec sect eq ref resp",
    "de": "Hr Hrn Fr Frl bzw vgl Vgl ggf evtl inkl exkl zzgl Abschn Abs Kap Bd Abb Nrn Tel Str Mio Mrd gem lt sog jew insb bspw max min",
    "fr": "M MM Mme Mlle Me Mgr env chap av",
    "es": "Sr Sra Srta Sres D Da Dña Dra Dres Ud Uds pág págs núm núms cap aprox Av Avda tel",
    "ru": "г-н г-жа рис Рис табл Табл см См ср Ср гл тыс млн млрд стр ул им проф акад напр руб коп",
    "hi": "डॉ श्री प्रो पं सं",
    "ar": "أ.د",
}
# Abbreviations that stand before a number; without one they are words.
BEFORE_NUMBER = "No Nos no nos Nr nr Fig Figs fig figs Tab tab Vol Eq Sec Ch Art art p pp P S Bl v V n N s"
# Abbreviations that may end a sentence; they do if what follows begins one.
TRAILING = "etc usw Inc Ltd Co Corp Jr Sr Bros Ave Blvd Rd al ff f Sek Std Min Tsd Hbf Jh dept Dept est Est ed eds op cit seq sq sg др пр гг мин сек"
DAYS_AND_MONTHS = "Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Jän Mrz Okt Dez Mo Di Mi Do Sa So"
# Letters with spaces between, whose last stop is like the ones above.
SPACED_LEADING = ["z. B", "d. h", "u. U", "u. a", "i. d. R", "i. A", "o. g", "s. o", "s. u", "e. g", "i. e", "т. е", "т. к", "т. н", "p. ex", "p. ej"]
SPACED_TRAILING = ["a. m", "p. m", "A. M", "P. M", "т. д", "т. п", "o. ä", "u. ä"]
# The same without spaces.
CLOSED_LEADING = "i.e I.e e.g E.g z.B d.h u.a u.U т.е т.к c.-à-d"
CLOSED_TRAILING = "a.m p.m A.M P.M т.д т.п o.ä"
# Words after which a small number with a stop is an ordinal, and months in full.
BEFORE_ORDINAL = "am Am vom Vom zum Zum bis Bis der Der dem Dem den Den des Des die Die das Das im Im beim Beim ab Ab seit Seit jeder jedem jeden"
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez"
# What follows the name of a company.
COMPANIES = "Inc Ltd Corp Co LLC GmbH AG SA SARL"
# Polite particles that close a Thai sentence before a space.
THAI_PARTICLES = "ครับ ค่ะ คะ"

_L = r"[\p{L}\p{N}\p{M}]"
# Terminators that end a sentence only before white space, a capital or the end of the text.
_LATIN_END = ".?!؟۔।॥‼⁇⁈⁉" + GREEK_ASK
# Terminators that Unicode doesn't list as such, and one that it lists but that separates clauses.
_ALSO_END, _NOT_END = "།༎\u037e", "၊"


@cache
def _script_ends() -> str:
    """All other characters with the property of a sentence's terminator; they end one wherever they stand."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return "".join(c for c in regex.findall(r"\p{Sentence_Break=STerm}", every) + [*_ALSO_END, "｡"] if c not in _LATIN_END + _NOT_END)


def _class(characters: str) -> str:
    """A character class of terminators that dismisses letters and blanks at once."""
    return r"[\p{Po}&&[" + characters + "]]"


_CLOSERS = "\\)\\]}”’'»›" + SHUT + LOW_SHUT + BACK_SHUT
_WIDE_CLOSERS = "」』）】》〉〕”’)»" + SHUT
_WHITE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = r"[\s\x{a0}\x{202f}\x{3000}]"


def _any(words: list[str]) -> str:
    """A pattern for any of the words, shared beginnings first, so that few branches are tried."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [{" ": r"\s{1,2}", ".": f"[.{DOT}]"}.get(c, c) + pattern(x) for c, x in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return pattern(tree)


def _words(*lists: str) -> list[str]:
    return [w for text in lists for w in text.split()]


def _starting(names: tuple[str, ...]) -> str:
    return "(?:" + "|".join(names) + r")(?!" + _L + r")|" if names else ""


def _small_start(names: tuple[str, ...]) -> str:
    """A sentence may begin small: with one of these names, a file or host (with a masked stop in it), a company's name, a point of a list."""
    return r"(?:" + _starting(names) + r"[\p{L}\p{N}_-]++(?:" + DOT + r"\p{L}|" + _GAP + r"(?:" + "|".join(COMPANIES.split()) + r")(?!" + _L + r"))|\p{Ll}\))"


def _after_quote(names: tuple[str, ...]) -> str:
    return r"(?:[¿¡«„“(\[" + OPEN + BACK_OPEN + r"]|\p{Lu}|" + _small_start(names) + r")"


def _inner_stop(names: tuple[str, ...]) -> str:
    """A stop within a word, number, host or file name, or before a number; not one where the blank behind a sentence was lost."""
    named = "|(?:" + "|".join(names) + r")" + _GAP if names else ""
    return r"\.(?=[\p{L}\p{N}])(?!(?<=[\p{Ll}\p{M}]{2}\.|\p{N}\.)(?:\p{Lu}" + named + r"))"


_INNER_ASK = r"\?(?=[\p{L}\p{N}_%-]++=)"


def _last_letters(forms: list[str]) -> str:
    """The last letter of abbreviations with spaces, by what stands before it."""
    return "(?:" + "|".join(f"{f[-1]}(?<=(?<!{_L}){_any([f])})" for f in forms) + ")"


def _abbreviations(names: tuple[str, ...]) -> str:
    """A stop after an abbreviation, initial or ordinal that doesn't end the sentence.

    Sought from the stop backwards, so that only what stands before a stop is compared.
    """
    small = _small_start(names)
    start = r"(?<![\p{L}\p{N}\p{M}" + DOT + r"'’])"
    follows = _GAP + r"+"
    leading = _any(_words(*LEADING.values(), CLOSED_LEADING))
    goes_on = r"(?=\.[)\]]*(?:[,;:]|" + follows + r"(?!" + small + r")[(\[]?\p{Ll}))"
    stop = rf"[.{DOT}]"
    branches = [
        # Letters with spaces between, and initials: but for a unit after a number, a letter before another with a stop.
        r"(?<!\d" + _GAP + r"{1,2})\p{Ll}(?<!(?:[ap]|т)\." + _GAP + r"{1,2}.)(?=\." + _GAP + r"{1,2}\p{L}(?:\.|\s*\z))",
        r"[ap](?=\." + _GAP + r"{1,2}m(?!" + _L + r"))",
        r"\p{Lu}(?=\." + follows + r"\p{Lu})",
        leading,
        _last_letters(SPACED_LEADING),
        _any(_words(BEFORE_NUMBER)) + r"(?=\." + _GAP + r"*[\p{N}" + DOT + r"])",
        # A time of day that opens a sentence goes on with its subject.
        r"(?:[ap]" + DOT + r")?m(?<=(?<!" + _L + r")At" + _GAP + r"{1,2}\d{1,2}[:.]\d{2}" + _GAP + r"{1,2}[ap]" + stop + r"\s{0,2}m)(?=\.\s)",
        "(?:" + _any(_words(TRAILING, CLOSED_TRAILING)) + "|" + _last_letters(SPACED_TRAILING) + ")" + goes_on,
        _any(_words(DAYS_AND_MONTHS)) + r"(?=\.(?:[,;:)]|" + follows + r"(?!" + small + r")[(]?[\p{Ll}\p{N}]))",
        # A one-letter title in a script without case; a year with its letter.
        r"[\p{IsArabic}](?=\." + follows + r")",
        r"г(?<=\d" + _GAP + r"{0,2}г)(?=\." + follows + r")",
        r"\d{1,2}(?<=(?<!" + _L + r")(?:" + "|".join(BEFORE_ORDINAL.split()) + r")" + _GAP + r"{1,2}\d{1,2})(?=\." + follows + r"\p{L})",
        r"\d{1,2}(?=\." + follows + r"(?:" + "|".join(MONTHS.split()) + r")(?!" + _L + r"))",
    ]
    return r"\.(?<=" + start + "(?:" + "|".join(branches) + r")\.)"


# The parts of a mail


def _of(head: Column, field: str, value: str) -> Column:
    return F.lower(F.regexp_extract(head, r"(?im)^" + field + r":[ \t]*(?:\r?\n[ \t]+)?" + value, 1))


def _with_begins(rows: DataFrame, lengths: str, name: str) -> DataFrame:
    """``rows`` with ``name``: for each element of the array ``lengths`` the sum of those before it.

    The array is cut into blocks of about the root of its length, and sums of blocks are
    added up first, so n elements take about n * sqrt(n) steps. What a lambda needs comes
    as its argument, as an expression within it is computed for every element.
    """
    add = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda t, n: t + n)
    block = F.greatest(F.ceil(F.sqrt(F.size(lengths))), F.lit(32)).cast("int")
    last = F.floor((F.size(lengths) - 1) / F.col("__block")).cast("int")
    staged = rows.withColumn("__block", block)
    staged = staged.withColumn("__blocks", F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * F.col("__block") + 1, F.col("__block")))))
    staged = staged.withColumn("__sums", F.transform("__blocks", add))
    staged = staged.withColumn("__bases", F.transform("__sums", lambda _, b: add(F.slice("__sums", F.lit(1), b))))
    begin = F.flatten(F.zip_with("__blocks", "__bases", lambda c, base: F.transform(c, lambda _, i: base + add(F.slice(c, F.lit(1), i)))))
    return staged.withColumn(name, begin).drop("__block", "__blocks", "__sums", "__bases")


def mail_parts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, at, prose): the parts of every mail.

    A part is what lies between two boundary lines (those of all multiparts that a
    multipart mail declares). ``prose`` is the body of a part that is text/plain (or says
    nothing), not base64 or quoted-printable and not an attachment, up to its signature or
    an appended original, and NULL for other parts. ``at`` is where it begins in the mail.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    # Only a mail whose header says multipart is searched for boundaries.
    header = F.substring_index(F.substring_index("text", "\n\n", 1), "\r\n\r\n", 1)
    names = F.regexp_extract_all("text", F.lit(r"(?i)boundary[ \t]*=[ \t]*\"?([^\"\s;]+)"), F.lit(1))
    quoted = F.concat_ws("|", F.transform(F.array_distinct(names), lambda b: F.concat(F.lit("\\Q"), F.replace(b, F.lit("\\E"), F.lit("")), F.lit("\\E"))))
    rows = rows.withColumn("names", F.when(header.rlike(r"(?im)^content-type:[ \t]*(?:\r?\n[ \t]+)?multipart/"), quoted))
    fence = F.concat(F.lit("(?m)(?=^--(?:"), F.col("names"), F.lit(r")(?:--)?[ \t]*\r?$)"))
    rows = rows.withColumn("parts", F.when(F.length("names") > 0, F.split("text", fence)).otherwise(F.array("text"))).drop("text")
    rows = rows.withColumn("lengths", F.transform("parts", lambda p: F.length(p).cast("bigint")))
    part = _with_begins(rows, "lengths", "begins").select("doc_id", "names", F.posexplode(F.arrays_zip("parts", "begins")).alias("part", "p")).select("doc_id", "names", "part", F.col("p.parts").alias("piece"), F.col("p.begins").alias("begin"))
    halves = part.withColumn("halves", F.split("piece", r"\r?\n[ \t]*\r?\n", 2))
    head, body = F.get("halves", F.lit(0)), F.get("halves", F.lit(1))
    media = _of(head, "content-type", r"([^;\s]*)")
    encoded = _of(head, "content-transfer-encoding", r"([^;\s]*)").isin("base64", "quoted-printable")
    attached = _of(head, "content-disposition", r"([^;\s]*)") == "attachment"
    closing = F.coalesce((F.col("part") > 0) & F.rlike("piece", F.concat(F.lit("^--(?:"), F.col("names"), F.lit(r")--[ \t]*(?:\r?\n|\z)"))), F.lit(False))
    # The first piece of a multipart is its header and preamble: its own type says multipart.
    wanted = media.isin("text/plain", "") & ~encoded & ~attached & ~closing
    prose = F.split(body, r"(?m)^(?:-- |_{5,}[ \t]*|-----Original Message-----[ \t]*)\r?$", 2)[0]
    return halves.select("doc_id", (F.col("begin") + F.length("piece") - F.length(body)).alias("at"), F.when(wanted, prose).alias("prose"))


# Units


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def paragraphs_marked(prose: Column) -> Column:
    """The prose cut by SEP into paragraphs and pieces that are none, which begin with SKIP.

    No prose are blank lines, lines that start with ``>`` with the line ending in a colon
    right above them, and lines indented by four blanks. A list line is a paragraph without
    its marker. As an ordinal may begin any line of a paragraph, a number is a marker only
    where a paragraph begins, behind another list line, or behind a line ending in a colon.
    """
    clean = _replace(prose, f"[{_OWN}]", "\ufffd")
    quoted = r"(?:[^\n]*:[ \t]*\r?\n(?=>))?>[^\n]*(?:\n|\z)"
    between = r"(?m)(?:^(?:" + quoted + r"| {4}[^\n]*(?:\n|\z)|[ \t 　\r]*\n))++"
    cut = _replace(clean, between, f"{SEP}{SKIP}$0{SEP}")
    return _replace(cut, rf"(?=[-*\d])((?:\A|(?<={SEP}|:\n|:\r\n)|\G(?<!\A))\d++\. |(?:\A|(?<=[\n{SEP}]))[-*] )([^\n{SEP}]*\n?)", f"{SEP}{SKIP}$1{SEP}$2{SEP}")


@cache
def _rules(names: tuple[str, ...]) -> tuple[list[tuple[str, str]], tuple[str, list[tuple[str, str]]], str]:
    """(masks, (what a quotation needs, marks of quotations), boundary) as patterns with their replacements."""
    shut = rf"[”»」』{SHUT}{LOW_SHUT}{BACK_SHUT}]"
    opening = rf"“„«「『{OPEN}{BACK_OPEN}"
    marks = rf"“”„«»「」『』{OPEN}{SHUT}{LOW_SHUT}{BACK_OPEN}{BACK_SHUT}"
    script = _class(_script_ends())
    ending = f"[{_class(_LATIN_END + _script_ends() + '…')}{GREEK_ASK}]"
    latin = f"[{_LATIN_END}]"
    small = _small_start(names)
    masks = [
        (_inner_stop(names), DOT),
        (_INNER_ASK, ASK),
        (rf";(?<=\p{{IsGreek}}\p{{M}}{{0,2}};)(?={_GAP}|[{_CLOSERS}]|\z)", GREEK_ASK),
        (_abbreviations(names), DOT),
    ]
    quotations = [
        (r'"([^"]++)"', f"{OPEN}$1{SHUT}"),
        (r"(„[^„“”]++)“", f"$1{LOW_SHUT}"),
        (r"»(?<=(?:\A|[\s(])»)(?=\S)([^»«]++)(?<=\S)«", f"{BACK_OPEN}$1{BACK_SHUT}"),
        # Each ending from an opening mark to the next mark, if that is a closing one.
        (rf"(?:[{opening}](?=[^{marks}]*+{shut})|\G(?!\A))[^{marks}{ending}]*+{ending}", f"$0{TAG}"),
    ]
    named = f"|(?:{'|'.join(names)}){_GAP}" if names else ""
    ends = [
        rf"(?<!{latin})(?!\.{{2,}}{_GAP}++(?!{small})\p{{Ll}}){latin}++(?!{TAG})[{_CLOSERS}]*+(?={_GAP}|\z|[\p{{Lu}}¿¡]{named})",
        rf"…++(?!{TAG})[{_CLOSERS}]*+(?={_GAP}++[\p{{Lu}}¿¡«„“{OPEN}])",
        rf"{script}++(?!{TAG})[{_WIDE_CLOSERS}]*+",
        rf"{ending}{TAG}{_GAP}?[”»{SHUT}{LOW_SHUT}{BACK_SHUT}][)\]]*+(?={_GAP}++{_after_quote(names)}|\p{{Lu}})",
    ]
    thai = rf"(?:{'|'.join(THAI_PARTICLES.split())})(?={_GAP})"
    return masks, (r'["„“«»「『]', quotations), rf"(?![a-z ])(?:(?={ending})(?:{'|'.join(ends)})|{thai})"


def sentences_marked(paragraph: Column, names: tuple[str, ...] = ()) -> Column:
    """The paragraph with a SEP behind each of its sentences, and masks still in it; as long as it was but for the SEPs."""
    masks, (needed, quotations), boundary = _rules(names)
    text = paragraph
    for pattern, by in masks:
        text = _replace(text, pattern, by)
    told = text
    for pattern, by in quotations:
        told = _replace(told, pattern, by)
    text = F.when(paragraph.rlike(needed), told).otherwise(text)
    return F.replace(_replace(text, boundary, f"$0{SEP}"), F.lit(TAG), F.lit(""))


def unmask(piece: Column) -> Column:
    """The text that a piece stands for."""
    return F.translate(piece, "".join(_MASKS), "".join(_MASKS.values()))


def sentence_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, names: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, start_at, end_at[, sentence]) of every sentence unit in the prose of every document.

    Places count code points from 0; ``end_at`` is the first behind the unit; a unit has no
    white space at either end. A document without prose, an empty one and a NULL have no
    unit. Every row is a document: repeated rows give repeated units, and a NULL id is
    kept. Other columns are dropped, whatever their names.

    ``names`` are names that are written small and may begin a sentence nevertheless, as
    those of commands do; without them a small letter begins one only in the names of files,
    hosts and companies.

    Nothing is shuffled: texts are cut, and places added up, in the row where the text lies.
    """
    parts = mail_parts(documents, doc_id, text)
    blocks = parts.select("doc_id", "at", F.split(paragraphs_marked(F.col("prose")), SEP).alias("blocks"))
    cut = F.flatten(F.transform("blocks", lambda b: F.when(b.startswith(SKIP) | (b == ""), F.array(b)).otherwise(F.split(sentences_marked(b, names), SEP))))
    pieces = blocks.select("doc_id", "at", cut.alias("pieces"))
    # A SKIP isn't in the text.
    pieces = pieces.withColumn("lengths", F.transform("pieces", lambda p: (F.length(p) - p.startswith(SKIP).cast("int")).cast("bigint")))
    placed = _with_begins(pieces, "lengths", "begins")
    units = placed.select("doc_id", "at", F.explode(F.arrays_zip("pieces", "begins")).alias("u")).select("doc_id", F.col("u.pieces").alias("piece"), (F.col("at") + F.col("u.begins")).alias("begin"))
    units = units.where(~F.col("piece").startswith(SKIP))
    units = units.withColumns({"upto": F.length(F.rtrim("piece", F.lit(_WHITE))), "lead": F.length("piece") - F.length(F.ltrim("piece", F.lit(_WHITE)))}).where(F.col("upto") > F.col("lead"))
    told = [unmask(F.trim("piece", F.lit(_WHITE))).alias("sentence")] if with_text else []
    return units.select(F.col("doc_id").alias(doc_id), (F.col("begin") + F.col("lead")).cast("bigint").alias("start_at"), (F.col("begin") + F.col("upto")).cast("bigint").alias("end_at"), *told)
