"""The readable text of a raw mail, and its words.

Mails in an archive are often broken, so nothing here raises: what can't be decoded is
taken as it is.
"""

from __future__ import annotations

import base64
import html
import quopri
import re
import unicodedata

_BLANK_LINE = re.compile(r"\r?\n[ \t]*\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")
_TYPE = re.compile(r"^content-type:[ \t]*([^;\s]*)(.*)$", re.I | re.M)
_ENCODING = re.compile(r"^content-transfer-encoding:[ \t]*([^\s;]+)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"]*)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([\w.:+-]+)", re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_ENCODED_WORD = re.compile(r"=\?([\w.:+-]+)\?([bq])\?([^?\s]*)\?=", re.I)
_ENCODED_GAP = re.compile(r"(\?=)[ \t]*(?:\r?\n)?[ \t]+(=\?)")
_UNSEEN = re.compile(r"<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
# Elements that don't interrupt a word.
_INLINE = "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup tt u var wbr".split()
_INLINE_TAG = re.compile(r"</?(?:%s)(?:\s[^<>]*|/)?>" % "|".join(_INLINE), re.I)
_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.I)
_LOOKS_HTML = re.compile(r"</?(?:html|body|p|br|div|span|b|i|a|table|td|tr|ul|li|blockquote|font)\b[^<>]*>", re.I)
#: Characters that take no space and have no say in a word: format characters, variation selectors, joiners.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")
_WORD = re.compile(r"[^\W_]+")

_TEXT_LIKE = ("text/", "message/")


def _charset(params: str) -> str:
    found = _CHARSET.search(params)
    return found[1] if found else "utf-8"


def _bytes_to_text(data: bytes, charset: str) -> str:
    try:
        return data.decode(charset)
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def _decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        letters = _NOT_BASE64.sub("", body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        return _bytes_to_text(base64.b64decode(letters + "=" * (-len(letters) % 4)), charset)
    if encoding == "quoted-printable":
        return _bytes_to_text(quopri.decodestring(body.encode("utf-8", "surrogatepass")), charset)
    return body


def _encoded_word(found: re.Match) -> str:
    charset, kind, data = found.groups()
    return _decode(data if kind in "bB" else data.replace("_", "=20"), "base64" if kind in "bB" else "quoted-printable", charset)


def from_html(text: str) -> str:
    """Text of an HTML body: unseen parts dropped, inline tags joined over, other tags as gaps, entities resolved."""
    text = _UNSEEN.sub(" ", text)
    text = _INLINE_TAG.sub("", text)
    return html.unescape(_TAG.sub("\n", text))


def texts(mail: str) -> list[str]:
    """The decoded texts of a mail: its header, and every part that may hold text, with the part's header.

    A part whose first block doesn't say what it is may well have no header, so all of it is
    one text. Parts may be nested to any depth.
    """
    out, waiting, inner = [], [mail], False
    while waiting:
        part = waiting.pop()
        cut = _BLANK_LINE.search(part)
        head, body = (part[: cut.start()], part[cut.end() :]) if cut else (part, "")
        if part.startswith(("\n", "\r\n")):
            head, body = "", part.lstrip("\r\n")
        head = _FOLD.sub(" ", head)
        kind = _TYPE.search(head)
        media, params = (kind[1].lower(), kind[2]) if kind else ("", "")
        encoding = found[1].lower() if (found := _ENCODING.search(head)) else ""
        shown = _ENCODED_WORD.sub(_encoded_word, _ENCODED_GAP.sub(r"\1\2", head)) if "=?" in head else head
        if inner and head and not media and not encoding:
            body = f"{shown}\n\n{body}"
        elif head or not inner:
            out.append(shown)
        inner = True
        if not body:
            continue
        boundary = (found[1] or found[2] or "").rstrip() if (found := _BOUNDARY.search(params)) else ""
        if media.startswith("multipart/") and boundary:
            pieces = re.split(r"(?:^|\r?\n)--" + re.escape(boundary) + r"(?:--)?[ \t]*(?=\r?\n|$)", body)
            out.append(pieces[0])
            waiting += [piece[2:] if piece.startswith("\r\n") else piece[1:] for piece in reversed(pieces[1:])]
        elif media.startswith("message/"):
            waiting.append(body)
        elif not media or media.startswith(_TEXT_LIKE) or media.startswith("multipart/"):
            text = _decode(body, encoding, _charset(params))
            if media == "text/html":
                out.append(from_html(text))
                continue
            if "<" in text and _LOOKS_HTML.search(text):
                out.append(from_html(text))
            out.append(text)
    return out


def words(text: str) -> list[str]:
    """Runs of letters and digits, regardless of case, composition and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))
    return _WORD.findall(text.lower())
