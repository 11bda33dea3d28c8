"""Which encoding a text of unknown origin is in, and the text itself.

Byte-order marks and valid UTF-8 decide by themselves. Everything else is scored: each candidate
decodes the bytes, and what it gives is judged by the share of letters of the scripts that the
encoding is for, by pairs that don't occur in words (a capital behind a small letter, letters of
two scripts side by side) and by characters that texts don't hold. The candidate with the highest
score is taken, the earlier one among equals. The whole text is read, whatever its length.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candidates in the order in which equals are decided, with the scripts their texts are written in.
CANDIDATES = (
    ("shift_jis", ("HIRAGANA", "KATAKANA", "CJK")),
    ("euc_jp", ("HIRAGANA", "KATAKANA", "CJK")),
    ("euc_kr", ("HANGUL",)),
    ("gb18030", ("CJK",)),
    ("big5", ("CJK",)),
    ("windows-1255", ("HEBREW",)),
    ("windows-1251", ("CYRILLIC",)),
    ("koi8-r", ("CYRILLIC",)),
    ("iso-8859-5", ("CYRILLIC",)),
    ("windows-1253", ("GREEK",)),
    ("windows-1252", ("LATIN",)),
    ("windows-1250", ("LATIN",)),
)
#: The most frequent letters beyond ASCII of texts in each one-byte encoding; others count less.
FREQUENT = {"windows-1252": "éèêàâçùûîïôëäöüßñóíáúåæøœ", "windows-1250": "ąćęłńóśźżáčďéěíňřšťúůýžőűöüäăâîșțđ", "windows-1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ", "windows-1255": "יוהלארתמבשנעםדקחפטגסןצךזכ", "windows-1253": "αοιετνσρκπηυςλμδγχωάέήίόύώθφβξ"}
#: Byte-order marks, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Escape sequences of stateful encodings.
ESCAPES = ((b"\x1b$B", "iso2022_jp"), (b"\x1b$@", "iso2022_jp"), (b"\x1b$)C", "iso2022_kr"), (b"~{", "hz"))
WIDE = ("shift_jis", "euc_jp", "euc_kr", "gb18030", "big5")
HIGH_WORDS = re.compile(rb"[A-Za-z]*[\x80-\xff][A-Za-z\x80-\xff]*").findall


def utf8_share(data: bytes) -> float:
    """1 - 0.99 * 0.5 ** n for n characters of several bytes below six, else 0.99; 0 if data isn't UTF-8."""
    try:
        n = sum(c > "\x7f" for c in data.decode("utf-8"))
    except UnicodeDecodeError:
        return 0.0
    return 1 - 0.99 * 0.5**n if n < 6 else 0.99


_kinds: dict[str, str] = {}


def _script(c: str) -> str:
    got = _kinds.get(c)
    if got is None:
        if c.isalpha():
            got = unicodedata.name(c, "OTHER").split()[0].split("-")[0]
        else:
            got = "CONTROL" if unicodedata.category(c) in ("Cc", "Co", "Cn", "Cf") and c not in "\t\n\r\f" else ""
        _kinds[c] = got
    return got


def _judge(text: str, scripts: tuple[str, ...], frequent: str) -> tuple[float, float, float, int]:
    """(characters beyond ASCII, those that fit, those that don't, hiragana)."""
    total = good = bad = 0.0
    before, small = "", False
    kana = 0
    for c in text:
        if c <= "\x7f":
            before, small = ("LATIN" if c.isalpha() else ""), c.islower()
            continue
        s = _script(c)
        total += 1
        if s in scripts:
            good += 1
            kana += s == "HIRAGANA"
            if frequent and c.lower() not in frequent:
                bad += 0.4
            elif c.isupper() and not frequent:
                bad += 0.1
            if s == "KATAKANA" and "\uff61" <= c <= "\uff9f":
                bad += 0.5  # half-width letters are rare in prose
            if s == "CJK" and not "\u4e00" <= c <= "\u9fff":
                bad += 0.5
            if c.isupper() and small:
                bad += 1  # a capital inside a word
        elif s:
            bad += 1
        elif before:
            bad += 0.5  # a sign glued to a word
        if s and before and s != before and "CJK" not in (s, before) and {s, before} != {"HIRAGANA", "KATAKANA"}:
            bad += 1
        before, small = s, c.islower()
    return total, good, bad, kana


def _plausible(parts: dict[str, int], scripts: tuple[str, ...], frequent: str = "") -> float:
    """From 0 to 1: how much what is beyond ASCII looks like words of these scripts; parts of a text with how often they occur."""
    total = good = bad = kana = 0.0
    for text, n in parts.items():
        got = _judge(text, scripts, frequent)
        total, good, bad, kana = total + n * got[0], good + n * got[1], bad + n * got[2], kana + n * got[3]
    if not total:
        return 0.0
    if "HIRAGANA" in scripts and kana * 20 < good:
        good *= 0.5  # Japanese prose holds kana
    return max(0.0, (good - bad) / total)


def _common(data: bytes, candidate: str) -> float:
    """Share of two-byte characters from the rows of a national set that hold its common characters."""
    rows = {"gb18030": (0xB0, 0xD7), "euc_kr": (0xB0, 0xC8)}.get(candidate)
    if rows is None:
        return 1.0
    lead = [data[i] for i in _leads(data)]
    letters = [b for b in lead if b not in (0xA1, 0xA2, 0xA3)]
    return sum(rows[0] <= b <= rows[1] for b in letters) / len(letters) if letters else 0.0


def _leads(data: bytes) -> list[int]:
    """Places of the first bytes of two-byte characters."""
    out, i = [], 0
    while i < len(data):
        if data[i] > 127:
            out.append(i)
            i += 2
        else:
            i += 1
    return out


def detect(data: bytes | None) -> tuple[str | None, float]:
    """(encoding, confidence). ASCII is ("us-ascii", 0): nothing in it tells; null has no encoding."""
    if data is None:
        return None, 0.0
    for mark, name in MARKS:
        if len(data) > 3 and data.startswith(mark):
            return name, 0.99
    if all(b < 128 for b in data):
        for mark, name in ESCAPES:
            if mark in data:
                try:
                    data.decode(name)
                    return name, 0.99
                except UnicodeDecodeError:
                    continue
        return "us-ascii", 0.0
    share = utf8_share(data)
    if share >= 0.5:
        return "utf-8", share
    best, name = share, "utf-8" if share else None
    words = Counter(HIGH_WORDS(data))
    for candidate, scripts in CANDIDATES:
        try:
            if candidate in WIDE:
                parts = Counter([data.decode(candidate)])
            else:  # a byte a character: only words with a high byte tell anything
                parts = {w.decode(candidate): n for w, n in words.items()}
        except UnicodeDecodeError:
            continue
        conf = 0.95 * _plausible(parts, scripts, FREQUENT.get(candidate, "")) * _common(data, candidate)
        if conf > best:
            best, name = conf, candidate
    return (name, best) if name else ("windows-1252", 0.01)


def decode(data: bytes | None) -> str | None:
    if data is None:
        return None
    name, _ = detect(data)
    for mark, _ in MARKS:
        if len(data) > 3 and data.startswith(mark):
            data = data[len(mark) :]
            break
    codecs.lookup(name)
    return data.decode(name, "replace")


def detect_charset(content: Column) -> Column:
    """struct(charset, confidence) of binary texts."""

    @F.pandas_udf("charset string, confidence double")
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect(d) for d in data], columns=["charset", "confidence"])

    return run(content)


def decode_unknown(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(decode)

    return run(content)
