"""Scalar text functions on columns, built from Spark's own; one that needs a running level is an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SUBTIME = r"^([+-]?)(\d+):(\d+):(\d+)[,.:](\d+)"


def parse_subtime(t: Column, scale: int, signed: bool = False) -> Column:
    """H:M:S<sep>fraction as ticks; the fraction is a plain number of ticks (",5" is 5). Anything else is 0."""
    g = lambda i: F.regexp_extract(t, SUBTIME, i)
    ticks = ((g(2).cast("long") * 60 + g(3).cast("long")) * 60 + g(4).cast("long")) * scale + g(5).cast("long")
    ok = F.coalesce(t.rlike(SUBTIME), F.lit(False))
    return F.when(ok & (F.lit(signed) & (g(1) == "-")), -ticks).when(ok, ticks).otherwise(0)


def filename_language(name: Column) -> Column:
    """The last dotted part before the extension if it has two or three letters, else null; without a dot the base name is tested."""
    base = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    part = F.substring_index(base, ".", -1)
    return F.when(part.rlike("^[A-Za-z]{2,3}$"), F.lower(part))


def packet_line(n: Column, *fields: Column) -> Column:
    """n + 1 and the fields of a line, joined by commas; "(null)" for null."""
    return F.concat_ws(",", (n + 1).cast("string"), *(F.coalesce(f.cast("string"), F.lit("(null)")) for f in fields))


# Names of colours in SAMI files.
COLOURS = {
    "aqua": "00FFFF", "black": "000000", "blue": "0000FF", "fuchsia": "FF00FF", "gray": "808080", "green": "008000", "lime": "00FF00", "maroon": "800000",
    "navy": "000080", "olive": "808000", "purple": "800080", "red": "FF0000", "silver": "C0C0C0", "teal": "008080", "white": "FFFFFF", "yellow": "FFFF00",
}


def override_colour(value: Column) -> Column:
    """#RRGGBB, RRGGBB or a name as a colour tag, whose bytes run blue, green, red; white for anything else."""
    names = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    digits = F.coalesce(names[F.lower(value)], F.when(value.rlike("^#?[0-9A-Fa-f]{6}$"), F.right(value, F.lit(6))), F.lit("FFFFFF"))
    s = lambda i: F.substring(digits, i, 2)
    return F.concat(F.lit("{\\1c&H"), F.upper(F.concat(s(5), s(3), s(1))), F.lit("&}"))


def sami_classes(text: Column) -> Column:
    """struct(first, second): the class of a file's first paragraph, and of the first one in its last tenth if that is another; noClass where there is none."""
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(?is)<P CLASS=\s*([^>]+)", 1), F.lit("")), F.lit("noClass"))
    first = name(text)
    second = name(F.substr(text, F.floor(F.length(text) * 9 / 10).cast("int") + 1))
    return F.struct(first.alias("first"), F.when(second == first, "noClass").otherwise(second).alias("second"))


def sami_language(tag: Column, classes: Column) -> Column:
    """1 or 2 for a paragraph of the first or second class, 3 for all others."""
    own = F.coalesce(F.nullif(F.regexp_extract(tag, r"(?i)CLASS=\s*([^>]+)", 1), F.lit("")), F.lit("noClass"))
    return F.when(own == classes["first"], 1).when(own == classes["second"], 2).otherwise(3)


def outside_tags(text: str) -> str:
    """The text where as many tags have ended as begun, with a space for each end of an outermost tag; in one pass."""
    out, level = [], 0
    for part in re.findall(r"[<>]|[^<>]+", text):
        level += (part == "<") - (part == ">")
        if not level and part != "<":
            out.append(" " if part == ">" else part)
    return "".join(out)


def strip_nested_tags(s: Column) -> Column:
    """The text outside all tags; where an outermost tag ends stands a space. Tags may hold others.

    A running level over the marks of a text has no built-in form that is linear in them (arrays are
    copied when they grow), so this is an Arrow function.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else outside_tags(x) for x in texts], dtype=object)

    return run(s)


def words_outside_tags(s: Column) -> Column:
    """Runs of letters and non-ASCII characters outside tags, a space apart; a tag that isn't closed goes to the end."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(s, "<[^>]*(>|$)", " "), F.lit(r"([A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1)), " ")


def sync_start(tag: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.upper(tag), r"^SYNC\s+START=\s*(-?\d+)", 1).try_cast("long"), F.lit(0))


def one_newline(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def sami_space(s: Column) -> Column:
    return F.replace(F.regexp_replace(s, "[\r\n]", ""), F.lit("&nbsp;"), F.lit(" "))


def split_trim(s: Column, sep: str) -> Column:
    return F.transform(F.split(s, sep), lambda x: F.trim(x))


def split_n(s: Column, sep: str, n: int, repeat_last: bool = False) -> Column:
    """At most n fields, the last keeps the rest. ``repeat_last``: too few fields repeat the last one once, as an old scanner did."""
    parts = F.split(s, sep, n)
    if not repeat_last:
        return parts
    # An empty last field is not scanned: the one before stands twice.
    scanned = F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    short = F.size(scanned) < n
    return F.when(short, F.array_append(scanned, F.element_at(scanned, -1))).otherwise(scanned)


def srt_tags(s: Column) -> Column:
    for a, b in (("<i>", "{\\i1}"), ("</i>", "{\\i0}"), ("<", "{"), (">", "}")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def cue_escapes(s: Column) -> Column:
    r"""\N and \n are line feeds, \h a no-break space, any other escaped character itself."""
    s = F.regexp_replace(s, r"\\[Nn]", "\n")
    s = F.regexp_replace(s, r"\\h", " ")
    return F.regexp_replace(s, r"\\(.)", "$1")


def colour_parts(c: Column) -> dict[str, Column]:
    """Red, green, blue and alpha from 0 to 1 of a packed colour whose bytes run alpha, blue, green, red; alpha is stored inverted."""
    part = lambda n: F.shiftright(c, n).bitwiseAND(F.lit(255)) / 255.0
    return {"r": part(0), "g": part(8), "b": part(16), "a": 1 - part(24)}


def colour_number(s: Column) -> Column:
    """&H hexadecimal or decimal text as a number."""
    return F.when(F.upper(s).startswith("&H"), F.conv(F.regexp_replace(F.upper(s), "[&H]", ""), 16, 10).cast("long")).otherwise(F.coalesce(s.try_cast("long"), F.lit(0)))


def ass_alignment(ssa: Column) -> Column:
    """Numeric-pad alignment of an old one: 1-3 stay, 5-7 are on top, 9-11 in the middle."""
    return F.when(ssa.between(9, 11), ssa - 5).when(ssa.between(5, 7), ssa + 2).otherwise(ssa)


def alignment_parts(a: Column) -> tuple[Column, Column]:
    """(horizontal, vertical) from 0: left, centre, right; bottom, middle, top. Anything outside 1-9 is bottom centre."""
    ok = a.between(1, 9)
    return F.when(ok, (a - 1) % 3).otherwise(1), F.when(ok, F.floor((a - 1) / 3).cast("int")).otherwise(0)


def version_parts(v: Column) -> Column:
    """Runs of digits, of other characters, and every period by itself."""
    return F.regexp_extract_all(v, F.lit(r"(\d+|\.|[^\d.]+)"), F.lit(1))


def is_older(a: Column, b: Column) -> Column:
    """a < b as text, or a is b with a beta mark behind it; b with such a mark is not newer than a."""
    beta = lambda x, y: x.startswith(F.concat(y, F.lit("b")))
    return F.when(beta(b, a), F.lit(False)).otherwise((a < b) | beta(a, b))


def newer_than(a: Column, b: Column) -> Column:
    """Numbered parts compare as numbers, others as text, missing ones are smallest."""
    typed = lambda v: F.transform(version_parts(v), lambda p: F.struct(F.when(p.rlike(r"^\d"), 2).when(p == ".", 1).otherwise(0).alias("k"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("n"), p.alias("s")))
    return typed(a) > typed(b)


def strip_flat_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^<>]*>", " ")


def fourcc_text(n: Column) -> Column:
    """Four characters of a packed code; small numbers as hexadecimal."""
    return F.when(n < 1 << 24, F.concat(F.lit("0x"), F.lower(F.hex(n)))).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "ISO-8859-1"))


def css_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "_")


def words_with_high_bytes(s: Column) -> Column:
    """Words (runs of letters and of characters beyond ASCII) that hold one beyond ASCII, each with a space behind."""
    words = F.regexp_extract_all(s, F.lit(r"([A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1))
    return F.array_join(F.transform(F.filter(words, lambda w: w.rlike(r"[^\x00-\x7F]")), lambda w: F.concat(w, F.lit(" "))), "")
