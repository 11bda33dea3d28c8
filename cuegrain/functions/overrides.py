"""Override tags of cue lines as typed columns: a table function over files, each file's lines in order.

The columns follow the tags that are asked for; a span's values are those that hold in it, so a
value is carried until another one, or a reset, takes its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Tags that change a span, with the kind of their argument.
TAGS = {
    "b": "int", "i": "flag", "u": "flag", "s": "flag", "bord": "float", "shad": "float", "be": "int", "fn": "string", "fs": "float", "fscx": "float", "fscy": "float", "fsp": "float", "frz": "float", "frx": "float", "fry": "float",
    "1c": "colour", "2c": "colour", "3c": "colour", "4c": "colour", "alpha": "colour", "1a": "colour", "2a": "colour", "3a": "colour", "4a": "colour", "r": "string", "p": "float",
}
#: Other names of the same tags, tags of the whole line, and tags that are read over.
OTHER = {"c": "1c", "fr": "frz"}
LINE = {"a": "int", "an": "int", "q": "int", "pos": "pos", "move": "move"}
SKIPPED = {"blur": "float", "fax": "float", "fay": "float", "fe": "int", "pbo": "float", "xbord": "float", "ybord": "float", "xshad": "float", "yshad": "float", "k": "int", "K": "int", "kf": "int", "ko": "int", "Kf": "int", "Ko": "int"}
#: What a change behind the first span asks of a renderer: 1 parts drawn one by one, 2 shadows of its own, 4 turned parts.
COMPLEX = {"bord": 1, "1c": 1, "3c": 1, "1a": 1, "3a": 1, "be": 1, "shad": 3, "4c": 3, "4a": 3, "alpha": 3, "r": 3, "frz": 4}
#: Tags whose value one for all transparencies sets.
ALPHAS = ("1a", "3a", "4a")

_FLOAT = r"-?(?:\d+(?:\.\d*)?|\.\d+)"
PATTERNS = {k: re.compile(v) for k, v in {"int": r"-?\d+", "flag": "[01]", "float": _FLOAT, "colour": "[H&]{0,2}([0-9A-Fa-f]+)&?", "string": "(?s).*", "pos": rf"\(({_FLOAT}),({_FLOAT})\)", "move": rf"\(({_FLOAT}),({_FLOAT})(?:,{_FLOAT}){{2,4}}\)"}.items()}
TYPES: dict[str, DataType] = {"int": IntegerType(), "flag": BooleanType(), "float": DoubleType(), "string": StringType(), "colour": LongType()}
_NAMES = sorted([*TAGS, *OTHER, *LINE, *SKIPPED], key=len, reverse=True)
_TOKEN = re.compile(r"(?s)\{([^}]*)\}|\\(.)|([^\\{]+)|(.)")
_COMMAND = re.compile(r"(?s)\\(?:(t|org|fade?|i?clip)\([^)]*\)|([^\\]*))")


def column(tag: str) -> str:
    """The column of a tag; names that begin with a digit have it at their end."""
    return tag[1:] + tag[0] if tag[0].isdigit() else tag


def commands(block: str) -> Iterator[tuple[str, object]]:
    """(tag, value) of a block's commands; what is no command is passed over."""
    for m in _COMMAND.finditer(block):
        if m[1]:
            yield m[1], None
            continue
        for name in _NAMES:
            if m[2].startswith(name):
                own = OTHER.get(name, name)
                kind = TAGS.get(own) or LINE.get(own) or SKIPPED[own]
                found = PATTERNS[kind].fullmatch(m[2][len(name) :])
                if found:
                    value = found[0]
                    yield own, {"int": int, "flag": lambda x: x == "1", "float": float, "string": str}[kind](value) if kind in ("int", "flag", "float", "string") else int(found[1], 16) if kind == "colour" else (float(found[1]), float(found[2]))
                    break


def units(text: str) -> int:
    """Length in units of 16 bits."""
    return len(text) + sum(c > "￿" for c in text)


@dataclass
class Line:
    """What holds for a whole line: the first alignment, wrapping and position that are given."""

    align: int | None = None
    wrap: int | None = None
    at: tuple[float, float] | None = None
    origin: bool = False
    complexity: int = 0


def spans(text: str) -> tuple[Line, list[tuple[int, str, dict]]]:
    """(what holds for the line, (offset, text, values) of its spans). Offsets count what is seen, in units of 16 bits; drawings are not."""
    line, values, out, shown, offset = Line(), {}, [], [], 0

    def close() -> None:
        nonlocal shown, offset
        seen = "".join(shown)
        if seen or not out:
            out.append((offset, seen, dict(values)))
        elif out:
            out.append((offset, "", dict(values)))
        offset += units(seen)
        shown = []

    begun = False
    for block, escaped, plain, odd in _TOKEN.findall(text):
        if plain or escaped or (odd and not block):
            piece = plain or {"N": "\n", "n": "\n", "h": " "}.get(escaped, escaped) or odd
            begun = True
            if not values.get("p"):
                shown.append(piece)
            continue
        if begun:
            close()
        begun = True
        for tag, value in commands(block):
            if tag in TAGS:
                if tag == "r":
                    values = {"r": value}
                else:
                    values[tag] = value
                if tag == "alpha":
                    values |= dict.fromkeys(ALPHAS, value)
                if out:
                    line.complexity |= COMPLEX.get(tag, 0)
            elif tag == "an" and line.align is None:
                line.align = value
            elif tag == "a" and line.align is None:
                line.align = value - 5 if 9 <= value <= 11 else value + 2 if 5 <= value <= 7 else value
            elif tag == "q" and line.wrap is None:
                line.wrap = value
            elif tag in ("pos", "move") and line.at is None:
                line.at = value
            elif tag == "org":
                line.origin = True
    close()
    return line, out


@dataclass
class Wanted(AnalyzeResult):
    """The tags that are asked for, beside the columns."""

    tags: tuple[str, ...] = ()


class OverrideSpans:
    """Spans of a table of cues (file, num, layer, line). ``resets``: pens go back to their place, as the layer is another than the line's before it or an origin is given."""

    def __init__(self, result: Wanted):
        self.tags, self.layer = result.tags, None

    @staticmethod
    def analyze(cues: AnalyzeArgument, tags: AnalyzeArgument) -> Wanted:
        names = tuple(t.strip() for t in (tags.value or "").split(",") if t.strip())
        if unknown := [t for t in names if t not in TAGS]:
            raise ValueError(f"no such tags: {', '.join(unknown)}")
        file = cues.dataType["file"].dataType
        fixed = [("file", file), ("num", LongType()), ("span", IntegerType()), ("offset", IntegerType()), ("text", StringType()), ("align", IntegerType()), ("wrap", IntegerType()), ("x", DoubleType()), ("y", DoubleType()), ("resets", BooleanType()), ("complexity", IntegerType())]
        schema = StructType([*(StructField(n, t) for n, t in fixed), *(StructField(column(t), TYPES[TAGS[t]]) for t in names)])
        return Wanted(schema=schema, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("num")], tags=names)

    def eval(self, cues, tags: str) -> Iterator[tuple]:
        line, found = spans(cues["line"] or "")
        resets = line.origin or cues["layer"] != self.layer
        self.layer = cues["layer"]
        for n, (offset, text, values) in enumerate(found):
            yield (cues["file"], cues["num"], n, offset, text, line.align, line.wrap, *(line.at or (None, None)), resets, line.complexity, *(values.get(t) for t in self.tags))


def override_spans(cues: DataFrame, *tags: str) -> DataFrame:
    """Spans of cues (file, num, layer, line) with a typed column for each of ``tags`` (TAGS; names that begin with a digit have it at their end); SQL has it as ``override_spans(TABLE(cues), 'b,i')``."""
    table = F.udtf(OverrideSpans)
    rows = cues.select("file", F.col("num").cast("long").alias("num"), F.col("layer").cast("int").alias("layer"), "line")
    return table(rows.asTable(), F.lit(",".join(tags)))


def register(spark: SparkSession) -> None:
    """Make the table function known to SQL."""
    spark.udtf.register("override_spans", F.udtf(OverrideSpans))


def span_css(has: list[str]) -> Column:
    """The declarations of a span, from the columns of those of its tags b, i, u, s, fn, fs, 1c, 4c that are there."""
    hexed = lambda c: F.lower(F.concat(*(F.substring(F.lpad(F.hex(c), 6, "0"), i, 2) for i in (5, 3, 1))))
    rules = {
        "b": lambda c: F.concat(F.lit("font-weight: "), F.when(c != 0, "bold").otherwise("normal")),
        "i": lambda c: F.concat(F.lit("font-style: "), F.when(c, "italic").otherwise("normal")),
        "u": lambda c: F.concat(F.lit("text-decoration: "), F.when(c, "underline").otherwise("none")),
        "s": lambda c: F.concat(F.lit("text-decoration: "), F.when(c, "line-through").otherwise("none")),
        "fn": lambda c: F.concat(F.lit("font-family: "), c),
        "fs": lambda c: F.concat(F.lit("font-size: "), (c * 0.75).cast("decimal(12,2)").cast("string"), F.lit("pt")),
        "c1": lambda c: F.concat(F.lit("color: #"), hexed(c)),
        "c4": lambda c: F.concat(F.lit("text-shadow: #"), hexed(c), F.lit(" 2px 2px 0")),
    }
    parts = [F.when(F.col(n).isNotNull(), rule(F.col(n))) for n, rule in rules.items() if n in has]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")
