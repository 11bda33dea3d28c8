"""Subtitle files as cues: SubRip, SubStation, SAMI and VobSub index files.

Files are read with ``binaryFile``; texts are cut with Spark's own functions, one row a block or
line, so that a large file's lines are spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.charset import decode_unknown

#: Fields of SubStation rows, in the order that they are read in whatever a file's Format line says.
EVENT_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")
STYLE_FIELDS_ASS = ("Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "OutlineColour", "BackColour", "Bold", "Italic", "Underline", "StrikeOut", "ScaleX", "ScaleY", "Spacing", "Angle", "BorderStyle", "Outline", "Shadow", "Alignment", "MarginL", "MarginR", "MarginV", "Encoding")

STYLE_FIELDS_SSA = ("Name", "Fontname", "Fontsize", "PrimaryColour", "SecondaryColour", "TertiaryColour", "BackColour", "Bold", "Italic", "BorderStyle", "Outline", "Shadow", "Alignment", "MarginL", "MarginR", "MarginV", "AlphaLevel", "Encoding")


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, text: files of unknown encoding, decoded, with one kind of newline and without a byte-order mark."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file"), F.regexp_replace(tx.one_newline(decode_unknown(F.col("content"))), "^﻿", "").alias("text"))


def srt_cues(texts: DataFrame) -> DataFrame:
    """file, num, begin, end, line (milliseconds): blocks of a number, a time line and a body, parted by empty lines."""
    blocks = texts.select("file", F.posexplode(F.split(F.regexp_replace("text", r"\n[ \t]*(?=\n)", "\n"), r"\n{2,}")).alias("num", "block"))
    time = r"(?s)^\s*\d+[ \t]*\n([\d:,.]+)[ \t]*-->[ \t]*([\d:,.]+)[^\n]*\n(.+)$"
    found = blocks.where(F.col("block").rlike(time))
    part = lambda i: F.regexp_extract("block", time, i)
    return found.select("file", F.col("num").cast("long").alias("num"), tx.parse_subtime(part(1), 1000).alias("begin"), tx.parse_subtime(part(2), 1000).alias("end"), tx.srt_tags(F.regexp_replace(part(3), r"\n+$", "")).alias("line"))


def script_lines(texts: DataFrame) -> DataFrame:
    """file, n, section, key, value of each "key: value" line of a SubStation script."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(F.when(F.col("raw").rlike(r"^\s*\[.*\]"), F.lower(F.regexp_extract("raw", r"\[(.*?)\]", 1))), ignorenulls=True).over(w))
    pair = r"^([^:;!\[]+):\s*(.*)$"
    return lines.where(F.col("raw").rlike(pair)).select("file", F.col("n").cast("long").alias("n"), "section", F.trim(F.regexp_extract("raw", pair, 1)).alias("key"), F.regexp_extract("raw", pair, 2).alias("value"))


def script_headers(texts: DataFrame) -> DataFrame:
    """file, headers: map of a script's information section; of repeated keys the last."""
    rows = script_lines(texts).where(F.col("section").startswith("script info"))
    one = rows.groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))
    return one.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("headers"))


def _fields(value: Column, names: tuple[str, ...]) -> Column:
    parts = F.split(value, ",", len(names))
    return F.when(F.size(parts) == len(names), F.struct(*(F.trim(F.get(parts, i)).alias(n) if n != "Text" else F.get(parts, i).alias(n) for i, n in enumerate(names))))


def script_styles(texts: DataFrame) -> DataFrame:
    """file and typed style columns; rows with another number of fields than their section's are dropped; of equal names the last wins, a leading * is dropped.

    Sections of the older kind ("V4 Styles") have 18 fields and number alignments by rows of four.
    """
    rows = script_lines(texts).where((F.lower("key") == "style") & F.col("section").startswith("v4"))
    new = F.col("section").startswith("v4+")
    fields = F.split("value", ",")
    of = F.when(new & (F.size(fields) == len(STYLE_FIELDS_ASS)), True).when(~new & (F.size(fields) == len(STYLE_FIELDS_SSA)), False)
    rows = rows.withColumns({"new": of, "fields": F.transform(fields, lambda x: F.trim(x))}).where("new IS NOT NULL")

    def field(name: str):
        old = F.get("fields", STYLE_FIELDS_SSA.index(name)) if name in STYLE_FIELDS_SSA else F.lit(None).cast("string")
        return F.when(F.col("new"), F.get("fields", STYLE_FIELDS_ASS.index(name))).otherwise(old)

    number = lambda n, d: F.coalesce(field(n).try_cast("double"), F.lit(d))
    flag = lambda n: F.coalesce(field(n).try_cast("int"), F.lit(0)) != 0
    font, place = field("Fontname"), field("Alignment").try_cast("int")
    typed = F.struct(
        F.regexp_replace(font, "^@", "").alias("font"), font.startswith("@").alias("vertical"), number("Fontsize", 0.0).alias("size"), tx.colour_number(field("PrimaryColour")).alias("primary"),
        flag("Bold").alias("bold"), flag("Italic").alias("italic"), F.coalesce(F.nullif(number("ScaleX", 100.0), F.lit(0.0)), F.lit(100.0)).alias("scale_x"), F.coalesce(F.nullif(number("ScaleY", 100.0), F.lit(0.0)), F.lit(100.0)).alias("scale_y"),
        F.coalesce(F.when(F.col("new"), place).otherwise(tx.ass_alignment(place)), F.lit(2)).alias("alignment"),
    )
    return rows.groupBy("file", F.regexp_replace(field("Name"), r"^\*+", "").alias("name")).agg(F.max_by(typed, "n").alias("style")).select("file", "name", "style.*")


def script_cues(texts: DataFrame) -> DataFrame:
    """file, num, begin, end (hundredths of a second), layer, style, line: the dialogue rows of a script."""
    rows = script_lines(texts).where((F.lower("key") == "dialogue") & (F.col("section") == "events")).withColumn("e", _fields(F.col("value"), EVENT_FIELDS)).where("e IS NOT NULL")
    return rows.select("file", F.col("n").alias("num"), tx.parse_subtime(F.col("e.Start"), 100).alias("begin"), tx.parse_subtime(F.col("e.End"), 100).alias("end"), F.coalesce(F.col("e.Layer").try_cast("int"), F.lit(0)).alias("layer"), F.regexp_replace("e.Style", r"^\*+", "").alias("style"), F.col("e.Text").alias("line"))


TAG = r"\{[^}]*\}"


def spans(cues: DataFrame) -> DataFrame:
    """file, num, span, offset, text, tags: a cue's text cut at its override tags; offsets count characters that are seen.

    tags is an array of (name, argument) that hold from this span on.
    """
    parts = F.transform(F.split("line", TAG), lambda p: tx.cue_escapes(p))
    blocks = F.regexp_extract_all("line", F.lit(f"({TAG})"), F.lit(1))
    name = r"\\(1c|2c|3c|4c|1a|2a|3a|4a|alpha|an|a|blur|bord|be|b|clip|c|fad|fade|fax|fay|fn|frx|fry|frz|fr|fscx|fscy|fsp|fs|fe|iclip|i|k[fo]?|K|move|org|pbo|pos|p|q|r|s|shad|t|u)(\([^)]*\)|[^\\})]*)"
    named = lambda b: F.transform(F.regexp_extract_all(b, F.lit(name), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, name, 1).alias("tag"), F.regexp_extract(x, name, 2).alias("arg")))
    df = cues.select("file", "num", "begin", "end", parts.alias("parts"), blocks.alias("blocks"))
    # The first part stands before every tag.
    rows = df.select("file", "num", "blocks", F.posexplode("parts").alias("span", "text"))
    w = Window.partitionBy("file", "num").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tags = F.when(F.col("span") > 0, named(F.get("blocks", F.col("span") - 1))).otherwise(F.array().cast("array<struct<tag:string,arg:string>>"))
    return rows.select("file", "num", "span", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("offset"), "text", tags.alias("tags")).where((F.length("text") > 0) | (F.size("tags") > 0))


def sami_cues(texts: DataFrame, last: int | None = None) -> DataFrame:
    """file, class, num, begin, end, line (milliseconds): a cue lasts until the next sync of its class; the last one is dropped, or with ``last`` stays so many milliseconds."""
    syncs = texts.select("file", F.posexplode(F.split("text", r"(?i)<sync\s+")).alias("k", "part")).where("k > 0")
    begin = F.coalesce(F.regexp_extract("part", r"(?i)^start\s*=\s*\"?(-?\d+)", 1).try_cast("long"), F.lit(0))
    syncs = syncs.select("file", "k", begin.alias("begin"), F.regexp_replace("part", r"(?s)^[^>]*>", "").alias("part"))
    paras = syncs.select("file", "k", "begin", F.posexplode(F.split("part", r"(?i)<p\b")).alias("i", "para")).where("i > 0")
    cls = F.upper(F.regexp_extract("para", r"(?i)^[^>]*class\s*=\s*\"?(\w+)", 1))
    body = F.regexp_replace(F.regexp_replace("para", r"(?s)^[^>]*>", ""), r"(?is)</?(p|sync|body|sami)[^>]*>", "")
    body = F.regexp_replace(F.regexp_replace(tx.sami_space(body), r"(?i)<br\s*/?>", "\n"), r"(?i)<(/?)(i|b|u)>", "{\\\\$2#$1}")
    body = F.regexp_replace(F.regexp_replace(body, r"#\}", "1}"), r"#/\}", "0}")
    rows = paras.select("file", cls.alias("class"), F.col("k").cast("long").alias("num"), "begin", F.trim(tx.strip_flat_tags(body)).alias("line"))
    until = F.lead("begin").over(Window.partitionBy("file", "class").orderBy("num"))
    if last is not None:
        until = F.coalesce(until, F.col("begin") + last)
    return rows.withColumn("end", until).where("end IS NOT NULL AND line <> ''").select("file", "class", "num", "begin", "end", "line")


def sami_tracks(texts: DataFrame, classes: DataFrame, last: int | None = None) -> DataFrame:
    """file, language, num, begin, end, line: the cues of both languages of SAMI texts, one under the other.

    ``classes`` (file, first, second) names the classes of each file; cues of other classes are left
    out. A language's last cue, which no later one ends, is left out, or with ``last`` stays so many
    milliseconds.
    """
    cues = sami_cues(texts, last)
    one = lambda n, name: cues.join(classes.select("file", F.upper(name).alias("class")).where("class IS NOT NULL"), ["file", "class"]).select("file", F.lit(n).alias("language"), "num", "begin", "end", "line")
    return one(1, "first").unionByName(one(2, "second"))


def vobsub_index(texts: DataFrame) -> DataFrame:
    """file, track, lang, ts, filepos of each timestamp line (milliseconds); a delay line holds for all that follow in its track."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    get = lambda p, i=1: F.nullif(F.regexp_extract("raw", p, i), F.lit(""))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"lang_": get(r"^id:\s*(\w\w)"), "opens": F.col("raw").rlike(r"^id:\s").cast("int")}).withColumns({"track": F.sum("opens").over(w), "lang": F.last("lang_", ignorenulls=True).over(w)})
    delay = F.when(F.col("raw").rlike(r"^delay:"), tx.parse_subtime(get(r"^delay:\s*([-+]?[\d:]+)"), 1000, signed=True)).when(F.col("opens") == 1, F.lit(0).cast("long"))
    lines = lines.withColumn("delay", F.coalesce(F.last(delay, ignorenulls=True).over(w), F.lit(0)))
    stamp = r"^timestamp:\s*([\d:]+),\s*filepos:\s*([0-9a-fA-F]+)"
    return lines.where(F.col("raw").rlike(stamp)).select("file", F.col("track").cast("long").alias("track"), "lang", (tx.parse_subtime(get(stamp, 1), 1000) + F.col("delay")).alias("ts"), F.conv(get(stamp, 2), 16, 10).cast("long").alias("filepos"))


def html_page(packets: DataFrame) -> DataFrame:
    """file, html: packets (file, begin, end, text) as one list a file, top lines first; each packet keeps its times."""
    safe = F.replace(F.replace(F.replace(F.regexp_replace("text", r"\n$", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))
    item = F.concat(F.lit('<p data-begin="'), F.col("begin").cast("string"), F.lit('" data-end="'), F.col("end").cast("string"), F.lit('">'), safe, F.lit("</p>"))
    rows = packets.where("text <> '\n'").select("file", "begin", item.alias("item"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "item"))), lambda x: x["item"]), "\n").alias("html"))


def screen_html(divs: Column) -> Column:
    """A packet's page from its parts: struct(place: top, bottom or absolute, x, y, style, spans: array of struct(css, text)).

    Parts on top come first, then those at the bottom from the last to the first, then those with a place of their own.
    """
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))
    span = lambda x: F.concat(F.when(x["css"] != "", F.concat(F.lit('<span style="'), x["css"], F.lit('">'))).otherwise(""), safe(x["text"]))

    def part(d: Column) -> Column:
        opened = F.size(F.filter(d["spans"], lambda x: x["css"] != "")) + 1
        body = F.concat(F.lit('<span class="'), F.regexp_replace(d["style"], "[^A-Za-z0-9_-]", "_"), F.lit('">'), F.array_join(F.transform(d["spans"], span), ""), F.repeat(F.lit("</span>"), opened))
        place = F.concat(F.lit('<div style="top: '), d["y"].cast("string"), F.lit("px; left: "), d["x"].cast("string"), F.lit('px; position: absolute">'))
        return F.concat(F.when(d["place"] == "absolute", F.concat(place, body, F.lit("</div>"))).otherwise(body), F.lit("\n"))

    at = lambda place: F.filter(divs, lambda d: d["place"] == place)
    group = lambda name, parts: F.when(F.size(parts) > 0, F.concat(F.lit(f'<div class="{name}">\n'), F.array_join(F.transform(parts, part), ""), F.lit("</div>\n"))).otherwise("")
    return F.concat(F.lit('<div class="screen">\n'), group("top", at("top")), group("bottom", F.reverse(at("bottom"))), F.array_join(F.transform(at("absolute"), part), ""), F.lit("</div>\n<br>\n"))


def default_style(aspect: Column) -> Column:
    """The style of cues that name none; its size follows the picture's aspect."""
    values = {"name": "Default", "font": "Helvetica", "primary": "FFFFFF", "outline_colour": "000000", "scale_x": 100.0, "scale_y": 100.0, "spacing": 0.0, "angle": 0.0, "outline": 1.5, "shadow": 2.0, "margin": 20, "bold": False, "italic": False, "alignment": 2}
    return F.struct((F.sqrt(aspect * 0.75) * 32).alias("size"), *(F.lit(v).alias(k) for k, v in values.items()))


def vobsub_samples(index: DataFrame, files: DataFrame) -> DataFrame:
    """file, track, lang, ts, sample: the bytes of each subpicture; index as of ``vobsub_index``, files: file, content of the picture file of the same name.

    A picture goes on to the next place in its track, the last to the end of the file; places that run backward are skipped.
    """
    w = Window.partitionBy("file", "track").orderBy("ts", "filepos")
    places = index.withColumn("until", F.lead("filepos").over(w)).groupBy("file").agg(F.collect_list(F.struct("track", "lang", "ts", "filepos", "until")).alias("places"))  # the lines of one index file
    end = lambda p: F.coalesce(p["until"], F.octet_length("content").cast("long"))
    whole = places.join(files, "file").withColumn("places", F.filter("places", lambda p: end(p) > p["filepos"]))
    cut = F.transform("places", lambda p: F.struct(p["track"].alias("track"), p["lang"].alias("lang"), p["ts"].alias("ts"), F.substr("content", p["filepos"].cast("int") + 1, (end(p) - p["filepos"]).cast("int")).alias("sample")))
    return whole.select("file", F.inline(cut))


def side_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("srt", "ass", "ssa", "idx", "smi")) -> DataFrame:
    """dir, name, size of the subtitle files below a folder; only names are listed, contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), name.alias("name"), F.col("length").alias("size"))
    return rows.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes))
