"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Lines are cut into chunks in PHASES ways at once. In each way a chunk ends behind a line whose own
hash has that way's bit set, so that nothing outside a passage but the line before it decides how
the passage is cut, an inserted line moves no other boundary, and every passage of two lines or
more is a whole chunk, or made of whole chunks, in one way or another (all but one in 24 of those
with two lines). Chunks of two or more lines with words that occur more than once anywhere are
removed, but for the first, after their whole bytes were compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

#: Ways of cutting, each with chunks of two lines on average; a line's hash has 28 bits.
PHASES = 24
MIN_LINES = 2
#: Bytes of spans that are broadcast; beyond, the texts are shuffled to them.
SPAN_BYTES = 64 << 20
NO_ID = -(1 << 63)
LOW = (1 << 31) - 1
PLACE = ("id", "row", "at")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _spans(docs: DataFrame) -> DataFrame:
    """id, row, and at (first line), n (lines) and digest of each distinct chunk of MIN_LINES lines with words."""
    df = docs.select("id", "row", _lines(F.col("text")).alias("lines"))
    df = df.select(
        "id",
        "row",
        F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("digests"),
        F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]").cast("int")).alias("worded"),
    )

    def chunks(p: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: (F.get("h", i - 1).bitwiseAND(p) != 0) | (i == F.size("h")))
        begins = F.concat(F.array(F.lit(1)), F.transform(ends, lambda e: e + 1))
        return F.filter(F.zip_with(ends, begins, lambda e, b: F.shiftleft(b.cast("long"), 31) + (e - b + 1)), lambda s: s.bitwiseAND(LOW) >= MIN_LINES)

    # A chunk is one number, first line and lines, as Spark tells numbers apart by hashing and structures by comparing all pairs.
    spans = F.array_distinct(F.flatten(F.transform(F.array(*(F.lit(1 << k) for k in range(PHASES))), chunks)))
    spans = F.transform(spans, lambda s: F.struct(F.shiftright(s, 31).cast("int").alias("at"), s.bitwiseAND(LOW).cast("int").alias("n")))

    def digested(v: Column) -> Column:
        worded = lambda s: F.aggregate(F.slice(v["worded"], s["at"], s["n"]), F.lit(0), lambda a, x: a + x)
        return F.transform(F.filter(spans, lambda s: worded(s) >= MIN_LINES), lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.xxhash64(F.slice(v["digests"], s["at"], s["n"])).alias("digest")))

    # Through an array of one, so that what the spans are held against is made once a text.
    each = df.select("id", "row", F.flatten(F.transform(F.array(F.struct("digests", "worded")), digested)).alias("spans"))
    # The outer form keeps the optimizer from testing the size of the array below all the columns that it is made from.
    return each.select("id", "row", F.explode_outer("spans").alias("s")).select("id", "row", "s.*").where("digest IS NOT NULL")


def _few(spans: DataFrame, column: str) -> DataFrame:
    """Spans by document for a join with the texts: sent to every task if they are few enough for that, so that texts needn't move."""
    rows, n = spans.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    return F.broadcast(spans) if rows * 64 + (n or 0) * 32 <= SPAN_BYTES else spans.hint("shuffle_hash")


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, kept_text: one row for each row of docs (doc_id, text).

    Null counts as empty, and an empty text has one empty line. Of equal chunks the one with the
    smallest doc_id and place stays; a null doc_id comes before all others; rows with one doc_id
    come in the order of a hash of their texts, and rows that are the same in both are one
    document that is returned as often. Texts of any length are cut whole. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    each = scratch.save(_spans(base), "spans", compression="zstd")
    counts = scratch.save(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), "digests")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    repeated = salted_join(each, counts, "digest", "n_rows", total, F.struct(*PLACE))
    repeated = scratch.save(repeated.groupBy("id", "row").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "repeated", compression="zstd")
    scratch.drop(each)

    # The bytes of all lines of chunks that may repeat are compared: where no two lines share a hash, equal hashes are equal lines.
    texts = base.join(_few(repeated, "spans"), ["id", "row"]).select("id", "row", "spans", _lines(F.col("text")).alias("lines"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    every = texts.select(F.explode(F.flatten(F.transform(F.array("lines"), lambda ls: F.transform(places, lambda i: F.element_at(ls, i))))).alias("line"))
    shared = every.distinct().groupBy(F.xxhash64("line").alias("h")).count().where("count > 1")
    if shared.isEmpty():
        whole, own = F.transform("lines", lambda x: F.xxhash64(x)), lambda part: part
    else:
        whole, own = F.col("lines"), lambda part: F.array_join(part, "\n")
    chunk = lambda ls: F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), own(F.slice(ls, s["at"], s["n"])).alias("own")))
    texts = texts.select("id", "row", F.explode(F.flatten(F.transform(F.array(whole), chunk))).alias("s")).select("id", "row", "s.*")
    texts = scratch.save(texts, "chunks", compression="zstd").dropDuplicates([*PLACE, "n"])
    place = F.struct(*PLACE)
    first = scratch.save(texts.groupBy("own").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), "first", compression="zstd")
    gone = salted_join(texts, first, "own", "n_rows", total, place).where(place != F.col("first"))
    gone = scratch.save(gone.groupBy("id", "row").agg(F.collect_set(F.struct("at", "n")).alias("gone")), "gone", compression="zstd")

    out = base.join(_few(gone, "gone"), ["id", "row"], "left").select("doc_id", "gone", _lines(F.col("text")).alias("lines"))
    lost = F.flatten(F.transform("gone", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), lost)
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(F.transform(F.array("lines"), lambda ls: F.transform(stay, lambda i: F.element_at(ls, i)))))
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed_lines"), F.array_join("kept", "\n").alias("kept_text"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM l),
r AS (SELECT *, (h >> p) & 1 AS ends FROM h, (SELECT unnest(range({PHASES})) AS p)),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c AS (SELECT doc_id, p, k, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY ALL HAVING count(*) FILTER (worded) >= {MIN_LINES}),
d AS (SELECT DISTINCT doc_id, first, n, text FROM c),
g AS (SELECT doc_id, first, n, row_number() OVER (PARTITION BY text ORDER BY doc_id, first) > 1 AS gone FROM d),
x AS (SELECT DISTINCT doc_id, unnest(range(first, first + n)) AS i FROM g WHERE gone)
SELECT doc_id, count(*) AS n_lines, count(x.i) AS n_removed_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN x USING (doc_id, i) GROUP BY doc_id
"""
