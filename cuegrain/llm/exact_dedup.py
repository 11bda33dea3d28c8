"""Exact dedup over a log-structured merge index of text digests.

Each task gathers (digest, smallest doc_id, rows) in a memtable of bounded size and flushes it
as a sorted run; runs are Parquet files with Bloom filters on the digest, which Spark reads where
digests are looked up by value. Compaction deals the runs by ranges of digests, merges them in
order, keeps the smallest identifier of every digest and writes the sorted level 1, again with
filters; an older level 1 takes part in it like another run. Rows whose digest level 1 holds more than once are hits: their whole texts are compared
byte by byte with the text of the row that stays, and digests where any text differs are
grouped anew by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, Scratch, bit_filter, in_filter, salted_join

BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _memtable(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "min"), ([], "count_all")]).sort_by("digest")
        run = run.select(["digest", "doc_id_min", "count_all"]).rename_columns(["digest", "keep_id", "n"])
        yield from run.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


INDEX = "digest string, keep_id bigint, n bigint"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of sorted rows; the last digest waits for the next batch."""
    held: pa.Table | None = None

    def merged(t: pa.Table) -> pa.Table:
        t = t.group_by("digest").aggregate([("keep_id", "min"), ("n", "sum")])
        return t.select(["digest", "keep_id_min", "n_sum"]).rename_columns(["digest", "keep_id", "n"]).sort_by("digest")

    for b in batches:
        t = pa.Table.from_batches([b])
        t = merged(t if held is None else pa.concat_tables([held, t]))
        held = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def compact(runs: DataFrame) -> DataFrame:
    """Runs merged to one level: digest, keep_id, n, dealt by ranges of digests and sorted."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartitionByRange(parts, "digest").sortWithinPartitions("digest").mapInArrow(_merge, INDEX)


def build_index(docs: DataFrame, scratch: Scratch, memtable_rows: int = 1 << 16, older: DataFrame | None = None) -> DataFrame:
    """Level 1 of the index: digest, keep_id (smallest doc_id), n (rows); docs has doc_id and digest, ``older`` is a level 1 to go on from."""
    level0 = docs.select("digest", "doc_id").mapInArrow(_memtable(memtable_rows), INDEX)
    level0 = scratch.save(level0, "level0", **BLOOM)
    return scratch.save(compact(level0 if older is None else level0.unionByName(older)), "level1", **BLOOM)


def look_up(index: DataFrame, digests: list[str]) -> DataFrame:
    """The index's rows of a few digests; files whose filter has none of them are left out."""
    return index.where(F.col("digest").isin(digests))


def _may_hit(repeated: DataFrame, n: int, bound: int) -> Callable[[Column], Column] | None:
    """A predicate on digests that is true for all repeated ones; None where its bit map would pass ``bound`` bytes."""
    held = bit_filter(repeated.select(F.xxhash64("digest").alias("h")), n, bound)
    if held is None:
        return None

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(held.value, h.to_numpy()))

    return lambda digest: probe(F.xxhash64(digest))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtable_rows: int = 1 << 16, filter_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text).

    Texts are equal when identical after white-space runs became one space; null counts as empty.
    The row with the smallest doc_id stays; where rows repeat that doc_id, one of them does. A null
    doc_id loses to any other. ``digest`` is any function of the normalised text: poor ones only
    make more work for the byte comparison. Hits are found by a filter of at most ``filter_bytes``
    that is broadcast, and beyond that size by the join alone. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    index = build_index(base, scratch, memtable_rows)
    total, n_repeated = index.agg(F.sum("n"), F.count(F.when(F.col("n") > 1, 1))).first()
    total = total or 0
    repeated = index.where("n > 1")

    may_hit = _may_hit(repeated, n_repeated, filter_bytes)
    candidates = base if may_hit is None else base.where(may_hit(F.col("digest")))
    hits = scratch.save(salted_join(candidates, repeated, "digest", "n", total, F.col("doc_id")), "hits")
    keepers = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.first("n").alias("n"))
    compared = salted_join(hits.drop("n"), keepers, "digest", "n", total, F.col("doc_id"))
    collided = scratch.save(compared.where(F.col("norm") != F.col("kept_norm")).select("digest").distinct(), "collided")

    rows = base.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    if not collided.isEmpty():
        rows = rows.join(collided, "digest", "left_anti")
    # The same digest is computed for the result where another one drove the index.
    out = salted_join(rows, repeated, "digest", "n", total, F.col("doc_id"), "left")
    if digest is sha256:
        out = out.withColumn("text_sha256", F.col("digest"))
    else:
        of = base.select("digest", "doc_id", sha256(F.col("norm")).alias("text_sha256")).distinct()
        out = out.join(of.withColumnRenamed("doc_id", "_id"), (of["digest"] == out["digest"]) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", of["digest"])
    out = out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "c", "text_sha256")
    if not collided.isEmpty():
        again = hits.join(collided, "digest").withColumn("text_sha256", sha256(F.col("norm")))
        groups = again.groupBy("digest", "norm").agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        each = again.groupBy("digest", "norm", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("c"))
        out = out.unionByName(each.join(groups, ["digest", "norm"]).select("doc_id", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), "c", "text_sha256"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
