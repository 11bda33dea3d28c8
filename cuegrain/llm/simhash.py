"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt by their 16-bit blocks: two that differ in at most three bits
agree in one of the four blocks. The rows of a block value are sorted by their number of set
bits and cut into tiles; tile pairs whose bit counts differ by more than the radius are
skipped, all others are compared whole with exclusive-or and bit counts in numpy. Block values
with many rows are dealt over pairs of sub-groups, so that no task holds more than two of
them. Links leave a task as stars, and alternating large and small stars join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

TILE = 512
#: Rows of one block value above which it is dealt over pairs of sub-groups.
HOT_BLOCK = 4096
BLOCKS = 4


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([hashed(joined, 42)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp: signed 64-bit SimHash."""

    @F.pandas_udf("bigint")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", udf(F.col("text").cast("binary")).alias("fp"))


def _links(values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius. Rows are sorted by group and number of set bits."""
    pop = np.bitwise_count(values).astype(np.int16)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= 64, sizes)
    # Small groups share tiles: row i meets row i + d while both are in one group.
    live = np.flatnonzero(small[:-1] & (group[1:] == group[:-1]))
    d = 1
    while len(live):
        near = np.bitwise_count(values[live] ^ values[live + d]) <= radius
        if near.any():
            yield live[near], live[near] + d
        d += 1
        live = live[live + d < len(values)]
        live = live[(group[live] == group[live + d]) & (pop[live + d] - pop[live] <= radius)]
    for at, n in zip(edges[:-1][sizes > 64], sizes[sizes > 64], strict=True):
        tiles = [(lo, min(lo + TILE, at + n)) for lo in range(at, at + n, TILE)]
        for i, (a, b) in enumerate(tiles):
            for c, e in tiles[i:]:
                if pop[c] - pop[b - 1] > radius:
                    break
                x, y = np.nonzero(np.bitwise_count(values[a:b, None] ^ values[None, c:e]) <= radius)
                if a == c:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield x + a, y + c


def _stars(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n rows."""
    label = np.arange(n)
    for x, y in links:
        while True:
            a, b = label[x], label[y]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(values: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            label = _stars(len(values), _links(values, group, radius))
            at = np.flatnonzero(label != np.arange(len(label)))
            if len(at):
                u, v = values[at].view(np.int64), values[label[at]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        values, group = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for b in batches:
            keys = [b.column(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in ("block", "ta", "tb")]
            values = np.concatenate([values, b.column("fp").to_numpy().view(np.uint64)])
            group = np.concatenate([group, keys[0] << np.uint64(44) | keys[1] << np.uint64(22) | keys[2]])
            ends = np.flatnonzero(group[1:] != group[:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut > 1 << 14:
                yield from done(values[:cut], group[:cut])
                values, group = values[cut:], group[cut:]
        if len(values):
            yield from done(values, group)

    return run


def links(distinct: DataFrame, scratch: Scratch, radius: int = 3, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Edges (u > v) that join all fingerprints (column fp, distinct) within the radius, as stars."""
    if radius >= BLOCKS:
        raise ValueError(f"a radius of {radius} needs more than {BLOCKS} blocks")
    blocks = distinct.select("fp", F.posexplode(F.array(*(F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(BLOCKS)))).alias("k", "bits"))
    blocks = blocks.select("fp", (F.col("k") * 65536 + F.col("bits")).alias("block"))
    sizes = blocks.groupBy("block").count().where(F.col("count") > hot_block)  # at most 4 * 65,536 rows
    hot = sizes.select("block", F.ceil(F.col("count") / hot_block).cast("int").alias("q"))
    dealt = blocks.join(F.broadcast(hot), "block", "left").withColumn("q", F.coalesce("q", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("q").cast("long")).cast("int")
    dealt = dealt.select("fp", "block", own.alias("t"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("other"))
    dealt = dealt.select("fp", "block", F.least("t", "other").alias("ta"), F.greatest("t", "other").alias("tb"))
    dealt = dealt.repartition("block", "ta", "tb").sortWithinPartitions("block", "ta", "tb", F.bit_count("fp"), "fp")
    return scratch.save(dealt.mapInArrow(_compare(radius), "u bigint, v bigint").distinct(), "links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, root: the smallest fingerprint reachable, for every one with a link (u > v)."""

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = both.join(low, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    seen = None
    while True:
        edges = scratch.save(star(star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        seen = now


def simhash_near_dedup(docs: DataFrame, radius: int = 3, shingle: int = 3, hot_block: int = HOT_BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs (doc_id, text).

    A text without words (null, empty, white space) has fingerprint zero and links like any other.
    component_id is the smallest doc_id reachable over fingerprints that differ in ``radius`` bits
    at most; null doc_ids never are the smallest unless all are null. Repeated rows come back as
    often as they went in; no rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    each = scratch.save(fingerprints(docs, shingle), "fingerprints")
    total = each.count()
    distinct = scratch.save(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), scratch, radius, hot_block), scratch)
    rooted = scratch.save(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    classes = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    whole = salted_join(rooted, classes, "root", "members", total, F.col("fp")).select("fp", "n", "component_id")
    out = salted_join(each, whole, "fp", "n", total, F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
