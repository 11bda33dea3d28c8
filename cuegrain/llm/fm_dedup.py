"""Substring dedup by an FM-index a shard.

Windows of words that occur twice share the least hash of their word groups (their anchor), so
equal windows meet if stretches of text go to the shard of their anchor. A first pass counts
anchors; only stretches around repeated ones are read again. Of equal stretches a task sends
just the earliest on. In its shard each distinct stretch is indexed: suffix order,
Burrows-Wheeler transform and a wavelet matrix of packed bits with sampled counts. The stretches
are streamed through backward search; the matching statistics at each place are followed up to
the length of a window, and windows whose interval holds an earlier place are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, chunks, in_filter, mix64, partitions, salted_join, word_hashes, words_of

WINDOW = 20
#: Words of a group whose least hash is the anchor of a window.
GRAM = 8
#: Windows of one stretch at most.
STRETCH = 64
#: Bytes of the map of repeated anchors that may be broadcast; beyond, stretches are joined with them.
FILTER_BYTES = 1 << 25
SHARD_WORDS = 1_000_000
#: Stretches of one anchor that an index holds; anchors with more are dealt window by window. Such anchors up to which they are broadcast.
HOT, FEW_ANCHORS = 20_000, 500_000
#: Stretches that a task remembers, to send equal ones once.
SEEN_STRETCHES = 1_000_000
NO_ID = -(1 << 63)


# ---------------------------------------------------------------- anchors and stretches


def stretches(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor) of each run of windows with one anchor."""
    buf, starts, ends, doc = words_of(texts)
    n = len(starts)
    if n < window:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    g = word_hashes(buf, starts, ends)
    width = 1
    while width < gram:
        step = min(width, gram - width)
        g = mix64(g[: n - width - step + 1] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + g[step : n - width + 1])
        width += step
    span, width = window - gram + 1, 1
    again = np.zeros(len(g) + 1, np.int32)  # groups that come again within a window's reach
    for p in range(1, min(span, len(g))):
        again[1 : len(g) - p + 1] |= g[:-p] == g[p:]
    again = np.cumsum(again)
    while width < span:
        step = min(width, span - width)
        g = np.minimum(g[: len(g) - step], g[step:])
        width += step
    g = g[: n - window + 1]
    whole = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    new = np.r_[True, (np.diff(at) > 1) | (g[at][1:] != g[at][:-1]) | (doc[at][1:] != doc[at][:-1])]
    head = np.flatnonzero(new)
    run = np.diff(np.r_[head, len(at)])
    pieces = -(-run // STRETCH)
    if pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(run, pieces) - k * STRETCH
        head, run, whole_run = np.repeat(head, pieces) + k * STRETCH, np.minimum(left, STRETCH), np.repeat(run, pieces)
    else:
        whole_run = run
    first_of_doc = np.searchsorted(doc, np.arange(len(texts)))
    d, first = doc[at[head]], at[head]
    # A run may hold its anchor twice if it is longer than a group's reach, or if a group comes again within it.
    twice = (whole_run > span) | (again[np.minimum(first + run + span - 1, len(again) - 1)] > again[first])
    return d, first - first_of_doc[d], run, g[first].view(np.int64), twice


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column("text").to_pylist()]
        for lo, hi in chunks(texts):
            got = stretches(texts[lo:hi])
            if len(got[0]):
                h, n = np.unique(got[3], return_counts=True)
                twice = np.zeros(len(h), bool)
                twice[np.searchsorted(h, got[3][got[4]])] = True
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n + twice, 2).astype(np.int32))], ["h", "n"])


def _cut(held):
    """Stretches with words; and without, of n words, those that are equal to an earlier one that this task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[bytes, tuple] = {}
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            ids, rows = b.column("id").to_pylist(), b.column("row").to_pylist()
            for lo, hi in chunks(texts):
                got = stretches(texts[lo:hi])
                if not len(got[0]):
                    continue
                if held is not None:
                    ok = in_filter(held.value, got[3])
                    got = [x[ok] for x in got]
                out, last, words = [], -1, []
                for d, first, n, h in zip(*(x.tolist() for x in got[:4]), strict=True):
                    if d != last:
                        last, words = d, texts[lo + d].split()
                    own = b" ".join(words[first : first + n + WINDOW - 1])
                    place, key = (ids[lo + d], rows[lo + d], first), xxhash.xxh3_128_digest(own)
                    before = earliest.get(key)
                    if before is None or place < before:
                        earliest[key] = place
                        out.append((h, *place, n + WINDOW - 1, own))
                    else:
                        out.append((h, *place, n + WINDOW - 1, None if place > before else own))
                if len(earliest) > SEEN_STRETCHES:
                    earliest.clear()
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "id", "row", "first", "n", "words"])

    return run


def first_and_later(seen: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of equal stretches, the earliest (h, words, id, row, first); and (id, row, first, n) of all others, which go whole."""
    place = F.struct("id", "row", "first")
    firsts = scratch.save(seen.groupBy("words").agg(F.min(place).alias("at"), F.first("h").alias("h"), F.first("n").alias("size"), F.count(F.lit(1)).alias("n")), name)
    total = firsts.agg(F.sum("n")).first()[0] or 0
    copies = firsts.where("n > 1").select("words", "at", "n")
    later = salted_join(seen.select("id", "row", "first", F.col("n").alias("size"), "words"), copies, "words", "n", total, F.struct("id", "row", "first")).where(place != F.col("at"))
    return firsts.select("h", "at.*", F.col("size").alias("n"), "words"), later.select("id", "row", "first", F.col("size").alias("n"))


# ---------------------------------------------------------------- the index


class FmIndex:
    """FM-index over word numbers: suffix order, and the transform in a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, jump: int = 8):
        n = len(symbols)
        self.n, self.jump = n, jump
        self.levels = max(1, int(symbols.max()).bit_length())
        rank = symbols.astype(np.int64)
        width, self.jump_class = 1, None
        while True:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (max(n, int(rank.max())) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.r_[0, (key[order][1:] != key[order][:-1]).astype(np.int64)]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
            if width == jump:
                self.jump_class = rank.copy()
            if rank.max() == n - 1 and width >= jump:
                break
        self.order = order
        sizes = np.bincount(self.jump_class)
        #: Interval of the suffixes that begin with the same ``jump`` symbols, by class: the usual table for the first steps.
        self.low = np.cumsum(sizes) - sizes
        self.high = np.cumsum(sizes)
        bwt = symbols[order - 1]
        before = np.cumsum(np.bincount(symbols, minlength=1 << self.levels)) - np.bincount(symbols, minlength=1 << self.levels)
        self.words, self.sampled, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            packed = np.packbits(np.r_[bit, np.zeros(-n % 64 + 64, bit.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.sampled.append(np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        every = np.arange(1 << self.levels)
        self.base = before - self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.sampled[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches one symbol longer to the left."""
        both = self._descend(np.r_[symbol, symbol], np.r_[low, high])
        base = self.base[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def repeated(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places in ``starts``, those whose next ``length`` symbols occur again, and their intervals.

        Places drop out as soon as their match is alone: its statistic is below ``length``.
        """
        end = starts + length - self.jump
        kind = self.jump_class[end]
        low, high = self.low[kind], self.high[kind]
        at = starts
        for t in range(self.jump, length):
            ok = high - low > 1
            at, low, high = at[ok], low[ok], high[ok]
            low, high = self.step(symbols[at + length - 1 - t], low, high)
        ok = high - low > 1
        return at[ok], low[ok], high[ok]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: index all of its stretches, stream them through, report windows that occur earlier."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not held:
        return
    t = pa.concat_tables(held)
    id_, row, first, n = (t.column(c).to_numpy() for c in ("id", "row", "first", "n"))
    order = np.lexsort((first, row, id_))
    seen: dict[bytes, tuple] = {}
    later, firsts = [], []
    texts = t.column("words").to_pylist()
    for i in order.tolist():
        place = (id_[i], row[i], first[i])
        known = seen.setdefault(texts[i], place)
        if known is place:
            firsts.append(i)
        elif known != place:  # else: the same row, twice in the table
            later.append(i)
    del seen
    if later:
        yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (id_, row, first, n)], ["id", "row", "first", "n"])
    id_, row, first = id_[firsts], row[firsts], first[firsts]
    number: dict[bytes, int] = {}
    ids, lens = [], []
    for i in firsts:
        own = texts[i].split(b" ")
        ids.extend([number.setdefault(w, len(number) + 1) for w in own])
        ids.append(0)
        lens.append(len(own))
    symbols, lens = np.array(ids, np.int64), np.array(lens)
    del ids, texts, t, held
    head = np.cumsum(lens + 1) - lens - 1
    index = FmIndex(symbols)
    # The order of places: documents by (id, row), then words.
    by = np.lexsort((row, id_))
    new = np.r_[0, (np.diff(id_[by]) != 0) | (np.diff(row[by]) != 0)]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    of = np.repeat(np.arange(len(lens)), lens + 1)
    place = (rank[of] << 32) + first[of] + np.arange(len(symbols)) - head[of]
    windows = lens - WINDOW + 1
    starts = np.repeat(head, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at, low, high = index.repeated(symbols, starts, WINDOW)
    if not len(at):
        return
    least, back = np.unique(low, return_inverse=True)
    top = np.empty(len(least), np.int64)
    top[back] = high
    sorted_places = np.r_[place[index.order], 0]
    earliest = np.minimum.reduceat(sorted_places, np.column_stack([least, top]).ravel())[::2]
    gone = np.sort(at[place[at] > earliest[back]])
    if not len(gone):
        return
    cut = np.r_[True, (np.diff(gone) > 1) | (of[gone][1:] != of[gone][:-1])]
    begin = np.flatnonzero(cut)
    n = np.diff(np.r_[begin, len(gone)]) + WINDOW - 1
    g = gone[begin]
    yield pa.RecordBatch.from_arrays([pa.array(id_[of[g]]), pa.array(row[of[g]]), pa.array(first[of[g]] + g - head[of[g]]), pa.array(n)], ["id", "row", "first", "n"])


# ---------------------------------------------------------------- the operator


def substring_dedup(docs: DataFrame, filter_bytes: int = FILTER_BYTES, hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: one row for each row of docs (doc_id, text).

    Each word is removed that a window of 20 words covers whose words also start earlier (smaller
    doc_id, or the same document, earlier start). Null texts have no words. A null doc_id comes
    before all others; rows with one doc_id come in the order of a hash of their texts, and rows
    that are the same in both are one document that is returned as often. No rows: no rows.
    Anchors with more than ``hot`` (HOT if not given) different stretches (a passage in many contexts) are dealt
    over shards window by window.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.col("text").cast("binary")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), text.alias("text"))
    counted = base.select("text").mapInArrow(_count, "h bigint, n int").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = scratch.save(counted.where("n > 1").select("h"), "anchors")
    held = bit_filter(repeated, repeated.count(), filter_bytes)
    cut = base.mapInArrow(_cut(held), "h bigint, id bigint, row bigint, first bigint, n bigint, words binary")
    if held is None:
        cut = cut.join(repeated, "h", "left_semi")
    cut = scratch.save(cut, "stretches", compression="zstd")
    later = cut.where("words IS NULL").select("id", "row", "first", "n")
    seen = cut.where("words IS NOT NULL")

    total, size = seen.agg(F.count(F.lit(1)), F.sum("n")).first()
    limit = hot or HOT
    wide = seen.groupBy("h").count().where(F.col("count") > limit).select("h", F.lit(True).alias("wide"))  # one anchor in ``limit`` stretches at most
    wide = scratch.save(wide, "wide")
    gone, indexed = [later], seen
    if not wide.isEmpty():
        seen = seen.join(F.broadcast(wide) if (total or 0) // limit <= FEW_ANCHORS else wide, "h", "left")
        own = F.split(F.col("words").cast("string"), " ")
        each = seen.where("wide").select("id", "row", "first", own.alias("w")).select("id", "row", "first", "w", F.explode(F.sequence(F.lit(0), F.size("w") - WINDOW)).alias("k"))
        each = each.select("id", "row", (F.col("first") + F.col("k")).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, WINDOW), " ").cast("binary").alias("words"))
        each = scratch.save(each.select(F.xxhash64("words").alias("h"), "id", "row", "first", F.lit(WINDOW).cast("long").alias("n"), "words"), "windows", compression="zstd")
        single, gone_single = first_and_later(each, scratch, "distinct-windows")
        gone.append(gone_single)
        indexed = seen.where("wide IS NULL").drop("wide").unionByName(single)

    shards = max(partitions(spark), int((size or 0) // SHARD_WORDS))
    gone.append(indexed.repartition(shards, "h").mapInArrow(_search, "id bigint, row bigint, first bigint, n bigint"))
    gone = scratch.save(reduce(DataFrame.unionByName, gone), "removed", compression="zstd")
    scratch.drop(cut)

    # Texts from which words go meet their spans by a join; the others, where a bit map tells them apart, don't move.
    spans = gone.groupBy("id", "row").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    spans = scratch.save(spans, "spans", compression="zstd")
    key = F.xxhash64("id", "row")
    some = bit_filter(spans.select(key.alias("h")), spans.count(), filter_bytes)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("t", F.lit(""))).alias("row"), F.col("t").cast("binary").alias("text"))
    none = F.lit(None).cast("array<struct<first: bigint, n: bigint>>").alias("spans")

    @F.pandas_udf("boolean")
    def touched(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(some.value, h.to_numpy()))

    moved = named if some is None else named.where(touched(key))
    moved = moved.join(spans.hint("shuffle_hash"), ["id", "row"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, KEPT)
    out = moved if some is None else moved.unionByName(named.where(~touched(key)).select("doc_id", "text", none).mapInArrow(_remove, KEPT))
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part, out = b.slice(lo, 500), []
            for t, spans in zip(part.column("text"), part.column("spans"), strict=True):
                own, spans = (t.as_py() or b"").split(), spans.as_py()
                keep = np.ones(len(own), bool)
                for s in spans or ():
                    keep[s["first"] : s["first"] + s["n"]] = False
                kept = [own[i] for i in np.flatnonzero(keep).tolist()] if spans else own
                out.append((len(own), len(own) - len(kept), b" ".join(kept)))
            n, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_text"])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(w, i, i + 19) ORDER BY doc_id, i) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE nth > 1),
s AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY j) FROM (SELECT unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS j) WHERE NOT list_contains(gone, j)), '') END) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
