"""Language-model scores by online logistic context mixing over the bits of a text's words.

A text is its lower-cased words, each with an end byte, and one end of text. Along the text each
word is predicted given the one before. First a bit says whether the two have been seen together
(twice or more in the training texts); it is predicted from the counts of the word before. Then
come the bits of the word: with the word before and the word so far as their context if the pair
is known (bits that no other known word has otherwise are certain then), with the word so far if
not. Next to that exact context stand predictors of one byte,
two bytes, and the place in the word with one byte, each in a table that has a slot for every
context there can be. Predictions are mixed in the logistic domain by weights that a gate picks
(how often the contexts were seen, and the bit); weights are learned online along fixed streams of
the training words and pairs, each occurrence left out of its own counts, and an adaptive map
refines the mixed probability.

Spark aggregates the training texts to words and pairs with counts. Whatever is learned comes from
these alone and is dealt to streams by hashes of the words, so neither the held-out texts nor the
number of cores or partitions change a score. A node of the tree of words (a context and the bits
so far) is evaluated once, for all texts that pass it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, chunks, held_out, in_filter, mix64, partitions, salted_join, word_hashes, words_of

#: Contexts of the tables: one byte, two bytes, place (up to 16) and one byte; each has a slot for every node.
SIZES = (1 << 16, 1 << 24, 1 << 20)
OFFSETS = np.cumsum([0, *SIZES])
INPUTS = len(SIZES) + 2  # and the exact context, and a constant
#: Longer words are modelled as pieces of so many bytes, each with the piece before as its context.
PIECE = 64
END, CUT, LEAD = 0x20, 0x0A, 0x09
END_HASH = np.uint64(0x5851F42D4C957F2D)
#: Kinds of counted rows: pairs, words (and pieces) of the model, whole words that were cut to pieces.
PAIR, WORD, LONG = 0, 1, 2
#: Bytes of text that a task takes apart, and that it counts, at once.
CHUNK, COUNT_BYTES = 1 << 18, 8 << 20
#: Bytes of text whose words and pairs one task adds up.
BUCKET_BYTES = 8 << 20
#: Training tokens to each bucket of words and pairs that texts are looked up in.
BUCKET_TOKENS = 1 << 22
#: Bytes of text whose keys a task sends to the buckets at once, and values that it sends at once.
PARCEL_BYTES, PARCEL_VALUES = 2 << 20, 1 << 17
#: Most frequent words and pairs that tasks get by broadcast; all others are joined.
TOP_KEYS = 1 << 19
#: Most frequent words whose own scores are added to pairs where these are scored; only the pairs of others are joined.
NEAR_WORDS = 1 << 18
#: Bytes of the map of known pairs that may be broadcast; beyond, all pairs are joined.
FILTER_BYTES = 1 << 25
#: Distinct words below one beginning; a beginning with more is split at HEAD more bytes.
GROUP_ROWS, HEAD = 100_000, 3
#: Distinct words or pairs of one stream of learning, of one step, and of one task.
STREAM_ROWS, BLOCK, TASK_ROWS = 1 << 18, 1 << 14, 250_000
#: Tables of hashes and scores, nearly all distinct: Parquet needn't look for dictionaries.
PLAIN = {"parquet.enable.dictionary": "false"}
#: Curvature that holds a weight where it starts.
PRIOR = 10.0
SLOTS = 1 << 16
DELTA = 0.05
SEEN = 7  # levels of "how often seen"
GATES = 8 * SEEN * SEEN + SEEN  # the last ones are those of the bit that says whether a pair is known
CELLS = 33
ALPHA = 0.1


# ---------------------------------------------------------------- texts as tokens


@dataclass
class Tokens:
    """Model tokens of some texts in order: words, pieces of long words, and an end of each text (begin == end)."""

    buf: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    lead: np.ndarray  # a piece that goes on with a word
    cut: np.ndarray  # a piece that the word goes on after
    text: np.ndarray
    h: np.ndarray
    n_words: np.ndarray  # words of each text
    long_text: np.ndarray  # text and hash of each word that was cut
    long_h: np.ndarray

    def before(self) -> np.ndarray:
        """Hash of the token before each one; before the first of a text stands the end of one."""
        return np.concatenate([[END_HASH], self.h[:-1]])


def tokens(texts: list[bytes]) -> Tokens:
    buf, s, e, doc = words_of([t.lower() for t in texts])
    n_words = np.bincount(doc, minlength=len(texts))
    k = np.maximum(-(-(e - s) // PIECE), 1)
    long = np.flatnonzero(k > 1)
    whole = word_hashes(buf, s[long], e[long])
    number = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    begin, stop = np.repeat(s, k) + PIECE * number, np.repeat(e, k)
    end = np.minimum(begin + PIECE, stop)
    lead, cut, text = number > 0, end < stop, np.repeat(doc, k)
    h = word_hashes(buf, begin, end)
    odd = lead | cut
    h[odd] = mix64(h[odd] + lead[odd] * np.uint64(0xA0761D6478BD642F) + cut[odd] * np.uint64(0xE7037ED1A0B428DB))
    at = np.cumsum(np.bincount(text, minlength=len(texts)))
    put = lambda x, v: np.insert(x, at, v)
    return Tokens(buf, put(begin, 0), put(end, 0), put(lead, False), put(cut, False), np.insert(text, at, np.arange(len(texts))), put(h, END_HASH), n_words, doc[long], whole)


def pair_hash(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(p * np.uint64(0x9E3779B97F4A7C15) + w)


def flat_names(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all names, first byte and length of each)."""
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    return np.frombuffer(names.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)


def name_hash(flat: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The hash of tokens by their names."""
    out = np.full(len(start), END_HASH)
    some = np.flatnonzero(lens > 1)
    if len(some):
        start, last = start[some], (start + lens)[some] - 1
        lead, cut = flat[start] == LEAD, flat[last] == CUT
        h = word_hashes(flat, start + lead, last)
        odd = lead | cut
        h[odd] = mix64(h[odd] + lead[odd] * np.uint64(0xA0761D6478BD642F) + cut[odd] * np.uint64(0xE7037ED1A0B428DB))
        out[some] = h
    return out


# ---------------------------------------------------------------- counts

COUNTED = "kind int, g bigint, w binary, c bigint"


def _names(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Names of tokens: their bytes, between the marks of a piece where they are one, and the end byte."""
    size = end - begin + lead + 1
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - lead - stop + size, size)
    out = buf[np.clip(at, 0, len(buf) - 1)]
    out[stop - 1] = np.where(cut, CUT, END)
    out[(stop - size)[lead]] = LEAD
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, stop].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _packed(t: pa.Table) -> bytes:
    """Rows as compressed Arrow data."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(x: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(x.as_buffer() if isinstance(x, pa.Scalar) else x).read_all()


def _by_bucket(t: pa.Table, key: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Buckets (equal ranges of 64-bit keys) that rows sorted by key fall in, and the packed rows of each."""
    bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    to = np.flatnonzero(np.diff(cuts)).tolist()
    return to, [_packed(t.slice(cuts[k], cuts[k + 1] - cuts[k])) for k in to]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, a place of each, and the number of each place's hash."""
    by = np.argsort(h)
    h = h[by]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    number = np.empty(len(h), np.int64)
    number[by] = np.cumsum(new) - 1
    return h[new], by[new], number


class _Memtable:
    """Tokens of some texts, told apart by their hashes."""

    def __init__(self):
        self.bufs, self.kept, self.number, self.train, self.long, self.size = [], [], [], [], [], 0

    def add(self, texts: list[bytes], held: np.ndarray) -> None:
        t = tokens(texts)
        h, first, number = _distinct(t.h)
        self.bufs.append(t.buf)
        self.kept.append((h, t.begin[first] + self.size, t.end[first] + self.size, t.lead[first], t.cut[first]))
        self.number.append(number)
        self.train.append(~held[t.text])
        self.long.append((t.long_h, ~held[t.long_text]))
        self.size += len(t.buf)

    def table(self, buckets: int) -> tuple[pa.Table, np.ndarray]:
        """COUNTED rows (kind and c in fewer bytes) in the order of their buckets, and where each bucket begins."""
        train = np.concatenate(self.train)
        h, begin, end, lead, cut = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        words, first, again = _distinct(h)
        names = _names(np.concatenate(self.bufs), begin[first], end[first], lead[first], cut[first])
        own = np.split(again, np.cumsum([len(k[0]) for k in self.kept])[:-1])
        number = np.concatenate([k[n] for k, n in zip(own, self.number, strict=True)])
        pairs = np.concatenate([[np.searchsorted(words, END_HASH)], number[:-1]]) * len(words) + number
        pairs, n = np.unique(pairs[train], return_counts=True)
        before, word = pairs // len(words), pairs % len(words)
        long, c = (np.concatenate(x) for x in zip(*self.long, strict=True))
        g, to = np.concatenate([words[before], words, long]), np.concatenate([words[word], words, long])
        bucket = (pair_hash(g, to) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)  # short numbers sort faster
        by = np.argsort(bucket, kind="stable")
        kind = np.repeat(np.array([PAIR, WORD, LONG], np.int8), [len(pairs), len(words), len(long)])
        name = np.concatenate([word, np.arange(len(words)), np.full(len(long), len(words))])
        c = np.concatenate([n, np.bincount(number, train, len(words)), c]).astype(np.int32)
        w = pa.concat_arrays([names, pa.array([b""], pa.binary())]).take(pa.array(name[by]))
        return pa.table({"kind": kind[by], "g": g[by].view(np.int64), "w": w, "c": c[by]}), np.searchsorted(bucket[by], np.arange(buckets + 1))

    def packed(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The rows of each bucket (by both words of a pair) as compressed Arrow data."""
        t, cuts = self.table(buckets)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows = _packed(t.slice(cuts[k], cuts[k + 1] - cuts[k]))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rows], pa.binary())], ["bucket", "rows"])


def count_words(docs: DataFrame) -> DataFrame:
    """kind, g, w, c: tokens with their hash (g), pairs with the hash of the first one, counts in training texts.

    Words are there for all texts, pairs only where they occur twice or more in training texts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), size // BUCKET_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Memtable()
        for b in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            texts, held = [t or b"" for t in b.column("text").to_pylist()], np.array(b.column("held").to_pylist(), bool)
            for lo, hi in chunks(texts, CHUNK):
                table.add(texts[lo:hi], held[lo:hi])
                if table.size >= COUNT_BYTES:
                    yield from table.packed(buckets)
                    table = _Memtable()
        if table.size:
            yield from table.packed(buckets)

    def add(t: pa.Table) -> pa.Table:
        """A bucket's rows, those of one kind together: who reads one kind skips the pages of the others."""
        rows, out = pa.concat_tables([_unpacked(x) for x in t["rows"]]), []
        for kind in (PAIR, WORD, LONG):
            own = rows.filter(pc.field("kind") == kind).group_by(["g", "w"]).aggregate([("c", "sum")])
            if kind == PAIR:
                own = own.filter(pc.field("c_sum") > 1)
            out.append(pa.table({"kind": np.full(len(own), kind, np.int32), "g": own["g"], "w": own["w"], "c": own["c_sum"]}))
        return pa.concat_tables(out)

    rows = docs.select(F.col("text").cast("binary").alias("text"), held_out(10).alias("held")).mapInArrow(run, "bucket bigint, rows binary")
    return rows.groupBy("bucket").applyInArrow(add, COUNTED)


# ---------------------------------------------------------------- trees of words


class Block:
    """Sorted words of whole groups (a context, or a beginning in it), walked bit by bit, node by node.

    ``heads`` gives, by group, the zeros and ones of the whole context at each bit of the beginning
    that the group's words share; below it the group's own words are all there are.
    """

    def __init__(self, names: pa.Array, counts: np.ndarray, group: np.ndarray, heads: dict[int, tuple]):
        self.n = len(names)
        self.flat, self.at, self.lens = flat_names(names)
        self.counts = counts.astype(np.float64)
        self.group = group
        self.m = np.zeros((self.n, int(self.lens.max(initial=1))), np.uint8)
        place = np.arange(self.lens.sum()) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.m[np.repeat(np.arange(self.n), self.lens), place] = self.flat[np.repeat(self.at, self.lens) + place]
        self.start = np.concatenate([[True], group[1:] != group[:-1]])
        deep = max([len(z) for z, _ in heads.values()], default=0)
        self.deep = np.zeros(int(group.max(initial=0)) + 1, np.int64)
        self.above = np.zeros((2, len(self.deep), deep))
        for g, (zeros, ones) in heads.items():
            self.deep[g] = len(zeros)
            self.above[0, g, : len(zeros)], self.above[1, g, : len(zeros)] = zeros, ones

    def steps(self, branches: bool = False):
        """(rows, place of each row's node, first row of each node, d, bit, partial byte of each node, y of each row, zeros, ones) of each bit.

        With ``branches``, words that are alone below a node are not followed further.
        """
        rows, new = np.arange(self.n), self.start
        for d in range(self.m.shape[1]):
            stay = self.lens[rows] > d
            if branches and len(rows):
                stay &= ~(new & np.append(new[1:], True)) | (self.deep[self.group[rows]] > 8 * d)
            stay = np.flatnonzero(stay)
            if len(stay) < len(rows):
                new = np.logical_or.reduceat(new[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else new[:0]
                rows = rows[stay]
            if not len(rows):
                return
            byte, c = self.m[rows, d].astype(np.int64), self.counts[rows]
            for bit in range(7, -1, -1):
                y = (byte >> bit) & 1
                first = np.flatnonzero(new)
                at = np.cumsum(new) - 1
                ones = np.add.reduceat(c * y, first)
                zeros = np.add.reduceat(c, first) - ones
                t = 8 * d + 7 - bit
                if t < self.above.shape[2]:
                    g = self.group[rows[first]]
                    up = self.deep[g] > t
                    zeros, ones = np.where(up, self.above[0, g, t], zeros), np.where(up, self.above[1, g, t], ones)
                yield rows, at, rows[first], d, bit, (1 << (7 - bit)) | (byte[first] >> (bit + 1)), y, zeros, ones
                new = new.copy()
                new[1:] |= y[1:] != y[:-1]

    def slots(self, row: np.ndarray, d: int, node: np.ndarray) -> list[np.ndarray]:
        one = self.m[row, d - 1].astype(np.int64) if d else np.full(len(row), END)
        two = self.m[row, d - 2].astype(np.int64) if d > 1 else np.full(len(row), END)
        return [one << 8 | node, OFFSETS[1] + (two << 16 | one << 8 | node), OFFSETS[2] + (min(d, 15) << 16 | one << 8 | node)]


def _paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """Zeros and ones at each bit of the next HEAD bytes of the beginnings below one beginning."""
    pdf = pdf.sort_values("kid")
    skip = len(pdf["head"].iloc[0])
    names = pa.array([bytes(x)[skip:] for x in pdf["kid"]], pa.binary())
    b = Block(names, pdf["c"].to_numpy(), np.zeros(len(pdf), np.int64), {})
    zeros, ones = np.zeros((2, b.n, 8 * HEAD))
    for rows, at, _, d, bit, _, _, z, o in b.steps():
        zeros[rows, 8 * d + 7 - bit], ones[rows, 8 * d + 7 - bit] = z[at], o[at]
    cut = (8 * b.lens).tolist()
    return pd.DataFrame({"g": pdf["g"], "head": pdf["head"], "kid": pdf["kid"], "z": [x[:k].tobytes() for x, k in zip(zeros, cut, strict=True)], "o": [x[:k].tobytes() for x, k in zip(ones, cut, strict=True)]})


def dealt(words: DataFrame, sizes: DataFrame, scratch: Scratch, group_rows: int = GROUP_ROWS) -> DataFrame:
    """words (g, w, c; sizes: g and n, the words of each) with key, the group they are walked in, and for groups that are but a beginning a row with the counts above it (zeros, ones).

    A context with more than group_rows words (at most words / group_rows of them) is split by the
    beginnings of its words, HEAD bytes more each time, until no group has more.
    """
    heads, k = [], 0
    rows = words.withColumn("head", F.lit(b""))
    hot = scratch.save(sizes.where(F.col("n") > group_rows).select("g", F.lit(b"").alias("head")), "hot")
    above = hot.select("g", "head", F.lit(b"").alias("zeros"), F.lit(b"").alias("ones"))
    while not hot.isEmpty():
        k += HEAD
        rows = rows.join(F.broadcast(hot.withColumn("split", F.lit(True))), ["g", "head"], "left")
        kid = F.when(F.col("split"), F.substring("w", 1, k)).otherwise(F.col("head"))
        rows = rows.withColumn("kid", kid)
        kids = rows.where("split").groupBy("g", "head", "kid").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
        kids = scratch.save(kids, "kids")
        paths = kids.groupBy("g", "head").applyInPandas(_paths, "g bigint, head binary, kid binary, z binary, o binary")
        paths = paths.join(above, ["g", "head"]).select("g", F.col("kid").alias("head"), F.concat("zeros", "z").alias("zeros"), F.concat("ones", "o").alias("ones"))
        paths = scratch.save(paths, "heads")
        hot = scratch.save(kids.where(F.col("n") > group_rows).select("g", F.col("kid").alias("head")), "hot")
        heads.append(paths.join(F.broadcast(hot), ["g", "head"], "left_anti"))
        above = paths.join(F.broadcast(hot), ["g", "head"], "left_semi")
        rows = rows.select("g", "w", "c", F.col("kid").alias("head"))
    none = F.lit(None).cast("binary")
    rows = rows.select("g", "head", "w", "c", none.alias("zeros"), none.alias("ones"))
    if heads:
        rows = rows.unionByName(reduce(DataFrame.unionByName, heads).select("g", "head", F.lit(None).cast("binary").alias("w"), F.lit(0).cast("bigint").alias("c"), "zeros", "ones"))
    return rows.select(F.xxhash64("g", "head").alias("key"), "g", "w", "c", "zeros", "ones")


def in_order(rows: DataFrame, parts: int, by: str, streams: int = 1) -> DataFrame:
    """Dealt rows by stream or key, and sorted by stream, key and w."""
    rows = rows.withColumn("stream", F.pmod("key", F.lit(streams)))
    low = streams.bit_length() + 1
    first = F.shiftleft("stream", 64 - low) + F.shiftright("key", low)  # the first number alone tells most rows apart, which Spark compares fastest
    return rows.repartition(parts, by).sortWithinPartitions(first, "key", F.col("w").asc_nulls_first())


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, Block]]:
    """(stream, contexts, block) of whole groups, ``most`` words together or more; batches don't show in them."""

    def block(t: pa.Table, new: np.ndarray) -> tuple[int, np.ndarray, Block]:
        group = np.cumsum(new) - 1
        head = t.column("w").is_null().to_numpy()
        heads = {int(group[i]): (np.frombuffer(t.column("zeros")[i].as_py()), np.frombuffer(t.column("ones")[i].as_py())) for i in np.flatnonzero(head).tolist()}
        own = np.flatnonzero(~head)
        names = t.column("w").take(pa.array(own)).combine_chunks()
        return t.column("stream")[0].as_py(), t.column("g").to_numpy()[own], Block(names, t.column("c").to_numpy()[own], group[own], heads)

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows > most:
            held, *out = _cut(held.combine_chunks(), most, False)
            yield from (block(*x) for x in out)
    if held is not None and held.num_rows:
        yield from (block(*x) for x in _cut(held.combine_chunks(), most, True)[1:])


def _cut(t: pa.Table, most: int, all_: bool) -> list:
    """What is left of t, and its complete pieces with the first rows of their groups marked: a piece ends with a stream, or with a group behind ``most`` rows."""
    key, stream = t.column("key").to_numpy(), t.column("stream").to_numpy()
    turn = np.r_[True, stream[1:] != stream[:-1]]
    new = turn | np.r_[True, key[1:] != key[:-1]]
    ends, turns = np.flatnonzero(new), np.flatnonzero(turn)
    out, lo = [], 0
    while True:
        a, b = np.searchsorted(turns, lo, "right"), np.searchsorted(ends, lo + most)
        hi = min([*turns[a : a + 1], *ends[b : b + 1]], default=t.num_rows if all_ else lo)
        if hi <= lo:
            return [t.slice(lo), *out]
        out.append((t.slice(lo, hi - lo), new[lo:hi]))
        lo = int(hi)


# ---------------------------------------------------------------- predictors


def _code(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 32, then eight steps a power of two."""
    n = np.asarray(n, np.float64)
    return np.where(n < 32, n, np.minimum(255, 32 + np.floor(8 * np.log2(np.maximum(n, 32) / 32)))).astype(np.uint8)


_value = np.concatenate([np.arange(32), 32 * 2 ** ((np.arange(32, 256) - 31.5) / 8)])


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + DELTA) / (n0 + DELTA))


def _seen(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 2, 4, 16, 128, 2048], n, "right").astype(np.int64)


_seen_of = _seen(np.arange(2049))


def _seen_whole(n: np.ndarray) -> np.ndarray:
    """_seen of counts that are whole numbers."""
    return _seen_of[np.minimum(n, 2048).astype(np.int64)]


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    """Stretched prediction and level for each pair of codes: as they are, and with one 0 or one 1 less."""
    n0, n1 = np.meshgrid(_value, _value, indexing="ij")
    ways = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
    return np.concatenate([_stretch(a, b).ravel() for a, b in ways]), np.concatenate([_seen(a + b).ravel() for a, b in ways])


_LUT, _LEVEL = _lookups()


def _inputs(table: np.ndarray, slots, zeros: np.ndarray, ones: np.ndarray, bit: int, less: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (inputs by nodes) and the gate of each; ``less``: the value of the bit that is left out once."""
    x = np.empty((INPUTS, len(zeros)))
    off = 0 if less is None else (1 + less) << 16
    for k, s in enumerate(slots):
        at = table[s].astype(np.int64) + off
        x[k] = _LUT[at]
        if k == 1:
            level = _LEVEL[at]  # of the context of two bytes
    if less is not None:
        zeros, ones = np.maximum(zeros - 1 + less, 0), np.maximum(ones - less, 0)
    x[-2] = _stretch(zeros, ones)
    x[-1] = 0.3
    return x, (bit * SEEN + _seen_whole(zeros + ones)) * SEEN + level


def _known(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and gate of the bit that says whether a pair is known, from how often that was so after the word before."""
    x = np.zeros((INPUTS, len(zeros)))
    x[-2], x[-1] = _stretch(zeros, ones), 0.3
    return x, 8 * SEEN * SEEN + _seen(zeros + ones)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def _cell(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower cell of a stretched probability in the adaptive map, and the share of the upper one."""
    at = (np.clip(z, -11.99, 11.99) + 12) * ((CELLS - 1) / 24)
    low = at.astype(np.int64)
    return low, at - low


@dataclass
class Model:
    """Weights by gate and input, and the adaptive map by partial byte (0: the bit of known pairs) and cell."""

    weights: np.ndarray
    cells: np.ndarray

    def p(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        z = np.einsum("kn,nk->n", x, self.weights[gate])
        low, up = _cell(z)
        at, cells = node * CELLS + low, self.cells.ravel()
        refined = cells[at] * (1 - up) + cells[at + 1] * up
        return np.clip((_squash(z) + refined) / 2, 1e-7, 1 - 1e-7)


class Learner:
    """Weights and map learned along one stream: after each step of predicted bits a Newton step, with the curvature of all bits so far."""

    def __init__(self):
        self.w = np.full((GATES, INPUTS), 0.15)
        self.w[:, -2] = 0.7
        self.seen = np.zeros(GATES)
        self.curve = np.tile(np.eye(INPUTS) * PRIOR, (GATES, 1, 1))
        self.cells = np.zeros((256 * CELLS, 2))

    def see(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray, y: np.ndarray, mass: np.ndarray) -> None:
        """Predict bits, then learn from their values ``y``, which occurred ``mass`` times."""
        z = np.einsum("kn,nk->n", x, self.w[gate])
        p = _squash(z)
        by = np.argsort(gate.astype(np.int16), kind="stable")
        gates = gate[by]
        cuts = np.flatnonzero(np.r_[True, gates[1:] != gates[:-1], True])
        here = gates[cuts[:-1]]
        err, bend = (y - p) * mass, np.maximum(p * (1 - p), 1e-4) * mass
        xs, err, slope = x[:, by], err[by], np.empty((len(here), INPUTS))
        bent = xs * bend[by]
        for i, (g, lo, hi) in enumerate(zip(here.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            slope[i] = xs[:, lo:hi] @ err[lo:hi]
            self.curve[g] += bent[:, lo:hi] @ xs[:, lo:hi].T
        step = np.linalg.solve(self.curve[here], slope[:, :, None])[:, :, 0]
        self.w[here] += np.clip(step, -0.5, 0.5)
        self.seen += np.bincount(gate, mass, GATES)
        low, up = _cell(z)
        for at, part in ((low, 1 - up), (low + 1, up)):
            self.cells[:, 0] += np.bincount(node * CELLS + at, part * mass, len(self.cells))
            self.cells[:, 1] += np.bincount(node * CELLS + at, part * mass * y, len(self.cells))

    def sums(self) -> np.ndarray:
        return np.concatenate([(self.w * self.seen[:, None]).ravel(), self.seen, self.cells.ravel()])


def _model(sums: np.ndarray) -> Model:
    seen = sums[GATES * INPUTS : GATES * (INPUTS + 1)]
    fresh = Learner().w
    w = np.where(seen[:, None] > 0, sums[: GATES * INPUTS].reshape(GATES, INPUTS) / np.maximum(seen, 1e-9)[:, None], fresh)
    cells = sums[GATES * (INPUTS + 1) :].reshape(256, CELLS, 2)
    prior = _squash((np.arange(CELLS) * 24 / (CELLS - 1)) - 12)
    # Rounded, so that the order in which Spark adds up streams doesn't show.
    return Model(np.round(w, 6), np.round((cells[:, :, 1] + 20 * prior) / (cells[:, :, 0] + 20), 8))


# ---------------------------------------------------------------- tables


def count_tables(words: DataFrame) -> np.ndarray:
    """Codes of zeros and ones of each slot of the tables, from words and their counts (w, c), summed by Spark.

    Their size is that of all contexts there can be. Bytes are counted, and the nodes of a context summed from them.
    """

    def rows(slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = [np.zeros(SIZES[0]), np.zeros(SIZES[2])]  # summed up; of the large table's slots a batch has few
        for b in batches:
            w = b.column("w")
            lens = pc.binary_length(w).to_numpy()
            flat = np.frombuffer(b"".join(w.to_pylist()), np.uint8).astype(np.int64)
            c = np.repeat(b.column("c").to_numpy(), lens).astype(float)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            one, two = (np.where(place >= k, np.roll(flat, k), END) for k in (1, 2))
            node = one << 8 | flat
            small[0] += np.bincount(node, c, SIZES[0])
            small[1] += np.bincount(np.minimum(place, 15) << 16 | node, c, SIZES[2])
            slot = OFFSETS[1] + (two << 16 | node)
            by = np.argsort(slot)
            slot = slot[by]
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
            if len(first):
                yield rows(slot[first], np.add.reduceat(c[by], first))
        for offset, n in zip((0, OFFSETS[2]), small, strict=True):
            some = np.flatnonzero(n)
            yield rows(some + offset, n[some])

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        n, codes = np.zeros(SLOTS), np.zeros((SLOTS // 256, 256), np.uint16)
        n[pdf["slot"].to_numpy() % SLOTS] = pdf["n"].to_numpy()
        for d in range(8):
            both = n.reshape(-1, 1 << d, 2, 1 << (7 - d)).sum(3)
            codes[:, 1 << d : 2 << d] = _code(both[:, :, 0]).astype(np.uint16) << 8 | _code(both[:, :, 1])
        return pd.DataFrame({"k": [pdf["slot"].iloc[0] // SLOTS], "codes": [codes.tobytes()]})

    slots = words.select("w", "c").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(int(OFFSETS[-1]), np.uint16)
    for r in slots.groupBy(F.shiftright("slot", 16)).applyInPandas(code, "k bigint, codes binary").toLocalIterator():  # 273 rows at most
        out[r["k"] * SLOTS : (r["k"] + 1) * SLOTS] = np.frombuffer(r["codes"], np.uint16)
    return out


# ---------------------------------------------------------------- learning and scoring


def learn(words: DataFrame, table, known: DataFrame | None = None, sure: bool = False) -> Model:
    """The model of dealt words in the order of their streams: each stream of groups is learned online, then streams are averaged by the bits they saw.

    ``sure``: the next word is one of the context's own, so bits with one outcome are certain, and
    words that would not be left after leaving one occurrence out (counts below 3) are not learned from. ``known`` has
    the counts (stream, g, zeros, ones) of the bit of known pairs, one row a word before.
    """

    def out(learner: Learner) -> pa.RecordBatch:
        sums = learner.sums()
        at = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, last, t = Learner(), None, table.value
        for stream, _, b in _blocks(batches, BLOCK):
            if last is not None and stream != last:
                yield out(learner)
                learner = Learner()
            last = stream
            counts = b.counts * (b.counts >= (3 if sure else 1))
            for rows, at, first, d, bit, node, y, zeros, ones in b.steps(sure):
                if sure and not ((zeros > 0) & (ones > 0)).any():
                    continue
                c = counts[rows]
                one = np.bincount(at, c * y, len(first))
                mass = np.r_[np.bincount(at, c, len(first)) - one, one]
                some = np.flatnonzero((mass > 0) & np.tile((zeros > 0) & (ones > 0), 2)) if sure else np.flatnonzero(mass)
                if len(some):
                    v = (some >= len(first)).astype(np.int64)
                    on = some - v * len(first)
                    learner.see(*_inputs(t, b.slots(first[on], d, node[on]), zeros[on], ones[on], bit, v), node[on], v, mass[some])
        if last is not None:
            yield out(learner)

    def run_known(pdf: pd.DataFrame) -> pd.DataFrame:
        learner, pdf = Learner(), pdf.sort_values("g")
        for lo in range(0, len(pdf), 512):
            z, o = (pdf[c].iloc[lo : lo + 512].to_numpy().astype(float) for c in ("zeros", "ones"))
            v, mass = np.repeat([0, 1], len(z)), np.r_[z, o]
            x, gate = _known(np.maximum(np.tile(z, 2) - 1 + v, 0), np.maximum(np.tile(o, 2) - v, 0))
            some = np.flatnonzero(mass)
            learner.see(x[:, some], gate[some], np.zeros(len(some), np.int64), v[some], mass[some])
        return out(learner).to_pandas()

    sums = [words.mapInArrow(run, "at bigint, x double")]
    if known is not None:
        sums.append(known.groupBy("stream").applyInPandas(run_known, "at bigint, x double"))
    got = reduce(DataFrame.unionByName, sums).groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # as many rows at any input size
    total = np.zeros(GATES * (INPUTS + 1) + 256 * CELLS * 2)
    total[got["at"].to_numpy()] = got["x"].to_numpy()
    return _model(total)


def near_words(alone: DataFrame, most: int) -> tuple[tuple[np.ndarray, ...], int]:
    """(hashes in order, turns, scores alone) of the most frequent words, ``most`` at most, and the lowest count among them."""
    top = _top(alone, most)
    g = top["g"].to_numpy().view(np.uint64)
    by = np.argsort(g)
    numbers = [np.append(top[k].to_numpy(zero_copy_only=False).astype(float)[by], 0.0) for k in ("turn", "logp")]
    return (g[by], *numbers), pc.min(top["c"]).as_py() or (1 << 63) - 1


def score_words(words: DataFrame, table, model, sure: bool = False, near=None) -> DataFrame:
    """g, h (hash of the word), key (of the pair), c, logp: the model's log10 probability of each dealt word in its context.

    ``near`` (of near_words): the turn of a context that is there is added, and g null then; the
    score alone of a word that is there is subtracted, and h null then.
    """
    finder: list[Finder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g, b in _blocks(batches, 2 * BLOCK):
            logp = np.zeros(b.n)
            for rows, at, first, d, bit, node, y, zeros, ones in b.steps(sure):
                if not sure:
                    one = model.value.p(*_inputs(table.value, b.slots(first, d, node), zeros, ones, bit), node)[at]
                    logp[rows] += np.log10(np.where(y, one, 1 - one))
                    continue
                some = np.flatnonzero((zeros > 0) & (ones > 0))
                if not len(some):
                    continue
                p = np.zeros((2, len(first)))
                one = model.value.p(*_inputs(table.value, b.slots(first[some], d, node[some]), zeros[some], ones[some], bit), node[some])
                p[0, some], p[1, some] = np.log10(1 - one), np.log10(one)
                logp[rows] += p[y, at]
            h = name_hash(b.flat, b.at, b.lens)
            key = pair_hash(g.view(np.uint64), h)
            done = [None, None]
            if near is not None:
                names, *numbers = near.value
                if not finder:  # once a worker
                    finder.append(Finder(names))
                for k, (of, sign) in enumerate(((g.view(np.uint64), 1), (h, -1))):
                    at, done[k] = finder[0].find(of)
                    logp += sign * np.where(done[k], numbers[k][at], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(g, mask=done[0]), pa.array(h.view(np.int64), mask=done[1]), pa.array(key.view(np.int64)), pa.array(b.counts.astype(np.int64)), pa.array(logp)], ["g", "h", "key", "c", "logp"])

    return words.mapInArrow(run, "g bigint, h bigint, key bigint, c bigint, logp double")


@dataclass
class Fitted:
    """What scoring needs: ``values`` has key, c (null: not a word of the text), v (added to a text's score for each occurrence)."""

    values: DataFrame
    pairs: int
    n: int
    v: int
    table: np.ndarray
    words: Model
    pairs_model: Model


def fit(docs: DataFrame, scratch: Scratch, group_rows: int = GROUP_ROWS, near_most: int = NEAR_WORDS) -> Fitted:
    spark = docs.sparkSession
    counted = scratch.save(count_words(docs), "counted", **PLAIN, compression="zstd")
    sizes = counted.groupBy("kind", (F.col("c") > 0).alias("known")).agg(F.count(F.lit(1)).alias("rows"), F.sum("c").alias("c")).collect()
    most = sum(r["c"] for r in sizes if r["kind"] == WORD) // 2  # known pairs, with repeats: each occurs twice at least
    sizes = {(r["kind"], r["known"]): r["rows"] for r in sizes}
    n_words, n_train, n_pairs = (sum(n for k, n in sizes.items() if k in of) for of in ({(WORD, True), (WORD, False)}, {(WORD, True)}, {(PAIR, True)}))
    tasks = lambda n: max(partitions(spark), -(-n // TASK_ROWS))
    streams = lambda n: max(1, -(-n // STREAM_ROWS))

    # Words have one context, the empty one; only those of training texts are learned from.
    words = counted.where(F.col("kind") == WORD).select("g", "w", "c")
    one = words.select(F.lit(0).cast("bigint").alias("g"), "w", "c")
    size = lambda n: spark.range(1).select(F.col("id").alias("g"), F.lit(n).alias("n"))
    train = dealt(one.where("c > 0"), size(n_train), scratch, group_rows)
    table = count_tables(words.where("c > 0"))
    shared = spark.sparkContext.broadcast(table)

    # After a word, a pair counts as known if it stays so without the occurrence looked at.
    pairs = counted.where(F.col("kind") == PAIR).select("g", "w", "c")
    after = pairs.groupBy("g").agg(F.sum(F.when(F.col("c") > 2, F.col("c")).otherwise(0)).alias("ones"), F.count(F.lit(1)).alias("n"))
    piece = (F.substring("w", -1, 1) == F.lit(bytes([CUT]))) | (F.substring("w", 1, 1) == F.lit(bytes([LEAD])))
    before = words.select("g", "c", piece.alias("piece")).join(after, "g", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("ones", "n")})
    known_rows = before = scratch.save(before.select("g", "piece", "n", (F.col("c") - F.col("ones")).alias("zeros"), "ones"), "before")
    known = before.where("zeros + ones > 0").select(F.pmod("g", F.lit(streams(n_train))).alias("stream"), "g", "zeros", "ones")
    held = spark.sparkContext.broadcast(learn(in_order(train, streams(n_train), "stream", streams(n_train)), shared, known))

    @F.pandas_udf("no double, yes double")
    def flag(zeros: pd.Series, ones: pd.Series) -> pd.DataFrame:
        """log10 of the probabilities that the pair with the next word is not known, and that it is."""
        p = held.value.p(*_known(zeros.to_numpy().astype(float), ones.to_numpy().astype(float)), np.zeros(len(zeros), np.int64))
        return pd.DataFrame({"no": np.log10(1 - p), "yes": np.log10(p)})

    before = before.select("g", "piece", "n", flag("zeros", "ones").alias("flag"))
    alone = score_words(in_order(dealt(one, size(n_words), scratch, group_rows), tasks(n_words), "key"), shared, held).select(F.col("h").alias("g"), "c", "logp")
    alone = scratch.save(alone.join(before, "g"), "words")
    scratch.drop(known_rows)

    # Sorted once, to learn from and to score; one row group a file, so that no reader splits a stream.
    both = in_order(dealt(pairs, alone.select("g", "n"), scratch, group_rows), streams(n_pairs), "stream", streams(n_pairs))
    both = scratch.save(both, "pairs", **{**PLAIN, "compression": "zstd", "parquet.block.size": str(1 << 30)})
    held_pairs = spark.sparkContext.broadcast(learn(both, shared, None, True))
    # What a known pair adds to what its words alone give: the other flag, and the word after the one before.
    turn = F.col("flag.yes") - F.col("flag.no")
    near, least = near_words(alone.select("g", "c", turn.alias("turn"), "logp"), near_most)
    scored = scratch.save(score_words(both, shared, held_pairs, True, spark.sparkContext.broadcast(near)).withColumnRenamed("logp", "v"), "scored", **PLAIN)
    scratch.drop(both)
    long = counted.where(F.col("kind") == LONG).select(F.col("g").alias("key"), F.col("c").alias("base"), "c", F.lit(0.0).alias("v"))
    long = scratch.save(long, "long")
    scratch.drop(counted)
    # The pairs of rarer words are joined. One join after the other is written, so that the shuffles of both are never on disk together.
    rare = alone.where(F.col("c") < least)
    turned = salted_join(scored.where("g IS NOT NULL"), rare.where("n > 0").select("g", "n", turn.alias("turn")), "g", "n", n_pairs, F.col("key"))
    turned = turned.select("key", "h", "c", (F.col("turn") + F.col("v")).alias("v"))
    turned = scratch.save(scored.where("g IS NULL").select("key", "h", "c", "v").unionByName(turned), "turned", **PLAIN)
    scratch.drop(scored)
    follow = rare.where("c > 1").select(F.col("g").alias("h"), F.shiftright("c", 1).alias("uses"), F.col("logp").alias("alone"))  # at most so many pairs end with it
    both = salted_join(turned.where("h IS NOT NULL"), follow, "h", "uses", most, F.col("key")).select("key", "c", (F.col("v") - F.col("alone")).alias("v"))
    both = turned.where("h IS NULL").select("key", "c", "v").unionByName(both)
    values = both.select("key", F.lit(None).cast("bigint").alias("base"), "c", "v")
    own = alone.select(F.col("g").alias("key"), F.when(~F.col("piece"), F.col("c")).alias("base"), "c", (F.col("logp") + F.col("flag.no")).alias("v"))
    values = scratch.save(values.unionByName(own).unionByName(long), "values", **PLAIN)
    for done in (long, alone, turned):
        scratch.drop(done)
    n, v = values.agg(F.coalesce(F.sum("base"), F.lit(0)), F.count_if(F.col("base") > 0)).first()
    return Fitted(values, n_pairs, n, v, table, held.value, held_pairs.value)


# ---------------------------------------------------------------- texts


def _top(values: DataFrame, most: int) -> pa.Table:
    """The words and pairs with the highest counts, ``most`` at most."""
    level = F.floor(F.log2(F.col("c")) * 8).cast("int")
    sizes = values.where("c > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 504 rows
    n, least = 0, None
    for r in sizes:
        n += r["count"]
        if n > most:
            break
        least = r["level"]
    top = values.where("c > 0")
    return (top.where(level >= least) if least is not None else top.limit(0)).toArrow()


class Finder:
    """Places of 64-bit hashes in a sorted array of them, by a directory of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.sort(keys.view(np.uint64)), np.uint64((1 << 64) - 1))
        self.shift = np.uint64(64 - max(8, len(self.keys).bit_length() + 1))
        self.low = np.searchsorted(self.keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place whose key is not smaller, whether it is equal) of each hash."""
        at = self.low[(h >> self.shift).view(np.int64)].astype(np.int64)
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < h[behind]]
        return at, self.keys[at] == h


def score_texts(docs: DataFrame, fitted: Fitted, scratch: Scratch, top_keys: int = TOP_KEYS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, log_c (sum of log10(c + ALPHA)), score of each text."""
    spark, values = docs.sparkSession, fitted.values
    top = _top(values.select("key", "base", "c", "v"), top_keys)
    keys = top["key"].to_numpy().astype(np.int64)
    by = np.argsort(keys.view(np.uint64))
    base = top["base"].to_numpy(zero_copy_only=False).astype(float)
    numbers = np.column_stack([np.nan_to_num(base > 0), np.where(np.isnan(base), 0.0, np.log10(np.nan_to_num(base) + ALPHA)), top["v"].to_numpy()])[by]
    held = spark.sparkContext.broadcast((keys[by], np.vstack([numbers, np.zeros(3)])))
    finder: list[Finder] = []
    known = bit_filter(values.where("base IS NULL").select(F.col("key").alias("h")), fitted.pairs, filter_bytes)

    buckets = max(partitions(spark), fitted.n // BUCKET_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of what the broadcast table has of each text, and its other keys by bucket."""
        pa.default_memory_pool().release_unused()  # what the worker's tasks before have left
        keys, numbers = held.value
        if not finder:  # once a worker
            finder.append(Finder(keys))
        done, rest, size, part = [], [], 0, None
        for b in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts, CHUNK):
                t = tokens(texts[lo:hi])
                n = hi - lo
                key = np.concatenate([t.h, t.long_h, pair_hash(t.before(), t.h)])
                text = np.concatenate([t.text, t.long_text, t.text])
                must = len(t.h) + len(t.long_h)  # words are all in the table, pairs may be
                at, hit = finder[0].find(key)
                found, at = text[hit], at[hit]
                sums = [np.bincount(found, x, n).astype(float) for x in numbers[at].T]
                miss = ~hit
                if known is not None:
                    miss[must:] &= in_filter(known.value, key[must:].view(np.int64))
                row = b.column("row")[lo].as_py()
                part = row if part is None else part
                rest.append((key[miss], text[miss] + (row - part)))
                n_bytes = np.bincount(t.text, t.end - t.begin, n).astype(np.int64) + t.n_words + 1
                own = b.slice(lo, n)
                done.append(pa.table([own.column("doc_id"), own.column("held_out"), pa.array(n_bytes), pa.array(t.n_words + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names))
                size += len(t.buf)
                if size >= PARCEL_BYTES:
                    yield parcel(part, done, rest)
                    done, rest, size, part = [], [], 0, None
        if done:
            yield parcel(part, done, rest)

    def parcel(part: int, done: list[pa.Table], rest: list[tuple]) -> pa.RecordBatch:
        """Keys of some texts, each with the text's number among them and how often it has it, by bucket; and what is known of the texts."""
        key, text = (np.concatenate(x) for x in zip(*rest, strict=True))
        by = np.argsort(key)  # texts in any order below a key: a text may have a key in two rows, which are added up
        key, text = key[by], text[by]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)])
        times = np.diff(np.r_[first, len(key)])
        rows = pa.table({"key": pa.array(key[first]), "text": pa.array(text[first].astype(np.int32)), "n": pa.array(times.astype(np.int32))})
        to, packed = _by_bucket(rows, key[first], buckets)
        texts = _packed(pa.concat_tables(done))
        return pa.RecordBatch.from_arrays([pa.array([*to, part % buckets], pa.int64()), pa.array([part] * (len(to) + 1), pa.int64()), pa.array([*packed, None], pa.binary()), pa.array([None] * len(to) + [texts], pa.binary())], ["bucket", "part", "rows", "texts"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values by bucket."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= PARCEL_VALUES:
                yield of_values(held)
                held = []
        if held:
            yield of_values(held)

    def of_values(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy().view(np.uint64)
        by = np.argsort(key)
        to, packed = _by_bucket(t.set_column(0, "key", pa.array(key)).take(pa.array(by)), key[by], buckets)
        none = pa.nulls(len(to))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), none.cast(pa.int64()), pa.array(packed, pa.binary()), none.cast(pa.binary())], ["bucket", "part", "rows", "texts"])

    def look_up(t: pa.Table) -> pa.Table:
        """What a bucket's values add to the texts of each parcel."""
        own = t.filter(pc.is_null(t["part"]))
        theirs = t.filter(pc.is_valid(t["part"]))
        values = pa.concat_tables([*(_unpacked(x) for x in own["rows"]), pa.table({"key": pa.array([], pa.uint64()), "base": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})])
        key = values["key"].to_numpy()
        by = np.argsort(key)
        key = key[by]
        base, v = values["base"].to_numpy(zero_copy_only=False).astype(float)[by], values["v"].to_numpy()[by]
        seen, logs = base > 0, np.where(np.isnan(base), 0.0, np.log10(np.nan_to_num(base) + ALPHA))
        out = []
        for part, rows, texts in zip(theirs["part"].to_pylist(), theirs["rows"], theirs["texts"].to_pylist(), strict=True):
            if texts is not None:
                out.append((part, None, texts))
                continue
            rows = _unpacked(rows)
            wanted = rows["key"].to_numpy()
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = np.flatnonzero(key[at] == wanted) if len(key) else np.zeros(0, np.int64)
            at, text, n = at[hit], rows["text"].to_numpy()[hit], rows["n"].to_numpy()[hit]
            some = np.flatnonzero(np.bincount(text))
            sums = [np.bincount(text, n * x[at])[some] for x in (seen, logs, v)]
            out.append((part, _packed(pa.table([pa.array(some.astype(np.int32)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["text", *names[4:]])), None))
        part, rows, texts = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(part, pa.int64()), pa.array(rows, pa.binary()), pa.array(texts, pa.binary())], ["part", "rows", "texts"])

    def add(t: pa.Table) -> pa.Table:
        """The texts of a parcel with all sums."""
        out = _unpacked(next(x for x in t["texts"] if x.is_valid))
        sums = [out[k].to_numpy().astype(float) for k in names[4:]]
        for rows in (_unpacked(x) for x in t["rows"] if x.is_valid):
            text = rows["text"].to_numpy()
            for total, k in zip(sums, names[4:], strict=True):
                total[text] += rows[k].to_numpy()  # a text is there once
        return pa.table([*(out[k] for k in names[:4]), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names)

    names = ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "log_c", "score"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), held_out(10).alias("held_out"), F.col("text").cast("binary").alias("text"))
    parcels = "bucket bigint, part bigint, rows binary, texts binary"
    sent = rows.mapInArrow(run, parcels).unionByName(values.select("key", "base", "v").mapInArrow(table, parcels))
    got = sent.groupBy("bucket").applyInArrow(look_up, "part bigint, rows binary, texts binary")
    return got.groupBy("part").applyInArrow(add, "doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, log_c double, score double")


def lm_score(docs: DataFrame, top_keys: int = TOP_KEYS, filter_bytes: int = FILTER_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    One row for each row of docs (doc_id, text; other columns are not read). Nothing is learned
    from rows whose crc32(doc_id as text) mod 10 is 0; a null doc_id counts as the empty text and
    so is held out. Null texts are empty: their one token is the end. Words of more than PIECE
    bytes, up to whole texts without white space, are modelled piece by piece to their end.
    Repeated rows are texts of their own. Without training rows the counts are zero, and
    base_score is that of the smoothed counts. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    fitted = fit(docs.select("doc_id", "text"), scratch, group_rows)
    out = score_texts(docs.select("doc_id", "text"), fitted, scratch, top_keys, filter_bytes)
    base = F.col("log_c") - F.col("n_tokens") * math.log10(fitted.n + ALPHA * (fitted.v + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", (F.col("score") * -math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
