"""Phrase collocation mining by level-wise (Apriori) passes.

Pass k reads all texts and counts phrases of k words. From the second on it gets the frequent
phrases of k - 1 words as a broadcast bit map and emits a phrase only if its first and its last
k - 1 words are in there; the map never misses a frequent phrase, so no count is lost. Counts are
added up in the task before the shuffle. Scores, containment and ranks come from joins of the
level tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, chunks, in_filter, mix64, partitions, salted_join, word_hashes

#: Words of the longest phrase.
LONGEST = 4
#: Occurrences that make a phrase frequent.
LEAST = 30
#: A phrase goes if a longer one that contains it has so many percent of its occurrences.
CONTAINED = 80
#: Phrases returned for each language.
TOP = 2000
#: Bytes of text whose counts are added up in a task, and of the bit map.
MEMTABLE, FILTER = 12 << 20, 32 << 20
#: Shares (a power of two) in which a task counts, so that it holds few numbers beside the words.
SHARES = 8
#: A first word with a HOT-th of its language's words or more is dealt over SALTS tasks (a power of two); there are HOT at most in a language.
HOT, SALTS = 1000, 64

_upper = np.arange(256, dtype=np.uint8)
_upper[ord("A") : ord("Z") + 1] += 32
_mark = np.zeros(256, bool)
_mark[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_gap = _mark.copy()
_gap[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _read(texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words each with one blank behind it, their lengths, hashes, whether a word goes on the piece of the word before, number of the text)."""
    buf = _upper[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap, mark = _gap[buf], _mark[buf]
    first, last = ~gap, gap.copy()
    first[1:] &= gap[:-1]
    last[1:] &= ~gap[:-1]
    last[0] = False
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    marks = np.cumsum(mark, dtype=np.int32)
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = marks[starts[1:]] == marks[ends[:-1] - 1]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(lens), starts, "right")
    h = mix64(word_hashes(buf, starts, ends) ^ seeds[doc])
    buf[ends] = 0x20
    gap[ends] = False
    return buf[~gap], (ends - starts).astype(np.int32), h, goes_on, doc


def _grams(h: np.ndarray, goes_on: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they stand in one piece)."""
    out, whole = h.copy(), np.ones(len(h), bool)
    for j in range(1, k):
        n = max(0, len(h) - j)
        out[:n] = mix64(out[:n] * _STEP + h[j:])
        whole[:n] &= goes_on[j:]
        whole[n:] = False
    return out, whole


def _differ(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a and those from b on differ, eight at a time; 8 bytes must follow the last."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    bad, at, left = np.zeros(len(a), bool), np.arange(len(a)), n.copy()
    a, b = a.copy(), b.copy()
    while len(at):
        x = eight[a] ^ eight[b]
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        bad[at[x != 0]] = True
        go = left > 8
        at, a, b, left = at[go], a[go] + 8, b[go] + 8, left[go] - 8
    return bad


def _counted(buf: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of one occurrence, count) of equal phrases: sorted by hash, compared by their bytes."""
    at = np.arange(len(h))
    while len(at):  # once, and once more for each phrase that shares another's hash
        order = at[np.argsort(h[at], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        group = np.cumsum(new) - 1
        head = order[new][group]
        other = size[order] != size[head]
        same = np.flatnonzero(~other & ~new)
        other[same] = _differ(buf, start[order[same]], start[head[same]], size[order[same]])
        yield order[new], np.bincount(group[~other], minlength=int(new.sum()))
        at = np.sort(order[other])


def _cut(buf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.Array:
    """The stretches of ``n`` bytes from ``begin`` on as strings."""
    offsets = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    index = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], n)
    return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(buf[index].tobytes())])


class _Memtable:
    """Words of some texts, until their phrases are counted."""

    def __init__(self, k: int, frequent: np.ndarray | None, hot: np.ndarray):
        self.k, self.frequent, self.hot = k, frequent, hot
        self.parts: list[tuple] = []
        self.bytes = 0

    def add(self, buf, size, h, goes_on, lang) -> None:
        self.parts.append((buf, size, h, goes_on, lang))
        self.bytes += len(buf)

    def flush(self, langs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        buf, size, h, goes_on, lang = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.bytes = [], 0
        start = np.cumsum(size + 1, dtype=np.int32) - size - 1
        buf = np.concatenate([buf, np.zeros(8, np.uint8)])
        hashes, whole = _grams(h, goes_on, self.k)
        if self.frequent is not None:
            below, _ = _grams(h, goes_on, self.k - 1)
            found = in_filter(self.frequent, below.view(np.int64))
            found[:-1] &= found[1:]
            whole &= found
            del below, found
        at = np.flatnonzero(whole).astype(np.int32)
        hashes = hashes[at]
        last = at + self.k - 1
        begin, n, head = start[at], start[last] + size[last] - start[at], size[at]
        lang, first = lang[at], h[at]
        del at, last, whole, h, goes_on, start, size
        names = b"".join(x + b"\n" for x in langs)
        both = np.concatenate([buf, np.frombuffer(names, np.uint8)])
        name_n = np.array([len(x) + 1 for x in langs])
        name_at = len(buf) + np.cumsum(name_n) - name_n
        if self.k == 1:  # all words of a language count as its empty phrase
            for code, count in zip(*np.unique(lang, return_counts=True), strict=True):
                yield self._row([langs[code] + b"\n"], [int(count)])
        for share in range(SHARES):  # phrases with one first word are counted together
            own = np.flatnonzero(first >> np.uint64(64 - SHARES.bit_length() + 1) == share).astype(np.int32)
            for one, count in _counted(buf, begin[own], n[own], hashes[own]):
                one = own[one]
                salt = np.where(np.isin(first[one], self.hot), hashes[one] & np.uint64(SALTS - 1), 0).astype(np.int32)
                order = np.lexsort((salt, first[one]))
                one, count, salt = one[order], count[order].astype(np.int64), salt[order]
                for lo in range(0, len(one), 100_000):
                    part = one[lo : lo + 100_000]
                    yield self._rows(both, begin[part], head[part], n[part], name_at[lang[part]], name_n[lang[part]], salt[lo : lo + 100_000], count[lo : lo + 100_000])

    @staticmethod
    def _row(keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array([0] * len(keys), pa.int32()), pa.array([""] * len(keys)), pa.array([[c] for c in counts], pa.list_(pa.int64()))], names=["key", "salt", "rests", "n"])

    @staticmethod
    def _rows(both, begin, head, n, name_at, name_n, salt, count) -> pa.RecordBatch:
        """A row for each first word (language, line feed, word): what follows it in its phrases, a line each, and their counts. Neighbours with one first word share a row."""
        new = np.ones(len(begin), bool)
        alike = (salt[1:] == salt[:-1]) & (head[1:] == head[:-1]) & (name_at[1:] == name_at[:-1])
        near = np.flatnonzero(alike)
        new[1:] = ~alike
        new[1 + near] = _differ(both, begin[1 + near], begin[near], head[near])
        rows = np.flatnonzero(new)
        bounds = np.append(rows, len(begin))
        stretches = _cut(both, np.stack([name_at[rows], begin[rows]], 1).ravel(), np.stack([name_n[rows], head[rows]], 1).ravel())
        _, at, held = stretches.buffers()
        keys = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(np.frombuffer(at, np.int32)[::2].tobytes()), held])
        if (n == head).all():  # single words
            return pa.RecordBatch.from_arrays([keys, pa.array(salt[rows]), pa.array([""] * len(rows)), pa.ListArray.from_arrays(bounds.astype(np.int32), count)], names=["key", "salt", "rests", "n"])
        # what follows the first word, and the byte behind the phrase, which becomes a line feed but for the last
        tail = n - head
        ends = np.cumsum(tail)
        index = np.arange(ends[-1]) + np.repeat(begin + head + 1 - (ends - tail), tail)
        data = both[index]
        data[ends - 1] = 0x0A
        keep = np.ones(len(data), bool)
        keep[ends[bounds[1:] - 1] - 1] = False
        sums = np.concatenate([[0], ends[bounds[1:] - 1] - np.arange(1, len(rows) + 1)])
        rests = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(sums.astype(np.int32).tobytes()), pa.py_buffer(data[keep].tobytes())])
        return pa.RecordBatch.from_arrays([keys, pa.array(salt[rows]), rests, pa.ListArray.from_arrays(bounds.astype(np.int32), count)], names=["key", "salt", "rests", "n"])


def _seed(lang: bytes) -> np.uint64:
    buf = np.frombuffer(lang + b"\n", np.uint8)
    return word_hashes(buf, np.array([0]), np.array([len(buf)]))[0]


def _hashed(phrases: DataFrame, k: int) -> DataFrame:
    """Column h: the hash of each phrase (lang, phrase) of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.encode() for x in b.column(1).to_pylist()]
            seeds = np.array([_seed(x.encode()) for x in b.column(0).to_pylist()], np.uint64)
            for lo, hi in chunks(texts):
                _, _, h, goes_on, doc = _read(texts[lo:hi], seeds[lo:hi])
                hashes, whole = _grams(h, goes_on, k)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[whole].view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def count_phrases(docs: DataFrame, k: int, frequent=None, hot: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, f: occurrences of phrases of ``k`` words, and all words of a language as its empty phrase if k is 1.

    With ``frequent`` (a broadcast bit map of phrases of k - 1 words) only of those that may be
    frequent; ``hot``: hashes of the first words that are dealt over several tasks.
    """
    hot = np.empty(0, np.uint64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        table = _Memtable(k, None if frequent is None else frequent.value, hot)
        for b in batches:
            for first in range(0, b.num_rows, 500):
                rows = b.slice(first, 500)
                texts = [(x or "").encode() for x in rows.column(1).to_pylist()]
                own = np.array([codes.setdefault(b"und" if x is None else x.encode(), len(codes)) for x in rows.column(0).to_pylist()], np.int32)
                seeds = np.array([_seed(x) for x in codes], np.uint64)
                for lo, hi in chunks(texts):
                    buf, size, h, goes_on, doc = _read(texts[lo:hi], seeds[own[lo:hi]])
                    table.add(buf, size, h, goes_on, own[lo:hi][doc])
                    if table.bytes >= MEMTABLE:
                        yield from table.flush(list(codes))
        yield from table.flush(list(codes))

    # a task has added up its texts already: rows go to the shuffle as they are, a first word with all that follows it
    counted = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "key string, salt int, rests string, n array<long>").repartition("key", "salt")
    each = counted.select("key", "salt", F.explode(F.arrays_zip(F.split("rests", "\n").alias("rest"), F.col("n").alias("n"))).alias("x")) if k > 1 else counted.select("key", "salt", F.struct(F.lit("").alias("rest"), F.get("n", F.lit(0)).alias("n")).alias("x"))
    sums = each.groupBy("key", "salt", F.col("x.rest").alias("rest")).agg(F.sum("x.n").alias("f"))
    first = F.substring_index("key", "\n", -1)
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    return sums.select(lang.alias("lang"), (F.concat(first, F.lit(" "), "rest") if k > 1 else first).alias("phrase"), "f")


def _part(words: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of 2 to ``longest`` words of each language.

    Letters A-Z are lower-cased; marks ``.,;:!?`` and line ends separate pieces, blanks and tabs
    words. a counts a phrase, l and r its parts at the cut with the lowest score
    floor(2000000 * a / (l + r)) (the first of equal ones), n all words of the language. Phrases
    of fewer than ``least`` occurrences are left out, as are those that a longer one contains with
    ``contained`` percent of their occurrences or more. Arithmetic is decimal, so exact. A null
    language is ``und``, a null text empty; repeated rows count each time; texts of any length are
    read whole, part by part; other columns are not read; no words give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    levels: list[DataFrame] = []
    totals, frequent, hot = None, None, None
    for k in range(1, longest + 1):
        counted = count_phrases(docs, k, frequent, hot)
        kept = scratch.save(counted.where((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("k", F.lit(k)), f"level{k}")
        if k == 1:
            totals = kept.where("phrase = ''").select("lang", F.col("f").alias("n"))
            often = kept.where("phrase <> ''").join(totals, "lang").where(F.col("f") * HOT >= F.col("n"))
            hot = np.array([r["h"] for r in _hashed(often, 1).collect()], np.int64).view(np.uint64)
        levels.append(kept.where("phrase <> ''"))
        if k < longest:
            frequent = bit_filter(_hashed(levels[-1], k), levels[-1].count(), FILTER, lossy=True)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    phrases = every.where("k > 1").withColumn("words", F.split("phrase", " "))

    # the longest containing phrase's count of each phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    inside = phrases.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stay = phrases.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(contained).cast("decimal(20,0)") * F.col("f"), F.lit(True)))
    stay = scratch.save(stay.select("lang", "phrase", "k", F.col("f").alias("a"), "words"), "stay")

    # the counts of both parts at each cut
    cut = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.array(F.struct(i.alias("cut"), F.lit(0).alias("side"), _part(F.col("words"), 1, i).alias("part")), F.struct(i.alias("cut"), F.lit(1).alias("side"), F.array_join(F.slice("words", i + 1, F.col("k") - i), " ").alias("part"))))
    parts = stay.select("lang", "phrase", "a", F.explode(F.flatten(cut)).alias("x")).select("lang", "phrase", "a", "x.*")
    parts = scratch.save(parts.withColumn("key", F.concat_ws("\n", "lang", "part")).drop("part"), "parts")
    asked = parts.groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    known = every.select(F.concat_ws("\n", "lang", "phrase").alias("key"), F.col("f").alias("part_f")).join(asked, "key")
    sides = salted_join(parts, known, "key", "asked", parts.count(), F.struct("phrase", "cut"))
    both = sides.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_f"))).alias("r"))
    score = F.expr("CAST(floor(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))) AS BIGINT)")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each slice of a language, then the first of the language: few rows of each meet
    slices = lowest.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark))))
    first = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*best))).where(F.col("rank") <= top).drop("_slice")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS words FROM words, range(1, 5) AS ks(k), LATERAL unnest(range(1, len(w) - k + 2)) AS t(i)),
counted AS (SELECT lang, k, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= 30),
longer AS (
  SELECT lang, words[i:i + m - 1] AS words, max(f) AS f
  FROM frequent, range(2, 4) AS ms(m), LATERAL unnest(range(1, k - m + 2)) AS t(i) WHERE m < k GROUP BY ALL),
stay AS (
  SELECT c.* FROM frequent c LEFT JOIN longer g ON g.lang = c.lang AND g.words = c.words
  WHERE c.k > 1 AND (g.f IS NULL OR 100 * g.f::HUGEINT < 80 * c.f::HUGEINT)),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, x.f AS l, y.f AS r, cut, CAST((2000000 * s.f::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS BIGINT) AS score
  FROM stay s, range(1, 4) AS cs(cut), frequent x, frequent y
  WHERE cut < s.k AND x.lang = s.lang AND x.words = s.words[1:cut] AND y.lang = s.lang AND y.words = s.words[cut + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM lowest JOIN total USING (lang) QUALIFY rank <= 2000
"""
