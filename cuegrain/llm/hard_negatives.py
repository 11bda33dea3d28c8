"""Hard negatives by distributed radix selection.

Rows are written as blocks of vectors, and the anchors among them as blocks of their own. Each pair
of blocks is one row of a job: a matrix product gives its scores, so the queries (anchors) meet all
rows in blocks. No score is written. For each window, the scores between two bounds that belong to
an anchor and one of its positives, tasks count the scores of other labels by one digit; the sums
of these counts say in which bucket the last wanted score lies, and the next pass counts by the
next digit within that bucket. Once that score is known, only the rows that qualify are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Rows of a block, and anchors of one on average: bounds a task's matrix of scores.
ROWS, ANCHORS = 4096, 512
#: An anchor's number is its block's, shifted by so much, plus its place in it.
PLACE = 20
#: Bytes of all anchors up to which each task gets them; beyond it both sides are shuffled.
BROADCAST = 32 << 20
#: Bits of a digit.
BITS = 8
#: Components of which a double holds the products and their sums exactly.
EXACT = 2.0**53

BLOCK = "block long, ids binary, known binary, labels binary, vectors binary, dims int, wide boolean, anchors binary, n_anchors long"
OWN = "a_block long, a_ids binary, a_known binary, a_labels binary, a_vectors binary, a_dims int, a_wide boolean, own_block binary, own_row binary"


def _plain(vector: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & finite


def _pack(block: int, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]) -> dict:
    dims = max((len(v) for v in vectors), default=0)
    table = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        table[i, : len(v)] = v
    wide = bool(dims and np.abs(table).max(initial=0) ** 2 * dims >= EXACT)
    return {"block": block, "ids": ids.tobytes(), "known": known.tobytes(), "labels": labels.tobytes(), "vectors": table.tobytes(), "dims": dims, "wide": wide}


def _opened(row, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether an id is known, labels, vectors) of a block."""
    ids, known, labels, vectors, dims = (row[prefix + c] for c in ("ids", "known", "labels", "vectors", "dims"))
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(known, bool), np.frombuffer(labels, np.int64), np.frombuffer(vectors).reshape(len(ids), dims)


def _numbers(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the largest number in the place of those that are missing, and which are there."""
    known = ids.notna().to_numpy()
    return np.array([int(x) if k else 2**63 - 1 for x, k in zip(ids, known, strict=True)], np.int64), known


def blocks(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Rows (id, label, vector, anchor) as blocks of at most ``size`` rows; components become floor(256 * x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                vectors = [np.floor(256 * np.asarray(v, np.float64)) for v in part["vector"]]
                ids, known = _numbers(part["id"])
                anchors = part["anchor"].to_numpy(bool) & known
                yield pd.DataFrame([_pack(n, ids, known, part["label"].to_numpy(np.int64), vectors) | {"anchors": anchors.tobytes(), "n_anchors": int(anchors.sum())}])
                n += 1

    exact = rows.select(F.col("id").cast("long").cast("decimal(20,0)").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    return exact.mapInPandas(run, BLOCK)


def anchor_blocks(stored: DataFrame, n: int) -> DataFrame:
    """The ``n`` anchors of the stored blocks as blocks 0 to n / ANCHORS of their own; each knows the place that it comes from."""

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                ids, _, labels, v = _opened(row)
                at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                if len(at):
                    yield pd.DataFrame({"id": ids[at], "label": labels[at], "vector": [r.tobytes() for r in v[at]], "own_block": row["block"], "own_row": at})

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        block = _pack(int(key[0]), ids, np.ones(len(ids), bool), pdf["label"].to_numpy(np.int64), [np.frombuffer(v) for v in pdf["vector"]])
        own = {"own_block": pdf["own_block"].to_numpy(np.int64).tobytes(), "own_row": pdf["own_row"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([{f"a_{k}": v for k, v in block.items()} | own])

    rows = stored.mapInPandas(taken, "id long, label long, vector binary, own_block long, own_row long")
    number = F.pmod(F.xxhash64("own_block", "own_row"), F.lit(-(-n // ANCHORS)))
    return rows.withColumn("a_block", number).groupBy("a_block").applyInPandas(packed, OWN)


class Pairs:
    """Each block of rows beside each block of anchors."""

    def __init__(self, stored: DataFrame, own: DataFrame, n: int, bytes_: int):
        self.stored, self.own, self.blocks = stored, own, -(-n // ANCHORS)
        self.small = bytes_ <= BROADCAST

    def of(self, windows: DataFrame | None = None) -> DataFrame:
        """The pairs; with ``windows`` (anchor and others) those of a block's anchors in a list, and only blocks that have some."""
        own = self.own
        if windows is not None:
            packed = windows.withColumn("a_block", F.shiftright("anchor", PLACE)).groupBy("a_block")
            own = own.join(packed.agg(F.collect_list(F.struct(*windows.columns)).alias("windows")), "a_block")  # a few for each anchor of one block
        rows = self.stored.withColumn("a_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.blocks - 1).cast("long"))))
        if self.small:
            return rows.join(F.broadcast(own), "a_block")
        salts = partitions(self.stored.sparkSession)
        rows = rows.withColumn("salt", F.pmod(F.hash("block"), F.lit(salts)))
        return rows.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["a_block", "salt"])


def _scores(anchors: np.ndarray, vectors: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products, exact: doubles where they hold all sums, else whole numbers of any size."""
    dims = min(anchors.shape[1], vectors.shape[1])  # a component that one vector lacks counts as zero
    a, v = anchors[:, :dims], vectors[:, :dims]
    if not wide and dims * max(np.abs(a).max(initial=0) * np.abs(v).max(initial=0), 0) < EXACT:
        return (a @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in v], object).reshape(v.shape).T
    if len(exact) and exact.size and max(abs(x) for x in exact.flat) >= 2**62:
        raise ValueError("scores do not fit in 64 bits")
    return exact.astype(np.int64)


def _best(order_by: list[np.ndarray], k: int) -> np.ndarray:
    return np.lexsort(order_by)[:k]


def _positives(pairs: Pairs, k: int) -> DataFrame:
    """anchor, anchor_id, positive_id, positive_score, n: the first ``k`` other rows of the anchor's label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                a_ids, _, a_labels, a = _opened(row, "a_")
                ids, known, labels, v = _opened(row)
                own, at = np.frombuffer(row["own_block"], np.int64), np.frombuffer(row["own_row"], np.int64)
                scores = _scores(a, v, row["wide"] or row["a_wide"])
                out = []
                for i, label in enumerate(a_labels):
                    same = labels == label
                    if own[i] == row["block"]:
                        same[at[i]] = False
                    same = np.flatnonzero(same)
                    s = scores[i, same]
                    if len(same) > k:  # all ties of the k-th stay, ids decide
                        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                        same, s = same[keep], s[keep]
                    first = _best([ids[same], -s], k)
                    out += [((row["a_block"] << PLACE) + i, a_ids[i], int(ids[j]) if known[j] else None, int(scores[i, j]), int(ids[j])) for j in same[first]]
                if out:
                    frame = pd.DataFrame(out, columns=["anchor", "anchor_id", "positive_id", "positive_score", "_order"], dtype="object")
                    yield frame.astype({"anchor": "int64", "anchor_id": "int64", "positive_id": "Int64", "positive_score": "int64", "_order": "int64"})

    found = pairs.of().mapInPandas(run, "anchor long, anchor_id long, positive_id long, positive_score long, _order long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "_order")
    return found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("_order")


def _each_window(batches: Iterator[pd.DataFrame]):
    """(row, window, scores of other labels in falling order, their places) of all windows of the pairs of blocks."""
    for pdf in batches:
        for _, row in pdf.iterrows():
            _, _, a_labels, a = _opened(row, "a_")
            ids, known, labels, v = _opened(row)
            scores = _scores(a, v, row["wide"] or row["a_wide"])
            by: dict[int, list] = {}
            for w in row["windows"]:
                by.setdefault(w["anchor"], []).append(w)
            for anchor, own in by.items():
                i = anchor & ((1 << PLACE) - 1)
                other = np.flatnonzero(labels != a_labels[i])
                s = scores[i, other]
                near = s >= min(w["lo"] for w in own)
                other, s = other[near], s[near]
                order = np.argsort(-s, kind="stable")
                for w in own:
                    yield ids, known, w, s[order], other[order]


def _histogram(pairs: Pairs, state: DataFrame) -> DataFrame:
    """anchor, n, bucket, count: how many scores of [lo, hi] have each digit, counted from the top.

    A block's counts end with the bucket in which it alone has all that is needed: the wanted score can't lie below.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for _, _, w, s, _ in _each_window(batches):
            begin, end = int(np.searchsorted(-s, -w["hi"], "left")), int(np.searchsorted(-s, -w["lo"], "right"))
            if begin == end:
                continue
            bucket, count = np.unique((w["hi"] - s[begin:end]) >> w["shift"], return_counts=True)
            last = int(np.searchsorted(np.cumsum(count), w["need"])) + 1
            out += [(w["anchor"], w["n"], int(b), int(c)) for b, c in zip(bucket[:last], count[:last], strict=True)]
            if len(out) > 100_000:
                yield pd.DataFrame(out, columns=["anchor", "n", "bucket", "count"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["anchor", "n", "bucket", "count"])

    counted = pairs.of(state).mapInPandas(run, "anchor long, n int, bucket long, count long")
    return counted.groupBy("anchor", "n", "bucket").agg(F.sum("count").alias("count"))


def _refined(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows cut to the bucket that holds the last wanted score, and how many are wanted of it; windows with too few scores are left out."""
    down = Window.partitionBy("anchor", "n").orderBy("bucket")
    above = F.coalesce(F.sum("count").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumn("above", above).join(state, ["anchor", "n"])
    last = held.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("count") >= F.col("need")))
    hi = F.expr("hi - shiftleft(bucket, shift)")
    lo = F.greatest(F.col("lo"), F.expr("hi - shiftleft(bucket + 1, shift) + 1"))
    return last.select("anchor", "n", lo.alias("lo"), hi.alias("hi"), (F.col("shift") - BITS).alias("shift"), (F.col("need") - F.col("above")).alias("need"))


def _gathered(pairs: Pairs, found: DataFrame, k: int) -> DataFrame:
    """anchor, n, negative_id, negative_score: rows above the last wanted score, and the smallest ids of a block that have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["anchor", "n", "negative_id", "negative_score", "_order"], dtype="object").astype({"anchor": "int64", "n": "int32", "negative_id": "Int64", "negative_score": "int64", "_order": "int64"})

        for ids, known, w, s, at in _each_window(batches):
            begin, end = int(np.searchsorted(-s, -w["hi"], "left")), int(np.searchsorted(-s, -w["lo"], "right"))
            first = _best([ids[at[begin:end]], -s[begin:end]], k)
            out += [(w["anchor"], w["n"], int(ids[j]) if known[j] else None, int(x), int(ids[j])) for j, x in zip(at[begin:end][first], s[begin:end][first], strict=True)]
            if len(out) > 100_000:
                yield frame()
                out.clear()
        if out:
            yield frame()

    return pairs.of(found).mapInPandas(run, "anchor long, n int, negative_id long, negative_score long, _order long")


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the integer inner product of the components floor(256 * x) with the anchor's.
    An anchor's positives are the ``positives`` best other rows of its label; for each, the
    ``negatives`` best rows of other labels with ``low`` to ``high`` percent of the positive's
    score are returned. Ties go to the smaller id; a row without an id takes part after all others,
    as no anchor. Rows without a label or vector, or with components that are null or not finite,
    take no part. Repeated rows are rows like others, so a copy of an anchor may be its positive. Of
    vectors of unequal length the missing components count as zero; scores must fit in 63 bits.
    Other columns are not read; an empty table has no rows.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    scratch = Scratch(spark)
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"), F.expr(anchors).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & _plain("vector")).repartition(partitions(spark))
    stored = scratch.save(blocks(rows), "rows")
    known = stored.agg(F.sum("n_anchors").alias("n"), F.max("dims").alias("dims")).first()
    n = known["n"] or 0
    if not n:
        return nothing
    pairs = Pairs(stored, scratch.save(anchor_blocks(stored, n), "anchors"), n, n * (8 * known["dims"] + 64 * positives))
    found = scratch.save(_positives(pairs, positives), "positives")

    # low * positive <= 100 * score <= high * positive, in whole numbers
    lo = F.expr(f"{low} * positive_score div 100 + CASE WHEN {low} * positive_score % 100 > 0 THEN 1 ELSE 0 END")
    hi = F.expr(f"{high} * positive_score div 100 - CASE WHEN {high} * positive_score % 100 < 0 THEN 1 ELSE 0 END")
    whole = found.select("anchor", "n", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    widest = whole.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    if widest is None:
        return nothing
    digits = max(1, -(-int(widest).bit_length() // BITS))
    state = whole.select("anchor", "n", "lo", "hi", F.lit((digits - 1) * BITS).alias("shift"), F.lit(negatives).cast("long").alias("need"))
    for _ in range(digits):
        state = scratch.save(_refined(state, _histogram(pairs, state)), "windows")
    last = state.select("anchor", "n", F.col("lo").alias("last"))  # the last wanted score; none where there are too few, and all qualify
    done = whole.join(last, ["anchor", "n"], "left").select("anchor", "n", F.coalesce("last", "lo").alias("lo"), "hi")
    best = Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "_order")
    ranked = _gathered(pairs, done, negatives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.join(found, ["anchor", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label, so that labels don't follow from the vectors alone."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label))


ORACLE = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
