"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters
run over each chunk, their largest answers are pooled, and the mean of a text's pooled chunks
goes through one hidden layer to a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

CHUNK, HOP = 512, 448
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 12, 4, 48, 16
#: The classifier is fitted on at most this many labelled rows of each class, and on at most this many chunks of each.
SAMPLE_ROWS, SAMPLE_CHUNKS = 2500, 4
EPOCHS, BATCH, RATE = 10, 32, 0.004
THRESHOLD = 0.3


def cut(text: bytes) -> np.ndarray:
    """All chunks of a text; the last one is padded with zero bytes."""
    n = max(1, -(-max(0, len(text) - CHUNK) // HOP) + 1)
    padded = np.frombuffer(text.ljust((n - 1) * HOP + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (HOP, 1))


@dataclass
class Net:
    weights: dict[str, np.ndarray]
    prior: float

    @staticmethod
    def new(seed: int = 5) -> Net:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return Net({"embed": n(256, EMBED) * 4, "conv": n(WIDTH * EMBED, FILTERS), "conv_b": np.zeros(FILTERS, np.float32), "hid": n(FILTERS, HIDDEN), "hid_b": np.zeros(HIDDEN, np.float32), "out": n(HIDDEN), "out_b": np.zeros(1, np.float32)}, 0.5)

    def pooled(self, chunks: np.ndarray, keep: bool = False):
        """Largest answer of each filter in each chunk."""
        w = self.weights
        x = w["embed"][chunks].reshape(len(chunks), -1)
        steps = (CHUNK - WIDTH) // STRIDE + 1
        x = np.lib.stride_tricks.as_strided(x, (len(chunks), steps, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * 4, 4))
        y = x.reshape(-1, WIDTH * EMBED) @ w["conv"]
        y = y.reshape(len(chunks), steps, FILTERS)
        if not keep:
            return np.maximum(y.max(1) + w["conv_b"], 0)
        at = y.argmax(1)
        top = np.take_along_axis(y, at[:, None], 1)[:, 0] + w["conv_b"]
        return np.maximum(top, 0), x, at, top

    def head(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        h = np.tanh(mean @ w["hid"] + w["hid_b"])
        return h, 1 / (1 + np.exp(-np.clip(h @ w["out"] + w["out_b"], -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, held, first = [], [], [0]

        def flush() -> None:
            pooled = np.concatenate([self.pooled(c) for x in [np.concatenate(held)] for c in np.array_split(x, -(-len(x) // 128))])
            n = np.diff(first)
            out.append(self.head(np.add.reduceat(pooled, first[:-1], axis=0) / n[:, None])[1])

        for t in texts:
            c = cut(t)
            held.append(c)
            first.append(first[-1] + len(c))
            if first[-1] >= 512:
                flush()
                held, first = [], [0]
        if held:
            flush()
        return np.concatenate(out).astype(np.float64) if out else np.empty(0)

    def learn(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> None:
        """Adam on the log loss; each bag holds the sampled chunks of one labelled text.

        One bag in four is replaced by a short piece of a chunk, for short texts are rare in samples.
        """

        def piece(bag: np.ndarray) -> np.ndarray:
            c = bag[r.integers(len(bag))]
            n = int(np.exp(r.uniform(np.log(12), np.log(CHUNK))))
            lo = r.integers(0, max(1, int((c > 0).sum()) - n))
            return cut(c[lo : lo + n].tobytes().rstrip(b"\0"))

        r, w = np.random.default_rng(seed), self.weights
        m = {k: np.zeros_like(v) for k, v in w.items()}
        s = {k: np.zeros_like(v) for k, v in w.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                held = [piece(bags[i]) if r.random() < 0.25 else bags[i] for i in own]
                n = np.array([len(b) for b in held])
                of = np.repeat(np.arange(len(own)), n)
                chunks = np.concatenate(held)
                pooled, x, at, top = self.pooled(chunks, keep=True)
                mean = np.add.reduceat(pooled, np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]
                h, p = self.head(mean)
                d = ((p - labels[own]) / len(own)).astype(np.float32)
                g = {"out": h.T @ d, "out_b": d.sum(keepdims=True)}
                dh = d[:, None] * w["out"] * (1 - h * h)
                g |= {"hid": mean.T @ dh, "hid_b": dh.sum(0)}
                dtop = ((dh @ w["hid"].T) / n[:, None])[of] * (top > 0)
                g["conv_b"] = dtop.sum(0)
                best = x[np.arange(len(chunks))[:, None], at]  # chunk, filter, width * embed
                g["conv"] = np.einsum("cf,cfe->ef", dtop, best)
                dx = (dtop[:, :, None] * w["conv"].T[None]).reshape(-1, EMBED)
                where = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
                seen = chunks[np.arange(len(chunks))[:, None, None], where].ravel()
                g["embed"] = np.stack([np.bincount(seen, dx[:, e], 256) for e in range(EMBED)], 1)
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Net:
    """Learn from ``rows`` labelled documents of each class, those with the smallest hashes of doc_id.

    A document with several labels takes the smallest; of rows that share a doc_id one text is taken. What reaches the driver is bounded:
    2 * rows * SAMPLE_CHUNKS chunks of CHUNK bytes. Without both classes, every score is the
    share of label 1, or 0.5 without labels.
    """
    labelled = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(5)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = None
    for q in (0, 1):
        one = labelled.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = one if picked is None else picked.unionByName(one)

    @F.pandas_udf("array<binary>")
    def sample(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def of(i: int, t: bytes | None) -> list[bytes]:
            c = cut(t or b"")
            at = np.random.default_rng(zlib.crc32(str(i).encode())).choice(len(c), min(SAMPLE_CHUNKS, len(c)), replace=False)
            return [c[k].tobytes() for k in sorted(at)]

        return pd.Series([of(i, t) for i, t in zip(ids, texts, strict=True)])

    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * rows rows
    # Chunks are taken before rows of one doc_id meet, so that whole texts aren't shuffled.
    bags = chosen.select("doc_id", "quality", F.xxhash64("text").alias("hash"), sample("doc_id", F.col("text").cast("binary")).alias("bag"))
    got = bags.groupBy("doc_id", "quality").agg(F.min_by("bag", "hash").alias("bag")).collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in got], np.float32)
    net = Net.new()
    if len(set(y.tolist())) < 2:
        net.weights["out"][:] = 0
        net.prior = float(y.mean()) if len(y) else 0.5
        net.weights["out_b"][:] = np.log(max(net.prior, 1e-6) / max(1 - net.prior, 1e-6))
        return net
    net.learn([np.stack([np.frombuffer(c, np.uint8) for c in r["bag"]]) for r in got], y)
    return net


def scorer(spark, net: Net):
    """A column function: binary text -> probability that the label is 1."""
    held = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.scores([t or b"" for t in texts]))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted; other columns stay.

    Only the bytes of the text are inputs. Null and empty texts get the score of a chunk of
    padding. No rows: no rows.
    """
    score = scorer(docs.sparkSession, fit(docs, labels))
    return docs.withColumn("score", score(F.col("text").cast("binary"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out(5).alias("held_out"), "score", "predicted")
