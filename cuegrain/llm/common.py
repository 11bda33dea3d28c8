"""Helpers shared by the training-data operators: scratch tables, salting and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a Java regular expression class.
WS = r"[\x20\x09-\x0D]"

_is_space = np.zeros(256, bool)
_is_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---------------------------------------------------------------- scratch tables


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests, the bench) gets a temporary folder; on a cluster,
    whose machines don't share one, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cuegrain-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operator run. ``save`` cuts lineage: executors may be lost afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, work_dir(spark), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        self.spark._jvm.System.gc()  # lets Spark delete the shuffle files of what is written now
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cuegrain_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cuegrain_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(mod: int) -> Column:
    """Rows from which nothing is learned; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0


# ---------------------------------------------------------------- skew


def salted_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join where ``right`` has one row a key and ``count`` says how many rows of ``left`` have it.

    Keys with more than ``limit`` rows are dealt over several salts. There are at most
    ``total / limit`` <= 2,000 such keys, so the list of them is small enough to broadcast
    at any input size.
    """
    limit = max(256, total // 2000)
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = right.where(F.col(count) > limit).select(key, salts.alias("_salts"))
    left = left.join(F.broadcast(hot), key, "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts").cast("long")).cast("int"), F.lit(0))).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------- filters

PIECE_BITS = 18


def bit_filter(keys: DataFrame, n: int, bound: int, lossy: bool = False):
    """Broadcast bit map over ``n`` 64-bit keys (column h), 16 bits or more a key; beyond ``bound`` bytes None, or with ``lossy`` one of ``bound`` bytes (a power of two), in which more other keys are found.

    A key that is in it is always found; one in about 16 others is found too. Tasks build the
    pieces, each from its own range of slots; only the map itself, of at most ``bound`` bytes,
    passes the driver.
    """
    bits = 1 << max(PIECE_BITS, int(max(n, 1) * 16 - 1).bit_length())
    if bits // 8 > bound:
        if not lossy:
            return None
        bits = 8 * bound

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        filled = np.zeros(1 << PIECE_BITS, bool)
        filled[pdf["slot"].to_numpy() & ((1 << PIECE_BITS) - 1)] = True
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "filled": [np.packbits(filled).tobytes()]})

    slots = keys.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("slot")).withColumn("piece", F.shiftrightunsigned("slot", PIECE_BITS))
    rows = slots.groupBy("piece").applyInPandas(piece, "piece bigint, filled binary").collect()
    whole = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = r["piece"] << (PIECE_BITS - 3)
        whole[at : at + (1 << (PIECE_BITS - 3))] = np.frombuffer(r["filled"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def in_filter(whole: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h.astype(np.int64, copy=False) & (len(whole) * 8 - 1)
    return (whole[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- words, vectorised


def chunks(texts: list[bytes], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, so that numpy temporaries stay small."""
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each word, byte after each word, number of its text)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _is_space[buf]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    last = space.copy()
    last[1:] &= ~space[:-1]
    last[0] = False
    ends = np.flatnonzero(last)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(lens), starts, "right")
    return buf, starts, ends, doc


_rng = np.random.default_rng(20240229)
_byte_value = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)]), dtype=np.uint64) for x in (_BASE, back)]
    return _powers


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same in every process."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers_to(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_value[buf] * up[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
