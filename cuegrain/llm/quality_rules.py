"""Quality rules: word and line counts, then bands of zstandard ratios.

The bands of each length, of whole documents and of chunks, are quantiles of the ratios of
documents labelled clean; the fixed ones below stand in where too few are labelled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Without labels: (bytes from which the band holds, lowest ratio, highest ratio) of a whole document.
BANDS = ((0, 0.0, 9.0), (128, 0.36, 1.05), (256, 0.30, 0.95), (512, 0.38, 0.80), (1024, 0.36, 0.74), (2048, 0.34, 0.72), (4096, 0.32, 0.70), (8192, 0.28, 0.70), (65536, 0.24, 0.70))
#: Documents are also cut into chunks of this many bytes; a shorter last chunk has the band of its own length.
CHUNK = 4096
CHUNK_BAND = (0.30, 0.72)
#: Without labels: bands of chunks.
CHUNK_BANDS = (*(b for b in BANDS if b[0] < CHUNK // 4), (CHUNK // 4, *CHUNK_BAND))
#: Documents labelled clean that a band of a length is taken from at least, and its quantiles.
LEAST_ROWS, QUANTILES = 200, (0.005, 0.995)
#: Share of chunks outside their band from which a document is rejected.
BAD_CHUNKS = 1 / 3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = rank[: n - width - step + 1] * (n + 1) + rank[step : n - width + 1]
        kinds, rank = np.unique(pair, return_inverse=True)
        if len(kinds) == len(pair):
            return 0
        width += step
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    cover = np.zeros(n + 1, np.int64)
    cover[twice] += 1
    cover[twice + window] -= 1
    return int((np.cumsum(cover)[:n] > 0).sum())


def band(bands: tuple, size: int) -> tuple[float, float]:
    return next((a, b) for least, a, b in reversed(bands) if size >= least)


def ratios(text: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Compressed by raw bytes of a text, and (bytes, ratio) of each of its chunks."""
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    each = [(len(p), len(zip_.compress(p)) / len(p)) for p in parts]
    return each[0][1] if len(parts) == 1 else len(zip_.compress(text)) / len(text) if text else 0.0, each


def judge(text: bytes | None, zip_: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk_bands: tuple = CHUNK_BANDS) -> tuple:
    text = text or b""
    words = text.split()
    bare = text.translate(None, SPACE)
    chars = len(bare) - int((np.frombuffer(bare, np.uint8) & 0xC0 == 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)

    ratio, parts = ratios(text, zip_)
    low, high = band(bands, len(text))
    bad = sum(not a <= r <= b for r, (a, b) in ((r, band(chunk_bands, n)) for n, r in parts))
    kept = not failed and low <= ratio <= high and bad <= BAD_CHUNKS * len(parts)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, failed, kept, ratio, len(parts), bad


def fit_bands(docs: DataFrame, labels: DataFrame, level: int = 3) -> tuple[tuple, tuple]:
    """Bands of whole documents and of chunks by length, from labels (doc_id, quality).

    They are taken from all documents that are labelled 1 and never 0 and pass the base rules. A
    length with fewer than LEAST_ROWS documents or chunks keeps its fixed band. The driver gets one
    row for each length.
    """
    clean = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")

    @F.pandas_udf("array<struct<chunk: boolean, bytes: long, ratio: double>>")
    def measured(texts: pd.Series) -> pd.Series:
        zip_ = zstandard.ZstdCompressor(level=level)

        def each(text: bytes | None) -> list[dict]:
            text = text or b""
            words = text.split()
            if len(words) < 20 or 100 * repeated_words(words) > 30 * len(words):
                return []
            ratio, parts = ratios(text, zip_)
            return [{"chunk": False, "bytes": len(text), "ratio": ratio}, *({"chunk": True, "bytes": n, "ratio": r} for n, r in parts)]

        return texts.map(each)

    # all texts are measured where they are read, so that the join shuffles ratios and not texts
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured(F.col("text").cast("binary")).alias("m")).where(F.size("m") > 0)
    rows = each.join(clean, "doc_id").select(F.explode("m").alias("m")).select("m.*")
    starts = [b[0] for b in BANDS]
    number = sum((F.when(F.col("bytes") >= x, 1).otherwise(0) for x in starts[1:]), F.lit(0))
    got = rows.groupBy("chunk", number.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ratio", list(QUANTILES), 10_000).alias("q")).where(F.col("n") >= LEAST_ROWS).collect()
    found = {(r["chunk"], starts[r["k"]]): tuple(r["q"]) for r in got}
    whole = tuple((x, *found.get((False, x), band(BANDS, x))) for x in starts)
    return whole, tuple((x, *found.get((True, x), band(CHUNK_BANDS, x))) for x in starts if x <= CHUNK)


def quality_rules(docs: DataFrame, level: int = 3, bands: tuple = BANDS, chunk_bands: tuple = CHUNK_BANDS) -> DataFrame:
    """doc_id and the columns of ``SCHEMA``: one row for each row of docs (doc_id, text).

    Null and empty texts have no words and so fail the base rules. kept is false where
    base_failed is true; else it says whether the ratio (compressed by raw bytes) of the whole
    document lies in the band of its length and at most a third of its chunks lie outside
    theirs. Repeated rows are judged one by one; no rows: no rows.
    """

    @F.pandas_udf(SCHEMA)
    def rules(texts: pd.Series) -> pd.DataFrame:
        zip_ = zstandard.ZstdCompressor(level=level)
        return pd.DataFrame([judge(t, zip_, bands, chunk_bands) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", rules(F.col("text").cast("binary")).alias("q")).select("doc_id", "q.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bands, chunk_bands = fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs, bands=bands, chunk_bands=chunk_bands)
