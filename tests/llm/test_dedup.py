"""Exact dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuegrain.llm.common import Scratch
from cuegrain.llm.exact_dedup import build_index, exact_dedup, look_up
from cuegrain.llm.simhash import fingerprint, simhash_near_dedup

SCHEMA = "doc_id bigint, text string"


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    seen = set()
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep and (i, t) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((i, t))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "a  b"), (3, " a b"), (4, None), (5, ""), (6, "\t"), (7, " "), (8, "é" * 30000), (9, "é" * 30000), (10, "x"), (10, "x"), (None, "x"), (None, "y"), (11, "y")]


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")])
def test_exact(spark, digest):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("norm", F.lit(1)).withColumn("digest", F.lit("d"))
    got = exact_dedup(df, **({"digest": digest} if digest else {}))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_exact(ROWS)


def test_exact_without_filter_and_tiny_memtables(spark):
    rows = [(i, f"t{i % 7}") for i in range(700)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), memtable_rows=10, filter_bytes=0)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_exact(rows)


def test_an_index_takes_a_second_batch(spark):
    rnd = random.Random(9)
    rows = [(i, f"{rnd.randrange(300):04d}") for i in range(3000)]
    table = lambda part: spark.createDataFrame(part, "doc_id bigint, digest string")
    scratch = Scratch(spark)
    one = build_index(table(rows[1000:]), scratch, 64)
    both = build_index(table(rows[:1000]), scratch, 64, one)
    want = {d: (min(i for i, x in rows if x == d), sum(x == d for _, x in rows)) for _, d in rows}
    assert {r.digest: (r.keep_id, r.n) for r in both.collect()} == want and both.count() == len(want)
    assert {r.digest for r in look_up(both, ["0001", "9999"]).collect()} == {"0001"} & set(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).count() == 0
    assert simhash_near_dedup(df).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rnd = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 50, 400]:
        text = " \n".join(rnd.choice(["Ab", "é", "ÀX", "the", "of", "\x1c"]) for _ in range(n))
        assert fingerprint(text.encode()) == slow_fingerprint(text)
    assert fingerprint(b" \t\n") == 0


def brute_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_block", [4096, 3])
def test_simhash(spark, hot_block):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(words) for _ in range(120)] for _ in range(12)]
    rows = [(None, "null id"), (3, None), (4, ""), (5, "one"), (5, "one"), (6, "x" * 100000)]
    for i in range(70):
        w = list(rnd.choice(base))
        w[rnd.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(0)).withColumn("root", F.lit("r"))
    got = simhash_near_dedup(df, hot_block=hot_block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_components(rows)


def test_large_blocks_are_compared_in_tiles():
    from cuegrain.llm.simhash import _links

    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 14, 3000, dtype=np.uint64)
    values = np.unique(values)
    values = values[np.lexsort((values, np.bitwise_count(values)))]
    got = {tuple(sorted(p)) for x, y in _links(values, np.zeros(len(values), np.uint64), 3) for p in zip(x.tolist(), y.tolist())}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
