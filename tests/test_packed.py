"""Packed bitstreams: tables, streams and restarts against a plain loop."""

import random

from pyspark.sql import functions as F

from cuegrain.plans.streams import rocks
from cuegrain.streaming import packed

SIZE = {"I": 400, "P": 200, "B": 100, "N": 7}


def loop(packets):
    """The rule told again, on lists of bytes: packets (n, kinds) of one file in order."""
    out, mode, waiting, last, held, left, expected = [], "first", None, None, "I", [], 0
    for n, kinds in packets:
        fresh = [(f"{n}.{k}", x) for k, x in enumerate(kinds)]
        seek = n != expected
        expected = n + 1
        if seek:
            held, left, last = "I", [], None
        data = left if left else fresh
        if not data or (data[0][1] == "N" and waiting):
            out.append((n, waiting, last if waiting else None, None, mode == "late"))
            waiting = None
            continue
        name, kind = data[0]
        behind = sum(SIZE[x] for _, x in data[1:])
        if mode == "first" and kind == "B" and not waiting:
            mode = "late"
        elif mode == "late" and behind > 16:
            mode = "first"
        needs = last if kind != "I" else None
        show, told = name, kind
        if mode == "late":
            if kind != "B":
                show = name if seek else last
            told, held = held, kind
        if kind != "B":
            last = name
        if mode == "first" and told == "I":
            waiting = None
        left = []
        if SIZE[kind] < sum(SIZE[x] for _, x in fresh):
            left = data[1:]
            if left and left[0][1] == "B":
                waiting, last, needs = told, show, show
                show, told = left[0][0], "B"
                left = left[1:]
        out.append((n, told, show, needs, mode == "late"))
    return out


def made(seed, files=12, most=60):
    rnd = random.Random(seed)
    out = {}
    for file in range(files):
        n, packets = 0, []
        for _ in range(rnd.randrange(most)):
            n += 1 if rnd.random() < 0.95 else rnd.randint(2, 5)
            packets.append((n - 1, rnd.choice(["P", "PB", "N", "B", "I", "IB", "PBB", "", "PN", "PI", "BB"])))
        out[file] = packets
    return out


def rows(spark, files):
    return spark.createDataFrame([(f, n, k, [SIZE[x] for x in k]) for f, own in files.items() for n, k in own], packed.PACKET)


def got(df):
    return sorted(((r.file, r.n, r.kind, r.shown, r.needs, r.late) for r in df.collect()), key=str)


def want(files):
    return sorted(((f, *x) for f, own in files.items() for x in loop(own)), key=str)


def test_tables(spark):
    files = made(1)
    files[99] = made(2, 1, 4000)[0]
    assert got(packed.packed_table(rows(spark, files).orderBy(F.rand(3)))) == want(files)
    assert got(packed.packed_table(rows(spark, {}))) == []


def test_streams_and_restarts(spark, tmp_path):
    files, bounds = made(5), (0, 7, 11, 30, 1000)
    state, out, inp = (str(tmp_path / x) for x in ("state", "out", "in"))
    with rocks(spark):
        for lo, hi in zip(bounds, bounds[1:], strict=False):  # a new run of the query for each share
            share = {f: own[lo:hi] for f, own in files.items()}
            rows(spark, share).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(inp)
            stream = packed.packed_stream(spark.readStream.schema(packed.PACKET).parquet(inp))
            run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            run.awaitTermination()
    assert got(spark.read.parquet(out)) == want(files)
