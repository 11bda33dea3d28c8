"""Timeline operators against a state machine and golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrain.operators import timeline as tl
from cuegrain.streaming.release import sweep

CUE = "file long, num long, begin long, end long, line string"


def golden(*cues):
    return [(1, i, b, e, t) for i, (t, b, e) in enumerate(cues)]


@pytest.mark.parametrize(
    "cues, packets",
    [
        (golden(("A", 0, 10), ("B", 2, 4), ("C", 2, 12), ("D", 15, 16)), [(0, 2, "A\n"), (2, 4, "A\nB\nC\n"), (4, 10, "A\nC\n"), (10, 12, "C\n"), (12, 15, "\n"), (15, 16, "D\n")]),
        (golden(("A", 5, 7)), [(0, 5, "\n"), (5, 7, "A\n")]),
        (golden(("A", 0, 5), ("B", 5, 9)), [(0, 5, "A\n"), (5, 9, "B\n")]),
        (golden(("A", 3, 9), ("B", 1, 9)), [(0, 1, "\n"), (1, 3, "B\n"), (3, 9, "B\nA\n")]),
        (golden(("A", 4, 4), ("B", 6, 5), ("C", 0, 2)), [(0, 2, "C\n")]),
    ],
)
def test_golden_sweeps(spark, cues, packets):
    got = tl.serialize_cues(spark.createDataFrame(cues, CUE), bucket=3).orderBy("begin").collect()
    assert [(r.begin, r.end, r.text) for r in got] == packets


def test_sweeps_equal_the_model(spark):
    rnd = random.Random(11)
    rows = []
    for file in range(60):
        for num in range(rnd.randrange(9)):
            b = rnd.randrange(40)
            rows.append((file, num, b, b + rnd.randrange(-2, 15), rnd.choice(["x", "y\n", "z"])))
    want = []
    for file in {r[0] for r in rows}:
        own = [(b, n, e, s if s.endswith("\n") else s + "\n") for f, n, b, e, s in rows if f == file and b < e]
        want += [(file, *p) for p in sweep(own, 0)] if own else []
    for bucket in (1, 4, 1000):
        got = tl.serialize_cues(spark.createDataFrame(rows, CUE), bucket=bucket).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_packets_part_the_time(spark):
    got = tl.serialize_cues(spark.createDataFrame(golden(("a", 2, 5), ("b", 4, 9), ("c", 11, 12)), CUE)).orderBy("begin").collect()
    assert got[0].begin == 0 and got[-1].end == 12
    assert all(x.end == y.begin for x, y in zip(got, got[1:]))


def test_lacing(spark):
    rows = [(1, 0, i) for i in range(4)] + [(1, 10, i + 4) for i in range(3)] + [(1, 17, 7 + i) for i in range(3)] + [(1, 26, 10)]
    got = tl.laced_durations(spark.createDataFrame(rows, "file long, tc long, pos long")).orderBy("pos").collect()
    assert [r.duration for r in got] == [2, 2, 3, 3, 2, 2, 3, 3, 3, 3, None]


def test_reorder(spark):
    pts = [0, 120, 40, 80, 240, 160, 200]
    got = tl.decode_times(spark.createDataFrame([(1, i, p) for i, p in enumerate(pts)], "file long, pos long, pts long")).orderBy("pos").collect()
    assert [r.dts for r in got] == [0, 40, 80, 120, 160, 200, 240]
    assert [r.duration for r in got] == [40, 40, 40, 40, None, 40, 40]


def test_index_durations(spark):
    rows = [(1, i, s) for i, s in enumerate([5, 0, 0, 7, 8, 0])]
    got = tl.index_video_durations(spark.createDataFrame(rows, "file long, k long, size long"), 2).orderBy("k").collect()
    assert [(r.k, r.duration) for r in got] == [(0, 6), (3, 2), (4, 4)]


def test_sweep_plan_has_an_equi_join(spark):
    plan = tl.serialize_cues(spark.createDataFrame(golden(("a", 2, 5)), CUE))._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], CUE)
    assert tl.serialize_cues(none).count() == tl.cue_clusters(none).count() == tl.fill_gaps(none).count() == 0


def test_next_at_or_after(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "file long, at long")
    index = spark.createDataFrame([(1, 5), (1, 7)], "file long, pos long")
    got = {(r.file, r.at): r.next_pos for r in tl.next_at_or_after(left, index, "file", "at", "pos").collect()}
    assert got == {(1, 5): 7, (1, 9): None, (2, 1): None}
    got = {(r.file, r.at): r.next_pos for r in tl.next_at_or_after(left, index, "file", "at", "pos", strict=False).collect()}
    assert got[1, 5] == 5


def test_carry(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 3, None)], "file long, n long, delay long")
    assert [r.d for r in tl.carry(df, ["file"], ["n"], F.col("delay"), "d").orderBy("n").collect()] == [None, 7, 7]
