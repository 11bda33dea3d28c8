"""Running values of long timelines equal those of windows, and no task holds a whole one."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuegrain.operators import scan, stats
from cuegrain.operators import timeline as tl


def made(seed, sizes):
    rnd = random.Random(seed)
    rows = []
    for file, n in sizes.items():
        for i in range(n):
            at = rnd.choice([rnd.randrange(n), rnd.randrange(n), 7, 10**12, None]) if file != "even" else i
            rows.append((file, at, i, rnd.choice([None, rnd.randint(-5, 5)])))
    return rows


@pytest.mark.parametrize("size", [1, 10, 150, 10**6])
def test_windows(spark, size):
    rows = made(size, {"a": 400, "even": 300, "b": 9, None: 200, "one": 1})
    df = spark.createDataFrame(rows, "file string, at long, i long, v long").repartition(4)
    w = Window.partitionBy("file").orderBy("at", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    want = df.select("file", "at", "i", F.sum(v).over(upto).alias("s"), F.count(F.lit(1)).over(upto).alias("n"), F.max(v).over(upto).alias("x"), F.min(v).over(upto).alias("m"), F.last(v, ignorenulls=True).over(upto).alias("l"), F.lead(v).over(w).alias("next"))
    got = scan.scan(df, ["file"], ["at", "i"], [scan.Running("s", "sum", v), scan.Running("n", "count"), scan.Running("x", "max", v), scan.Running("m", "min", v), scan.Running("l", "last", v), scan.Running("next", "next", v)], size).drop("v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_one_long_file_is_spread(spark):
    df = spark.range(0, 300_000, 1, 8).select(F.lit("film").alias("file"), (F.col("id") * 40 + F.col("id") * 7 % 13 * 30).alias("pts"), F.col("id").alias("pos"))
    cut = scan.segments(df, ["file"], "pts", 20_000).groupBy("_segment").count().collect()
    assert len(cut) >= 10 and max(r["count"] for r in cut) <= 21_000
    got = scan.decode_times(df, 20_000)
    want = tl.decode_times(df)
    assert got.count() == 300_000 and got.exceptAll(want).count() == 0
    gate = scan.commit_gate(want, 20_000)
    assert gate.exceptAll(tl.commit_gate(want)).count() == 0


def test_lag_and_stretches(spark):
    rnd = random.Random(3)
    rows = [(s, i, rnd.choice(["begin", "end", "draw", None])) for s in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "stream long, seq long, stage string")
    assert sorted(map(tuple, scan.running_lag(df, 25).collect())) == sorted(map(tuple, stats.running_lag(df).collect()))
    cues = spark.createDataFrame([(1, b, b + rnd.randrange(-3, 30)) for b in range(0, 500, 3)], "file long, begin long, end long")
    w = Window.partitionBy("file").orderBy("begin")
    ends = cues.where("begin < end").select("file", F.explode(F.array(F.lit(0).cast("long"), "begin", "end")).alias("begin")).distinct().withColumn("end", F.lead("begin").over(w)).where("end IS NOT NULL")
    assert sorted(map(tuple, scan.cue_segments(cues, 20).collect())) == sorted(map(tuple, ends.collect()))


def test_nothing_and_wrong_kinds(spark):
    df = spark.createDataFrame([], "file string, at long")
    assert scan.scan(df, ["file"], ["at"], [scan.Running("n", "count")]).collect() == []
    with pytest.raises(ValueError, match="mean"):
        scan.scan(df, ["file"], ["at"], [scan.Running("n", "mean")])


def test_rows_are_never_shuffled_by_file_alone(spark):
    """One long file would come to one task, whatever joins Spark plans."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(0, 3000, 1, 2).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), (F.col("id") * 40 + F.col("id") * 7 % 13 * 30).alias("pts"), F.col("id").alias("pos"))
    spark.conf.set(key, "-1")
    try:
        cut = plan(scan.segments(df, ["file"], "pts", 100))
        assert not re.findall(r"hashpartitioning\(coalesce\(file#\d+, \S*\), isnull\(file#\d+\), \d+\)", cut), cut
        times = plan(scan.decode_times(df, 100))
        assert len(re.findall(r"hashpartitioning\(file#\d+, \d+\)", times)) == 4, times  # the counts of files, and sums of segments three times (a row each)
    finally:
        spark.conf.set(key, before)
    few = spark.createDataFrame([(f, i, i * 10) for f, n in (("a", 1), ("b", 3), ("c", 4), ("d", 5)) for i in range(n)], "file string, pos long, pts long")
    assert sorted((r.file, r.pos) for r in scan.decode_times(few, 2).where("is_tail").collect()) == [("a", 0), *(("b", i) for i in range(3)), *(("c", i) for i in range(4)), *(("d", i) for i in range(1, 5))]
