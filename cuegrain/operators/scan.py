"""Running values over timelines of which one may hold most of all rows.

A window over a file is one task, however many machines there are. Here a timeline is cut into
segments of neighbouring rows; each is summed up by itself, the few sums of a timeline are scanned,
and what stands before a segment is added to the running values within it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a segment, about; cells of time by which segments are cut.
SEGMENT, CELLS = 1_000_000, 4096


@dataclass
class Running:
    """A running value: ``kind`` is sum, count, max, min, last (the last one that is not null) or next (the value of the row behind)."""

    name: str
    kind: str
    value: Column | None = None


def segments(df: DataFrame, keys: list[str], order: str, size: int = SEGMENT) -> DataFrame:
    """df with ``_segment``: rows of a timeline by ranges of a numeric ``order`` (equal values stay together), about ``size`` rows each.

    Time between the first and the last hundredth is cut into CELLS cells; neighbouring cells
    make a segment as their counts allow. All rows of a short timeline are segment 0. Rows without
    a time are in the first cell, as they sort first.
    """
    span = df.groupBy(*keys).agg(F.percentile_approx(order, [0.01, 0.99]).alias("_p"), F.count(F.lit(1)).alias("_n"))
    hot = span.where(F.col("_n") > size).select(*(F.col(k).alias(f"_{k}") for k in keys), F.element_at("_p", 1).alias("_lo"), F.element_at("_p", 2).alias("_hi"))
    # At most rows / size timelines are hot; a shuffle by their keys would bring each to one task.
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    placed = df.join(F.broadcast(hot), same(hot), "left").drop(*(f"_{k}" for k in keys))
    share = (F.col(order) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    cell = F.when(F.col("_lo").isNull(), 0).when(F.col(order).isNull(), 1).otherwise(F.coalesce(F.greatest(F.lit(1), F.least(F.lit(CELLS), F.floor(share * (CELLS - 2)) + 2)), F.lit(0))).cast("int")
    placed = placed.withColumn("_cell", cell).drop("_lo", "_hi")
    counts = placed.where("_cell > 0").groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_n")  # CELLS rows a timeline
    of_cell = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_cell").alias("_of"), F.floor(before / size).cast("int").alias("_segment"))
    out = placed.join(of_cell, [*same(of_cell), F.col("_cell") == F.col("_of")], "left").drop("_of", *(f"_{k}" for k in keys))
    return out.withColumn("_segment", F.coalesce("_segment", F.lit(0))).drop("_cell")


def scan(df: DataFrame, keys: list[str], order: list[str], values: list[Running], size: int = SEGMENT) -> DataFrame:
    """df with the running values of each row's timeline, up to and with the row, in the order of ``order`` (the first column numeric, all together unique).

    The same as windows over ``keys``, but no task holds more than a segment. The rows are written
    once with their segments, as they are read twice.
    """
    cut = stored(segments(df, keys, order[0], size))
    place = F.struct(*order)
    local = Window.partitionBy(*keys, "_segment").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    sums, within, joined = [], {}, {}
    for v in values:
        base = F.col(f"_b_{v.name}")
        if v.kind in ("sum", "count"):
            one = F.lit(1) if v.kind == "count" else v.value
            sums.append(F.sum(one).alias(f"_s_{v.name}"))
            within[v.name] = F.sum(one).over(upto)
            joined[v.name] = F.when(base.isNull(), F.col(v.name)).otherwise(base + F.coalesce(F.col(v.name), F.lit(0)))
        elif v.kind in ("max", "min"):
            of = F.max if v.kind == "max" else F.min
            sums.append(of(v.value).alias(f"_s_{v.name}"))
            within[v.name] = of(v.value).over(upto)
            joined[v.name] = (F.greatest if v.kind == "max" else F.least)(base, F.col(v.name))
        elif v.kind == "last":
            sums.append(F.max_by(v.value, F.when(v.value.isNotNull(), place)).alias(f"_s_{v.name}"))
            within[v.name] = F.last(v.value, ignorenulls=True).over(upto)
            joined[v.name] = F.coalesce(F.col(v.name), base)
        elif v.kind == "next":
            sums.append(F.min_by(F.struct(v.value.alias("v")), place).alias(f"_s_{v.name}"))
            within[v.name] = F.lead(F.struct(v.value.alias("v"))).over(local)
            joined[v.name] = F.coalesce(F.col(v.name), base)["v"]
        else:
            raise ValueError(f"no running value of kind {v.kind}")
    whole = cut.groupBy(*keys, "_segment").agg(*sums)
    ahead = Window.partitionBy(*keys).orderBy("_segment")  # a row a segment
    back = ahead.rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    base = whole.select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_segment").alias("_at"),
        *(F.lead(f"_s_{v.name}").over(ahead).alias(f"_b_{v.name}") if v.kind == "next" else F.last(f"_s_{v.name}", ignorenulls=True).over(back).alias(f"_b_{v.name}") if v.kind == "last" else over[v.kind](f"_s_{v.name}").over(back).alias(f"_b_{v.name}") for v in values),
    )
    rows = cut.withColumns(within).join(base, [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_segment") == F.col("_at")], "left")
    return rows.withColumns(joined).drop("_segment", "_at", *(f"_{k}" for k in keys), *(f"_b_{v.name}" for v in values))


def decode_times(frames: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``timeline.decode_times`` of files of any length: file, pos, pts, dts, duration, is_tail."""
    frames = stored(frames.select("file", "pos", "pts"))
    by_pos = scan(frames, ["file"], ["pos", "pts"], [Running("k", "count")], size)
    by_pts = scan(frames, ["file"], ["pts", "pos"], [Running("k", "count"), Running("later", "next", F.col("pts"))], size)
    n = frames.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    tails = n.select("file", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("n") - 3), F.col("n"))).alias("k"), F.lit(True).alias("tail"))
    times = by_pts.select("file", "k", F.col("pts").alias("dts"))
    own = by_pts.select("file", "pos", "pts", (F.col("later") - F.col("pts")).alias("duration"))
    out = by_pos.join(times, ["file", "k"]).join(tails, ["file", "k"], "left").join(own, ["file", "pos", "pts"])  # never by file alone
    return out.select("file", "pos", "pts", "dts", "duration", F.col("tail").isNotNull().alias("is_tail"))


def commit_gate(frames: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``timeline.commit_gate`` of files of any length: the running offset, and the duration up to the last place where it was 0."""
    sums = scan(stored(frames), ["file"], ["pos"], [Running("offset", "sum", F.col("pts") - F.col("dts")), Running("run", "sum", F.coalesce("duration", F.lit(0)))], size)
    gated = scan(sums, ["file"], ["pos"], [Running("committed", "last", F.when(F.col("offset") == 0, F.col("run")))], size)
    return gated.select("file", "pos", "offset", F.coalesce("committed", F.lit(0)).alias("committed"))


def running_lag(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``stats.running_lag`` of streams of any length."""
    step = F.when(F.col("stage") == "begin", 1).when(F.col("stage") == "end", -1).otherwise(0)
    behind = scan(rows.select("stream", "seq", step.cast("long").alias("step")), ["stream"], ["seq"], [Running("behind", "sum", F.col("step"))], size)
    return scan(behind, ["stream"], ["seq"], [Running("worst", "max", F.abs("behind"))], size).select("stream", "seq", "behind", "worst")


def cue_segments(cues: DataFrame, size: int = SEGMENT) -> DataFrame:
    """file, begin, end: the stretches between neighbouring ends of cues (file, begin, end), from 0 on; for the sweep of one long file."""
    ends = cues.where("begin < end").select("file", F.explode(F.array(F.lit(0).cast("long"), F.col("begin").cast("long"), F.col("end").cast("long"))).alias("begin")).distinct()
    return scan(ends, ["file"], ["begin"], [Running("end", "next", F.col("begin"))], size).where("end IS NOT NULL").select("file", "begin", "end")
