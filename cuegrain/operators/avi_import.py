"""Import of AVI-like files: which files and streams are taken, and samples from the index or from the packets.

Tables are those of ``sources.avi``: streams and entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.avi import read_avi
from ..sources.containers import REFUSED

#: Streams with which a file is refused.
MOST_STREAMS = 16


def _refused(code: Column | str) -> Column:
    return F.lower(code).isin(*REFUSED)


def accepted(streams: DataFrame) -> DataFrame:
    """Video and sound streams of the files that are imported: none of whose video codes other software plays, and with fewer than MOST_STREAMS streams."""
    bad = streams.where((F.col("n_streams") >= MOST_STREAMS) | ((F.col("kind") == "vids") & (_refused("handler") | _refused("compression")))).select("file").distinct()
    return streams.where(F.col("kind").isin("vids", "auds")).join(bad, "file", "left_anti")


def accepted_entries(entries: DataFrame) -> DataFrame:
    """Entries of the streams that ``accepted`` takes; each row tells its file's codes and number of streams, so that nothing is joined."""
    return entries.where(F.col("kind").isin("vids", "auds") & (F.col("n_streams") < MOST_STREAMS) & ~F.exists("codes", _refused))


def _timed(entries: DataFrame) -> DataFrame:
    """Entries numbered (k of n) and with their time (ts, in units of the stream's rate): what came before, in entries or, where samples have a fixed size, in samples."""
    own = Window.partitionBy("file", "stream")
    w = own.orderBy("place")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = entries.withColumns({"k": (F.row_number().over(w) - 1).cast("long"), "n": F.count(F.lit(1)).over(own), "_before": before})
    return timed.withColumn("ts", F.when(F.col("sample_size") > 0, F.expr("_before div nullif(sample_size, 0)")).otherwise(F.col("k"))).drop("_before")


def header_offset() -> Column:
    """What is added to places of a file's index, of timed entries. The first packet's real place tells, less that of the entry of its time."""
    at = F.when((F.col("ts") == 0) & (F.col("stream") == F.col("first_stream")), F.struct("place", "pos"))
    return F.col("first_pos") - F.min(at).over(Window.partitionBy("file"))["pos"]


def samples(entries: DataFrame) -> DataFrame:
    """Samples (file, stream, k, offset, size, keyframe, samples, duration) of accepted entries.

    Empty entries are no samples: those of an index that stand behind a picture make it last longer. A
    sound packet of varying size lasts until the next one, the last of an index as long as the one
    before it, the last without an index not at all; nor is it known there which pictures are key frames.
    """
    w = Window.partitionBy("file", "stream").orderBy("place")
    gap = F.lead("ts").over(w) - F.col("ts")
    # a file's rows lie together, which serves all windows
    rows = _timed(entries.repartition("file")).withColumn("gap", gap).withColumns({"gap": F.coalesce("gap", F.lag("gap").over(w)), "base": header_offset()})
    later = F.coalesce(F.lead("ts").over(w) - F.col("ts"), F.lit(0))
    rows = rows.where("size > 0 AND (base IS NOT NULL OR NOT indexed)").withColumns({"stays": F.coalesce(F.lead("k").over(w), F.col("n")) - F.col("k"), "later": later})
    by_index = lambda yes, no: F.when(F.col("indexed"), yes).otherwise(no)
    fixed = (F.col("kind") == "auds") & (F.col("sample_size") > 0)
    n = F.expr("size div nullif(coalesce(nullif(block_align, 0), sample_size), 0)")
    lasts = F.when(F.col("kind") == "vids", by_index(F.col("stays"), F.lit(1)) * F.col("scale")).when(fixed, F.lit(1)).otherwise(by_index(F.col("gap"), F.col("later")) * F.col("scale"))
    key = by_index(F.col("keyframe"), F.when(F.col("kind") == "auds", F.lit(True)))
    offset = by_index(F.col("pos") + F.col("base"), F.col("pos"))
    return rows.select("file", "stream", "k", offset.alias("offset"), "size", key.alias("keyframe"), F.when(fixed, n).otherwise(F.lit(1)).cast("long").alias("samples"), lasts.cast("long").alias("duration"))


def import_avi(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Samples of all accepted files below a folder, by the index where there is one. With ``folders`` tasks list the files, all of which are in folders below."""
    entries = accepted_entries(read_avi(spark, path, "entries", folders=folders))
    return samples(entries.drop("codes", "n_streams"))


def movie_ends(streams: DataFrame, samples: DataFrame, movie_scale: int = 600) -> DataFrame:
    """file, ends: the end of the longest track in units of the movie."""
    tracks = samples.groupBy("file", "stream").agg(F.sum(F.col("duration") * F.col("samples")).alias("ticks")).join(streams, ["file", "stream"])
    return tracks.groupBy("file").agg(F.max(F.expr(f"(ticks + start * scale) * {movie_scale} div rate")).alias("ends"))
