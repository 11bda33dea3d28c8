"""Timeline operators: interval sweep, durations from neighbours, re-ordering, carries and gates.

All of them take the key columns of a timeline (a file, a track) and plan as equi-joins and
windows on those keys, so that timelines are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_cues(cues: DataFrame) -> DataFrame:
    """Cues (file, num, begin, end, line) that end after they begin; each line closed by a line feed."""
    line = F.coalesce("line", F.lit(""))
    closed = F.when(line.endswith("\n"), line).otherwise(F.concat(line, F.lit("\n")))
    return cues.where("begin < end").select("file", "num", "begin", "end", closed.alias("line"))


def serialize_cues(cues: DataFrame, bucket: int = 60_000) -> DataFrame:
    """file, begin, end, text: overlapping cues cut into disjoint packets with all lines on screen.

    Lines are in the order of (begin, num). Where nothing is on screen, from 0 to the last end, the
    text is one line feed. Cues meet segments by equality of (file, bucket of ticks): a cue lies in
    the bucket of every segment that begins while it is active, so the join is a hash or merge
    join, however long a file is.
    """
    cues = valid_cues(cues)
    ends = cues.select("file", F.explode(F.array(F.lit(0).cast("long"), F.col("begin").cast("long"), F.col("end").cast("long"))).alias("begin")).distinct()
    w = Window.partitionBy("file").orderBy("begin")
    segments = ends.withColumn("end", F.lead("begin").over(w)).where("end IS NOT NULL").withColumn("bucket", F.expr(f"begin div {bucket}"))
    dealt = cues.select("file", "num", "line", F.col("begin").alias("from"), F.col("end").alias("to"), F.explode(F.sequence(F.expr(f"begin div {bucket}"), F.expr(f"(end - 1) div {bucket}"))).alias("bucket"))
    met = segments.join(dealt, ["file", "bucket"], "left").where("from IS NULL OR (from <= begin AND to >= end)")
    # A segment whose bucket holds only other cues has lost its row: it is a gap.
    active = met.where("from IS NOT NULL").groupBy("file", "begin", "end").agg(F.array_sort(F.collect_list(F.struct("from", "num", "line"))).alias("on"))
    text = F.array_join(F.transform("on", lambda x: x["line"]), "")
    return segments.select("file", "begin", "end").join(active, ["file", "begin", "end"], "left").select("file", "begin", "end", F.coalesce(text, F.lit("\n")).alias("text"))


def cue_clusters(cues: DataFrame) -> DataFrame:
    """file, num, begin, end, cluster: cues in one cluster overlap in a chain; a later begin at or after the running end opens the next."""
    w = Window.partitionBy("file").orderBy("begin", "num")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cues.where("begin < end").withColumn("opens", (before.isNull() | (F.col("begin") >= before)).cast("long")).select("file", "num", "begin", "end", F.sum("opens").over(w).alias("cluster"))


def fill_gaps(spans: DataFrame) -> DataFrame:
    """file, begin, end, filler: the spans, and a row for every gap between one's end and the next begin."""
    w = Window.partitionBy("file").orderBy("begin", "end")
    gaps = spans.withColumn("last", F.lag("end", 1, 0).over(w)).where("last <> begin").select("file", F.col("last").alias("begin"), F.col("begin").alias("end"), F.lit(True).alias("filler"))
    return spans.select("file", "begin", "end", F.lit(False).alias("filler")).unionByName(gaps)


def decode_times(frames: DataFrame) -> DataFrame:
    """frames (file, pos, pts) with dts (the pos-th smallest pts), duration (to the next pts; null for the last) and is_tail."""
    by_pos, by_pts = Window.partitionBy("file").orderBy("pos"), Window.partitionBy("file").orderBy("pts", "pos")
    ranked = frames.select("file", "pos", "pts", F.row_number().over(by_pos).alias("k"), (F.lead("pts").over(by_pts) - F.col("pts")).alias("duration"), F.count(F.lit(1)).over(Window.partitionBy("file")).alias("n"))
    sorted_ = frames.select("file", F.col("pts").alias("dts"), F.row_number().over(by_pts).alias("k"))
    return ranked.join(sorted_, ["file", "k"]).select("file", "pos", "pts", "dts", "duration", (F.col("k") > F.col("n") - 4).alias("is_tail"))


def laced_durations(frames: DataFrame) -> DataFrame:
    """frames (file, tc, pos) with duration: the gap to the next distinct tc shared out, what is left over to the last frames; null for the last tc."""
    codes = frames.select("file", "tc").distinct()
    codes = codes.withColumn("gap", F.lead("tc").over(Window.partitionBy("file").orderBy("tc")) - F.col("tc"))
    w = Window.partitionBy("file", "tc")
    df = frames.withColumns({"i": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count(F.lit(1)).over(w)}).join(codes, ["file", "tc"])
    return df.select("file", "tc", "pos", (F.expr("gap div n") + F.when(F.col("i") >= F.col("n") - F.col("gap") % F.col("n"), 1).otherwise(0)).alias("duration"))


def index_video_durations(entries: DataFrame, base: int = 1) -> DataFrame:
    """Entries (file, k, size) with a size, with duration = base * (1 + empty entries that follow)."""
    w = Window.partitionBy("file").orderBy("k")
    df = entries.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file")))
    df = df.where("size > 0").withColumn("next", F.coalesce(F.lead("rn").over(w), F.col("n") + 1))
    return df.select("file", "k", "size", ((F.col("next") - F.col("rn")) * base).cast("long").alias("duration"))


def index_audio_durations(entries: DataFrame) -> DataFrame:
    """Entries (file, k, ts) with duration: to the next ts; the last one repeats that of the entry before."""
    w = Window.partitionBy("file").orderBy("k")
    df = entries.withColumn("d", F.lead("ts").over(w) - F.col("ts"))
    return df.select("file", "k", "ts", F.coalesce("d", F.lag("d").over(w)).alias("duration"))


def packet_durations(packets: DataFrame) -> DataFrame:
    """Packets (file, pos, dts) with duration to the next packet; 0 at the end of the stream."""
    w = Window.partitionBy("file").orderBy("dts", "pos")
    return packets.select("file", "pos", "dts", F.coalesce(F.lead("dts").over(w) - F.col("dts"), F.lit(0)).alias("duration"))


def commit_gate(frames: DataFrame) -> DataFrame:
    """Frames (file, pos, pts, dts, duration) with the running offset and the duration that may be committed: all up to the last place where the offset was 0."""
    w = Window.partitionBy("file").orderBy("pos")
    df = frames.withColumns({"offset": F.sum(F.col("pts") - F.col("dts")).over(w), "run": F.sum(F.coalesce("duration", F.lit(0))).over(w)})
    return df.select("file", "pos", "offset", F.coalesce(F.last(F.when(F.col("offset") == 0, F.col("run")), ignorenulls=True).over(w), F.lit(0)).alias("committed"))


def until_next(df: DataFrame, keys: list[str], at: str, default: Column | None = None) -> DataFrame:
    """df with until: the next value of ``at`` on the timeline, else ``default``."""
    return df.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(*keys).orderBy(at)), default if default is not None else F.lit(None)))


def carry(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last known ``value`` up to each row, as ``name``."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def next_at_or_after(left: DataFrame, index: DataFrame, key: str, at: str, pos: str, strict: bool = True) -> DataFrame:
    """left (key, at) with the smallest ``pos`` of index (key, pos) behind ``at``: a forward as-of join by one sort of both sides."""
    both = left.withColumns({"_q": F.lit(1 if strict else 0), "_at": F.col(at), "_pos": F.lit(None).cast("long")}).unionByName(index.select(key, F.col(pos).cast("long").alias("_pos"), F.col(pos).cast("long").alias("_at")).withColumn("_q", F.lit(0 if strict else 1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_q").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("next_pos", F.first("_pos", ignorenulls=True).over(w)).where(F.col("_pos").isNull()).drop("_q", "_at", "_pos")


def release_order(samples: DataFrame, rows: int = 100_000) -> DataFrame:
    """Samples (track, dts) with their place when tracks are interleaved: smallest time first, lower track first among equals.

    The place is counted by range: a row's place in its bucket of time behind all rows of earlier
    buckets, so no task sorts all rows. Buckets are as wide as ``rows`` rows take on average.
    """
    span = samples.agg(F.greatest(F.lit(1), F.floor((F.max("dts") - F.min("dts")) / F.ceil(F.count(F.lit(1)) / rows)).cast("long"))).scalar()
    df = samples.withColumn("b", F.floor(F.col("dts") / span))
    counts = df.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(before.select("b", "before"), "b").select("track", "dts", "sample", (F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("dts", "track", "sample"))).alias("place"))


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """df with the running number of rows where ``starts`` holds."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def scan_turns(packets: DataFrame, file: str, order: str, first: int = 300, idle: int = 1000) -> DataFrame:
    """packets with turn: the scan that reads each one, the first of ``first`` packets, those after it of ``idle``; 0 packets: one scan reads all."""
    n = F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1
    turn = F.when(n < first, 0).otherwise(F.floor((n - first) / idle) + 1) if first and idle else F.lit(0)
    return packets.withColumn("turn", turn.cast("int"))


def before_margin(packets: DataFrame, file: str, available: str, total: str, least: int = 0, factor: int = 8) -> DataFrame:
    """packets (pos, size) that are read while a file still arrives.

    Reading ends behind the first packet, ``least`` at the earliest, that leaves less than
    ``factor`` times the largest packet so far; a file that is complete is read to its end.
    """
    w = Window.partitionBy(file).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, 0)
    margin = F.col(available) - F.col("pos") - F.col("size")
    near = (F.col(available) > 0) & (F.col(available) < F.col(total)) & (F.count(F.lit(1)).over(w) >= least) & (margin < F.max("size").over(w) * factor)
    out = packets.withColumn("_near", near.cast("int"))
    before = Window.partitionBy(file).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("_stop", F.coalesce(F.max("_near").over(before), F.lit(0))).where("_stop = 0").drop("_near", "_stop")


def placeholders(files: DataFrame) -> DataFrame:
    """file, start, duration of the empty track that stands for what isn't loaded yet (file, loaded, duration)."""
    return files.where("loaded < duration").select("file", F.col("loaded").alias("start"), (F.col("duration") - F.col("loaded")).alias("duration"))


def track_table(tracks: DataFrame, file: str, order: str) -> DataFrame:
    """tracks with number (1 to n in their file) and uid, the same in every run and not 0."""
    number = F.row_number().over(Window.partitionBy(file).orderBy(order))
    out = tracks.withColumn("number", number)
    uid = F.abs(F.xxhash64(file, "number") % ((1 << 62) - 1)) + 1
    return out.withColumn("uid", uid)


def cue_samples(packets: DataFrame) -> DataFrame:
    """file, number, start, duration, data of a text track: each packet (file, begin, end, text) is a sample, its length in two bytes before the text; a text that needs more is an error."""
    raw = F.encode("text", "UTF-8")
    n = F.octet_length(raw)
    size = F.unhex(F.lpad(F.hex(F.when(n > 65535, F.raise_error(F.concat(F.lit("a text of more than 65535 bytes in "), F.col("file").cast("string")))).otherwise(n)), 4, "0"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("begin", "end"))
    return packets.select("file", number.alias("number"), F.col("begin").alias("start"), (F.col("end") - F.col("begin")).alias("duration"), F.concat(size, raw).alias("data"))


def restored_packets(packets: DataFrame, header: Column) -> DataFrame:
    """packets (file, n, data, frames) with the bytes that were stripped from the head of each: data, size, and offset in the new stream; frames go along."""
    out = packets.withColumn("data", F.concat(header, "data")).withColumn("size", F.octet_length("data").cast("long"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
