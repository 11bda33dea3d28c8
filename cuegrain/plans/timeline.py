"""Timeline operators on the driver's tables: users are files, events are cues, orders are tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as tl
from .registry import millis, query


def cues(t):
    begin = millis("ts")
    return t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("num"), begin.alias("begin"), (begin + F.round(F.col("value") * 1000).cast("long")).alias("end"), F.col("event_type").alias("line"))


CUES = "cues AS (SELECT user_id AS file, event_id AS num, (epoch_us(ts) // 1000) AS begin_, (epoch_us(ts) // 1000) + CAST(round(value * 1000) AS BIGINT) AS end_, event_type AS line FROM events)"
FRAMES = "frames AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, (epoch_us(l_shipdate) // 1000) // 86400000 AS pts FROM lineitem)"


def lines(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t("lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(w).cast("long").alias("pos"), F.floor(millis("l_shipdate") / 86400000).alias("pts"), "l_quantity", "l_returnflag")


@query("cue_sweep", f"""
WITH {CUES}, v AS (SELECT * FROM cues WHERE begin_ < end_),
b AS (SELECT DISTINCT file, t FROM (SELECT file, begin_ AS t FROM v UNION ALL SELECT file, end_ FROM v UNION ALL SELECT file, 0 FROM v)),
s AS (SELECT * FROM (SELECT file, t AS s0, lead(t) OVER (PARTITION BY file ORDER BY t) AS s1 FROM b) WHERE s1 IS NOT NULL)
SELECT s.file, s0 AS "begin", s1 AS "end", coalesce(string_agg(line || chr(10), '' ORDER BY begin_, num), chr(10)) AS text
FROM s LEFT JOIN v ON s.file = v.file AND begin_ <= s0 AND end_ >= s1 GROUP BY s.file, s0, s1
""")
def cue_sweep(t):
    return tl.serialize_cues(cues(t))


@query("cue_clusters", f"""
WITH {CUES}, v AS (SELECT *, max(end_) OVER (PARTITION BY file ORDER BY begin_, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cues WHERE begin_ < end_)
SELECT file, num, begin_ AS "begin", end_ AS "end", CAST(sum(CASE WHEN m IS NULL OR begin_ >= m THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY begin_, num ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM v
""")
def cue_clusters(t):
    return tl.cue_clusters(cues(t))


@query("gap_filler", f"""
WITH {CUES}, g AS (SELECT file, begin_, lag(end_, 1, 0) OVER (PARTITION BY file ORDER BY begin_, end_) AS last FROM cues)
SELECT file, begin_ AS "begin", end_ AS "end", false AS filler FROM cues UNION ALL SELECT file, last, begin_, true FROM g WHERE last <> begin_
""")
def gap_filler(t):
    return tl.fill_gaps(cues(t))


DTS = f"""{FRAMES},
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) AS k, lead(pts) OVER (PARTITION BY file ORDER BY pts, pos) - pts AS duration, count(*) OVER (PARTITION BY file) AS n FROM frames),
s AS (SELECT file, pts AS dts, row_number() OVER (PARTITION BY file ORDER BY pts, pos) AS k FROM frames),
d AS (SELECT file, pos, pts, dts, duration, k > n - 4 AS is_tail FROM r JOIN s USING (file, k))"""


@query("pts_to_dts", f"WITH {DTS} SELECT * FROM d")
def pts_to_dts(t):
    return tl.decode_times(lines(t))


@query("commit_gate", f"""WITH {DTS}, o AS (SELECT file, pos, sum(pts - dts) OVER w AS o, sum(coalesce(duration, 0)) OVER w AS run FROM d WINDOW w AS (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT file, pos, CAST(o AS BIGINT) AS "offset", CAST(coalesce(last_value(CASE WHEN o = 0 THEN run END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS committed FROM o
""")
def commit_gate(t):
    return tl.commit_gate(tl.decode_times(lines(t)))


@query("laced_durations", """
WITH f AS (SELECT user_id AS file, (epoch_us(ts) // 1000) // 3600000 AS tc, event_id AS pos FROM events),
c AS (SELECT file, tc, lead(tc) OVER (PARTITION BY file ORDER BY tc) - tc AS gap FROM (SELECT DISTINCT file, tc FROM f)),
x AS (SELECT *, row_number() OVER (PARTITION BY file, tc ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY file, tc) AS n FROM f)
SELECT x.file, x.tc, pos, gap // n + CASE WHEN i >= n - gap % n THEN 1 ELSE 0 END AS duration FROM x JOIN c ON x.file = c.file AND x.tc = c.tc
""")
def laced_durations(t):
    return tl.laced_durations(t("events").select(F.col("user_id").alias("file"), F.floor(millis("ts") / 3600000).alias("tc"), F.col("event_id").alias("pos")))


@query("index_video_durations", f"""
WITH {FRAMES.replace('(epoch_us(l_shipdate) // 1000) // 86400000 AS pts', "CASE WHEN l_quantity < 15 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS size")},
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) AS rn, count(*) OVER (PARTITION BY file) AS n FROM frames)
SELECT file, pos AS k, size, coalesce(lead(rn) OVER (PARTITION BY file ORDER BY pos), n + 1) - rn AS duration FROM r WHERE size > 0
""")
def index_video_durations(t):
    size = F.when(F.col("l_quantity") < 15, 0).otherwise(F.col("l_quantity").cast("long")).cast("long")
    return tl.index_video_durations(lines(t).select("file", F.col("pos").alias("k"), size.alias("size")))


@query("index_audio_durations", f"""
WITH {FRAMES}, d AS (SELECT file, pos AS k, pts AS ts, lead(pts) OVER (PARTITION BY file ORDER BY pos) - pts AS d FROM frames)
SELECT file, k, ts, coalesce(d, lag(d) OVER (PARTITION BY file ORDER BY k)) AS duration FROM d
""")
def index_audio_durations(t):
    return tl.index_audio_durations(lines(t).select("file", F.col("pos").alias("k"), F.col("pts").alias("ts")))


@query("packet_durations", "SELECT user_id AS file, event_id AS pos, (epoch_us(ts) // 1000) AS dts, coalesce(lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) - (epoch_us(ts) // 1000), 0) AS duration FROM events")
def packet_durations(t):
    return tl.packet_durations(t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), millis("ts").alias("dts")))


@query("sync_end_times", "SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations) WHERE until IS NOT NULL")
def sync_end_times(t):
    return tl.until_next(t("conversations").select("conv_id", "turn"), ["conv_id"], "turn").where("until IS NOT NULL")


@query("file_position_sizes", "WITH f AS (SELECT user_id AS file, event_id AS filepos FROM events) SELECT file, filepos, coalesce(lead(filepos) OVER (PARTITION BY file ORDER BY filepos), 2000000) - filepos AS size FROM f")
def file_position_sizes(t):
    df = tl.until_next(t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("filepos")), ["file"], "filepos", F.lit(2_000_000))
    return df.select("file", "filepos", (F.col("until") - F.col("filepos")).alias("size"))


@query("delay_ffill", "SELECT user_id AS file, event_id, CAST(coalesce(last_value(CASE WHEN event_type = 'error' THEN CAST(round(value) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS delay FROM events")
def delay_ffill(t):
    delay = F.when(F.col("event_type") == "error", F.round("value").cast("long"))
    df = tl.carry(t("events"), ["user_id"], ["ts", "event_id"], delay, "delay")
    return df.select(F.col("user_id").alias("file"), "event_id", F.coalesce("delay", F.lit(0)).cast("long").alias("delay"))


KIND = "CASE WHEN event_type = 'signup' THEN 'I' WHEN event_type IN ('click', 'error') THEN 'P' ELSE 'B' END"


@query("gop_tracking", f"""
WITH k AS (SELECT user_id AS file, event_id AS frame, {KIND} AS kind, ts FROM events)
SELECT file, frame, kind, last_value(CASE WHEN kind = 'I' THEN frame END IGNORE NULLS) OVER w AS gop, last_value(CASE WHEN kind <> 'B' THEN frame END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ts, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS needs
FROM k WINDOW w AS (PARTITION BY file ORDER BY ts, frame ROWS UNBOUNDED PRECEDING)
""")
def gop_tracking(t):
    from pyspark.sql import Window

    df = t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("frame"), F.expr(KIND).alias("kind"), "ts")
    w = Window.partitionBy("file").orderBy("ts", "frame")
    df = tl.carry(df, ["file"], ["ts", "frame"], F.when(F.col("kind") == "I", F.col("frame")), "gop")
    needs = F.last(F.when(F.col("kind") != "B", F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select("file", "frame", "kind", "gop", needs.alias("needs"))


@query("span_offsets", """
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations)
SELECT conv_id, turn, i, CAST(coalesce(sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM w
""")
def span_offsets(t):
    from pyspark.sql import Window

    df = t("conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    w = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("i"), F.coalesce(F.sum(F.length("word")).over(w), F.lit(0)).cast("long").alias("offset"))


@query("first_and_last_overrides", """
SELECT DISTINCT user_id AS file, first_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS align, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS colour
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def first_and_last_overrides(t):
    at = F.struct("ts", "event_id")
    pick = lambda f, kind: f(F.when(F.col("event_type") == kind, F.col("value")), F.when((F.col("event_type") == kind) & F.col("value").isNotNull(), at))
    return t("events").groupBy(F.col("user_id").alias("file")).agg(pick(F.min_by, "click").alias("align"), pick(F.max_by, "view").alias("colour"))


@query("pen_positions", """
WITH l AS (SELECT user_id AS file, event_id AS n, event_type AS align, value AS height, CAST(floor(value / 100) AS BIGINT) AS layer, ts FROM events),
i AS (SELECT *, lag(layer) OVER (PARTITION BY file ORDER BY ts, n) AS before FROM l),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> layer THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ts, n ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT file, n, CAST(island AS BIGINT) AS island, round(coalesce(sum(height) OVER (PARTITION BY file, island, align ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS pen FROM s
""")
def pen_positions(t):
    from pyspark.sql import Window

    df = t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), F.col("event_type").alias("align"), F.col("value").alias("height"), F.floor(F.col("value") / 100).alias("layer"), "ts")
    df = df.withColumn("before", F.lag("layer").over(Window.partitionBy("file").orderBy("ts", "n")))
    df = tl.islands(df, ["file"], ["ts", "n"], F.col("before").isNull() | (F.col("before") != F.col("layer")))
    w = Window.partitionBy("file", "island", "align").orderBy("ts", "n").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("file", "n", "island", F.round(F.coalesce(F.sum("height").over(w), F.lit(0.0)), 4).alias("pen"))


@query("header_offset", """
WITH i AS (SELECT o_custkey AS stream, o_orderdate AS tm, o_orderkey AS pos FROM orders),
p AS (SELECT stream, min(tm) AS tm, arg_min(pos, (tm, pos)) AS pos FROM i GROUP BY stream)
SELECT p.stream, p.pos - min(i.pos) AS "offset" FROM p JOIN i ON i.stream = p.stream AND i.tm = p.tm GROUP BY p.stream, p.pos
""")
def header_offset(t):
    index = t("orders").select(F.col("o_custkey").alias("stream"), millis("o_orderdate").alias("at"), F.col("o_orderkey").alias("pos"))
    first = index.groupBy("stream").agg(F.min(F.struct("at", "pos")).alias("f")).select("stream", "f.at", F.col("f.pos").alias("own"))
    return index.join(first, ["stream", "at"]).groupBy("stream", "own").agg((F.first("own") - F.min("pos")).alias("offset")).select("stream", "offset")


@query("resync_forward", """
WITH i AS (SELECT user_id AS file, event_id AS pos FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id AS file, event_id AS at FROM events WHERE event_type = 'error')
SELECT q.file, q.at, min(pos) AS next_pos FROM q LEFT JOIN i ON i.file = q.file AND i.pos > q.at GROUP BY q.file, q.at
""")
def resync_forward(t):
    e = t("events")
    index = e.where("event_type = 'purchase'").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"))
    return tl.next_at_or_after(e.where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("at")), index, "file", "at", "pos")


@query("interleave_tracks", "SELECT user_id AS track, (epoch_us(ts) // 1000) AS dts, event_id AS sample, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), user_id, event_id) AS place FROM events")
def interleave_tracks(t):
    return tl.release_order(t("events").select(F.col("user_id").alias("track"), millis("ts").alias("dts"), F.col("event_id").alias("sample")))


@query("cluster_partitions", "SELECT user_id AS track, (epoch_us(ts) // 1000) // 5000 AS cluster, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def cluster_partitions(t):
    return t("events").groupBy(F.col("user_id").alias("track"), F.floor(millis("ts") / 5000).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("sample_table", """
WITH d AS (SELECT user_id AS track, event_id AS sample, (epoch_us(ts) // 1000) AS dts, coalesce(lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) - (epoch_us(ts) // 1000), 0) AS duration FROM events)
SELECT track, sample, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY track ORDER BY dts, sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d
""")
def sample_table(t):
    from pyspark.sql import Window

    df = tl.packet_durations(t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), millis("ts").alias("dts")))
    w = Window.partitionBy("file").orderBy("dts", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return df.select(F.col("file").alias("track"), F.col("pos").alias("sample"), "duration", F.coalesce(F.sum("duration").over(w), F.lit(0)).alias("start"))
