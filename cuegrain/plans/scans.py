"""Running values of one long timeline: all rows of a table are one file, which is cut into segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from .registry import millis, query

#: Rows of a segment here.
SIZE = 500

_ORDER = "OVER (ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING)"


def one_file(t):
    return t("events").select(F.lit(1).cast("long").alias("file"), millis("ts").alias("at"), "event_id", "event_type", F.round("value").cast("long").alias("value"))


@query("long_file_values", f"""
WITH e AS (SELECT (epoch_us(ts) // 1000) AS tm, event_id, event_type, CAST(round(value) AS BIGINT) AS value FROM events)
SELECT event_id, sum(value) {_ORDER} AS total, count(*) {_ORDER} AS place, max(value) {_ORDER} AS most, min(value) {_ORDER} AS least,
  last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) {_ORDER} AS delay, lead(tm) OVER (ORDER BY tm, event_id) AS later FROM e""", long="total")
def long_file_values(t):
    """Sums, counts, extremes, carried and next values, as windows over the whole file would give them."""
    value = F.col("value")
    running = [scan.Running("total", "sum", value), scan.Running("place", "count"), scan.Running("most", "max", value), scan.Running("least", "min", value), scan.Running("delay", "last", F.when(F.col("event_type") == "error", value)), scan.Running("later", "next", F.col("at"))]
    return scan.scan(one_file(t), ["file"], ["at", "event_id"], running, SIZE).select("event_id", "total", "place", "most", "least", "delay", "later")


_LONG = """
f AS (SELECT event_id AS pos, event_id * 40 + (event_id * 7) % 11 * 35 AS pts FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY pos) AS k, lead(pts) OVER (ORDER BY pts, pos) - pts AS duration, count(*) OVER () AS n FROM f),
s AS (SELECT pts AS dts, row_number() OVER (ORDER BY pts, pos) AS k FROM f),
d AS (SELECT pos, pts, dts, duration, k > n - 4 AS is_tail FROM r JOIN s USING (k))"""


def _frames(t):
    e = F.col("event_id")
    return t("events").select(F.lit(1).cast("long").alias("file"), e.alias("pos"), (e * 40 + (e * 7) % 11 * 35).alias("pts"))


@query("long_file_times", f"WITH {_LONG} SELECT pos, pts, dts, duration, is_tail FROM d")
def long_file_times(t):
    """Frames of one long file put in the order in which they are decoded."""
    return scan.decode_times(_frames(t), SIZE).select("pos", "pts", "dts", "duration", "is_tail")


@query("long_file_gate", f"""WITH {_LONG}, o AS (SELECT pos, sum(pts - dts) OVER w AS o, sum(coalesce(duration, 0)) OVER w AS run FROM d WINDOW w AS (ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT pos, CAST(o AS BIGINT) AS "offset", CAST(coalesce(last_value(CASE WHEN o = 0 THEN run END IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS committed FROM o""")
def long_file_gate(t):
    """What of one long file may be committed behind each frame."""
    return scan.commit_gate(scan.decode_times(_frames(t), SIZE), SIZE).select("pos", "offset", "committed")


@query("long_file_lag", """
WITH s AS (SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS step FROM events),
b AS (SELECT seq, CAST(sum(step) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS behind FROM s)
SELECT seq, behind, max(abs(behind)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS worst FROM b""", long="worst")
def long_file_lag(t):
    """How far decoding has fallen behind in one long stream."""
    stage = F.when(F.col("event_type").isin("click", "view"), "begin").when(F.col("event_type") == "error", "end")
    return scan.running_lag(t("events").select(F.lit(1).alias("stream"), F.col("event_id").alias("seq"), stage.alias("stage")), SIZE).select("seq", "behind", "worst")


@query("long_file_segments", """
WITH c AS (SELECT (epoch_us(ts) // 1000) AS b, (epoch_us(ts) // 1000) + CAST(round(value * 1000) AS BIGINT) AS e FROM events),
t AS (SELECT DISTINCT t FROM (SELECT b AS t FROM c WHERE b < e UNION ALL SELECT e FROM c WHERE b < e UNION ALL SELECT 0 FROM c WHERE b < e))
SELECT t AS "begin", later AS "end" FROM (SELECT t, lead(t) OVER (ORDER BY t) AS later FROM t) WHERE later IS NOT NULL""")
def long_file_segments(t):
    """The stretches between neighbouring ends of the cues of one long file."""
    cues = t("events").select(F.lit(1).alias("file"), millis("ts").alias("begin"), (millis("ts") + F.round(F.col("value") * 1000).cast("long")).alias("end"))
    return scan.cue_segments(cues, SIZE).select("begin", "end")
