"""Matroska files written from events and read back: a movie for each eight users, a track for each kind of event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from ..sinks.matroska import encoder_tracks, export_matroska
from ..sources.containers import read_matroska
from .registry import query

KINDS = ("click", "view", "purchase", "signup", "error")
NUMBER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KINDS, 1)) + " END"


def frames(t) -> DataFrame:
    """Sixteen events a second; the data are the event's number as text."""
    return t("events").select(F.expr("CAST(user_id div 8 AS string)").alias("file"), F.expr(NUMBER).cast("long").alias("track"), (F.col("event_id") * 16).alias("dts"), (F.col("event_id") * 16 + F.col("event_id") % 3).alias("pts"), (F.col("event_id") % 5 == 0).alias("keyframe"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("data"))


def tracks(t) -> DataFrame:
    """The tracks of each movie that has frames: pictures, sound, and others as text; those of the kind error are not given."""
    own = t("events").where(f"{NUMBER} < 5").select(F.expr("CAST(user_id div 8 AS string)").alias("file"), F.expr(NUMBER).cast("long").alias("number")).distinct()
    kind = F.when(F.col("number") == 1, 1).when(F.col("number") == 2, 2).otherwise(17)
    return own.select("file", "number", kind.alias("type"), F.concat(F.lit("X_"), F.col("number").cast("string")).alias("codec_id"), F.when(F.col("number") == 2, F.encode("file", "UTF-8")).alias("codec_private"), F.lit(320).alias("width"), F.lit(240).alias("height"), F.lit(8000.0).alias("rate"), F.lit(2).alias("channels"))


def _exported(t, table: str) -> DataFrame:
    folder = f"{new_folder(t('events').sparkSession)}/mkv"
    export_matroska(frames(t), tracks(t), folder)
    return read_matroska(t("events").sparkSession, folder, table).withColumn("file", F.regexp_extract("path", r"(\d+)\.mkv$", 1).cast("long"))


@query("exported_frames", f"SELECT user_id // 8 AS file, {NUMBER} AS track, event_id * 16 + event_id % 3 AS tc, event_id % 5 = 0 AS keyframe, length(event_id::VARCHAR) AS size FROM events WHERE event_type <> 'error'", long="track size")
def exported_frames(t):
    return _exported(t, "frames").select("file", "track", "tc", "keyframe", "size")


@query("exported_tracks", f"SELECT DISTINCT user_id // 8 AS file, {NUMBER} AS number, CASE {NUMBER} WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 17 END AS type, 'X_' || {NUMBER} AS codec_id, CASE WHEN {NUMBER} = 2 THEN (user_id // 8)::VARCHAR END AS private FROM events WHERE event_type <> 'error'", long="number type")
def exported_tracks(t):
    return _exported(t, "tracks").select("file", "number", "type", "codec_id", F.decode("codec_private", "UTF-8").alias("private"))


@query("exported_places", f"""
WITH f AS (SELECT user_id // 8 AS file, {NUMBER} AS track, event_id * 16 AS dts, event_id * 16 + event_id % 3 AS pts, length(event_id::VARCHAR) AS size FROM events WHERE event_type <> 'error'),
c AS (SELECT file, dts // 5000 AS slot, 29 + sum(13 + size) AS bytes FROM f GROUP BY ALL),
b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
o AS (SELECT f.*, before + 42 + coalesce(sum(13 + size) OVER (PARTITION BY f.file, slot ORDER BY dts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM f JOIN b ON b.file = f.file AND slot = dts // 5000)
SELECT file, track, pts AS tc, spot - min(spot) OVER (PARTITION BY file) AS place FROM o""", long="track place")
def exported_places(t):
    """Where each frame's bytes stand, counted from the file's first frame: frames are interleaved by time, clusters last five seconds."""
    from pyspark.sql import Window

    rows = _exported(t, "frames")
    return rows.select("file", "track", "tc", (F.col("offset") - F.min("offset").over(Window.partitionBy("file"))).alias("place"))


@query("encoder_tracks", """
WITH s AS (SELECT o_custkey AS file, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'soun' WHEN 3 THEN 'text' ELSE 'vide' END AS media, CASE WHEN o_orderkey % 3 = 0 THEN 'V_MPEG4/ISO/AVC' END AS known, o_orderkey % 5 = 0 AS bitmap FROM orders),
k AS (SELECT * FROM s WHERE media = 'soun' OR (media = 'vide' AND (known IS NOT NULL OR bitmap)))
SELECT file, row_number() OVER (PARTITION BY file ORDER BY ord) AS number, CASE media WHEN 'vide' THEN 1 ELSE 2 END AS type, coalesce(known, CASE media WHEN 'vide' THEN 'V_MS/VFW/FOURCC' ELSE '' END) AS codec_id,
  CASE WHEN media = 'vide' AND known IS NULL THEN ord::VARCHAR END AS private, CASE media WHEN 'vide' THEN 320 END AS width FROM k""", long="number", int_="type width")
def encoder_tracks_(t):
    """Streams that are encoded anew: one code has an identifier, the other has none."""
    from ..functions.codecs import fourcc

    o = F.col("o_orderkey")
    media = F.when(o % 4 == 0, "soun").when(o % 4 == 3, "text").otherwise("vide")
    rows = t("orders").select(F.col("o_custkey").alias("file"), o.alias("ord"), media.alias("media"), F.when(o % 3 == 0, F.lit(fourcc("avc1"))).otherwise(F.lit(fourcc("????"))).alias("fourcc"), F.when(o % 5 == 0, F.encode(o.cast("string"), "UTF-8")).alias("private"), F.lit(320).alias("width"), F.lit(240).alias("height"), F.lit(8000.0).alias("rate"), F.lit(2).alias("channels"))
    out = encoder_tracks(rows, "ord")
    return out.select("file", "number", "type", "codec_id", F.decode("codec_private", "UTF-8").alias("private"), "width")
