"""Import of AVI files: the queries write such files from lineitem, one a supplier, and read them back by ranges.

Of each supplier's lines, in order, odd line numbers are pictures (stream 0) and even ones sound
(stream 1). Suppliers whose number divides by 5 get no index, those by 7 a refused code; places in
the index count from the packets on for even numbers, from the file's beginning for odd ones.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import avi_import
from ..session import new_folder
from ..sinks.files import write_files
from ..sources.avi import read_avi, stream_avi
from .registry import query
from .streams import drained


def le32(n: Column) -> Column:
    """A number as four bytes, the lowest first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", 4 + len(body)) + kind + body


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body


def headers(handler: bytes) -> bytes:
    """The header list of a picture stream of 25 a second and a sound stream with samples of 4 bytes."""
    strh = lambda kind, code, scale, rate, sample: _chunk(b"strh", kind + code + struct.pack("<3I7I", 0, 0, 0, scale, rate, 0, 0, 0, 0, sample) + bytes(8))
    video = strh(b"vids", handler, 40, 1000, 0) + _chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, 320, 240, 1, 24, handler, 0, 0, 0, 0, 0))
    sound = strh(b"auds", bytes(4), 1, 8000, 4) + _chunk(b"strf", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16))
    return _list(b"hdrl", _chunk(b"avih", bytes(56)) + _list(b"strl", video) + _list(b"strl", sound))


PLAIN, REFUSED = headers(b"DIVX"), headers(b"MJPG")
#: Place of the first packet.
BEGIN = 12 + len(PLAIN) + 12


def packets(t) -> DataFrame:
    """file, n, stream, size, key, data of each packet."""
    size = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 4).when(F.col("l_quantity") < 15, 0).otherwise(F.col("l_quantity")).cast("long")
    rows = t("lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), ((F.col("l_linenumber") + 1) % 2).alias("stream"), size.alias("size"), (F.col("l_linenumber") % 3 == 1).alias("key"))
    return rows.withColumn("data", F.encode(F.expr("repeat('x', CAST(size AS INT))"), "UTF-8"))


def files(t, share: float = 1.0) -> DataFrame:
    """name, content of each supplier's file; with ``share`` only so much of the files whose number divides by 3 has arrived."""
    tag = F.concat(F.lit("0"), F.col("stream").cast("string"), F.when(F.col("stream") == 0, "dc").otherwise("wb"))
    packet = F.concat(F.encode(tag, "UTF-8"), le32(F.col("size")), F.col("data"), F.when(F.col("size") % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    before = Window.partitionBy("file").orderBy("n", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = packets(t).withColumn("packet", packet).withColumn("at", F.coalesce(F.sum(F.length("packet")).over(before), F.lit(0)))
    base = F.when(F.col("file") % 2 == 0, F.lit(4)).otherwise(F.lit(BEGIN))
    entry = F.concat(F.encode(tag, "UTF-8"), F.when(F.col("key"), F.lit(b"\x10\0\0\0")).otherwise(F.lit(bytes(4))), le32(F.col("at") + base), le32(F.col("size")))
    # places grow, so they alone order a file's packets
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("packet").alias("packet"), F.hex(entry).alias("entry")))).alias("all"))
    joined = lambda name: F.unhex(F.concat_ws("", F.transform("all", lambda x: x[name])))
    df = whole.withColumns({"movi": joined("packet"), "idx": joined("entry")})
    movi = F.concat(F.lit(b"LIST"), le32(F.length("movi") + 4), F.lit(b"movi"), F.col("movi"))
    idx = F.when(F.col("file") % 5 == 0, F.lit(b"")).otherwise(F.concat(F.lit(b"idx1"), le32(F.length("idx")), F.col("idx")))
    body = F.concat(F.lit(b"AVI "), F.when(F.col("file") % 7 == 0, F.lit(REFUSED)).otherwise(F.lit(PLAIN)), movi, idx)
    content = F.concat(F.lit(b"RIFF"), le32(F.length("body")), F.col("body"))
    out = df.withColumn("body", body).withColumn("content", content)
    arrived = F.when(F.col("file") % 3 == 0, F.floor(F.length("content") * share).cast("int")).otherwise(F.length("content"))
    return out.select(F.format_string("%08d.avi", "file").alias("name"), F.col("content").substr(F.lit(1), arrived).alias("content"))


def _written(t, share: float = 1.0, apart: bool = False) -> str:
    rows = files(t, share)
    folder = f"{new_folder(rows.sparkSession)}/avi"
    write_files(rows, folder, apart)
    return folder


def _number() -> Column:
    return F.regexp_extract("file", r"(\d+)\.avi$", 1).cast("long").alias("file")


PACKETS = f"""p AS (
  SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS n, CAST((l_linenumber + 1) % 2 AS INTEGER) AS stream, l_linenumber % 3 = 1 AS key,
    CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 4 WHEN l_quantity < 15 THEN 0 ELSE l_quantity END AS BIGINT) AS size FROM lineitem),
q AS (
  SELECT *, CAST({BEGIN} + 8 + coalesce(sum(8 + size + size % 2) OVER (PARTITION BY file ORDER BY n, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
    row_number() OVER (PARTITION BY file, stream ORDER BY n, size) - 1 AS k, count(*) OVER (PARTITION BY file, stream) AS m, row_number() OVER (PARTITION BY file ORDER BY n, size) - 1 AS place FROM p)"""


@query("avi_streams", """
SELECT DISTINCT l_suppkey AS file, CAST(s AS INTEGER) AS stream, CASE s WHEN 0 THEN 'vids' ELSE 'auds' END AS kind, CASE WHEN s = 0 THEN CASE WHEN l_suppkey % 7 = 0 THEN 'MJPG' ELSE 'DIVX' END END AS compression,
  CASE s WHEN 0 THEN 40 ELSE 1 END AS scale, CASE s WHEN 0 THEN 1000 ELSE 8000 END AS rate, CASE s WHEN 0 THEN 0 ELSE 4 END AS sample_size, CASE s WHEN 0 THEN 320 END AS width, CASE s WHEN 1 THEN 2 END AS channels, l_suppkey % 5 <> 0 AS indexed
FROM lineitem, range(0, 2) AS x(s)""", long="scale rate sample_size", int_="width channels")
def avi_streams(t):
    folder = _written(t)
    return read_avi(t("lineitem").sparkSession, folder, "streams").select(_number(), "stream", "kind", "compression", "scale", "rate", "sample_size", "width", "channels", "indexed")


@query("avi_index", f"WITH {PACKETS} SELECT file, place, stream, key AS keyframe, pos - 8 - CASE WHEN file % 2 = 0 THEN {BEGIN - 4} ELSE 0 END AS pos, size FROM q WHERE file % 5 <> 0")
def avi_index(t):
    """Entries of the index, which tasks read in shares."""
    return read_avi(t("lineitem").sparkSession, _written(t), "index", share=4096).select(_number(), "place", "stream", "keyframe", "pos", "size")


@query("avi_samples", f"""
WITH {PACKETS},
s AS (SELECT *, coalesce(lead(k) OVER (PARTITION BY file, stream ORDER BY n, size), m) - k AS stays FROM q WHERE size > 0 AND file % 7 <> 0)
SELECT file, stream, k, pos AS "offset", size, CASE WHEN file % 5 <> 0 THEN key WHEN stream = 1 THEN true END AS keyframe, CASE WHEN stream = 1 THEN size // 4 ELSE 1 END AS samples,
  CASE WHEN stream = 1 THEN 1 WHEN file % 5 = 0 THEN 40 ELSE 40 * stays END AS duration FROM s""", long="samples duration")
def avi_samples(t):
    """Samples by the index, or by the packets of files that have none; files with refused codes are left out."""
    return avi_import.import_avi(t("lineitem").sparkSession, _written(t, apart=True), folders=True).withColumn("file", _number())


@query("avi_growing", f"""
WITH {PACKETS},
f AS (
  SELECT file, {BEGIN} + sum(8 + size + size % 2) + CASE WHEN file % 5 = 0 THEN 0 ELSE 8 + 16 * count(*) END AS total FROM p GROUP BY file),
a AS (SELECT *, CASE WHEN file % 3 = 0 THEN total * 6 // 10 ELSE total END AS available FROM f),
r AS (
  SELECT q.*, available < total AND place + 1 >= 10 AND available - (pos + size + size % 2) < 8 * max(size) OVER w AS near, pos + size <= available AS here FROM q JOIN a USING (file)
  WINDOW w AS (PARTITION BY file ORDER BY n, size ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(bool_or(near) OVER (PARTITION BY file ORDER BY n, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM r)
SELECT file, place, stream, pos, size FROM b WHERE here AND NOT behind""")
def avi_growing(t):
    """Packets of files of which some have arrived in part, as a stream in turns of 300 and 1000 packets: reading ends before what is missing."""
    rows = stream_avi(t("lineitem").sparkSession, _written(t, 0.6))
    return drained(rows).select(_number(), "place", "stream", "pos", "size")
