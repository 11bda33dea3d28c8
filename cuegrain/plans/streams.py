"""Streams over the driver's tables: each reads a table's files as a stream and returns what it has written."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from ..streaming import flush, packed, release
from .registry import query


def streamed(table: DataFrame) -> DataFrame:
    """The files of a table as a stream."""
    folder, _, name = table.inputFiles()[0].rpartition("/")
    return table.sparkSession.readStream.schema(table.schema).option("pathGlobFilter", name if name.endswith(".parquet") and not name.startswith("part-") else "*.parquet").parquet(folder)


def finished(rows: DataFrame) -> DataFrame:
    """All rows that a stream gives for what is there now."""
    folder = new_folder(rows.sparkSession)
    run = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


@contextlib.contextmanager
def rocks(spark):
    """A session whose new streams keep their state in RocksDB, as transformWithState asks for."""
    key, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, own)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drained(rows: DataFrame) -> DataFrame:
    """All rows that a stream gives in as many turns as its source takes."""
    folder = new_folder(rows.sparkSession)
    run = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


CUES = "(SELECT user_id AS file, event_id * 10 AS b, event_id * 10 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 5 END AS e, event_type || chr(10) AS line FROM events)"


@query("released_packets", f"""
WITH c AS (SELECT file, b, e, line, coalesce(lag(e) OVER w, 0) AS done, lead(b) OVER w AS later FROM {CUES} WHERE b < e WINDOW w AS (PARTITION BY file ORDER BY b))
SELECT file, b AS "begin", e AS "end", line AS "text" FROM c WHERE later IS NOT NULL UNION ALL SELECT file, done, b, chr(10) FROM c WHERE later IS NOT NULL AND done < b
""")
def released_packets(t):
    """Cues that never overlap: each leaves, with the gap before it, when the next one of its file comes; the last stays open, empty ones are left out."""
    rows = streamed(t("events"))
    cues = rows.select(F.col("user_id").cast("long").alias("file"), F.col("event_id").alias("num"), (F.col("event_id") * 10).alias("begin"), (F.col("event_id") * 10 + F.when(F.col("event_id") % 7 == 0, 0).otherwise(5)).alias("end"), F.concat("event_type", F.lit("\n")).alias("line"))
    return finished(release.release_packets(cues))


# ---------------------------------------------------------------- packed bitstreams

#: Kinds of the pictures of a packet, by the event's number; a jump after each twenty packets.
LETTERS = ("P", "B", "PB", "N", "IB", "P", "PBB", "", "N", "B", "I", "PN", "P")
SIZES = {"I": 400, "P": 200, "B": 100, "N": 7}


def _total(column: str) -> str:
    return "(" + " + ".join(f"{v} * (length({column}) - length(replace({column}, '{k}', '')))" for k, v in SIZES.items()) + ")"


_PACKED = f"""
WITH RECURSIVE p AS (
  SELECT user_id AS file, rn + rn // 20 AS n, rn, [{', '.join(repr(x) for x in LETTERS)}][CAST(event_id % {len(LETTERS)} AS INTEGER) + 1] AS own
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)),
r AS (
  SELECT DISTINCT file, CAST(-1 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS rn, false AS late, CAST(NULL AS VARCHAR) AS last_p, CAST(NULL AS VARCHAR) AS future, 'I' AS last_kind, '' AS rest, CAST(0 AS BIGINT) AS rest_n, CAST(0 AS BIGINT) AS rest_k,
    CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS shown, CAST(NULL AS VARCHAR) AS needs FROM p
  UNION ALL
  SELECT file, n, rn, late1, CASE WHEN b THEN shown1 ELSE lp1 END, CASE WHEN b THEN kind1 ELSE f1 END, lk1,
    CASE WHEN failed THEN rest0 WHEN NOT more THEN '' WHEN b THEN have[3:] ELSE have[2:] END, CASE WHEN failed THEN rn0 ELSE hn END, CASE WHEN failed THEN rk0 ELSE hk + CASE WHEN b THEN 2 ELSE 1 END END,
    CASE WHEN b THEN 'B' ELSE kind1 END, CASE WHEN b THEN hn || '.' || (hk + 1) ELSE shown1 END, CASE WHEN b THEN shown1 ELSE needs1 END
  FROM (SELECT *, more AND have[2] = 'B' AS b FROM (
    SELECT *, NOT failed AND {_total('c')} < {_total('own')} AS more,
      CASE WHEN failed THEN CASE WHEN f0 IS NOT NULL THEN lp0 END WHEN late1 AND c <> 'B' AND NOT jumped THEN lp0 ELSE id END AS shown1,
      CASE WHEN NOT failed AND c <> 'I' THEN lp0 END AS needs1, CASE WHEN failed OR c = 'B' THEN lp0 ELSE id END AS lp1,
      CASE WHEN failed THEN f0 WHEN late1 THEN lk0 ELSE c END AS kind1, CASE WHEN NOT failed AND late1 THEN c ELSE lk0 END AS lk1,
      CASE WHEN failed OR (c = 'I' AND NOT late1) THEN NULL ELSE f0 END AS f1
    FROM (SELECT *, CASE WHEN failed THEN late WHEN c = 'B' AND NOT late AND f0 IS NULL THEN true WHEN late AND {_total('c')} < {_total('have')} - 16 THEN false ELSE late END AS late1
    FROM (SELECT *, have = '' OR (c = 'N' AND f0 IS NOT NULL) AS failed, hn || '.' || hk AS id
    FROM (SELECT *, CASE WHEN rest0 <> '' THEN rest0 ELSE own END AS have, left(CASE WHEN rest0 <> '' THEN rest0 ELSE own END, 1) AS c, CASE WHEN rest0 <> '' THEN rn0 ELSE n END AS hn, CASE WHEN rest0 <> '' THEN rk0 ELSE 0 END AS hk
    FROM (
      SELECT p.file, p.n, p.rn, p.own, r.late, r.future AS f0, p.n <> r.n + 1 AS jumped, CASE WHEN p.n <> r.n + 1 THEN '' ELSE r.rest END AS rest0, r.rest_n AS rn0, r.rest_k AS rk0,
        CASE WHEN p.n <> r.n + 1 THEN NULL ELSE r.last_p END AS lp0, CASE WHEN p.n <> r.n + 1 THEN 'I' ELSE r.last_kind END AS lk0
      FROM r JOIN p ON p.file = r.file AND p.rn = r.rn + 1))))) ))
SELECT file, n, kind, shown, needs, late FROM r WHERE rn >= 0
"""


def _packets(events: DataFrame) -> DataFrame:
    """Packets of a table that has each event's place among its user's."""
    kinds = F.element_at(F.array(*(F.lit(x) for x in LETTERS)), (F.col("event_id") % len(LETTERS) + 1).cast("int"))
    sizes = F.transform(F.filter(F.split("kinds", ""), lambda x: x != ""), lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in SIZES.items() for v in kv)), x))
    return events.select(F.col("user_id").cast("long").alias("file"), F.expr("rn + rn div 20").cast("long").alias("n"), kinds.alias("kinds")).withColumn("sizes", sizes)


def _placed(t) -> DataFrame:
    from pyspark.sql import Window

    return t("events").withColumn("rn", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))


@query("packed_table", _PACKED)
def packed_table(t):
    """What each packet of packed streams shows, over a table."""
    return packed.packed_table(_packets(_placed(t)))


@query("packed_stream", _PACKED)
def packed_stream(t):
    """The same as a stream in which a quarter of each file's packets arrives at a time."""
    rows = _packets(_placed(t))
    spark = rows.sparkSession
    folder = f"{new_folder(spark)}/packets"
    quarter = F.ntile(4).over(_by_n())
    parts = rows.withColumn("part", quarter)
    for part in range(1, 5):  # files are read in the order in which they were written; a quarter's tasks write one each, so a file's packets of a quarter stand together
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
    written = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, written // 4)).parquet(folder)
    with rocks(spark):
        return drained(packed.packed_stream(stream))


def _by_n():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("n")


# ---------------------------------------------------------------- end of input by event time


def _sweep(cues: str, start: str, name: str) -> str:
    """SQL of the packets of ``cues`` (file, num, b, e, line) from ``start`` (file, t) on."""
    return f"""{name}_t AS (SELECT DISTINCT file, t FROM (SELECT file, b AS t FROM {cues} UNION ALL SELECT file, e FROM {cues} UNION ALL SELECT file, t FROM {start} WHERE file IN (SELECT file FROM {cues}))),
{name}_s AS (SELECT * FROM (SELECT file, t AS s0, lead(t) OVER (PARTITION BY file ORDER BY t) AS s1 FROM {name}_t) WHERE s1 IS NOT NULL),
{name} AS (SELECT s.file, s0, s1, coalesce(string_agg(line || chr(10), '' ORDER BY b, num), chr(10)) AS text FROM {name}_s s LEFT JOIN {cues} c ON s.file = c.file AND b <= s0 AND e >= s1 GROUP BY s.file, s0, s1)"""


@query("flushed_packets", f"""
WITH c AS (SELECT user_id AS file, event_id AS num, event_id * 10 - CASE WHEN event_id % 7 = 3 THEN 4000 ELSE 0 END AS b, event_id * 10 + 5 + event_id % 5 * 300 - CASE WHEN event_id % 14 = 3 THEN 3000 ELSE 0 END AS e, event_type AS line, event_id % 7 = 3 OR event_id % 7 = 5 AS second FROM events),
f AS (SELECT file, num, greatest(b, 0) AS b, e, line, second FROM c WHERE greatest(b, 0) < e),
k1 AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY b, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WHERE NOT second),
k2 AS (SELECT *, sum(CASE WHEN before IS NULL OR b >= before THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY b, num ROWS UNBOUNDED PRECEDING) AS cluster FROM k1),
k3 AS (SELECT *, max(cluster) OVER (PARTITION BY file) AS last FROM k2),
one AS (SELECT file, num, b, e, line FROM k3 WHERE cluster < last),
files AS (SELECT DISTINCT file FROM f),
done AS (SELECT files.file, coalesce(max(e), 0) AS t FROM files LEFT JOIN one ON one.file = files.file GROUP BY files.file),
two AS (
  SELECT file, num, b, e, line FROM k3 WHERE cluster = last
  UNION ALL SELECT f.file, num, greatest(b, t), e, line FROM f JOIN done USING (file) WHERE second AND e > t),
late AS (SELECT done.file, count(num) AS n FROM done LEFT JOIN f ON f.file = done.file AND second AND b < t GROUP BY done.file),
zero AS (SELECT file, 0 AS t FROM files),
{_sweep('one', 'zero', 'p1')},
{_sweep('two', 'done', 'p2')}
SELECT file, s0 AS "begin", s1 AS "end", text, 0 AS late FROM p1 UNION ALL SELECT p2.file, s0, s1, text, n FROM p2 JOIN late USING (file)""", long="begin end late")
def flushed_packets(t):
    """Cues that overlap, in two shares of which the second has late ones; then time goes on, and timers flush all files."""
    e = F.col("event_id")
    begin = F.greatest(e * 10 - F.when(e % 7 == 3, 4000).otherwise(0), F.lit(0))
    end = e * 10 + 5 + e % 5 * 300 - F.when(e % 14 == 3, 3000).otherwise(0)
    second = (e % 7).isin(3, 5)
    rows = t("events").select(F.col("user_id").cast("long").alias("file"), e.alias("num"), begin.alias("begin"), end.alias("end"), F.col("event_type").alias("line"), F.timestamp_millis(F.when(second, 200_000).otherwise(100_000).cast("long") + e % 1000).alias("ts"), second.alias("second"))
    spark = rows.sparkSession
    folder = f"{new_folder(spark)}/cues"
    later = spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS file", "0L AS num", "0L AS begin", "0L AS end", "'' AS line", "timestamp_millis(9000000L) AS ts")
    for share in (rows.where(~F.col("second")).drop("second"), rows.where("second").drop("second"), later):
        share.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(later.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with rocks(spark):
        return drained(flush.flushed_packets(stream, 60_000, "10 minutes"))
