"""Operators on real letters, versions and classes: Hebrew order, eligible updates, both languages of a file, restored sound packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import stats
from ..operators import timeline as tl
from ..sources import subtitles
from .registry import query

#: Latin letters of the tables' words, and the Hebrew ones that stand for them: final forms, plain forms, and others.
LATIN, HEBREW = "nesrtakmop", stats.HEBREW_FINAL + stats.HEBREW_PLAIN + "א"


@query("hebrew_scores", f"""
WITH c AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS x FROM (SELECT doc_id, '  ' || translate(lower(text), '{LATIN}', '{HEBREW}') AS s FROM documents)),
w AS (SELECT *, lag(x, 1) OVER w AS prev, lag(x, 2) OVER w AS before FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, count(*) FILTER (WHERE x = ' ' AND before <> ' ' AND contains('{stats.HEBREW_FINAL}', prev)) AS logical,
    count(*) FILTER (WHERE (x = ' ' AND before <> ' ' AND contains('{stats.HEBREW_PLAIN}', prev)) OR (x <> ' ' AND before = ' ' AND contains('{stats.HEBREW_FINAL}', prev))) AS visual FROM w GROUP BY doc_id)
SELECT doc_id, logical, visual, CASE WHEN logical - visual >= 5 THEN 'windows-1255' WHEN logical - visual <= -5 THEN 'ISO-8859-8' WHEN doc_id % 3 = 0 THEN 'windows-1255' WHEN doc_id % 3 = 1 THEN 'ISO-8859-8' WHEN logical < visual THEN 'ISO-8859-8' ELSE 'windows-1255' END AS charset FROM s""", int_="logical visual")
def hebrew_scores(t):
    """Signs of the order of Hebrew letters in words, and the charset that they and two models' confidences tell."""
    logical, visual = stats.hebrew_scores(F.translate(F.lower("text"), LATIN, HEBREW))
    rows = t("documents").where("text IS NOT NULL").select("doc_id", logical.alias("logical"), visual.alias("visual"))
    three = F.col("doc_id") % 3
    return rows.withColumn("charset", stats.hebrew_order(F.col("logical"), F.col("visual"), F.when(three == 0, 0.5).otherwise(0.3), F.when(three == 1, 0.5).otherwise(0.3)))


@query("update_versions", """
WITH u AS (SELECT p_partkey, [p_size // 10, p_size % 10, 0] AS own, [p_partkey % 5, 5] AS latest, [10, p_size % 8] AS needs, p_brand FROM part)
SELECT p_partkey, [latest[1], latest[2], -1] > own AND [10, 4] >= needs AND p_brand <> 'Brand#13' AS eligible FROM u""")
def update_versions(t):
    """Updates that are newer, run on this system, and aren't skipped; versions compare part by part, 1.10 behind 1.9."""
    size = F.col("p_size")
    version = lambda *parts: F.concat_ws(".", *(p.cast("string") for p in parts))
    own = version(F.floor(size / 10), size % 10, F.lit(0))
    latest = version(F.col("p_partkey") % 5, F.lit(5))
    needs = version(F.lit(10), size % 8)
    return t("part").select("p_partkey", (tx.newer_than(latest, own) & ~tx.newer_than(needs, F.lit("10.4")) & (F.col("p_brand") != "Brand#13")).alias("eligible"))


@query("sami_tracks", """
WITH s AS (SELECT p_partkey AS file, unnest(range(0, p_size % 4 + 1)) AS i, p_size % 4 AS last, p_brand, p_type FROM part)
SELECT file, 1 AS language, i + 1 AS num, i * 2000 AS "begin", CASE WHEN i = last THEN i * 2000 + 700 ELSE (i + 1) * 2000 END AS "end", p_brand AS line FROM s
UNION ALL SELECT file, 2, i + 1, i * 2000, CASE WHEN i = last THEN i * 2000 + 700 ELSE (i + 1) * 2000 END, p_type FROM s""", long="num begin end", int_="language")
def sami_tracks(t):
    """Both languages of a file, the last cue of each with a time of its own; a third class is left out."""
    block = "concat('<SYNC Start=', i * 2000, '><P Class=ENCC>', p_brand, '<P Class=FRCC>', p_type, '<P Class=XX>other')"
    text = F.expr(f"concat('<SAMI><BODY>', array_join(transform(sequence(0, p_size % 4), i -> {block}), ''), '</BODY></SAMI>')")
    texts = t("part").select(F.col("p_partkey").alias("file"), text.alias("text"))
    return subtitles.sami_tracks(texts, texts.select("file", F.lit("ENCC").alias("first"), F.lit("FRCC").alias("second")), 700)


@query("restored_packets", """
WITH p AS (SELECT user_id AS file, event_id AS n, event_type AS x FROM events)
SELECT file, n, 'hd' || x AS data, length(x) + 2 AS size, coalesce(sum(length(x) + 2) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM p""", long="size offset")
def restored_packets(t):
    packets = t("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), F.encode("event_type", "UTF-8").alias("data"))
    return tl.restored_packets(packets, F.lit(b"hd")).select("file", "n", F.decode("data", "UTF-8").alias("data"), "size", "offset")
