"""Track and component tables on the driver's tables: encodings, sizes, metadata, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup
from .registry import query

#: Sample rates of AAC streams in the order of their index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000)
#: Metadata keys and the names they are stored under.
METADATA = (("title", "©nam"), ("artist", "©ART"), ("album", "©alb"), ("comment", "©cmt"), ("copyright", "©cpy"), ("genre", "©gen"), ("date", "©day"), ("composer", "©com"), ("encoder", "©enc"))


@query("aac_rate_index", f"SELECT p_partkey, coalesce(list_position([{', '.join(map(str, AAC_RATES))}], CASE p_size % 4 WHEN 0 THEN 48000 WHEN 1 THEN 44100 WHEN 2 THEN 8000 ELSE p_size END) - 1, 15) AS idx, CASE WHEN p_size % 4 = 2 THEN 5 ELSE 2 END AS profile FROM part")
def aac_rate_index(t):
    rate = F.when(F.col("p_size") % 4 == 0, 48000).when(F.col("p_size") % 4 == 1, 44100).when(F.col("p_size") % 4 == 2, 8000).otherwise(F.col("p_size"))
    rows = t("part").select("p_partkey", rate.alias("rate"), F.when(F.col("p_size") % 4 == 2, "SBR").otherwise("?").alias("codec"))
    spark = rows.sparkSession
    dim = spark.createDataFrame(list(enumerate(AAC_RATES)), "idx int, rate int")
    profiles = spark.createDataFrame([("LC", 2, 0), ("SBR", 5, 1)], "codec string, profile int, ord int")
    out = lookup.match(rows, dim, ["rate"], "idx", "idx", default=F.lit(15))
    return lookup.match(out, profiles, ["codec"], "profile", "ord", default=F.lit(2)).select("p_partkey", "idx", "profile")


@query("metadata_sink", "SELECT page_id, '©nam' AS key, regexp_extract(html, '<title>([^<]*)', 1) AS value FROM pages WHERE regexp_matches(html, '<title>') UNION ALL SELECT page_id, '©cmt', url FROM pages")
def metadata_sink(t):
    title = F.nullif(F.regexp_extract("html", "<(title)>", 1), F.lit(""))
    tags = F.map_from_arrays(F.array(F.lit("title"), F.lit("comment"), F.lit("unknown")), F.array(F.when(title.isNotNull(), F.regexp_extract("html", "<title>([^<]*)", 1)), F.col("url"), F.lit("x")))
    rows = t("pages").select("page_id", F.explode(tags).alias("name", "value")).where("value IS NOT NULL")
    dim = rows.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(METADATA)], "ord int, name string, key string")
    return lookup.match(rows, dim, ["name"], "key", "ord", how="inner").select("page_id", "key", "value")


@query("content_encodings", "SELECT p_partkey, p_size % 3 = 1 AND p_partkey % 2 = 0 AS usable, p_size % 3 = 1 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AS warned FROM part")
def content_encodings(t):
    scope, kind, algorithm = F.col("p_size") % 3, F.col("p_partkey") % 2, F.col("p_partkey") % 5
    usable = (scope == 1) & (kind == 0)
    return t("part").select("p_partkey", usable.alias("usable"), (usable & (algorithm != 0)).alias("warned"))


@query("subtitle_sizes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 700 + p_size END AS w, CASE WHEN p_size % 2 = 0 THEN 400 + p_size END AS h FROM part WHERE p_size % 5 > 0")
def subtitle_sizes(t):
    size = F.col("p_size")
    private = F.when(size % 2 == 0, F.concat(F.lit("# x\nsize: "), (size + 700).cast("string"), F.lit("x"), (size + 400).cast("string"), F.lit("\n"))).otherwise("# none")
    codec = F.when(size % 5 == 0, "S_UNKNOWN").otherwise("S_VOBSUB")
    part = lambda i: F.regexp_extract(private, r"size: (\d+)x(\d+)", i).try_cast("int")
    return t("part").where(codec.isin("S_VOBSUB", "S_TEXT/ASS", "S_TEXT/SSA", "S_TEXT/UTF8")).select("p_partkey", part(1).alias("w"), part(2).alias("h"))


@query("component_status", """
WITH o AS (SELECT p_type AS bundle, arg_max(p_name, p_partkey) AS name FROM part WHERE p_size > 40 GROUP BY p_type), u AS (SELECT 'user' AS scope, c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' END AS bundle FROM customer UNION ALL SELECT 'system', s_suppkey, 'STANDARD' FROM supplier)
SELECT scope, id, coalesce(u.bundle, 'unknown.' || id) AS bundle, coalesce(o.name, 'OK') AS status FROM u LEFT JOIN o ON o.bundle = u.bundle
""")
def component_status(t):
    bundle = F.when(F.col("c_custkey") % 3 == 0, "ECONOMY").when(F.col("c_custkey") % 3 == 1, "PROMO")
    user = t("customer").select(F.lit("user").alias("scope"), F.col("c_custkey").alias("id"), bundle.alias("bundle"))
    every = user.unionByName(t("supplier").select(F.lit("system").alias("scope"), F.col("s_suppkey").alias("id"), F.lit("STANDARD").alias("bundle")))
    obsolete = t("part").where("p_size > 40").select(F.col("p_type").alias("bundle"), F.col("p_name").alias("status"), "p_partkey")
    out = lookup.match(every, obsolete, ["bundle"], "status", "p_partkey", last=True, default=F.lit("OK"))
    return out.select("scope", "id", F.coalesce("bundle", F.concat(F.lit("unknown."), F.col("id").cast("string"))).alias("bundle"), "status")


@query("delta_updates", "SELECT o_custkey, o_orderstatus AS from_version, arg_max(o_orderkey, o_orderkey) AS item FROM orders GROUP BY o_custkey, o_orderstatus")
def delta_updates(t):
    return t("orders").groupBy("o_custkey", F.col("o_orderstatus").alias("from_version")).agg(F.max("o_orderkey").alias("item"))


@query("font_scales", "SELECT p_partkey, round(CASE WHEN p_size % 10 = 0 THEN 1 ELSE 1000.0 / (p_size % 10 * 100 + 50) END, 6) AS scale, NOT regexp_matches(CASE WHEN p_size % 4 = 0 THEN 'DFx.ttc' ELSE 'Arial.ttf' END, '^DF.*[.]ttc$') AS imported FROM part")
def font_scales(t):
    k = F.col("p_size") % 10
    name = F.when(F.col("p_size") % 4 == 0, "DFx.ttc").otherwise("Arial.ttf")
    return t("part").select("p_partkey", F.round(F.coalesce(F.try_divide(F.lit(1000.0), F.when(k != 0, k * 100 + 50)), F.lit(1.0)), 6).alias("scale"), (~name.rlike(r"^DF.*\.ttc$")).alias("imported"))


@query("two_channel_modes", "SELECT p_partkey, p_size & 247 & 15 AS mode FROM part")
def two_channel_modes(t):
    return t("part").select("p_partkey", F.col("p_size").bitwiseAND(F.lit(0xF7)).bitwiseAND(F.lit(15)).alias("mode"))


@query("wave_codes", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'ac-3' WHEN 1 THEN 'mp3 ' ELSE 'ms' || lower(printf('%04X', p_size)) END AS code FROM part")
def wave_codes(t):
    dim = t("part").sparkSession.createDataFrame([(0, 0, "ac-3"), (1, 1, "mp3 "), (2, 1, "later")], "ord int, twocc int, code string")
    rows = t("part").select("p_partkey", (F.col("p_size") % 5).alias("twocc"), "p_size")
    fallback = F.concat(F.lit("ms"), F.lower(F.lpad(F.hex("p_size"), 4, "0")))
    return lookup.match(rows, dim, ["twocc"], "code", "ord", default=fallback).select("p_partkey", "code")


@query("exportable", "SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey")
def exportable(t):
    kinds = t("orders").sparkSession.createDataFrame([("O",), ("F",)], "o_orderstatus string")
    return t("orders").join(kinds, "o_orderstatus", "left_semi").select("o_custkey").distinct()


@query("import_limits", "SELECT o_custkey, count(*) AS streams FROM orders GROUP BY o_custkey HAVING count(*) < 16")
def import_limits(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("streams")).where("streams < 16")


@query("track_alternates", "SELECT event_id, user_id AS file, event_type AS kind, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS alternate_of FROM events")
def track_alternates(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").select("event_id", F.col("user_id").alias("file"), F.col("event_type").alias("kind"), F.first("event_id").over(w).alias("alternate_of"))
