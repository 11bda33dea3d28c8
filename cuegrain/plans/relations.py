"""Look-ups, aggregations, orders and set operations on the driver's tables."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lookup, stats
from .registry import millis, query


@query("block_to_track", "WITH s AS (SELECT s_suppkey, arg_min(s_name, s_name) AS s_name FROM supplier WHERE s_acctbal > 0 GROUP BY s_suppkey) SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, s_name FROM lineitem JOIN s ON l_suppkey = s_suppkey")
def block_to_track(t):
    blocks = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    tracks = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lookup.match(blocks, tracks, ["l_suppkey"], "s_name", "s_name", how="inner")


@query("style_lookup", "SELECT o_orderkey, coalesce(c_mktsegment, 'Default') AS style FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 1000) c ON o_custkey = c_custkey")
def style_lookup(t):
    dim = t("customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("style"))
    return lookup.match(t("orders").select("o_orderkey", "o_custkey"), dim, ["o_custkey"], "style", "style", default=F.lit("Default")).select("o_orderkey", "style")


@query("style_map_last", "SELECT ltrim(p_brand, '*') AS name, arg_max(p_type, p_partkey) AS style FROM part GROUP BY 1")
def style_map_last(t):
    return t("part").groupBy(F.regexp_replace("p_brand", r"^\*+", "").alias("name")).agg(F.max_by("p_type", "p_partkey").alias("style"))


@query("first_match_dim", "SELECT o_orderkey, (SELECT arg_min(p_type, p_partkey) FROM part WHERE p_size = o_orderkey % 60) AS fourcc FROM orders")
def first_match_dim(t):
    rows = t("orders").select("o_orderkey", (F.col("o_orderkey") % 60).cast("int").alias("p_size"))
    return lookup.match(rows, t("part").select("p_size", "p_partkey", F.col("p_type").alias("fourcc")), ["p_size"], "fourcc", "p_partkey").select("o_orderkey", "fourcc")


@query("last_match_dim", "SELECT o_orderkey, coalesce((SELECT arg_max(p_type, p_partkey) FROM part WHERE p_size = o_orderkey % 60), 'OK') AS status FROM orders")
def last_match_dim(t):
    rows = t("orders").select("o_orderkey", (F.col("o_orderkey") % 60).cast("int").alias("p_size"))
    return lookup.match(rows, t("part").select("p_size", "p_partkey", F.col("p_type").alias("status")), ["p_size"], "status", "p_partkey", last=True, default=F.lit("OK")).select("o_orderkey", "status")


#: Two- and three-letter codes of ISO 639 for the languages that the tables hold, in order.
LANGUAGES = (("en", "eng"), ("de", "ger"), ("de", "deu"), ("fr", "fre"), ("fr", "fra"), ("es", "spa"))


@query("iso639_lookup", "SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fre' WHEN 'es' THEN 'spa' ELSE 'und' END AS code FROM documents")
def iso639_lookup(t):
    docs = t("documents").select("doc_id", F.lower("lang").alias("two"))
    dim = docs.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(LANGUAGES)], "ord int, two string, code string")
    return lookup.match(docs, dim, ["two"], "code", "ord", default=F.lit("und")).select("doc_id", "code")


@query("prefix_match", "SELECT p.n_regionkey AS dir, p.n_name AS base, f.n_name || '.SRT' AS name FROM nation p JOIN nation f ON p.n_regionkey = f.n_regionkey AND starts_with(lower(f.n_name || '.SRT'), lower(p.n_name))")
def prefix_match(t):
    n = t("nation").select(F.col("n_regionkey").alias("dir"), "n_name")
    return lookup.prefix_pairs(n.select("dir", F.col("n_name").alias("base")), n.select("dir", F.concat("n_name", F.lit(".SRT")).alias("name")), ["srt", "ass", "ssa", "idx", "smi"], "dir")


@query("codec_cascade", "SELECT p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_partkey % 5, 0), 85 + p_size) AS fourcc FROM part")
def codec_cascade(t):
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    return t("part").select("p_partkey", F.coalesce(lookup.cascade(size % 3, key % 5), size + 85).alias("fourcc"))


@query("channel_layout", "SELECT c_custkey, s_name AS layout FROM customer LEFT JOIN (SELECT s_nationkey, s_suppkey % 3 AS m, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY ALL) ON c_nationkey = s_nationkey AND c_custkey % 3 = m")
def channel_layout(t):
    dim = t("supplier").select(F.col("s_nationkey").alias("codec"), (F.col("s_suppkey") % 3).alias("channels"), "s_suppkey", F.col("s_name").alias("layout"))
    rows = t("customer").select("c_custkey", F.col("c_nationkey").alias("codec"), (F.col("c_custkey") % 3).alias("channels"))
    return lookup.match(rows, dim, ["codec", "channels"], "layout", "s_suppkey").select("c_custkey", "layout")


@query("best_localised_node", "SELECT source, arg_min(doc_id, (CASE WHEN lang = 'fr' THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END, doc_id)) AS doc_id FROM documents GROUP BY source")
def best_localised_node(t):
    rank = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "en", 1).otherwise(2)
    return t("documents").groupBy("source").agg(F.min_by("doc_id", F.struct(rank, "doc_id")).alias("doc_id"))


@query("newest_generation", "SELECT o_orderkey, coalesce(b.p_name, a.p_name) AS frame FROM orders LEFT JOIN (SELECT * FROM part WHERE p_size > 25) b ON b.p_partkey = o_orderkey LEFT JOIN part a ON a.p_partkey = o_orderkey")
def newest_generation(t):
    part = t("part").select(F.col("p_partkey").alias("o_orderkey"), "p_name", "p_size")
    new, old = part.where("p_size > 25").select("o_orderkey", F.col("p_name").alias("a")), part.select("o_orderkey", F.col("p_name").alias("b"))
    return t("orders").select("o_orderkey").join(new, "o_orderkey", "left").join(old, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", "b").alias("frame"))


STAGE = "CASE event_id % 3 WHEN 0 THEN 'begin' WHEN 1 THEN 'decode' ELSE 'end' END"


@query("drop_stats", f"""
WITH s AS (SELECT event_type AS kind, {STAGE} AS stage FROM events), c AS (SELECT kind, count(*) FILTER (stage = 'begin') AS begun, count(*) FILTER (stage = 'decode') AS decoded FROM s GROUP BY kind)
SELECT kind, begun, decoded, begun - decoded AS dropped, coalesce(round((begun - decoded) * 100.0 / nullif(begun, 0), 4), 0) AS dropped_pct FROM c
""")
def drop_stats(t):
    return stats.drop_stats(t("events").select(F.col("event_type").alias("kind"), F.expr(STAGE).alias("stage")))


@query("running_lag", f"""
WITH s AS (SELECT user_id AS stream, event_id AS seq, {STAGE} AS stage FROM events), b AS (SELECT stream, seq, sum(CASE stage WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS behind FROM s)
SELECT stream, seq, CAST(behind AS BIGINT) AS behind, CAST(max(abs(behind)) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS worst FROM b
""")
def running_lag(t):
    return stats.running_lag(t("events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.expr(STAGE).alias("stage")))


@query("byte_score", "SELECT doc_id, CAST(sum(CASE WHEN c IN ('é', 'è', 'ê', 'ç', 'ñ') THEN -3 WHEN c IN ('ä', 'ö', 'ü', 'ß') THEN 2 ELSE 0 END) AS BIGINT) AS score FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id")
def byte_score(t):
    weights = {**{c: -3 for c in "éèêçñ"}, **{c: 2 for c in "äöüß"}}
    n = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    return t("documents").select("doc_id", sum((n(c) * w for c, w in weights.items()), F.lit(0)).cast("long").alias("score"))


CHARS = "SELECT lang, unnest(string_split(text, '')) AS c FROM documents"


@query("char_hist", f"SELECT lang, c, count(*) AS n FROM ({CHARS}) WHERE c <> '' GROUP BY ALL")
def char_hist(t):
    return stats.histogram(t("documents"), "lang")


@query("bigram_hist", """
WITH c AS (SELECT doc_id, lang, unnest(string_split(text, '')) AS c, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM documents), p AS (SELECT lang, c, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM c)
SELECT lang, c, d, count(*) AS n FROM p WHERE d IS NOT NULL AND c <> '' AND d <> '' GROUP BY ALL
""")
def bigram_hist(t):
    return stats.bigrams(t("documents"), "lang", "doc_id")


@query("hist_diff", f"""
WITH h AS (SELECT lang, c, count(*) AS n FROM ({CHARS}) WHERE c <> '' GROUP BY ALL), a AS (SELECT c, n, sum(n) OVER () AS t FROM h WHERE lang = 'en'), b AS (SELECT c, n, sum(n) OVER () AS t FROM h WHERE lang = 'fr')
SELECT coalesce(a.c, b.c) AS c, CAST(trunc((sqrt(coalesce(b.n / b.t, 0)) - sqrt(coalesce(a.n / a.t, 0))) * 65536 + 0.5) AS INTEGER) AS delta FROM a FULL JOIN b ON a.c = b.c
""")
def hist_diff(t):
    return stats.histogram_difference(stats.histogram(t("documents").where(F.col("lang").isin("en", "fr")), "lang"), "lang", "en", "fr")


@query("latin1_pairs", """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM documents),
k AS (SELECT doc_id, i, CASE WHEN regexp_matches(c, '^[A-Z]$') THEN 'U' WHEN regexp_matches(c, '^[a-z]$') THEN 'l' WHEN c IN ('à','è','é','ê','ç','ñ','ä','ö','ü','ß','ó','í','á') THEN 'a' ELSE 'o' END AS k FROM c WHERE c <> ''),
p AS (SELECT doc_id, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS a, k AS b FROM k)
SELECT doc_id, count(*) FILTER (b = 'a' AND a IN ('l', 'a')) AS likely, count(*) FILTER (b = 'a' AND a = 'U') AS unlikely, count(*) FILTER (a IS NOT NULL) AS total FROM p GROUP BY doc_id
""")
def latin1_pairs(t):
    upper, lower, accented = string.ascii_uppercase, string.ascii_lowercase, "àèéêçñäöüßóíá"
    text = F.translate("text", upper + lower + accented, "U" * 26 + "l" * 26 + "a" * len(accented))
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return t("documents").where(F.length("text") > 0).select("doc_id", n("(?<=[la])a").alias("likely"), n("(?<=U)a").alias("unlikely"), (F.length("text") - 1).cast("long").alias("total"))


@query("latin1_confidence", """
WITH n AS (SELECT doc_id, length(text) AS total, length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS hi FROM documents)
SELECT doc_id, round(CASE WHEN total = 0 THEN 0 ELSE greatest((total - hi * 20.0) / total, 0) * 0.5 END, 6) AS conf FROM n
""")
def latin1_confidence(t):
    hi = F.regexp_count("text", F.lit(r"[^\x00-\x7F]"))
    return t("documents").select("doc_id", F.round(stats.pair_class_confidence(F.lit(False), F.length("text"), hi, F.length("text")), 6).alias("conf"))


@query("utf8_confidence", """
WITH n AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS n FROM documents)
SELECT doc_id, n, round(CASE WHEN n < 6 THEN 1 - 0.99 * pow(0.5, n) ELSE 0.99 END, 6) AS conf FROM n
""")
def utf8_confidence(t):
    df = t("documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x7F]")).cast("long").alias("n"))
    return df.select("doc_id", "n", F.round(stats.utf8_confidence(F.col("n")), 6).alias("conf"))


@query("sequence_confidence", """
WITH c AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS n, CAST(length(text) - length(replace(replace(text, 'e', ''), 'n', '')) AS DOUBLE) AS f, CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS DOUBLE) AS p FROM documents)
SELECT doc_id, round(CASE WHEN n > 1 THEN least(p / (n - 1) / 0.02 * (f / n), 0.99) ELSE 0.01 END, 6) AS conf FROM c
""")
def sequence_confidence(t):
    n = F.length("text")
    without = lambda *x: F.length(F.regexp_replace("text", "|".join(x), ""))
    return t("documents").select("doc_id", F.round(stats.sequence_confidence((n - without("en")) / 2, n - 1, n - without("e", "n"), n, 0.02), 6).alias("conf"))


@query("distribution_confidence", """
WITH c AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS n, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS f FROM documents)
SELECT doc_id, round(CASE WHEN n <= 0 OR f <= 0 THEN 0.01 WHEN n = f THEN 0.99 ELSE least(f / ((n - f) * 0.3), 0.99) END, 6) AS conf FROM c
""")
def distribution_confidence(t):
    n = F.length("text")
    return t("documents").select("doc_id", F.round(stats.distribution_confidence(n - F.length(F.replace(F.col("text"), F.lit("e"), F.lit(""))), n, 0.3), 6).alias("conf"))


@query("argmax_tie", """
WITH c AS (SELECT doc_id, lang AS name, CAST(doc_id % 7 AS DOUBLE) / 10 AS conf, 0 AS ord FROM documents UNION ALL SELECT doc_id, source, CAST(doc_id % 5 AS DOUBLE) / 10, 1 FROM documents UNION ALL SELECT doc_id, 'x', 0.3, 2 FROM documents)
SELECT doc_id, arg_max(name, (conf, -ord)) AS name, max(conf) AS conf FROM c GROUP BY doc_id HAVING max(conf) > 0.2
""")
def argmax_tie(t):
    d = t("documents")
    row = lambda name, conf, k: d.select("doc_id", name.alias("name"), conf.alias("conf"), F.lit(k).alias("ord"))
    rows = row(F.col("lang"), (F.col("doc_id") % 7).cast("double") / 10, 0).unionByName(row(F.col("source"), (F.col("doc_id") % 5).cast("double") / 10, 1)).unionByName(row(F.lit("x"), F.lit(0.3), 2))
    return stats.best(rows, "doc_id", floor=0.2)


@query("hebrew_style_finals", "SELECT lang, CAST(sum(CASE WHEN regexp_matches(w, 'n$') THEN 1 ELSE 0 END) - sum(CASE WHEN regexp_matches(w, '^n') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang")
def hebrew_style_finals(t):
    n = lambda p: F.size(F.filter(F.split("text", " "), lambda w: w.rlike(p)))
    return t("documents").groupBy("lang").agg(F.sum((n("n$") - n("^n")).cast("long")).alias("score"))


@query("loaded_time", "SELECT max(m) AS max_loaded, min(m) FILTER (m > 0) AS min_loaded FROM (SELECT user_id, max((epoch_us(ts) // 1000)) AS m FROM events GROUP BY user_id)")
def loaded_time(t):
    m = t("events").groupBy("user_id").agg(F.max(millis("ts")).alias("m"))
    return m.agg(F.max("m").alias("max_loaded"), F.min(F.when(F.col("m") > 0, F.col("m"))).alias("min_loaded"))


@query("enabled_any", "WITH g AS (SELECT quality, bool_or(toxic = 1) AS any_on, min(doc_id) AS first FROM labels GROUP BY quality) SELECT l.quality, doc_id, (toxic = 1) OR (NOT any_on AND doc_id = first) AS enabled FROM labels l JOIN g ON l.quality = g.quality")
def enabled_any(t):
    on = F.col("toxic") == 1
    groups = t("labels").groupBy("quality").agg(F.bool_or(on).alias("any_on"), F.min("doc_id").alias("first"))  # partly summed before the shuffle
    return t("labels").join(groups, "quality").select("quality", "doc_id", (on | (~F.col("any_on") & (F.col("doc_id") == F.col("first")))).alias("enabled"))


@query("largest_packet", "SELECT user_id AS stream, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS largest FROM events")
def largest_packet(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select(F.col("user_id").alias("stream"), "event_id", F.max("value").over(w).alias("largest"))


@query("frame_classes", "SELECT l_orderkey AS frame, min(l_linenumber) AS slice, bool_and(l_returnflag = 'N') AS skippable, bool_or(l_quantity = 50) AS idr FROM lineitem GROUP BY l_orderkey")
def frame_classes(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.min("l_linenumber").alias("slice"), F.bool_and(F.col("l_returnflag") == "N").alias("skippable"), F.bool_or(F.col("l_quantity") == 50).alias("idr"))


@query("status_min", "SELECT s_nationkey, least(3, min(CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 1000 THEN 1 ELSE 2 END)) AS status FROM supplier GROUP BY s_nationkey")
def status_min(t):
    status = F.when(F.col("s_acctbal") < 0, 0).when(F.col("s_acctbal") < 1000, 1).otherwise(2)
    return t("supplier").groupBy("s_nationkey").agg(F.least(F.lit(3), F.min(status)).alias("status"))


@query("media_streams", "SELECT conv_id, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role = 'user') > 1 AS several FROM conversations GROUP BY conv_id")
def media_streams(t):
    n = F.count_if(F.col("role") == "user")
    return t("conversations").groupBy("conv_id").agg(n.alias("n"), (n > 1).alias("several"))


@query("distinct_names", "SELECT DISTINCT unnest(regexp_extract_all(html, 'charset=\"?([A-Za-z0-9-]+)', 1)) AS name FROM pages")
def distinct_names(t):
    return t("pages").select(F.explode(F.regexp_extract_all("html", F.lit('charset="?([A-Za-z0-9-]+)'), F.lit(1))).alias("name")).distinct()


@query("movie_end", "SELECT user_id AS file, max(((epoch_us(ts) // 1000) % 100000) * 600 // 1000) AS ends FROM events GROUP BY user_id")
def movie_end(t):
    return t("events").groupBy(F.col("user_id").alias("file")).agg(F.max(F.floor((millis("ts") % 100000) * 600 / 1000)).alias("ends"))


@query("layer_sort", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def layer_sort(t):
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("place"))


@query("newest_item", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def newest_item(t):
    return t("orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1)


@query("reverse_collisions", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 2 = 0 THEN -turn ELSE turn END) AS place FROM conversations")
def reverse_collisions(t):
    key = F.when(F.col("conv_id") % 2 == 0, -F.col("turn")).otherwise(F.col("turn"))
    return t("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(key)).cast("long").alias("place"))


@query("union_scopes", "SELECT 'user' AS scope, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'system', s_suppkey, s_acctbal FROM supplier")
def union_scopes(t):
    user = t("customer").select(F.lit("user").alias("scope"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return user.unionByName(t("supplier").select(F.lit("system").alias("scope"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")))


@query("forced_union", "SELECT event_id, false AS forced_track FROM events WHERE value > 0 UNION ALL SELECT event_id, true FROM events WHERE value > 0 AND event_type = 'error'")
def forced_union(t):
    good = t("events").where("value > 0")
    return good.select("event_id", F.lit(False).alias("forced_track")).unionByName(good.where("event_type = 'error'").select("event_id", F.lit(True).alias("forced_track")))


@query("placement_partition", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'positioned' WHEN doc_id % 9 >= 6 THEN 'top' ELSE 'bottom' END AS part FROM documents")
def placement_partition(t):
    return t("documents").select("doc_id", F.when(F.col("lang") == "de", "positioned").when(F.col("doc_id") % 9 >= 6, "top").otherwise("bottom").alias("part"))


@query("seen_once", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def seen_once(t):
    return lookup.once(t("documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("format_agreement", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 = o_orderkey % 5 AND c_mktsegment <> o_orderstatus")
def format_agreement(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.where((F.col("c_nationkey") % 5 == F.col("o_orderkey") % 5) & (F.col("c_mktsegment") != F.col("o_orderstatus"))).select("o_orderkey")
