"""Texts with tags on the driver's tables: colours and classes of SAMI files, nested tags, words outside tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query

_COLOURS = [*tx.COLOURS, "#12aBcD", "0a0B0c", "nothing"]


@query("sami_colours", f"""
WITH c AS (SELECT p_partkey, {_COLOURS}[p_partkey % {len(_COLOURS)} + 1] AS v FROM part), d AS (SELECT p_partkey, upper(coalesce(map {tx.COLOURS}[v], CASE v WHEN '#12aBcD' THEN '12abcd' WHEN '0a0B0c' THEN '0a0b0c' ELSE 'ffffff' END)) AS h FROM c)
SELECT p_partkey, '{{\\1c&H' || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '&}}' AS tag FROM d
""")
def sami_colours(t):
    value = F.get(F.array(*map(F.lit, _COLOURS)), (F.col("p_partkey") % len(_COLOURS)).cast("int"))
    return t("part").select("p_partkey", tx.override_colour(F.when(F.col("p_partkey") % 2 == 0, value).otherwise(F.initcap(value))).alias("tag"))


@query("sami_classes", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'noClass' ELSE 'ENCC' END AS first, CASE WHEN p_size % 2 = 0 THEN 'DECC' ELSE 'noClass' END AS second, CASE WHEN p_size % 3 > 0 THEN 1 ELSE 3 END AS english, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS german FROM part")
def sami_classes(t):
    text = F.expr("concat(CASE WHEN p_size % 3 > 0 THEN '<P Class=ENCC>' ELSE '' END, repeat('x', 500), CASE WHEN p_size % 2 = 0 THEN '<p class=DECC>' WHEN p_size % 3 > 0 THEN '<P CLASS=ENCC>' ELSE '' END)")
    # With no class in front, the search from the start finds that of the last tenth: it is then the first one.
    text = F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 2 == 0), F.concat(F.lit("<P CLASS=noClass>"), text)).otherwise(text)
    rows = t("part").select("p_partkey", tx.sami_classes(text).alias("c"))
    return rows.select("p_partkey", "c.first", "c.second", tx.sami_language(F.lit("P CLASS=ENCC"), F.col("c")).alias("english"), tx.sami_language(F.lit("P Class=DECC"), F.col("c")).alias("german"))


@query("strip_nested", """
WITH p AS (SELECT page_id, unnest(regexp_extract_all('<a <b> c>' || html, '[<>]|[^<>]+')) AS x, generate_subscripts(regexp_extract_all('<a <b> c>' || html, '[<>]|[^<>]+'), 1) AS i FROM pages),
l AS (SELECT *, sum(CASE x WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS n FROM p)
SELECT page_id, string_agg(CASE WHEN n <> 0 OR x = '<' THEN '' WHEN x = '>' THEN ' ' ELSE x END, '' ORDER BY i) AS "text" FROM l GROUP BY page_id
""")
def strip_nested(t):
    return t("pages").select("page_id", tx.strip_nested_tags(F.concat(F.lit("<a <b> c>"), "html")).alias("text"))


@query("words_outside_tags", "SELECT page_id, coalesce(array_to_string(regexp_extract_all(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '[A-Za-z\\x{80}-\\x{10FFFF}]+'), ' '), '') AS words FROM pages WHERE html IS NOT NULL")
def words_outside_tags(t):
    return t("pages").where("html IS NOT NULL").select("page_id", tx.words_outside_tags(F.col("html")).alias("words"))
