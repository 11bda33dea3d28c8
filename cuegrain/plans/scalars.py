"""Scalar text and header functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, text
from .registry import millis, query


@query("parse_subtime", r"""
WITH s AS (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN '00:01' ELSE strftime(ts, '%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN ',' ELSE '.' END || CAST(event_id % 1000 AS VARCHAR) END AS s FROM events)
SELECT event_id, CASE WHEN regexp_matches(s, '^\d+:\d+:\d+[,.:]\d+') THEN ((CAST(split_part(s, ':', 1) AS BIGINT) * 60 + CAST(split_part(s, ':', 2) AS BIGINT)) * 60 + CAST(regexp_extract(s, ':(\d+)[,.]', 1) AS BIGINT)) * 1000 + CAST(regexp_extract(s, '[,.](\d+)$', 1) AS BIGINT) ELSE 0 END AS ticks FROM s
""")
def parse_subtime(t):
    s = F.when(F.col("event_id") % 10 == 9, "00:01").otherwise(F.concat(F.date_format("ts", "HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, ",").otherwise("."), (F.col("event_id") % 1000).cast("string")))
    return t("events").select("event_id", text.parse_subtime(s, 1000).alias("ticks"))


@query("filename_language", r"SELECT doc_id, CASE WHEN regexp_matches(source || '.' || lang, '[.][A-Za-z]{2,3}$') THEN lower(lang) END AS lang FROM documents")
def filename_language(t):
    name = F.concat("source", F.lit("."), "lang", F.lit(".srt"))
    return t("documents").select("doc_id", text.filename_language(name).alias("lang"))


@query("packet_lines", "SELECT conv_id, turn, concat_ws(',', turn + 1, 0, role, coalesce(nullif(role, 'user'), '(null)'), '0000', text) AS line FROM conversations")
def packet_lines(t):
    return t("conversations").select("conv_id", "turn", text.packet_line(F.col("turn"), F.lit(0), F.col("role"), F.nullif(F.col("role"), F.lit("user")), F.lit("0000"), F.col("text")).alias("line"))


@query("override_colours", r"SELECT p_partkey, '{\1c&H' || CASE WHEN p_partkey % 7 = 0 THEN 'FFFFFF' ELSE upper(substr(md5(p_name), 5, 2) || substr(md5(p_name), 3, 2) || substr(md5(p_name), 1, 2)) END || '&}' AS tag FROM part")
def override_colours(t):
    rgb = F.when(F.col("p_partkey") % 7 == 0, "red-ish").otherwise(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)))
    return t("part").select("p_partkey", text.override_colour(rgb).alias("tag"))


@query("sync_starts", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 10 END AS start FROM events")
def sync_starts(t):
    tag = F.when(F.col("event_id") % 5 == 0, "SYNC START=x").otherwise(F.concat(F.lit("Sync Start="), (F.col("event_id") * 10).cast("string")))
    return t("events").select("event_id", text.sync_start(tag).alias("start"))


@query("newlines", "SELECT doc_id, replace(text, '.', chr(10)) AS text FROM documents")
def newlines(t):
    mixed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\r ")), F.lit("."), F.lit("\r\n"))
    return t("documents").select("doc_id", text.one_newline(mixed).alias("text"))


@query("markup_space", "SELECT page_id, replace(replace(replace(html, chr(10), ''), chr(13), ''), '&nbsp;', ' ') AS text FROM pages")
def markup_space(t):
    return t("pages").select("page_id", text.sami_space(F.col("html")).alias("text"))


@query("split_fields", "WITH p AS (SELECT conv_id, turn, string_split(text, ',') AS p FROM conversations) SELECT conv_id, turn, len(p) AS n, trim(p[1], ' ') AS first, CASE WHEN len(p) >= 3 THEN array_to_string(list_slice(p, 3, len(p)), ',') END AS rest FROM p")
def split_fields(t):
    every, three = text.split_trim(F.col("text"), ","), text.split_n(F.col("text"), ",", 3)
    return t("conversations").select("conv_id", "turn", F.size(every).cast("long").alias("n"), F.element_at(every, 1).alias("first"), F.get(three, 2).alias("rest"))


@query("row_arity", "SELECT conv_id, turn FROM conversations WHERE len(string_split(text, ',')) >= 4")
def row_arity(t):
    return t("conversations").where(F.size(text.split_n(F.col("text"), ",", 4)) == 4).select("conv_id", "turn")


@query("subtitle_tags", r"SELECT page_id, replace(replace(replace(replace(html, '<i>', '{\i1}'), '</i>', '{\i0}'), '<', '{'), '>', '}') AS text FROM pages")
def subtitle_tags(t):
    return t("pages").select("page_id", text.srt_tags(F.col("html")).alias("text"))


@query("cue_escapes", r"SELECT doc_id, replace(replace(text, ' ', chr(10)), 'q', chr(160)) AS text FROM documents")
def cue_escapes(t):
    raw = F.replace(F.replace(F.regexp_replace("text", r"\\", ""), F.lit(" "), F.lit("\\N")), F.lit("q"), F.lit("\\h"))
    return t("documents").select("doc_id", text.cue_escapes(raw).alias("text"))


@query("packed_colours", "SELECT p_partkey, round((p_partkey * 7919 & 255) / 255.0, 6) AS r, round(((p_partkey * 7919) >> 8 & 255) / 255.0, 6) AS g, round(((p_partkey * 7919) >> 16 & 255) / 255.0, 6) AS b, round(1 - ((p_partkey * 7919) >> 24 & 255) / 255.0, 6) AS a FROM part")
def packed_colours(t):
    c = text.colour_number(F.concat(F.lit("&H"), F.hex(F.col("p_partkey") * 7919), F.lit("&")))
    return t("part").select("p_partkey", *(F.round(v, 6).alias(k) for k, v in text.colour_parts(c).items()))


@query("alignments", "WITH a AS (SELECT p_partkey, p_partkey % 12 AS s FROM part), b AS (SELECT *, CASE WHEN s BETWEEN 9 AND 11 THEN s - 5 WHEN s BETWEEN 5 AND 7 THEN s + 2 ELSE s END AS n FROM a) SELECT p_partkey, n AS numpad, CASE WHEN n BETWEEN 1 AND 9 THEN (n - 1) % 3 ELSE 1 END AS h, CASE WHEN n BETWEEN 1 AND 9 THEN (n - 1) // 3 ELSE 0 END AS v FROM b")
def alignments(t):
    n = text.ass_alignment(F.col("p_partkey") % 12)
    h, v = text.alignment_parts(n)
    return t("part").select("p_partkey", n.alias("numpad"), h.alias("h"), v.cast("long").alias("v"))


@query("version_tokens", r"SELECT p_partkey, array_to_string(regexp_extract_all(CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 9 AS VARCHAR) || 'b2', '\d+|[.]|[^\d.]+'), '/') AS parts FROM part")
def version_tokens(t):
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit("b2"))
    return t("part").select("p_partkey", F.array_join(text.version_parts(v), "/").alias("parts"))


@query("older_versions", "WITH v AS (SELECT p_partkey, '1.' || (p_size % 4) || CASE WHEN p_partkey % 3 = 0 THEN 'b1' ELSE '' END AS a, '1.' || (p_partkey % 4) AS b FROM part) SELECT p_partkey, CASE WHEN starts_with(b, a || 'b') THEN false ELSE a < b OR starts_with(a, b || 'b') END AS older FROM v")
def older_versions(t):
    a = F.concat(F.lit("1."), (F.col("p_size") % 4).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "b1").otherwise(""))
    return t("part").select("p_partkey", text.is_older(a, F.concat(F.lit("1."), (F.col("p_partkey") % 4).cast("string"))).alias("older"))


@query("newer_versions", "SELECT p_partkey, p_size > p_partkey % 40 OR (p_size = p_partkey % 40 AND p_partkey % 7 > 3) AS newer FROM part")
def newer_versions(t):
    v = lambda a, b: F.concat(a.cast("string"), F.lit("."), b.cast("string"))
    return t("part").select("p_partkey", text.newer_than(v(F.col("p_size"), F.col("p_partkey") % 7), v(F.col("p_partkey") % 40, F.lit(3))).alias("newer"))


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^<>]*>', ' ', 'g') AS text FROM pages")
def strip_html(t):
    return t("pages").select("page_id", text.strip_flat_tags(F.col("html")).alias("text"))


@query("trimmed", "SELECT conv_id, turn, trim(coalesce(text, ''), ' ') = '' AS empty FROM conversations")
def trimmed(t):
    return t("conversations").select("conv_id", "turn", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))


@query("substituted", "SELECT doc_id, regexp_replace(text, '[.,;:!?]', '_', 'g') AS text FROM documents")
def substituted(t):
    return t("documents").select("doc_id", F.translate("text", ".,;:!?", "______").alias("text"))


@query("fourcc_texts", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '0x' || lower(printf('%X', p_partkey)) ELSE chr(65 + CAST(p_partkey % 26 AS INTEGER)) || 'VC' || chr(48 + CAST(p_size % 10 AS INTEGER)) END AS fourcc FROM part")
def fourcc_texts(t):
    n = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey")).otherwise((F.lit(65) + F.col("p_partkey") % 26) * 16777216 + 0x564300 + 48 + F.col("p_size") % 10)
    return t("part").select("p_partkey", text.fourcc_text(n).alias("fourcc"))


@query("css_names", "SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM part")
def css_names(t):
    return t("part").select("p_partkey", text.css_name(F.concat("p_brand", F.lit(" "), "p_name")).alias("name"))


@query("font_direction", "SELECT p_partkey, p_partkey % 3 = 0 AS vertical, p_name AS font FROM part")
def font_direction(t):
    raw = F.concat(F.when(F.col("p_partkey") % 3 == 0, "@").otherwise(""), F.col("p_name"))
    return t("part").select("p_partkey", raw.startswith("@").alias("vertical"), F.regexp_replace(raw, "^@", "").alias("font"))


@query("feed_version", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END, CAST(o_custkey AS VARCHAR)) AS version FROM orders")
def feed_version(t):
    url = F.concat(F.lit("http://x/app_"), F.col("o_custkey").cast("string"), F.lit(".zip"))
    attribute = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    item = F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", F.coalesce(attribute, item, F.regexp_replace(F.substring_index(url, "_", -1), r"\.[^.]*$", "")).alias("version"))


@query("release_notes", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'link' WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url END AS notes FROM pages")
def release_notes(t):
    return t("pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "link").when(F.col("url").rlike("^https?://"), F.col("url")).alias("notes"))


@query("high_byte_words", "SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z\\x{80}-\\x{10FFFF}]+'), lambda w: regexp_matches(w, '[^\\x00-\\x7F]')), lambda w: w || ' '), '') AS words FROM documents")
def high_byte_words(t):
    return t("documents").select("doc_id", text.words_with_high_bytes(F.col("text")).alias("words"))


@query("first_words", "SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS head FROM documents")
def first_words(t):
    return t("documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("head"))


@query("script_type", "SELECT p_partkey, lower(CASE WHEN p_size % 2 = 0 THEN 'V4.00+' ELSE 'v4.00' END) = 'v4.00+' AS is_ass FROM part")
def script_type(t):
    return t("part").select("p_partkey", (F.lower(F.when(F.col("p_size") % 2 == 0, "V4.00+").otherwise("v4.00")) == "v4.00+").alias("is_ass"))


@query("ntsc_snap", """
WITH r AS (SELECT p_partkey, 1000 AS num, 23000 + p_partkey % 8000 AS den FROM part), x AS (SELECT *, CAST(den AS DOUBLE) / num AS rate, floor(CAST(den AS DOUBLE) / num * 1.001 + 0.5) AS n FROM r),
s AS (SELECT *, abs(rate - n * 1000 / 1001) < 1.0 / 120 AND NOT abs(rate - floor(rate + 0.5)) < 1e-9 AS snap FROM x)
SELECT p_partkey, CAST(CASE WHEN snap THEN 1001 ELSE num END AS BIGINT) AS num, CAST(CASE WHEN snap THEN n * 1000 ELSE den END AS BIGINT) AS den FROM s
""")
def ntsc_snap(t):
    return t("part").select("p_partkey", media.ntsc_snap(F.lit(1000), F.lit(23000) + F.col("p_partkey") % 8000).alias("s")).select("p_partkey", "s.num", "s.den")


@query("time_scales", "SELECT p_partkey, CASE WHEN p_partkey * 1000 > 100000 THEN CAST(round(p_size * 1000.0) AS BIGINT) ELSE p_partkey * 1000 END AS scale FROM part")
def time_scales(t):
    return t("part").select("p_partkey", media.time_scale(F.col("p_partkey") * 1000, F.col("p_size").cast("double")).alias("scale"))


@query("rescale", "SELECT event_id, ((epoch_us(ts) // 1000) % 10000000) * 600 // 1000 AS ticks FROM events")
def rescale(t):
    return t("events").select("event_id", (millis("ts") % 10_000_000).alias("ms")).select("event_id", media.rescale("ms", "600", "1000").alias("ticks"))


@query("samples_per_packet", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) * 1152 // 7 AS n FROM lineitem")
def samples_per_packet(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("cast(l_quantity as bigint) * 1152 div 7").alias("n"))


@query("header_restore", "SELECT doc_id, sha256('<hdr>' || text) AS whole FROM documents")
def header_restore(t):
    return t("documents").select("doc_id", F.sha2(F.concat(F.encode(F.lit("<hdr>"), "UTF-8"), F.encode("text", "UTF-8")), 256).alias("whole"))


@query("palette", "SELECT p_partkey, CAST(('0x' || substr(md5(p_name), 1, 6)) AS BIGINT) AS c0, CAST(('0x' || substr(md5(p_name), 7, 6)) AS BIGINT) AS c1 FROM part")
def palette(t):
    line = F.concat(F.lit("palette: "), F.substring(F.md5("p_name"), 1, 6), F.lit(", "), F.substring(F.md5("p_name"), 7, 6))
    got = F.transform(F.regexp_extract_all(F.regexp_replace(line, "^palette:", ""), F.lit("([0-9a-fA-F]{6})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    return t("part").select("p_partkey", F.get(got, 0).alias("c0"), F.get(got, 1).alias("c1"))


@query("clamps", "SELECT s_suppkey, least(greatest(CAST(round(s_acctbal) AS BIGINT), 0), 4) AS drc FROM supplier")
def clamps(t):
    return t("supplier").select("s_suppkey", media.clamp(F.round("s_acctbal").cast("long"), 0, 4).alias("drc"))


@query("display_sizes", """
WITH s AS (SELECT p_partkey, 720 AS w, 480 + p_size AS h, 1 + p_partkey % 16 AS dw, 1 + p_partkey % 9 AS dh FROM part)
SELECT p_partkey, CAST(CASE WHEN dw * h >= dh * w THEN round(CAST(h * dw AS DOUBLE) / dh) ELSE w END AS BIGINT) AS w, CAST(CASE WHEN dw * h >= dh * w THEN h ELSE round(CAST(w * dh AS DOUBLE) / dw) END AS BIGINT) AS h FROM s
""")
def display_sizes(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", media.display_size(F.lit(720), F.col("p_size") + 480, k % 16 + 1, k % 9 + 1).alias("s")).select("p_partkey", "s.w", "s.h")


@query("colour_spaces", "WITH s AS (SELECT p_partkey, 720 AS w, 400 + p_partkey % 400 AS h FROM part), k AS (SELECT p_partkey, CASE WHEN h > 576 THEN 'HD' WHEN h = 576 OR w * 4 = h * 5 THEN 'PAL' ELSE 'NTSC' END AS kind FROM s) SELECT p_partkey, kind, CASE kind WHEN 'HD' THEN 1 WHEN 'PAL' THEN 5 ELSE 6 END AS primaries FROM k")
def colour_spaces(t):
    return t("part").select("p_partkey", media.colour_space(F.lit(720), F.col("p_partkey") % 400 + 400).alias("s")).select("p_partkey", "s.kind", "s.primaries")


@query("pixel_aspects", "WITH s AS (SELECT p_partkey, CAST((1 + p_partkey % 16) * (100 + p_size) AS BIGINT) AS a, CAST((1 + p_partkey % 9) * 160 AS BIGINT) AS b FROM part) SELECT p_partkey, CASE WHEN a <> b THEN a // gcd(a, b) END AS h, CASE WHEN a <> b THEN b // gcd(a, b) END AS v FROM s")
def pixel_aspects(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", media.pixel_aspect(F.lit(160), F.col("p_size") + 100, k % 16 + 1, k % 9 + 1).alias("s")).select("p_partkey", "s.h", "s.v")


@query("script_resolutions", """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 640 * (1 + p_size % 2) END AS x, CASE WHEN p_partkey % 2 <> 0 THEN 512 * (1 + p_size % 2) END AS y FROM part)
SELECT p_partkey, CAST(coalesce(x, CASE WHEN y IS NULL THEN 384 WHEN y = 1024 THEN 1280 ELSE y * 4 // 3 END) AS BIGINT) AS w, CAST(coalesce(y, CASE WHEN x IS NULL THEN 288 WHEN x = 1280 THEN 1024 ELSE x * 3 // 4 END) AS BIGINT) AS h FROM s
""")
def script_resolutions(t):
    k, s = F.col("p_partkey"), F.col("p_size") % 2 + 1
    return t("part").select("p_partkey", media.script_resolution(F.when(k % 3 != 0, s * 640), F.when(k % 2 != 0, s * 512)).alias("s")).select("p_partkey", "s.w", "s.h")


@query("audio_defaults", "SELECT p_partkey, CASE WHEN p_partkey * 100 > 24000 THEN 1152 ELSE 576 END AS frames, p_size NOT IN (3, 7) AS known FROM part")
def audio_defaults(t):
    return t("part").select("p_partkey", media.mp3_frames(F.col("p_partkey") * 100).alias("frames"), (~F.col("p_size").isin(3, 7)).alias("known"))


@query("decodability", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_size * 3 < 100 AND p_partkey % 4 < 2 AND NOT p_partkey % 2 = 0 THEN 1 ELSE 2 END AS ability FROM part")
def decodability(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", media.decodability(F.col("p_size") * 3, k % 4, k % 5 != 0, k % 2 == 0).alias("ability"))


@query("frame_kinds", "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'key' WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN 'droppable' ELSE 'difference' END AS class FROM events")
def frame_kinds(t):
    k = F.col("event_id")
    return t("events").select("event_id", media.frame_class(F.when(F.col("event_type") == "click", "I").otherwise("B"), k % 2 == 1, k % 3 == 0, F.lit("none")).alias("class"))


@query("renderable_packets", "SELECT doc_id FROM documents WHERE text <> chr(10) AND strlen(text) <= 1048576")
def renderable_packets(t):
    return t("documents").where((F.col("text") != "\n") & (F.octet_length("text") <= 1_048_576)).select("doc_id")


@query("white_list", "SELECT c_custkey, list_contains(CASE WHEN c_custkey % 2 = 0 THEN ['FURNITURE'] ELSE ['BUILDING', 'MACHINERY'] END, c_mktsegment) AS listed FROM customer")
def white_list(t):
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("FURNITURE")))
    return t("customer").select("c_custkey", F.array_contains(F.coalesce(own, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))), F.col("c_mktsegment")).alias("listed"))


@query("update_eligible", "SELECT o_orderkey FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey > 100 AND o_orderstatus = 'O'")
def update_eligible(t):
    return t("orders").where((F.col("o_custkey") % 3 > 0) & (F.col("o_orderkey") > 100) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("charset_udf")
def charset_udf(t):
    """Texts in the old encoding of their language, and what the detector says of them (no SQL: a detector of encodings)."""
    from ..functions.charset import detect_charset

    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return t("documents").select("doc_id", detect_charset(raw).alias("d")).select("doc_id", "d.charset", F.round("d.confidence", 6).alias("confidence"))
