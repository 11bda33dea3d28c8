"""Codec, pixel format and language look-ups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs as cd
from .registry import query


def _values(rows, *names: str) -> str:
    """A table of constants in SQL."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(names)}))"


def _numbered(table: str, *kinds) -> list[tuple]:
    return [(i, *(k(x) for k, x in zip(kinds, row, strict=True))) for i, row in enumerate(cd.rows_of(table))]


_REGISTRY = _values(cd.registry_rows(), "ord", "decoder", "name", "fourcc")
_MATROSKA = _values(_numbered(cd.MATROSKA, str, cd.fourcc), "ord", "codec_id", "fourcc")
_AUDIO = _values(_numbered(cd.AUDIO, cd.fourcc, str), "ord", "fourcc", "decoder")
_WAVE = _values(_numbered(cd.WAVE, lambda x: int(x, 16), cd.fourcc), "ord", "two", "fourcc")
_WRAPPED = _values(_numbered(cd.WRAPPED, cd.fourcc, cd.fourcc), "ord", "wrapped", "original")
_PIXELS = _values(_numbered(cd.PIXELS, str, str, cd.fourcc), "ord", "pixels", "shown", "code")
_LANGUAGES = _values(cd.language_rows(), "ord", "two", "three", "language")
_CODES = len(cd.registry_rows())


@query("codec_registry", _REGISTRY[1:-1], long="fourcc")
def codec_registry(t):
    return cd.registry(t("part").sparkSession)


@query("codec_decoders", f"SELECT p_partkey, coalesce((SELECT arg_min(decoder, ord) FROM {_REGISTRY} r WHERE r.fourcc = c.code), 'NONE') AS decoder FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN 7 ELSE (SELECT any_value(fourcc) FROM {_REGISTRY} r WHERE r.ord = p_partkey % {_CODES}) END AS code FROM part) c")
def codec_decoders(t):
    spark = t("part").sparkSession
    pick = cd.registry(spark).select(F.col("ord").cast("long").alias("k"), "fourcc")
    rows = t("part").select("p_partkey", "p_size", (F.col("p_partkey") % _CODES).alias("k")).join(pick, "k")
    rows = rows.select("p_partkey", F.when(F.col("p_size") == 1, 7).otherwise(F.col("fourcc")).alias("fourcc"))
    return cd.decoder_of(rows).select("p_partkey", "decoder")


_IDS = [*dict.fromkeys(r[0] for r in cd.rows_of(cd.MATROSKA)), "X_OTHER"]


@query("matroska_codes", f"""
WITH r AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN 'V_MS/VFW/FOURCC' WHEN 1 THEN 'A_MS/ACM' WHEN 2 THEN 'V_QUICKTIME' ELSE {_IDS}[p_partkey % {len(_IDS)} + 1] END AS id, CASE p_partkey % 4 WHEN 0 THEN 85 WHEN 1 THEN 8192 ELSE p_size END AS two FROM part)
SELECT p_partkey, CASE WHEN id = 'V_MS/VFW/FOURCC' THEN CASE WHEN p_size > 20 THEN 1482049860 ELSE 0 END WHEN id = 'A_MS/ACM' THEN coalesce((SELECT arg_min(fourcc, ord) FROM {_WAVE} w WHERE w.two = r.two), 1836253184 + two) WHEN id = 'V_QUICKTIME' THEN 1398165809
  ELSE coalesce((SELECT arg_min(fourcc, ord) FROM {_MATROSKA} m WHERE m.codec_id = id), 0) END AS fourcc FROM r
""", long="fourcc")
def matroska_codes(t):
    size = F.col("p_size")
    ids = F.array(*map(F.lit, _IDS))
    codec = F.when(size % 5 == 0, "V_MS/VFW/FOURCC").when(size % 5 == 1, "A_MS/ACM").when(size % 5 == 2, "V_QUICKTIME").otherwise(F.get(ids, (F.col("p_partkey") % len(_IDS)).cast("int")))
    two = F.when(F.col("p_partkey") % 4 == 0, 85).when(F.col("p_partkey") % 4 == 1, 8192).otherwise(size)
    bitmap = F.unhex(F.concat(F.repeat(F.lit("00"), 16), F.when(size > 20, F.hex(F.lit("XVID"))).otherwise("585649")))
    wave = F.unhex(F.concat(F.lpad(F.hex(two % 256), 2, "0"), F.lpad(F.hex(F.floor(two / 256)), 2, "0"), F.lit("00")))
    image = F.unhex(F.concat(F.hex(F.lit("SVQ1")), F.lit("00")))
    private = F.when(size % 5 == 0, bitmap).when(size % 5 == 1, wave).when(size % 5 == 2, image)
    return cd.matroska_code(t("part").select("p_partkey", codec.alias("codec_id"), private.alias("codec_private"))).select("p_partkey", "fourcc")


@query("matroska_ids", f"SELECT p_partkey, (SELECT arg_max(codec_id, ord) FROM {_MATROSKA} m WHERE m.fourcc = (SELECT any_value(r.fourcc) FROM {_REGISTRY} r WHERE r.ord = p_partkey % {_CODES})) AS codec_id FROM part")
def matroska_ids(t):
    pick = cd.registry(t("part").sparkSession).select(F.col("ord").cast("long").alias("k"), "fourcc")
    rows = t("part").select("p_partkey", (F.col("p_partkey") % _CODES).alias("k")).join(pick, "k").select("p_partkey", "fourcc")
    return cd.matroska_id(rows).select("p_partkey", "codec_id")


@query("audio_decoders", f"""
WITH r AS (SELECT p_partkey, (SELECT any_value(fourcc) FROM {_REGISTRY} r WHERE r.ord = p_partkey % {_CODES}) AS code, (SELECT any_value(decoder) FROM {_REGISTRY} r WHERE r.ord = p_partkey % {_CODES}) AS name FROM part)
SELECT p_partkey, coalesce((SELECT arg_min(decoder, ord) FROM {_AUDIO} a WHERE a.fourcc = code), 'NONE') AS decoder, coalesce((SELECT arg_min(fourcc, ord) FROM {_AUDIO} a WHERE a.decoder = name), 0) AS back FROM r
""", long="back")
def audio_decoders(t):
    pick = cd.registry(t("part").sparkSession).select(F.col("ord").cast("long").alias("k"), "fourcc", F.col("decoder").alias("name"))
    rows = t("part").select("p_partkey", (F.col("p_partkey") % _CODES).alias("k")).join(pick, "k")
    there = cd.audio_decoder_of(rows.select("p_partkey", "fourcc", "name")).select("p_partkey", "name", F.col("decoder").alias("to"))
    back = cd.audio_code_of(there.withColumnRenamed("name", "decoder"))
    return back.select("p_partkey", F.col("to").alias("decoder"), F.col("fourcc").alias("back"))


@query("wrapped_streams", f"""
WITH r AS (SELECT p_partkey, (SELECT any_value(fourcc) FROM {_REGISTRY} r WHERE r.ord = p_partkey % {_CODES}) AS code FROM part)
SELECT p_partkey, coalesce((SELECT arg_min(original, ord) FROM {_WRAPPED} w WHERE w.wrapped = code), 0) AS original, coalesce((SELECT arg_min(wrapped, ord) FROM {_WRAPPED} w WHERE w.original = code), 0) AS wrapped, code IN {cd.NEEDS_PRIVATE} AS needs_private FROM r
""", long="original wrapped")
def wrapped_streams(t):
    pick = cd.registry(t("part").sparkSession).select(F.col("ord").cast("long").alias("k"), "fourcc")
    rows = t("part").select("p_partkey", (F.col("p_partkey") % _CODES).alias("k")).join(pick, "k").select("p_partkey", "fourcc")
    return cd.unwrapped(rows).select("p_partkey", "original", "wrapped", cd.needs_private(F.col("fourcc")).alias("needs_private"))


_FORMATS = [*dict.fromkeys(r[0] for r in cd.rows_of(cd.PIXELS)), "PAL8"]


@query("pixel_formats", f"""
WITH r AS (SELECT p_partkey, p_size, {_FORMATS}[p_partkey % {len(_FORMATS)} + 1] AS f FROM part), j AS (SELECT p_partkey, p_size % 4 AS w, p_size % 3 AS h, f, shown, coalesce(code, 0) AS code FROM r LEFT JOIN {_PIXELS} p ON p.pixels = f)
SELECT p_partkey, shown, code, CASE WHEN f IN ('YUVJ420P', 'YUV420P', 'YUVA420P') THEN w < 2 OR h < 2 WHEN f = 'YUV422P' THEN h < 2 ELSE false END AS invalid, repeat(CASE shown WHEN 'YUV422P' THEN '8010' WHEN 'YUV444P' THEN '801080EB' WHEN 'RGB555BE' THEN '0000' WHEN 'RGB24' THEN '000000' WHEN 'ARGB' THEN '00000000' END, w * h) AS black FROM j
""", long="code")
def pixel_formats(t):
    f = F.get(F.array(*map(F.lit, _FORMATS)), (F.col("p_partkey") % len(_FORMATS)).cast("int"))
    w, h = F.col("p_size") % 4, F.col("p_size") % 3
    rows = cd.shown_as(t("part").select("p_partkey", "p_size", f.alias("pixels")))
    return rows.select("p_partkey", "shown", F.col("shown_code").alias("code"), cd.invalid_image(F.col("pixels"), w, h).alias("invalid"), F.hex(cd.cleared(F.col("shown"), w, h)).alias("black"))


@query("language_numbers", f"""
WITH r AS (SELECT c_custkey, chr(97 + (c_custkey % 26)::INT) || chr(65 + (c_custkey // 26 % 26)::INT) AS two, (SELECT any_value(three) FROM {_LANGUAGES} l WHERE l.ord = c_custkey % {len(cd.language_rows()) + 5}) AS three FROM customer)
SELECT c_custkey, coalesce((SELECT arg_min(language, ord) FROM {_LANGUAGES} l WHERE l.two = lower(r.two)), {cd.UNSPECIFIED}) AS short, coalesce((SELECT arg_min(language, ord) FROM {_LANGUAGES} l WHERE l.three = r.three), {cd.UNSPECIFIED}) AS long FROM r
""")
def language_numbers(t):
    k = F.col("c_custkey")
    names = F.array(*(F.lit(r[2]) for r in cd.language_rows()))
    two = F.concat(F.char(k % 26 + 97), F.char(F.floor(k / 26) % 26 + 65))
    rows = t("customer").select("c_custkey", two.alias("two"), F.upper(F.get(names, (k % (len(cd.language_rows()) + 5)).cast("int"))).alias("three"))
    rows = cd.language_number(rows, "two").withColumnRenamed("language", "short")
    return cd.language_number(rows, "three").select("c_custkey", "short", F.col("language").alias("long"))


@query("cropped_pictures", "SELECT p_partkey, repeat(repeat('AB', p_size), 3) AS \"rows\" FROM part")
def cropped_pictures(t):
    row = F.concat(F.expr("repeat('AB', p_size)"), F.expr("repeat('00', 64 - p_size)"))
    return t("part").select("p_partkey", F.hex(cd.cropped_rows(F.unhex(F.repeat(row, 3)), F.lit(64), F.col("p_size"), F.lit(3))).alias("rows"))


@query("image_descriptions", "SELECT p_partkey, 86 + p_size % 2 AS size, substr(p_brand, 1, 4) AS code, p_size * 16 AS width, p_size * 9 AS height, 1 AS frames, 24 AS depth, p_size % 2 = 1 AS extended FROM part", long="size width height frames depth")
def image_descriptions(t):
    h = lambda v, n: f"lpad(hex({v}), {n}, '0')"
    data = F.expr(f"unhex(concat({h('86 + p_size % 2', 8)}, hex(substring(p_brand, 1, 4)), repeat('00', 24), {h('p_size * 16', 4)}, {h('p_size * 9', 4)}, repeat('00', 12), '0001', repeat('00', 32), '0018', 'FFFF', repeat('00', p_size % 2)))")
    return t("part").select("p_partkey", cd.image_description(data).alias("d")).select("p_partkey", "d.*")


@query("packed_tables", "SELECT p_partkey, (p_size * 4) & 15 AS four, p_size & 255 AS eight, (p_size * 256) & 65535 AS sixteen FROM part", long="four eight sixteen")
def packed_tables(t):
    size = F.col("p_size").cast("long")
    i = F.col("p_partkey") % 4
    lane = lambda value, n: cd.packed_lane(F.array(F.lit(-1).cast("long"), value.bitwiseAND(F.lit((1 << n) - 1)) * F.pow(F.lit(2), i % (32 // n) * n).cast("long")), 32 // n + i % (32 // n), n)
    return t("part").select("p_partkey", lane(size * 4, 4).alias("four"), lane(size, 8).alias("eight"), lane(size * 256, 16).alias("sixteen"))
