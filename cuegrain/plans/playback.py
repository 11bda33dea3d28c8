"""Screens, samples, turns of reading, letter pairs and pictures on the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import bits
from ..operators import lookup, stats, timeline
from ..sources import containers, subtitles
from ..streaming import release
from .registry import query

# ---------------------------------------------------------------- subtitles on screen


@query("screen_html", """
SELECT p_partkey, '<div class="screen">' || chr(10)
  || CASE WHEN p_size % 2 = 0 THEN '<div class="top">' || chr(10) || '<span class="A_B">one &amp; two</span>' || chr(10) || '</div>' || chr(10) ELSE '' END
  || '<div class="bottom">' || chr(10) || CASE WHEN p_size % 2 = 1 THEN '' ELSE '' END || '<span class="S"><span style="font-weight: bold">' || p_brand || '</span></span>' || chr(10) || '<span class="S">x<br>&lt;</span>' || chr(10) || '</div>' || chr(10)
  || '<div style="top: ' || p_size || 'px; left: 7px; position: absolute"><span class="S">' || p_type || '</span></div>' || chr(10) || '</div>' || chr(10) || '<br>' || chr(10) AS html FROM part
""")
def screen_html(t):
    span = lambda text, css="": F.struct(F.lit(css).alias("css"), text.alias("text"))
    div = lambda place, style, text, css="": F.struct(F.lit(place).alias("place"), F.lit(7).alias("x"), F.col("p_size").alias("y"), F.lit(style).alias("style"), F.array(span(text, css)).alias("spans"))
    divs = F.array(div("absolute", "S", F.col("p_type")), div("bottom", "S", F.lit("x\n<")), div("top", "A.B", F.lit("one & two")), div("bottom", "S", F.col("p_brand"), "font-weight: bold"))
    divs = F.filter(divs, lambda d: (d["place"] != "top") | (F.col("p_size") % 2 == 0))
    return t("part").select("p_partkey", subtitles.screen_html(divs).alias("html"))


@query("default_styles", "SELECT p_partkey, round(32 * sqrt(p_size / 10.0 / (4 / 3.0)), 6) AS size, 'Helvetica' AS font, 20 AS margin, 1.5::DOUBLE AS outline FROM part")
def default_styles(t):
    return t("part").select("p_partkey", subtitles.default_style(F.col("p_size") / 10.0).alias("s")).select("p_partkey", F.round("s.size", 6).alias("size"), "s.font", "s.margin", "s.outline")


@query("vobsub_samples", "SELECT p_partkey AS file, 1 AS track, i * 1000 AS ts, repeat(upper(printf('%02X', i)), CASE WHEN i = 2 THEN 5 ELSE p_size END) AS sample FROM (SELECT *, unnest([0, 1, 2]) AS i FROM part) WHERE i <> 1 UNION ALL SELECT p_partkey, 1, 1000, repeat('01', p_size) FROM part", long="track ts")
def vobsub_samples(t):
    text = F.expr(r"concat('id: en, index: 0\n', array_join(transform(sequence(0, 2), i -> format_string('timestamp: 00:00:%02d:000, filepos: %09x\n', i, i * p_size)), ''))")
    index = subtitles.vobsub_index(t("part").select(F.col("p_partkey").alias("file"), text.alias("text")))
    files = t("part").select(F.col("p_partkey").alias("file"), F.expr("unhex(concat(repeat('00', p_size), repeat('01', p_size), repeat('02', 5)))").alias("content"))
    return subtitles.vobsub_samples(index, files).select("file", "track", "ts", F.hex("sample").alias("sample"))


@query("font_names", """
WITH f AS (SELECT p_partkey AS ord, p_brand AS family, p_type AS platform FROM part WHERE p_size > 45), r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN upper(p_brand) ELSE 'none' END AS name FROM part)
SELECT p_partkey, coalesce((SELECT arg_min(family, ord) FROM f WHERE family = name), (SELECT arg_min(family, ord) FROM f WHERE platform = name), (SELECT arg_min(family, ord) FROM f WHERE lower(family) = lower(name)), 'Helvetica') AS font FROM r
""")
def font_names(t):
    fonts = t("part").where("p_size > 45").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("family"), F.col("p_type").alias("platform"))
    name = F.expr("CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN upper(p_brand) ELSE 'none' END")
    return lookup.font_names(t("part").select("p_partkey", name.alias("name")), fonts, "Helvetica").select("p_partkey", "font")


# ---------------------------------------------------------------- reading while a file arrives


@query("scan_turns", "SELECT event_id, CASE WHEN n < 3 THEN 0 ELSE 1 + (n - 3) // 10 END AS turn FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)", int_="turn")
def scan_turns(t):
    return timeline.scan_turns(t("events").select("event_id", "user_id"), "user_id", "event_id", 3, 10).select("event_id", "turn")


@query("read_before_margin", """
WITH p AS (SELECT p_brand AS file, p_partkey AS pos, p_size AS size, (SELECT max(p_partkey) FROM part) // 2 AS available FROM part),
n AS (SELECT *, available - pos - size < 8 * max(size) OVER w AND count(*) OVER w >= 2 AS near FROM p WINDOW w AS (PARTITION BY file ORDER BY pos))
SELECT file, pos FROM (SELECT *, coalesce(bool_or(near) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM n) WHERE NOT stopped
""")
def read_before_margin(t):
    last = t("part").agg(F.max("p_partkey")).scalar()
    rows = t("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("pos"), F.col("p_size").cast("long").alias("size"), F.floor(last / 2).alias("available"), (last * 2).alias("total"))
    return timeline.before_margin(rows, "file", "available", "total", least=2).select("file", "pos")


@query("placeholder_tracks", "SELECT p_partkey AS file, p_size * 20 AS start, 500 - p_size * 20 AS duration FROM part WHERE p_size < 25")
def placeholder_tracks(t):
    return timeline.placeholders(t("part").select(F.col("p_partkey").alias("file"), (F.col("p_size") * 20).alias("loaded"), F.lit(500).alias("duration")))


@query("load_states", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'complete' WHEN p_size > 10 AND p_partkey % 50 * 1000 < 34000 THEN 'playthrough' WHEN p_size > 5 THEN 'playable' ELSE 'loading' END AS state, p_size % 2 = 0 AND p_size > 20 OR p_partkey % 10 < 5 AS publish FROM part")
def load_states(t):
    rows = t("part").select("p_partkey", F.when(F.col("p_size") <= 5, 0).otherwise(F.col("p_size") * 1000).alias("loaded"), F.lit(40000).alias("duration"), (F.col("p_partkey") % 50 * 1000).alias("eta"), F.col("p_size").alias("idles"), (F.col("p_size") % 2 == 0).alias("paused"), (F.col("p_partkey") % 10 * 1000).alias("ahead"))
    return rows.select("p_partkey", release.load_state().alias("state"), release.publish_now().alias("publish"))


# ---------------------------------------------------------------- feeds, inventories, export


@query("feed_items", "SELECT p_partkey AS file, i AS num, p_brand || ' ' || i AS title, '1.' || (10 * i) AS version, 'http://x/' || p_size || '.zip' AS url FROM (SELECT *, unnest(range(0, p_size % 3 + 1)) AS i FROM part)", int_="num")
def feed_items(t):
    item = "format_string('<item><title>%s %d</title><enclosure url=\"http://x/%d.zip\" version=\"1.%d\" length=\"7\"/></item>', p_brand, i, p_size, 10 * i)"
    text = F.expr(f"concat('<rss><channel>', array_join(transform(sequence(0, p_size % 3), i -> {item}), '\\n'), '</channel></rss>')")
    items = containers.feed_items(t("part").select(F.col("p_partkey").alias("file"), text.alias("text")))
    return items.select("file", "num", "title", F.col("enclosure._version").alias("version"), F.col("enclosure._url").alias("url"))


@query("tag_attributes", "SELECT p_partkey, p_type AS name, p_size::VARCHAR AS size, 2 AS n FROM part")
def tag_attributes(t):
    tag = F.expr("concat('<part size=\"0\" p:name = \\'', p_type, '\\' size=\"', p_size, '\"/>')")
    rows = t("part").select("p_partkey", containers.attributes(tag).alias("a"))
    return rows.select("p_partkey", F.col("a")["p:name"].alias("name"), F.col("a")["size"].alias("size"), F.size("a").alias("n"))


@query("component_inventory", "SELECT CASE p_size % 3 WHEN 0 THEN 'codec' ELSE 'import' END AS kind, p_brand AS dir, p_partkey || '.' || CASE p_size % 3 WHEN 0 THEN 'component' ELSE 'bundle' END AS name FROM part WHERE p_size % 3 < 2 AND p_brand = (SELECT min(p_brand) FROM part)")
def component_inventory(t):
    ext = F.expr("CASE p_size % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'bundle' ELSE 'txt' END")
    files = t("part").select(F.col("p_brand").alias("dir"), F.concat(F.col("p_partkey").cast("string"), F.lit("."), ext).alias("name"))
    least = t("part").agg(F.min("p_brand")).first()[0]
    return containers.inventory(files, [("codec", least, "component"), ("import", least, "bundle")])


@query("track_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, true AS has_uid FROM events", int_="number")
def track_numbers(t):
    return timeline.track_table(t("events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "number", (F.col("uid") > 0).alias("has_uid"))


@query("cue_samples", "SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number, p_partkey AS start, p_size AS duration, upper(printf('%04X', length(p_type))) || hex(p_type::BLOB) AS data FROM part", long="duration", int_="number")
def cue_samples(t):
    packets = t("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_type").alias("text"))
    return timeline.cue_samples(packets).withColumn("data", F.hex("data"))


# ---------------------------------------------------------------- letter pairs and two-byte characters

_LETTERS = {c: i for i, c in enumerate("etaoinshrdlu")}
_MATRIX = [(a * 3 + b * 5) % 4 for a in range(12) for b in range(12)]


@query("pair_categories", """
WITH p AS (SELECT p_partkey, p_type, unnest(range(1, length(p_type))) AS i FROM part), q AS (SELECT p_partkey, strpos('etaoinshrdlu', substr(lower(p_type), i, 1)) - 1 AS a, strpos('etaoinshrdlu', substr(lower(p_type), i + 1, 1)) - 1 AS b FROM p),
c AS (SELECT p_partkey, count(*) FILTER (WHERE a >= 0 AND b >= 0) AS total, count(*) FILTER (WHERE a >= 0 AND b >= 0 AND (a * 3 + b * 5) % 4 = 0) AS zero, count(*) FILTER (WHERE a >= 0 AND b >= 0 AND (a * 3 + b * 5) % 4 = 3) AS three FROM q GROUP BY p_partkey)
SELECT p_partkey, zero, three, CASE WHEN total > 4 THEN (total - zero) / total ELSE -1.0 END AS share FROM c
""")
def pair_categories(t):
    counts = stats.pair_categories(F.lower("p_type"), _LETTERS, _MATRIX, len(_LETTERS))
    rows = t("part").where("length(p_type) > 1").select("p_partkey", counts.alias("n"))
    return rows.select("p_partkey", F.get("n", 0).alias("zero"), F.get("n", 3).alias("three"), stats.pair_share(F.col("n")).alias("share"))


@query("two_byte_orders", """
WITH c AS (SELECT p_partkey, 129 + p_partkey % 126 AS a, 64 + p_size * 3 AS b FROM part)
SELECT p_partkey, CASE WHEN a >= 161 AND b >= 161 THEN (a - 161) * 94 + b - 161 ELSE -1 END AS euc_jp, CASE WHEN a >= 176 AND b >= 161 THEN (a - 176) * 94 + b - 161 ELSE -1 END AS euc_kr, CASE WHEN a >= 196 AND b >= 161 THEN (a - 196) * 94 + b - 161 ELSE -1 END AS euc_tw,
  CASE WHEN a < 164 THEN -1 WHEN b >= 161 THEN 157 * (a - 164) + b - 98 ELSE 157 * (a - 164) + b - 64 END AS big5, CASE WHEN b > 127 OR a = 160 OR (a > 159 AND a < 224) OR a > 239 THEN -1 ELSE 188 * (CASE WHEN a < 160 THEN a - 129 ELSE a - 193 END) + b - 64 END AS sjis FROM c
""")
def two_byte_orders(t):
    a, b = F.col("p_partkey") % 126 + 129, F.col("p_size") * 3 + 64
    names = {"euc_jp": "EUC-JP", "euc_kr": "EUC-KR", "euc_tw": "EUC-TW", "big5": "Big5", "sjis": "Shift_JIS"}
    return t("part").select("p_partkey", *(stats.two_byte_order(v, a, b).alias(k) for k, v in names.items()))


# ---------------------------------------------------------------- pictures and sound

_KINDS = {
    # pixels: planes of a picture of 4 by 4 (y: one byte), and what is shown
    "YUV420P": ("repeat(y, 16) || 'A0A1B0B1' || 'C0C1D0D1'", "repeat('A0' || y || 'C0' || y || 'A1' || y || 'C1' || y, 2) || repeat('B0' || y || 'D0' || y || 'B1' || y || 'D1' || y, 2)"),
    "YUV422P": ("repeat(y, 16) || repeat('A0A1', 4) || repeat('C0C1', 4)", "repeat('A0' || y || 'C0' || y || 'A1' || y || 'C1' || y, 4)"),
    "YUV410P": ("repeat(y, 16) || 'A0' || 'C0'", "repeat('A0' || y || 'C0' || y, 8)"),
    "YUVA420P": ("repeat(y, 16) || 'A0A1B0B1' || 'C0C1D0D1' || repeat('FF', 16)", "repeat(repeat('A0' || y || 'C0FF', 2) || repeat('A1' || y || 'C1FF', 2), 2) || repeat(repeat('B0' || y || 'D0FF', 2) || repeat('B1' || y || 'D1FF', 2), 2)"),
    "YUV420P10LE": ("repeat('00' || '02', 16) || repeat('0001', 4) || repeat('0003', 4)", "repeat('4080C080', 8)"),
    "BGR24": ("repeat(y || '0102', 16)", "repeat('0201' || y, 16)"),
    "RGB555LE": ("repeat(y || '01', 16)", "repeat('01' || y, 16)"),
    "BGRA": ("repeat(y || '010203', 16)", "repeat('030201' || y, 16)"),
    "RGB24": ("repeat(y || '0102', 16)", "repeat(y || '0102', 16)"),
    "PAL8": ("repeat(y, 16)", "NULL"),
}


def _case(at: int) -> str:
    return "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {v[at]}" for i, v in enumerate(_KINDS.values())) + " END"


@query("converted_pictures", f"SELECT p_partkey, {_case(1)} AS shown FROM (SELECT p_partkey, upper(printf('%02X', p_size)) AS y FROM part)")
def converted_pictures(t):
    rows = t("part").select("p_partkey", F.lpad(F.hex("p_size"), 2, "0").alias("y"))
    pixels = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 10).cast("int"))
    rows = rows.select("p_partkey", F.unhex(F.expr(_case(0))).alias("data"), pixels.alias("pixels"))
    return rows.select("p_partkey", F.hex(bits.converted("data", "pixels", F.lit(4), F.lit(4))).alias("shown"))


@query("subpicture_colours", "SELECT p_partkey, [(5 * 17) * 16777216 + p_size % 16 * 1000, 255 * 16777216::BIGINT + p_size // 16 * 1000, 0::BIGINT + 2000, 255 * 16777216::BIGINT + 1000] AS colours FROM part")
def subpicture_colours(t):
    packet = F.expr("unhex(concat('00200004', '00000010', '0312', lpad(hex(p_size), 2, '0'), '04F0F5', 'FF'))")
    palette = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i.cast("long") * 1000)
    return t("part").select("p_partkey", bits.coloured(packet, palette).alias("colours"))


@query("dts_bursts", "SELECT p_partkey, '72F81F4E0B00' || upper(printf('%02X%02X', (8 + 2 * p_size) * 8 % 256, (8 + 2 * p_size) * 8 // 256)) || 'FE7F01803C000000' || repeat('CDAB', p_size) || repeat('00', 2048 - 16 - 2 * p_size) AS burst FROM part")
def dts_bursts(t):
    frame = F.expr("unhex(concat('7FFE8001003C0000', repeat('ABCD', p_size)))")
    return t("part").select("p_partkey", F.hex(bits.udf("dts_burst")(frame)).alias("burst"))


@query("vorbis_privates", "SELECT p_partkey, p_size + 230 AS first, length(p_brand) AS second, hex(p_type::BLOB) AS third FROM part WHERE p_size % 5 > 0")
def vorbis_privates(t):
    atom = lambda kind, digits: f"lpad(hex(8 + length({digits}) div 2), 8, '0'), hex('{kind}'), {digits}"
    setup = f"CASE WHEN p_size % 5 > 0 THEN concat({atom('vCtC', 'hex(p_type)')}) ELSE '' END"
    cookie = F.expr(f"unhex(concat({atom('vCtH', repr('AA'))}, {atom('vCt#', 'hex(p_brand)')}, {atom('vCtH', 'repeat(' + repr('BB') + ', p_size + 230)')}, {setup}))")
    rows = t("part").select("p_partkey", bits.udf("split_xiph")(bits.udf("vorbis_private")(cookie)).alias("x")).where("x IS NOT NULL")
    return rows.select("p_partkey", F.length(F.col("x")[0]).alias("first"), F.length(F.col("x")[1]).cast("long").alias("second"), F.hex(F.col("x")[2]).alias("third"))


@F.pandas_udf(BinaryType())
def _bitmap(width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([bits.bitmap_header(int(w), int(h), 24, b"XVID") for w, h in zip(width, height, strict=True)])


@F.pandas_udf(BinaryType())
def _sound(channels: pd.Series) -> pd.Series:
    return channels.map(lambda c: bits.wave_cookie(b".mp3", 85, int(c), 44100, 16000, 1, 0))


@F.pandas_udf(BinaryType())
def _descriptor(private: pd.Series) -> pd.Series:
    return private.map(lambda p: bits.elementary_descriptor(bytes(p), 0x40, 0x15))


@query("written_headers", """
SELECT p_partkey, '28000000' || printf('%02X%02X0000', p_size * 8 % 256, p_size * 8 // 256) || printf('%02X000000', p_size) || '0100180058564944' AS bitmap, '0000000C66726D612E6D7033' || '0000001A2E6D7033' || '5500' || printf('%02X00', p_size) || '44AC0000803E00000100000000000000000800000000' AS sound,
  '00000000038080' || printf('80%02X', 3 + 5 + 13 + 5 + length(p_brand) + 6) || '00000004808080' || printf('%02X', 13 + 5 + length(p_brand)) || '4015' || repeat('00', 11) || '05808080' || printf('%02X', length(p_brand)) || hex(p_brand::BLOB) || '068080800102' AS descriptor FROM part
""")
def written_headers(t):
    size = F.col("p_size")
    return t("part").select("p_partkey", F.hex(F.substring(_bitmap(size * 8, size), 1, 20)).alias("bitmap"), F.hex(_sound(size)).alias("sound"), F.hex(_descriptor(F.col("p_brand").cast("binary"))).alias("descriptor"))
