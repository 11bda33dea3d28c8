"""Readers of subtitle files and binary headers: each query writes files or headers from a table's columns and reads them back."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bits
from ..sources import containers, subtitles
from .registry import query

# ---------------------------------------------------------------- subtitle files


def _files(t, text: str):
    """file, text: one file a row of part, written by an expression over its columns; i numbers its up to four cues."""
    return t("part").select(F.col("p_partkey").alias("file"), F.expr(text).alias("text"))


CUES = "FROM (SELECT *, unnest(range(0, p_size % 4 + 1)) AS i FROM part)"


@query("srt_cues", f"SELECT p_partkey AS file, i AS num, i * 5000 + p_size AS \"begin\", i * 5000 + p_size + 2500 AS \"end\", '{{\\i1}}' || p_brand || '{{\\i0}}' || chr(10) || p_type AS line {CUES}")
def srt_cues(t):
    block = r"format_string('%d\n00:00:%02d,%03d --> 00:00:%02d,%03d\n<i>%s</i>\n%s\n', i + 1, CAST((i * 5000 + p_size) div 1000 AS INT), (i * 5000 + p_size) % 1000, CAST((i * 5000 + p_size + 2500) div 1000 AS INT), (i * 5000 + p_size + 2500) % 1000, p_brand, p_type)"
    return subtitles.srt_cues(_files(t, f"array_join(transform(sequence(0, p_size % 4), i -> {block}), '\\n')"))


SCRIPT = (
    r"concat('[Script Info]\nTitle: first\nPlayResX: ', p_size, '\nTitle: ', p_name, '\n\n[V4+ Styles]\nFormat: Name\n',"
    r" 'Style: *Main,@Arial,', p_size, ',&H0000FF,0,0,0,-1,0,0,0,0,150,0,0,1,2,2,8,10,10,10,0\n', 'Style: Main,Arial,', p_size + 1, ',&HFF0000,0,0,0,0,1,0,0,100,0,0,0,1,2,2,2,10,10,10,0\n', 'Style: short,Arial\n',"
    r" '\n[Events]\nFormat: Layer\nDialogue: broken,row\n', array_join(transform(sequence(0, p_size % 4), i -> format_string('Dialogue: %d,0:00:%02d.50,0:00:%02d.25,*Main,,0,0,0,,{\\b1\\an8}%s{\\i1}, %s', i, i, i + 2, p_brand, p_type)), '\n'), '\n')"
)


@query("script_cues", f"SELECT p_partkey AS file, i AS layer, i * 100 + 50 AS \"begin\", i * 100 + 225 AS \"end\", 'Main' AS style, '{{\\b1\\an8}}' || p_brand || '{{\\i1}}, ' || p_type AS line {CUES}", int_="layer")
def script_cues(t):
    return subtitles.script_cues(_files(t, SCRIPT)).select("file", "layer", "begin", "end", "style", "line")


@query("script_headers", "SELECT p_partkey AS file, p_name AS title, p_size::VARCHAR AS width FROM part")
def script_headers(t):
    return subtitles.script_headers(_files(t, SCRIPT)).select("file", F.col("headers")["Title"].alias("title"), F.col("headers")["PlayResX"].alias("width"))


@query("script_styles", "SELECT p_partkey AS file, 'Main' AS name, 'Arial' AS font, false AS vertical, (p_size + 1)::DOUBLE AS size, false AS bold, true AS italic, 100.0::DOUBLE AS scale_x, 100.0::DOUBLE AS scale_y, 2 AS alignment FROM part")
def script_styles(t):
    return subtitles.script_styles(_files(t, SCRIPT)).select("file", "name", "font", "vertical", "size", "bold", "italic", "scale_x", "scale_y", "alignment")


@query("script_styles_v4", "SELECT p_partkey AS file, 'Old' AS name, 'Arial' AS font, p_size::DOUBLE AS size, true AS bold, CASE WHEN a BETWEEN 9 AND 11 THEN a - 5 WHEN a BETWEEN 5 AND 7 THEN a + 2 ELSE a END AS alignment FROM (SELECT *, [1, 2, 3, 5, 6, 7, 9, 10, 11][p_partkey % 9 + 1] AS a FROM part)")
def script_styles_v4(t):
    text = r"concat('[V4 Styles]\nStyle: Old,Arial,', p_size, ',255,0,0,0,-1,0,1,2,2,', array(1, 2, 3, 5, 6, 7, 9, 10, 11)[CAST(p_partkey % 9 AS INT)], ',10,10,10,0,0\nStyle: Wrong,Arial,10\n')"
    return subtitles.script_styles(_files(t, text)).select("file", "name", "font", "size", "bold", "alignment")


@query("script_spans", f"""
WITH c AS (SELECT p_partkey AS file, i, p_brand, p_type {CUES})
SELECT file, i AS cue, 1 AS span, 0 AS "offset", p_brand AS "text", 'b=1 an=8' AS tags FROM c UNION ALL SELECT file, i, 2, length(p_brand), ', ' || p_type, 'i=1' FROM c
""", int_="cue")
def script_spans(t):
    cues = subtitles.script_cues(_files(t, SCRIPT))
    tags = F.array_join(F.transform("tags", lambda x: F.concat(x["tag"], F.lit("="), x["arg"])), " ")
    return subtitles.spans(cues.withColumn("num", F.col("layer"))).select("file", F.col("num").alias("cue"), "span", "offset", "text", tags.alias("tags"))


@query("sami_cues", f"SELECT p_partkey AS file, 'ENCC' AS class, i * 1000 AS \"begin\", i * 1000 + 1000 AS \"end\", '{{\\i1}}' || p_brand || '{{\\i0}} ' || chr(10) || 'x' AS line {CUES}")
def sami_cues(t):
    sync = r"format_string('<SYNC Start=%d><P Class=ENCC><i>%s</i>&nbsp;<br>x\n', i * 1000, p_brand)"
    text = f"concat('<SAMI><BODY>\\n', array_join(transform(sequence(0, p_size % 4 + 1), i -> {sync}), ''), '</BODY></SAMI>')"
    return subtitles.sami_cues(_files(t, text)).select("file", "class", "begin", "end", "line")


@query("vobsub_index", f"SELECT p_partkey AS file, i + 1 AS track, 'en' AS lang, i * 1000 + CASE WHEN k = 1 THEN 500 ELSE 0 END AS ts, p_size * 2048 + k AS filepos FROM (SELECT *, unnest([0, 1]) AS k {CUES})", long="filepos")
def vobsub_index(t):
    track = r"format_string('id: en, index: %d\ntimestamp: 00:00:%02d:000, filepos: %09x\ndelay: 00:00:00:500\ntimestamp: 00:00:%02d:000, filepos: %09x\n', i, i, p_size * 2048, i, p_size * 2048 + 1)"
    return subtitles.vobsub_index(_files(t, f"concat('# VobSub\\n', array_join(transform(sequence(0, p_size % 4), i -> {track}), ''))"))


@query("html_page", "SELECT p_partkey AS file, '<p data-begin=\"' || p_size || '\" data-end=\"' || (p_size + 1) || '\">' || replace(replace(p_type, '&', '&amp;'), '<', '&lt;') || '<br>&lt;b></p>' AS html FROM part")
def html_page(t):
    cue = t("part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("begin"), (F.col("p_size") + 1).alias("end"), F.concat("p_type", F.lit("\n<b>\n")).alias("text"))
    return subtitles.html_page(cue.unionByName(cue.withColumn("text", F.lit("\n"))))


# ---------------------------------------------------------------- bits and bytes


def _hex(value: str, digits: int) -> str:
    return f"lpad(hex({value}), {digits}, '0')"


def _ue(value: str) -> str:
    """Bits of an unsigned Exp-Golomb number."""
    return f"lpad(bin({value} + 1), 2 * length(bin({value} + 1)) - 1, '0')"


def _bits(value: str, n: int) -> str:
    return f"lpad(bin({value}), {n}, '0')"


def _bytes(bit_string: str) -> str:
    """Hexadecimal digits of a string of bits, a stop bit and zeros behind them."""
    whole = f"concat({bit_string}, '1', repeat('0', 7 - length({bit_string}) % 8))"
    return f"array_join(transform(sequence(1, length({whole}), 8), i -> lpad(conv(substring({whole}, i, 8), 2, 16), 2, '0')), '')"


def _data(t, digits: str, *names: str):
    return t("part").select("p_partkey", "p_size", "p_brand", F.expr(f"unhex(concat({digits}))").alias("data"), *names)


#: The part of a parameter set that says how many frames are re-ordered.
VUI = f"concat('00000', '00', '0', '1', '1', {_ue('0')}, {_ue('0')}, {_ue('9')}, {_ue('9')}, {_ue('p_size % 4')}, {_ue('4')})"
SPS = f"concat({_ue('0')}, {_ue('4')}, {_ue('p_size % 3 div 2 * 2')}, CASE WHEN p_size % 3 < 2 THEN {_ue('3')} ELSE '' END, {_ue('p_size % 5')}, '0', {_ue('p_size')}, {_ue('p_size % 7')}, '1', '1', '0', '1', {VUI})"


def _parsed(name: str, data: Column | str = "data") -> Column:
    return bits.udf(name)(data)


AC3 = ", ".join(["'0B77'", "'0000'", _hex("(p_size % 3) * 64 + p_size % 38", 2), _hex("(p_size % 11) * 8", 2), _hex("(p_size % 8) * 32", 2), "'000000'"])


@query("ac3_headers", f"""
SELECT p_partkey, [48000, 44100, 32000][p_size % 3 + 1] >> greatest(p_size % 11 - 8, 0) AS rate, ({list(bits.AC3_BITS)}[(p_size % 38) // 2 + 1] * 1000) >> greatest(p_size % 11 - 8, 0) AS bit_rate, [2, 1, 2, 3, 3, 4, 4, 5][p_size % 8 + 1] AS channels FROM part
""")
def ac3_headers(t):
    return _data(t, f"'FFFF', {AC3}").select("p_partkey", _parsed("parse_ac3").alias("a")).select("p_partkey", "a.rate", "a.bit_rate", "a.channels")


@query("h264_pictures", "SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 'B' WHEN 2 THEN 'I' ELSE 'P' END AS kind, p_size % 2 = 0 AND p_size % 3 <> 2 AS skippable, p_size % 3 = 2 AS idr FROM part")
def h264_pictures(t):
    head = "CASE WHEN p_size % 3 = 2 THEN '65' WHEN p_size % 2 = 0 THEN '01' ELSE '41' END"
    return _data(t, f"'0000010930000001', {head}, {_bytes('concat(' + _ue('0') + ', ' + _ue('p_size % 3') + ', ' + _ue('5') + ')')}").select("p_partkey", _parsed("parse_h264_frame").alias("f")).select("p_partkey", "f.*")


@query("h264_parameters", "SELECT p_partkey, 8 AS frame_bits, p_size % 3 // 2 * 2 AS poc_type, CASE WHEN p_size % 3 < 2 THEN 7 ELSE 0 END AS poc_bits, p_size % 5 AS ref_frames, (p_size + 1) * 16 AS width, (p_size % 7 + 1) * 16 AS height, p_size % 4 AS reorder_frames FROM part")
def h264_parameters(t):
    return _data(t, f"'674D001E', {_bytes(SPS)}").select("p_partkey", _parsed("parse_sps").alias("s")).select("p_partkey", *(f"s.{c}" for c in ("frame_bits", "poc_type", "poc_bits", "ref_frames", "width", "height", "reorder_frames")))


@query("h264_picture_parameters", "SELECT p_partkey, p_size AS pps_id, p_size % 5 AS sps_id, p_size % 2 = 1 AS cabac, p_size % 3 = 0 AS order_present FROM part")
def h264_picture_parameters(t):
    flags = f"concat({_ue('p_size')}, {_ue('p_size % 5')}, {_bits('p_size % 2', 1)}, CASE WHEN p_size % 3 = 0 THEN '1' ELSE '0' END)"
    return _data(t, f"'68', {_bytes(flags)}").select("p_partkey", _parsed("parse_pps").alias("s")).select("p_partkey", "s.*")


@query("h264_slice_orders", "SELECT p_partkey, ['P', 'B', 'I'][p_size % 3 + 1] AS kind, 100 + p_size AS frame, CASE WHEN p_size % 3 < 2 THEN 64 + p_size END AS \"order\" FROM part")
def h264_slice_orders(t):
    slice_ = f"concat({_ue('0')}, {_ue('p_size % 3')}, {_ue('0')}, {_bits('100 + p_size', 8)}, CASE WHEN p_size % 3 < 2 THEN {_bits('64 + p_size', 7)} ELSE '' END, '1111')"
    return _data(t, f"'000001674D001E', {_bytes(SPS)}, '00000141', {_bytes(slice_)}").select("p_partkey", _parsed("parse_slice").alias("s")).select("p_partkey", "s.*")


@query("mpeg_pictures", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'I' WHEN 2 THEN 'P' WHEN 3 THEN 'B' END AS kind FROM part")
def mpeg_pictures(t):
    return _data(t, f"'000001B3', '00000100', '00', {_hex('(p_size % 4) * 8', 2)}, '00'").select("p_partkey", _parsed("mpeg_picture_kind").alias("kind"))


@query("stream_descriptors", "SELECT p_partkey, hex(p_brand::BLOB) AS private FROM part")
def stream_descriptors(t):
    own = "hex(p_brand)"
    size = f"length({own}) div 2"
    config = f"concat('05', {_hex(size, 2)}, {own})"
    middle = f"concat('0480', {_hex(f'13 + length({config}) div 2', 2)}, '4015', repeat('00', 11), {config})"
    return _data(t, f"'00000000', '03808080', {_hex(f'3 + length({middle}) div 2', 2)}, '000000', {middle}").select("p_partkey", F.hex(_parsed("parse_esds")).alias("private"))


@query("xiph_packets", "SELECT p_partkey, 255 + p_size AS first, p_size AS second, length(p_brand) AS third FROM part", long="first second")
def xiph_packets(t):
    rows = _data(t, f"'02', 'FF', {_hex('p_size', 2)}, {_hex('p_size', 2)}, repeat('AA', 255 + p_size), repeat('BB', p_size), hex(p_brand)").select("p_partkey", _parsed("split_xiph").alias("x"))
    return rows.select("p_partkey", *(F.length(F.col("x")[i]).cast("long").alias(n) for i, n in enumerate(("first", "second", "third"))))


@query("flac_metadata", "SELECT p_partkey, 4 AS kind, p_size AS size, true AS last FROM part UNION ALL SELECT p_partkey, 0, 34, false FROM part")
def flac_metadata(t):
    rows = _data(t, f"hex('fLaC'), '00000022', repeat('00', 34), '84', {_hex('p_size', 6)}, repeat('00', p_size), '0000000100'").select("p_partkey", F.explode(_parsed("parse_flac")).alias("b"))
    return rows.select("p_partkey", "b.*")


@query("cookie_atoms", "SELECT p_partkey, 'CpSt' AS type, hex(p_brand::BLOB) AS payload FROM part UNION ALL SELECT p_partkey, 'CpCk', '' FROM part WHERE p_size % 2 = 0")
def cookie_atoms(t):
    digits = f"{_hex('8 + length(p_brand)', 8)}, hex('CpSt'), hex(p_brand), CASE WHEN p_size % 2 = 0 THEN '00000008' ELSE '00000009' END, hex('CpCk')"
    return _data(t, digits).select("p_partkey", F.explode(_parsed("parse_atoms")).alias("a")).select("p_partkey", "a.type", F.hex("a.payload").alias("payload"))


@query("avc_records", "SELECT p_partkey, 2 AS units, hex(p_brand::BLOB) AS first, repeat('AB', p_size) AS second FROM part")
def avc_records(t):
    rows = _data(t, f"'014D001EFFE1', {_hex('length(p_brand)', 4)}, hex(p_brand), '01', {_hex('p_size', 4)}, repeat('AB', p_size)").select("p_partkey", _parsed("split_avcc").alias("u"))
    return rows.select("p_partkey", F.size("u").alias("units"), F.hex(F.col("u")[0]).alias("first"), F.hex(F.col("u")[1]).alias("second"))


@query("inflated_frames", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS \"text\" FROM part")
def inflated_frames(t):
    @F.pandas_udf("binary")
    def deflate(x: pd.Series) -> pd.Series:
        return x.map(lambda s: zlib.compress(s.encode()))

    packed = deflate("p_name")
    damaged = F.when(F.col("p_size") % 3 == 0, F.concat(F.expr("X'00'"), packed)).otherwise(packed)
    return t("part").select("p_partkey", _parsed("inflate", damaged).cast("string").alias("text"))


def _framed(stream: str, digits: str) -> str:
    """A pack header and a private packet of one substream."""
    return f"concat('000001BA', repeat('00', 9), 'F8', '000001BD', {_hex(f'4 + length({digits}) div 2', 4)}, '800000', {stream}, {digits})"


@query("subpicture_units", "SELECT p_partkey, upper(printf('%04X', length(p_brand) + 2)) || hex(p_brand::BLOB) AS unit FROM part")
def subpicture_units(t):
    first = f"concat({_hex('length(p_brand) + 2', 4)}, hex(substring(p_brand, 1, 3)))"
    digits = f"{_framed(chr(39) + '20' + chr(39), first)}, {_framed(chr(39) + '20' + chr(39), 'hex(substring(p_brand, 4))')}, '000001BE0001FF'"
    return _data(t, digits).select("p_partkey", F.hex(_parsed("unframe_subpicture")).alias("unit"))


@query("subpicture_controls", "SELECT p_partkey, ((p_size * 1024) // 90) & 65535 AS start, ((p_size * 2 * 1024) // 90) & 65535 AS \"end\", p_size % 2 = 0 AS forced FROM part")
def subpicture_controls(t):
    show = "CASE WHEN p_size % 2 = 0 THEN '00' ELSE '01' END"
    digits = f"'001C0004', {_hex('p_size', 4)}, '0010', {show}, '031234', '04F0FF', 'FF', {_hex('p_size * 2', 4)}, '0010', '02FF'"
    return _data(t, digits).select("p_partkey", _parsed("subpicture_times").alias("s")).select("p_partkey", "s.*")


# ---------------------------------------------------------------- containers


def _el(ident: int, digits: str) -> str:
    """An element's digits. Its content is named once, so that an expression grows with the elements in it and not with two to the power of their depth."""
    return f"transform(array({digits}), d -> concat('{ident:X}', {_hex('268435456 + length(d) div 2', 8)}, d))[0]"


def _num(ident: int, value: str) -> str:
    return _el(ident, _hex(f"CAST({value} AS BIGINT)", 16))


def _movie(*parts: str) -> str:
    c = containers
    return f"{_el(c.EBML, 'concat(' + _el(c.DOC_TYPE, 'hex(' + repr('matroska') + ')') + ', ' + _num(c.READ_VERSION, '2 + (p_size = 50)::INT') + ')')}, {_el(c.SEGMENT, 'concat(' + ', '.join(parts) + ')')}"


def _mkv(t, table: str, *parts: str):
    rows = _data(t, _movie(*parts)).select(F.col("p_partkey").cast("string").alias("path"), F.col("data").alias("content"))
    return containers.matroska_rows(rows, table).withColumn("p_partkey", F.col("path").cast("long"))


@query("matroska_tracks", "SELECT p_partkey, p_size AS number, 17 AS type, 'S_TEXT/UTF8' AS codec_id, 'ger' AS lang, p_size % 2 = 1 AS enabled FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, p_size + 1, 1, p_brand, 'eng', true FROM part WHERE p_size < 50", long="number type")
def matroska_tracks(t):
    c = containers
    one = _el(c.TRACK, f"concat({_num(c.NUMBER, 'p_size')}, {_num(c.TYPE, '17')}, {_el(c.CODEC, 'hex(' + repr('S_TEXT/UTF8') + ')')}, {_el(c.LANGUAGE, 'hex(' + repr('ger') + ')')}, {_num(c.ENABLED, 'p_size % 2')})")
    two = _el(c.TRACK, f"concat({_num(c.NUMBER, 'p_size + 1')}, {_num(c.TYPE, '1')}, {_el(c.CODEC, 'hex(p_brand)')})")
    return _mkv(t, "tracks", _el(c.TRACKS, f"concat({one}, {two})")).select("p_partkey", "number", "type", "codec_id", "lang", "enabled")


@query("matroska_frames", "SELECT p_partkey, 1 AS track, 1000 + p_size AS tc, 0 AS lace, p_size AS size, p_size % 2 = 0 AS keyframe FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, 2, 1007, i, [3, 4, 2][i + 1], true FROM (SELECT *, unnest([0, 1, 2]) AS i FROM part WHERE p_size < 50)", long="track tc lace size")
def matroska_frames(t):
    c = containers
    simple = _el(c.SIMPLE, f"concat('81', {_hex('p_size', 4)}, CASE WHEN p_size % 2 = 0 THEN '80' ELSE '00' END, repeat('FF', p_size))")
    laced = _el(c.GROUP, _el(c.BLOCK, "'82000702020304616263646566676869'"))
    junk = "'00006A756E6B00'"
    return _mkv(t, "frames", junk, _el(c.CLUSTER, f"concat({_num(c.TIMECODE, '1000')}, {simple}, {laced})")).select("p_partkey", "track", "tc", "lace", "size", "keyframe")


@query("matroska_headers", "SELECT p_partkey, 1000 * p_size AS scale, p_name AS title FROM part WHERE p_size < 50", long="scale")
def matroska_headers(t):
    c = containers
    info = _el(c.INFO, f"concat({_num(c.SCALE, '1000 * p_size')}, {_el(c.TITLE, 'hex(p_name)')})")
    return _mkv(t, "segment", info, info).select("p_partkey", "scale", "title")


@query("matroska_seeks", "SELECT p_partkey, 357149030 AS ident, p_size AS \"position\" FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, 290298740, 0 FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, 272869232, 1000 FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, 290298740, 78 FROM part WHERE p_size < 50", long="ident position")
def matroska_seeks(t):
    c = containers
    seek = lambda ident, at: _el(c.SEEK, f"concat({_el(c.SEEK_ID, repr(f'{ident:X}'))}, {_num(c.SEEK_POSITION, at)})")
    # The first head names the second (78 bytes on), which names the first.
    first = _el(c.SEEK_HEAD, f"concat({seek(c.INFO, 'p_size')}, {seek(c.SEEK_HEAD, '78')})")
    second = _el(c.SEEK_HEAD, f"concat({seek(c.CHAPTERS, '1000')}, {seek(c.SEEK_HEAD, '0')})")
    return _mkv(t, "seeks", first, second).select("p_partkey", "ident", "position")


@query("matroska_late_chapters", "SELECT p_partkey, 1 AS uid, 1000000 * p_size AS start FROM part WHERE p_size <= 25", long="uid start")
def matroska_late_chapters(t):
    c = containers
    info = _el(c.INFO, f"concat({_num(c.SCALE, '1000000')}, {_el(c.DURATION, repr('4039000000000000'))})")
    atom = _el(c.ATOM, f"concat({_num(c.UID, '1')}, {_num(c.START, '1000000 * p_size')})")
    return _mkv(t, "chapters", _el(c.CHAPTERS, _el(c.EDITION, atom)), info).select("p_partkey", F.col("uid").cast("long").alias("uid"), "start")


@query("matroska_chapters", "SELECT p_partkey, 2 AS uid, 1 AS parent, p_size AS start FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, 4, NULL, 9 FROM part WHERE p_size < 50", long="uid parent start")
def matroska_chapters(t):
    c = containers
    leaf = lambda uid, start, extra="''": _el(c.ATOM, f"concat({_num(c.UID, uid)}, {_num(c.START, start)}, {extra})")
    hidden = _num(c.HIDDEN, "1")
    one = leaf("1", "0", f"concat({leaf('2', 'p_size')}, {leaf('3', '6', hidden)})")
    rows = _mkv(t, "chapters", _el(c.CHAPTERS, _el(c.EDITION, f"concat({one}, {leaf('4', '9', leaf('5', '9', hidden))})")))
    return rows.select("p_partkey", F.col("uid").cast("long").alias("uid"), F.col("parent").cast("long").alias("parent"), "start")


@query("matroska_attachments", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'cover.png' WHEN p_size % 3 = 1 THEN 'DFfont.ttc' ELSE p_brand || '.ttf' END AS name, CASE WHEN p_size % 3 = 0 THEN 'cover' WHEN p_size % 3 = 2 THEN 'font' END AS role, p_size AS size FROM part WHERE p_size < 50", long="size")
def matroska_attachments(t):
    c = containers
    name = "CASE WHEN p_size % 3 = 0 THEN 'cover.png' WHEN p_size % 3 = 1 THEN 'DFfont.ttc' ELSE concat(p_brand, '.ttf') END"
    mime = "CASE WHEN p_size % 3 = 0 THEN 'image/png' ELSE 'application/x-truetype-font' END"
    file = _el(c.FILE, f"concat({_el(c.FILE_NAME, 'hex(' + name + ')')}, {_el(c.FILE_MIME, 'hex(' + mime + ')')}, {_el(c.FILE_DATA, 'repeat(' + repr('AA') + ', p_size)')})")
    return _mkv(t, "attachments", _el(c.ATTACHMENTS, file)).select("p_partkey", "name", "role", "size")


@query("format_probe", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'avi' WHEN 1 THEN 'flv' WHEN 2 THEN 'tta' END AS format, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 8 = 0 THEN 'dvsd' ELSE 'XVID' END ELSE '' END AS codes, p_size % 4 IN (1, 2) OR p_size % 8 = 4 AS accepted FROM part")
def format_probe(t):
    strh = "concat(hex('strh'), '38000000', hex('vids'), CASE WHEN p_size % 8 = 0 THEN hex('dvsd') ELSE hex('XVID') END, repeat('00', 48))"
    strl = f"concat(hex('LIST'), '44000000', hex('strl'), {strh})"
    hdrl = f"concat(hex('LIST'), '50000000', hex('hdrl'), {strl})"
    avi = f"concat(hex('RIFF'), '5C000000', hex('AVI '), {hdrl})"
    data = f"CASE p_size % 4 WHEN 0 THEN {avi} WHEN 1 THEN hex('FLV1') WHEN 2 THEN hex('TTA1') ELSE '00' END"
    return _data(t, data).select("p_partkey", containers.probe(F.col("data")).alias("p")).select("p_partkey", "p.format", F.array_join("p.codes", ",").alias("codes"), "p.accepted")
