"""Sources on small files written here, and the stream of finished packets."""

import json
import os
import struct

from pyspark.sql import functions as F

from cuegrain.operators import timeline as tl
from cuegrain.sources import containers as mk
from cuegrain.sources import subtitles as st
from cuegrain.streaming.release import release_packets


def put(path, name, data):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


def test_srt(spark, tmp_path):
    body = "1\r\n00:00:01,500 --> 00:00:02,000\r\n<i>Hé</i>\r\nsecond\r\n\r\n2\r\n0:00:03.0 --> 0:00:04.0\r\nb\r\n\r\nx\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nlast"
    put(tmp_path / "s", "a.srt", b"\xef\xbb\xbf" + body.encode())
    cues = st.srt_cues(st.read_texts(spark, str(tmp_path / "s"), "*.srt"))
    got = [(r.begin, r.end, r.line) for r in cues.orderBy("num").collect()]
    assert got == [(1500, 2000, "{\\i1}Hé{\\i0}\nsecond"), (3000, 4000, "b"), (5000, 6000, "last")]
    assert tl.serialize_cues(cues).count() == 6


SCRIPT = """[Script Info]
; comment
ScriptType: v4.00+
PlayResX: 640
[V4+ Styles]
Format: ignored
Style: *Default,@Arial,20,&H00FFFFFF,&H0,&H0,&H0,-1,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1
Style: Default,Arial,24,&H000000FF,&H0,&H0,&H0,0,0,0,0,0,100,0,0,1,2,2,8,10,10,10,1
Style: Short,Arial
[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.00,0:00:02.50,*Default,,0,0,0,,{\\b1\\pos(3,4)}Bold{\\b0} and, commas\\Nline
Dialogue: 1,0:00:02.00,0:00:03.00,Default,,0,0,0,,plain
Dialogue: too,short
"""


def test_scripts(spark, tmp_path):
    texts = st.read_texts(spark, str(put(tmp_path / "s", "a.ass", SCRIPT)))
    assert st.script_headers(texts).first().headers["PlayResX"] == "640"
    styles = st.script_styles(texts).collect()
    assert [(s.name, s.font, s.vertical, s.size, s.scale_x, s.alignment, s.primary) for s in styles] == [("Default", "Arial", False, 24.0, 100.0, 8, 255)]
    cues = st.script_cues(texts)
    assert [(c.begin, c.end, c.layer, c.style) for c in cues.orderBy("num").collect()] == [(100, 250, 0, "Default"), (200, 300, 1, "Default")]
    spans = st.spans(cues.where("layer = 0")).orderBy("span").collect()
    assert [(s.offset, s.text, [tuple(t) for t in s.tags]) for s in spans] == [(0, "Bold", [("b", "1"), ("pos", "(3,4)")]), (4, " and, commas\nline", [("b", "0")])]
    html = st.html_page(tl.serialize_cues(cues)).first().html
    assert html.count("<p ") == 3


def test_sami(spark, tmp_path):
    body = "<SAMI><BODY>\n<SYNC Start=100><P Class=ENCC>One&nbsp;<br>two\n<SYNC Start=200><P Class=ENCC>&nbsp;\n<SYNC Start=300><P Class=DECC>Drei<SYNC Start=400><P Class=ENCC>Three<SYNC Start=500><P Class=DECC>x<P Class=ENCC>y</BODY></SAMI>"
    cues = st.sami_cues(st.read_texts(spark, str(put(tmp_path / "s", "a.smi", body)))).orderBy("class", "begin").collect()
    assert [(c["class"], c.begin, c.end, c.line) for c in cues] == [("DECC", 300, 500, "Drei"), ("ENCC", 100, 200, "One \ntwo"), ("ENCC", 400, 500, "Three")]


def test_vobsub_index(spark, tmp_path):
    body = "# x\nid: en, index: 0\ntimestamp: 00:00:01:000, filepos: 000000000\ndelay: -00:00:00:500\ntimestamp: 00:00:02:000, filepos: 00000a000\nid: de, index: 1\ntimestamp: 00:00:03:000, filepos: 000000010\n"
    rows = st.vobsub_index(st.read_texts(spark, str(put(tmp_path / "s", "a.idx", body)))).orderBy("track", "ts").collect()
    assert [(r.track, r.lang, r.ts, r.filepos) for r in rows] == [(1, "en", 1000, 0), (1, "en", 1500, 0xA000), (2, "de", 3000, 16)]


def el(ident, body):
    n = len(body)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (0x10000000 | n).to_bytes(4, "big") + body


def uint(ident, n):
    return el(ident, n.to_bytes(8, "big"))


def movie(read_version=2, damage=b""):
    head = el(mk.EBML, el(mk.DOC_TYPE, b"matroska") + uint(mk.READ_VERSION, read_version))
    info = el(mk.INFO, uint(mk.SCALE, 1_000_000) + el(mk.DURATION, struct.pack(">d", 5000.0)))
    tracks = el(mk.TRACKS, el(mk.TRACK, uint(mk.NUMBER, 1) + uint(mk.TYPE, 1) + el(mk.CODEC, b"V_MPEG4/ISO/AVC") + el(mk.PRIVATE, b"\1\2")) + el(mk.TRACK, uint(mk.NUMBER, 2) + uint(mk.TYPE, 17) + el(mk.LANGUAGE, b"ger")))
    leaf = lambda uid, start, extra=b"": el(mk.ATOM, uint(mk.UID, uid) + uint(mk.START, start) + extra)
    chapters = el(mk.CHAPTERS, el(mk.EDITION, leaf(1, 0, leaf(2, 5) + leaf(3, 6, uint(mk.HIDDEN, 1))) + leaf(4, 9, leaf(5, 9, uint(mk.HIDDEN, 1)) + el(mk.DISPLAY, el(mk.CHAPTER_TEXT, b"End")))))
    files = el(mk.ATTACHMENTS, el(mk.FILE, el(mk.FILE_NAME, b"a.ttf") + el(mk.FILE_MIME, b"application/x-truetype-font")))
    simple = el(mk.SIMPLE, b"\x81\x00\x05\x80" + b"F" * 10)
    laced = el(mk.GROUP, el(mk.BLOCK, b"\x82\x00\x07\x02" + b"\x02\x03\x04" + b"abc" + b"defg" + b"hi") + uint(mk.BLOCK_DURATION, 40))
    fixed = el(mk.SIMPLE, b"\x82\xff\xff\x05" + b"\x01" + b"xxyy")
    clusters = el(mk.CLUSTER, uint(mk.TIMECODE, 100) + simple + laced) + damage + el(mk.CLUSTER, uint(mk.TIMECODE, 200) + fixed)
    return head + el(mk.SEGMENT, info + tracks + chapters + files + clusters)


def test_matroska(spark, tmp_path):
    put(tmp_path / "m", "ok.mkv", movie())
    put(tmp_path / "m", "new.mkv", movie(read_version=3))
    put(tmp_path / "m", "not.mkv", b"RIFFxxxx")
    put(tmp_path / "m", "damaged.mkv", movie(damage=b"\0\0junk\0"))
    read = lambda t: mk.read_matroska(spark, str(tmp_path / "m"), t).where("path LIKE '%ok.mkv'").collect()
    assert [(t.number, t.type, t.lang, t.codec_id) for t in read("tracks")] == [(1, 1, "eng", "V_MPEG4/ISO/AVC"), (2, 17, "ger", "")]
    frames = read("frames")
    assert [(f.track, f.tc, f.n_frames, f.size, f.keyframe, f.duration) for f in frames] == [(1, 105, 1, 10, True, None), (2, 107, 3, 3, True, 40), (2, 107, 3, 4, True, 40), (2, 107, 3, 2, True, 40), (2, 199, 2, 2, False, None), (2, 199, 2, 2, False, None)]
    data = movie()
    assert [data[f.offset : f.offset + f.size] for f in frames[1:4]] == [b"abc", b"defg", b"hi"]
    assert [(int(c.uid), c.title) for c in read("chapters")] == [(2, None), (4, "End")]
    assert read("attachments")[0].name == "a.ttf" and read("segment")[0].duration == 5000.0
    every = mk.read_matroska(spark, str(tmp_path / "m"), "frames").groupBy("path").count().collect()
    assert sorted((r.path.rpartition("/")[2], r["count"]) for r in every) == [("damaged.mkv", 6), ("ok.mkv", 6)]


def test_matroska_tables_behind_the_clusters(spark, tmp_path):
    head = el(mk.EBML, el(mk.DOC_TYPE, b"matroska"))
    cluster = lambda tc: uint(mk.TIMECODE, tc) + el(mk.SIMPLE, b"\x81\x00\x05\x80" + b"F" * 10)
    unknown = lambda tc: mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster(tc)
    tables = el(mk.TRACKS, el(mk.TRACK, uint(mk.NUMBER, 1))) + el(mk.CHAPTERS, el(mk.EDITION, el(mk.ATOM, uint(mk.UID, 7)))) + el(mk.ATTACHMENTS, el(mk.FILE, el(mk.FILE_NAME, b"b.ttf")))
    for name, clusters in (("sized", el(mk.CLUSTER, cluster(1)) + el(mk.CLUSTER, cluster(2))), ("unknown", unknown(1) + unknown(2))):
        put(tmp_path / name, "late.mkv", head + el(mk.SEGMENT, el(mk.INFO, uint(mk.SCALE, 5)) + clusters + tables))
        read = lambda t, name=name: mk.read_matroska(spark, str(tmp_path / name), t).collect()
        assert [r.number for r in read("tracks")] == [1] and [int(r.uid) for r in read("chapters")] == [7]
        assert [r.name for r in read("attachments")] == ["b.ttf"] and [r.tc for r in read("frames")] == [6, 7]


def avi(code):
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", b"vids" + code + b"\0" * 49))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"INFO" + chunk(b"ISFT", b"abc")) + chunk(b"LIST", b"hdrl" + strl))


def test_probe(spark):
    df = spark.createDataFrame([("a", avi(b"XVID")), ("b", avi(b"dvsd")), ("c", b"FLV\1"), ("d", b"nothing"), ("e", None)], "k string, content binary")
    got = {r.k: tuple(r.p) for r in df.select("k", mk.probe(F.col("content")).alias("p")).collect()}
    assert got == {"a": ("avi", ["XVID"], True), "b": ("avi", ["dvsd"], False), "c": ("flv", [], True), "d": (None, [], False), "e": (None, [], False)}


def test_feed(spark, tmp_path):
    items = "".join(f'<item><title>t{v}</title><pubDate>Mon, 0{i} Jan 2024 00:00:00 +0000</pubDate><enclosure url="http://x/app_{v}.zip" version="{v}"/></item>' for i, v in ((1, "1.2"), (2, "1.10")))
    put(tmp_path / "f", "feed.xml", f"<rss><channel>{items}</channel></rss>")
    got = mk.read_feed(spark, str(tmp_path / "f")).collect()
    assert sorted(r.enclosure["_version"] for r in got) == ["1.10", "1.2"]


def test_stream_releases_what_the_batch_gives(spark, tmp_path):
    rows = [(1, 0, 2, 5, "a"), (1, 1, 4, 9, "b"), (1, 2, 11, 12, "c"), (2, 0, 0, 3, "d"), (1, 3, 20, 21, "e"), (2, 1, 8, 9, "f")]
    source = tmp_path / "in"
    source.mkdir()
    for i, r in enumerate(rows):
        (source / f"{i}.json").write_text(json.dumps(dict(zip(("file", "num", "begin", "end", "line"), r))))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order
    stream = spark.readStream.schema("file long, num long, begin long, end long, line string").option("maxFilesPerTrigger", 2).json(str(source))
    q = release_packets(stream).writeStream.format("memory").queryName("packets").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("packets").collect()}
    whole = {tuple(r) for r in tl.serialize_cues(spark.createDataFrame(rows, "file long, num long, begin long, end long, line string")).collect()}
    assert got <= whole
    assert {r for r in whole if r[0] == 1 and r[2] <= 12} <= got


def test_side_files(spark, tmp_path):
    for name in ("Movie.srt", "movie.en.ASS", "movie.mkv", "note.txt"):
        put(tmp_path / "d", name, "abc")
    got = st.side_files(spark, str(tmp_path / "d")).collect()
    assert sorted((r.name, r.size) for r in got) == [("Movie.srt", 3), ("movie.en.ASS", 3)]


def test_seek_heads_that_name_each_other():
    seek = lambda ident, at: el(mk.SEEK, el(mk.SEEK_ID, ident.to_bytes(4, "big")) + uint(mk.SEEK_POSITION, at))
    body = el(mk.SEEK_HEAD, seek(mk.INFO, 500) + seek(mk.SEEK_HEAD, 0)) + el(mk.SEEK_HEAD, seek(mk.TRACKS, 7) + seek(mk.INFO, 500))
    rows = mk.walk_matroska(el(mk.EBML, el(mk.DOC_TYPE, b"webm")) + el(mk.SEGMENT, body))["seeks"]
    assert [(r["ident"], r["position"]) for r in rows] == [(mk.SEEK_HEAD, 0), (mk.TRACKS, 7), (mk.INFO, 500)]
