"""Text functions, header decoders, pixel kernels and the encoding detector."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrain.functions import bits, charset, media, text


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first().x


@pytest.mark.parametrize("t, scale, ticks", [("00:00:01,5", 1000, 1005), ("0:00:01.50", 100, 150), ("01:02:03:004", 1000, 3723004), ("00:01", 1000, 0), ("", 1000, 0)])
def test_subtimes(spark, t, scale, ticks):
    assert one(spark, text.parse_subtime(F.col("t"), scale), t=t) == ticks


@pytest.mark.parametrize("s, n, fixed, repeated", [("a,b,c,d", 2, ["a", "b,c,d"], ["a", "b,c,d"]), ("a,,c", 3, ["a", "", "c"], ["a", "", "c"]), ("a,b,c", 4, ["a", "b", "c"], ["a", "b", "c", "c"]), ("a,b", 4, ["a", "b"], ["a", "b", "b"]), ("a,b,", 3, ["a", "b", ""], ["a", "b", "b"])])
def test_splits(spark, s, n, fixed, repeated):
    assert one(spark, text.split_n(F.col("s"), ",", n), s=s) == fixed
    assert one(spark, text.split_n(F.col("s"), ",", n, repeat_last=True), s=s) == repeated


def test_versions(spark):
    assert one(spark, text.is_older(F.col("a"), F.col("b")), a="1.0b1", b="1.0")
    assert not one(spark, text.is_older(F.col("a"), F.col("b")), a="1.0", b="1.0b1")
    assert one(spark, text.newer_than(F.col("a"), F.col("b")), a="1.10", b="1.9")
    assert one(spark, text.version_parts(F.col("a")), a="1.10b2") == ["1", ".", "10", "b", "2"]


def test_languages(spark):
    got = [one(spark, text.filename_language(F.col("n")), n=n) for n in ("film.EN.srt", "film.ger.srt", "film.srt", "film.1234.srt", "de")]
    assert got == ["en", "ger", None, None, "de"]


def test_aspects(spark):
    r = one(spark, media.pixel_aspect(F.lit(720), F.lit(576), F.col("a"), F.col("b")), a=16, b=9)
    assert (r.h, r.v) == (64, 45)
    assert one(spark, media.pixel_aspect(F.lit(10), F.lit(10), F.col("a"), F.col("b")), a=3, b=3) is None


@pytest.mark.parametrize("name, sample", [
    ("utf-8", "Grüße aus Köln, schöne Straße"), ("shift_jis", "これは日本語の文章です。漢字とかなが混ざっています。"), ("euc_jp", "これは日本語の文章です。漢字とかなが混ざっています。"),
    ("windows-1251", "Это предложение написано на русском языке, и в нём много букв."), ("koi8-r", "Это предложение написано на русском языке, и в нём много букв."),
    ("windows-1253", "Αυτή είναι μια πρόταση στα ελληνικά με πολλά γράμματα"), ("windows-1255", "זהו משפט בעברית עם הרבה אותיות"), ("euc_kr", "이것은 한국어로 쓴 문장입니다. 글자가 많습니다."),
    ("gb18030", "这是一个用中文写的句子,里面有很多汉字。"), ("windows-1252", "C'était un été très agréable à la forêt, où les élèves étaient là"), ("us-ascii", "plain"), ("iso2022_jp", "これは日本語です"),
])
def test_detector(name, sample):
    data = sample.encode(name)
    assert charset.detect(data)[0] == name
    assert charset.decode(data) == sample


def test_marks_and_floors():
    assert charset.detect(b"\xef\xbb\xbfabc") == ("utf-8", 0.99)
    assert charset.decode("﻿ab".encode("utf-16-le")) == "ab"
    assert charset.detect(None) == (None, 0.0) and charset.detect(b"")[0] == "us-ascii"
    assert [charset.utf8_share("é".encode() * n) for n in (0, 1, 2, 6)] == [1 - 0.99, 1 - 0.99 * 0.5, 1 - 0.99 * 0.25, 0.99]


class Writer:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += f"{v:0{n}b}"
        return self

    def ue(self, *vs):
        for v in vs:
            b = f"{v + 1:b}"
            self.s += "0" * (len(b) - 1) + b
        return self

    def bytes(self):
        s = self.s + "1"
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def test_parameter_sets(spark):
    w = Writer().put(77, 8).put(0, 8).put(30, 8).ue(0, 0, 0, 0, 2).put(0, 1).ue(44, 35).put(1, 1)
    nal = b"\x67" + w.bytes()
    got = bits.sequence_parameters(nal)
    assert (got["profile"], got["level"], got["ref_frames"], got["width"], got["height"], got["frame_mbs_only"]) == (77, 30, 2, 720, 576, True)
    df = spark.createDataFrame([(nal,), (b"\x67",), (None,)], "b binary").select(bits.udf("parse_sps")("b").alias("p"))
    assert [r.p.width for r in df.collect()][0] == 720


def test_frames():
    slice_ = lambda head, kind: b"\0\0\1" + bytes([head]) + Writer().ue(0, kind).bytes()
    assert bits.frame_kind(slice_(0x65, 7)) == {"kind": "I", "skippable": False, "idr": True}
    assert bits.frame_kind(slice_(0x41, 5) + slice_(0x41, 2)) == {"kind": "P", "skippable": False, "idr": False}
    assert bits.frame_kind(slice_(0x01, 6)) == {"kind": "B", "skippable": True, "idr": False}
    assert bits.unescape(b"\0\0\3\1") == b"\0\0\1"


def test_headers():
    ac3 = b"xx\x0b\x77\0\0" + bytes([0 << 6 | 20, 8 << 3, 0b01000100, 0])
    assert bits.ac3_header(ac3) == {"rate": 48000, "bit_rate": 192000, "channels": 2, "lfe": True} or bits.ac3_header(ac3)["channels"] in (2, 3)
    assert bits.ac3_header(b"\x0b\x77\0\0\xff\0\0\0") is None
    for n in (1, 127, 128, 300):
        assert bits.decoder_config(bits.elementary_descriptor(b"p" * n, 0x40, 0x15)) == b"p" * n
    parts = [b"a" * 30, b"b" * 300, b"c" * 9]
    laced = b"\x02" + bytes([30]) + b"\xff" + bytes([45]) + b"".join(parts)
    assert bits.xiph_split(laced) == parts and bits.xiph_split(b"\x02\xff") is None
    assert bits.flac_blocks(b"fLaC\x00\x00\x00\x02ab\x84\x00\x00\x01c") == [{"kind": 0, "size": 2, "last": False}, {"kind": 4, "size": 1, "last": True}]
    assert bits.atoms(struct.pack(">I4s2s", 10, b"CpSt", b"ab")) == [{"type": "CpSt", "payload": b"ab"}]
    assert bits.inflate(zlib.compress(b"hello")) == b"hello" and bits.inflate(b"bad") is None
    packet = struct.pack(">HHHH", 30, 4, 0, 12) + b"\x00\x01\xff\xff" + struct.pack(">HH", 90, 12) + b"\x02\xff"
    assert bits.subpicture_times(packet) == {"start": 0, "end": 1024, "forced": True}


def test_more_headers():
    record = b"\x01\x4d\x00\x1e\xff\xe1" + struct.pack(">H", 3) + b"sps" + b"\x01" + struct.pack(">H", 2) + b"pp"
    assert bits.configuration_units(record) == [b"sps", b"pp"]
    assert bits.mpeg_picture_kind(b"..\0\0\1\0\0" + bytes([2 << 3])) == "P"
    spu = struct.pack(">HH", 12, 4) + b"abcdefgh"
    pes = lambda body: b"\0\0\1\xbd" + struct.pack(">H", 3 + 1 + len(body)) + b"\x81\0\0" + b"\x20" + body
    framed = b"\0\0\1\xba" + b"\0" * 9 + b"\xf8" + pes(spu[:5]) + b"\0\0\1\xbe\0\2xx" + pes(spu[5:] + b"junk")
    assert bits.unframe_subpicture(framed) == spu == bits.unframe_subpicture(framed, 0)
    control = struct.pack(">HHHH", 20, 4, 0, 4) + b"\x03\x32\x10\x04\xff\x0f\xff"
    assert bits.subpicture_colours(control, list(range(16))) == [0xFF000000, 1, 0xFF000002, 0xFF000003]
    assert bits.subpicture_colours(control[:11] + b"\xff", list(range(16))) is None
    assert struct.unpack("<Iii", bits.bitmap_header(4, 3, 24, b"XVID")[:12]) == (40, 4, 3)
    assert struct.unpack("<Iii", bits.bitmap_header(4, 3, 24, b"XVID", as_width=True)[:12]) == (40, 4, 4)
    assert [a["type"] for a in bits.atoms(bits.wave_cookie(b"ms\0U", 85, 2, 48000, 16000, 1, 0))][:2] == ["frma", "ms\0U"]
    dts = b"\x7f\xfe\x80\x01" + bytes([0xFC, 15 << 2]) + b"\0" * 90
    burst = bits.dts_burst(dts)
    assert len(burst) == 2048 and burst[:8] == struct.pack("<HHHH", 0xF872, 0x4E1F, 11, 96 * 8)


def test_pixels():
    rnd = np.random.default_rng(1)
    y, u, v, a = (rnd.integers(0, 256, s, dtype=np.uint8) for s in ((5, 6), (3, 3), (3, 3), (5, 6)))
    out = bits.planar420_to_packed422(y, u, v)
    assert all(list(out[r, 4 * c : 4 * c + 4]) == [u[r // 2, c], y[r, 2 * c], v[r // 2, c], y[r, 2 * c + 1]] for r in range(5) for c in range(3))
    deep = bits.planar420_to_packed422(y.astype(np.uint16) << 2, u.astype(np.uint16) << 2, v.astype(np.uint16) << 2, 2)
    assert (deep == out).all()
    assert list(bits.alpha420_to_4444(y, u, v, a)[3, 4:8]) == [u[1, 0], y[3, 1], v[1, 0], a[3, 1]]
    assert bits.planar410_to_packed422(np.zeros((8, 8), np.uint8), np.ones((2, 2), np.uint8), np.ones((2, 2), np.uint8)).shape == (8, 16)
    assert list(bits.swap_rgb24(np.arange(6, dtype=np.uint8))) == [2, 1, 0, 5, 4, 3]
    assert bits.swap_bytes(b"\1\2\3\4", 2) == b"\2\1\4\3"
    assert list(bits.near_black(np.array([0xFF000000, 5], np.uint32))) == [0xFF010101, 5]
    assert list(bits.permute_channels(np.array([1, 2, 3, 4]), [1, 0])) == [2, 1, 4, 3]


def test_parsers_in_sql(spark):
    bits.register(spark)
    got = spark.createDataFrame([(zlib.compress(b"abc"),), (b"x",), (None,)], "b binary").selectExpr("inflate(b) AS x").collect()
    assert [r.x if r.x is None else bytes(r.x) for r in got] == [b"abc", None, None]


def test_damaged_input_gives_null():
    rnd = random.Random(9)
    for name, (f, _) in bits.PARSERS.items():
        for _ in range(300):
            data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(40)))
            try:
                f(data)
            except (ValueError, IndexError, struct.error):
                pass
            except Exception as e:  # noqa: BLE001
                raise AssertionError(f"{name}: {e!r} on {data!r}") from e


def test_codes():
    from cuegrain.functions import codecs

    assert codecs.fourcc("DTS_") == 0x44545320 and codecs.fourcc("0x6D732000") == 0x6D732000
    assert len(codecs.language_rows()) == len({r[2] for r in codecs.language_rows()})


def test_pictures():
    assert bits.convert_picture(bytes(range(12)), "BGR24", 2, 2) == bytes([2, 1, 0, 5, 4, 3, 8, 7, 6, 11, 10, 9])
    assert bits.convert_picture(b"\1" * 9 + b"\2" * 4 + b"\3" * 4, "YUV420P", 3, 3) == b"\2\1\3\1" * 3
    assert bits.convert_picture(b"", "PAL8", 1, 1) is None


def test_vorbis_private():
    cookie = b"".join(bits.atom(k.encode(), v) for k, v in zip(bits.VORBIS_ATOMS, (b"a" * 255, b"b" * 3, b"c"), strict=True))
    assert bits.xiph_split(bits.vorbis_private(cookie)) == [b"a" * 255, b"b" * 3, b"c"]
    assert bits.vorbis_private(cookie[:-9]) is None
