"""Codec, pixel format and language tables, and the look-ups over them.

Every table is a small DataFrame of constants; look-ups reduce it to one row a key by an explicit
rule (first or last match) and join, which Spark broadcasts as its size is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup

# Identifiers of codecs in Matroska files and their four-character codes, first match first.
MATROSKA = """
V_UNCOMPRESSED raw_
V_MPEG4/ISO/ASP mp4v
V_MPEG4/ISO/SP mp4v
V_MPEG4/ISO/AP mp4v
V_MPEG4/ISO/AVC avc1
V_MPEG4/MS/V3 MP43
V_MPEG1 mp1v
V_MPEG2 mp2v
V_REAL/RV10 RV10
V_REAL/RV20 RV20
V_REAL/RV30 RV30
V_REAL/RV40 RV40
V_THEORA PeTh
V_SNOW SNOW
V_VP8 VP80
A_AAC aac_
A_AAC/MPEG4/LC aac_
A_AAC/MPEG4/MAIN aac_
A_AAC/MPEG4/LC/SBR aac_
A_AAC/MPEG4/SSR aac_
A_AAC/MPEG4/LTP aac_
A_AAC/MPEG2/LC aac_
A_AAC/MPEG2/MAIN aac_
A_AAC/MPEG2/LC/SBR aac_
A_AAC/MPEG2/SSR aac_
A_MPEG/L1 .mp1
A_MPEG/L2 .mp2
A_MPEG/L3 .mp3
A_AC3 ac-3
A_AC3 0x6D732000
A_AC3/BSID9 ac-3
A_AC3/BSID10 ac-3
A_VORBIS XiVs
A_FLAC XiFL
A_PCM/INT/LIT lpcm
A_PCM/INT/BIG lpcm
A_PCM/FLOAT/IEEE lpcm
A_DTS DTS_
A_TTA1 TTA1
A_WAVPACK4 WVPK
A_REAL/14_4 14_4
A_REAL/28_8 28_8
A_REAL/COOK COOK
A_REAL/SIPR SIPR
A_REAL/RALF RALF
A_REAL/ATRC ATRC
S_TEXT/SSA SSA_
S_SSA SSA_
S_TEXT/ASS ASS_
S_ASS ASS_
S_TEXT/UTF8 SRT_
S_TEXT/ASCII SRT_
S_VOBSUB SPU_
"""
# Two-byte codes of sound formats in wave headers.
WAVE = """
0x50 .mp2
0x55 .mp3
0x2000 ac-3
0x2001 DTS_
0xFF aac_
0xF1AC XiFL
"""
# Sound formats and the decoder of each, first match first in both directions.
AUDIO = """
0x6D730160 WMAV1
0x6D730161 WMAV2
FlAd ADPCM_SWF
XiVs VORBIS
.mp1 MP1
.mp2 MP2
.mp3 MP3
0x6D730050 MP2
DTS_ DTS
NELL NELLYMOSER
TTA1 TTA
0x6D732000 AC3
lpcm PCM_S16LE
lpcm PCM_U8
alaw PCM_ALAW
ulaw PCM_MULAW
0x6D730002 ADPCM_MS
aac_ AAC
"""
# The catalogue of supported codes: decoder, name, codes.
REGISTRY = """
MSMPEG4V1|MS-MPEG4 v1|MPG4 mpg4 DIV1 div1
MSMPEG4V2|MS-MPEG4 v2|MP42 mp42 DIV2 div2
MSMPEG4V3|DivX 3|MPG3 mpg3 MP43 mp43 DIV3 div3 DIV4 div4 DIV5 div5 DIV6 div6 AP41 COL0 col0 COL1 col1
MPEG4|DivX 4|DIVX divx mp4s MP4S M4S2 m4s2 0x04000000 UMP4
MPEG4|DivX 5|DX50
MPEG4|3ivx|3IVD 3ivd 3IV2 3iv2
MPEG4|Xvid|XVID xvid XviD XVIX BLZ0
MPEG4|MPEG-4|RMP4 SEDG WV1F FMP4 SMP4 mp4v
H264|H.264|H264 h264 X264 x264 DAVC VSSH AVC1 avc1
FLV1|Sorenson H.263|FLV1
FLASHSV|Flash Screen Video|FSV1
VP6|TrueMotion VP6|VP60 VP61 VP62
VP6F|TrueMotion VP6|VP6F FLV4
H263I|Intel H.263|I263 i263
VP3|On2 VP3|VP30 VP31
HUFFYUV|HuffYUV|HFYU
FFVHUFF|HuffYUV|FFVH
MPEG1VIDEO|MPEG-1|MPEG mpg1 mp1v
MPEG2VIDEO|MPEG-2|MPG2 mpg2 mp2v
FRAPS|Fraps|FPS1
SNOW|Snow|SNOW
NUV|NuppelVideo|RJPG NUV1
INDEO2|Indeo 2|RT21
INDEO3|Indeo 3|IV32 iv32 IV31 iv31
INDEO4|Indeo 4|IV41 iv41
INDEO5|Indeo 5|IV50 iv50
TSCC|Techsmith Screen Capture|tscc
ZMBV|DosBox Capture|ZMBV
VP6A|On2 VP6A|VP6A
VP8|On2 VP8|VP80
FFV1|FFv1|FFV1
THEORA|Xiph Theora|PeTh
DXTORY|Dxtory|xtor
DVD_SUBTITLE|VobSub|SPU_
NONE|H.264|CAVC
NONE|MPEG-4|CMP4
NONE|SSA Text Subtitle|SSA_
NONE|Text Subtitle|SRT_
WMAV1|Windows Media Audio 1|0x6D730160
WMAV2|Windows Media Audio 2|0x6D730161
ADPCM_SWF|Flash ADPCM|FlAd
VORBIS|Vorbis|XiVs
MP1|MPEG-1 Layer 1|.mp1
MP2|MPEG-1 Layer 1/2|0x6D730050
MP2|MPEG-1 Layer 2|.mp2
TTA|True Audio|TTA1
DTS|DTS Coherent Acoustics|DTS_
NELLYMOSER|Nellymoser ASAO|NELL
NONE|AC3|CAC3
NONE|MPEG-1 Layer 1|CMP1
NONE|MPEG-1 Layer 2|CMP2
NONE|MP3|CMP3
NONE|DTS Coherent Acoustics|CDTS
"""
# Codes of streams with stripped headers, and of the streams inside.
WRAPPED = """
CAVC avc1
CMP4 mp4v
CMP1 .mp1
CMP2 .mp2
CMP3 .mp3
CAC3 ac-3
CDTS DTS_
"""
# Input pixel format, format it is shown in, code of that.
PIXELS = """
RGB555LE RGB555BE 0x00000010
RGB555BE RGB555BE 0x00000010
BGR24 RGB24 0x00000018
RGB24 RGB24 0x00000018
ARGB ARGB 0x00000020
BGRA ARGB 0x00000020
YUV410P YUV422P 2vuy
YUVJ420P YUV422P 2vuy
YUV420P YUV422P 2vuy
YUV422P YUV422P 2vuy
YUVA420P YUV444P v408
YUV420P9LE YUV422P 2vuy
YUV420P10LE YUV422P 2vuy
YUV420P16LE YUV422P 2vuy
"""
# ISO 639 codes of two letters (- where there is none) and three, and the number of the language.
LANGUAGES = """
- und 32767
af afr 141
sq alb 36
sq sqi 36
am amh 85
ar ara 12
hy arm 51
hy hye 51
as asm 68
ay aym 134
az aze 49
eu baq 129
eu eus 129
bn ben 67
br bre 142
bg bul 44
my bur 77
my mya 77
ca cat 130
zh chi 19
zh zho 19
cs cze 38
cs ces 38
da dan 7
nl dut 4
nl nld 4
dz dzo 137
en eng 0
eo epo 94
et est 27
fo fao 30
fi fin 13
fr fre 1
fr fra 1
ka geo 52
ka kat 52
de ger 2
de deu 2
gl glg 140
gd gla 144
ga gle 35
gv glv 145
- grc 148
el gre 14
el ell 14
gn grn 133
gu guj 69
he heb 10
hi hin 21
hu hun 26
is ice 15
is isl 15
id ind 81
it ita 3
jv jav 138
ja jpn 11
kl kal 149
kn kan 73
ks kas 61
kk kaz 48
km khm 78
rw kin 90
ky kir 54
ko kor 23
ku kur 60
lo lao 79
la lat 131
lv lav 28
lt lit 24
mk mac 43
mk mkd 43
ml mal 72
mr mar 66
ms may 83
ms msa 83
mg mlg 93
mt mlt 16
mo mol 53
mn mon 57
ne nep 64
nb nob 9
no nor 9
nn nno 151
ny nya 92
or ori 71
om orm 87
pa pan 70
fa per 31
fa fas 31
pl pol 25
pt por 8
qu que 132
ro rum 37
ro ron 37
rn run 91
ru rus 32
sa san 65
sr scc 42
sr srp 42
hr scr 18
hr hrv 18
si sin 76
- sit 63
sk slo 39
sk slk 39
sl slv 40
se sme 29
- smi 29
sd snd 62
so som 88
es spa 6
su sun 139
sw swa 89
sv swe 5
ta tam 74
tt tat 135
te tel 75
tg tgk 55
tl tgl 82
th tha 22
bo tib 63
bo bod 63
ti tir 86
- tog 147
tr tur 17
tk tuk 56
ug uig 136
uk ukr 45
ur urd 20
uz uzb 47
vi vie 80
cy wel 128
cy cym 128
yi yid 41
"""
UNSPECIFIED = 32767
# Formats whose decoders need the file's private bytes before they open.
NEEDS_PRIVATE = (0x6D730160, 0x6D730161, int.from_bytes(b"XiVs", "big"), int.from_bytes(b"TTA1", "big"))


def fourcc(text: str) -> int:
    """Four characters (_ for a space at the end) or a hexadecimal number as a big-endian number."""
    return int(text, 16) if text.startswith("0x") else int.from_bytes(text.replace("_", " ").encode() if text.endswith("_") else text.encode(), "big")


def rows_of(table: str) -> list[list[str]]:
    return [line.split() for line in table.strip().splitlines()]


def registry_rows() -> list[tuple[int, str, str, int]]:
    """(ord, decoder, name, code) of the catalogue, one row a code."""
    out = []
    for line in REGISTRY.strip().splitlines():
        decoder, name, codes = line.split("|")
        out += [(decoder, name, fourcc(c)) for c in codes.split()]
    return [(i, *x) for i, x in enumerate(out)]


def language_rows() -> list[tuple[int, str, str, int]]:
    return [(i, "" if two == "-" else two, three, int(n)) for i, (two, three, n) in enumerate(rows_of(LANGUAGES))]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), "ord int, decoder string, name string, fourcc long")


def decoder_of(rows: DataFrame) -> DataFrame:
    """rows (fourcc, ...) with decoder: the first row of the catalogue that has the code, NONE for others."""
    return lookup.match(rows, registry(rows.sparkSession), ["fourcc"], "decoder", "ord", default=F.lit("NONE"))


def _audio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, fourcc(a), b) for i, (a, b) in enumerate(rows_of(AUDIO))], "ord int, fourcc long, decoder string")


def audio_decoder_of(rows: DataFrame) -> DataFrame:
    """rows (fourcc, ...) with the decoder of a sound format; NONE for others."""
    return lookup.match(rows, _audio(rows.sparkSession), ["fourcc"], "decoder", "ord", default=F.lit("NONE"))


def audio_code_of(rows: DataFrame) -> DataFrame:
    """rows (decoder, ...) with the code of the first format that the decoder reads; 0 for others."""
    return lookup.match(rows, _audio(rows.sparkSession), ["decoder"], "fourcc", "ord", default=F.lit(0))


def _number(data: Column, at: int, n: int, little: bool = False) -> Column:
    """An unsigned number of n bytes at an offset of binary data."""
    digits = F.hex(F.substring(data, at + 1, n))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.conv(digits, 16, 10).cast("long")


def matroska_code(rows: DataFrame) -> DataFrame:
    """rows (codec_id, codec_private, ...) with fourcc.

    The first row of the table that has the identifier; identifiers that stand for other files'
    codes take it from the private bytes: a bitmap header (20 bytes at least), a wave header (3 at
    least; its two-byte code by the wave table, else tagged as such), or an image description (5 at
    least). 0 for all others.
    """
    spark, private = rows.sparkSession, F.col("codec_private")
    size = F.coalesce(F.octet_length(private), F.lit(0))
    dim = spark.createDataFrame([(i, a, fourcc(b)) for i, (a, b) in enumerate(rows_of(MATROSKA))], "ord int, codec_id string, fourcc long")
    wave = spark.createDataFrame([(i, int(a, 16), fourcc(b)) for i, (a, b) in enumerate(rows_of(WAVE))], "ord int, _two long, _wave long")
    out = lookup.match(rows.withColumn("_two", _number(private, 0, 2, little=True)), dim, ["codec_id"], "fourcc", "ord")
    out = lookup.match(out, wave, ["_two"], "_wave", "ord")
    own = (
        F.when((F.col("codec_id") == "V_MS/VFW/FOURCC") & (size > 19), _number(private, 16, 4))
        .when((F.col("codec_id") == "A_MS/ACM") & (size > 2), F.coalesce("_wave", F.col("_two") + 0x6D730000))
        .when((F.col("codec_id") == "V_QUICKTIME") & (size > 4), _number(private, 0, 4))
    )
    return out.withColumn("fourcc", F.coalesce(own, "fourcc", F.lit(0))).drop("_two", "_wave")


def matroska_id(rows: DataFrame) -> DataFrame:
    """rows (fourcc, ...) with codec_id for writing: the last row of the table that has the code wins."""
    dim = rows.sparkSession.createDataFrame([(i, a, fourcc(b)) for i, (a, b) in enumerate(rows_of(MATROSKA))], "ord int, codec_id string, fourcc long")
    return lookup.match(rows, dim, ["fourcc"], "codec_id", "ord", last=True)


def unwrapped(rows: DataFrame) -> DataFrame:
    """rows (fourcc, ...) with original: the code of the stream inside one with stripped headers, and wrapped: the way back; 0 for others."""
    pairs = [(i, fourcc(a), fourcc(b)) for i, (a, b) in enumerate(rows_of(WRAPPED))]
    spark = rows.sparkSession
    out = lookup.match(rows, spark.createDataFrame(pairs, "ord int, fourcc long, original long"), ["fourcc"], "original", "ord", default=F.lit(0))
    return lookup.match(out, spark.createDataFrame(pairs, "ord int, wrapped long, fourcc long"), ["fourcc"], "wrapped", "ord", default=F.lit(0))


def shown_as(rows: DataFrame) -> DataFrame:
    """rows (pixels, ...) with the format that they are shown in (null: unknown) and its code (0: none)."""
    dim = [(i, a, b, fourcc(c)) for i, (a, b, c) in enumerate(rows_of(PIXELS))]
    dim = rows.sparkSession.createDataFrame(dim, "ord int, pixels string, shown string, shown_code long")
    out = lookup.match(rows, dim.drop("shown_code"), ["pixels"], "shown", "ord")
    return lookup.match(out, dim.drop("shown"), ["pixels"], "shown_code", "ord", default=F.lit(0))


def language_number(rows: DataFrame, column: str = "lang") -> DataFrame:
    """rows with language: the number of a two- or three-letter code in either case, by its first row; UNSPECIFIED for others."""
    spark = rows.sparkSession
    names = [(i, name, n) for i, two, three, n in language_rows() for name in (two, three) if name]
    dim = spark.createDataFrame(names, "ord int, _lang string, language int")
    return lookup.match(rows.withColumn("_lang", F.lower(column)), dim, ["_lang"], "language", "ord", default=F.lit(UNSPECIFIED)).drop("_lang")


def invalid_image(pixels: Column, width: Column, height: Column) -> Column:
    """Pictures too small for their format: planes of half the size need two columns and rows, those of half the width two rows."""
    return (pixels.isin("YUVJ420P", "YUV420P", "YUVA420P") & ((width < 2) | (height < 2))) | ((pixels == "YUV422P") & (height < 2))


def needs_private(code: Column) -> Column:
    return code.isin(*NEEDS_PRIVATE)


def cleared(shown: Column, width: Column, height: Column) -> Column:
    """A black picture: packed luma and chroma of 2 or 4 bytes a pixel, zeros for the others."""
    pixel = F.when(shown == "YUV422P", "8010").when(shown == "YUV444P", "801080EB").when(shown == "RGB555BE", "0000").when(shown == "RGB24", "000000").when(shown == "ARGB", "00000000")
    return F.unhex(F.repeat(pixel, (width * height).cast("int")))


def cropped_rows(data: Column, stride: Column, row_bytes: Column, height: Column) -> Column:
    """The first row_bytes of each row of a picture, without the padding behind them."""
    digits = F.hex(data)
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda y: digits.substr((y * stride * 2 + 1).cast("int"), (row_bytes * 2).cast("int")))
    return F.unhex(F.array_join(rows, ""))


def image_description(data: Column) -> Column:
    """Fields of a big-endian image description: size, code, width, height, frames, depth, and whether more follows."""
    return F.struct(
        _number(data, 0, 4).alias("size"), F.decode(F.substring(data, 5, 4), "ISO-8859-1").alias("code"), _number(data, 32, 2).alias("width"), _number(data, 34, 2).alias("height"), _number(data, 48, 2).alias("frames"), _number(data, 82, 2).alias("depth"), (F.octet_length(data) > 86).alias("extended"),
    )


def packed_lane(table: Column, i: Column, width: int) -> Column:
    """Lane i (4, 8 or 16 bits, lowest first) of an array of 32-bit numbers."""
    lanes = 32 // width
    word = F.get(table, F.floor(i / lanes).cast("int")).cast("long")
    return F.floor(word / F.pow(F.lit(2.0), (i % lanes) * width)).cast("long").bitwiseAND(F.lit((1 << width) - 1))
