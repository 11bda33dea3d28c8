"""Decoders of binary headers and pixel kernels, as Arrow-batched functions.

Each is a small function on bytes; ``udf`` gives it a column form, and ``register`` names them
all in a session.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, n: int) -> int:
        v = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0
            v = v << 1 | byte >> (7 - (self.at & 7)) & 1
            self.at += 1
        return v

    def ue(self) -> int:
        """Unsigned Exp-Golomb."""
        zeros = 0
        while not self.get(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("no such code")
        return (1 << zeros) - 1 + self.get(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def unescape(nal: bytes) -> bytes:
    """A NAL unit without its emulation bytes (00 00 03)."""
    return nal.replace(b"\0\0\3", b"\0\0")


def nal_units(stream: bytes) -> list[bytes]:
    """Units between start codes."""
    out, at = [], stream.find(b"\0\0\1")
    while at >= 0:
        nxt = stream.find(b"\0\0\1", at + 3)
        out.append(stream[at + 3 : nxt if nxt >= 0 else len(stream)].rstrip(b"\0"))
        at = nxt
    return [u for u in out if u]


#: Slice types by number, and profiles whose parameter sets hold chroma fields.
SLICES = "PBIPIPBIPI"
HIGH = (100, 110, 122, 244, 44, 83, 86, 118, 128)


def sequence_parameters(nal: bytes | None) -> dict | None:
    """Profile, level, picture size and structure of an H.264 sequence parameter set."""
    if not nal or nal[0] & 31 != 7:
        return None
    b = Bits(unescape(nal[1:]))
    profile, _, level = b.get(8), b.get(8), b.get(8)
    b.ue()
    chroma = 1
    if profile in HIGH:
        chroma = b.ue()
        if chroma == 3:
            b.get(1)
        b.ue(), b.ue(), b.get(1)
        if b.get(1):
            for i in range(8 if chroma != 3 else 12):
                if b.get(1):
                    last = nxt = 8
                    for _ in range(16 if i < 6 else 64):
                        if nxt:
                            nxt = (last + b.se()) % 256
                        last = nxt or last
    frame_bits, poc, poc_bits = b.ue() + 4, b.ue(), 0
    if poc == 0:
        poc_bits = b.ue() + 4
    elif poc == 1:
        b.get(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    refs, _, width, height, mbs_only = b.ue(), b.get(1), b.ue() + 1, b.ue() + 1, b.get(1)
    if not mbs_only:
        b.get(1)
    b.get(1)
    if b.get(1):
        b.ue(), b.ue(), b.ue(), b.ue()
    reorder = _reorder_frames(b) if b.get(1) else None
    return {"profile": profile, "level": level, "poc_type": poc, "ref_frames": refs, "width": width * 16, "height": height * 16 * (2 - mbs_only), "frame_mbs_only": bool(mbs_only), "frame_bits": frame_bits, "poc_bits": poc_bits, "reorder_frames": reorder}


def _reorder_frames(b: Bits) -> int | None:
    """How many frames are held back for re-ordering, by the usability part of a parameter set; None if it doesn't say."""
    if b.get(1) and b.get(8) == 255:
        b.get(32)
    if b.get(1):
        b.get(1)
    if b.get(1):
        b.get(4)
        if b.get(1):
            b.get(24)
    if b.get(1):
        b.ue(), b.ue()
    if b.get(1):
        b.get(65)
    buffers = [b.get(1) and _skip_buffer_model(b) for _ in range(2)]
    if any(buffers):
        b.get(1)
    b.get(1)
    if not b.get(1):
        return None
    b.get(1)
    return [b.ue() for _ in range(5)][-1]


def _skip_buffer_model(b: Bits) -> bool:
    n = b.ue() + 1
    b.get(8)
    for _ in range(n):
        b.ue(), b.ue(), b.get(1)
    b.get(20)
    return True


def picture_parameters(nal: bytes | None) -> dict | None:
    """Identifiers, entropy coding and order flag of an H.264 picture parameter set."""
    if not nal or nal[0] & 31 != 8:
        return None
    b = Bits(unescape(nal[1:]))
    return {"pps_id": b.ue(), "sps_id": b.ue(), "cabac": bool(b.get(1)), "order_present": bool(b.get(1))}


def slice_order(stream: bytes | None) -> dict | None:
    """Kind, frame number and order count (its low bits) of the first slice behind the parameter sets in a stream; order only where the stream counts by it (type 0)."""
    sps = pps = None
    for u in nal_units(stream or b""):
        sps, pps = sequence_parameters(u) or sps, picture_parameters(u) or pps
        if u[0] & 31 not in (1, 5) or sps is None:
            continue
        b = Bits(unescape(u[1:60]))
        b.ue()
        kind = b.ue()
        if kind > 9:
            return None
        b.ue()
        number, field = b.get(sps["frame_bits"]), 0
        if not sps["frame_mbs_only"]:
            field = b.get(1)
            if field:
                b.get(1)
        if u[0] & 31 == 5:
            b.ue()
        order = None
        if sps["poc_type"] == 0:
            order = b.get(sps["poc_bits"])
            if pps and pps["order_present"] and not field:
                order += min(b.se(), 0)
        return {"kind": SLICES[kind], "frame": number, "order": order}
    return None


def frame_kind(stream: bytes | None) -> dict | None:
    """Kind of a picture from its slices: I, P or B (the kind that needs most), whether all of it may be skipped, and IDR."""
    if stream is None:
        return None
    kinds, refs, idr = [], [], False
    for u in nal_units(stream):
        if u[0] & 31 in (1, 5):
            b = Bits(unescape(u[1:40]))
            b.ue()
            kinds.append({"I": 0, "P": 1, "B": 2}[SLICES[b.ue() % 10]])
            refs.append(u[0] >> 5 & 3)
            idr |= u[0] & 31 == 5
    if not kinds:
        return None
    kind = "IPB"[max(kinds)]
    return {"kind": "P" if kind == "I" and not idr else kind, "skippable": not any(refs), "idr": idr}


#: AC-3 sample rates, bit rates (kbit/s) and channels by coding mode.
AC3_RATES = (48000, 44100, 32000)
AC3_BITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


def ac3_header(data: bytes | None) -> dict | None:
    """Rate, bit rate and channels of the first AC-3 frame; None without one, or beyond the defined versions."""
    at = (data or b"").find(b"\x0b\x77")
    if data is None or at < 0 or len(data) < at + 8:
        return None
    code, size = data[at + 4] >> 6, data[at + 4] & 63
    version, mode = data[at + 5] >> 3, data[at + 6] >> 5
    if code == 3 or size >= 38 or version >= 12:
        return None
    b = Bits(data[at + 6 : at + 9])
    b.get(3)
    if mode & 1 and mode != 1:
        b.get(2)
    if mode & 4:
        b.get(2)
    if mode == 2:
        b.get(2)
    lfe, half = b.get(1), max(version - 8, 0)
    return {"rate": AC3_RATES[code] >> half, "bit_rate": AC3_BITS[size >> 1] * 1000 >> half, "channels": AC3_CHANNELS[mode] + lfe, "lfe": bool(lfe)}


def descriptor_length(data: bytes, at: int = 0) -> tuple[int, int]:
    """Seven bits a byte, four bytes at most."""
    n = 0
    for _ in range(4):
        n, more, at = n << 7 | data[at] & 127, data[at] & 128, at + 1
        if not more:
            break
    return n, at


def decoder_config(esds: bytes | None) -> bytes | None:
    """The decoder's own bytes inside an elementary stream descriptor."""
    if not esds:
        return None
    at = 4 if esds[:4] == b"\0\0\0\0" else 0
    try:
        while at < len(esds):
            tag = esds[at]
            n, at = descriptor_length(esds, at + 1)
            if tag == 3:
                flags = esds[at + 2]
                at += 3 + 2 * (flags >> 7) + (1 + esds[at + 3] if flags & 64 else 0) + 2 * (flags >> 5 & 1)
            elif tag == 4:
                at += 13
            elif tag == 5:
                return esds[at : at + n]
            else:
                at += n
    except IndexError:
        pass
    return None


def elementary_descriptor(private: bytes, object_type: int, stream_type: int, track: int = 0) -> bytes:
    """A descriptor around a decoder's bytes; decoder_config undoes it."""
    size = lambda n: bytes([n >> 21 & 127 | 128, n >> 14 & 127 | 128, n >> 7 & 127 | 128, n & 127])
    info = b"\x05" + size(len(private)) + private
    config = b"\x04" + size(13 + len(info)) + bytes([object_type, stream_type]) + b"\0" * 11 + info
    sync = b"\x06" + size(1) + b"\x02"
    return b"\0\0\0\0\x03" + size(3 + len(config) + len(sync)) + struct.pack(">HB", track, 0) + config + sync


def xiph_split(private: bytes | None) -> list[bytes] | None:
    """The three packets of a Xiph codec's private bytes."""
    if not private or private[0] != 2:
        return None
    at, sizes = 1, []
    try:
        for _ in range(2):
            n = 0
            while private[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + private[at])
            at += 1
    except IndexError:
        return None
    if at + sum(sizes) > len(private):
        return None
    return [private[at : at + sizes[0]], private[at + sizes[0] : at + sum(sizes)], private[at + sum(sizes) :]]


def flac_blocks(data: bytes | None) -> list[dict] | None:
    """(kind, size, last) of FLAC metadata blocks."""
    if not data or data[:4] != b"fLaC":
        return None
    at, out = 4, []
    while at + 4 <= len(data):
        kind, size = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        out.append({"kind": kind, "size": size, "last": bool(data[at] & 128)})
        at += 4 + size
        if out[-1]["last"]:
            break
    return out


def atoms(data: bytes | None) -> list[dict]:
    """(type, payload) records: a 32-bit length that counts itself, four characters, payload."""
    out, at = [], 0
    while data and at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size < 8 or at + size > len(data):
            break
        out.append({"type": data[at + 4 : at + 8].decode("latin-1"), "payload": data[at + 8 : at + size]})
        at += size
    return out


def inflate(data: bytes | None, size: int | None = None) -> bytes | None:
    """zlib data, up to ``size`` bytes; None if damaged."""
    if data is None:
        return None
    try:
        d = zlib.decompressobj()
        out = d.decompress(data, size or 0)
    except zlib.error:
        return None
    return out if d.eof or size and len(out) == size else None


def subpicture_times(packet: bytes | None) -> dict | None:
    """Start and end (milliseconds, 16 bits as stored) and the forced flag of a subpicture's control sequences."""
    if not packet or len(packet) < 4:
        return None
    at = struct.unpack(">H", packet[2:4])[0]
    start = end = 0
    forced = False
    sizes = {3: 2, 4: 2, 5: 6, 6: 4}
    seen = set()
    while at + 4 <= len(packet) and at not in seen:
        seen.add(at)
        tick, nxt = struct.unpack(">HH", packet[at : at + 4])
        ms, i = ((tick << 10) // 90) & 0xFFFF, at + 4
        while i < len(packet) and packet[i] != 255:
            c = packet[i]
            forced |= c == 0
            if c in (0, 1):
                start = ms
            elif c == 2:
                end = ms
            elif c not in sizes:
                break
            i += 1 + sizes.get(c, 0)
        at = nxt
    return {"start": start, "end": end, "forced": forced}


def configuration_units(avcc: bytes | None) -> list[bytes] | None:
    """Parameter sets inside an avcC record."""
    if not avcc or len(avcc) < 7 or avcc[0] != 1:
        return None
    out, at = [], 5
    for mask in (31, 255):
        n = avcc[at] & mask
        at += 1
        for _ in range(n):
            size = struct.unpack(">H", avcc[at : at + 2])[0]
            out.append(avcc[at + 2 : at + 2 + size])
            at += 2 + size
        if at >= len(avcc):
            break
    return out


def mpeg_picture_kind(data: bytes | None) -> str | None:
    """I, P or B from the first MPEG-1 or MPEG-2 picture header."""
    at = (data or b"").find(b"\0\0\1\0")
    if data is None or at < 0 or at + 5 >= len(data):
        return None
    return {1: "I", 2: "P", 3: "B"}.get(data[at + 5] >> 3 & 7)


def unframe_subpicture(framed: bytes | None, stream: int | None = None) -> bytes | None:
    """The subpicture inside program-stream packets, up to its own declared size; of one substream, or of any."""
    if not framed:
        return None
    out, at = b"", 0
    while at + 6 <= len(framed) and framed[at : at + 3] == b"\0\0\1":
        kind = framed[at + 3]
        if kind == 0xBA:
            at += 14 + (framed[at + 13] & 7)
            continue
        size = struct.unpack(">H", framed[at + 4 : at + 6])[0]
        if kind == 0xBD:
            head = at + 9 + framed[at + 8]
            if stream is None or framed[head] & 31 == stream:
                out += framed[head + 1 : at + 6 + size]
            if len(out) >= 2 and len(out) >= struct.unpack(">H", out[:2])[0]:
                break
        elif kind not in (0xBE, 0xBF):
            break
        at += 6 + size
    return out[: struct.unpack(">H", out[:2])[0]] if len(out) >= 2 else None


def subpicture_colours(packet: bytes | None, palette: list[int] | None) -> list[int] | None:
    """Four ARGB colours of a subpicture from its first control sequence; None unless colours and contrast are both there."""
    if not packet or not palette or len(packet) < 4:
        return None
    at = struct.unpack(">H", packet[2:4])[0] + 4
    colours = contrast = None
    while at < len(packet) and packet[at] != 255:
        c = packet[at]
        if c == 3:
            colours = [packet[at + 2] & 15, packet[at + 2] >> 4, packet[at + 1] & 15, packet[at + 1] >> 4]
        elif c == 4:
            contrast = [packet[at + 2] & 15, packet[at + 2] >> 4, packet[at + 1] & 15, packet[at + 1] >> 4]
        at += {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 7, 6: 5}.get(c, len(packet))
    if colours is None or contrast is None:
        return None
    return [a * 17 << 24 | palette[c] & 0xFFFFFF for c, a in zip(colours, contrast, strict=True)]


def bitmap_header(width: int, height: int, bits_: int, code: bytes, extra: bytes = b"", as_width: bool = False) -> bytes:
    """A BITMAPINFOHEADER; ``as_width`` writes the width in the place of the height, as an old writer did."""
    return struct.pack("<IiiHH4sIiiII", 40 + len(extra), width, width if as_width else height, 1, bits_, code, width * height * bits_ // 8, 0, 0, 0, 0) + extra


def atom(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def wave_cookie(format_: bytes, tag: int, channels: int, rate: int, byte_rate: int, align: int, bits_: int, extra: bytes = b"") -> bytes:
    """The atoms of a sound description: format, the little-endian wave header under the same name, and an end."""
    header = struct.pack("<HHIIHHH", tag, channels, rate, byte_rate, align, bits_, len(extra)) + extra
    return atom(b"frma", format_) + atom(format_, header) + atom(b"\0\0\0\0", b"")


#: Burst types of DTS frames by their number of samples (IEC 61937).
DTS_TYPES = {512: 11, 1024: 12, 2048: 13}


def dts_burst(frame: bytes | None) -> bytes | None:
    """A DTS core frame as a burst of 16-bit words for a digital output, padded to its samples; None for other sizes."""
    if not frame or len(frame) < 8 or frame[:4] != b"\x7f\xfe\x80\x01":
        return None
    samples = (((frame[4] & 1) << 6 | frame[5] >> 2) + 1) * 32
    if samples not in DTS_TYPES or len(frame) + 8 > samples * 4:
        return None
    body = frame + b"\0" * (len(frame) & 1)
    words = np.frombuffer(body, ">u2").astype("<u2").tobytes()
    return (struct.pack("<HHHH", 0xF872, 0x4E1F, DTS_TYPES[samples], len(frame) * 8) + words).ljust(samples * 4, b"\0")


# ---------------------------------------------------------------- pixels


def planar420_to_packed422(y: np.ndarray, u: np.ndarray, v: np.ndarray, shift: int = 0) -> np.ndarray:
    """Rows of U Y V Y from planes; deeper samples are shifted right to eight bits. Every chroma row serves two picture rows."""
    h, w = y.shape
    w -= w & 1
    rows = np.minimum(np.arange(h) // 2, len(u) - 1)
    out = np.empty((h, w * 2), np.uint8)
    out[:, 1::2] = y[:, :w] >> shift
    out[:, 0::4] = u[rows, : w // 2] >> shift
    out[:, 2::4] = v[rows, : w // 2] >> shift
    return out


def planar422_to_packed422(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    w = y.shape[1] - (y.shape[1] & 1)
    out = np.empty((len(y), w * 2), np.uint8)
    out[:, 1::2], out[:, 0::4], out[:, 2::4] = y[:, :w], u[:, : w // 2], v[:, : w // 2]
    return out


def planar410_to_packed422(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Chroma at a quarter of the width and height."""
    wide = lambda c: np.repeat(np.repeat(c, 2, 1), 4, 0)[: len(y)]
    return planar422_to_packed422(y, wide(u), wide(v))


def alpha420_to_4444(y: np.ndarray, u: np.ndarray, v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows of U Y V A."""
    h, w = y.shape
    big = lambda c: np.repeat(np.repeat(c, 2, 0), 2, 1)[:h, :w]
    return np.stack([big(u), y, big(v), a], -1).reshape(h, w * 4)


def swap_rgb24(data: np.ndarray) -> np.ndarray:
    return data.reshape(*data.shape[:-1], -1, 3)[..., ::-1].reshape(data.shape)


def swap_bytes(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, f">u{width}").astype(f"<u{width}").tobytes()


def near_black(argb: np.ndarray) -> np.ndarray:
    """Opaque black becomes the darkest grey that isn't black."""
    return np.where(argb == 0xFF000000, np.uint32(0xFF010101), argb)


def permute_channels(samples: np.ndarray, order: list[int]) -> np.ndarray:
    return samples.reshape(-1, len(order))[:, order].reshape(-1)


def convert_picture(data: bytes, pixels: str, width: int, height: int) -> bytes | None:
    """A picture in the form that it is shown in, from its planes one behind the other without padding; None for formats that aren't known."""
    deep = {"YUV420P9LE": 1, "YUV420P10LE": 2, "YUV420P16LE": 8}.get(pixels)
    raw = np.frombuffer(data, "<u2" if deep else np.uint8)

    def planes(*sizes: tuple[int, int]) -> list[np.ndarray]:
        out, at = [], 0
        for h, w in sizes:
            out.append(raw[at : at + h * w].reshape(h, w))
            at += h * w
        return out

    half, quarter = ((height + 1) // 2, (width + 1) // 2), ((height + 3) // 4, (width + 3) // 4)
    whole = (height, width)
    if deep or pixels in ("YUV420P", "YUVJ420P"):
        return planar420_to_packed422(*planes(whole, half, half), shift=deep or 0).tobytes()
    if pixels == "YUV422P":
        return planar422_to_packed422(*planes(whole, (height, half[1]), (height, half[1]))).tobytes()
    if pixels == "YUV410P":
        return planar410_to_packed422(*planes(whole, quarter, quarter)).tobytes()
    if pixels == "YUVA420P":
        return alpha420_to_4444(*planes(whole, half, half, whole)).tobytes()
    if pixels == "BGR24":
        return swap_rgb24(raw.reshape(height, width * 3)).tobytes()
    if pixels in ("RGB555LE", "BGRA"):
        return swap_bytes(data, 2 if pixels == "RGB555LE" else 4)
    return data if pixels in ("RGB24", "RGB555BE", "ARGB") else None


@F.pandas_udf(BinaryType())
def converted(data: pd.Series, pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """``convert_picture`` on columns; null for planes of another size."""

    def one(d: bytes | None, p: str, w: int, h: int) -> bytes | None:
        try:
            return None if d is None else convert_picture(bytes(d), p, int(w), int(h))
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(data, pixels, width, height, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def coloured(packet: pd.Series, palette: pd.Series) -> pd.Series:
    """``subpicture_colours`` on columns."""
    return pd.Series([subpicture_colours(None if p is None else bytes(p), None if c is None else [int(x) for x in c]) for p, c in zip(packet, palette, strict=True)], dtype=object)


#: Atoms of a Vorbis cookie: header, comments, codebooks.
VORBIS_ATOMS = ("vCtH", "vCt#", "vCtC")


def vorbis_private(cookie: bytes | None) -> bytes | None:
    """A Vorbis decoder's private bytes (three packets, laced) from a cookie's atoms; of repeated atoms the last counts. None unless all three are there."""
    parts = {a["type"]: a["payload"] for a in atoms(cookie)}
    got = [parts.get(k) for k in VORBIS_ATOMS]
    if any(x is None for x in got):
        return None
    lace = b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in got[:2])
    return b"\x02" + lace + b"".join(got)


# ---------------------------------------------------------------- registry

SPS = "profile int, level int, poc_type int, ref_frames int, width int, height int, frame_mbs_only boolean, frame_bits int, poc_bits int, reorder_frames int"
PARSERS: dict[str, tuple[Callable, str]] = {
    "parse_sps": (sequence_parameters, SPS),
    "parse_pps": (picture_parameters, "pps_id int, sps_id int, cabac boolean, order_present boolean"),
    "parse_slice": (slice_order, "kind string, frame int, order int"),
    "parse_h264_frame": (frame_kind, "kind string, skippable boolean, idr boolean"),
    "parse_ac3": (ac3_header, "rate int, bit_rate int, channels int, lfe boolean"),
    "parse_esds": (decoder_config, "binary"),
    "split_xiph": (xiph_split, "array<binary>"),
    "parse_flac": (flac_blocks, "array<struct<kind:int,size:int,last:boolean>>"),
    "parse_atoms": (atoms, "array<struct<type:string,payload:binary>>"),
    "vorbis_private": (vorbis_private, "binary"),
    "inflate": (inflate, "binary"),
    "split_avcc": (configuration_units, "array<binary>"),
    "mpeg_picture_kind": (mpeg_picture_kind, "string"),
    "unframe_subpicture": (unframe_subpicture, "binary"),
    "dts_burst": (dts_burst, "binary"),
    "subpicture_times": (subpicture_times, "start int, end int, forced boolean"),
}


def udf(name: str):
    """The column function of a parser; damaged input gives null."""
    f, kind = PARSERS[name]
    flat = "struct" not in kind and "," in kind

    def safe(x):
        try:
            return f(None if x is None else bytes(x))
        except (ValueError, IndexError, struct.error):
            return None

    if flat:
        names = [c.split()[0] for c in kind.split(", ")]

        def run(data: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([safe(x) or dict.fromkeys(names) for x in data], columns=names, dtype=object)
    else:

        def run(data: pd.Series) -> pd.Series:
            return pd.Series([safe(x) for x in data], dtype=object)

    run.__annotations__ = {"data": pd.Series, "return": pd.DataFrame if flat else pd.Series}
    return F.pandas_udf(run, kind)


def register(spark: SparkSession) -> None:
    """Make every parser callable from SQL."""
    for name in PARSERS:
        spark.udf.register(name, udf(name))
