"""Scalar arithmetic of media headers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntsc_snap(num: Column, den: Column) -> Column:
    """A time base as struct(num, den): rates within 1/120 of n * 1000 / 1001 snap to 1001 / (n * 1000)."""
    rate = den / num
    n = F.floor(rate * 1.001 + 0.5)
    near = F.abs(rate - n * 1000 / 1001) < 1 / 120
    whole = F.abs(rate - F.floor(rate + 0.5)) < 1e-9
    snap = near & ~whole
    return F.struct(F.when(snap, 1001).otherwise(num).cast("long").alias("num"), F.when(snap, n * 1000).otherwise(den).cast("long").alias("den"))


def time_scale(den: Column, fps: Column) -> Column:
    """Ticks a second; beyond 100,000 the rate in thousandths."""
    return F.when(den > 100_000, F.round(fps * 1000).cast("long")).otherwise(den.cast("long"))


def rescale(t: str, to: str, frm: str) -> Column:
    return F.expr(f"({t} * {to}) div {frm}")


def display_size(w: Column, h: Column, dw: Column, dh: Column) -> Column:
    """Size on screen of a picture with a ratio-like display size: grown until it holds all pixels."""
    dw, dh = F.coalesce(F.nullif(dw, F.lit(0)), w), F.coalesce(F.nullif(dh, F.lit(0)), h)
    wide = dw * h >= dh * w
    small = (dw < w) | (dh < h)
    width = F.when(~small, dw).when(wide, F.round(h * dw / dh)).otherwise(w)
    height = F.when(~small, dh).when(wide, h).otherwise(F.round(w * dh / dw))
    return F.struct(width.cast("long").alias("w"), height.cast("long").alias("h"))


def colour_space(w: Column, h: Column) -> Column:
    """Primaries, transfer and matrix by height: high definition, else PAL (576 lines or 5:4), else NTSC."""
    kind = F.when(h > 576, "HD").when((h == 576) | (w * 4 == h * 5), "PAL").otherwise("NTSC")
    pick = lambda hd, pal, ntsc: F.when(kind == "HD", hd).when(kind == "PAL", pal).otherwise(ntsc)
    return F.struct(kind.alias("kind"), pick(1, 5, 6).alias("primaries"), F.lit(1).alias("transfer"), pick(1, 6, 6).alias("matrix"))


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor by a bounded Euclid over integers below 2 ** 31."""
    start = F.struct(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0))).alias("y"))))
    return end["x"]


def pixel_aspect(w: Column, h: Column, dw: Column, dh: Column) -> Column:
    """(dw * h) : (dh * w) in lowest terms; null for 1:1."""
    a, b = dw * h, dh * w
    g = gcd(a, b)
    return F.when(a != b, F.struct((a / g).cast("long").alias("h"), (b / g).cast("long").alias("v")))


def script_resolution(x: Column, y: Column) -> Column:
    """Width and height of a script's screen: 384 x 288 without any, 1280 pairs with 1024, else 4:3."""
    w = F.when(x.isNull() & y.isNull(), 384).when(x.isNull(), F.when(y == 1024, 1280).otherwise(F.floor(y * 4 / 3)))
    h = F.when(x.isNull() & y.isNull(), 288).when(y.isNull(), F.when(x == 1280, 1024).otherwise(F.floor(x * 3 / 4)))
    return F.struct(F.coalesce(w, x).cast("long").alias("w"), F.coalesce(h, y).cast("long").alias("h"))


def mp3_frames(rate: Column) -> Column:
    return F.when(rate > 24_000, 1152).otherwise(576)


def decodability(profile: Column, reorder: Column, frame_mbs_only: Column, enabled: Column) -> Column:
    """0 cannot, 1 prefer not, 2 prefer."""
    return F.when(~frame_mbs_only, 0).when((profile < 100) & (reorder < 2) & ~enabled, 1).otherwise(2)


def frame_class(kind: Column, skippable: Column, dropping: Column, original: Column) -> Column:
    return F.when((kind == "I") & ~skippable, "key").when(skippable & dropping, "droppable").when(kind.isNotNull(), "difference").otherwise(original)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
