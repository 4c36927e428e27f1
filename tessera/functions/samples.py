"""Colour, size and quality rules as column expressions. Integers are widened to BIGINT before products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-range BT.601 in 13-bit fixed point, forward and inverse, and the largest coded picture.
LUMA = (2449, 4809, 934)
CB = (-1382, -2714, 4096)
CR = (4096, -3430, -666)
FORWARD_BIAS, PRECISION = 4095, 13
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB, INVERSE_BIAS = 11485, 2819, 5850, 14516, 4096
MAX_SIDE, MAX_AREA = 16_888, 35_651_584


def clip(v: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def fixed_point(weights: tuple[int, int, int], r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(sum(c * w for c, w in zip((r, g, b), map(F.lit, weights), strict=True)).cast("bigint") + FORWARD_BIAS, PRECISION)


def luma(r: Column, g: Column, b: Column) -> Column:
    return fixed_point(LUMA, r, g, b)


def chroma(weights: tuple[int, int, int], r: Column, g: Column, b: Column) -> Column:
    """An 8-bit chroma sample, 128 for grey."""
    return clip(fixed_point(weights, r, g, b) + 128, 0, 255)


def rgb_of(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """8-bit RGB of a sample and its chroma."""
    u, v = cb - 128, cr - 128
    red = y + F.shiftright(v * RED_CR + INVERSE_BIAS, PRECISION)
    green = y - F.shiftright(u * GREEN_CB + v * GREEN_CR + INVERSE_BIAS, PRECISION)
    blue = y + F.shiftright(u * BLUE_CB + INVERSE_BIAS, PRECISION)
    return tuple(clip(c, 0, 255) for c in (red, green, blue))


def to_multiple_of_8(n: Column) -> Column:
    return F.floor((n + 7) / 8).cast("bigint") * 8


def fits_level(w: Column, h: Column) -> Column:
    """Whether a picture may be coded: sides of 1 or more, and the padded picture within the level."""
    cw, ch = to_multiple_of_8(w), to_multiple_of_8(h)
    return (w >= 1) & (h >= 1) & (cw <= MAX_SIDE) & (ch <= MAX_SIDE) & (cw * ch <= MAX_AREA)


def quality_to_qp(q: Column) -> Column:
    """100 gives 4, 1 gives 51, evenly between; qualities outside are clipped."""
    return 51 - F.floor((clip(q, 1, 100) - 1) * 47 / 99).cast("bigint")


def chroma_for_size(idc: Column, w: Column, h: Column) -> Column:
    """The least chroma format (1: 4:2:0, 2: 4:2:2, 3: 4:4:4) that can hold odd sides."""
    return F.when((idc == 1) & (w % 2 != 0), 3).when((idc == 1) & (h % 2 != 0), 2).when((idc == 2) & (w % 2 != 0), 3).otherwise(idc)


def tools_in_effect(c: dict[str, Column]) -> dict[str, Column]:
    """The coding tools that stay on, from what was asked: lossless, aq, mtt, cclm, dual_tree, deblock, idc, depth."""
    lossy = ~c["lossless"]
    dual = c["dual_tree"] & lossy & c["idc"].isin(1, 2)
    return {
        "aq_on": c["aq"] & lossy,
        "mtt_on": c["mtt"] & lossy,
        "cclm_on": c["cclm"] & lossy,
        "dual_on": dual,
        "deblock_on": c["deblock"] & (c["depth"] == 8) & ~c["aq"] & ~dual & lossy & ~c["mtt"],
    }


def picture_checks(c: dict[str, Column], depth: Column, quality: Column) -> dict[str, Column]:
    """Whether a picture's quality, buffer length, sample range and stride hold, from its w, h, channels, length, largest, stride.

    Nulls in any of them give false.
    """
    w, h, needed = c["w"].cast("bigint"), c["h"].cast("bigint"), (c["h"].cast("bigint") - 1) * c["stride"] + c["w"]
    found = {
        "quality_ok": quality.between(1, 100),
        "length_ok": c["length"] == w * h * c["channels"],
        "range_ok": c["largest"].between(0, F.pow(F.lit(2), depth) - 1),
        "stride_ok": (w == 0) | (h == 0) | ((c["stride"] >= w) & (c["length"] >= needed)),
    }
    return {n: F.coalesce(x, F.lit(False)) for n, x in found.items()}


def depth_offset(depth: Column) -> Column:
    """By how much quantizers of a greater bit depth begin below 0."""
    return 6 * (depth - 8)


def widened(v: Column, depth: Column) -> Column:
    """An 8-bit sample at a greater depth."""
    return (v * F.pow(F.lit(2.0), depth - 8)).cast("bigint")


def profile(depth: Column, idc: Column) -> Column:
    """The number of the profile that a depth and chroma format need."""
    wide = idc >= 2
    return F.when(depth == 12, F.when(wide, 34).otherwise(2)).otherwise(F.when(wide, 33).otherwise(1))


def decoder_error(w: Column, h: Column) -> Column:
    """Why a decoder refuses a picture of this size; null if it does not."""
    cw, ch = to_multiple_of_8(w), to_multiple_of_8(h)
    sides = (F.least(w, h) <= 0) | (F.greatest(cw, ch) > MAX_SIDE)
    what = F.when(sides, "image dimensions out of range").when(cw * ch > MAX_AREA, "image too large to decode")
    return F.concat(F.lit("decode error: "), what)


def message(kind: Column, a: Column, b: Column) -> Column:
    """The text of an error: of dimensions (a x b), quality (a), length (a expected, b found), range (sample a, depth b)."""
    text = {
        "dimensions": F.format_string("invalid image dimensions: %dx%d", a, b),
        "quality": F.format_string("quality %d out of range (expected 1..=100)", a),
        "length": F.format_string("pixel buffer size mismatch: expected %d bytes, found %d", a, b),
        "range": F.format_string("sample %d exceeds maximum %d for %d-bit depth", a, (F.pow(F.lit(2.0), b) - 1).cast("bigint"), b),
    }
    out = F.lit(None).cast("string")
    for name, t in text.items():
        out = F.when(kind == name, t).otherwise(out)
    return out
