"""Colour spaces, packing and text of colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Oklab's matrices (single precision, as published for linear sRGB).
LMS = ((0.41222146, 0.53633255, 0.051445995), (0.2119035, 0.6806995, 0.10739696), (0.08830246, 0.28171885, 0.6299787))
LAB = ((0.21045426, 0.7936178, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577))
LMS_BACK = ((4.0767417, -3.3077116, 0.23096994), (-1.268438, 2.6097574, -0.34131938), (-0.0041960863, -0.7034186, 1.7076147))
LAB_BACK = ((1.0, 0.39633778, 0.21580376), (1.0, -0.105561346, -0.06385417), (1.0, -0.08948418, -1.2914855))
#: Chroma is stretched by this much to fill the range of lightness.
CHROMA = 5.0


def linear(u8: Column) -> Column:
    """An sRGB byte as linear light in 0..1."""
    s = u8.cast("double") / 255
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def companded(lin: Column) -> Column:
    """Linear light in 0..1 as sRGB in 0..1."""
    c = F.least(F.greatest(lin.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def srgb_u8(lin: Column) -> Column:
    """Linear light as an sRGB byte; NaN is 0."""
    return F.when(F.isnan(lin.cast("double")), 0).otherwise(F.floor(companded(lin) * 255 + 0.5).cast("int"))


def _times(m: tuple, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in m)


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear light as Oklab with stretched chroma."""
    lms = tuple(F.cbrt(x) for x in _times(LMS, (r, g, b)))
    light, a, bb = _times(LAB, lms)
    return light, a * CHROMA, bb * CHROMA


def from_oklab(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Oklab with stretched chroma as linear light."""
    roots = _times(LAB_BACK, (light, a / CHROMA, b / CHROMA))
    return _times(LMS_BACK, tuple(x * x * x for x in roots))


def power(x: Column, p: float) -> Column:
    """sign(x) |x|^p: companding, and with 1/p expanding."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def rgb565(r: Column, g: Column, b: Column) -> Column:
    r, g, b = (x.cast("int") for x in (r, g, b))
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def from_rgb565(p: Column) -> tuple[Column, Column, Column]:
    """Bytes with the high bits repeated below."""
    r, g, b = F.shiftright(p, 11).bitwiseAND(31), F.shiftright(p, 5).bitwiseAND(63), p.bitwiseAND(31)
    return F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb, or #rgb where both digits of each byte are equal."""
    digits = [F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")) for x in (r, g, b)]
    short = [F.substring(d, 1, 1) for d in digits]
    twice = [F.substring(d, 1, 1) == F.substring(d, 2, 1) for d in digits]
    return F.when(twice[0] & twice[1] & twice[2], F.concat(F.lit("#"), *short)).otherwise(F.concat(F.lit("#"), *digits))


def number_text(x: Column) -> Column:
    """At most two decimals, no trailing zeros, no zero before the point."""
    rounded = F.round(x.cast("double") * 100) / 100
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", rounded), "0+$", ""), "\\.$", "")
    return F.when((rounded > 0) & (rounded < 1), F.regexp_replace(plain, "^0", "")).otherwise(plain)


def hsl(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    """Bytes of a colour by hue in degrees, saturation and lightness in 0..1."""
    a = s * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(h / 30 + n, F.lit(12.0))
        return F.round((light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255).cast("int")

    return channel(0), channel(8), channel(4)


# The 8 x 8 ordered-dither matrix.
BAYER = (
    (0, 32, 8, 40, 2, 34, 10, 42),
    (48, 16, 56, 24, 50, 18, 58, 26),
    (12, 44, 4, 36, 14, 46, 6, 38),
    (60, 28, 52, 20, 62, 30, 54, 22),
    (3, 35, 11, 43, 1, 33, 9, 41),
    (51, 19, 59, 27, 49, 17, 57, 25),
    (15, 47, 7, 39, 13, 45, 5, 37),
    (63, 31, 55, 23, 61, 29, 53, 21),
)


def dither_threshold(x: Column, y: Column) -> Column:
    cells = F.array(*(F.lit(v) for row in BAYER for v in row))
    return (F.element_at(cells, (F.pmod(y, F.lit(8)) * 8 + F.pmod(x, F.lit(8)) + 1).cast("int")) + 0.5) / 64


def quantised(v: Column, threshold: Column | float = 0.5) -> Column:
    """0..255 to a byte, by rounding or by a dither threshold."""
    return F.least(F.greatest(F.floor(v + threshold), F.lit(0)), F.lit(255)).cast("int")
