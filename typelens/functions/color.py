"""Colour: sRGB to Lab (D65) and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of the sRGB to XYZ matrix, and the D65 white point (fixed values).
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def linear(c: Column) -> Column:
    s = c / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    return from_tones(tones([linear(c) for c in (r, g, b)]))


def tones(lin: list[Column]) -> list[Column]:
    """X, Y and Z of linear channels, as shares of the white point."""
    return [sum((k * c for k, c in zip(row, lin)), F.lit(0.0)) / w for row, w in zip(XYZ, WHITE)]


def from_tones(t: list[Column]) -> list[Column]:
    f = [F.when(x > 216 / 24389, F.pow(x, F.lit(1 / 3))).otherwise((24389 / 27 * x + 16) / 116) for x in t]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def distance2(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def to_segment2(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Squared distance from p to the segment a-b."""
    along = sum(((y - x) * (q - x) for q, x, y in zip(p, a, b)), F.lit(0.0))
    length = sum(((y - x) * (y - x) for x, y in zip(a, b)), F.lit(0.0))
    t = F.when(length > 0, F.least(F.greatest(along / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return distance2(p, [x + t * (y - x) for x, y in zip(a, b)])


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
