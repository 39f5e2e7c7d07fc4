"""Rules of bands, rows and tiles on cases made by hand, with what lies at their edges."""

import pytest
from pyspark.sql import functions as F

from typelens.plans import sheets as P

BANDS = "array<struct<start:bigint,stop:bigint>>"


def one(spark, column, **values):
    types = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], types).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("std, strict, expected, want", [
    ([10] * 5, [10] * 5, 0, False),  # no more bands
    ([10] * 3, [10] * 4, 3, True),  # the standard ones are as expected
    ([10] * 4, [5] * 8, 0, False),  # too few to tell
    ([10] * 5 + [20], [10] * 9, 0, False),  # one of them is two rows
    ([10] * 6, [5] * 9, 0, True), ([10] * 6, [9] * 8, 0, False),
    ([10] * 8, [7] * 10, 0, True), ([10] * 8, [8] * 10, 0, False), ([], [], 0, False),
])
def test_fragments(spark, std, strict, expected, want):
    r = P.fragmented(F.array_sort("a"), F.array_sort("b"), F.col("e"))
    assert one(spark, r, a=("array<bigint>", std), b=("array<bigint>", strict), e=("int", expected)) is want


@pytest.mark.parametrize("bands, want", [
    ([(0, 10), (20, 30), (40, 50), (52, 56), (60, 70), (80, 90)], [(0, 10), (20, 30), (40, 56), (60, 70), (80, 90)]),
    ([(0, 4), (5, 9)], [(0, 4), (5, 9)]), ([(3, 5)], [(3, 5)]), ([], []), (None, None),
])
def test_pitch(spark, bands, want):
    got = one(spark, P.pitched(F.col("b")), b=(BANDS, bands))
    assert got == want if want is None else [tuple(b) for b in got] == want


@pytest.mark.parametrize("widths, want", [
    ([0, 5, 2] + [20] * 20, 2),  # a strip, a valley, the body
    ([0, 5, 5] + [20] * 20, 0),  # no valley
    ([9, 2] + [10] * 20, 0),  # no body to speak of
    ([5, 4, 4, 4, 4, 3] + [20] * 6, 0),  # a strip as long as a part of the glyph
    ([0, 0, 0], 0), ([], 0),
])
def test_bleed(spark, widths, want):
    assert one(spark, P.bleed(F.col("w")), w=("array<bigint>", widths)) == want


def test_tiles(spark):
    """Levels by hand: the value that 85 of 100 pixels do not exceed; tiles without an opaque pixel, or without any, are white."""
    rows = [(1, x, y, True, 10 if y * 10 + x < 84 else 90) for x in range(10) for y in range(10)] + [(1, x, 0, False, 7) for x in range(10, 20)]
    t, cols, n = P.tile_levels(spark.createDataFrame(rows, "page long, x long, y long, opaque boolean, luma int"), 20, 20, least=10)
    assert (cols, n) == (2, 2)
    assert {(r.tx, r.ty): r.v for r in t.collect()} == {(0, 0): 90, (1, 0): 255, (0, 1): 255, (1, 1): 255}


def test_even_bands(spark):
    p = spark.createDataFrame([(1, 0, 3, True, 0), (1, 0, 12, True, 0), (1, 0, 40, False, 0), (2, 0, 0, True, 255)], "page long, x long, y long, opaque boolean, luma int")
    assert sorted(tuple(r) for r in P.banded(p, 4).collect()) == [(1, 0, 3, 6), (1, 1, 6, 8), (1, 2, 8, 11), (1, 3, 11, 13)]
