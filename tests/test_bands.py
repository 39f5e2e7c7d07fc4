"""Repair and search of row bands: cases with known answers, and what lies at the edges of the rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typelens.operators import bands as B

TYPE = "array<struct<start:bigint,stop:bigint>>"


def parse(s):
    return [tuple(map(int, r.split("-"))) for r in s.split()]


def apply(spark, column, bands, **more):
    types = "".join(f", {n} {t}" for n, (t, _) in more.items())
    got = spark.createDataFrame([(bands, *[v for _, v in more.values()])], f"b {TYPE}{types}").select(column.alias("r")).first()["r"]
    return None if got is None else [tuple(x) for x in got]


@pytest.mark.parametrize("bands, want", [
    # fixed values: two reads of one scan with a light pen, and a sheet whose first rows are one band
    ("5-12 13-198 235-236 237-250 251-252 253-455 456-457 458-459 533-554 557-558 561-562 564-723 724-726 843-981 1084-1240 1241-1249 1300-1301 1303-1307 1308-1324 1327-1329 1330-1495",
     "5-198 235-459 533-726 843-981 1084-1249 1300-1495"),
    ("4-199 235-470 532-732 843-983 1084-1250 1300-1301 1302-1495", "4-199 235-470 532-732 843-983 1084-1250 1300-1495"),
    ("64-772 796-924 945-1085", "64-772 796-924 945-1085"), ("65-226 227-771 796-924 946-1085", "65-226 227-771 796-924 946-1085"),
    ("0-100 102-200 202-300", "0-100 102-200 202-300"), ("0-100 140-160 200-300", "0-100 140-160 200-300"), ("", ""), ("0-5", "0-5"),
    ("0-2 4-6 8-100", "0-100"),  # a chain of slivers
    ("0-100 103-106 109-209", "0-106 109-209"),  # as near to both: the upper one
])
def test_slivers(spark, bands, want):
    assert apply(spark, B.folded(F.col("b")), parse(bands)) == parse(want)


def fold(spark, bands, lines, runs=None):
    return apply(spark, B.reconciled(F.col("b"), F.col("r"), F.col("l")), bands, r=("array<bigint>", runs), l=("array<string>", lines))


def test_reconcile(spark):
    rows = [(0, 100), (150, 250), (300, 400)]
    assert fold(spark, rows, ["a", "b", "c"]) == rows and fold(spark, rows, ["a"]) == rows and fold(spark, rows, []) == rows
    assert fold(spark, [(0, 10), (14, 100), *rows[1:]], ["a", "b", "c"]) == [(0, 100), *rows[1:]]  # a tittle
    assert fold(spark, [(0, 45), (50, 100), *rows[1:]], ["a", "", "b", "c"]) == rows  # halves of a row
    more = [(0, 100), (130, 230), (260, 360), (390, 490)]
    assert fold(spark, more, ["a", "b", "c"]) == more  # a full row too many stays


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("dense, lines, gone", [
    (9, ["AB", "CD", "ef", "12"], True), (4, ["AB", "CD", "ef", "12"], False), (9, ["a", "b", "c", "d"], True),
])
def test_captions(spark, first, dense, lines, gone):
    rows = [(200 * k + 40, 200 * k + 140) for k in range(4)]
    notes = [(a - 30, a - 10) if first else (b + 10, b + 30) for a, b in rows]
    bands = sorted(rows + notes)
    runs = [dense if b in notes else 6 for b in bands]
    got = fold(spark, bands, lines, runs)
    assert (got == rows) is gone
    if not gone:  # folded into the rows instead
        assert len(got) == 4 and all(b - a == 130 for a, b in got)


def test_no_captions_without_runs(spark):
    rows = [(200 * k, 200 * k + 100) for k in range(4)]
    got = fold(spark, sorted(rows + [(b + 10, b + 30) for _, b in rows]), ["A", "B", "C", "D"])
    assert got == [(a, b + 30) for a, b in rows]


def test_valleys():
    shallow = np.array([35 if 50 <= y < 70 else 100 for y in range(120)])
    assert B.parted(shallow, [(0, 119)]) == [(0, 119)]
    deep = np.array([5 if 58 <= y < 62 else 100 for y in range(120)])
    assert len(B.parted(deep, [(0, 119)])) == 2
    assert B.parted(deep[:79], [(0, 78)]) == [(0, 78)]  # no room for two rows
    four = np.tile(np.array([100] * 60 + [2] * 6), 4)[:-6]
    assert len(B.parted(four, [(0, len(four) - 1)])) == 4
    assert len(B.parted(four, [(0, len(four) - 1)], most=3)) in (1, 3)
    uneven = np.array([100] * 45 + [2] * 6 + [100] * 150)
    assert B.parted(uneven, [(0, 200)]) == [(0, 200)]  # too different heights
    ten = np.tile(np.array([100] * 45 + [2] * 6 + [100] * 45 + [0] * 4), 5)
    rows = [(100 * k, 100 * k + 95) for k in range(5)]
    assert B.parted(ten, rows) == rows  # five even rows stay five
    assert len(B.parted(ten, rows[:4])) == 8


def test_valley_against_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(300):
        v = rng.integers(0, 12, rng.integers(1, 40))
        s = [np.mean(v[max(0, i - 2) : i + 3]) for i in range(len(v))]
        best, low = -1, float("inf")
        for i in range(5, len(v) - 5 + 1):
            if len(v) >= 10 and max(s) > 0 and s[i] < low and s[i] <= 0.25 * min(max(s[:i]), max(s[i + 1 :], default=0)):
                best, low = i, s[i]
        assert B.deepest_valley(v, 5) == best


def humps(*rows, floor=0):
    return np.concatenate([np.concatenate([np.full(20, floor), np.round(h * np.sin(np.linspace(0.1, 3.04, 60)))]) for h in rows])


def test_rows_by_valleys():
    assert B.rows_by_valleys(np.zeros(50)) == [] and B.rows_by_valleys(np.array([0, 3, 0])) == [(1, 2)]
    assert len(B.rows_by_valleys(humps(100, 90, 95, 12))) == 4  # a faint row stays
    assert len(B.rows_by_valleys(humps(100, 90, 95, floor=3))) == 3  # joined by what lies between
    assert B.peaks_of(np.array([0, 5, 5, 0, 6, 0, 0, 0, 1.0]), 1, 2) == [1, 4]  # the higher of neighbours; none under the floor
    assert B.peaks_of(np.array([0, 5.0, 0, 0, 0, 5.0]), 1, 1) == [1, 5]


def test_rows_by_count():
    v = humps(100, 90, 95)
    assert len(B.rows_by_count(v, 3)) == 3 and B.rows_by_count(v, 1) is None and B.rows_by_count(np.zeros(9), 2) is None
    assert B.rows_by_count(np.array([1, 1]), 3) is None
    for a, b in B.rows_by_count(humps(100, 90, 95, floor=8), 3):
        assert 40 < b - a < 100
