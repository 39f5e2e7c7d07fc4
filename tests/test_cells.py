"""Rows cut into cells: rasters drawn by hand, and ink that crosses a row's edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typelens.operators import slicing as C
from typelens.sources.shipping import ship


def canvas(w, h, *rects):
    """x0, x1, y0, y1 of each rectangle of ink."""
    m = np.zeros((h, w), bool)
    for x0, x1, y0, y1 in rects:
        m[y0:y1, x0:x1] = True
    return m


def rows(spark, mask, y0, y1, chars):
    ship(spark)
    sheets = spark.createDataFrame([(1, mask.shape[1], mask.reshape(-1).tolist())], "sheet_id long, width long, ink array<boolean>")
    bands = spark.createDataFrame([(1, 0, y0, y1, chars)], "sheet_id long, row long, y0 long, y1 long, chars string")
    return C.rows_of(sheets, bands)


def cells(df):
    return [(r.x0, r.x1) for r in df.orderBy("cell").collect()]


N = lambda: C.count_of(F.col("chars"))


def test_foreign_runs(spark):
    """A tail from above, a tip from below, a detached mark, a tall character, a detached low mark."""
    m = canvas(80, 140, (5, 10, 0, 18), (20, 25, 102, 130), (35, 40, 10, 18), (50, 55, 10, 115), (65, 70, 90, 110))
    got = C.runs(rows(spark, m, 10, 110, "abc")).orderBy("x0").collect()
    assert [(r.x0, r.x1, r.alien) for r in got] == [(5, 10, True), (20, 25, True), (35, 40, False), (50, 55, False), (65, 70, False)]


def recovered(mask, x0, x1, y0, y1, owner=None, cell=0):
    free = np.ones(mask.shape, bool) if owner is None else np.vectorize(lambda x: owner(x) in (-1, cell))(np.arange(mask.shape[1]))[None, :].repeat(len(mask), 0)
    top, bottom, joined = C.recovered(mask[:, x0:x1], free[:, x0:x1], y0, y1)
    return top, bottom, joined


def test_extents():
    """A hooked descender, an ascender beside another cell's, a fragment of the row above, a diagonal step, the sheet's edges."""
    m = canvas(60, 180, (30, 34, 35, 125), (12, 34, 121, 125), (12, 16, 105, 125), (45, 55, 112, 165))
    top, bottom, joined = recovered(m, 5, 58, 20, 110)
    assert bottom == 125 and joined[123, 14 - 5] and not joined[120, 50 - 5]
    m = canvas(60, 180, (10, 15, 12, 90), (30, 35, 10, 130))
    top, bottom, joined = recovered(m, 5, 50, 20, 110, lambda x: 0 if x < 20 else 1)
    assert (top, bottom) == (12, 110) and joined[14, 12 - 5] and not joined[45, 32 - 5]
    assert recovered(canvas(60, 180, (10, 15, 50, 90), (30, 35, 0, 29)), 5, 50, 20, 110) == (20, 110, None)
    m = canvas(60, 180, (20, 21, 40, 110), (21, 22, 110, 120))
    assert recovered(m, 0, 60, 20, 110)[1] == 120 and recovered(m, 0, 60, 0, 180)[:2] == (0, 180)
    far = canvas(60, 180, (20, 22, 60, 170))
    assert recovered(far, 0, 60, 50, 100)[1] == 120  # no further than 0.4 of the height


def test_padding():
    """Ink of the row before is not the cell's, the fringe of its own ink is."""
    m = canvas(30, 30, (15, 16, 10, 11), (3, 4, 8, 9), (15, 16, 9, 10), (14, 15, 8, 9))
    free = np.ones(m.shape, bool)
    top, bottom, ink = C.own_ink(m, free, 10, 20, 0, 30)
    assert (top, bottom) == (10, 20) and ink[9, 15] and not ink[8, 3] and not ink[8, 14]
    free[:, 15] = False
    assert not C.own_ink(m, free, 10, 20, 0, 30)[2][9, 15]


@pytest.mark.parametrize("middles, cells, want", [
    ([[], [5, 7, 40, 42]], 2, [[5, 7], [40, 42]]),  # the first group of the next cell
    ([[5, 7, 40, 42], []], 2, [[5, 7], [40, 42]]),  # the last group of the one before
    ([[], [40, 42]], 2, [[], [40, 42]]),  # a group stays whole
    ([[5, 30], [], [60, 90]], 3, [[5, 30], [60], [90]]),  # the right neighbour is asked first
    ([[], [], [10, 40, 70]], 3, [[], [10], [40, 70]]),  # a cell of one group gives nothing
    ([[], []], 2, [[], []]),
])
def test_empty_cells(middles, cells, want):
    held = [[{"centroid": m} for m in c] for c in middles]
    C.settle_empty(held, [10.0] * cells)
    assert [[p["centroid"] for p in c] for c in held] == want


def test_components(spark):
    # a dotted letter, a broken one, and two that overlap without touching
    m = canvas(100, 40, (5, 9, 10, 35), (5, 9, 2, 6), (30, 34, 5, 20), (31, 35, 22, 35), (60, 64, 5, 30), (64, 80, 30, 36), (70, 74, 5, 28))
    r = rows(spark, m, 0, 40, "iktl")
    got = C.boxes(C.component_cells(C.components(r), r, N()))
    assert cells(got) == [(5, 9), (30, 35), (60, 64), (64, 80)]
    few = rows(spark, m, 0, 40, "abcdefghij")  # each component is a cell, by its left edge
    assert cells(C.boxes(C.component_cells(C.components(few), few, N()))) == [(5, 9), (5, 9), (30, 34), (31, 35), (60, 64), (64, 80), (70, 74)]
    blank = rows(spark, canvas(20, 10), 0, 10, "ab")
    assert C.components(blank).count() == 0 and C.component_cells(C.components(blank), blank, N()).count() == 0
    assert [(x["x0"], x["x1"]) for x in C.anchored(C.profile(blank), N()).first()["ranges"]] == [(0, 7), (7, 20)]  # of equal columns the first


def test_ways(spark):
    """Each way is chosen where it finds what the text has."""

    def way(mask, chars, y0=10, y1=50):
        r = rows(spark, mask, y0, y1, chars)
        x = C.chosen(r, C.candidates(r)[0]).first()
        return x["way"], x["forced"], x["natural"]

    three = canvas(90, 60, (5, 15, 15, 45), (35, 45, 15, 45), (65, 75, 15, 45))
    assert way(three, "abc") == ("whitespace", False, 3)
    assert way(three, "#!?") == ("components", False, 3)
    tail = three.copy()
    tail[0:14, 25:28] = True
    assert way(tail, "abc") == ("clean", False, 3)
    assert way(canvas(90, 60, (5, 85, 15, 45)), "abc") == ("anchored", True, 1)
    caron = three.copy()
    caron[15:22, 17:19] = True
    assert way(caron, "ďbc") == ("gaps", False, 3)
    lapped = canvas(90, 60, (5, 30, 15, 20), (27, 32, 25, 45), (60, 70, 15, 45))
    assert way(lapped, "abc") == ("components", False, 3)


def test_accents(spark):
    rows = spark.createDataFrame([("é",), ("é",), ("ø",), ("ß",), ("İ",), ("Å",), ("a",), ("й",)], "c string")
    assert [r[0] for r in rows.select(C.has_accent(F.col("c"))).collect()] == [True, True, False, False, True, True, False, False]


def test_seam_by_loops():
    """The least cost of all paths, by the definition; and the path costs it."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        band = rng.random((rng.integers(1, 9), rng.integers(1, 12))) < 0.5
        lo = int(rng.integers(-2, band.shape[1]))
        hi = lo + int(rng.integers(0, 6))
        got = C.seam(band, lo, hi)
        a, b = max(0, lo), min(band.shape[1] - 1, hi)
        if b < a:
            assert got is None
            continue
        cost, par = [[float(v) for v in band[0, a : b + 1]]], []
        for line in band[1:, a : b + 1]:
            now, ways = [], []
            for x in range(b - a + 1):
                best, at = 1e9, x
                for p in (x - 1, x, x + 1):
                    if 0 <= p <= b - a and cost[-1][p] < best:
                        best, at = cost[-1][p], p
                now.append(float(line[x]) + best + abs(x - at) * 0.001)
                ways.append(at)
            cost.append(now)
            par.append(ways)
        x = cost[-1].index(min(cost[-1]))
        path = [x]
        for ways in reversed(par):
            x = ways[x]
            path.append(x)
        assert got.tolist() == [v + a for v in path[::-1]]


def ends(band, n):
    return [(int(a.min()), int(b.max())) for a, b in C.seam_cells(band, n)]


def test_seam_cells():
    three = canvas(60, 20, (5, 15, 0, 20), (20, 30, 0, 20), (40, 50, 0, 20))
    assert ends(three, 3) == [(5, 15), (20, 30), (40, 50)]
    assert ends(canvas(60, 20), 3) == [] and ends(three, 0) == []
    joined = canvas(60, 20, (0, 10, 0, 20), (10, 14, 9, 11), (14, 24, 0, 20), (40, 50, 0, 20))  # two letters and the stroke between them, one letter
    a, b, c = C.seam_cells(joined, 3)
    assert (a[0] == 0).all() and (a[1] == b[0]).all() and ((a[1] >= 10) & (a[1] <= 14)).all() and (c[0] == 40).all() and (c[1] == 50).all()
    more = ends(three, 2)  # more blobs than letters: an even pitch
    assert more[0][0] == 5 and more[1][1] == 50 and len(more) == 2
    assert C.shares([30, 10], 4, 10.0) == [3, 1] and C.shares([50, 10], 4, 10.0) == [3, 1] and C.shares([12, 12], 3, 20.0) == [2, 1] and C.shares([1, 1, 1], 2, 9.0) == [1, 1, 1]


def test_wide_gaps(spark):
    found = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 13, 20), (1, 0, 30, 40), (1, 1, 0, 10), (1, 1, 11, 20), (2, 0, 0, 9)], "sheet_id long, row long, x0 long, x1 long")
    n = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (2, 0, 2)], "sheet_id long, row long, n long")
    got = sorted((r.sheet_id, r.row, r.cell, r.x0, r.x1) for r in C.parted_cells(found, n).collect())
    assert got == [(1, 0, 0, 0, 25), (1, 0, 1, 25, 40)]  # a gap of one column is none; one run has none
