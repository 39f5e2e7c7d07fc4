"""Colours of drawn sheets: inks found, blends and halos left out, shadows told from dark ink."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from typelens.operators import palette as P
from typelens.sources.shipping import ship

WHITE, RED, BLUE, DARK, GREEN = (255, 255, 255), (220, 40, 40), (40, 70, 200), (45, 45, 50), (30, 160, 60)


def sheet(w=60, h=60, *rects, paper=WHITE):
    img = np.full((h, w, 3), paper, int)
    for x0, x1, y0, y1, c in rects:
        img[y0:y1, x0:x1] = c
    return img


def pixels(spark, *sheets):
    ship(spark)
    rows = [(k, img.shape[1], img.shape[0], x, y, *map(int, img[y, x])) for k, img in enumerate(sheets) for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "sheet_id long, width long, height long, x long, y long, r long, g long, b long")


def test_background(spark):
    tinted = sheet(40, 30, (5, 35, 5, 25, RED), paper=(240, 230, 210))
    half = sheet(10, 10, paper=(0, 0, 0))
    half[:, 5:] = 255
    got = {r.sheet_id: (r.br, r.bg, r.bb) for r in P.background(pixels(spark, tinted, half)).collect()}
    assert got[0] == (240, 230, 210) and got[1] in {(0, 0, 0), (255, 255, 255)}
    assert got[1] == (0, 0, 0)  # as many of both: the upper left one was met first


def test_palettes(spark):
    three = sheet(60, 60, (4, 30, 4, 50, RED), (32, 44, 4, 40, BLUE), (46, 54, 4, 30, GREEN))
    soft = three.copy()  # edges half paper, half ink
    for x0, x1, y0, y1, c in ((4, 30, 4, 50, RED), (32, 44, 4, 40, BLUE), (46, 54, 4, 30, GREEN)):
        soft[y0:y1, x0] = soft[y0:y1, x1 - 1] = [(v + 255) // 2 for v in c]
    grey = sheet(60, 60, (10, 50, 10, 50, (238, 238, 238)))  # a halo, no ink
    one = sheet(60, 60, (10, 50, 10, 50, RED), (20, 30, 20, 30, (222, 42, 40)))  # two nearly equal colours
    got = {}
    for r in P.palettes(pixels(spark, three, soft, grey, one), 3).orderBy("sheet_id", "place").collect():
        got.setdefault(r.sheet_id, []).append((r.r, r.g, r.b, r.n))
    assert [c[:3] for c in got[0]] == [RED, BLUE, GREEN] and [c[3] for c in got[0]] == [26 * 46, 12 * 36, 8 * 26]
    assert len(got[1]) == 3 and all(np.abs(np.array(c[:3]) - w).max() < 30 for c, w in zip(got[1], (RED, BLUE, GREEN)))
    assert sum(c[3] for c in got[1]) == sum(c[3] for c in got[0])  # every pixel is counted, blends too
    assert 2 not in got and len(got[3]) == 1 and got[3][0][3] == 1600


def test_large_sheet_counts_all_pixels(spark):
    img = sheet(120, 101, (10, 60, 10, 91, RED), (70, 110, 10, 91, BLUE))  # the sample takes every second pixel
    got = P.palettes(pixels(spark, img), 2).orderBy("place").collect()
    assert [(r.r, r.g, r.b, r.n) for r in got] == [(*RED, 50 * 81), (*BLUE, 40 * 81)]


def test_means():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1, (40, 3)) for c in ((0, 0, 0), (50, 0, 0), (0, 50, 0))])
    got = P.means(points, 3)
    want = np.array([points[:40].mean(0), points[40:80].mean(0), points[80:].mean(0)])
    assert all(np.abs(want - g).sum(1).min() < 1e-9 for g in got)
    assert len(P.means(points[:2], 5)) == 2 and len(P.means(points, 1)) == 1
    assert (P.means(np.zeros((5, 3)), 3) == 0).all()


def letters(shift=(4, 4), n=5, dark=DARK, own=False):
    img = sheet(200, 60)
    for k in range(n):
        x = 10 + 38 * k
        if own:  # dark letters of their own between bright ones
            img[10:45, x : x + 20] = dark if k % 2 else RED
            continue
        for (a, b), c in ((shift, dark), ((0, 0), RED)):  # two bars and a bar across, over the same shape set off
            for x0, x1, y0, y1 in ((0, 5, 10, 45), (12, 17, 10, 45), (0, 17, 25, 30)):
                img[y0 + b : y1 + b, x + x0 + a : x + x1 + a] = c
    return img


@pytest.mark.parametrize("img, want", [
    (letters(), True), (letters((-4, 4)), True), (letters((5, 1)), True),
    (letters(own=True), False), (letters(n=2), False),  # too few
    (letters(dark=BLUE), False),  # not grey
    (letters((15, 0)), False),  # no shadow lies so far
    (sheet(200, 60, (10, 60, 10, 45, RED)), None),  # one ink
])
def test_shadows(spark, img, want):
    px = pixels(spark, img)
    got = P.shadows(px, P.palettes(px, 2)).collect()
    assert (got[0].shadow if got else None) in ({want} if want else {want, None})


def test_layers(spark):
    a = sheet(20, 20, (4, 12, 2, 10, RED), (4, 12, 10, 18, BLUE), (15, 18, 2, 8, RED), (1, 2, 1, 3, BLUE))
    px = pixels(spark, a, a, a).withColumns({"face": F.lit(0).cast("long"), "ch": F.element_at(F.array(F.lit("o"), F.lit("i"), F.lit("!")), (F.col("sheet_id") + 1).cast("int")), **{c: F.lit(255) for c in ("br", "bg", "bb")}})
    paper = spark.createDataFrame([(0, *RED, 0), (0, *BLUE, 1)], "face long, r long, g long, b long, k long")
    inks = P.with_lab(paper, ("r", "g", "b"), ("l", "a", "v")).groupBy("face").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l", "a", "v"))), lambda c: F.struct(c["l"].alias("l"), c["a"].alias("a"), c["v"].alias("v"))).alias("centres"))
    got = {(r.sheet_id, r.place): (r.n, r.stray) for r in P.layers(px, inks).groupBy("sheet_id", "place").agg(F.count(F.lit(1)).alias("n"), F.max("stray").alias("stray")).collect()}
    assert got == {(0, 0): (64, True), (0, 1): (64, True), (1, 0): (82, False), (1, 1): (64, False), (2, 0): (82, False), (2, 1): (64, False)}
    wide = P.spread(spark.createDataFrame([(0, 0, 0), (0, 5, 5)], "k long, x long, y long"), ["k"], 6, 6)
    assert sorted((r.x, r.y) for r in wide.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (4, 4), (4, 5), (5, 4), (5, 5)]
