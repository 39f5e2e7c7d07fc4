"""Charsets by rows, and the pen's path, on cases made by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from typelens.plans import charsets as P


def guess(spark, cells):
    df = spark.createDataFrame([(cells,)], "c array<bigint>")
    return df.select(P.by_rows(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("cells, want", [
    ([], P.DEFAULT), ([26, 10], [P.UPPER, P.DIGITS]), ([13, 13, 10], [*P.HALF[:2], P.DIGITS]), ([26, 26, 10, 11], P.DEFAULT),
    ([13, 13, 13, 13, 10], [*P.HALF, P.DIGITS]), ([13, 12, 14, 13, 12, 17, 13], [*P.HALF, P.DIGITS, P.BANK[:17], P.BANK[17:30]]),
    ([26, 26, 20, 9], [*P.FULL, P.BANK[:20], P.BANK[20:29]]),  # no row of digits
    ([26, 26, 10, 30, 5, 2], [*P.FULL, P.DIGITS, P.BANK[:30], P.BANK[30:], P.BANK[:2]]),  # the bank runs out
    ([13, 13, 13, 13, 10, 0, 4], [*P.HALF, P.DIGITS, P.BANK[:1], P.BANK[1:5]]),
])
def test_by_rows(spark, cells, want):
    assert guess(spark, cells) == want


def test_by_count(spark):
    df = spark.createDataFrame([(1, 26), (4, 13), (4, 26), (4, 0), (6, 13), (6, 20), (9, 13), (0, 0)], "n int, c int")
    got = [r["r"] for r in df.select(P.by_count(F.col("n"), F.col("c")).alias("r")).collect()]
    assert got == [[P.UPPER], P.HALF, P.DEFAULT, P.DEFAULT, [*P.HALF, P.DIGITS, P.PUNCT], P.DEFAULT, P.DEFAULT, P.DEFAULT]


def test_pen_order():
    assert P.pen_order([], [], []) == []
    assert P.pen_order([(0, 0), (9, 0), (1, 0)], [(0, 0), (2, 0), (5, 0)], [True, False, False]) == [(0, False), (2, False), (1, True)]
    assert P.pen_order([(0, 0), (3, 0), (3, 0)], [(2, 0), (4, 0), (4, 0)], [False] * 3) == [(0, False), (1, False), (2, True)]  # ties
    rng = random.Random(1)
    for _ in range(50):
        s, e = [[(rng.randrange(9), rng.randrange(9)) for _ in range(5)] for _ in "se"]
        order = P.pen_order(s, e, [False] * 5)
        assert sorted(i for i, _ in order) == list(range(5))
        pen = s[0]
        for (i, back), k in zip(order, itertools.count()):
            dist = lambda q: (q[0] - pen[0]) ** 2 + (q[1] - pen[1]) ** 2
            assert dist(e[i] if back else s[i]) == min(dist(q) for j, _ in order[k:] for q in (s[j], e[j]))
            pen = s[i] if back else e[i]
