"""Trims taken back by pairs, one after the other, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from typelens.operators import trim as T

LETTERS = "array<struct<ch:string,first:bigint,last:bigint,x0:bigint,x1:bigint,cell:bigint>>"
PAIRS = "array<struct<k:int,l:string,r:string,d:bigint>>"


def loop(letters, pairs, pad, pen):
    state = {g[0]: list(g) for g in letters}
    for _, l, r, d in pairs:
        a, b = state[l], state[r]
        whole = lambda g: g[3] is None
        adv = max(1, a[5]) if whole(a) else a[4] - a[3] + 1 + 2 * pad
        gap = adv + (0 if whole(b) else pad - b[3]) - (0 if whole(a) else pad - a[3]) + d
        if gap >= -pen:
            continue
        deficit = -gap - pen
        if not whole(a):
            back = min(deficit, max(0, a[2] - a[4]))
            a[4] += back
            deficit -= back
        if deficit > 0 and not whole(b):
            b[3] -= min(deficit, max(0, b[3] - b[1]))
    return sorted(tuple(g) for g in state.values())


@pytest.mark.parametrize("seed", range(12))
def test_fold(spark, seed):
    rng = random.Random(seed)
    letters = []
    for ch in "abcdef":
        first, last = rng.randint(0, 4), rng.randint(12, 20)
        body = (None, None) if rng.random() < 0.3 else (first + rng.randint(0, 4), last - rng.randint(0, 4))
        letters.append((ch, first, last, *body, 22))
    pairs = [(k, rng.choice("abcdef"), rng.choice("abcdef"), rng.randint(-30, -8)) for k in range(9)]
    df = spark.createDataFrame([(letters, pairs)], f"g {LETTERS}, p {PAIRS}")
    got = df.select(T.fold(F.col("g"), F.col("p"), 2, F.lit(1)).alias("r")).first()["r"]
    assert sorted(tuple(g) for g in got) == loop(letters, pairs, 2, 1)


def test_scripts(spark):
    rows = [(1, k, 0, 99, 10 if k < 4 else 0, 99) for k in range(10)] + [(2, k, 0, 99, 10 if k < 3 else 2, 99) for k in range(10)]
    got = {r.face: r.script for r in T.scripts(spark.createDataFrame(rows, "face int, sheet_id int, first int, last int, x0 int, x1 int")).collect()}
    assert got == {1: True, 2: False}


def test_tails(spark):
    rows = [(1, k, 0, e, 10.0) for k, e in enumerate((7, 7, 8, 14))] + [(2, 10 + k, 0, e, 10.0) for k, e in enumerate((2, 2, 3, 14))] + [(3, 20 + k, 0, 14, 10.0) for k in range(3)]
    df = spark.createDataFrame(rows, "face int, sheet_id int, first int, x0 int, xh double")
    got = {r.sheet_id: r.scale for r in T.tails(df).collect()}
    assert got.pop(3) == pytest.approx(1.1 / 1.4) and set(got.values()) == {None}  # short-entry hands and small faces stay


def snapped(spark, rows):
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "face int, sheet_id int, ch string, first int, last int, x0 int, x1 int, base int, ly int, ry int, xh double")
    return {r.sheet_id: (r.exit_dy, r.entry_dy) for r in T.snaps(df).collect()}


def test_snaps(spark):
    # entries 20 over the base line of 100, exits 60: the plain letters' exits come down to the join line, by half an x-height at most
    flick = [(c, 0, 50, 10, 40, 100, 80, 40, 100.0) for c in "aenm"]
    assert snapped(spark, flick) == {k: (40.0, 0.0) for k in range(4)}
    assert snapped(spark, [(c, 0, 50, 10, 40, 100, 80, 10, 100.0) for c in "aenm"])[0] == (50.0, 0.0)
    got = snapped(spark, [*flick, ("o", 0, 50, 10, 40, 100, 80, 40, 100.0), ("g", 0, 50, 10, 40, 100, 80, 40, 100.0)])
    assert got[4] == (0.0, 0.0) and got[5] == (0.0, 0.0)  # high exits and descenders keep theirs
    assert snapped(spark, [(c, 0, 50, 10, 40, 100, 80, 75, 100.0) for c in "aenm"]) == {}  # they meet already
    assert snapped(spark, flick[:3]) == {}
    # entries that scatter: ends are raised too, and high exits move
    wild = [("a", 0, 50, 10, 40, 100, 95, 80, 100.0), ("e", 0, 50, 10, 40, 100, 50, 80, 100.0), ("n", 0, 50, 10, 40, 100, 80, 80, 100.0), ("o", 0, 50, 10, 40, 100, 80, 50, 100.0)]
    assert snapped(spark, wild) == {0: (0.0, -15.0), 1: (0.0, 30.0), 2: (0.0, 0.0), 3: (30.0, 0.0)}
    assert snapped(spark, [(c, 0, 40, 0, 40, 100, 80, 40, 100.0) for c in "aenm"]) == {k: (0.0, 0.0) for k in range(4)}  # no tails
