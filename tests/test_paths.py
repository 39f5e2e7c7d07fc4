"""Path text: cases with known answers."""

import pytest
from pyspark.sql import functions as F

from typelens.functions import paths as P


def one(spark, path, fn):
    return spark.createDataFrame([(path,)], "p string").select(fn(P.parsed(F.col("p"))).alias("r")).first()["r"]


CASES = [  # fixed values: path, what is done, the path after
    ("M 0 0 L 20 0", lambda p: P.tail_shortened(p, 20, 1, "left"), "M 0 0 L 20 0"),
    ("M 0 0 L 10 0 L 20 0", lambda p: P.tail_shortened(p, 20, 0.5, "left"), "M 10 0 L 15 0 L 20 0"),
    ("M 0 0 L 10 0 L 20 0", lambda p: P.tail_shortened(p, 10, 0.5, "right"), "M 0 0 L 10 0 L 15 0"),
    ("M 0 7 L 10 9 L 20 7", lambda p: P.tail_shortened(p, 20, 0.5, "left"), "M 10 7 L 15 9 L 20 7"),
    ("M 0 0 C 2 0 4 0 8 0", lambda p: P.tail_shortened(p, 8, 0.5, "left"), "M 4 0 C 5 0 6 0 8 0"),
    ("M 0 0 L 20 0", lambda p: P.tail_lowered(p, 10, 20, 0, "right"), "M 0 0 L 20 0"),
    ("M 0 0 L 10 0 L 15 0 L 20 0", lambda p: P.tail_lowered(p, 10, 20, 4, "right"), "M 0 0 L 10 0 L 15 2 L 20 4"),
    ("M 0 0 L 5 0 L 10 0", lambda p: P.tail_lowered(p, 10, 0, 4, "left"), "M 0 4 L 5 2 L 10 0"),
    ("M 0 7 L 15 7 L 20 7", lambda p: P.tail_lowered(p, 10, 20, 4, "right"), "M 0 7 L 15 9 L 20 11"),
    ("M 10 0 C 12 0 16 0 20 0", lambda p: P.tail_lowered(p, 10, 20, 4, "right"), "M 10 0 C 12 0.8 16 2.4 20 4"),
    ("M 0 0 L 30 5", lambda p: P.tail_lowered(p, 10, 10, 4, "right"), "M 0 0 L 30 5"),  # no tail to speak of
    ("M1.5,2L-3.25e1,.5Z", lambda p: P.translated(p, 0.25), "M 1.75 2 L -32.25 0.5 Z"),
    ("M 1 2 Q 3 4 5 6 Z M 1 1 L 2 2", lambda p: P.scaled(p, 2, -1), "M 1 2 Q 5 4 9 6 Z M 1 1 L 3 2"),
    ("", lambda p: P.translated(p, 1), ""), (None, lambda p: P.translated(p, 1), ""),
    ("M 0.0005 -0.0004", lambda p: p, "M 0.001 0"),
]


@pytest.mark.parametrize("path, fn, want", CASES)
def test_moved(spark, path, fn, want):
    assert (one(spark, path, lambda p: P.text(fn(p))) or "") == want


@pytest.mark.parametrize("path, want", [
    ("M 0 0 L 10 0 L 10 10 Z", 1), ("M 0 0 L 10 10 L 10 0 Z", -1), ("M 0 0 L 10 0 L 10 10 Z M 0 0 L 1 1 L 1 0 Z", 1), ("M 0 0 L 1 1", 0), ("", 0),
    ("M 0 0 L 10 10 L 10 0 Z M 0 0 L 100 0 L 100 100 Z", -1),
])
def test_turn(spark, path, want):
    assert one(spark, path, P.turn) == want


def test_box(spark):
    assert tuple(one(spark, "M 1 2 C -5 9 3 3 4 -7 Z", P.box)) == (-5, -7, 4, 9)
    assert tuple(one(spark, "Z", P.box)) == (None,) * 4
