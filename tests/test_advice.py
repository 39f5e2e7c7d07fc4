"""Screens, advice and reports: cases with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from typelens.plans import advice as A

LINES = "array<struct<mean:double,sd:double>>"


def share(spark, lines):
    return spark.createDataFrame([(lines,)], f"l {LINES}").select(A.flat_share(F.col("l")).alias("r")).first()["r"]


def page(n, *bands, shade=248.0, sd=0.0):
    out = [(shade, sd)] * n
    for a, b, v in bands:
        out[a:b] = [(float(v), 0.0)] * (b - a)
    return out


@pytest.mark.parametrize("lines, want", [
    (page(1000, (0, 60, 210), (960, 1000, 60)), 0.1), (page(500), 0), (page(400, sd=3.0), 0),
    (page(800, (100, 180, 20), shade=229.0), 0.1), (page(1000, (0, 80, 70), shade=18.0), 0.08), (page(1000, (500, 504, 120)), 0), (page(1000, (500, 520, 120)), 0.02),
    (page(1000, (500, 530, 244)), 0),  # nearly the page's shade
    (page(1000, (500, 530, 120), (530, 545, 150)), 0.03),  # a new shade is a new band, too low here
    (page(1000, (0, 30, 10), (50, 90, 240)), 0),  # black, white
    ([], 0),
])
def test_flat_share(spark, lines, want):
    assert share(spark, lines) == pytest.approx(want)


def advise(spark, w, h, flat, cells, chars, suggested=False):
    df = spark.createDataFrame([(w, h, flat, cells, suggested)], "w int, h int, f double, c array<int>, s boolean")
    return df.select(A.advised(F.col("w"), F.col("h"), F.col("f"), F.col("c"), chars, F.col("s")).alias("r")).first()["r"]


def test_advice(spark):
    assert advise(spark, 2000, 900, 0.0, [26, 26, 10], [26, 26, 10]) == []
    shot, small = advise(spark, 296, 571, 0.12, [], [9])
    assert shot.startswith("This looks like a screenshot.") and "296 × 571 pixels" in small and "Export it at a larger size" in small
    assert advise(spark, 2000, 900, 0.0, [1], [3]) == [
        "Row 1 has 3 characters in the charset, but the maker only found 1 shape there. Letters that touch get read as one shape, so add some space between them. Turning up the letter spacing in your editor does it."
    ]
    assert advise(spark, 2000, 900, 0.0, [13, 4, 3], [13, 13, 13])[0].startswith("Rows 2 and 3 have far fewer shapes")
    assert advise(spark, 2000, 900, 0.0, [1], [3], True) == [] and advise(spark, 2000, 900, 0.0, [26, 26, 10], [3, 3]) == []


@pytest.mark.parametrize("raw, want", [
    ({"error": "  bad  ", "secret": 1, "sheetW": 12, "connect": True, "dpr": 1.5}, "error: bad\nconnect: true\nsheetW: 12\ndpr: 1.5"),
    ({"where": "", "stage": ["a"], "kind": {"a": 1}, "phase": None}, ""), ({"viewport": "9" * 30}, "viewport: " + "9" * 20),
    ([1], ""), ("text", ""), (7, ""), (None, ""),
])
def test_context(spark, raw, want):
    df = spark.createDataFrame([(json.dumps(raw),)], "raw string")
    assert df.select(A.context_text(A.context(F.col("raw"))).alias("r")).first()["r"] == want


def test_context_of_no_json(spark):
    df = spark.createDataFrame([("{broken",), ("",), (None,)], "raw string")
    assert [r[0] for r in df.select(A.context_text(A.context(F.col("raw")))).collect()] == ["", "", ""]
