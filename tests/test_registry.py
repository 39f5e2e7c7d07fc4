"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from typelens import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in plans.SQL:
        got = duck.execute(plans.SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["font_id", "votes"]
