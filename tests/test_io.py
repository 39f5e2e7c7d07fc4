"""Sources and sinks over small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typelens.sources import io


def test_first_and_exists(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (1, "a")], "k int, v string")
    assert [tuple(r) for r in io.first_row(df, F.col("k"), F.col("v").asc_nulls_last()).collect()] == [(1, "a")]
    assert io.first_row(df.filter("k > 5"), F.col("k")).count() == 0
    assert io.exists(df) and not io.exists(df.filter("k > 5"))


def test_objects_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("a.otf", 3), ("b.png", 5), ("empty.png", 0)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    found = io.objects(spark, str(tmp_path / "in"), "*.png")
    assert sorted((r.path.rsplit("/", 1)[1], r.length, bytes(r.content)) for r in found.collect()) == [("b.png", 5, b"xxxxx")]  # empty ones are passed over
    io.manifest(io.objects(spark, str(tmp_path / "in")), str(tmp_path / "m"))
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "m")).select("name", "length").collect()) == [("a.otf", 3), ("b.png", 5)]


def test_nested_json(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"id": "a", "rows": [{"c": "H", "x": 1}]}, {"id": "b", "extra": 1}]))
    schema = T.StructType.fromDDL("id string, rows array<struct<c:string,x:int>>")
    got = io.nested_json(spark, str(tmp_path / "f.json"), schema).select("id", F.get("rows", F.lit(0))["x"].alias("x")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", None)]


def test_missing_table(spark):
    assert io.table_or_empty(spark, "no_such_table_yet", T.StructType.fromDDL("a int")).collect() == []


def test_new_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = io.evolved(df, T.StructType.fromDDL("a bigint, b string, locked int, note string"), {"b": "d", "locked": 0})
    assert sorted(map(tuple, got.collect())) == [(1, None, 0, None), (2, "x", 0, None)]
    assert got.schema["a"].dataType == T.LongType()


def test_publish_is_all_or_nothing(spark, tmp_path):
    root, row = str(tmp_path), spark.createDataFrame([(1,)], "id int")
    io.publish({"glyphs": spark.range(3), "none": spark.range(0)}, row, root, "one")
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        io.publish({"glyphs": spark.range(5), "bad": bad}, row, root, "two")
    with pytest.raises(FileExistsError):
        io.publish({}, row, root, "one")
    rows = spark.read.parquet(f"{root}/rows").collect()
    assert [r.id for r in rows] == [1] and spark.read.parquet(f"{rows[0].objects}/glyphs").count() == 3
    assert [p.name for p in (tmp_path / "objects").iterdir()] == ["one"]


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([("a&b", "2024-01-02"), ("c", None)], "u string, d string")
    url = F.concat(F.lit("<url><loc>"), F.replace("u", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "d", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    io.text_sink(df, url, str(tmp_path / "x"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "x")).collect()) == ["<url><loc>a&amp;b</loc><lastmod>2024-01-02</lastmod></url>", "<url><loc>c</loc></url>"]


def test_commit(spark, tmp_path):
    """Two tables appear together, or neither does; a later commit is what is read, a failed one leaves the one before."""
    root = str(tmp_path / "tables")
    assert io.committed(spark, root, "a") is None
    a, b = spark.range(3), spark.range(5)
    io.commit({"a": a, "b": b}, root, "0001")
    assert io.committed(spark, root, "a").count() == 3 and io.committed(spark, root, "b").count() == 5
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        io.commit({"a": b, "b": bad}, root, "0002")
    assert io.committed(spark, root, "a").count() == 3
    io.commit({"a": b, "b": a}, root, "0003")
    assert io.committed(spark, root, "a").count() == 5 and io.committed(spark, root, "b").count() == 3
    with pytest.raises(FileExistsError):
        io.commit({"a": a}, root, "0003")


def test_sitemap(spark, tmp_path):
    """Whole documents of bounded length, with every address once, escaped, in order; no date where there is none."""
    import xml.etree.ElementTree as ET

    rows = [(f"https://x/{k:03d}?a=1&b=<{k}>", None if k % 3 else f"2024-01-{k % 28 + 1:02d}") for k in range(95)]
    io.sitemap_sink(spark.createDataFrame(rows, "loc string, lastmod string"), str(tmp_path / "map"), most=20)
    seen, space = {}, "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    files = [p for p in (tmp_path / "map").rglob("part-*.txt")]
    assert len(files) >= 5
    for p in files:
        urls = ET.fromstring(p.read_text().encode()).findall(f"{space}url")
        locs = [u.find(f"{space}loc").text for u in urls]
        assert 0 < len(locs) <= 20 and locs == sorted(locs)
        seen |= {u.find(f"{space}loc").text: getattr(u.find(f"{space}lastmod"), "text", None) for u in urls}
    assert seen == dict(rows)
