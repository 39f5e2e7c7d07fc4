"""Findings of the third round: what failed at size or on odd rows."""

import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from typelens.streaming import ingest


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_admission_over_batches(spark, tmp_path, small_batches):
    """The first of a user's hour are admitted in whatever order and number of batches they come; no user is a user; ids stay whole; state has a few rows an hour."""
    big = 2**60 + 1
    rows = [(big + i, f"2024-01-01 00:{50 - i:02d}:00", big) for i in range(9)] + [(i, f"2024-01-01 00:{i:02d}:00", None) for i in range(3)] + [(1000 + i, "2024-01-01 00:30:00", i) for i in range(60)]
    rows += [(None, "2024-01-01 01:00:00", 5), (7, "2024-01-01 01:00:00", 5), (6, "2024-01-01 01:00:00", 5), (2000, None, 8), (2001, None, 8), (2002, None, 8)]
    df = spark.createDataFrame([(*r, "view", 1.0, "{}") for r in rows], "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) AS ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.admitted(ingest.event_stream(spark, str(tmp_path / "in")), 2).writeStream.format("memory").queryName("admission").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("admission").collect()]
    want = [(big + 8, big), (big + 7, big), (0, None), (1, None), (6, 5), (7, 5), (2000, 8), (2001, 8), *[(1000 + i, i) for i in range(60)]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 3 * (ingest.SHARDS + 1)


def test_admission_goes_on_from_state():
    """Counters of earlier batches count."""
    at = np.arange(5)
    ok, users, counts = ingest.first_of(np.array([3, 3, 9, 1, 3]), (at,), np.array([1, 3]), np.array([2, 1]), 2)
    assert ok.tolist() == [0, 2] and users.tolist() == [1, 3, 9] and counts.tolist() == [3, 4, 1]


def versus_sql(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over small tables, sorted."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted([tuple(r) for r in got.collect()], key=str), sorted(want, key=str)


def test_colours_in_single_precision(spark, tmp_path):
    """Values at the edges of bytes, where single and double precision give different ones; values that are no numbers."""
    edges = [struct.unpack("f", struct.pack("f", k / 255 - 0.5))[0] for k in np.arange(0.5, 255, 1.0)]
    near = [float(np.float32(x) + np.float32(d) * np.spacing(np.float32(x))) for x in edges for d in (-2, -1, 0, 1, 2)] + [float("nan"), float("inf"), float("-inf")]
    rows = [(i, [x, near[-1 - i], 0.1, *[0.0] * 61], i % 3) for i, x in enumerate(near)]
    got, want = versus_sql(spark, tmp_path, "lab_convert", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert len(got) == len(near) and got == want


def test_mark_owners_makes_no_row_of_a_pair(spark, tmp_path):
    """Marks are joined to one row for each sheet, not to its cells; ids that come again are one mark."""
    rows = [(i, "x", "b", "t", i * 7 % 50, 1.0) for i in [*range(240), 8, 30, 30, 2, 0]] + [(9, "x", "b", "t", 44, 1.0)]
    got, want = versus_sql(spark, tmp_path, "mark_owners", part=spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    assert got == want and got
    plan = entry.queries()["mark_owners"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "collect_list" in plan


def test_characters_are_counted_in_one_pass(spark, tmp_path):
    """Characters of any plane, spaces, line ends, tabs, no text; without an array of strings to sort."""
    texts = ["aab c\nc", "", None, " \n ", "é́éa\tA", "😀😀 \U0010ffff￿ x", "\0\0a", "漢字 漢"]
    got, want = versus_sql(spark, tmp_path, "charset_problems", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want and len(got) == 6
    assert "array_sort" not in entry.queries()["charset_problems"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_sheets_are_held_a_few_at_a_time(spark):
    """Whatever an Arrow batch has, a worker has the numbers of a few sheets; one step gives what two give."""
    from typelens.operators import skeleton, strokes

    ink = np.zeros((12, 12), bool)
    ink[5:7, 1:11] = True
    n = 3 * skeleton.SHEETS + 1
    df = spark.createDataFrame([(i, ink.ravel().tolist() if i % 3 else None, 12) for i in range(n)], "sheet_id long, ink array<boolean>, width int")
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([ink.ravel()] * n, pa.list_(pa.bool_())), pa.array([12] * n)], ["sheet_id", "ink", "width"])
    sizes = [b.num_rows for b in skeleton.skeletonised(iter([batch]))]
    assert sum(sizes) == n and max(sizes) == skeleton.SHEETS
    rows = lambda s: sorted(map(str, s.collect()))
    assert rows(strokes.strokes_of(df)) == rows(strokes.strokes(skeleton.skeletons(df)))


def test_near_copies_are_searched_by_fingerprint(spark, monkeypatch):
    """The pipeline's stage finds near copies by SimHash, checks its links by the sets, and leaves to prefix filtering what SimHash has not connected."""
    import corpus_pipeline
    from typelens.llm import jaccard

    rng, sh = np.random.default_rng(5), jaccard.simhash.simhash
    made = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(40)]
    texts = [t for t in made if (sh(t) ^ sh(f"{t} end")).bit_count() <= 3][:6]
    rows = [*enumerate(texts), *[(10 + i, f"{t} end") for i, t in enumerate(texts[:3])]]
    rows += [(20, texts[5] + " " + " ".join(f"z{k}" for k in range(90)))]  # a similarity over 0.8 and many bits
    assert (sh(texts[5]) ^ sh(rows[-1][1])).bit_count() > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_prefix = []
    pairs = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: by_prefix.append(found := pairs(*a)) or found)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(6))
    assert by_prefix[0].filter("b is not null").count() == 1
