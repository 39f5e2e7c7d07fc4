"""Literal cases of the shared rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from typelens.functions import binary as B
from typelens.functions import semantics as S
from typelens.functions import text as X
from typelens.operators import components as K
from typelens.operators import islands as I
from typelens.operators import tables as T
from typelens.plans import analytics as A
from typelens.plans import glyphs as G
from typelens.plans import raster as R
from typelens.plans.glyphs import merge_bands


def one(df):
    return df.first()[0]


def test_windows():
    now = dt.datetime.fromisoformat("2026-01-01T23:30:00-05:00")
    assert A.window_of(7, now) == (dt.date(2025, 12, 27), dt.date(2026, 1, 2), dt.date(2025, 12, 20))
    assert (A.window_of(999999, now)[1] - A.window_of(999999, now)[0]).days == 29


def test_rounding_and_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert one(df.agg(S.upper_median(F.col("x")))) == 3
    assert one(df.agg(S.middle_median(F.col("x")))) == 2.5
    assert one(df.limit(1).select(S.half_up(F.lit(-0.5)))) == 0
    assert one(df.filter("x > 99").agg(S.upper_median(F.col("x")))) is None
    assert one(df.limit(1).select(S.percent(F.lit(1), F.lit(0)))) is None


def test_funnel_split(spark):
    d = lambda x: dt.date.fromisoformat(f"2026-{x}")
    rows = [("10-18", "build_ok", "", 10), ("10-19", "build_ok", "mono", 3), ("10-25", "build_ok", "mono+script", 3), ("10-25", "build_fail", "trace", 2), ("10-26", "build_ok", "", 100), ("10-11", "build_ok", "", 100), ("10-25", "download", "woff2", 4), ("10-25", "library_download", "", 1)]
    c = spark.createDataFrame([(d(a), b, m, n) for a, b, m, n in rows], "day date, event string, meta string, count long")
    start, end, before = A.window_of(7, dt.datetime(2026, 10, 25, 12, tzinfo=dt.UTC))
    got = {r["event"]: (r["current"], r["previous"]) for r in A.totals(c, start, end, before).collect()}
    assert got == {"build_ok": (6, 10), "build_fail": (2, 0), "download": (4, 0), "library_download": (1, 0)}
    assert one(c.limit(1).select(S.percent(F.lit(6), F.lit(8)))) == 75


@pytest.mark.parametrize("cur, prev, text", [(4, 0, "No events in previous period"), (0, 0, "No change"), (0, 4, "-100% vs previous period"), (6, 4, "+50% vs previous period")])
def test_change_text(spark, cur, prev, text):
    assert one(spark.range(1).select(A.change_text(F.lit(cur), F.lit(prev)))) == text


def test_adoption(spark):
    d = dt.date
    rows = [(2, 0, d(2024, 1, 1), d(2024, 1, 3)), (1, 1, d(2024, 1, 3), d(2024, 1, 3)), (0, 2, None, None), (0, 0, None, None)]
    m = spark.createDataFrame(rows, "builds long, downloads long, first_build date, last_build date")
    assert tuple(A.adoption(m).first()) == (2, 2, 1)


def test_marks_and_limits(spark):
    fonts = spark.createDataFrame([(1, 1, "a"), (2, 9, "a"), (3, None, "b")], "id int, owner int, handle string")
    users = spark.createDataFrame([(1, "a"), (9, "z")], "id int, handle string")
    assert {r["id"]: r["m"] for r in T.mark(fonts, users, {"owner": "id", "handle": "handle"}, "m").collect()} == {1: True, 2: False, 3: False}
    calls = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0, 0, i), i) for i in range(5)] + [("j", dt.datetime(2024, 1, 1), 9)], "k string, ts timestamp, i int")
    assert sorted(r["i"] for r in T.admitted(calls, ["k"], "ts", 60, 3, F.col("i")).filter("allowed").collect()) == [0, 1, 2, 9]


def test_insert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "x", 0), (2, "b", 1), (2, "c", 2)], "id int, v string, seq int")
    once = T.insert_ignore(old, new, ["id"], F.col("seq"))
    twice = T.insert_ignore(once, new, ["id"], F.col("seq"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b")]


def test_as_of_carries_over_units(spark):
    d = dt.date
    facts = spark.createDataFrame([(d(2024, 1, 5), "a"), (d(2024, 3, 1), "b")], "day date, v string")
    probes = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 5),), (d(2024, 2, 9),), (d(2024, 3, 9),)], "at date")
    assert [r["v"] for r in T.as_of(probes, facts, "at", "day", "v").orderBy("at").collect()] == [None, "a", "a", "b"]


def test_islands(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 1, 3, 4, 7)], "k int, x int")
    assert sorted((r["start"], r["stop"]) for r in I.islands(df, ["k"], "x").collect()) == [(0, 2), (3, 5), (7, 8)]


@pytest.mark.parametrize("text, expect", [("  Héllo  World_1 ", "hello-world-1"), ("<b>", "b"), ("...", ""), ("A" * 40, "a" * 32)])
def test_handles(spark, text, expect):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(X.handle(F.col("t")))) == expect
    assert one(df.select(X.slug(F.col("t")))) == (expect or "untitled")


def test_search_is_literal(spark):
    df = spark.createDataFrame([("100%",), ("1000",), ("A_b",), ("axb",)], "t string")
    assert [r[0] for r in df.filter(S.contains_folded(F.col("t"), "a_B")).collect()] == ["A_b"]
    assert [r[0] for r in df.filter(S.contains_folded(F.col("t"), "0%")).collect()] == ["100%"]


def test_sfnt_round_trip():
    head = b"\0" * 16
    body = b"\0\1\0\0\0\1\0\0\0\0\0\0" + b"head" + (0).to_bytes(4, "big") + (28).to_bytes(4, "big") + (16).to_bytes(4, "big") + head
    fixed = B.sfnt_repaired(body)
    assert B.sfnt_errors(fixed) == [] and B.sfnt_repaired(fixed) == fixed
    assert B.sfnt_errors(fixed[:-1] + b"x") and B.sfnt_errors(b"no") == ["too short"]


def test_metadata_goes():
    chunk = lambda k, v: len(v).to_bytes(4, "big") + k + v + b"crc!"
    clean = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x") + chunk(b"IEND", b"")
    assert B.without_metadata(clean) == clean
    assert B.without_metadata(clean[:8] + chunk(b"tEXt", b"secret") + clean[8:]) == clean
    assert B.without_metadata(b"GIF89a") is None
    scan = b"\xff\xe0\x00\x04JF\xff\xe5\x00\x04ab\xff\xda\x00\x02da\xff\x00\xff\xd1ta\xff\xda\x00\x02more\xff\xd9"
    jpeg = b"\xff\xd8\xff\xe1\x00\x04ab\xff\xed\x00\x04ab\xff\xfe\x00\x04ab\xff\xe2\x00\x06MPF\0" + scan + b"\xff\xd8second picture"
    assert B.without_metadata(jpeg) == b"\xff\xd8" + scan
    assert B.without_metadata(b"\xff\xd8" + scan) == b"\xff\xd8" + scan and B.without_metadata(b"\xff\xd8" + scan[:-2]) is None


def test_components_and_holes():
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    assert K.holes(ring) == 1 and K.label(ring).max() == 1
    diagonal = np.eye(2, dtype=bool)
    assert K.label(diagonal).max() == 2 and K.label(diagonal, True).max() == 1


def test_band_merge():
    assert merge_bands([(0, 2), (3, 13)], 10) == [(0, 13)]
    assert merge_bands([(0, 10), (30, 40)], 10) == [(0, 10), (30, 40)]
    assert merge_bands([(0, 2)], 10) == [(0, 2)]


def brute_kmeans(points, k, rounds=16):
    """First centre: the first point; then the farthest from all centres; empty clusters keep their centre; first on ties."""
    centres = [points[0]]
    while len(centres) < k:
        centres.append(points[int(np.argmax(np.min([((points - c) ** 2).sum(1) for c in centres], 0)))])
    c, last = np.array(centres), None
    for _ in range(rounds):
        own = np.argmin(((points[:, None] - c[None]) ** 2).sum(2), 1)
        if last is not None and (own == last).all():
            break
        last = own
        for j in range(k):
            if (own == j).any():
                c[j] = points[own == j].mean(0)
    return c


def test_kmeans_takes_all_points(spark, tmp_path):
    from typelens.plans import raster

    rng = np.random.default_rng(2)
    near, late = rng.normal(-0.3, 0.02, (6000, 3)), rng.normal(0.3, 0.1, (1500, 3))  # the late ones follow after 6000 rows
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(np.concatenate([near, late]))] + [(9000, 2, [0.1, 0.2, 0.3]), (9001, 2, [0.3, 0.2, 0.1])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = raster.lab_points(spark, str(tmp_path)).toPandas().sort_values("vec_id")
    got = {(r["label"], r["cluster"]): (r["l"], r["a"], r["bb"]) for r in raster.kmeans_farthest(spark, str(tmp_path)).collect()}
    want = {}
    for label, own in ((1, p["vec_id"] < 9000), (2, p["vec_id"] >= 9000)):
        for k, c in enumerate(brute_kmeans(p[own][["l", "a", "bb"]].to_numpy(), min(3, int(own.sum())))):
            want[label, k] = tuple(c)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_messages_and_sizes(spark):
    """Messages of each class, the order of the classes, empty messages and unknown sizes."""
    cases = {
        "The engine did not load": "engine_load", "No glyphs were traced": "no_glyphs", "found 5 rows but your charset has 6": "rows_mismatch",
        "no character rows found": "no_rows", "Charset is empty": "charset", "Worker stopped": "worker", "boom": "other", "": "other", None: "other",
    }
    rows = spark.createDataFrame(list(cases.items()), "m string, want string").select("want", X.failure_class(F.col("m")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)
    one = spark.createDataFrame([(" \n ", None)], "m string, n long").select(X.redacted(F.col("m")).alias("m"), X.kilobytes(F.col("n")).alias("n"), X.kilobytes(F.lit(31_744)).alias("k")).first()
    assert tuple(one) == ("No error message provided.", "–", "31 KB")


def test_layouts(spark):
    cases = [([26, 10], "A to Z and 0 to 9"), ([24, 27, 11], "A to Z, a to z and 0 to 9"), ([13, 13, 13, 13, 10], "A to Z, a to z and 0 to 9 in five rows"), ([40], None), ([26, 26, 10, 16], None), ([26, 26, 10, 15], "A to Z, a to z, 0 to 9 and a row of punctuation"), ([], None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, cells array<long>")
    assert [r[0] for r in df.orderBy("i").select(G.best_layout(F.col("cells"))["n"]).collect()] == [x for _, x in cases]


def test_short_rows(spark):
    cases = [([5, 3], "ABCDE\nFGH"), ([9, 9, 9], "ABCDEFGHI\nJKLMNOPQR\nSTUVWXYZ□"), ([13, 13], None), ([26], None), ([10, 16], "ABCDEFGHIJ\nKLMNOPQRSTUVWXYZ"), ([12, 9], None), ([0, 3], None), ([], None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, cells array<long>")
    assert [r[0] for r in df.orderBy("i").select(G.short_rows(F.col("cells"))).collect()] == [x for _, x in cases]


def test_spacing(spark):
    rows = [(1, c, 50.0, k) for c, k in zip("HOn", (4.0, 2.0, 3.0))] + [(2, c, 4.0, 0.0) for c in "HOn"] + [(3, c, 4.0, 1.0) for c in "HO"]
    got = G.spacing(spark.createDataFrame(rows, "face long, ch string, width double, counter double")).orderBy("face").collect()
    assert [tuple(r) for r in got] == [(1, "counters", 3, 6.0), (2, "proportions", 3, 3.3), (3, "fallback", 2, 3.5)]


def test_dropped(spark):
    # o: one pair seen twice votes once, rare pairs don't; p: a third of the seams to plain followers open gaps; w: gaps before entry joins don't count
    rows = [(1, "o", "w", 1, 0, "worse", False), (2, "o", "w", 3, 2, "better", False), (3, "o", "x", 1, 0, "better", False), (4, "p", "a", 1, 0, "tie", True), (5, "p", "b", 1, 1, "tie", False), (6, "p", "c", 1, 0, "tie", False),
            (7, "w", "z", 1, 2, "tie", True), (8, "w", "y", 1, 0, "tie", False), (9, "l", "l", 0, 0, "worse", True)]
    df = spark.createDataFrame(rows, "sheet_id long, ch string, follower string, form long, follower_form long, verdict string, gap boolean")
    assert sorted(r["ch"] for r in G.dropped(df, []).collect()) == ["o", "p"]


def test_body_bounds(spark):
    def bounds(cols, span=1):
        df = spark.createDataFrame([(1, x, n, 0 if n else None, (9 if n > 4 else span - 1) if n else None) for x, n in enumerate(cols)], "sheet_id long, x long, n long, y0 long, y1 long")
        return tuple(R.body_bounds(df).select("x0", "x1").first())

    assert bounds([0, 1, 1, 1, 10, 10, 10, 10, 10, 10, 0]) == (3, 9)  # floor(9 * 0.3) = 2 columns at most
    assert bounds([1, 10, 10, 10, 10]) == (0, 4)  # one column is too little
    assert bounds([1, 1, 10, 10, 10, 10, 10, 10], span=8) == (0, 7)  # tall columns stay


def test_meta_edit(spark):
    cases = [('{"treat":"mono","og":true,"n":1.0,"deep":{"a":[1,2.5]}}', True, '{"treat":"mono","og":false,"n":1,"deep":{"a":[1,2.5]},"family":"Öl","license":"ofl"}', True),
             ('{"license":"cc0","og":true}', False, '{"license":"ofl","og":true,"family":"Öl"}', False), ('{"og":"true"}', True, '{"og":"true","family":"Öl","license":"ofl"}', False),
             ("{broken", True, '{"family":"Öl","license":"ofl"}', False), ("[1]", True, '{"family":"Öl","license":"ofl"}', False), (None, True, '{"family":"Öl","license":"ofl"}', False)]
    df = spark.createDataFrame([(i, r, c) for i, (r, c, _, _) in enumerate(cases)], "i int, raw string, changed boolean")
    got = df.orderBy("i").select(X.edited_meta("raw", F.lit("Öl"), F.lit("ofl"), "changed").alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]


def test_lists(spark):
    rows = spark.createDataFrame([(0, [2]), (1, [1, 3]), (2, [1, 2, 4]), (3, [])], "i int, r array<int>").orderBy("i")
    assert [r[0] for r in rows.select(X.row_list(F.col("r"))).collect()] == ["Row 2", "Rows 1 and 3", "Rows 1, 2 and 4", None]
    assert one(rows.limit(1).select(X.plural(F.lit(1), "row", "rows"))) == "1 row" and one(rows.limit(1).select(X.plural(F.lit(0), "row", "rows"))) == "0 rows"
    assert [r[0] for r in rows.select(X.allowed(F.lit("A@x.org"), F.lit(" b@x.org, a@X.org ,"))).limit(1).collect()] == [True]
    raw = spark.createDataFrame([(0, '["é","b"]'), (1, '["a",1]'), (2, "[]"), (3, None), (4, "{"), (5, '{"a":"b"}')], "i int, raw string").orderBy("i")
    assert [r[0] for r in raw.select(X.armed(F.col("raw"))).collect()] == ["é\nb", None, None, None, None, None]


def test_spacing_problem(spark):
    cases = [((600.0, 50.0, 550.0), False, False), ((0.0, 0.0, 10.0), True, True), ((None, 0.0, 10.0), True, True), ((float("inf"), 0.0, 1.0), True, True), ((300.0, -20.0, 500.0), True, False), ((600.0, -90.0, 600.0), False, False)]
    df = spark.createDataFrame([(i, *c) for i, (c, _, _) in enumerate(cases)], "i int, a double, l double, r double").orderBy("i")
    f = lambda overlap: [r[0] for r in df.select(S.spacing_problem(F.col("a"), F.col("l"), F.col("r"), F.lit(1000.0), overlap)).collect()]
    assert f(False) == [c[1] for c in cases] and f(True) == [c[2] for c in cases]


def test_components_of_rows(spark):
    """Rasters of any width, one row each; null, empty and blank ones have no component and no hole."""
    ring = [x in (0, 3) or y in (0, 2) for y in range(3) for x in range(4)]
    far = [True, False, False, False, True, False]
    df = spark.createDataFrame([(1, ring, 4), (2, far, 3), (3, None, 4), (4, [], 4), (5, [False] * 8, 4)], "sheet_id long, ink array<boolean>, width int")
    c = {(r.sheet_id, r.root): r for r in K.components(df).collect()}
    assert sorted(c) == [(1, 0), (2, 0), (2, 4)]
    r = c[1, 0]
    assert (r.area, r.largest, r.x0, r.x1, r.y0, r.y1, r.top, r.bottom, r.left, r.right) == (10, 10, 0, 3, 0, 2, 4, 4, 3, 3)
    assert [(r.sheet_id, r.area) for r in K.components(df.filter("sheet_id = 2"), diagonal=True).collect()] == [(2, 2)]
    assert sorted(tuple(r) for r in K.hole_areas(df).collect()) == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 0)]
