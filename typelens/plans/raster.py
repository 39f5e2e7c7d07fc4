"""Rasters: ink, runs, cuts, morphology, components, colour. The sheets are the 8 x 8 views of the vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import semantics as S
from ..operators import components as K
from ..operators import islands as I
from ..operators import slicing as W
from ..sources.bindings import INK, pixels, rasters, sql, table
from ..sources.shipping import ship
from . import query

_INK = ", ink AS (SELECT * FROM pixels_v WHERE ink)"
_ROWS = _INK + ", rws AS (SELECT DISTINCT sheet_id, y FROM ink), g AS (SELECT *, y - row_number() OVER (PARTITION BY sheet_id ORDER BY y) AS k FROM rws), runs AS (SELECT sheet_id, min(y) AS start, max(y) + 1 AS stop FROM g GROUP BY sheet_id, k)"
_COLS = _INK + ", rws AS (SELECT DISTINCT sheet_id, x FROM ink), g AS (SELECT *, x - row_number() OVER (PARTITION BY sheet_id ORDER BY x) AS k FROM rws), runs AS (SELECT sheet_id, min(x) AS start, max(x) + 1 AS stop FROM g GROUP BY sheet_id, k)"


@query(sql("SELECT sheet_id, count(*) FILTER (WHERE ink) AS ink, CAST(sum(CASE WHEN ink THEN 0 ELSE 255 END) AS BIGINT) AS sum FROM pixels_v GROUP BY sheet_id", "pixels_v"))
def binarize_8x8(spark, d):
    """Counted inside each vector: no shuffle."""
    bits = F.transform("embedding", lambda z: (z.cast("double") > 0.12).cast("int"))
    n = F.aggregate(bits, F.lit(0), lambda a, b: a + b).cast("long")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), n.alias("ink"), ((64 - n) * 255).alias("sum"))


@query(sql("SELECT sheet_id, y, count(*) FILTER (WHERE ink) AS ink FROM pixels_v GROUP BY sheet_id, y", "pixels_v"))
def ink_rows(spark, d):
    return pixels(spark, d).groupBy("sheet_id", "y").agg(F.count_if("ink").alias("ink"))


@query(sql("SELECT sheet_id, x, count(*) FILTER (WHERE ink) AS ink FROM pixels_v GROUP BY sheet_id, x", "pixels_v"))
def ink_cols(spark, d):
    return pixels(spark, d).groupBy("sheet_id", "x").agg(F.count_if("ink").alias("ink"))


def row_runs(spark, d):
    return I.islands(pixels(spark, d).filter("ink").select("sheet_id", "y").distinct(), ["sheet_id"], "y")


def col_runs(spark, d):
    return I.islands(pixels(spark, d).filter("ink").select("sheet_id", "x").distinct(), ["sheet_id"], "x")


@query(sql(_ROWS + " SELECT * FROM runs", "pixels_v"))
def row_islands(spark, d):
    return row_runs(spark, d)


@query(sql(_COLS + " SELECT * FROM runs", "pixels_v"))
def col_islands(spark, d):
    return col_runs(spark, d)


@query(sql(_COLS + """, gp AS (SELECT *, start - lag(stop) OVER (PARTITION BY sheet_id ORDER BY start) AS gap FROM runs),
f AS (SELECT sheet_id, coalesce(list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[CAST(floor(count(gap) / 2) AS BIGINT) + 1], 1) AS m, count(*) AS n FROM gp GROUP BY 1),
s AS (SELECT gp.*, sum(CASE WHEN gap IS NULL OR n < 3 OR gap >= 0.35 * greatest(m, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY gp.sheet_id ORDER BY start) AS ses FROM gp JOIN f USING (sheet_id))
SELECT sheet_id, min(start) AS start, max(stop) AS stop FROM s GROUP BY sheet_id, ses""", "pixels_v"))
def merge_narrow_runs(spark, d):
    return I.merged_narrow(col_runs(spark, d), ["sheet_id"])


@query(sql(_COLS + """, gp AS (SELECT *, lag(stop) OVER (PARTITION BY sheet_id ORDER BY start) AS from_ FROM runs), r AS (SELECT *, start - from_ AS gap, row_number() OVER (PARTITION BY sheet_id ORDER BY start - from_ DESC, start) AS rn FROM gp WHERE from_ IS NOT NULL)
SELECT sheet_id, (from_ + start) / 2 AS cut, gap FROM r WHERE rn <= 2""", "pixels_v"))
def widest_gap_cuts(spark, d):
    return I.widest_gap_cuts(col_runs(spark, d), ["sheet_id"], F.lit(3))


@query(sql(""", c AS (SELECT sheet_id, x, count(*) FILTER (WHERE ink) AS n FROM pixels_v GROUP BY 1, 2), e AS (SELECT unnest([1, 2, 3]) AS k),
w AS (SELECT sheet_id, k, x, n, row_number() OVER (PARTITION BY sheet_id, k ORDER BY n, x) AS rn FROM c JOIN e ON x >= k * 2 - 0.7 AND x < k * 2 + 0.7)
SELECT sheet_id, CAST(k AS BIGINT) AS k, x AS cut FROM w WHERE rn = 1""", "pixels_v"))
def anchored_cuts(spark, d):
    """Four columns expected over a span of 8: near each expected cut the column with the least ink, the first on ties."""
    n = ink_cols(spark, d)
    near = n.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: (F.col("x") >= k * 2 - 0.7) & (F.col("x") < k * 2 + 0.7))))
    return near.groupBy("sheet_id", F.col("k").cast("long").alias("k")).agg(F.min(F.struct("ink", "x")).alias("m")).select("sheet_id", "k", F.col("m.x").alias("cut"))


@query(sql(_INK + """, last AS (SELECT sheet_id, x, max(y) AS y FROM ink GROUP BY 1, 2), n AS (SELECT sheet_id, y, count(*) AS n FROM last GROUP BY 1, 2),
t AS (SELECT sheet_id, count(*) AS cols, list_sort(list(y))[CAST(floor(0.7 * count(*)) AS BIGINT) + 1] AS p70 FROM last GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, y) AS rn FROM n)
SELECT p.sheet_id, CASE WHEN m.n IS NULL THEN 7 WHEN m.n >= 0.12 * t.cols THEN m.y ELSE t.p70 END AS baseline FROM (SELECT DISTINCT sheet_id FROM pixels_v) p LEFT JOIN m ON m.sheet_id = p.sheet_id AND rn = 1 LEFT JOIN t ON t.sheet_id = p.sheet_id""", "pixels_v"))
def baseline_mode(spark, d):
    """Inside each vector: last ink row per column, their mode if common enough, else the 70th percentile."""
    p = pixels(spark, d)
    last = p.groupBy("sheet_id", "x").agg(F.max(F.when(F.col("ink"), F.col("y"))).alias("y"))
    n = last.groupBy("sheet_id", "y").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("sheet_id").agg(
        F.max_by(F.struct("y", "n"), F.when(F.col("y").isNotNull(), F.struct(F.col("n"), -F.col("y")))).alias("m"),
        F.sum(F.when(F.col("y").isNotNull(), F.col("n"))).alias("cols"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("y").isNotNull(), F.array_repeat("y", F.col("n").cast("int")))))).alias("ys"),
    )
    return g.select("sheet_id", F.when(F.col("m").isNull(), F.lit(7)).when(F.col("m.n") >= 0.12 * F.col("cols"), F.col("m.y")).otherwise(F.get("ys", F.floor(0.7 * F.col("cols")).cast("int"))).cast("long").alias("baseline"))


def _window3(spark, d, over=INK):
    """Ink of the 3 x 3 neighbourhood by two passes of row and column windows: (n: ink around, whole: all 9 exist)."""
    rows = Window.partitionBy("sheet_id", "y").orderBy("x").rowsBetween(-1, 1)
    cols = Window.partitionBy("sheet_id", "x").orderBy("y").rowsBetween(-1, 1)
    p = pixels(spark, d, over).withColumn("a", F.sum(F.col("ink").cast("int")).over(rows)).withColumn("c", F.count(F.lit(1)).over(rows))
    return p.withColumn("n", F.sum("a").over(cols)).withColumn("whole", F.sum("c").over(cols))


_NEAR = ", nb AS (SELECT a.sheet_id, a.x, a.y, CAST(sum(CASE WHEN b.ink THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS whole FROM pixels_v a JOIN pixels_v b ON a.sheet_id = b.sheet_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)"


@query(sql(_NEAR.replace("pixels_v", "paint_v") + " SELECT sheet_id, x, y FROM nb WHERE n = 9", "paint_v"))
def morph_erode(spark, d):
    return _window3(spark, d, 0).filter("n = 9").select("sheet_id", "x", "y")


@query(sql(_NEAR + " SELECT sheet_id, x, y FROM nb WHERE n > 0", "pixels_v"))
def morph_dilate(spark, d):
    return _window3(spark, d).filter("n > 0").select("sheet_id", "x", "y")


@query(sql(""", r AS (SELECT sheet_id, y, count(*) FILTER (WHERE ink) AS ink FROM pixels_v GROUP BY 1, 2), s AS (SELECT *, avg(ink) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM r),
p AS (SELECT *, max(v) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, max(v) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rr FROM s)
SELECT sheet_id, y, round(v, 6) AS v FROM p WHERE v <= 0.6 * least(l, rr)""", "pixels_v"))
def valley_split(spark, d):
    w = Window.partitionBy("sheet_id").orderBy("y")
    r = ink_rows(spark, d).withColumn("v", F.avg("ink").over(w.rowsBetween(-2, 2)))
    r = r.withColumn("l", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rr", F.max("v").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return r.filter(F.col("v") <= 0.6 * F.least("l", "rr")).select("sheet_id", "y", F.round("v", 6).alias("v"))


_COMP = """, ink AS (SELECT sheet_id, x, y, y * 8 + x AS p FROM pixels_v WHERE ink),
reach AS (SELECT sheet_id, p, p AS q FROM ink UNION SELECT r.sheet_id, r.p, b.p FROM reach r JOIN ink a ON a.sheet_id = r.sheet_id AND a.p = r.q JOIN ink b ON b.sheet_id = a.sheet_id AND {near}),
root AS (SELECT sheet_id, p, min(q) AS root FROM reach GROUP BY 1, 2)"""
_FOUR, _EIGHT = "abs(a.x - b.x) + abs(a.y - b.y) = 1", "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1"


@query(sql(_COMP.format(near=_FOUR) + " SELECT sheet_id, root, count(*) AS area FROM root GROUP BY 1, 2", "pixels_v", recursive=True))
def components_8x8(spark, d):
    ship(spark)
    return K.components(rasters(spark, d)).select("sheet_id", "root", "area")


@query(sql(_COMP.format(near=_EIGHT) + " SELECT sheet_id, root, count(*) AS area FROM root GROUP BY 1, 2", "pixels_v", recursive=True))
def components_diagonal(spark, d):
    ship(spark)
    return K.components(rasters(spark, d), diagonal=True).select("sheet_id", "root", "area")


@query(sql(_COMP.format(near=_FOUR).replace("pixels_v", "paint_v") + ", a AS (SELECT sheet_id, root, count(*) AS area FROM root GROUP BY 1, 2) SELECT sheet_id, root, area FROM a QUALIFY area >= greatest(12, 0.03 * max(area) OVER (PARTITION BY sheet_id))", "paint_v", recursive=True))
def large_components(spark, d):
    ship(spark)
    c = K.components(rasters(spark, d, 0))
    return c.filter(F.col("area") >= F.greatest(F.lit(12), 0.03 * F.col("largest"))).select("sheet_id", "root", "area")


@query(sql(_COMP.format(near=_FOUR) + """, bx AS (SELECT root.sheet_id, root, min(x) AS x0, max(x) AS x1, count(*) AS area FROM root JOIN ink USING (sheet_id, p) GROUP BY 1, 2),
rc AS (SELECT *, max(x1) OVER (PARTITION BY sheet_id ORDER BY x0, x1, root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bx), gr AS (SELECT *, sum((reach IS NULL OR x0 > reach)::INT) OVER (PARTITION BY sheet_id ORDER BY x0, x1, root) AS g FROM rc),
sp AS (SELECT sheet_id, g, min(x0) AS x0, max(x1) AS x1, max(area) AS m FROM gr GROUP BY 1, 2) SELECT sheet_id, x0, x1 FROM sp QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY m DESC, x0) = 1""", "pixels_v", recursive=True))
def body_extent(spark, d):
    """Columns of the largest component, widened by components that overlap it, again and again."""
    ship(spark)
    boxes = K.components(rasters(spark, d))
    w = Window.partitionBy("sheet_id").orderBy("x0", "x1", "component")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = boxes.withColumn("new", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0)).withColumn("g", F.sum("new").over(w))
    spans = grouped.groupBy("sheet_id", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("area").alias("m"))
    return S.first_wins(spans, ["sheet_id"], F.desc("m"), F.col("x0")).select("sheet_id", "x0", "x1")


@query(sql(""", grid AS (SELECT s.sheet_id, i % 10 - 1 AS x, i // 10 - 1 AS y FROM (SELECT DISTINCT sheet_id FROM pixels_v) s, range(0, 100) t(i)), bg AS (SELECT g.sheet_id, g.x, g.y FROM grid g LEFT JOIN pixels_v p ON p.sheet_id = g.sheet_id AND p.x = g.x AND p.y = g.y WHERE p.ink IS NULL OR NOT p.ink),
out AS (SELECT sheet_id, x, y FROM bg WHERE x = -1 AND y = -1 UNION SELECT b.sheet_id, b.x, b.y FROM out o JOIN bg b ON b.sheet_id = o.sheet_id AND abs(b.x - o.x) + abs(b.y - o.y) = 1)
SELECT b.sheet_id, CAST((SELECT count(*) FROM bg k WHERE k.sheet_id = b.sheet_id) - count(*) AS BIGINT) AS hole_area FROM out b GROUP BY b.sheet_id""", "pixels_v", recursive=True))
def hole_area(spark, d):
    ship(spark)
    return K.hole_areas(rasters(spark, d))


_LIN = "CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_LAB = (
    ", rgb AS (SELECT vec_id, " + ", ".join(f"CAST(least(255, greatest(0, floor((embedding[{k + 1}] + 0.5) * 255 + 0.5))) AS DOUBLE) AS {c}" for k, c in enumerate("rgb")) + " FROM embeddings), "
    "lin AS (SELECT *, " + ", ".join(_LIN.format(c=c) + f" AS l{c}" for c in "rgb") + " FROM rgb), "
    "xyz AS (SELECT *, " + ", ".join(f"({m[0]} * lr + {m[1]} * lg + {m[2]} * lb) / {w} AS t{k}" for k, (m, w) in enumerate(zip(C.XYZ, C.WHITE))) + " FROM lin), "
    "f AS (SELECT *, " + ", ".join(f"CASE WHEN t{k} > 216 / 24389.0 THEN pow(t{k}, 1 / 3.0) ELSE (24389 / 27.0 * t{k} + 16) / 116 END AS f{k}" for k in range(3)) + " FROM xyz), "
    "lab AS (SELECT vec_id, 116 * f1 - 16 AS l, 500 * (f0 - f1) AS a, 200 * (f1 - f2) AS bb FROM f)"
)


def single(x: float):
    return F.lit(x).cast("float")


def lab_points(spark, d):
    e = table(spark, d, "embeddings")
    # in single precision, as the vectors are; cut off before the floor, which makes a long and so has no NaN and infinities
    tone = lambda k: (F.get("embedding", F.lit(k)) + single(0.5)) * single(255) + single(0.5)
    byte = lambda k: F.floor(F.least(single(255), F.greatest(single(0), tone(k)))).cast("double")
    l, a, b = C.lab(byte(0), byte(1), byte(2))
    return e.select("vec_id", l.alias("l"), a.alias("a"), b.alias("bb"))


@query(sql(_LAB + " SELECT vec_id, round(l, 3) AS l, round(a, 3) AS a, round(bb, 3) AS bb FROM lab", "pixels_v"))
def lab_convert(spark, d):
    return lab_points(spark, d).select("vec_id", *[F.round(c, 3).alias(c) for c in ("l", "a", "bb")])


#: A palette of five Lab colours.
PALETTE = [(20.0, 0.0, 0.0), (50.0, 30.0, 20.0), (50.0, -30.0, 20.0), (60.0, 0.0, -30.0), (90.0, 0.0, 0.0)]


@query(sql(_LAB + ", pal AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {p[0]}, {p[1]}, {p[2]})" for k, p in enumerate(PALETTE)) + """) t(k, pl, pa, pb)),
r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY (l - pl) * (l - pl) + (a - pa) * (a - pa) + (bb - pb) * (bb - pb), k) AS rn FROM lab, pal) SELECT CAST(k AS BIGINT) AS colour, count(*) AS n FROM r WHERE rn = 1 GROUP BY k""", "pixels_v"))
def nearest_palette(spark, d):
    """The nearest of a fixed palette, as an expression over each row: no join."""
    p = lab_points(spark, d)
    own = [F.col(c) for c in ("l", "a", "bb")]
    best = F.array_min(F.array(*[F.struct(C.distance2(own, [F.lit(x) for x in q]).alias("d"), F.lit(k).cast("long").alias("k")) for k, q in enumerate(PALETTE)]))["k"]
    return p.groupBy(best.alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query()
def kmeans_farthest(spark, d):
    """k-means per vector group (label) over all its points: the first point, then the farthest; empty clusters keep their centre.

    The driver holds the centres (three a label); points are only aggregated.
    """
    e = table(spark, d, "embeddings").select("label", "vec_id")
    p = lab_points(spark, d).join(e, "vec_id").persist()
    own = [F.col(c) for c in ("l", "a", "bb")]
    point = F.array(*own)

    def beside(centres):
        c = spark.createDataFrame(list(centres.items()), "of long, centres array<array<double>>")
        return p.join(F.broadcast(c), p["label"].cast("long").eqNullSafe(c["of"]))

    far = F.transform("centres", lambda c: C.distance2(own, [c[0], c[1], c[2]]))
    n, centres = {}, {}
    for r in p.groupBy(F.col("label").cast("long").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min_by(point, "vec_id").alias("first")).collect():
        n[r["of"]], centres[r["of"]] = r["n"], [r["first"]]
    for k in (1, 2):
        for r in beside(centres).groupBy("of").agg(F.max_by(point, F.struct(F.array_min(far), -F.col("vec_id"))).alias("next")).collect() if centres else []:
            if k < n[r["of"]]:
                centres[r["of"]].append(r["next"])
    nearest = F.array_min(F.transform(far, lambda x, k: F.struct(x.alias("d"), k.alias("k"))))["k"]
    for _ in range(16 if centres else 0):
        before = {x: list(c) for x, c in centres.items()}
        for r in beside(centres).groupBy("of", nearest.alias("k")).agg(F.array(*[F.avg(c) for c in own]).alias("mean")).collect():
            centres[r["of"]][r["k"]] = r["mean"]
        if all(abs(x - y) < 1e-12 for of in centres for b, c in zip(before[of], centres[of]) for x, y in zip(b, c)):
            break
    p.unpersist()
    rows = [(of, k, *[round(x, 6) for x in c]) for of, cs in centres.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "label long, cluster long, l double, a double, bb double")


@query(sql(""", b AS (SELECT sheet_id, x, y, CAST(floor((value + 0.6) * 16) AS BIGINT) AS bucket, value FROM pixels_v WHERE x IN (0, 7) OR y IN (0, 7)),
n AS (SELECT sheet_id, bucket, count(*) AS n, avg(value) AS v, min(y * 8 + x) AS first FROM b GROUP BY 1, 2) SELECT sheet_id, bucket, n, round(v, 6) AS mean FROM n QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, first) = 1""", "pixels_v"))
def border_mode_colour(spark, d):
    b = pixels(spark, d).filter("x in (0, 7) or y in (0, 7)").withColumn("bucket", F.floor((F.col("value") + 0.6) * 16))
    n = b.groupBy("sheet_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"), F.min(F.col("y") * 8 + F.col("x")).alias("first"))
    m = n.groupBy("sheet_id").agg(F.max_by(F.struct("bucket", "n", "v"), F.struct(F.col("n"), -F.col("first"))).alias("m"))
    return m.select("sheet_id", "m.bucket", "m.n", F.round("m.v", 6).alias("mean"))


@query(sql(""", t AS (SELECT label, CAST(floor(least(0.999, greatest(0, embedding[1] + 0.5)) * 24) AS BIGINT) AS bin, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings),
a AS (SELECT label, bin, avg(v) AS v FROM t GROUP BY 1, 2), s AS (SELECT label, unnest(range(0, 24)) AS bin FROM (SELECT DISTINCT label FROM t)),
j AS (SELECT s.label, s.bin, n.bin AS from_bin, n.v, row_number() OVER (PARTITION BY s.label, s.bin ORDER BY abs(n.bin - s.bin), n.bin) AS rn FROM s JOIN a n ON n.label = s.label)
SELECT CAST(label AS BIGINT) AS label, bin, from_bin, round(v, 6) AS v FROM j WHERE rn = 1""", "pixels_v"))
def gradient_bins(spark, d):
    """24 bins of means per group; an empty bin takes the nearest, the lower of two."""
    e = table(spark, d, "embeddings")
    at = F.floor(F.least(single(0.999), F.greatest(single(0), F.get("embedding", F.lit(0)) + single(0.5))) * single(24))
    a = e.groupBy("label", at.alias("bin")).agg(F.avg(F.get("embedding", F.lit(1)).cast("double")).alias("v"))
    s = e.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("bin"))
    w = Window.partitionBy("label").orderBy("bin")
    j = s.join(a, ["label", "bin"], "left").withColumn("own", F.when(F.col("v").isNotNull(), F.struct(F.col("bin").alias("b"), "v")))
    j = j.withColumn("lo", F.last("own", True).over(w)).withColumn("hi", F.first("own", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    pick = F.when(F.col("hi").isNull() | (F.col("bin") - F.col("lo.b") <= F.col("hi.b") - F.col("bin")), F.col("lo")).otherwise(F.col("hi"))
    return j.select(F.col("label").cast("long").alias("label"), "bin", pick["b"].alias("from_bin"), F.round(pick["v"], 6).alias("v"))


_STEP = "list_sort(list_transform(list_filter([b - 1, b, b + 1], lambda p: p >= 1 AND p <= 8), lambda p: {'c': costs[p], 'p': p}))[1]"


@query(sql(f""", ln AS (SELECT sheet_id, y, list(CASE WHEN ink THEN 1.0e0 ELSE 0.0e0 END ORDER BY x) AS k FROM pixels_v GROUP BY 1, 2),
dp AS (SELECT sheet_id, y, k AS costs, ['0', '1', '2', '3', '4', '5', '6', '7'] AS paths FROM ln WHERE y = 0
UNION ALL SELECT sheet_id, y, list_transform(range(1, 9), lambda b: k[b] + s[b].c + abs(b - s[b].p) * 0.001e0), list_transform(range(1, 9), lambda b: paths[s[b].p] || ',' || CAST(b - 1 AS VARCHAR)) FROM
(SELECT dp.sheet_id, ln.y, ln.k, paths, list_transform(range(1, 9), lambda b: {_STEP}) AS s FROM dp JOIN ln ON ln.sheet_id = dp.sheet_id AND ln.y = dp.y + 1))
SELECT sheet_id, paths[list_position(costs, list_min(costs))] AS seam FROM dp WHERE y = 7""", "pixels_v", recursive=True))
def min_ink_seam(spark, d):
    """Per sheet, the path from top to bottom with the least ink, steps of at most one column."""
    ship(spark)

    def run(it):
        for pdf in it:
            out = [W.seam(np.array(e, float).reshape(8, 8) > INK, 0, 7) for e in pdf["embedding"]]
            yield pd.DataFrame({"sheet_id": pdf["vec_id"], "seam": [",".join(map(str, p)) for p in out]})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "sheet_id long, seam string")


@query(sql(""", c AS (SELECT sheet_id, x, count(*) FILTER (WHERE ink) AS n, min(y) FILTER (WHERE ink) AS y0, max(y) FILTER (WHERE ink) AS y1 FROM pixels_v GROUP BY 1, 2),
g AS (SELECT sheet_id, min(x) FILTER (WHERE n > 0) AS a, max(x) FILTER (WHERE n > 0) AS z, sum(n) AS total, max(n) AS peak, max(y1) - min(y0) + 1 AS h FROM c GROUP BY 1),
t AS (SELECT *, n < 0.5 * peak AND (n = 0 OR y1 - y0 + 1 <= 0.55 * h) AS thin, sum(n) OVER (PARTITION BY sheet_id ORDER BY x) AS l, sum(n) OVER (PARTITION BY sheet_id ORDER BY x DESC) AS r FROM c JOIN g USING (sheet_id) WHERE x BETWEEN a AND z),
b AS (SELECT sheet_id, any_value(a) AS a, any_value(z) AS z, min(x) FILTER (WHERE NOT (thin AND l <= 0.08 * total AND x - a < floor((z - a + 1) * 0.3))) AS lo, max(x) FILTER (WHERE NOT (thin AND r <= 0.08 * total AND z - x < floor((z - a + 1) * 0.3))) AS hi FROM t GROUP BY 1)
SELECT sheet_id, CASE WHEN lo - a < greatest(2, floor((z - a + 1) * 0.04 + 0.5)) THEN a ELSE lo END AS x0, CASE WHEN z - hi < greatest(2, floor((z - a + 1) * 0.04 + 0.5)) THEN z ELSE hi END AS x1 FROM b""", "pixels_v"))
def dense_body_bounds(spark, d):
    """Column bounds of the body of each sheet that has ink."""
    ink = lambda c: F.when(F.col("ink"), F.col(c))
    c = pixels(spark, d).groupBy("sheet_id", "x").agg(F.count_if("ink").alias("n"), F.min(ink("y")).alias("y0"), F.max(ink("y")).alias("y1"))
    return body_bounds(c)


def body_bounds(cols, area=0.08, most=0.3, thin_share=0.5, extent=0.04):
    """From (sheet_id, x, n, y0, y1): thin (under half the peak) and low (up to 0.55 of the height) columns go at either end, within 8 % of
    the ink and 30 % of the width, if that takes two columns and 4 % of the width at least; the shares can be others."""
    own, w = Window.partitionBy("sheet_id"), Window.partitionBy("sheet_id").orderBy("x")
    inked = F.when(F.col("n") > 0, F.col("x"))
    t = cols.select(
        "*", F.min(inked).over(own).alias("a"), F.max(inked).over(own).alias("z"), F.sum("n").over(own).alias("total"), F.max("n").over(own).alias("peak"), (F.max("y1").over(own) - F.min("y0").over(own) + 1).alias("h"),
        F.sum("n").over(w).alias("l"), F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("r"),
    ).filter("x between a and z")
    width = F.col("z") - F.col("a") + 1
    thin = (F.col("n") < thin_share * F.col("peak")) & ((F.col("n") == 0) | (F.col("y1") - F.col("y0") + 1 <= 0.55 * F.col("h")))
    goes = lambda spent, far: thin & (spent <= area * F.col("total")) & (far < F.floor(width * most))
    b = t.groupBy("sheet_id").agg(
        F.first("a").alias("a"), F.first("z").alias("z"), F.min(F.when(~goes(F.col("l"), F.col("x") - F.col("a")), F.col("x"))).alias("lo"),
        F.max(F.when(~goes(F.col("r"), F.col("z") - F.col("x")), F.col("x"))).alias("hi"),
    )
    least = F.greatest(F.lit(2), S.half_up(width * extent))
    return b.select("sheet_id", F.when(F.col("lo") - F.col("a") < least, F.col("a")).otherwise(F.col("lo")).alias("x0"), F.when(F.col("z") - F.col("hi") < least, F.col("z")).otherwise(F.col("hi")).alias("x1"))
