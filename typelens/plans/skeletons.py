"""Skeletons of pages: distances, thinning, branches, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import skeleton as K
from ..operators import strokes as T
from ..sources.shipping import ship
from . import query
from .cells import page_rasters
from .sheets import _PAGE, DARK, SIDE

_REC = _PAGE.replace("WITH page_v", "WITH RECURSIVE page_v")
_PX = f", px AS (SELECT p.page AS sheet_id, g.x, g.y, coalesce(bool_or(q.opaque AND q.luma < {DARK}), false) AS ink FROM (SELECT DISTINCT page FROM page_v) p CROSS JOIN (SELECT i % {SIDE} AS x, i // {SIDE} AS y FROM range(0, {SIDE * SIDE}) t(i)) g LEFT JOIN page_v q ON q.page = p.page AND q.x = g.x AND q.y = g.y GROUP BY 1, 2, 3)"
_AT = "coalesce(b[i + {o}], false)"
_DIRS = (-SIDE, -SIDE + 1, 1, SIDE + 1, SIDE, SIDE - 1, -1, -SIDE - 1)


def _ring(name: str, i: str) -> list[str]:
    """The neighbours of pixel i (from 1) of a list, for pixels inside."""
    return [f"{name}[{i} + {o}]" if o >= 0 else f"{name}[{i} - {-o}]" for o in _DIRS]


def _peel(one: tuple, two: tuple) -> str:
    r = _ring("b", "i")
    n = " + ".join(f"{v}::INT" for v in r)
    turns = " + ".join(f"(NOT {r[k]} AND {r[(k + 1) % 8]})::INT" for k in range(8))
    free = " AND ".join("NOT (" + " AND ".join(r[k] for k in ks) + ")" for ks in (one, two))
    inner = f"(i - 1) % {SIDE} BETWEEN 1 AND {SIDE - 2} AND i BETWEEN {SIDE + 1} AND {SIDE * (SIDE - 1)}"
    return f"list_transform(range(1, {SIDE * SIDE + 1}), lambda i: CASE WHEN NOT b[i] THEN false WHEN NOT ({inner}) THEN true ELSE NOT (({n}) BETWEEN 2 AND 6 AND ({turns}) = 1 AND {free}) END)"


_THIN = _PX + f""", im AS (SELECT sheet_id, list(ink ORDER BY y, x) AS b FROM px GROUP BY 1),
th AS (SELECT sheet_id, b, false AS done, 0 AS t FROM im UNION ALL SELECT sheet_id, b, b = old, t + 1 FROM (SELECT sheet_id, {_peel((0, 2, 6), (0, 4, 6))} AS b, old, t FROM (SELECT sheet_id, {_peel((0, 2, 4), (2, 4, 6))} AS b, b AS old, t FROM th WHERE NOT done))),
sk AS (SELECT sheet_id, b FROM th WHERE done)"""


@query(_PAGE + _PX + " SELECT sheet_id, count(*) AS n, round(max(d), 4) AS most, round(sum(d), 3) AS total FROM (SELECT a.sheet_id, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)) + (sqrt(2) - 1) * least(abs(a.x - b.x), abs(a.y - b.y))) AS d FROM px a JOIN px b ON a.sheet_id = b.sheet_id WHERE a.ink AND NOT b.ink GROUP BY 1, 2, 3) GROUP BY 1")
def ink_distance(spark, d):
    """Per page the largest distance from the background and the sum of all."""
    ship(spark)
    s = K.skeletons(page_rasters(spark, d), smooth=False).select("sheet_id", F.filter("steps", lambda v: v > 0).alias("v")).filter("size(v) > 0")
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    return s.select("sheet_id", F.size("v").cast("long").alias("n"), F.round(F.array_max("v"), 4).alias("most"), F.round(total, 3).alias("total"))


@query(_REC + _THIN + f" SELECT sheet_id, (i - 1) % {SIDE} AS x, (i - 1) // {SIDE} AS y FROM (SELECT sheet_id, b, unnest(range(1, {SIDE * SIDE + 1})) AS i FROM sk) WHERE b[i]")
def thin_lines(spark, d):
    """The pixels that are left of each page's ink when it is thinned."""
    ship(spark)
    s = K.skeletons(page_rasters(spark, d), smooth=False).select("sheet_id", F.posexplode("skeleton").alias("i", "on"))
    return s.filter("on").select("sheet_id", (F.col("i") % SIDE).cast("long").alias("x"), F.expr(f"i div {SIDE}").alias("y"))


@query(_REC + _THIN + f""", s AS (SELECT sheet_id, (i - 1) % {SIDE} AS x, (i - 1) // {SIDE} AS y FROM (SELECT sheet_id, b, unnest(range(1, {SIDE * SIDE + 1})) AS i FROM sk) WHERE b[i]),
o AS (SELECT * FROM (VALUES (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)) v(k, dx, dy)),
r AS (SELECT s.sheet_id, s.x, s.y, o.k, q.x IS NOT NULL AS ink FROM s CROSS JOIN o LEFT JOIN s q ON q.sheet_id = s.sheet_id AND q.x = s.x + o.dx AND q.y = s.y + o.dy),
c AS (SELECT a.sheet_id, a.x, a.y, count(*) FILTER (WHERE a.ink) AS near, count(*) FILTER (WHERE NOT a.ink AND b.ink) AS leave FROM r a JOIN r b ON b.sheet_id = a.sheet_id AND b.x = a.x AND b.y = a.y AND b.k = (a.k + 1) % 8 GROUP BY 1, 2, 3)
SELECT sheet_id, leave AS branches, count(*) AS pixels, count(*) FILTER (WHERE near = 1) AS ends FROM c GROUP BY 1, 2""")
def skeleton_branches(spark, d):
    """Pixels of the thinned pages by the number of lines that leave them, and how many of them are ends (one neighbour)."""
    ship(spark)
    s = K.skeletons(page_rasters(spark, d), smooth=False)
    on = lambda i, dx, dy: F.when((i % SIDE + dx >= 0) & (i % SIDE + dx < SIDE), F.coalesce(F.get("skeleton", i + dx + SIDE * dy), F.lit(False))).otherwise(False)
    around = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    near = lambda i: sum((on(i, *p).cast("int") for p in around), F.lit(0))
    each = s.select("sheet_id", "skeleton", F.posexplode("branch").alias("i", "branches")).filter(F.get("skeleton", F.col("i")))
    each = each.select("sheet_id", "branches", near(F.col("i")).alias("near"))
    return each.groupBy("sheet_id", "branches").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("near") == 1).alias("ends"))


@query(None)
def page_strokes(spark, d):
    """What a pen would draw along the skeletons of pages: per stroke its length and the points that it needs."""
    ship(spark)
    s = T.strokes_of(page_rasters(spark, d))
    return s.select("sheet_id", "stroke", "closed", F.round("length", 3).alias("length"), F.size("xs").cast("long").alias("points"), F.regexp_count("path", F.lit("C")).cast("long").alias("curves"))
