"""Colours of pages and glyphs. A page's ink has one of three colours by its cell; a glyph's is one by its pixels' place; paper is nearly white."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import palette as P
from ..sources.bindings import pixels, sql
from ..sources.shipping import ship
from . import query
from .raster import _COMP as _PARTS
from .raster import _FOUR
from .sheets import _PAGE, DARK, SIDE, page_pixels

INKS = ((200, 40, 40), (40, 60, 190), (30, 30, 34))
_INK = lambda c: f"CASE (x // 8 + y // 8) % 3 WHEN 0 THEN {INKS[0][c]} WHEN 1 THEN {INKS[1][c]} ELSE {INKS[2][c]} END + luma % 5"
_RGB = _PAGE + f", px AS (SELECT page AS sheet_id, x, y, luma, {', '.join(f'CASE WHEN luma < {DARK} THEN {_INK(c)} ELSE {w} - luma % 4 END AS {n}' for c, (n, w) in enumerate(zip('rgb', (250, 248, 244))))} FROM page_v WHERE opaque)"
_PAPER = f""", edge AS (SELECT *, (y = 0)::INT + (y = {SIDE - 1})::INT + (x = 0)::INT + (x = {SIDE - 1})::INT AS n, least(CASE WHEN y = 0 THEN 2 * x END, CASE WHEN y = {SIDE - 1} THEN 2 * x + 1 END, CASE WHEN x = 0 THEN 2 * ({SIDE} + y) END, CASE WHEN x = {SIDE - 1} THEN 2 * ({SIDE} + y) + 1 END) AS met FROM px),
bk AS (SELECT sheet_id, r // 16 AS i, g // 16 AS j, b // 16 AS k, sum(n) AS n, min(met) AS met, floor(sum(r * n) / sum(n) + 0.5) AS r, floor(sum(g * n) / sum(n) + 0.5) AS g, floor(sum(b * n) / sum(n) + 0.5) AS b FROM edge WHERE n > 0 GROUP BY 1, 2, 3, 4),
paper AS (SELECT sheet_id, CAST(r AS BIGINT) AS br, CAST(g AS BIGINT) AS bg, CAST(b AS BIGINT) AS bb FROM bk QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, met) = 1)"""


def _lab(r: str, g: str, b: str) -> list[str]:
    lin = [f"CASE WHEN {c} / 255.0e0 <= 0.04045e0 THEN {c} / 255.0e0 / 12.92e0 ELSE pow(({c} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END" for c in (r, g, b)]
    f = []
    for row, w in zip(C.XYZ, C.WHITE):
        t = "((" + " + ".join(f"{k}e0 * ({v})" for k, v in zip(row, lin)) + f") / {w}e0)"
        f.append(f"(CASE WHEN {t} > {216 / 24389}e0 THEN pow({t}, {1 / 3}e0) ELSE ({24389 / 27}e0 * {t} + 16) / 116 END)")
    return [f"116 * {f[1]} - 16", f"500 * ({f[0]} - {f[1]})", f"200 * ({f[1]} - {f[2]})"]


def _measured(px: str) -> str:
    own, white = _lab("r", "g", "b"), _lab("br", "bg", "bb")
    cols = ", ".join(f"{e} AS {n}" for e, n in zip([*own, *white], ("l", "a", "v", "pl", "pa", "pv")))
    return f"(SELECT *, (l - pl) * (l - pl) + (a - pa) * (a - pa) + (v - pv) * (v - pv) AS d2 FROM (SELECT *, {cols} FROM {px}))"


_COLOURED = "d2 > 400 AND NOT (sqrt(a * a + v * v) < 6 AND d2 < 1600)"


def page_colours(spark, d):
    x, y, luma = F.col("x"), F.col("y"), F.col("luma")
    cell = (F.floor(x / 8) + F.floor(y / 8)) % 3
    ink = lambda c: F.element_at(F.array(*[F.lit(i[c]) for i in INKS]), (cell + 1).cast("int")) + luma % 5
    white = (250, 248, 244)
    p = page_pixels(spark, d).filter("opaque")
    return p.select(
        F.col("page").alias("sheet_id"), F.lit(SIDE).cast("long").alias("width"), F.lit(SIDE).cast("long").alias("height"), "x", "y", *[F.when(luma < DARK, ink(c)).otherwise(white[c] - luma % 4).cast("long").alias(n) for c, n in enumerate("rgb")]
    )


@query(_RGB + _PAPER + " SELECT * FROM paper")
def sheet_paper(spark, d):
    """The colour of a page's paper, from its border."""
    return P.background(page_colours(spark, d))


@query(_RGB + _PAPER + f" SELECT sheet_id, count(*) AS n, count(*) FILTER (WHERE d2 > 400) AS ink, count(*) FILTER (WHERE {_COLOURED}) AS coloured FROM {_measured('px JOIN paper USING (sheet_id)')} GROUP BY 1")
def ink_union(spark, d):
    """Pixels of a page that are ink by their distance from the paper, and those that are no grey halo."""
    px = page_colours(spark, d)
    m = P.measured(px, P.background(px))
    return m.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(P.inked()).alias("ink"), F.count_if(P.coloured()).alias("coloured"))


@query(None)
def sheet_palettes(spark, d):
    """The inks of pages, by the number of their pixels."""
    ship(spark)
    return P.palettes(page_colours(spark, d), 4)


@query(None)
def sheet_shadows(spark, d):
    """Whether the darkest grey ink of a page is the shadow of the others."""
    ship(spark)
    px = page_colours(spark, d)
    return P.shadows(px, P.palettes(px, 4)).select("sheet_id", "paired", F.round("score", 6).alias("score"), "shadow")


GLYPH_INKS = ((60.0, 60.0, 40.0), (40.0, 20.0, -60.0))
CHARS = "Hiou8"


def glyph_pixels(spark, d):
    """Glyphs of two inks: their colour by diagonals, shaded by the values."""
    p = pixels(spark, d)
    shade = F.floor(F.col("value") * 40)
    first = (F.col("x") + F.col("y")) % 5 < 3
    col = lambda a, b, w: F.when(F.col("value") > -0.05, F.when(first, a).otherwise(b) + shade).otherwise(w).cast("long")
    ch = F.substring(F.lit(CHARS), (F.col("sheet_id") % len(CHARS)).cast("int") + 1, F.lit(1))
    eight = F.lit(8).cast("long")
    return p.select("sheet_id", (F.col("sheet_id") % 2).alias("face"), ch.alias("ch"), eight.alias("width"), eight.alias("height"), "x", "y", col(220, 60, 250).alias("r"), col(90, 70, 250).alias("g"), col(80, 200, 250).alias("b"), *[F.lit(250).cast("long").alias(c) for c in ("br", "bg", "bb")])


def _glyph(a: int, b: int) -> str:
    return f"CAST(CASE WHEN value > -0.05e0 THEN CASE WHEN (x + y) % 5 < 3 THEN {a} ELSE {b} END + floor(value * 40) ELSE 250 END AS BIGINT)"


_D = [f"(l - {c[0]}e0) * (l - {c[0]}e0) + (a - {c[1]}e0) * (a - {c[1]}e0) + (v - ({c[2]}e0)) * (v - ({c[2]}e0))" for c in GLYPH_INKS]
_LAYERS = f""", gp AS (SELECT sheet_id, substr('{CHARS}', CAST(sheet_id % {len(CHARS)} AS INT) + 1, 1) AS ch, x, y, {_glyph(220, 60)} AS r, {_glyph(90, 70)} AS g, {_glyph(80, 200)} AS b, 250 AS br, 250 AS bg, 250 AS bb FROM pixels_v),
ink AS (SELECT sheet_id, ch, x, y, y * 8 + x AS p, CASE WHEN {_D[0]} <= {_D[1]} THEN 0 ELSE 1 END AS place FROM {_measured('gp')} WHERE {_COLOURED})""" + _PARTS[_PARTS.index("\nreach"):].replace("\nreach", ",\nreach").format(near=_FOUR) + f""",
ar AS (SELECT sheet_id, root, count(*) AS area FROM root GROUP BY 1, 2), mx AS (SELECT sheet_id, max(area) AS largest, arg_max(root, (area, -root)) AS main FROM ar GROUP BY 1),
al AS (SELECT i.*, a.area, m.largest, regexp_matches(i.ch, '^[A-Za-z0-9]$') AND NOT contains('ij', i.ch) AND a.root <> m.main AND a.area < 0.5 * m.largest AS island FROM ink i JOIN root r USING (sheet_id, p) JOIN ar a USING (sheet_id, root) JOIN mx m USING (sheet_id)),
lg AS (SELECT *, bool_or(island) OVER (PARTITION BY sheet_id) AS stray FROM al WHERE area >= greatest(12, 0.03 * largest)), ly AS (SELECT * FROM lg WHERE NOT island),
wd AS (SELECT DISTINCT l.sheet_id, l.place, q.x, q.y FROM ly l JOIN (SELECT i % 8 AS x, i // 8 AS y FROM range(0, 64) t(i)) q ON abs(q.x - l.x) <= 1 AND abs(q.y - l.y) <= 1)
SELECT l.sheet_id, CAST(l.place AS BIGINT) AS place, l.ink, w.spread, stray FROM (SELECT sheet_id, place, count(*) AS ink, bool_or(stray) AS stray FROM ly GROUP BY 1, 2) l JOIN (SELECT sheet_id, place, count(*) AS spread FROM wd GROUP BY 1, 2) w ON w.sheet_id = l.sheet_id AND w.place = l.place"""


@query(sql(_LAYERS, "pixels_v", recursive=True))
def colour_layers(spark, d):
    """The layers of glyphs by colour: a layer's ink, its ink with a pixel around it, and whether islands went."""
    ship(spark)
    inks = spark.range(2).select(F.col("id").alias("face"), F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "lav")]) for c in GLYPH_INKS]).alias("centres"))
    l = P.layers(glyph_pixels(spark, d), inks)  # noqa: E741
    wide = P.spread(l.select("sheet_id", "place", "x", "y"), ["sheet_id", "place"], 8, 8).groupBy("sheet_id", "place").agg(F.count(F.lit(1)).alias("spread"))
    return l.groupBy("sheet_id", "place").agg(F.count(F.lit(1)).alias("ink"), F.max("stray").alias("stray")).join(wide, ["sheet_id", "place"]).select("sheet_id", "place", "ink", "spread", "stray")
