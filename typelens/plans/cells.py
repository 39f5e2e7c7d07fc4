"""Rows of pages cut into cells: components, ownership, the choice among ways to cut, glyphs. Pages are those of ``sheets``; a row is a fifth of a page's ink."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import marks as M
from ..operators import palette as P
from ..operators import slicing as C
from ..operators.skeleton import slices
from ..sources.bindings import table
from ..sources.shipping import settle, ship
from . import query
from .sheets import _EVEN, DARK, SIDE, _luma, banded, page_pixels

#: What is written in the rows of a page, from the first.
TEXTS = ("Hnou", "il", "#!?", "áčé", "wxyzwxyz")


def page_rasters(spark, d):
    """One row per page: ink in reading order, put together from its vectors; a missing vector has none."""
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 64").alias("page"), F.col("vec_id"), "embedding")
    ship(spark)
    ink = F.transform("embedding", lambda z: (F.col("vec_id") % 13 != 12) & (_luma(z, F.col("page")) < DARK))
    g = v.groupBy(F.col("page").alias("sheet_id")).agg(F.collect_list(F.struct((F.col("vec_id") % 64).alias("k"), ink.alias("bits"))).alias("parts"))

    def run(batches):
        for part in slices(batches):
            out = []
            for parts in part.column(1).to_pylist():
                ink = np.zeros((8, 8, 8, 8), bool)  # cell row, line, cell column, column
                for p in parts:
                    ink[p["k"] // 8, :, p["k"] % 8] = np.asarray(p["bits"]).reshape(8, 8)
                out.append(ink.ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([SIDE] * len(out), pa.int64()), pa.array(out, pa.list_(pa.bool_()))], ["sheet_id", "width", "ink"])

    return g.mapInArrow(run, "sheet_id long, width long, ink array<boolean>")


def page_rows(spark, d):
    ship(spark)
    bands = banded(page_pixels(spark, d), len(TEXTS)).select(F.col("page").alias("sheet_id"), F.col("band").alias("row"), F.col("start").alias("y0"), F.col("stop").alias("y1"))
    bands = bands.withColumn("chars", F.get(F.array(*map(F.lit, TEXTS)), F.col("row").cast("int")))
    return settle(C.rows_of(page_rasters(spark, d), bands))


_ROW = _EVEN.replace("WITH page_v", "WITH RECURSIVE page_v") + f""", line_v AS (SELECT page AS sheet_id, band AS row, start AS y0, stop AS y1, {list(TEXTS)}[band + 1] AS chars, length({list(TEXTS)}[band + 1]) AS expected FROM bands),
ink AS (SELECT l.*, p.x, p.y FROM line_v l JOIN page_v p ON p.page = l.sheet_id AND p.y >= l.y0 AND p.y < l.y1 WHERE p.opaque AND p.luma < {DARK})"""
_PROFILE = f""", cols AS (SELECT l.*, t.x, coalesce(n, 0) AS n FROM line_v l CROSS JOIN range(0, {SIDE}) t(x) LEFT JOIN (SELECT sheet_id, row, x, count(*) AS n FROM ink GROUP BY ALL) i ON i.sheet_id = l.sheet_id AND i.row = l.row AND i.x = t.x),
span AS (SELECT sheet_id, row, any_value(expected) AS expected, coalesce(min(x) FILTER (WHERE n > 0), 0) AS a, coalesce(max(x) FILTER (WHERE n > 0) + 1, {SIDE}) AS b FROM cols GROUP BY 1, 2),
want AS (SELECT *, (b - a) / expected AS p, CAST(floor(a + k * ((b - a) / expected) + 0.5) AS BIGINT) AS mid FROM span, range(1, 99) t(k) WHERE k < expected),
win AS (SELECT *, greatest(a, CAST(floor(mid - 0.35e0 * p + 0.5) AS BIGINT)) AS lo, least(b, CAST(floor(mid + 0.35e0 * p + 0.5) AS BIGINT)) AS hi FROM want),
cuts AS (SELECT w.sheet_id, w.row, w.k, coalesce(arg_min(c.x, {{'n': c.n, 'x': c.x}}), any_value(w.mid)) AS cut FROM win w LEFT JOIN cols c ON c.sheet_id = w.sheet_id AND c.row = w.row AND c.x >= w.lo AND c.x < w.hi GROUP BY 1, 2, 3
UNION ALL SELECT sheet_id, row, 0, a FROM span UNION ALL SELECT sheet_id, row, expected, b FROM span),
anch AS (SELECT * FROM (SELECT sheet_id, row, k AS cell, cut AS x0, lead(cut) OVER (PARTITION BY sheet_id, row ORDER BY k) AS x1 FROM cuts) WHERE x1 IS NOT NULL)"""
_PARTS = """, seg AS (SELECT sheet_id, row, y, min(x) AS x0, max(x) + 1 AS x1, sum(x) AS sx, y * 64 + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY sheet_id, row, y ORDER BY x) AS g FROM ink) GROUP BY sheet_id, row, y, g),
touch AS (SELECT a.sheet_id, a.row, a.id AS p, b.id AS q FROM seg a JOIN seg b ON a.sheet_id = b.sheet_id AND a.row = b.row AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 AND b.x0 < a.x1),
reach AS (SELECT sheet_id, row, id AS p, id AS q FROM seg UNION SELECT r.sheet_id, r.row, r.p, t.q FROM reach r JOIN touch t ON t.sheet_id = r.sheet_id AND t.row = r.row AND t.p = r.q),
root AS (SELECT sheet_id, row, p AS id, min(q) AS root FROM reach GROUP BY 1, 2, 3),
parts AS (SELECT sheet_id, row, root, min(x0) AS x0, max(x1) AS x1, min(y) AS py0, max(y) + 1 AS py1, sum(x1 - x0) AS area, sum(sx) / sum(x1 - x0) AS centroid FROM seg JOIN root USING (sheet_id, row, id) GROUP BY 1, 2, 3)"""
_BY_PARTS = _PARTS + """, c0 AS (SELECT parts.*, y0, y1, expected AS n, count(*) OVER w AS total, row_number() OVER (w ORDER BY x0, root) - 1 AS k_left, row_number() OVER (w ORDER BY centroid, x0, root) AS k,
    (max(x1) OVER w - min(x0) OVER w) / expected AS pitch, py1 - py0 >= (y1 - y0) * 0.4e0 AS tall FROM parts JOIN line_v USING (sheet_id, row) WHERE area >= 2 WINDOW w AS (PARTITION BY sheet_id, row)),
c1 AS (SELECT *, lead(x0) OVER w - x1 AS gap, lead(centroid) OVER w - centroid < pitch * 0.4e0 AS near, tall AND lead(tall) OVER w AS both_tall FROM c0 WINDOW w AS (PARTITION BY sheet_id, row ORDER BY k)),
c2 AS (SELECT *, CASE WHEN gap IS NULL OR near THEN 'no' WHEN both_tall THEN 'must' ELSE 'may' END AS kind FROM c1),
c3 AS (SELECT *, count(*) FILTER (WHERE kind = 'must') OVER (PARTITION BY sheet_id, row) AS musts, row_number() OVER (PARTITION BY sheet_id, row, kind ORDER BY gap DESC NULLS LAST, k) AS rank FROM c2),
c4 AS (SELECT *, (kind <> 'no' AND rank <= CASE WHEN kind = 'must' THEN n - 1 ELSE n - 1 - musts END)::BIGINT AS cut FROM c3),
by_parts AS (SELECT *, CASE WHEN total <= n THEN k_left ELSE coalesce(sum(cut) OVER (PARTITION BY sheet_id, row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS cell FROM c4),
part_cells AS (SELECT sheet_id, row, cell, min(x0) AS x0, max(x1) AS x1, sum(area) AS area FROM by_parts GROUP BY 1, 2, 3)"""
# cells of the components (sorted by centroid) of a row: an empty cell takes the first group of the next, else the last group of the one before
_TAKE = """CASE WHEN list_contains(cs, i) THEN NULL ELSE list_filter(range(2, len(ms) + 1), lambda j: cs[j] = i + 1 AND cs[j - 1] = i + 1 AND ms[j] - ms[j - 1] > ps[i + 2] * 0.25e0)[1] END"""
_GIVE = """CASE WHEN list_contains(cs, i) OR i = 0 THEN NULL ELSE list_filter(range(2, len(ms) + 1), lambda j: cs[j] = i - 1 AND cs[j - 1] = i - 1 AND ms[j] - ms[j - 1] > ps[i] * 0.25e0)[-1] END"""
_OWN = _PROFILE + _PARTS + f""", homes AS (SELECT p.sheet_id, p.row, p.root, p.centroid, p.x0, p.x1, p.area, a.cell FROM parts p JOIN anch a ON a.sheet_id = p.sheet_id AND a.row = p.row AND p.centroid >= a.x0 AND p.centroid < a.x1 WHERE p.area >= 2),
start_v AS (SELECT sheet_id, row, list(root ORDER BY centroid, root) AS rs, list(centroid ORDER BY centroid, root) AS ms, list(cell ORDER BY centroid, root) AS cs FROM homes GROUP BY 1, 2),
width_v AS (SELECT sheet_id, row, count(*) AS n, list(x1 - x0 ORDER BY cell) AS ps FROM anch GROUP BY 1, 2),
step_v AS (SELECT s.sheet_id, s.row, rs, ms, cs, n, ps, CAST(0 AS BIGINT) AS t FROM start_v s JOIN width_v USING (sheet_id, row)
UNION ALL SELECT sheet_id, row, rs, ms, CASE WHEN take IS NOT NULL THEN list_transform(range(1, len(cs) + 1), lambda j: CASE WHEN cs[j] = i + 1 AND j < take THEN i ELSE cs[j] END)
    WHEN give IS NOT NULL THEN list_transform(range(1, len(cs) + 1), lambda j: CASE WHEN cs[j] = i - 1 AND j >= give THEN i ELSE cs[j] END) ELSE cs END, n, ps, t + 1
FROM (SELECT *, {_TAKE} AS take, {_GIVE} AS give FROM (SELECT *, t % n AS i FROM step_v WHERE t < n * (n + 1)))),
by_place AS (SELECT h.* EXCLUDE (cell), u.cell FROM (SELECT sheet_id, row, unnest(rs) AS root, unnest(cs) AS cell FROM step_v WHERE t = n * (n + 1)) u JOIN homes h USING (sheet_id, row, root)),
own_cells AS (SELECT a.sheet_id, a.row, a.cell, coalesce(min(b.x0), any_value(a.x0)) AS x0, coalesce(max(b.x1), any_value(a.x1)) AS x1, CAST(coalesce(sum(b.area), 0) AS BIGINT) AS area FROM anch a LEFT JOIN by_place b ON b.sheet_id = a.sheet_id AND b.row = a.row AND b.cell = a.cell GROUP BY 1, 2, 3)"""


@query(_ROW + _PROFILE + " SELECT sheet_id, row, CAST(cell AS BIGINT) AS cell, x0, x1 FROM anch")
def anchored_cells(spark, d):
    """Cells of an even pitch over a row's ink, cut where columns have least ink."""
    rows = page_rows(spark, d)
    r = C.anchored(C.profile(rows), C.count_of(F.col("chars")))
    return r.select("sheet_id", "row", F.posexplode("ranges").alias("cell", "r")).select("sheet_id", "row", F.col("cell").cast("long").alias("cell"), "r.x0", "r.x1")


@query(_ROW + _BY_PARTS + " SELECT sheet_id, row, CAST(cell AS BIGINT) AS cell, x0, x1, CAST(area AS BIGINT) AS area FROM part_cells")
def component_cells(spark, d):
    """Cells made of whole components: their columns may overlap."""
    rows = page_rows(spark, d)
    c = C.component_cells(C.components(rows), rows, C.count_of(F.col("chars")))
    return c.groupBy("sheet_id", "row", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("area").alias("area"))


@query(_ROW + _OWN + " SELECT sheet_id, row, CAST(cell AS BIGINT) AS cell, x0, x1, area FROM own_cells")
def owned_cells(spark, d):
    """Cells of an even pitch that own the components whose centroids they have, or a group of a neighbour's; bounded by what they own."""
    rows = page_rows(spark, d)
    ranged = C.anchored(C.profile(rows), C.count_of(F.col("chars")))
    own = C.owned_components(C.components(rows), ranged)
    area = own.groupBy("sheet_id", "row", "cell").agg(F.sum("area").alias("area"))
    return C.owned_cells(own, ranged).join(area, ["sheet_id", "row", "cell"], "left").na.fill(0, "area")


@query(_ROW + _OWN + """, mine AS (SELECT b.sheet_id, b.row, b.root, b.cell FROM by_place b), owner AS (SELECT s.sheet_id, s.row, s.y, s.x0, s.x1, coalesce(m.cell, -1) AS cell FROM seg s JOIN root r USING (sheet_id, row, id) LEFT JOIN mine m ON m.sheet_id = s.sheet_id AND m.row = s.row AND m.root = r.root)
SELECT c.sheet_id, c.row, CAST(c.cell AS BIGINT) AS cell, c.x1 - c.x0 AS width, CAST(coalesce(sum(greatest(0, least(o.x1, c.x1) - greatest(o.x0, c.x0))) FILTER (WHERE o.cell IN (-1, c.cell)), 0) AS BIGINT) AS ink,
CAST(coalesce(sum(greatest(0, least(o.x1, c.x1) - greatest(o.x0, c.x0))) FILTER (WHERE o.cell NOT IN (-1, c.cell)), 0) AS BIGINT) AS erased FROM own_cells c LEFT JOIN owner o ON o.sheet_id = c.sheet_id AND o.row = c.row GROUP BY c.sheet_id, c.row, c.cell, c.x0, c.x1""")
def cell_ink(spark, d):
    """The ink that each cell keeps in its columns, and that of other cells which is erased there; specks belong to whoever has them."""
    rows = page_rows(spark, d)
    comps, ranged = C.components(rows), C.anchored(C.profile(rows), C.count_of(F.col("chars")))
    own = C.owned_components(comps, ranged)
    owner = comps.join(own.select("sheet_id", "row", "component", F.col("cell").alias("owner")), ["sheet_id", "row", "component"], "left").select("sheet_id", "row", "owner", "spots")
    cells = C.owned_cells(own, ranged).join(owner, ["sheet_id", "row"], "left")
    inside = F.size(F.filter("spots", lambda p: (p % SIDE >= F.col("x0")) & (p % SIDE < F.col("x1")))).cast("long")
    keep = F.coalesce((F.col("owner") == F.col("cell")) | F.col("owner").isNull(), F.lit(True))
    n = F.when(F.col("spots").isNotNull(), inside).otherwise(0)
    return cells.groupBy("sheet_id", "row", "cell", "x0", "x1").agg(F.sum(F.when(keep, n).otherwise(0)).alias("ink"), F.sum(F.when(~keep, n).otherwise(0)).alias("erased")).select(
        "sheet_id", "row", "cell", (F.col("x1") - F.col("x0")).alias("width"), "ink", "erased"
    )


_RUNS = f""", page_ink AS (SELECT page AS sheet_id, x, y FROM page_v WHERE opaque AND luma < {DARK}),
wsr AS (SELECT sheet_id, row, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY sheet_id, row ORDER BY x) AS g FROM cols WHERE n > 0) GROUP BY sheet_id, row, g),
inside AS (SELECT w.sheet_id, w.row, w.x0, w.x1, any_value(i.y0) AS y0, any_value(i.y1) AS y1, min(i.y) AS top, max(i.y) AS bottom FROM wsr w JOIN ink i ON i.sheet_id = w.sheet_id AND i.row = w.row AND i.x >= w.x0 AND i.x < w.x1 GROUP BY 1, 2, 3, 4),
over AS (SELECT DISTINCT n.sheet_id, n.row, n.x0, p.y < n.y0 AS head FROM inside n JOIN page_ink i ON i.sheet_id = n.sheet_id AND i.x >= n.x0 AND i.x < n.x1 AND i.y IN (n.y0, n.y1 - 1)
    JOIN page_ink p ON p.sheet_id = i.sheet_id AND abs(p.x - i.x) <= 1 AND ((i.y = n.y0 AND p.y = n.y0 - 1) OR (i.y = n.y1 - 1 AND p.y = n.y1))),
runs AS (SELECT n.sheet_id, n.row, n.x0, n.x1, coalesce(bool_or((o.head AND n.bottom < n.y0 + (n.y1 - n.y0) * 0.25e0) OR (NOT o.head AND n.top > n.y1 - (n.y1 - n.y0) * 0.25e0)), false) AS alien FROM inside n LEFT JOIN over o ON o.sheet_id = n.sheet_id AND o.row = n.row AND o.x0 = n.x0 GROUP BY 1, 2, 3, 4)"""
_WAYS = _OWN + _BY_PARTS.removeprefix(_PARTS) + _RUNS + r""", tidy AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY sheet_id, row ORDER BY x0) AS gap, count(*) OVER (PARTITION BY sheet_id, row) AS k FROM runs WHERE NOT alien),
tidy_m AS (SELECT sheet_id, row, coalesce(list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[count(gap) // 2 + 1], 1) AS m FROM tidy GROUP BY 1, 2),
clean AS (SELECT sheet_id, row, min(x0) AS x0, max(x1) AS x1 FROM (SELECT t.*, sum((gap IS NULL OR k < 3 OR gap >= 0.35e0 * greatest(m, 1))::BIGINT) OVER (PARTITION BY t.sheet_id, t.row ORDER BY x0) AS s FROM tidy t JOIN tidy_m USING (sheet_id, row)) GROUP BY sheet_id, row, s),
gap_v AS (SELECT r.*, l.y0, l.y1, l.expected, lead(x0) OVER w - x1 AS gap, lead(x0) OVER w AS nxt, count(*) OVER (PARTITION BY sheet_id, row) AS k FROM runs r JOIN line_v l USING (sheet_id, row) WINDOW w AS (PARTITION BY sheet_id, row ORDER BY x0)),
gap_r AS (SELECT *, gap IS NOT NULL AND row_number() OVER (PARTITION BY sheet_id, row ORDER BY gap DESC NULLS LAST, x0) < expected AS cut FROM gap_v WHERE k > expected),
gap_e AS (SELECT sheet_id, row, list_concat([min(x0)], list_sort(coalesce(list(CAST(floor((x1 + nxt) / 2 + 0.5) AS BIGINT)) FILTER (WHERE cut), [])), [max(x1)]) AS e FROM gap_r GROUP BY 1, 2 HAVING count(*) FILTER (WHERE cut AND gap < greatest(2, (y1 - y0) * 0.08e0)) = 0),
ways AS (SELECT sheet_id, row, 'anchored' AS way, cell, x0, x1 FROM anch UNION ALL SELECT sheet_id, row, 'ownership', cell, x0, x1 FROM own_cells UNION ALL SELECT sheet_id, row, 'components', cell, x0, x1 FROM part_cells
UNION ALL SELECT sheet_id, row, 'whitespace', row_number() OVER (PARTITION BY sheet_id, row ORDER BY x0) - 1, x0, x1 FROM runs UNION ALL SELECT sheet_id, row, 'clean', row_number() OVER (PARTITION BY sheet_id, row ORDER BY x0) - 1, x0, x1 FROM clean SEMI JOIN (SELECT sheet_id, row FROM runs WHERE alien) USING (sheet_id, row)
UNION ALL SELECT sheet_id, row, 'gaps', i - 1, e[i], e[i + 1] FROM (SELECT *, unnest(range(1, len(e))) AS i FROM gap_e)),
count_v AS (SELECT l.sheet_id, l.row, l.expected AS e, regexp_matches(chars, '[^\p{L}\p{N} ]') AS sym, strip_accents(chars) <> chars AS acc, count(*) FILTER (WHERE way = 'gaps') AS ga, count(*) FILTER (WHERE way = 'whitespace') AS ws, count(*) FILTER (WHERE way = 'clean') AS cl,
    count(*) FILTER (WHERE way = 'components') AS co, count(*) FILTER (WHERE way = 'ownership') AS ow FROM line_v l LEFT JOIN ways USING (sheet_id, row) GROUP BY ALL),
pick0 AS (SELECT *, CASE WHEN acc AND ga > 0 THEN 'gaps' WHEN sym THEN CASE WHEN co = e THEN 'components' WHEN ow = e THEN 'ownership' ELSE 'anchored' END WHEN ws = e THEN 'whitespace' WHEN ws > e AND cl = e THEN 'clean' WHEN co = e THEN 'components' WHEN ws > e AND ow = e THEN 'ownership' ELSE 'anchored' END AS way FROM count_v),
pick AS (SELECT *, way = 'anchored' OR (way = 'ownership' AND NOT sym) AS forced FROM pick0)"""


@query(_ROW + _PROFILE + _RUNS + " SELECT * FROM runs")
def row_fragments(spark, d):
    """Runs of columns in a row; shallow ones that go on in the row above or below are marked."""
    return C.runs(page_rows(spark, d))


@query(_ROW + _WAYS + """ SELECT p.sheet_id, p.row, CAST(w.cell AS BIGINT) AS cell, w.x0, w.x1, CASE WHEN p.way IN ('gaps', 'clean') THEN 'whitespace' ELSE p.way END AS slicer, forced,
CASE WHEN forced AND sym THEN greatest(co, ow) WHEN forced THEN ws ELSE e END AS natural FROM pick p JOIN ways w ON w.sheet_id = p.sheet_id AND w.row = p.row AND w.way = p.way""")
def row_cells(spark, d):
    """The cells of each row by the first of five ways that finds as many as its text has characters, and whether that had to be forced."""
    rows = page_rows(spark, d)
    cells, _ = C.candidates(rows)
    return cells.withColumnRenamed("slicer", "way").join(C.chosen(rows, cells), ["sheet_id", "row", "way"]).select("sheet_id", "row", "cell", "x0", "x1", "slicer", "forced", "natural")


_GLYPHS = _WAYS + f""", owns AS (SELECT 'components' AS way, sheet_id, row, root, cell FROM by_parts UNION ALL SELECT 'ownership', sheet_id, row, root, cell FROM by_place),
spot AS (SELECT i.sheet_id, i.row, i.x, i.y, coalesce(o.cell, -1) AS owner FROM ink i JOIN pick p ON p.sheet_id = i.sheet_id AND p.row = i.row JOIN seg s ON s.sheet_id = i.sheet_id AND s.row = i.row AND s.y = i.y AND i.x >= s.x0 AND i.x < s.x1
    JOIN root r ON r.sheet_id = s.sheet_id AND r.row = s.row AND r.id = s.id LEFT JOIN owns o ON o.way = p.way AND o.sheet_id = r.sheet_id AND o.row = r.row AND o.root = r.root),
cell_v AS (SELECT l.sheet_id, l.row, w.cell, l.y0, l.y1, l.y1 - l.y0 AS h, greatest(0, w.x0 - 2) AS x0, least({SIDE}, w.x1 + 2) AS x1 FROM pick p JOIN ways w ON w.sheet_id = p.sheet_id AND w.row = p.row AND w.way = p.way JOIN line_v l ON l.sheet_id = p.sheet_id AND l.row = p.row WHERE w.x1 > w.x0 AND w.cell < l.expected),
near AS (SELECT c.sheet_id, c.row, c.cell, c.y0, c.y1, c.x0, c.x1, i.x, i.y, i.y >= c.y0 AND i.y < c.y1 AS band, i.y >= c.y0 - ceil(c.h * 0.4e0) AND i.y < c.y1 + ceil(c.h * 0.4e0) AS reachable, i.x >= c.x0 AND i.x < c.x1 AS col, i.y >= ceil(c.y0 + c.h * 0.25e0) AND i.y < c.y0 + c.h * 0.75e0 AS mid,
    coalesce(s.owner, -1) IN (-1, c.cell) AS free FROM cell_v c JOIN page_ink i ON i.sheet_id = c.sheet_id AND i.x >= c.x0 - 1 AND i.x <= c.x1 AND i.y >= c.y0 - ceil(c.h * 0.4e0) - 3 AND i.y < c.y1 + ceil(c.h * 0.4e0) + 3 LEFT JOIN spot s ON s.sheet_id = i.sheet_id AND s.row = c.row AND s.x = i.x AND s.y = i.y),
crosses AS (SELECT DISTINCT a.sheet_id, a.row, a.cell FROM near a JOIN near b ON a.sheet_id = b.sheet_id AND a.row = b.row AND a.cell = b.cell AND abs(a.x - b.x) <= 1 AND a.col AND b.col AND ((a.y = a.y0 AND b.y = a.y0 - 1) OR (a.y = a.y1 - 1 AND b.y = a.y1))),
flow AS (SELECT n.sheet_id, n.row, n.cell, n.x, n.y FROM near n JOIN crosses USING (sheet_id, row, cell) WHERE mid AND free AND col
    UNION SELECT n.sheet_id, n.row, n.cell, n.x, n.y FROM flow f JOIN near n ON n.sheet_id = f.sheet_id AND n.row = f.row AND n.cell = f.cell AND abs(n.x - f.x) <= 1 AND abs(n.y - f.y) <= 1 WHERE n.free AND n.col AND n.reachable),
ext AS (SELECT c.sheet_id, c.row, c.cell, c.x0, c.x1, c.y0, c.y1, least(c.y0, coalesce(min(f.y), c.y0)) AS top, greatest(c.y1, coalesce(max(f.y) + 1, c.y1)) AS bottom FROM cell_v c LEFT JOIN flow f ON f.sheet_id = c.sheet_id AND f.row = c.row AND f.cell = c.cell GROUP BY c.sheet_id, c.row, c.cell, c.x0, c.x1, c.y0, c.y1),
joined AS (SELECT f.* FROM flow f JOIN ext e USING (sheet_id, row, cell) WHERE e.top < e.y0 OR e.bottom > e.y1),
may AS (SELECT DISTINCT n.sheet_id, n.row, n.cell, n.x, n.y, n.col FROM near n JOIN ext e USING (sheet_id, row, cell) LEFT JOIN joined j ON j.sheet_id = n.sheet_id AND j.row = n.row AND j.cell = n.cell AND abs(j.x - n.x) <= 1 AND abs(j.y - n.y) <= 1
    WHERE n.y >= e.top AND n.y < e.bottom AND ((n.band AND n.free) OR (NOT n.band AND j.x IS NOT NULL))),
fringe AS (SELECT DISTINCT n.sheet_id, n.row, n.cell, n.x, n.y, n.col FROM near n JOIN ext e USING (sheet_id, row, cell) JOIN may m ON m.sheet_id = n.sheet_id AND m.row = n.row AND m.cell = n.cell AND abs(m.x - n.x) <= 1 AND abs(m.y - n.y) <= 1 WHERE n.y < e.top OR n.y >= e.bottom),
kept AS (SELECT sheet_id, row, cell, count(*) AS ink FROM (SELECT * FROM may UNION ALL SELECT * FROM fringe) WHERE col GROUP BY ALL),
last_v AS (SELECT sheet_id, row, x, max(y) - min(y0) AS y FROM (SELECT * FROM ink) GROUP BY 1, 2, 3), last_n AS (SELECT sheet_id, row, y, count(*) AS n FROM last_v GROUP BY 1, 2, 3),
base_v AS (SELECT l.sheet_id, l.row, l.y0 + CASE WHEN m.n IS NULL THEN l.y1 - l.y0 - 1 WHEN m.n >= t.c * 0.12e0 THEN m.y ELSE t.p END AS base FROM line_v l
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sheet_id, row ORDER BY n DESC, y) AS k FROM last_n) m ON m.sheet_id = l.sheet_id AND m.row = l.row AND m.k = 1 LEFT JOIN (SELECT sheet_id, row, count(*) AS c, list_sort(list(y))[CAST(floor(count(*) * 0.7e0) AS BIGINT) + 1] AS p FROM last_v GROUP BY 1, 2) t ON t.sheet_id = l.sheet_id AND t.row = l.row),
tall AS (SELECT page AS sheet_id, {SIDE} AS height FROM page_v GROUP BY page)
SELECT e.sheet_id, e.row, CAST(e.cell AS BIGINT) AS cell, substr(l.chars, CAST(e.cell + 1 AS INT), 1) AS char, e.x1 - e.x0 AS cell_w, least(t.height, e.bottom + 2) - greatest(0, e.top - 2) AS cell_h, CAST(b.base - greatest(0, e.top - 2) AS BIGINT) AS baseline, CAST(coalesce(k.ink, 0) AS BIGINT) AS ink
FROM ext e JOIN line_v l USING (sheet_id, row) JOIN base_v b USING (sheet_id, row) JOIN tall t USING (sheet_id) LEFT JOIN kept k ON k.sheet_id = e.sheet_id AND k.row = e.row AND k.cell = e.cell"""


@query(_ROW + _GLYPHS)
def row_glyphs(spark, d):
    """A glyph for each character of a row that has a cell: its box with what is joined to it above and below, its base line and its ink."""
    rows = page_rows(spark, d)
    cells, owners = C.candidates(rows)
    picked = C.chosen(rows, cells).select("sheet_id", "row", "way")
    at = rows.select("sheet_id", "row", "chars")
    cells = cells.withColumnRenamed("slicer", "way").join(picked, ["sheet_id", "row", "way"]).join(at, ["sheet_id", "row"]).filter(F.col("cell") < C.count_of(F.col("chars")))
    owners = owners.withColumnRenamed("slicer", "way").join(picked, ["sheet_id", "row", "way"])
    g = C.glyphs(rows, cells, owners).join(at, ["sheet_id", "row"])
    return g.select("sheet_id", "row", "cell", F.substr("chars", F.col("cell") + 1, F.lit(1)).alias("char"), (F.col("x1") - F.col("x0")).alias("cell_w"), (F.col("bottom") - F.col("top")).alias("cell_h"), "baseline", "ink")


#: The parts of letters with marks (of those in TEXTS).
_ACCENTS = [(c, unicodedata.normalize("NFD", c)[0], True, False) for c in "áčé"]
_MARKS = _PROFILE + f""", page_ink AS (SELECT page AS sheet_id, x, y FROM page_v WHERE opaque AND luma < {DARK}),
sg AS (SELECT sheet_id, y, min(x) AS x0, max(x) + 1 AS x1, y * {SIDE} + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY sheet_id, y ORDER BY x) AS g FROM page_ink) GROUP BY sheet_id, y, g),
tc AS (SELECT a.sheet_id, a.id AS p, b.id AS q FROM sg a JOIN sg b ON a.sheet_id = b.sheet_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
lb AS (SELECT sheet_id, id AS p, id AS q FROM sg UNION SELECT l.sheet_id, t.q, l.q FROM lb l JOIN tc t ON t.sheet_id = l.sheet_id AND t.p = l.p WHERE t.q > l.q),
rt AS (SELECT sheet_id, p AS id, min(q) AS root FROM lb GROUP BY 1, 2), sh AS (SELECT sheet_id, root, min(x0) AS x0, max(x1) AS x1, min(y) AS y0, max(y) + 1 AS y1, sum(x1 - x0) AS area FROM sg JOIN rt USING (sheet_id, id) GROUP BY 1, 2),
cv AS (SELECT a.sheet_id, a.row, a.cell, a.x0, a.x1, l.y0, l.y1, substr(l.chars, CAST(a.cell + 1 AS INT), 1) AS ch FROM anch a JOIN line_v l USING (sheet_id, row)),
nn AS (SELECT c.sheet_id, c.row, c.cell, r.root, sum(least(s.x1, c.x1) - greatest(s.x0, c.x0)) AS n, min(s.y * {SIDE} + greatest(s.x0, c.x0)) AS at_ FROM cv c JOIN sg s ON s.sheet_id = c.sheet_id AND s.y >= c.y0 AND s.y < c.y1 AND s.x0 < c.x1 AND c.x0 < s.x1 JOIN rt r ON r.sheet_id = s.sheet_id AND r.id = s.id GROUP BY 1, 2, 3, 4),
bo AS (SELECT c.*, ch IN ({", ".join(f"'{a[0]}'" for a in _ACCENTS)}) AS acc, n.root, s.x0 AS bx0, s.x1 AS bx1, s.y0 AS by0, s.y1 AS by1, s.area AS ba, s.y1 - s.y0 AS h, s.x1 - s.x0 AS w FROM cv c JOIN (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY sheet_id, row, cell ORDER BY n DESC, at_) = 1) n USING (sheet_id, row, cell) JOIN sh s ON s.sheet_id = c.sheet_id AND s.root = n.root),
ft AS (SELECT sheet_id, row, list_sort(list(by1) FILTER (WHERE regexp_matches(ch, '^\\p{{L}}$') AND NOT contains('gjpqy', ch)))[count(*) FILTER (WHERE regexp_matches(ch, '^\\p{{L}}$') AND NOT contains('gjpqy', ch)) // 2 + 1] AS foot FROM bo GROUP BY 1, 2),
pa AS (SELECT m.sheet_id, m.root AS mark, b.row, b.cell, b.acc AND m.x1 >= bx0 - greatest(w * 0.25e0, h * 0.15e0) AND m.x0 <= bx1 + greatest(w * 0.25e0, h * 0.15e0) AND m.y1 <= by0 + 1 AND by0 - m.y1 <= h * 0.65e0 AS fits,
    m.y0 >= by0 AND m.y1 <= by1 AND greatest(0, bx0 - m.x1, m.x0 - bx1) <= greatest(2, h * 0.12e0) AS inner_, m.y1 - m.y0 <= h * 0.55e0 AND m.x1 - m.x0 <= h * 0.9e0 AND m.area <= ba * 0.75e0 AS small, coalesce(m.y0 >= by1 AND by1 > foot + greatest(2, h * 0.05e0), false) AS has,
    greatest(0, by0 - m.y1, m.y0 - by1) / h + 0.25e0 * abs((m.x0 + m.x1 - bx0 - bx1) / 2) / greatest(w, h * 0.5e0) AS score
    FROM sh m JOIN bo b ON b.sheet_id = m.sheet_id LEFT JOIN ft ON ft.sheet_id = b.sheet_id AND ft.row = b.row WHERE m.area >= 2 AND NOT EXISTS (SELECT 1 FROM bo q WHERE q.sheet_id = m.sheet_id AND q.root = m.root)),
bm AS (SELECT sheet_id, mark, arg_min({{'row': row, 'cell': cell}}, {{'s': score, 'row': row, 'cell': cell}}) FILTER (WHERE fits AND small AND NOT has) AS b, bool_or(inner_ AND NOT fits) AS own FROM pa GROUP BY 1, 2)"""


@query(_ROW + _MARKS + f" SELECT sheet_id, b.row AS row, CAST(b.cell AS BIGINT) AS cell, mark % {SIDE} AS x, mark // {SIDE} AS y FROM bm WHERE NOT own AND b IS NOT NULL")
def accent_owners(spark, d):
    """Detached marks of pages (their first pixel) and the accented letter that each belongs to; letters are the cells of an even pitch."""
    rows = page_rows(spark, d)
    cells = C.anchored(C.profile(rows), C.count_of(F.col("chars"))).select("sheet_id", "row", "y0", "y1", "chars", F.posexplode("ranges").alias("cell", "r"))
    cells = cells.select("sheet_id", "row", F.col("cell").cast("long").alias("cell"), "y0", "y1", "r.x0", "r.x1", F.substr("chars", F.col("cell") + 1, F.lit(1)).alias("char"))
    px = page_pixels(spark, d).filter(F.col("opaque") & (F.col("luma") < DARK)).select(F.col("page").alias("sheet_id"), F.lit(SIDE).cast("long").alias("width"), F.lit(SIDE).cast("long").alias("height"), "x", "y")
    lab = settle(P.labelled(px, diagonal=True).select("sheet_id", "x", "y", "component"))
    at = lab.groupBy("sheet_id", F.col("component").alias("mark")).agg(F.min(F.struct("y", "x")).alias("at"))
    return M.owners(lab, cells).join(at, ["sheet_id", "mark"]).select("sheet_id", "row", "cell", "at.x", "at.y")


@query(_ROW + _PROFILE + """, wr AS (SELECT sheet_id, row, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY sheet_id, row ORDER BY x) AS g FROM cols WHERE n > 0) GROUP BY sheet_id, row, g),
ge AS (SELECT r.*, 2 + (r.sheet_id + r.row) % 3 AS n, lead(x0) OVER w AS nxt, min(x0) OVER p AS a, max(x1) OVER p AS b, count(*) OVER p AS k FROM wr r WINDOW p AS (PARTITION BY sheet_id, row), w AS (PARTITION BY sheet_id, row ORDER BY x0)),
gr AS (SELECT *, nxt - x1 AS gap, row_number() OVER (PARTITION BY sheet_id, row ORDER BY nxt - x1 DESC NULLS LAST, x0) AS rank FROM ge WHERE k >= n AND b - a >= n),
gc AS (SELECT sheet_id, row, list_concat([a], list_sort(list(CAST(floor((x1 + nxt) / 2 + 0.5) AS BIGINT))), [b]) AS e FROM gr WHERE gap IS NOT NULL AND rank < n GROUP BY sheet_id, row, a, b, n HAVING min(gap) >= greatest(2, (b - a) / n * 0.18e0))
SELECT sheet_id, row, i - 1 AS cell, e[i] AS x0, e[i + 1] AS x1 FROM (SELECT *, unnest(range(1, len(e))) AS i FROM gc)""")
def wide_gap_cells(spark, d):
    """Two to four cells a row, cut at its widest gaps where all of these are real ones."""
    rows = page_rows(spark, d)
    return C.parted_cells(C.runs(rows).select("sheet_id", "row", "x0", "x1"), rows.select("sheet_id", "row", ((F.col("sheet_id") + F.col("row")) % 3 + 2).alias("n")))


@query(None)
def seam_cells(spark, d):
    """Each row's characters as cells between seams: where they begin and end at the widest, and their ink."""
    s = C.seamed(page_rows(spark, d), C.count_of(F.col("chars")))
    return s.select("sheet_id", "row", "cell", F.array_min("lefts").alias("x0"), F.array_max("rights").alias("x1"), "ink")
