"""Outlines as path text: each vector's first numbers as the points of two outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import semantics as S
from ..operators import trim as T
from ..sources.bindings import pixels, sql, table
from . import query
from .glyphs import _PROF, profiles
from .raster import body_bounds
from .sheets import _MET, ascents, metrics

#: The commands of a vector's path, and how many numbers each has.
SHAPE = (("M", 2), ("L", 2), ("C", 6), ("Q", 4), ("L", 2), ("Z", 0), ("M", 2), ("L", 2), ("C", 6), ("Z", 0))
EDGE, TIP = 10.0, 40.0


def _numbers(value) -> list:
    out, at = [], 0
    for cmd, n in SHAPE:
        out.append((cmd, [value(at + k) for k in range(n)]))
        at += n
    return out


def drawn(spark, d):
    """(vec_id, path): path text with whole numbers."""
    n = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") * 200).cast("string")
    parts = [F.concat_ws(" ", F.lit(cmd), *args) for cmd, args in _numbers(n)]
    return table(spark, d, "embeddings").select("vec_id", F.concat_ws(" ", *parts).alias("path"))


def _sql(x: str, y: str, columns: str) -> str:
    """The numbers p (x, y in turn) of each vector, changed by expressions of x and y, as text again; further columns."""
    at, parts = 0, []
    for cmd, n in SHAPE:
        parts.append(" || ' ' || ".join([f"'{cmd}'", *[f"t[{at + k + 1}]" for k in range(n)]]))
        at += n
    number = "CASE WHEN floor(v * 1000 + 0.5) / 1000 = floor(floor(v * 1000 + 0.5) / 1000) THEN CAST(CAST(floor(v * 1000 + 0.5) / 1000 AS BIGINT) AS VARCHAR) ELSE CAST(floor(v * 1000 + 0.5) / 1000 AS VARCHAR) END"
    return f"""WITH p AS (SELECT vec_id, list_transform(range(1, {at + 1}), lambda i: floor(CAST(embedding[i] AS DOUBLE) * 200)) AS p FROM embeddings),
m AS (SELECT vec_id, p, list_transform(range(1, {at + 1}), lambda i: CASE WHEN i % 2 = 1 THEN {x.format(x='p[i]')} ELSE {y.format(x='p[i - 1]', y='p[i]')} END) AS q FROM p),
s AS (SELECT *, list_transform(q, lambda v: {number}) AS t FROM m) SELECT vec_id, {" || ' ' || ".join(parts)} AS path{columns} FROM s"""


@query(_sql("{x} * 1.25e0 - 3", "{y}", ""))
def path_scale(spark, d):
    """Outlines scaled and moved along x."""
    return drawn(spark, d).select("vec_id", P.text(P.scaled(P.parsed(F.col("path")), 1.25, -3.0)).alias("path"))


@query(_sql(f"CASE WHEN {{x}} > {EDGE} THEN {EDGE} + ({{x}} - {EDGE}) * 0.35e0 ELSE {{x}} END", "{y}", ""))
def path_tail_shorten(spark, d):
    """Outlines whose parts right of an edge are drawn towards it."""
    return drawn(spark, d).select("vec_id", P.text(P.tail_shortened(P.parsed(F.col("path")), EDGE, 0.35, "right")).alias("path"))


@query(_sql("{x}", f"{{y}} + CASE WHEN {{x}} > {EDGE} THEN least(1, greatest(0, ({{x}} - {EDGE}) / {TIP - EDGE})) ELSE 0 END * -7.5e0", ""))
def path_tail_lower(spark, d):
    """Outlines whose parts right of an edge are moved down, all of it at the tip."""
    return drawn(spark, d).select("vec_id", P.text(P.tail_lowered(P.parsed(F.col("path")), EDGE, TIP, -7.5, "right")).alias("path"))


_FIRST = sum(n for _, n in SHAPE[:6])


@query(_sql("{x}", "{y}", f""", list_min(list_filter(q, lambda v, i: i % 2 = 1)) AS x0, list_min(list_filter(q, lambda v, i: i % 2 = 0)) AS y0, list_max(list_filter(q, lambda v, i: i % 2 = 1)) AS x1, list_max(list_filter(q, lambda v, i: i % 2 = 0)) AS y1,
CAST(sign(list_sum(list_transform(range(0, {_FIRST // 2}), lambda k: q[2 * k + 1] * q[(2 * k + 3) % {_FIRST} + 1] - q[(2 * k + 2) % {_FIRST} + 1] * q[2 * k + 2]))) AS INT) AS turn"""))
def path_measure(spark, d):
    """Outlines with their boxes and the way round of the first."""
    p = drawn(spark, d).select("vec_id", P.parsed(F.col("path")).alias("p"))
    return p.select("vec_id", P.text(F.col("p")).alias("path"), P.box(F.col("p")).alias("b"), P.turn(F.col("p")).alias("turn")).select("vec_id", "path", "b.x0", "b.y0", "b.x1", "b.y1", "turn")


PAD, PEN = 0, 0  # of glyphs that are 8 columns wide


def bodied(spark, d):
    """Glyphs with ink by face: their ink's columns, and the body by the rules of their face (script or not); whole ones have none."""
    ink = lambda c: F.when(F.col("ink"), F.col(c))
    cols = pixels(spark, d).groupBy("sheet_id", "x").agg(F.count_if("ink").alias("n"), F.min(ink("y")).alias("y0"), F.max(ink("y")).alias("y1"))
    span = cols.filter("n > 0").groupBy("sheet_id").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    g = profiles(spark, d).select("sheet_id", "face", "ch").join(span, "sheet_id").join(body_bounds(cols), "sheet_id")
    deep = body_bounds(cols, area=1.0, most=0.45, thin_share=0.65).select("sheet_id", F.col("x0").alias("s0"), F.col("x1").alias("s1"))
    g = g.join(T.scripts(g), "face").join(deep, "sheet_id")
    g = g.withColumns({"x0": F.when(F.col("script"), F.col("s0")).otherwise(F.col("x0")), "x1": F.when(F.col("script"), F.col("s1")).otherwise(F.col("x1"))})
    tail = (F.col("x0") != F.col("first")) | (F.col("x1") != F.col("last"))
    right = F.when(F.lit(T.RIGHT).contains(F.col("ch")), F.col("last")).otherwise(F.col("x1"))
    return g.select("sheet_id", "face", "ch", "script", "first", "last", F.when(tail, F.col("x0")).alias("x0"), F.when(tail, right).alias("x1"), F.lit(8).cast("long").alias("cell"))


_INKED = """, cl AS (SELECT sheet_id, x, count(*) FILTER (WHERE ink) AS n, min(y) FILTER (WHERE ink) AS y0, max(y) FILTER (WHERE ink) AS y1 FROM pixels_v GROUP BY 1, 2),
cg AS (SELECT sheet_id, min(x) FILTER (WHERE n > 0) AS a, max(x) FILTER (WHERE n > 0) AS z, sum(n) AS total, max(n) AS peak, max(y1) - min(y0) + 1 AS h FROM cl GROUP BY 1)"""


def _bounds(name: str, area: float, most: float, thin: float, extent: float = 0.04) -> str:
    edge = "NOT (thin AND {s} <= {area}e0 * total AND {far} < floor((z - a + 1) * {most}e0))"
    lo, hi = edge.format(s="l", far="x - a", area=area, most=most), edge.format(s="r", far="z - x", area=area, most=most)
    return f""", {name}_t AS (SELECT *, n < {thin}e0 * peak AND (n = 0 OR y1 - y0 + 1 <= 0.55e0 * h) AS thin, sum(n) OVER (PARTITION BY sheet_id ORDER BY x) AS l, sum(n) OVER (PARTITION BY sheet_id ORDER BY x DESC) AS r FROM cl JOIN cg USING (sheet_id) WHERE x BETWEEN a AND z),
{name}_b AS (SELECT sheet_id, any_value(a) AS a, any_value(z) AS z, min(x) FILTER (WHERE {lo}) AS lo, max(x) FILTER (WHERE {hi}) AS hi FROM {name}_t GROUP BY 1),
{name} AS (SELECT sheet_id, a, z, CASE WHEN lo - a < greatest(2, floor((z - a + 1) * {extent}e0 + 0.5)) THEN a ELSE lo END AS x0, CASE WHEN z - hi < greatest(2, floor((z - a + 1) * {extent}e0 + 0.5)) THEN z ELSE hi END AS x1 FROM {name}_b)"""


_TRIM = _PROF + _INKED + _bounds("bd", 0.08, 0.3, 0.5) + _bounds("sc", 1.0, 0.45, 0.65) + f""", fs AS (SELECT face, count(*) FILTER (WHERE greatest(x0 - a, z - x1) >= (z - a + 1) * 0.08e0) / count(*) >= 0.4e0 AS script FROM bd JOIN prof USING (sheet_id) GROUP BY 1),
bs AS (SELECT p.sheet_id, p.face, p.ch, fs.script, b.a AS first, b.z AS last, CASE WHEN script THEN s.x0 ELSE b.x0 END AS x0, CASE WHEN script THEN s.x1 ELSE b.x1 END AS x1 FROM prof p JOIN bd b USING (sheet_id) JOIN sc s USING (sheet_id) JOIN fs ON fs.face = p.face),
bo AS (SELECT sheet_id, face, ch, script, first, last, CASE WHEN x0 <> first OR x1 <> last THEN x0 END AS x0, CASE WHEN x0 <> first OR x1 <> last THEN CASE WHEN contains('{T.RIGHT}', ch) THEN last ELSE x1 END END AS x1 FROM bs),
le AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY ch) AS i FROM (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY face, ch ORDER BY sheet_id) = 1)),
sp AS (SELECT DISTINCT m.face, CAST(floor(8 - (m.xh * 0.15e0 + m.xh * 0.95e0 * s / 32) + 0.5) AS BIGINT) AS y FROM (SELECT face, coalesce(CAST(xh AS DOUBLE), max_asc * 0.5e0) AS xh FROM met) m, range(0, 33) q(s)),
pr AS (SELECT k, l, r FROM (VALUES {", ".join(f"({k}, '{p[0]}', '{p[1]}')" for k, p in enumerate(T.PAIRS))}) v(k, l, r)),
sd AS (SELECT sheet_id, y, min(x) AS lft, max(x) AS rgt FROM pixels_v WHERE ink GROUP BY 1, 2),
dp AS (SELECT a.face, k, any_value(a.i) AS li, any_value(b.i) AS ri, min(v.lft - u.rgt) AS d FROM pr JOIN le a ON a.ch = pr.l JOIN le b ON b.ch = pr.r AND b.face = a.face JOIN sp ON sp.face = a.face JOIN sd u ON u.sheet_id = a.sheet_id AND u.y = sp.y JOIN sd v ON v.sheet_id = b.sheet_id AND v.y = sp.y GROUP BY a.face, k),
ord AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY k) AS t, count(*) OVER (PARTITION BY face) AS n FROM dp),
s0 AS (SELECT face, list(first ORDER BY i) AS f, list(last ORDER BY i) AS z, list(x0 ORDER BY i) AS a, list(x1 ORDER BY i) AS b FROM le GROUP BY 1),
st AS (SELECT face, f, z, a, b, CAST(0 AS BIGINT) AS t FROM s0 UNION ALL
SELECT face, f, z, list_transform(range(1, len(a) + 1), lambda j: CASE WHEN j = ri THEN a[j] - back ELSE a[j] END), list_transform(range(1, len(b) + 1), lambda j: CASE WHEN j = li THEN b[j] + given ELSE b[j] END), t FROM
(SELECT *, CASE WHEN a[ri] IS NULL THEN 0 ELSE least(miss - given, greatest(0, a[ri] - f[ri])) END AS back FROM (SELECT *, CASE WHEN a[li] IS NULL THEN 0 ELSE least(miss, greatest(0, z[li] - b[li])) END AS given FROM
(SELECT st.face, f, z, a, b, o.t, o.li, o.ri, greatest(0, -(CASE WHEN a[li] IS NULL THEN 8 ELSE b[li] - a[li] + 1 + {2 * PAD} END + CASE WHEN a[ri] IS NULL THEN 0 ELSE {PAD} - a[ri] END - CASE WHEN a[li] IS NULL THEN 0 ELSE {PAD} - a[li] END + d) - {PEN}) AS miss FROM st JOIN ord o ON o.face = st.face AND o.t = st.t + 1)))),
en AS (SELECT face, arg_max(a, t) AS a, arg_max(b, t) AS b FROM st GROUP BY 1)"""


@query(sql(_MET.replace(_PROF, _TRIM.split(", fs AS")[0], 1) + ", fs AS" + _TRIM.split(", fs AS", 1)[1] + " SELECT le.face, le.ch, script, first, last, le.x0 AS body_x0, le.x1 AS body_x1, a[i] AS x0, b[i] AS x1 FROM le JOIN en USING (face)", "pixels_v", recursive=True))
def flourish_trim(spark, d):
    """The first glyph of each character of a face: its ink, its body, and what is left of the trim when pairs have taken theirs back."""
    g = S.first_wins(bodied(spark, d), ["face", "ch"], F.col("sheet_id"))
    p = pixels(spark, d).filter("ink").groupBy("sheet_id", "y").agg(F.min("x").alias("left"), F.max("x").alias("right"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda s: S.half_up(8 - (F.col("xh") * 0.15 + F.col("xh") * 0.95 * s / 32)))
    strip = metrics(ascents(spark, d)).select("face", F.explode(F.array_distinct(lines)).alias("y"))
    pairs = T.depths(p, g.select("face", "ch", "sheet_id"), strip).groupBy("face").agg(F.array_sort(F.collect_list(F.struct("k", "l", "r", "d"))).alias("pairs"))
    one = F.struct("ch", "first", "last", F.col("x0").alias("body_x0"), F.col("x1").alias("body_x1"), "x0", "x1", "cell")
    faces = g.groupBy("face").agg(F.first("script").alias("script"), F.array_sort(F.collect_list(one)).alias("letters")).join(pairs, "face", "left")
    none = F.array().cast("array<struct<k:int,l:string,r:string,d:bigint>>")
    done = T.fold(F.col("letters"), F.coalesce("pairs", none), PAD, F.lit(PEN))
    return faces.select("face", "script", F.inline(done)).drop("cell")


def joined(spark, d):
    """Small letters with ink: their ink's and their body's columns by the joins' rules, and the lines where they reach furthest in the joining band."""
    ink = lambda c: F.when(F.col("ink"), F.col(c))
    px = pixels(spark, d)
    cols = px.groupBy("sheet_id", "x").agg(F.count_if("ink").alias("n"), F.min(ink("y")).alias("y0"), F.max(ink("y")).alias("y1"))
    span = cols.filter("n > 0").groupBy("sheet_id").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    xh = metrics(ascents(spark, d)).select("face", F.greatest(F.lit(1.0), F.col("xh")).alias("xh"))
    g = profiles(spark, d).filter(F.col("ch").rlike("^[a-z]$")).select("sheet_id", "face", "ch").join(span, "sheet_id").join(body_bounds(cols, area=0.25, most=0.5, thin_share=0.6, extent=0.02), "sheet_id").join(xh, "face")
    lines = px.filter("ink").groupBy("sheet_id", "y").agg(F.min("x").alias("left"), F.max("x").alias("right"))
    at = lambda share: F.least(F.lit(7), F.greatest(F.lit(0), S.half_up(8 - F.col("xh") * share)))
    band = lines.join(g.select("sheet_id", at(0.6).alias("top"), at(0.02).alias("bot")), "sheet_id").filter("y between top and bot")
    ends = band.groupBy("sheet_id").agg(F.min_by("y", F.struct("left", "y")).alias("ly"), F.max_by("y", F.struct("right", (-F.col("y")).alias("y"))).alias("ry"))
    return g.join(ends, "sheet_id", "left").withColumn("base", F.lit(8))


_JOINED = _PROF + _INKED + _bounds("jb", 0.25, 0.5, 0.6, 0.02)
_LETTERS = """, jl AS (SELECT p.sheet_id, p.face, p.ch, b.a AS first, b.z AS last, b.x0, b.x1, greatest(1, coalesce(CAST(m.xh AS DOUBLE), m.max_asc * 0.5e0)) AS xh FROM prof p JOIN jb b USING (sheet_id) JOIN met m ON m.face = p.face WHERE regexp_matches(p.ch, '^[a-z]$')),
ln AS (SELECT sheet_id, y, min(x) AS lft, max(x) AS rgt FROM pixels_v WHERE ink GROUP BY 1, 2),
je AS (SELECT j.sheet_id, arg_min(y, (lft, y)) AS ly, arg_max(y, (rgt, -y)) AS ry FROM jl j JOIN ln USING (sheet_id) WHERE y >= least(7, greatest(0, floor(8 - xh * 0.6e0 + 0.5))) AND y <= least(7, greatest(0, floor(8 - xh * 0.02e0 + 0.5))) GROUP BY 1),
jo AS (SELECT jl.*, ly, ry FROM jl LEFT JOIN je USING (sheet_id))"""
_MEDIAN = "list_sort(list({0}) FILTER (WHERE {1}))[count(*) FILTER (WHERE {1}) // 2 + 1]"
GATE, MOST = -0.01, 0.15  # glyphs of eight columns have no long entries


@query(sql(_MET.replace(_PROF, _JOINED, 1) + _LETTERS + f""", en AS (SELECT *, (x0 - first) / xh AS entry FROM jo), md AS (SELECT face, {_MEDIAN.format('entry', 'entry IS NOT NULL')} AS median, count(*) AS n FROM en GROUP BY 1)
SELECT sheet_id, round(entry, 6) AS entry, CASE WHEN n >= 4 AND median > {GATE} AND entry > {MOST} THEN round({MOST} / entry, 6) END AS scale FROM en JOIN md USING (face)""", "pixels_v"))
def connector_tails(spark, d):
    """Entries of small letters, and what shortens those that are too long in faces where most are long."""
    t = T.tails(joined(spark, d), GATE, MOST)
    return t.select("sheet_id", F.round("entry", 6).alias("entry"), F.round("scale", 6).alias("scale"))


def _move(line: str, can: str) -> str:
    dy = f"CASE WHEN jy - {line} >= 0 THEN least(0.5e0 * xh, jy - {line}) WHEN scattered THEN greatest(-0.25e0 * xh, jy - {line}) ELSE 0 END"
    return f"CASE WHEN ({can}) AND abs({dy}) >= 1 THEN round({dy}, 6) ELSE 0 END"


@query(sql(_MET.replace(_PROF, _JOINED, 1) + _LETTERS + f""", se AS (SELECT *, (8 - ly) / xh AS entry, (8 - ry) / xh AS lv, NOT contains('{T.DESCENDER + T.HIGH}', ch) AS plain FROM jo WHERE ly IS NOT NULL),
sm AS (SELECT face, count(*) AS n, count(*) FILTER (WHERE plain) AS k, {_MEDIAN.format('entry', 'true')} AS median, {_MEDIAN.format('lv', 'plain')} AS lv_m, stddev_pop(entry) AS sd FROM se GROUP BY 1),
sj AS (SELECT se.*, sd > 0.12e0 AS scattered, 8 - least(0.3e0, greatest(0.08e0, median)) * xh AS jy FROM se JOIN sm USING (face) WHERE n >= 4 AND k >= 2 AND (sd > 0.12e0 OR lv_m - median > 0.2e0))
SELECT sheet_id, {_move('ry', f"(plain OR (scattered AND NOT contains('{T.DESCENDER}', ch))) AND last > x1")} AS exit_dy, {_move('ly', 'first < x0')} AS entry_dy FROM sj""", "pixels_v"))
def connector_snaps(spark, d):
    """How far the ends of small letters' connectors move on to their face's join line."""
    s = T.snaps(joined(spark, d).filter("ly is not null"))
    return s.select("sheet_id", F.round("exit_dy", 6).alias("exit_dy"), F.round("entry_dy", 6).alias("entry_dy"))
