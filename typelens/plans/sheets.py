"""Sheets of many cells, faces and joins. A page is 8 x 8 of the 8 x 8 vectors (64 x 64 pixels), a strip is one column of its cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..operators import islands as I
from ..sources.bindings import fonts, owned, pixels, sql, table
from ..sources.shipping import ship
from . import SQL, query
from .glyphs import _PROF, profiles
from .raster import hole_area

SIDE = 64
BIAS = (20, 128, 200)
DARK = 60  # ink is under this luma
_PAGE = f"""WITH page_v AS (SELECT vec_id, vec_id // 64 AS page, CAST(vec_id % 8 * 8 + i % 8 AS BIGINT) AS x, CAST(vec_id % 64 // 8 * 8 + i // 8 AS BIGINT) AS y, vec_id % 13 <> 12 AS opaque,
least(255, greatest(0, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 600) AS BIGINT) + {list(BIAS)}[vec_id // 64 % 3 + 1])) AS luma FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))"""
_STRIP = _PAGE + f", strip_v AS (SELECT page * 8 + x // 8 AS strip, y, count(*) FILTER (WHERE opaque AND luma < {DARK}) AS width FROM page_v GROUP BY 1, 2)"


def _luma(value: Column, page: Column) -> Column:
    bias = F.element_at(F.array(*map(F.lit, BIAS)), (page % 3 + 1).cast("int"))
    return S.clamp(F.floor(value.cast("double") * 600) + bias, 0, 255)


def page_pixels(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 64").alias("page"), F.posexplode("embedding").alias("i", "value"))
    return v.select(
        "page", (F.col("vec_id") % 8 * 8 + F.col("i") % 8).alias("x"), F.expr("vec_id % 64 div 8 * 8 + i div 8").alias("y"), (F.col("vec_id") % 13 != 12).alias("opaque"), _luma(F.col("value"), F.col("page")).alias("luma")
    )


def strip_rows(spark, d):
    """Ink per row of a strip, counted inside each cell."""
    v = table(spark, d, "embeddings").withColumn("page", F.expr("vec_id div 64"))
    ink = lambda y: F.size(F.filter(F.slice(v["embedding"], y * 8 + 1, 8), lambda z: _luma(z, F.col("page")) < DARK))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.when(F.col("vec_id") % 13 == 12, 0).otherwise(ink(y)))
    v = v.select("vec_id", (F.col("page") * 8 + F.col("vec_id") % 8).alias("strip"), F.posexplode(rows).alias("k", "width"))
    return v.select("strip", F.expr("vec_id % 64 div 8 * 8 + k").alias("y"), F.col("width").cast("long").alias("width"))


@query(_PAGE + """, s AS (SELECT page, count(*) FILTER (WHERE k) AS n, count(*) FILTER (WHERE k AND luma <= 70) AS dark, count(*) FILTER (WHERE k AND luma > 90 AND luma < 150) AS mid, count(*) FILTER (WHERE k AND luma >= 160) AS bright
FROM (SELECT *, opaque AND x BETWEEN 12 AND 51 AND y BETWEEN 12 AND 51 AS k FROM page_v) GROUP BY page) SELECT page, n, dark, coalesce(n >= 64 AND dark / n >= 0.65 AND bright / n >= 0.015 AND bright / n <= 0.35 AND mid / n < 0.2, false) AS invert FROM s""")
def dark_sheet_invert(spark, d):
    """Whether a page is light ink on dark paper, by the shares of tones in its central 60 per cent."""
    lo, hi, step = math.floor(SIDE * 0.2), math.ceil(SIDE * 0.8), max(1, SIDE // 200)
    inside = F.col("opaque")
    for c in ("x", "y"):
        inside = inside & (F.col(c) >= lo) & (F.col(c) < hi) & ((F.col(c) - lo) % step == 0)
    luma, n = F.col("luma"), F.col("n")
    s = page_pixels(spark, d).groupBy("page").agg(
        F.count_if(inside).alias("n"), F.count_if(inside & (luma <= 70)).alias("dark"), F.count_if(inside & (luma > 90) & (luma < 150)).alias("mid"), F.count_if(inside & (luma >= 160)).alias("bright")
    )
    share = lambda c: F.try_divide(F.col(c), n)
    invert = (n >= 64) & (share("dark") >= 0.65) & share("bright").between(0.015, 0.35) & (share("mid") < 0.2)
    return s.select("page", "n", "dark", F.coalesce(invert, F.lit(False)).alias("invert"))


_TILES = _PAGE + """, c AS (SELECT page, x // 8 AS tx, y // 8 AS ty, CASE WHEN opaque THEN luma END AS luma, count(*) AS c FROM page_v GROUP BY ALL),
a AS (SELECT *, sum(CASE WHEN luma IS NOT NULL THEN c END) OVER (PARTITION BY page, tx, ty ORDER BY luma NULLS FIRST) AS acc, sum(CASE WHEN luma IS NOT NULL THEN c END) OVER (PARTITION BY page, tx, ty) AS n FROM c),
q AS (SELECT page, tx, ty, min(luma) FILTER (WHERE luma IS NOT NULL AND acc >= greatest(1, ceil(n * 0.85e0))) AS v FROM a GROUP BY 1, 2, 3),
g AS (SELECT page, k % 8 AS tx, k // 8 AS ty FROM (SELECT DISTINCT page FROM page_v), range(0, 64) t(k)), tiles AS (SELECT g.page, g.tx, g.ty, coalesce(q.v, 255) AS v FROM g LEFT JOIN q ON q.page = g.page AND q.tx = g.tx AND q.ty = g.ty)"""


def tile_levels(p, w: int, h: int, least: int = 32):
    """The 85th percentile of luma of every tile of a page (255 where nothing is opaque), from counts per level; also tiles a row and a column."""
    tile = max(least, math.floor(min(w, h) / 16 + 0.5))
    cols, rows = max(2, math.ceil(w / tile)), max(2, math.ceil(h / tile))
    key = ["page", "tx", "ty"]
    p = p.select("page", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), F.when(F.col("opaque"), F.col("luma")).alias("luma"))
    c = p.groupBy(*key, "luma").agg(F.count(F.lit(1)).alias("c"))
    counted = F.sum(F.when(F.col("luma").isNotNull(), F.col("c")))
    each = Window.partitionBy(*key)
    a = c.withColumns({"acc": counted.over(each.orderBy("luma").rowsBetween(Window.unboundedPreceding, 0)), "n": counted.over(each)})
    q = a.groupBy(*key).agg(F.min(F.when(F.col("acc") >= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.85)), F.col("luma"))).alias("v"))
    grid = p.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1))).alias("k"))
    grid = grid.select("page", (F.col("k") % cols).cast("long").alias("tx"), F.floor(F.col("k") / cols).alias("ty"))
    return grid.join(q, key, "left").select(*key, F.coalesce("v", F.lit(255)).alias("v")), cols, rows


@query(_TILES + " SELECT * FROM tiles")
def tile_percentiles(spark, d):
    return tile_levels(page_pixels(spark, d), SIDE, SIDE, least=8)[0]


@query(_TILES + """, m AS (SELECT a.page, a.tx, a.ty, max(b.v) AS v FROM tiles a JOIN tiles b ON a.page = b.page AND abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 GROUP BY 1, 2, 3),
s AS (SELECT a.page, a.tx, a.ty, avg(b.v) AS v FROM m a JOIN m b ON a.page = b.page AND abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 GROUP BY 1, 2, 3),
r AS (SELECT page, min(v) AS lo, max(v) AS hi FROM s WHERE tx BETWEEN 1 AND 6 AND ty BETWEEN 1 AND 6 GROUP BY 1)
SELECT page, lo >= 232 OR hi < 105 AS bypass, CASE WHEN NOT (lo >= 232 OR hi < 105) THEN round(greatest(95, hi * 0.42e0), 6) END AS floor FROM r""")
def paper_field(spark, d):
    """The lighting of a page: tile levels, dilated and smoothed by their neighbours; evenly white and dark pages need none. Tiles are of 8
    pixels at least here, the pages being small."""
    t, cols, rows = tile_levels(page_pixels(spark, d), SIDE, SIDE, least=8)
    for how in (F.max, F.avg):
        for axis, n in (("tx", cols), ("ty", rows)):
            t = t.withColumn(axis, F.explode(F.sequence(F.greatest(F.col(axis) - 1, F.lit(0)), F.least(F.col(axis) + 1, F.lit(n - 1)))))
        t = t.groupBy("page", "tx", "ty").agg(how("v").alias("v"))
    for axis, n in (("tx", cols), ("ty", rows)):
        lo = min(n - 1, math.floor(n * 0.15))
        t = t.filter((F.col(axis) >= lo) & (F.col(axis) < max(lo + 1, math.ceil(n * 0.85))))
    r = t.groupBy("page").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bypass = (F.col("lo") >= 232) | (F.col("hi") < 105)
    return r.select("page", bypass.alias("bypass"), F.when(~bypass, F.round(F.greatest(F.lit(95.0), F.col("hi") * 0.42), 6)).alias("floor"))


_EVEN = _PAGE + f""", e AS (SELECT page, min(y) AS top, max(y) AS bot FROM page_v WHERE opaque AND luma < {DARK} GROUP BY 1),
bands AS (SELECT page, r AS band, CAST(floor(top + r * ((bot - top + 1) / 5) + 0.5) AS BIGINT) AS start, CAST(floor(top + (r + 1) * ((bot - top + 1) / 5) + 0.5) AS BIGINT) AS stop FROM e, range(0, 5) t(r))"""


def banded(p, n: int):
    """n bands of equal height over the rows of a page that have ink."""
    e = p.filter(F.col("opaque") & (F.col("luma") < DARK)).groupBy("page").agg(F.min("y").alias("top"), F.max("y").alias("bot"))
    edge = lambda r: S.half_up(F.col("top") + r * ((F.col("bot") - F.col("top") + 1) / n))
    e = e.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return e.select("page", "band", edge(F.col("band")).alias("start"), edge(F.col("band") + 1).alias("stop"))


@query(_EVEN + " SELECT * FROM bands")
def even_bands(spark, d):
    return banded(page_pixels(spark, d), 5)


@query(_EVEN + " SELECT b.page, band, count(*) AS n, CAST(sum(luma) AS BIGINT) AS luma FROM bands b JOIN page_v p ON p.page = b.page AND y >= start AND y < stop WHERE opaque GROUP BY 1, 2")
def band_levels(spark, d):
    """Pixels by the band that holds their row; rows are summed before they meet the bands."""
    p = page_pixels(spark, d)
    rows = p.filter("opaque").groupBy("page", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("luma").alias("luma"))
    inside = rows.join(banded(p, 5), "page").filter("y >= start and y < stop")
    return inside.groupBy("page", "band").agg(F.sum("n").alias("n"), F.sum("luma").alias("luma"))


LINES = ("HIOnou", "ilxv", "wz")


@query(_EVEN + f" SELECT page, band, {list(LINES)}[band + 1] AS chars, start, stop FROM bands WHERE band < {len(LINES)}")
def charset_rows(spark, d):
    """Lines of the charset and detected rows by their places, as many as both have."""
    b = banded(page_pixels(spark, d), 5).withColumn("chars", F.get(F.array(*map(F.lit, LINES)), F.col("band").cast("int")))
    return b.filter("chars is not null").select("page", "band", "chars", "start", "stop")


@query(_PAGE + f""", s AS (SELECT page, x + CAST(floor((y - 16) * (CASE WHEN page % 2 = 0 THEN 0.25e0 ELSE -0.25e0 END) + 0.5) AS BIGINT) AS x FROM page_v WHERE y BETWEEN 16 AND 31 AND opaque AND luma < {DARK})
SELECT page, x, count(*) AS ink FROM s WHERE x BETWEEN 0 AND 67 GROUP BY 1, 2""")
def deskew_columns(spark, d):
    """Ink per column of a row of 16 lines after it is sheared; what leaves the wider frame is dropped."""
    y0, y1, slope = 16, 32, 0.25
    tan = F.when(F.col("page") % 2 == 0, slope).otherwise(-slope)
    p = page_pixels(spark, d).filter((F.col("y") >= y0) & (F.col("y") < y1) & F.col("opaque") & (F.col("luma") < DARK))
    p = p.select("page", (F.col("x") + S.half_up((F.col("y") - y0) * tan)).alias("x"))
    return p.filter((F.col("x") >= 0) & (F.col("x") < SIDE + math.ceil((y1 - y0) * slope))).groupBy("page", "x").agg(F.count(F.lit(1)).alias("ink"))


def _bands(over: int) -> str:
    return f"(SELECT strip, list_sort(list(stop - start)) AS hs, list({{'start': start, 'stop': stop}} ORDER BY start) AS bs FROM (SELECT strip, min(y) AS start, max(y) + 1 AS stop FROM (SELECT strip, y, y - row_number() OVER (PARTITION BY strip ORDER BY y) AS k FROM strip_v WHERE width > {over}) GROUP BY strip, k) GROUP BY strip)"


def strip_bands(spark, d, over: int):
    """Runs of rows with more ink than a value, as one list a strip (a strip has 64 rows)."""
    runs = I.islands(strip_rows(spark, d).filter(F.col("width") > over).select("strip", "y"), ["strip"], "y")
    return runs.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("bs"))


def fragmented(std: Column, strict: Column, expected: Column) -> Column:
    """Whether stricter bands (sorted heights) are pieces of the standard ones, not rows that these had fused."""
    a, b = F.size(std), F.size(strict)
    mid = lambda x: F.get(x, F.floor(F.size(x) / 2).cast("int"))
    split = (b >= F.ceil(a * 1.5)) | ((b > 9) & (mid(strict) < mid(std) * 0.72))
    return F.when(b <= a, False).when((expected > 0) & (a == expected), True).when(a < 5, False).when(F.array_max(std) > mid(std) * 1.55, False).otherwise(split)


@query(_STRIP + f""" SELECT a.strip, len(a.hs) AS standard, coalesce(len(b.hs), 0) AS strict, CASE WHEN coalesce(len(b.hs), 0) <= len(a.hs) THEN false WHEN a.strip % 4 = 0 AND len(a.hs) = 9 THEN true WHEN len(a.hs) < 5 THEN false
WHEN a.hs[-1] > a.hs[len(a.hs) // 2 + 1] * 1.55 THEN false ELSE len(b.hs) >= ceil(len(a.hs) * 1.5) OR (len(b.hs) > 9 AND b.hs[len(b.hs) // 2 + 1] < a.hs[len(a.hs) // 2 + 1] * 0.72) END AS fragments
FROM {_bands(0)} a LEFT JOIN {_bands(1)} b USING (strip)""")
def row_fragmentation(spark, d):
    heights = lambda c: F.array_sort(F.transform(F.coalesce(c, F.expr("array()").cast("array<struct<start:bigint,stop:bigint>>")), lambda r: r["stop"] - r["start"]))
    t = strip_bands(spark, d, 0).join(strip_bands(spark, d, 1).withColumnRenamed("bs", "cs"), "strip", "left")
    a, b = heights(F.col("bs")), heights(F.col("cs"))
    expected = F.when(F.col("strip") % 4 == 0, 9).otherwise(0)
    return t.select("strip", F.size(a).cast("long").alias("standard"), F.size(b).cast("long").alias("strict"), fragmented(a, b, expected).alias("fragments"))


def pitched(bs: Column) -> Column:
    """Bands whose centres are nearer than 0.75 of the upper-median pitch become one; fewer than three stay."""
    centre = lambda r: (r["start"] + r["stop"]) / 2
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(bs) - 1), lambda i: centre(F.get(bs, i)) - centre(F.get(bs, i - 1))))
    pitch = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))

    def step(done, r):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), r["stop"].alias("stop"))))
        return F.when(centre(r) - centre(last) < 0.75 * pitch, joined).otherwise(F.concat(done, F.array(r)))

    return F.when(F.size(bs) > 2, F.aggregate(F.slice(bs, 2, F.size(bs)), F.slice(bs, 1, 1), step)).otherwise(bs)


@query(_STRIP + f""", b AS (SELECT strip, bs, list_sort(list_transform(range(2, len(bs) + 1), lambda i: (bs[i].start + bs[i].stop) / 2 - (bs[i - 1].start + bs[i - 1].stop) / 2)) AS gs FROM {_bands(0)}),
m AS (SELECT strip, CASE WHEN len(bs) <= 2 THEN bs ELSE list_reduce(list_transform(bs, lambda z: [z]), lambda a, r: CASE WHEN (r[1].start + r[1].stop) / 2 - (a[-1].start + a[-1].stop) / 2 < 0.75 * gs[len(gs) // 2 + 1]
THEN list_concat(a[:-2], [{{'start': a[-1].start, 'stop': r[1].stop}}]) ELSE list_concat(a, r) END) END AS bs FROM b) SELECT strip, u.start AS start, u.stop AS stop FROM (SELECT strip, unnest(bs) AS u FROM m)""")
def pitch_merge(spark, d):
    m = strip_bands(spark, d, 0).select("strip", F.explode(pitched(F.col("bs"))).alias("b"))
    return m.select("strip", "b.start", "b.stop")


def bleed(w: Column) -> Column:
    """From the widths of a glyph's rows: rows at its head that belong to the row above (0: none)."""
    h = F.size(w)
    first = F.array_position(F.transform(w, lambda z: z > 0), True).cast("int") - 1
    valley = F.get(F.filter(F.sequence(first, h - 1), lambda i: F.coalesce(F.get(w, i + 1) > F.get(w, i), F.lit(True))), F.lit(0))
    head = F.get(w, first)
    cut = (valley > first) & (valley - first <= h * 0.18) & (F.get(w, valley) <= head * 0.8) & (F.array_max(F.slice(w, valley + 1, h)) >= head * 1.6)
    return F.when((first >= 0) & cut, valley).otherwise(0)


def _bleed(w: str, out: str) -> str:
    return f"""(SELECT strip, CASE WHEN v > a AND v - a <= len(w) * 0.18 AND w[v + 1] <= w[a + 1] * 0.8 AND list_max(w[v + 1:]) >= w[a + 1] * 1.6 THEN v ELSE 0 END AS {out} FROM
(SELECT *, list_filter(range(a, len(w)), lambda i: i + 1 >= len(w) OR w[i + 2] > w[i + 1])[1] AS v FROM (SELECT strip, {w} AS w, list_position(list_transform({w}, lambda z: z > 0), true) - 1 AS a FROM ws)))"""


@query(_STRIP + f", ws AS (SELECT strip, list(width ORDER BY y) AS w FROM strip_v GROUP BY 1) SELECT ws.strip, coalesce(t.top, 0) AS top, len(w) - coalesce(b.bot, 0) AS bot FROM ws LEFT JOIN {_bleed('w', 'top')} t USING (strip) LEFT JOIN {_bleed('list_reverse(w)', 'bot')} b USING (strip)")
def edge_bleed(spark, d):
    """The rows of a strip without what bleeds into its head and its foot."""
    w = strip_rows(spark, d).groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("y", "width"))).alias("r"))
    w = w.select("strip", F.transform("r", lambda r: r["width"]).alias("w"))
    return w.select("strip", bleed(F.col("w")).cast("long").alias("top"), (F.size("w") - bleed(F.reverse("w"))).cast("long").alias("bot"))


@query(sql("SELECT sheet_id, x, count(*) FILTER (WHERE ink AND y BETWEEN 2 AND 5) AS ink FROM pixels_v GROUP BY 1, 2", "pixels_v"))
def band_column_ink(spark, d):
    return pixels(spark, d).groupBy("sheet_id", "x").agg(F.count_if(F.col("ink") & F.col("y").between(2, 5)).alias("ink"))


@query(sql(", c AS (SELECT sheet_id, x, count(*) FILTER (WHERE ink AND y BETWEEN 2 AND 5) AS ink FROM pixels_v GROUP BY 1, 2) SELECT sheet_id, min(x) AS first, max(x) AS last FROM c WHERE ink > 1 GROUP BY 1", "pixels_v"))
def eye_body(spark, d):
    """The columns of a glyph's body: the first and the last with more ink than a value; none without."""
    return band_column_ink(spark, d).filter("ink > 1").groupBy("sheet_id").agg(F.min("x").alias("first"), F.max("x").alias("last"))


_UP = "list_sort(list({0}) FILTER (WHERE {1}))[CAST(floor(count({0}) FILTER (WHERE {1}) / 2) AS BIGINT) + 1]"
_ASC = _PROF + ", asc_v AS (SELECT *, CASE WHEN area > 0 THEN base + 1 - height + 0 END AS top, CASE WHEN area > 0 THEN 8 - (base + 1 - height) END AS asc_px FROM prof)"
_MET = _ASC + f""", met AS (SELECT face, greatest(1, coalesce(max(asc_px), 1)) AS max_asc, coalesce(nullif(arg_max(asc_px, sheet_id) FILTER (WHERE ch = 'x' AND asc_px IS NOT NULL), 0), {_UP.format('asc_px', "asc_px IS NOT NULL AND contains('xvwzonu', ch)")}) AS xh,
{_UP.format('asc_px', "asc_px IS NOT NULL AND contains('HBEINPRT', ch)")} AS cap FROM asc_v GROUP BY face)"""


def ascents(spark, d):
    """Profiles with the first ink row and its height over the baseline, which is the sheet's foot; nulls without ink."""
    top = F.when(F.col("area") > 0, F.col("base") + 1 - F.col("height"))
    return profiles(spark, d).withColumns({"top": top, "asc": 8 - top})


def metrics(glyphs):
    """x-height, cap height and the largest ascent per face: the last ``x``, else an upper median of flat letters, else half the ascent."""
    of = lambda chars: S.upper_median(F.when(F.lit(chars).contains(F.col("ch")), F.col("asc")))
    x = F.max_by(F.when(F.col("ch") == "x", F.col("asc")), F.when((F.col("ch") == "x") & F.col("asc").isNotNull(), F.col("sheet_id")))
    m = glyphs.groupBy("face").agg(F.greatest(F.lit(1), F.max("asc")).alias("max_asc"), F.coalesce(F.nullif(x, F.lit(0)), of("xvwzonu")).alias("xh"), of("HBEINPRT").alias("cap"))
    xh = F.coalesce(F.col("xh").cast("double"), F.col("max_asc") * 0.5)
    return m.select("face", "max_asc", xh.alias("xh"), F.coalesce(F.col("cap").cast("double"), xh / 0.7).alias("cap"))


@query(sql(_MET + " SELECT face, max_asc, coalesce(CAST(xh AS DOUBLE), max_asc * 0.5e0) AS xh, coalesce(CAST(cap AS DOUBLE), coalesce(CAST(xh AS DOUBLE), max_asc * 0.5e0) / 0.7e0) AS cap FROM met", "pixels_v"))
def face_metrics(spark, d):
    return metrics(ascents(spark, d))


@query(sql(_MET + " SELECT sheet_id, CAST(width + 2 * greatest(1, floor(0.3e0 * (max_asc / 0.8e0) + 0.5)) AS BIGINT) AS advance FROM asc_v JOIN met USING (face) WHERE area > 0", "pixels_v"))
def complete_outlines(spark, d):
    """Advances of whole outlines: the box and a pad on both sides that is a share of the face's scale."""
    g = ascents(spark, d)
    pad = F.greatest(F.lit(1), S.half_up(0.3 * (F.col("max_asc") / 0.8)))
    return g.filter("area > 0").join(metrics(g).select("face", "max_asc"), "face").select("sheet_id", (F.col("width") + 2 * pad).alias("advance"))


#: Letters that leave high, and those that leave by a descender (fixed values).
HIGH_EXIT, DESC_EXIT = "ovwbdsur", "gjqyz"


@query(sql(f""", c AS (SELECT id, substr(name, CAST(id % length(name) AS INT) + 1, 1) AS ch, glyph_count AS n FROM fonts_v), j AS (SELECT *, regexp_matches(ch, '^[A-Za-z]$') AND regexp_matches(ch, '^[a-z]$') AS l, regexp_matches(ch, '^[A-Za-z]$') AS r FROM c),
a AS (SELECT *, CASE WHEN l THEN least(n % 7, id % 5 - 1) ELSE id % 5 - 1 - 3 END AS la, CASE WHEN r THEN n + 20 - 2 ELSE n + 20 + 3 END AS ra FROM j)
SELECT id, CASE WHEN ch = ' ' THEN 'space' WHEN r THEN 'join' ELSE 'break' END AS kind, l AS joins_left, r AS joins_right, r AND contains('{HIGH_EXIT}', ch) AND NOT contains('{DESC_EXIT}', ch) AS high_exit, -la AS dx, greatest(24, ra - la) AS advance FROM a""", "fonts_v"))
def join_advance(spark, d):
    """How a character joins its neighbours, and its shift and advance from the plugs and the ink: capitals join only to the right."""
    at = (F.col("id") % F.length("name") + 1).cast("int")
    c = fonts(spark, d).select("id", F.substring(F.col("name"), at, F.lit(1)).alias("ch"), F.col("glyph_count").alias("n"))
    letter, lower = F.col("ch").rlike("^[A-Za-z]$"), F.col("ch").rlike("^[a-z]$")
    pad, overlap, least = 3, 2, 24
    ink, plug = F.col("id") % 5 - 1, F.col("n") % 7
    left = F.when(lower, F.least(plug, ink)).otherwise(ink - pad)
    right = F.when(letter, F.col("n") + 20 - overlap).otherwise(F.col("n") + 20 + pad)
    high = letter & F.lit(HIGH_EXIT).contains(F.col("ch")) & ~F.lit(DESC_EXIT).contains(F.col("ch"))
    kind = F.when(F.col("ch") == " ", "space").when(letter, "join").otherwise("break")
    return c.select("id", kind.alias("kind"), lower.alias("joins_left"), letter.alias("joins_right"), high.alias("high_exit"), (-left).alias("dx"), F.greatest(F.lit(least), right - left).alias("advance"))


_SIDE = "count(*) FILTER (WHERE {0}) >= 3"


@query(sql(_PROF + """, h AS (SELECT face // 2 AS pair, face % 2 AS side, ch, height * CASE WHEN face % 2 = 1 THEN 1 + face % 3 ELSE 1 END AS h FROM prof WHERE height > 0),
m AS (SELECT pair, side, CASE WHEN count(*) FILTER (WHERE contains('acemnorsuvwxz', ch)) >= 3 THEN median(h) FILTER (WHERE contains('acemnorsuvwxz', ch)) END AS low,
CASE WHEN count(*) FILTER (WHERE contains('BEFHIKLMNPTXYZ', ch)) >= 3 THEN median(h) FILTER (WHERE contains('BEFHIKLMNPTXYZ', ch)) WHEN count(*) FILTER (WHERE regexp_matches(ch, '[A-Z]')) >= 3 THEN median(h) FILTER (WHERE regexp_matches(ch, '[A-Z]')) END AS cap FROM h GROUP BY 1, 2),
r AS (SELECT a.pair, coalesce(a.low / b.low, a.cap / b.cap) AS r FROM m a JOIN m b ON a.pair = b.pair AND a.side = 0 AND b.side = 1) SELECT pair, round(CASE WHEN r < 0.72 OR r > 1.38 THEN r ELSE 1 END, 6) AS scale FROM r""", "pixels_v"))
def sheet_scale(spark, d):
    """The factor that brings a variant sheet to its base's size, by median heights of small letters, else capitals; near 1 nothing is done."""
    h = F.col("height") * F.when(F.col("face") % 2 == 1, 1 + F.col("face") % 3).otherwise(1)
    p = profiles(spark, d).filter("height > 0").select(F.floor(F.col("face") / 2).alias("pair"), (F.col("face") % 2).alias("side"), "ch", h.alias("h"))

    def median(side, chars):
        mine = (F.col("side") == side) & F.col("ch").rlike(chars)
        return F.when(F.count_if(mine) >= 3, S.middle_median(F.when(mine, F.col("h"))))

    low, cap, any_cap = "^[acemnorsuvwxz]$", "^[BEFHIKLMNPTXYZ]$", "^[A-Z]$"
    m = p.groupBy("pair").agg(*[median(k, c).alias(f"{n}{k}") for k in (0, 1) for n, c in (("low", low), ("cap", cap), ("any", any_cap))])
    m = m.withColumn("r", F.coalesce(F.col("low0") / F.col("low1"), F.coalesce("cap0", "any0") / F.coalesce("cap1", "any1")))
    apart = (F.col("r") < 0.72) | (F.col("r") > 1.38)
    return m.select("pair", F.round(F.when(apart, F.col("r")).otherwise(1.0), 6).alias("scale"))


JOINERS = 4  # fewer have no standard join
_MED = "list_sort(list({0}))[len(list({0})) // 2 + 1]"


@query(sql(_PROF + f""", e AS (SELECT face, ch, width AS reach, height / 8 AS tip, width - 4 AS dx, base - 4 AS dy FROM prof WHERE width >= 7), m AS (SELECT face, ch, count(*) AS n, {', '.join(_MED.format(c) + ' AS ' + c for c in ('reach', 'tip', 'dx', 'dy'))} FROM e GROUP BY 1, 2)
SELECT face, ch, CASE WHEN n >= {JOINERS} THEN reach END AS reach, CASE WHEN n >= {JOINERS} THEN tip END AS tip, CASE WHEN n >= {JOINERS} THEN round(dx / greatest(1e-6, sqrt(dx * dx + dy * dy)), 6) END AS dx, CASE WHEN n >= {JOINERS} THEN round(dy / greatest(1e-6, sqrt(dx * dx + dy * dy)), 6) END AS dy FROM m""", "pixels_v"))
def standard_join(spark, d):
    """Upper medians of the entries of a group part by part, the direction as a unit vector; nulls for fewer than four."""
    p = profiles(spark, d).filter("width >= 7").select("face", "ch", F.col("width").alias("reach"), (F.col("height") / 8).alias("tip"), (F.col("width") - 4).alias("dx"), (F.col("base") - 4).alias("dy"))
    m = p.groupBy("face", "ch").agg(F.count(F.lit(1)).alias("n"), *[S.upper_median(F.col(c)).alias(c) for c in ("reach", "tip", "dx", "dy")])
    enough, size = F.col("n") >= JOINERS, F.greatest(F.lit(1e-6), F.hypot("dx", "dy"))
    return m.select("face", "ch", F.when(enough, F.col("reach")).alias("reach"), F.when(enough, F.col("tip")).alias("tip"), *[F.when(enough, F.round(F.col(c) / size, 6)).alias(c) for c in ("dx", "dy")])


@query(sql(""", r AS (SELECT sheet_id, y, min(x) AS l, max(x) + 1 AS r FROM pixels_v WHERE ink GROUP BY 1, 2), b AS (SELECT sheet_id, min(y) AS top, max(y) + 1 AS bottom, max(r) - min(l) AS w FROM r GROUP BY 1),
f AS (SELECT b.sheet_id, min(y) AS y FROM r JOIN b ON b.sheet_id = r.sheet_id WHERE r - l >= w * 0.5 GROUP BY 1), k AS (SELECT sheet_id, min(y) AS s, max(y) + 1 AS e FROM (SELECT sheet_id, y, y - row_number() OVER (PARTITION BY sheet_id ORDER BY y) AS g FROM r) GROUP BY sheet_id, g),
m AS (SELECT sheet_id, arg_min({'s': s, 'e': e}, {'h': s - e, 's': s}) AS m FROM k GROUP BY 1)
SELECT sheet_id, top, bottom, greatest(CAST(top AS DOUBLE), least(bottom - 0.01e0, y + 0.5e0)) AS body_top, m.m.s AS main_top, m.m.e AS main_bottom FROM b LEFT JOIN f USING (sheet_id) JOIN m USING (sheet_id)""", "pixels_v"))
def baseline_bounds(spark, d):
    """The box of a glyph's ink, the first row at least half as wide as it, and the tallest run of rows (of equals the first)."""
    r = pixels(spark, d).filter("ink").groupBy("sheet_id", "y").agg(F.min("x").alias("l"), (F.max("x") + 1).alias("r"))
    each = Window.partitionBy("sheet_id")
    r = r.withColumns({"w": F.max("r").over(each) - F.min("l").over(each), "g": F.col("y") - F.row_number().over(each.orderBy("y"))})
    k = r.groupBy("sheet_id", "g").agg(F.min("y").alias("s"), (F.max("y") + 1).alias("e"), F.min(F.when(F.col("r") - F.col("l") >= F.col("w") * 0.5, F.col("y"))).alias("wide"))
    b = k.groupBy("sheet_id").agg(F.min("s").alias("top"), F.max("e").alias("bottom"), F.min("wide").alias("wide"), F.min(F.struct((F.col("s") - F.col("e")).alias("h"), "s", "e")).alias("m"))
    body = F.greatest(F.col("top").cast("double"), F.least(F.col("bottom") - 0.01, F.col("wide") + 0.5))
    return b.select("sheet_id", "top", "bottom", body.alias("body_top"), F.col("m.s").alias("main_top"), F.col("m.e").alias("main_bottom"))


@query(sql(_PROF + """, i AS (SELECT face, ch, sheet_id AS gid, row_number() OVER (PARTITION BY face, ch ORDER BY sheet_id) - 1 AS k FROM prof)
SELECT face, ch AS base, min(gid) FILTER (WHERE k = 0) AS base_gid, string_agg('cv0' || k || ':' || gid, ' ' ORDER BY k) FILTER (WHERE k > 0) AS variants FROM i GROUP BY 1, 2 HAVING NOT (face % 3 = 0 AND ch = 'z') AND max(k) > 0""", "pixels_v"))
def variant_groups(spark, d):
    """Variants under their base by number; bases without variants and variants without a base (here some ``z``) are left out."""
    i = profiles(spark, d).select("face", "ch", F.col("sheet_id").alias("gid"), (F.row_number().over(Window.partitionBy("face", "ch").orderBy("sheet_id")) - 1).alias("k"))
    i = i.filter(~((F.col("k") == 0) & (F.col("face") % 3 == 0) & (F.col("ch") == "z")))
    g = i.groupBy("face", F.col("ch").alias("base")).agg(F.min(F.when(F.col("k") == 0, F.col("gid"))).alias("base_gid"), F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "gid")))).alias("v"))
    name = lambda v: F.concat(F.lit("cv0"), v["k"].cast("string"), F.lit(":"), v["gid"].cast("string"))
    return g.filter("base_gid is not null and size(v) > 0").select("face", "base", "base_gid", F.array_join(F.transform("v", name), " ").alias("variants"))


SHADOW = 0.5
_MASK = "CAST(embedding[i + 1] AS DOUBLE) {0}"
_COMP = f"""WITH p AS (SELECT vec_id, vec_id // 64 AS page, i % 8 AS x, i // 8 AS y, {_MASK.format('< -0.03e0')} AS dark, {_MASK.format('> 0.03e0')} AS bright FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)),
comp AS (SELECT page, vec_id, count(*) FILTER (WHERE dark) AS dc, count(*) FILTER (WHERE bright) AS bc, CAST(sum(x) FILTER (WHERE dark) AS BIGINT) / count(*) FILTER (WHERE dark) - CAST(sum(x) FILTER (WHERE bright) AS BIGINT) / count(*) FILTER (WHERE bright) AS ox,
CAST(sum(y) FILTER (WHERE dark) AS BIGINT) / count(*) FILTER (WHERE dark) - CAST(sum(y) FILTER (WHERE bright) AS BIGINT) / count(*) FILTER (WHERE bright) AS oy, max(x) FILTER (WHERE dark OR bright) - min(x) FILTER (WHERE dark OR bright) + 1 AS wd FROM p GROUP BY 1, 2)"""


def shadow_parts(spark, d):
    """Per component (a cell) the sizes of its dark and its bright mask, the offset of their centres and its width; counted in the row."""
    e = F.col("embedding")
    dark, bright = (lambda z: z.cast("double") < -0.03), (lambda z: z.cast("double") > 0.03)
    total = lambda mask, value: F.aggregate(F.transform(e, lambda z, i: F.when(mask(z), value(i)).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    one, col, row = (lambda i: F.lit(1)), (lambda i: i % 8), (lambda i: F.floor(i / 8))
    mean = lambda mask, value: total(mask, value) / total(mask, one)
    xs = F.filter(F.transform(e, lambda z, i: F.when(dark(z) | bright(z), i % 8)), lambda x: x.isNotNull())
    v = table(spark, d, "embeddings").withColumn("_some", (total(dark, one) > 0) & (total(bright, one) > 0))
    offset = lambda axis: F.when(F.col("_some"), mean(dark, axis) - mean(bright, axis))
    return v.select(
        F.expr("vec_id div 64").alias("page"), "vec_id", total(dark, one).alias("dc"), total(bright, one).alias("bc"), offset(col).alias("ox"), offset(row).alias("oy"), (F.array_max(xs) - F.array_min(xs) + 1).cast("long").alias("wd")
    )


@query(_COMP + " SELECT page, vec_id, dc, bc, round(ox, 6) AS ox, round(oy, 6) AS oy, wd FROM comp")
def shadow_offsets(spark, d):
    return shadow_parts(spark, d).withColumns({"ox": F.round("ox", 6), "oy": F.round("oy", 6)})


@query(_COMP + f""", m AS (SELECT *, sqrt(ox * ox + oy * oy) AS m, dc >= 20 AND bc >= 20 AND sqrt(ox * ox + oy * oy) >= 0.5 AND sqrt(ox * ox + oy * oy) <= 0.4 * wd AS fits FROM comp),
s AS (SELECT page, sum(ox * dc) FILTER (WHERE fits) / sum(dc) FILTER (WHERE fits) AS dx, sum(oy * dc) FILTER (WHERE fits) / sum(dc) FILTER (WHERE fits) AS dy, CAST(sum(dc) AS BIGINT) AS n FROM m GROUP BY 1),
k AS (SELECT page, any_value(n) AS n, count(*) FILTER (WHERE ok) AS paired, coalesce(CAST(sum(dc) FILTER (WHERE ok) AS BIGINT), 0) AS shadow FROM (SELECT m.*, n, fits AND (ox * dx + oy * dy) / (m * coalesce(nullif(sqrt(dx * dx + dy * dy), 0), 1)) >= 0.7 AS ok FROM m JOIN s USING (page)) GROUP BY 1)
SELECT page, paired, round(coalesce(shadow / nullif(n, 0), 0), 6) AS score, coalesce(shadow / nullif(n, 0), 0) >= {SHADOW} AND paired >= 3 AS offset_shadow FROM k""")
def shadow_direction(spark, d):
    """Whether the components of a page agree on a direction in which their dark mask is offset; offsets count from half a pixel here."""
    each = Window.partitionBy("page")
    m = F.hypot("ox", "oy")
    c = shadow_parts(spark, d).withColumn("m", m).withColumn("fits", F.coalesce((F.col("dc") >= 20) & (F.col("bc") >= 20) & (F.col("m") >= 0.5) & (F.col("m") <= 0.4 * F.col("wd")), F.lit(False)))
    kept = lambda x: F.sum(F.when(F.col("fits"), x)).over(each)
    c = c.withColumns({"dx": kept(F.col("ox") * F.col("dc")) / kept(F.col("dc")), "dy": kept(F.col("oy") * F.col("dc")) / kept(F.col("dc"))})
    size = F.coalesce(F.nullif(F.hypot("dx", "dy"), F.lit(0.0)), F.lit(1.0))
    ok = F.col("fits") & ((F.col("ox") * F.col("dx") + F.col("oy") * F.col("dy")) / (F.col("m") * size) >= 0.7)
    k = c.groupBy("page").agg(F.count_if(ok).alias("paired"), F.coalesce(F.sum(F.when(ok, F.col("dc"))), F.lit(0)).alias("shadow"), F.sum("dc").alias("n"))
    score = F.coalesce(F.try_divide("shadow", "n"), F.lit(0.0))
    return k.select("page", "paired", F.round(score, 6).alias("score"), ((score >= SHADOW) & (F.col("paired") >= 3)).alias("offset_shadow"))


#: Letters with an enclosed counter (fixed values).
COUNTERS = "ABDOPQRabdegopq04689"


@query(sql(_PROF + f", c AS (SELECT face, count(*) AS counters, count(*) FILTER (WHERE hole_area < 0.006 * area) AS filled FROM prof JOIN ({SQL['hole_area']}) h USING (sheet_id) WHERE area > 0 AND contains('{COUNTERS}', ch) GROUP BY face) SELECT face, counters, filled, counters >= 6 AND filled / counters >= 0.5 AS glow FROM c", "pixels_v"))
def glow_warning(spark, d):
    """Faces in which at least half of six or more letters with a counter have it closed."""
    p = profiles(spark, d).filter((F.col("area") > 0) & F.lit(COUNTERS).contains(F.col("ch"))).join(hole_area(spark, d), "sheet_id")
    c = p.groupBy("face").agg(F.count(F.lit(1)).alias("counters"), F.count_if(F.col("hole_area") < 0.006 * F.col("area")).alias("filled"))
    return c.select("face", "counters", "filled", ((F.col("counters") >= 6) & (F.col("filled") / F.col("counters") >= 0.5)).alias("glow"))


_BOXES = """CAST(id AS BIGINT) AS id, id // 24 AS sheet, id % 24 AS k, CASE WHEN id % 24 < 8 THEN id % 24 * 40 ELSE id * 37 % 320 END AS x1, CASE WHEN id % 24 < 8 THEN 40 + id * 7 % 5 ELSE id * 13 % 90 END AS y1,
CASE WHEN id % 24 < 8 THEN 20 + n % 15 ELSE 3 + n % 25 END AS w, CASE WHEN id % 24 < 8 THEN 30 + n % 20 ELSE 2 + n % 20 END AS h"""


@query(sql(f""", b AS (SELECT {_BOXES} FROM (SELECT id, glyph_count AS n FROM fonts_v)), j AS (SELECT m.id AS mark, c.k, c.k % 2 = 0 AS accented, m.y1 >= c.y1 AND m.y1 + m.h <= c.y1 + c.h AND greatest(0, c.x1 - m.x1 - m.w, m.x1 - c.x1 - c.w) <= greatest(2, c.h * 0.12e0) AS within,
m.h <= c.h * 0.55e0 AND m.w <= c.h * 0.9e0 AND m.w * m.h * 0.5e0 <= c.w * c.h * 0.6e0 * 0.75e0 AS small, greatest(0, c.y1 - m.y1 - m.h, m.y1 - c.y1 - c.h) / c.h + 0.25e0 * abs((2 * m.x1 + m.w - 2 * c.x1 - c.w) / 2) / greatest(c.w, c.h * 0.5e0) AS score
FROM b m JOIN b c ON c.sheet = m.sheet AND m.k >= 8 AND c.k < 8) SELECT mark, arg_min(k, {{'s': score, 'k': k}}) FILTER (WHERE accented AND small) AS cell FROM j GROUP BY mark HAVING NOT bool_or(within) AND count(*) FILTER (WHERE accented AND small) > 0""", "fonts_v"))
def mark_owners(spark, d):
    """Detached marks and the accented cell of their sheet that they fit best; ink within a letter's height beside it is that letter's."""
    b = fonts(spark, d).select("id", F.col("glyph_count").alias("n")).selectExpr(*_box_columns())
    box = ("k", "x1", "y1", "w", "h")
    cells = b.filter("k < 8").groupBy("sheet").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in box])).alias("cells"))
    m = {n: F.col(n) for n in box}

    def judged(c):
        off = lambda a, s: F.greatest(F.lit(0), c[a] - m[a] - m[s], m[a] - c[a] - c[s])
        within = (m["y1"] >= c["y1"]) & (m["y1"] + m["h"] <= c["y1"] + c["h"]) & (off("x1", "w") <= F.greatest(F.lit(2.0), c["h"] * 0.12))
        small = (m["h"] <= c["h"] * 0.55) & (m["w"] <= c["h"] * 0.9) & (m["w"] * m["h"] * 0.5 <= c["w"] * c["h"] * 0.6 * 0.75)
        apart = F.abs((2 * m["x1"] + m["w"] - 2 * c["x1"] - c["w"]) / 2)
        score = off("y1", "h") / c["h"] + 0.25 * apart / F.greatest(c["w"].cast("double"), c["h"] * 0.5)
        return F.struct(within.alias("within"), F.when((c["k"] % 2 == 0) & small, F.struct(score.alias("s"), c["k"].alias("k"))).alias("fit"))

    # a mark is judged in its row, against the few cells of its sheet: pairs of marks and cells are not rows
    j = b.filter("k >= 8").join(cells, "sheet").select(F.col("id").alias("mark"), F.transform("cells", judged).alias("j"))
    each = j.select("mark", F.array_max("j.within").alias("within"), F.array_min("j.fit").alias("best"))
    g = each.groupBy("mark").agg(F.bool_or("within").alias("within"), F.min("best").alias("best"))  # ids may come again
    return g.filter("not within and best is not null").select("mark", F.col("best.k").alias("cell"))


def _box_columns() -> list[str]:
    cell = "id % 24 < 8"
    return [
        "id", "id div 24 AS sheet", "id % 24 AS k", f"IF({cell}, id % 24 * 40, id * 37 % 320) AS x1", f"IF({cell}, 40 + id * 7 % 5, id * 13 % 90) AS y1",
        f"IF({cell}, 20 + n % 15, 3 + n % 25) AS w", f"IF({cell}, 30 + n % 20, 2 + n % 20) AS h",
    ]


_CAND = "l_orderkey AS part, l_linenumber AS place, l_partkey AS kind, CAST(l_quantity AS BIGINT) % 4 AS n, CAST(l_discount AS DOUBLE) AS off_ink, 1 - CAST(l_tax AS DOUBLE) * 5 AS cover"


@query(f""", t AS (SELECT *, CASE WHEN n > 0 AND off_ink <= 0.05e0 AND cover >= 0.8e0 THEN 0 WHEN n > 0 THEN 1 ELSE 2 END AS tier FROM c)
SELECT part, place, kind, tier FROM t QUALIFY row_number() OVER (PARTITION BY part ORDER BY tier, CASE WHEN tier < 2 THEN n END, CASE WHEN tier < 2 THEN -cover END, CASE WHEN tier < 2 THEN kind % 5 END, place, kind) = 1""".replace(", t AS", f"WITH c AS (SELECT {_CAND} FROM lineitem), t AS", 1))
def candidate_choice(spark, d):
    """Per part the candidate with fewest strokes, then best cover, then priority, of those that fit, else of those with strokes, else the first."""
    c = table(spark, d, "lineitem").selectExpr(*_CAND.split(", "))
    fits = (F.col("off_ink") <= 0.05) & (F.col("cover") >= 0.8)
    tier = F.when(F.col("n") > 0, F.when(fits, 0).otherwise(1)).otherwise(2)
    ranked = [F.when(F.col("n") > 0, x).alias(f"r{k}") for k, x in enumerate((F.col("n"), -F.col("cover"), F.col("kind") % 5))]
    best = c.groupBy("part").agg(F.min(F.struct(tier.alias("tier"), *ranked, "place", "kind")).alias("b"))
    return best.select("part", "b.place", "b.kind", "b.tier")


_V = {n: [f"(CAST(embedding[{k + c + 1}] AS DOUBLE) - CAST(embedding[{4 + c}] AS DOUBLE)) * 255" for c in range(3)] for n, k in (("d", 0), ("u", 6), ("v", 9))}


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in range(3)) + ")"


@query("WITH q AS (SELECT vec_id, " + ", ".join(f"{e} AS {n}{k}" for n, es in _V.items() for k, e in enumerate(es)) + f""" FROM embeddings), t AS (SELECT *, {_dot('u', 'u')} AS uu, {_dot('u', 'v')} AS uv, {_dot('v', 'v')} AS vv, {_dot('d', 'u')} AS du, {_dot('d', 'v')} AS dv FROM q),
s AS (SELECT *, CASE WHEN uu * vv - uv * uv > 1e-6 THEN (du * vv - dv * uv) / (uu * vv - uv * uv) END AS x, CASE WHEN uu * vv - uv * uv > 1e-6 THEN (dv * uu - du * uv) / (uu * vv - uv * uv) END AS y FROM t)
SELECT vec_id, CASE WHEN x >= 0 AND y >= 0 AND x + y <= 1 THEN round({' + '.join(f'(d{k} - x * u{k} - y * v{k}) * (d{k} - x * u{k} - y * v{k})' for k in range(3))}, 3) END AS dist2 FROM s""")
def blend_triangle(spark, d):
    """Squared distance of a colour to the blends of three others; null outside their triangle or where they stand in a line."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    p, u, v = [[(at(k + c) - at(3 + c)) * 255 for c in range(3)] for k in (0, 6, 9)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    uu, uv, vv, pu, pv = dot(u, u), dot(u, v), dot(v, v), dot(p, u), dot(p, v)
    det = uu * vv - uv * uv
    t = table(spark, d, "embeddings").withColumns({"x": F.when(det > 1e-6, (pu * vv - pv * uv) / det), "y": F.when(det > 1e-6, (pv * uu - pu * uv) / det)})
    rest = [p[k] - F.col("x") * u[k] - F.col("y") * v[k] for k in range(3)]
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("y") <= 1)
    return t.select("vec_id", F.when(inside, F.round(dot(rest, rest), 3)).alias("dist2"))


@query(sql("SELECT owner_id, id, visibility, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id) AS place FROM owned_v", "owned_v"))
def account_items(spark, d):
    """An account's own items, the newest first."""
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "id"))
    return owned(spark, d).select("owner_id", "id", "visibility", place.cast("long").alias("place"))


_LINE = "CASE id % 4 WHEN 0 THEN name || 'e' || {0} WHEN 1 THEN name || 'x' || {0} WHEN 2 THEN '' ELSE name END"


@query(sql(", l AS (SELECT id, " + _LINE.format("chr(769)") + " AS line FROM fonts_v) SELECT id, length(nfc_normalize(line)) AS size, NOT regexp_matches(nfc_normalize(line), '\\p{M}') AS accepted FROM l WHERE line <> ''", "fonts_v"))
def charset_check(spark, d):
    """Composed lines of a charset, empty ones dropped; those that keep a combining mark of its own are refused."""
    ship(spark)
    line = X.nfc(F.expr(_LINE.format("decode(unhex('CC81'), 'UTF-8')")))
    c = fonts(spark, d).select("id", line.alias("line")).filter("line <> ''")
    return c.select("id", F.length("line").cast("long").alias("size"), (~F.col("line").rlike(r"\p{M}")).alias("accepted"))
