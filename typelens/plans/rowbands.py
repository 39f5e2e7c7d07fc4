"""Rows of sheets repaired and found. The sheets are strips (one column of a page's cells, 64 lines) and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as B
from ..sources.shipping import ship
from . import query
from .sheets import _PAGE, _STRIP, DARK, page_pixels, strip_bands, strip_rows

LEAST = 6  # the least lines of a row: strips are low
_REC = _STRIP.replace("WITH page_v", "WITH RECURSIVE page_v")
_RUNS = ", r0 AS (SELECT strip, min(y) AS start, max(y) + 1 AS stop FROM (SELECT strip, y, y - row_number() OVER (PARTITION BY strip ORDER BY y) AS k FROM strip_v WHERE width > {over}) GROUP BY strip, k), b0 AS (SELECT strip, list({{'start': start, 'stop': stop}} ORDER BY start) AS bs FROM r0 GROUP BY strip)"


def strip_ink(spark, d):
    """Ink per line of a strip, as one array."""
    w = strip_rows(spark, d).groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("y", "width"))).alias("r"))
    return w.select("strip", F.transform("r", lambda r: r["width"]).alias("ink"))


def _each(df, column):
    return df.select("strip", F.explode(column).alias("b")).select("strip", "b.start", "b.stop")


_MERGE = "list_concat(bs[:i - 1], [{'start': bs[i].start, 'stop': bs[i + 1].stop}], bs[i + 2:])"


@query(_REC + _RUNS.format(over=2) + f""", t AS (SELECT *, list_filter(hs, lambda h: h >= hs[-1] * 0.1e0) AS tall FROM (SELECT strip, bs, list_sort(list_transform(bs, lambda b: b.stop - b.start)) AS hs FROM b0)),
f AS (SELECT strip, bs, tall[len(tall) // 2 + 1] AS typical, 0 AS i FROM t UNION ALL SELECT strip, {_MERGE}, typical, i FROM (SELECT strip, bs, typical, CASE WHEN p[2] = 1 OR (p[2] < len(bs) AND bs[p[2] + 1].start - bs[p[2]].stop < bs[p[2]].start - bs[p[2] - 1].stop) THEN p[2] ELSE p[2] - 1 END AS i
FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(bs) + 1), lambda k: [bs[k].stop - bs[k].start, k, least(CASE WHEN k > 1 THEN bs[k].start - bs[k - 1].stop ELSE 1000000 END, CASE WHEN k < len(bs) THEN bs[k + 1].start - bs[k].stop ELSE 1000000 END)]),
    lambda x: x[1] < typical * 0.25e0 AND x[3] <= greatest(2, typical * 0.05e0)))[1] AS p FROM f) WHERE p IS NOT NULL))
SELECT strip, u.start AS start, u.stop AS stop FROM (SELECT strip, unnest(arg_min(bs, len(bs))) AS u FROM f GROUP BY strip)""")
def sliver_fold(spark, d):
    """Bands of lines with three pixels of ink or more, slivers folded into the rows that they nearly touch."""
    return _each(strip_bands(spark, d, 2), B.folded(F.col("bs")))


_WANT = "CASE strip % 3 WHEN 0 THEN ['AB', 'cd'] WHEN 1 THEN ['ab', '', 'cd', 'ef'] ELSE ['a', 'b', 'c', 'd', 'e'] END"


@query(_REC + _RUNS.format(over=1) + f""", g AS (SELECT strip, bs, len(list_filter({_WANT}, lambda t: t <> '')) AS n FROM b0),
f AS (SELECT strip, bs, n, (bs[-1].stop - bs[1].start) / n AS pitch, 0 AS i FROM g UNION ALL SELECT strip, {_MERGE}, n, pitch, i FROM (SELECT strip, bs, n, pitch, CAST(c[2] AS INT) AS i FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(bs)), lambda k:
    CASE WHEN bs[k + 1].start - bs[k].stop <= greatest(ty * 0.45e0, pitch * 0.25e0) AND bs[k + 1].stop - bs[k].start <= greatest(ty * 1.65e0, pitch * 0.92e0) AND NOT (least(bs[k].stop - bs[k].start, bs[k + 1].stop - bs[k + 1].start) > ty * 0.62e0 AND bs[k + 1].stop - bs[k].start > pitch * 0.88e0)
    THEN [bs[k + 1].start - bs[k].stop + least(bs[k].stop - bs[k].start, bs[k + 1].stop - bs[k + 1].start) * 0.35e0, k] END), lambda x: x IS NOT NULL))[1] AS c
FROM (SELECT *, hs[least(n, len(hs)) // 2 + 1] AS ty FROM (SELECT *, list_reverse_sort(list_transform(bs, lambda b: b.stop - b.start)) AS hs FROM f)) WHERE len(bs) > n) WHERE c IS NOT NULL))
SELECT strip, u.start AS start, u.stop AS stop FROM (SELECT strip, unnest(arg_min(bs, len(bs))) AS u FROM f GROUP BY strip)""")
def band_reconcile(spark, d):
    """Bands of lines with two pixels of ink or more, brought to the number of lines of the text where pieces of rows are too many."""
    lines = F.when(F.col("strip") % 3 == 0, F.array(*map(F.lit, ("AB", "cd")))).when(F.col("strip") % 3 == 1, F.array(*map(F.lit, ("ab", "", "cd", "ef")))).otherwise(F.array(*map(F.lit, "abcde")))
    return _each(strip_bands(spark, d, 1), B.reconciled(F.col("bs"), F.lit(None).cast("array<bigint>"), lines))


_INK = ", ink_v AS (SELECT strip, list(width ORDER BY y) AS ink FROM strip_v GROUP BY 1)"
_VALLEY = f"""(SELECT *, list_sort(list_filter(list_transform(range({LEAST}, CAST(len(s) - {LEAST} + 1 AS INT)), lambda i: CASE WHEN s[i + 1] <= 0.25e0 * least(list_max(s[:i]), coalesce(list_max(s[i + 2:]), 0)) THEN [s[i + 1], i] END), lambda x: x IS NOT NULL))[1] AS v FROM
(SELECT *, list_transform(range(y0, y1 + 1), lambda i: list_avg(ink[greatest(i - 2, y0) + 1:least(i + 2, y1) + 1])) AS s FROM {{src}}))"""


@query(_REC + _RUNS.format(over=1) + _INK + f""", p AS (SELECT r0.strip, start AS y0, stop - 1 AS y1, ink, 0 AS t FROM r0 JOIN ink_v USING (strip) UNION ALL
SELECT strip, CASE WHEN h = 0 THEN y0 ELSE y0 + CAST(v[2] AS INT) + 1 END, CASE WHEN h = 0 THEN y0 + CAST(v[2] AS INT) - 1 ELSE y1 END, ink, t + 1 FROM {_VALLEY.format(src="p")}, range(0, 2) q(h) WHERE y1 - y0 + 1 >= {2 * LEAST} AND list_max(s) > 0 AND v IS NOT NULL),
leaf AS (SELECT strip, y0, y1 FROM {_VALLEY.format(src="p")} WHERE y1 - y0 + 1 < {2 * LEAST} OR list_max(s) <= 0 OR v IS NULL),
o AS (SELECT strip, count(*) AS n, max(y1 - y0 + 1) / greatest(1, min(y1 - y0 + 1)) AS ratio FROM leaf GROUP BY 1), i AS (SELECT strip, count(*) AS n, list_sort(list(stop - start)) AS hs FROM r0 GROUP BY 1),
keep AS (SELECT strip, o.n <= i.n OR (i.n >= 5 AND o.n > 9 AND hs[-1] <= hs[i.n // 2 + 1] * 1.55e0) OR ratio > 2.6e0 AS old FROM o JOIN i USING (strip))
SELECT strip, start, stop FROM r0 JOIN keep USING (strip) WHERE old UNION ALL SELECT strip, y0, y1 + 1 FROM leaf JOIN keep USING (strip) WHERE NOT old""")
def band_valleys(spark, d):
    """Bands parted at valleys, the parts again, unless rows of very different heights come of it."""
    ship(spark)
    t = strip_bands(spark, d, 1).join(strip_ink(spark, d), "strip")
    return _each(t, B.part_bands(LEAST)("ink", "bs", F.lit(None).cast("int")))


@query(None)
def band_valleys_capped(spark, d):
    """The highest bands parted first, up to six bands."""
    ship(spark)
    t = strip_bands(spark, d, 1).join(strip_ink(spark, d), "strip")
    return _each(t, B.part_bands(LEAST)("ink", "bs", F.lit(6)))


def page_ink(spark, d):
    """Ink per line of a page, as one array; pages without ink too."""
    rows = page_pixels(spark, d).groupBy("page", "y").agg(F.count_if(F.col("opaque") & (F.col("luma") < DARK)).alias("n"))
    g = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("r"))
    return g.select("page", F.transform("r", lambda r: r["n"]).alias("ink"))


_SPAN = """, sp AS (SELECT *, list_position(list_transform(ink, lambda v: v > 0), true) - 1 AS a, len(ink) - list_position(list_reverse(list_transform(ink, lambda v: v > 0)), true) AS b FROM ink_v WHERE list_max(ink) > 0),
sm AS (SELECT *, list_transform(range(a, b + 1), lambda i: list_avg(ink[greatest(i - 1, a) + 1:least(i + 1, b) + 1])) AS s FROM sp),
pk AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: s[i] >= list_max(ink) * 0.04e0 AND s[i] >= list_max(s[greatest(i - 2, 1):i + 2])) AS c FROM sm),
ps AS (SELECT *, list_reduce(list_transform(c, lambda y: [y]), lambda k, y: CASE WHEN y[1] - k[-1] > 2 THEN list_concat(k, y) WHEN s[y[1]] > s[k[-1]] THEN list_concat(k[:-2], y) ELSE k END) AS p FROM pk),
ct AS (SELECT *, list_filter(list_transform(range(1, len(p)), lambda i: CASE WHEN list_min(s[p[i]:p[i + 1]]) <= 0.5e0 * least(s[p[i]], s[p[i + 1]]) THEN a + p[i] + list_position(s[p[i]:p[i + 1]], list_min(s[p[i]:p[i + 1]])) - 2 END), lambda x: x IS NOT NULL) AS cuts FROM ps),
bd AS (SELECT *, CASE WHEN len(p) > 1 THEN list_concat([a], cuts, [b + 1]) ELSE [a, b + 1] END AS bounds FROM ct),
bn AS (SELECT strip, i, min(y) AS start, max(y) + 1 AS stop FROM (SELECT *, unnest(range(0, len(ink))) AS y FROM (SELECT *, unnest(range(1, len(bounds))) AS i FROM bd)) WHERE y >= bounds[i] AND y < bounds[i + 1] AND ink[y + 1] > 0 GROUP BY 1, 2),
bl AS (SELECT strip, list({'start': start, 'stop': stop} ORDER BY start) AS bs FROM bn GROUP BY 1),
gp AS (SELECT *, list_sort(list_transform(range(2, len(bs) + 1), lambda i: (bs[i].start + bs[i].stop) / 2 - (bs[i - 1].start + bs[i - 1].stop) / 2)) AS gs FROM bl),
mg AS (SELECT strip, CASE WHEN len(bs) <= 2 THEN bs ELSE list_reduce(list_transform(bs, lambda z: [z]), lambda x, r: CASE WHEN (r[1].start + r[1].stop) / 2 - (x[-1].start + x[-1].stop) / 2 < 0.75 * gs[len(gs) // 2 + 1] THEN list_concat(x[:-2], [{'start': x[-1].start, 'stop': r[1].stop}]) ELSE list_concat(x, r) END) END AS bs FROM gp)
SELECT strip, u.start AS start, u.stop AS stop FROM (SELECT strip, unnest(bs) AS u FROM mg)"""


@query(_REC + _INK + _SPAN)
def valley_rows(spark, d):
    """Rows found as humps of ink, each judged against its neighbours."""
    ship(spark)
    return _each(strip_ink(spark, d), B.valley_rows("ink"))


@query(_PAGE.replace("WITH page_v", "WITH RECURSIVE page_v") + f""", ink_v AS (SELECT page, list(n ORDER BY y) AS ink FROM (SELECT page, y, count(*) FILTER (WHERE opaque AND luma < {DARK}) AS n FROM page_v GROUP BY 1, 2) GROUP BY 1),
sp AS (SELECT *, 3 + page % 4 AS n, list_position(list_transform(ink, lambda v: v > 0), true) - 1 AS a, len(ink) - list_position(list_reverse(list_transform(ink, lambda v: v > 0)), true) + 1 AS b FROM ink_v WHERE list_max(ink) > 0),
c AS (SELECT page, ink, n, a, b, (b - a) / n AS pitch, CAST(1 AS BIGINT) AS k, [a] AS bounds FROM sp WHERE b - a >= n
UNION ALL SELECT page, ink, n, a, b, pitch, k + 1, list_append(bounds, lo + list_position(ink[lo + 1:hi + 1], list_min(ink[lo + 1:hi + 1])) - 1) FROM
(SELECT *, greatest(bounds[-1] + 1, CAST(floor(a + k * pitch - pitch * 0.4e0 + 0.5) AS BIGINT)) AS lo, least(b - 1, CAST(floor(a + k * pitch + pitch * 0.4e0 + 0.5) AS BIGINT)) AS hi FROM c WHERE k < n) WHERE hi > lo),
r AS (SELECT page, n, i, min(y) AS start, max(y) + 1 AS stop FROM (SELECT *, unnest(range(0, len(ink))) AS y FROM (SELECT page, ink, n, list_append(bounds, b) AS e, unnest(range(1, n + 1)) AS i FROM c WHERE k = n)) WHERE y >= e[i] AND y < e[i + 1] AND ink[y + 1] > 0 GROUP BY 1, 2, 3)
SELECT page, start, stop FROM r QUALIFY count(*) OVER (PARTITION BY page) = n""")
def counted_rows(spark, d):
    """Three to six rows of an even pitch in a page, cut where there is least ink behind the cut before."""
    ship(spark)
    rows = page_ink(spark, d).select("page", F.explode(B.counted_rows("ink", F.col("page") % 4 + 3)).alias("b"))
    return rows.select("page", "b.start", "b.stop")
