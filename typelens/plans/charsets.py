"""Charsets guessed from rows, frames around sheets, pen paths, tones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import color as C
from ..operators import components as K
from ..sources.bindings import rasters, sql, table
from ..sources.shipping import ship
from . import query
from .glyphs import sheet_cells
from .raster import _COMP, _EIGHT

#: Lines of the usual charsets, and the order in which further punctuation is expected (fixed values).
UPPER, DIGITS, PUNCT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,!?:;'-&@#"
BANK = "!?@#$%^&*()-_+=[]{};:'\",.<>/\\|~`"
FULL = [UPPER, UPPER.lower()]
HALF = [line[a : a + 13] for line in FULL for a in (0, 13)]
DEFAULT = [*FULL, DIGITS, PUNCT]
TEMPLATES = {(n, split): DEFAULT for n in (5, 6) for split in (False, True)} | {
    **{(n, split): DEFAULT[:n] for n in (1, 2, 3) for split in (False, True)},
    (4, False): DEFAULT, (4, True): HALF, (5, True): [*HALF, DIGITS], (6, True): [*HALF, DIGITS, PUNCT],
}


def _lines(lines: list[str]) -> Column:
    return F.array(*map(F.lit, lines))


def by_count(rows: Column, first: Column) -> Column:
    """The charset of a number of rows; up to 16 cells in the first mean the alphabet in halves. Other numbers have the default."""
    split = (first > 0) & (first <= 16)
    return F.coalesce(*[F.when((rows == n) & (split == s), _lines(lines)) for (n, s), lines in TEMPLATES.items()], _lines(DEFAULT))


def by_rows(cells: Column) -> Column:
    """A line for each row by the number of its cells: alphabet and digits by place, what is left from the bank of punctuation in order."""
    n, at = F.size(cells), lambda i: F.get(cells, i)
    split = at(F.lit(0)) <= 16
    alphabet = F.when(split, F.slice(_lines(HALF), F.lit(1), F.least(n, F.lit(4)))).otherwise(F.slice(_lines(FULL), F.lit(1), F.least(n, F.lit(2))))
    head = F.when((n > F.size(alphabet)) & (at(F.size(alphabet)) <= 15), F.concat(alphabet, _lines([DIGITS]))).otherwise(alphabet)
    i = F.size(head)
    rest = F.transform(F.slice(cells, i + 1, F.greatest(n - i, F.lit(0))), lambda c: F.greatest(c, F.lit(1)))

    def line(c, k):
        before = F.aggregate(F.slice(rest, F.lit(1), k), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.when(before < len(BANK), F.substring(F.lit(BANK), (before + 1).cast("int"), F.least(c, len(BANK) - before).cast("int"))).otherwise(F.substring(F.lit(BANK), F.lit(1), c.cast("int")))

    known = F.when((i == n - 1) & (at(i) == len(PUNCT)), _lines([PUNCT]))
    seven = F.when(split & (n == 7) & (i == 5) & at(F.lit(5)).between(17, 20) & (at(F.lit(6)) == 13), _lines([BANK[:17], BANK[17:30]]))
    two = (n == 2) & (at(F.lit(0)) >= 22) & at(F.lit(1)).between(8, 12)
    three = (n == 3) & at(F.lit(0)).between(11, 15) & at(F.lit(1)).between(11, 15) & at(F.lit(2)).between(8, 12)
    usual = F.concat(head, F.coalesce(known, seven, F.transform(rest, line)))
    return F.when(n == 0, _lines(DEFAULT)).when(two, _lines([UPPER, DIGITS])).when(three, _lines([*HALF[:2], DIGITS])).otherwise(usual)


def _list(lines: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]"


_B = "'" + BANK.replace("'", "''") + "'"


@query(f"""WITH s AS (SELECT l_orderkey AS sheet, list(CAST(l_quantity AS BIGINT) % 20 + 1 ORDER BY l_linenumber, CAST(l_quantity AS BIGINT) % 20 + 1) AS c FROM lineitem GROUP BY 1),
a AS (SELECT *, len(c) AS n, c[1] <= 16 AS split, CASE WHEN c[1] <= 16 THEN {_list(HALF)}[1:least(len(c), 4)] ELSE {_list(FULL)}[1:least(len(c), 2)] END AS al FROM s),
h AS (SELECT *, CASE WHEN n > len(al) AND c[len(al) + 1] <= 15 THEN list_append(al, '{DIGITS}') ELSE al END AS head FROM a),
r AS (SELECT *, list_transform(range(len(head) + 1, n + 1), lambda k: CASE WHEN coalesce(list_sum(c[len(head) + 1:k - 1]), 0) < {len(BANK)} THEN substr({_B}, CAST(coalesce(list_sum(c[len(head) + 1:k - 1]), 0) AS BIGINT) + 1, CAST(least(c[k], {len(BANK)} - coalesce(list_sum(c[len(head) + 1:k - 1]), 0)) AS BIGINT)) ELSE substr({_B}, 1, c[k]) END) AS rest FROM h),
u AS (SELECT *, CASE WHEN n = 2 AND c[1] >= 22 AND c[2] BETWEEN 8 AND 12 THEN {_list([UPPER, DIGITS])} WHEN n = 3 AND c[1] BETWEEN 11 AND 15 AND c[2] BETWEEN 11 AND 15 AND c[3] BETWEEN 8 AND 12 THEN {_list([*HALF[:2], DIGITS])}
WHEN len(head) = n - 1 AND c[n] = {len(PUNCT)} THEN list_concat(head, {_list([PUNCT])}) WHEN split AND n = 7 AND len(head) = 5 AND c[6] BETWEEN 17 AND 20 AND c[7] = 13 THEN list_concat(head, {_list([BANK[:17], BANK[17:30]])}) ELSE list_concat(head, rest) END AS lines FROM r)
SELECT sheet, array_to_string(CASE {' '.join(f'WHEN n = {n} AND {"" if s else "NOT "}split THEN {_list(lines)}' for (n, s), lines in TEMPLATES.items())} ELSE {_list(DEFAULT)} END, chr(10)) AS by_count, array_to_string(lines, chr(10)) AS by_rows FROM u""")
def charset_guess(spark, d):
    """Charsets by the number of rows and by the cells of each; short rows of capitals have a rule of their own (``short_row_charset``)."""
    s = sheet_cells(spark, d, F.col("l_quantity").cast("long") % 20 + 1)
    cells = F.col("cells")
    return s.select("sheet", F.array_join(by_count(F.size(cells), F.get(cells, F.lit(0))), "\n").alias("by_count"), F.array_join(by_rows(cells), "\n").alias("by_rows"))


@query(sql(_COMP.format(near=_EIGHT) + """, c AS (SELECT sheet_id, root, count(*) AS area, count(*) FILTER (WHERE p // 8 = 0) AS t, count(*) FILTER (WHERE p // 8 = 7) AS b, count(*) FILTER (WHERE p % 8 = 0) AS l, count(*) FILTER (WHERE p % 8 = 7) AS r,
max(p % 8) - min(p % 8) + 1 AS w, max(p // 8) - min(p // 8) + 1 AS h FROM root GROUP BY 1, 2) SELECT sheet_id, root, area, area < 64 * 0.85e0 AND ((greatest(t, b) >= 8 * 0.22e0 AND w >= 2) OR (greatest(l, r) >= 8 * 0.22e0 AND h >= 2)) AS frame FROM c""", "pixels_v", recursive=True))
def perimeter_frame(spark, d):
    """Components that run along an edge of their sheet for 22 per cent of it and span a quarter: a frame, unless nearly all is ink."""
    ship(spark)
    side = 8
    c = K.components(rasters(spark, d), diagonal=True)
    along = lambda a, b, lo, hi: (F.greatest(a, b) >= side * 0.22) & (F.col(hi) - F.col(lo) + 1 >= side * 0.25)
    frame = along("top", "bottom", "x0", "x1") | along("left", "right", "y0", "y1")
    return c.select("sheet_id", "root", "area", ((F.col("area") < side * side * 0.85) & frame).alias("frame"))


def pen_order(starts, ends, closed) -> list[tuple[int, bool]]:
    """Strokes in the order of a pen that always goes to the nearest end left, from the first stroke's start; true: drawn backwards.
    Of equal distances the first stroke counts, and its start before its end; closed strokes end where they start."""
    left, pen, out = list(range(len(starts))), starts[0] if starts else None, []
    while left:
        ways = [(i, back) for i in left for back in (False, True)[: 1 if closed[i] else 2]]
        i, back = min(ways, key=lambda w: sum((a - b) ** 2 for a, b in zip(pen, (ends if w[1] else starts)[w[0]])))
        out.append((i, back))
        left.remove(i)
        pen = starts[i] if back or closed[i] else ends[i]
    return out


@F.pandas_udf(StringType())
def _pen(sx: pd.Series, sy: pd.Series, ex: pd.Series, ey: pd.Series, closed: pd.Series) -> pd.Series:
    rows = zip(sx, sy, ex, ey, closed)
    return pd.Series([" ".join(f"{i}{'r' * b}" for i, b in pen_order(list(zip(a, b)), list(zip(c, e)), list(k))) for a, b, c, e, k in rows])


@query()
def pen_path(spark, d):
    """The pen's path over the strokes of a drawing (an order's lines): their numbers, ``r`` for those drawn backwards."""
    ship(spark)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("drawing")).agg(F.array_sort(F.collect_list(line)).alias("s"))
    part = lambda f: F.transform("s", lambda s: f(s).cast("double"))
    closed = F.transform("s", lambda s: s["l_linenumber"] % 3 == 0)
    path = _pen(part(lambda s: s["l_quantity"]), part(lambda s: s["l_linenumber"] * 5), part(lambda s: s["l_partkey"] % 50), part(lambda s: s["l_suppkey"] % 50), closed)
    return g.select("drawing", path.alias("path"))


_E = [[f"CAST(embedding[{k + c + 1}] AS DOUBLE) * 255 AS {n}{c}" for c in range(3)] for n, k in (("p", 0), ("a", 3), ("b", 6))]


@query("WITH e AS (SELECT vec_id, " + ", ".join(x for v in _E for x in v) + f""" FROM embeddings), t AS (SELECT *, least(greatest(({' + '.join(f'(b{c} - a{c}) * (p{c} - a{c})' for c in range(3))}) / ({' + '.join(f'(b{c} - a{c}) * (b{c} - a{c})' for c in range(3))}), 0), 1) AS t FROM e)
SELECT vec_id, round({' + '.join(f'power(p{c} - a{c} - t * (b{c} - a{c}), 2)' for c in range(3))}, 3) AS dist2, round(0.299e0 * p0 + 0.587e0 * p1 + 0.114e0 * p2, 6) AS luma FROM t""")
def blend_segment(spark, d):
    """Squared distance of a colour to the blends of two others, and its luma."""
    p, a, b = [[F.get("embedding", F.lit(k + c)).cast("double") * 255 for c in range(3)] for k in (0, 3, 6)]
    return table(spark, d, "embeddings").select("vec_id", F.round(C.to_segment2(p, a, b), 3).alias("dist2"), F.round(C.luma(*p), 6).alias("luma"))
