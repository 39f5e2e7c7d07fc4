"""Rounding, medians and first/last-wins rules; queries use these and do not restate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(x + 0.5)


def upper_median(x: Column) -> Column:
    """Element floor(n / 2) of the sorted values, an aggregate; null for none."""
    s = F.array_sort(F.collect_list(x))
    return F.when(F.size(s) > 0, F.get(s, F.floor(F.size(s) / 2).cast("int")))


def middle_median(x: Column) -> Column:
    """The median with the mean of the two middle values, an aggregate."""
    return F.median(x)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded half up; null without a whole."""
    return F.when(whole > 0, half_up(100.0 * part / whole))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def escape_like(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\%_])", r"\\$1")


def contains_folded(x: Column, term: str) -> Column:
    """Whether x holds the term, wild cards taken literally and ASCII case folded."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
    return F.contains(lower_ascii(x), F.lit(low))


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first of a total order (descending orders make it the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def spacing_problem(advance: Column, left: Column, right: Column, upm: Column, overlap: bool = False) -> Column:
    """No usable advance, or ink that severely leaves it; only the former where overlaps are meant. Nulls, NaN and infinities are problems."""
    inf = F.lit(float("inf"))
    broken = (advance <= 0) | (upm <= 0)
    for x in (advance, left, right, upm):
        broken = broken | x.isNull() | F.isnan(x) | (F.abs(x) == inf)
    ink, over = right - left, F.greatest(F.lit(0.0), -left) + F.greatest(F.lit(0.0), right - advance)
    severe = (ink > 0) & (over > upm * 0.1) & ((advance < ink * 0.75) | (over > F.greatest(ink * 0.35, upm * 0.2)))
    return F.coalesce(broken, F.lit(True)) if overlap else F.coalesce(broken | severe, F.lit(True))
