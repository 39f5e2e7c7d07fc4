"""Bands of rows repaired and found. A sheet's bands are one array of (start, stop), its ink per line another: all work is inside the row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANDS = T.ArrayType(T.StructType().add("start", T.LongType()).add("stop", T.LongType()))
SLIVER, SEAM, TALL = 0.25, 0.05, 0.1  # of the typical height: a fragment's height, a gap inside a row; of the largest: a row's height
VALLEY, LEAST, EVEN = 0.25, 40, 2.6  # a valley's share of the peaks beside it, the least lines of a row, the largest ratio of heights


def height(b: Column) -> Column:
    return b["stop"] - b["start"]


def upper(sorted_: Column) -> Column:
    """The upper median of a sorted array."""
    return F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int"))


def merged_at(bands: Column, i: Column) -> Column:
    """Bands i and i + 1 (from 0) as one."""
    both = F.struct(F.get(bands, i)["start"].alias("start"), F.get(bands, i + 1)["stop"].alias("stop"))
    return F.concat(F.slice(bands, 1, i), F.array(both), F.slice(bands, i + 3, F.size(bands)))


def folded(bands: Column) -> Column:
    """Bands that are much shorter than the sheet's rows and nearly touch a neighbour become a part of the nearer one (of equals the upper one):
    the shortest first, so that the pieces of a row run into it one after the other."""
    heights = F.array_sort(F.transform(bands, height))
    typical = upper(F.filter(heights, lambda h: h >= F.array_max(heights) * TALL))

    def step(out, _):
        far = F.lit(2**40).cast("long")
        gap = lambda i: F.when((i > 0) & (i < F.size(out)), F.get(out, i)["start"] - F.get(out, i - 1)["stop"]).otherwise(far)
        each = F.transform(out, lambda b, i: F.struct(height(b).alias("h"), i.alias("i"), gap(i).alias("up"), gap(i + 1).alias("down")))
        pick = F.array_min(F.filter(each, lambda x: (x["h"] < typical * SLIVER) & (F.least(x["up"], x["down"]) <= F.greatest(F.lit(2.0), typical * SEAM))))
        return F.when(pick.isNull(), out).otherwise(merged_at(out, F.when(pick["up"] <= pick["down"], pick["i"] - 1).otherwise(pick["i"])))

    # a band that can still be merged is one of the first's: as many steps as there are seams
    return F.when(F.size(bands) < 2, bands).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(bands)), bands, step))


def without_captions(bands: Column, runs: Column, lines: Column) -> Column:
    """The tall bands of a sheet whose bands are, turn by turn, rows and printed captions under or over them; null for other sheets.

    ``runs`` has the runs of columns with ink in each band.  Captions are low, near their row, and of many runs, also at a line of capitals or digits.
    """
    n = F.size(lines)
    found = F.lit(None).cast(BANDS)
    for first in (0, 1):  # where the rows are
        odd = lambda x, k: F.filter(x, lambda _, i: i % 2 == k)
        tall, low, dense = odd(bands, first), odd(bands, 1 - first), F.transform(odd(runs, 1 - first), lambda r: r >= 5)
        mid = upper(F.array_sort(F.transform(tall, height)))
        level = ~F.exists(tall, lambda b: (height(b) < mid * 0.62) | (height(b) > mid * 1.48)) & ~F.exists(low, lambda b: (height(b) < 3) | (height(b) > mid * 0.34))
        pair = lambda k: F.get(tall, k)["start"] - F.get(low, k)["stop"] if first else F.get(low, k)["start"] - F.get(tall, k)["stop"]  # noqa: B023, E731
        between = lambda k: F.get(bands, 2 * k + 2)["start"] - F.get(bands, 2 * k + 1)["stop"]
        near = F.forall(F.sequence(F.lit(0), n - 1), lambda k: (pair(k) >= F.greatest(F.lit(2.0), mid * 0.04)) & (pair(k) <= mid * 0.7) & ((k == n - 1) | (pair(k) <= F.coalesce(between(k), F.lit(0)) * 1.15)))  # noqa: B023
        plain = F.transform(lines, lambda t: t.rlike("^[A-Z0-9]+$"))
        seen = ~F.exists(plain, lambda p: p) | F.exists(F.zip_with(plain, dense, lambda p, q: p & q), lambda v: v)
        many = F.size(F.filter(dense, lambda q: q)) >= F.ceil(n * 0.7)
        found = F.coalesce(found, F.when((F.size(bands) == 2 * n) & (n >= 4) & level & near & many & seen, tall))
    return found


def reconciled(bands: Column, runs: Column, lines: Column) -> Column:
    """As many bands as lines where there are more: captions go; else the cheapest neighbours become one, again and again, as long as what they
    make is no higher than a row.  Full rows that are too many stay.  ``runs`` may be null (captions are not looked for)."""
    lines = F.filter(lines, lambda t: F.length(t) > 0)
    n = F.size(lines)
    pitch = (F.element_at(bands, -1)["stop"] - F.get(bands, F.lit(0))["start"]) / n

    def step(out, _):
        typical = upper(F.slice(F.sort_array(F.transform(out, height), asc=False), 1, n))

        def cost(b, i):
            after = F.get(out, i + 1)
            gap, whole, small = after["start"] - b["stop"], after["stop"] - b["start"], F.least(height(b), height(after))
            fits = (gap <= F.greatest(typical * 0.45, pitch * 0.25)) & (whole <= F.greatest(typical * 1.65, pitch * 0.92)) & ~((small > typical * 0.62) & (whole > pitch * 0.88))
            return F.when(fits, F.struct((gap + small * 0.35).alias("c"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(out, cost), lambda c: c.isNotNull()))
        return F.when((F.size(out) <= n) | best.isNull(), out).otherwise(merged_at(out, best["i"]))

    folds = F.aggregate(F.sequence(F.lit(1), F.size(bands)), bands, step)
    return F.when((n < 2) | (F.size(bands) <= n), bands).otherwise(F.coalesce(without_captions(bands, runs, lines), folds))


def smoothed(v: np.ndarray, win: int) -> np.ndarray:
    """Means over ``win`` values on both sides, fewer at the ends."""
    sums = np.concatenate([[0.0], np.cumsum(v, dtype=float)])
    i = np.arange(len(v))
    lo, hi = np.maximum(i - win, 0), np.minimum(i + win + 1, len(v))
    return (sums[hi] - sums[lo]) / (hi - lo)


def deepest_valley(profile: np.ndarray, least: int) -> int:
    """Where to part a band: the lowest place (the first of equals) that is a valley between two peaks, ``least`` lines from both ends; -1 for none."""
    h = len(profile)
    if h < 2 * least:
        return -1
    s = smoothed(profile, 2)
    i = np.arange(least, h - least + 1)
    i = i[i < h]
    left, right = np.maximum.accumulate(s), np.maximum.accumulate(s[::-1])[::-1]
    beside = np.minimum(left[i - 1], np.where(i + 1 < h, right[np.minimum(i + 1, h - 1)], 0.0))
    ok = i[(s[i] <= VALLEY * beside) & (s.max() > 0)]
    return int(ok[np.argmin(s[ok])]) if len(ok) else -1


def parted(ink: np.ndarray, bands: list[tuple[int, int]], least: int = LEAST, most: int | None = None) -> list[tuple[int, int]]:
    """Bands (first and last line) parted at valleys, as often as there are any, or the highest first up to ``most`` bands; unchanged where
    the parts are of too different heights, or are halves of rows that were even."""
    cut = lambda b: (v := deepest_valley(ink[b[0] : b[1] + 1], least)) >= 0 and [(b[0], b[0] + v - 1), (b[0] + v + 1, b[1])]
    out = list(bands)
    if most is None:
        i = 0
        while i < len(out):
            if halves := cut(out[i]):
                out[i : i + 1] = halves
            else:
                i += 1
        tall = sorted(b - a + 1 for a, b in bands)
        if len(bands) >= 5 and len(out) > 9 and tall[-1] <= tall[len(tall) // 2] * 1.55:
            return list(bands)
    else:
        while len(out) < most:
            able = [(a - b, k) for k, (a, b) in enumerate(out) if cut((a, b))]
            if not able:
                break
            k = min(able)[1]
            out[k : k + 1] = cut(out[k])
    hs = [b - a + 1 for a, b in out]
    return list(bands) if len(out) <= len(bands) or max(hs) / max(1, min(hs)) > EVEN else out


def tight(ink: np.ndarray, bounds: list[int]) -> list[tuple[int, int]]:
    """Between every two bounds the lines from the first to behind the last with ink; none without."""
    out = []
    for a, b in zip(bounds, bounds[1:]):
        on = np.flatnonzero(ink[a:b]) + a
        if len(on):
            out.append((int(on[0]), int(on[-1]) + 1))
    return out


def peaks_of(s: np.ndarray, win: int, floor: float) -> list[int]:
    """Places of largest values among ``win`` + 1 on both sides and not under the floor; of such that are as near as that the higher one (of equals the first)."""
    out: list[int] = []
    for y in np.flatnonzero(s >= floor):
        if s[y] < s[max(0, y - win - 1) : y + win + 2].max():
            continue
        if out and y - out[-1] <= win + 1:
            if s[y] > s[out[-1]]:
                out[-1] = int(y)
        else:
            out.append(int(y))
    return out


def rows_by_valleys(ink: np.ndarray) -> list[tuple[int, int]]:
    """Rows as humps of ink, parted where it falls under half of the smaller hump beside; bands whose centres are nearer than 0.75 of the pitch are one row."""
    on = np.flatnonzero(ink)
    if not len(on):
        return []
    first, last = int(on[0]), int(on[-1])
    win = max(1, int(np.floor((last - first + 1) / 150 + 0.5)))
    s = smoothed(ink[first : last + 1], win)
    peaks = peaks_of(s, win, ink.max() * 0.04)
    cuts = []
    for a, b in zip(peaks, peaks[1:]):
        v = a + int(np.argmin(s[a : b + 1]))
        if s[v] <= 0.5 * min(s[a], s[b]):
            cuts.append(v + first)
    bands = tight(ink, [first, *cuts, last + 1]) if len(peaks) > 1 else [(first, last + 1)]
    if len(bands) < 3:
        return bands
    middle = lambda b: (b[0] + b[1]) / 2
    pitch = sorted(middle(b) - middle(a) for a, b in zip(bands, bands[1:]))[(len(bands) - 1) // 2]
    out = bands[:1]
    for b in bands[1:]:
        if middle(b) - middle(out[-1]) < 0.75 * pitch:
            out[-1] = (out[-1][0], b[1])
        else:
            out.append(b)
    return out


def rows_by_count(ink: np.ndarray, n: int) -> list[tuple[int, int]] | None:
    """n rows of an even pitch, parted at the line with least ink near each place and behind the cut before; none where that gives a row without ink."""
    on = np.flatnonzero(ink)
    if n < 2 or not len(on) or on[-1] + 1 - on[0] < n:
        return None
    first, last = int(on[0]), int(on[-1]) + 1
    pitch, bounds = (last - first) / n, [first]
    for k in range(1, n):
        at = first + k * pitch
        lo, hi = max(bounds[-1] + 1, int(np.floor(at - pitch * 0.4 + 0.5))), min(last - 1, int(np.floor(at + pitch * 0.4 + 0.5)))
        if hi <= lo:
            return None
        bounds.append(lo + int(np.argmin(ink[lo : hi + 1])))
    rows = tight(ink, [*bounds, last])
    return rows if len(rows) == n else None


def _as_structs(bands) -> list[dict] | None:
    return None if bands is None else [{"start": int(a), "stop": int(b)} for a, b in bands]


@F.pandas_udf(BANDS)
def valley_rows(ink: pd.Series) -> pd.Series:
    """``rows_by_valleys`` of arrays of ink per line."""
    return pd.Series([_as_structs(rows_by_valleys(np.asarray(v))) for v in ink], dtype=object)


@F.pandas_udf(BANDS)
def counted_rows(ink: pd.Series, n: pd.Series) -> pd.Series:
    """``rows_by_count`` of arrays of ink per line."""
    return pd.Series([_as_structs(rows_by_count(np.asarray(v), int(k))) for v, k in zip(ink, n)], dtype=object)


def part_bands(least: int = LEAST):
    """A function of columns (ink per line, bands, the most bands or null): half-open bands parted at valleys; the line of a cut is in neither part."""

    @F.pandas_udf(BANDS)
    def run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ink, bands, most in it:
            out = []
            for v, bs, m in zip(ink, bands, most):
                got = parted(np.asarray(v), [(b["start"], b["stop"] - 1) for b in bs], least, None if pd.isna(m) else int(m))
                out.append(_as_structs((a, b + 1) for a, b in got))
            yield pd.Series(out, dtype=object)

    return run
