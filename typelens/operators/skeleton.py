"""Skeletons of rasters that are one row each: distances to the background, thinning to lines of one pixel, branch numbers.

Whole lines or the whole raster are worked on at once; only the last step, which depends on its own results, goes pixel by
pixel, over the few that are left.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .components import label

STEP = np.sqrt(2.0)


def distances(mask: np.ndarray) -> np.ndarray:
    """Steps from each pixel of ink to the nearest background, diagonal ones of root 2; the raster's edge is no background."""
    d = np.where(mask, np.inf, 0.0)
    x = np.arange(d.shape[1], dtype=float)
    for view in (d, d[::-1, ::-1]):  # downwards from the left, upwards from the right
        for y in range(len(view)):
            line = view[y]
            if y:
                above = view[y - 1]
                line = np.minimum(line, above + 1)
                line[1:] = np.minimum(line[1:], above[:-1] + STEP)
                line[:-1] = np.minimum(line[:-1], above[1:] + STEP)
            view[y] = np.minimum.accumulate(line - x) + x
    return d


def ring(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of every pixel, from the upper one clockwise; none beyond the edge."""
    p = np.pad(mask.astype(np.int8), 1)
    h, w = mask.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def branches(mask: np.ndarray) -> np.ndarray:
    """How many lines leave a pixel: changes from background to ink around it."""
    r = ring(mask)
    return sum(((r[k] == 0) & (r[(k + 1) % 8] == 1)).astype(np.int64) for k in range(8)) * mask


def thinned(mask: np.ndarray) -> np.ndarray:
    """Ink peeled from two sides in turn, as long as no line breaks or shortens, until nothing changes; pixels at the edge stay."""
    now = mask.copy()
    inner = np.zeros(mask.shape, bool)
    inner[1:-1, 1:-1] = True
    while True:
        before = now
        for one, two in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            r = ring(now)
            n = sum(v.astype(np.int64) for v in r)
            free = lambda k: (r[k[0]] & r[k[1]] & r[k[2]]) == 0  # noqa: B023, E731
            now = now & ~(now & inner & (n >= 2) & (n <= 6) & (branches(now) == 1) & free(one) & free(two))
        if (now == before).all():
            return now


def smooth_steps(skeleton: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """A skeleton without the second pixels of its slanted lines: of pixels whose three neighbours and more hang together those go that have a
    neighbour as far from the background, so that the line stays in the middle."""
    s = skeleton.copy()
    around = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    h, w = s.shape
    for _ in range(64):
        changed = False
        for y, x in zip(*np.nonzero(s)):
            if not (0 < y < h - 1 and 0 < x < w - 1):
                continue
            near = [(y + dy, x + dx) for dy, dx in around if s[y + dy, x + dx]]
            if not 3 <= len(near) <= 7 or not any(dist[p] >= dist[y, x] - 0.001 for p in near):
                continue
            block = s[y - 1 : y + 2, x - 1 : x + 2].copy()
            block[1, 1] = False
            if label(block, diagonal=True).max() == 1:
                s[y, x] = False
                changed = True
        if not changed:
            break
    return s


#: So many sheets are held as Python objects at once, whatever Arrow batches have.
SHEETS = 64


def slices(batches, rows: int = SHEETS):
    """Arrow batches in parts of a few rows."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


SKELETONS = "sheet_id long, width long, skeleton array<boolean>, steps array<double>, branch array<bigint>"


def skeletonised(batches, smooth: bool = True):
    """Batches of (sheet_id, ink, width) -> batches of ``SKELETONS``, of a few sheets each."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.list_(pa.int64())]
    for part in slices(batches):
        out = []
        for sheet, ink, width in zip(*(part.column(c).to_pylist() for c in ("sheet_id", "ink", "width"))):
            mask = np.asarray(ink, bool).reshape(-1, int(width)) if ink else np.zeros((0, 1), bool)
            dist = distances(mask)
            thin = thinned(mask) if min(mask.shape) > 2 else mask
            thin = smooth_steps(thin, dist) if smooth else thin
            out.append((sheet, width, thin.ravel(), dist.ravel(), branches(thin).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in SKELETONS.split(", ")])


def skeletons(rasters: DataFrame, smooth: bool = True) -> DataFrame:
    """Rasters (sheet_id, ink array<boolean> in reading order, width) with, in the same order, the skeleton, each pixel's distance to the background
    (infinite where there is none) and the branch numbers of the skeleton; null and empty rasters have empty ones."""
    return rasters.select("sheet_id", "ink", "width").mapInArrow(lambda it: skeletonised(it, smooth), SKELETONS)
