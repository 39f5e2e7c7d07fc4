"""Connected components of rasters that are one row each: labelled where the row lies, without a shuffle; the labelling is sequential."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1, in reading order of the first pixel of each component; 0 elsewhere."""
    out = np.zeros(mask.shape, np.int64)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(a, b) for a in (-1, 1) for b in (-1, 1)] * diagonal
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            for da, db in steps:
                p, q = a + da, b + db
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    todo.append((p, q))
    return out


def holes(mask: np.ndarray) -> int:
    """Pixels of background that no path of 4-neighbours joins to the outside."""
    outside = np.pad(~mask, 1, constant_values=True)
    lab = label(outside)
    return int((outside & (lab != lab[0, 0])).sum())


PARTS = "sheet_id long, component long, root long, area long, largest long, x0 long, x1 long, y0 long, y1 long, top long, bottom long, left long, right long"


def parts_of(mask: np.ndarray, diagonal: bool = False) -> dict[str, np.ndarray]:
    """Per component: its first pixel in reading order, area, the sheet's largest area, box, and pixels on each edge of the sheet."""
    lab = label(mask, diagonal)
    y, x = np.nonzero(lab)
    names, first, k = np.unique(lab[y, x], return_index=True, return_inverse=True)
    count = lambda on: np.bincount(k[on], minlength=len(names))
    area = count(slice(None))
    out = {"component": names, "root": y[first] * mask.shape[1] + x[first], "area": area, "largest": np.full(len(names), area.max(initial=0))}
    for axis, v in (("x", x), ("y", y)):
        low, high = np.full(len(names), max(mask.shape)), np.zeros(len(names), np.int64)
        np.minimum.at(low, k, v)
        np.maximum.at(high, k, v)
        out |= {f"{axis}0": low, f"{axis}1": high}
    edges = {"top": y == 0, "bottom": y == mask.shape[0] - 1, "left": x == 0, "right": x == mask.shape[1] - 1}
    return out | {name: count(on) for name, on in edges.items()}


def _masks(batches):
    for pdf in batches:
        for sheet, ink, width in zip(pdf["sheet_id"], pdf["ink"], pdf["width"]):
            flat = np.zeros(0, bool) if ink is None else np.asarray(ink, bool)
            yield sheet, flat.reshape(-1, int(width)) if flat.size else np.zeros((0, 1), bool)


def components(rasters: DataFrame, diagonal: bool = False) -> DataFrame:
    """The components of rasters (sheet_id, ink array<boolean> in reading order, width); null and empty rasters have none."""
    columns = [f.split()[0] for f in PARTS.split(", ")]

    def run(batches):
        for pdf in batches:
            found = [(sheet, parts_of(mask, diagonal)) for sheet, mask in _masks([pdf])]
            if found:
                ids = np.repeat([s for s, _ in found], [len(p["component"]) for _, p in found])
                yield pd.DataFrame({c: np.concatenate([p[c] for _, p in found]) if c != "sheet_id" else ids for c in columns})

    return rasters.select("sheet_id", "ink", "width").mapInPandas(run, PARTS)


def hole_areas(rasters: DataFrame) -> DataFrame:
    """Enclosed background of each raster; 0 for null and empty ones."""

    def run(batches):
        rows = [(sheet, holes(mask)) for sheet, mask in _masks(batches)]
        yield pd.DataFrame(rows, columns=["sheet_id", "hole_area"])

    return rasters.select("sheet_id", "ink", "width").mapInPandas(run, "sheet_id long, hole_area long")
