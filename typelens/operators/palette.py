"""Colours of sheets: the paper, the inks, a shadow among them, and a glyph's layers.

Pixels are rows (sheet_id, width, height, x, y, r, g, b); transparent ones are left out before.  What looks at all pixels is joins
and aggregates; clusters are trained per sheet on a sample that is bounded (about SAMPLE pixels by a stride, as the rule has it),
and every pixel is counted again against the centres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.semantics import half_up
from .components import label

PAPER, HALO, SAMPLE, MERGE = 20.0, 6.0, 6000, 100.0  # distance from the paper; chroma of a halo; pixels of a sample; squared distance of equal centres
SHADOW, MOST_L, MOST_CHROMA = 0.5, 58.0, 26.0


def background(px: DataFrame) -> DataFrame:
    """(sheet_id, br, bg, bb): the mean of the commonest colours at the border, in steps of 16 (of equals that met first); a corner counts twice."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    sides = [(y == 0, 2 * x), (y == h - 1, 2 * x + 1), (x == 0, 2 * (w + y)), (x == w - 1, 2 * (w + y) + 1)]
    times = sum((s.cast("long") for s, _ in sides), F.lit(0))
    met = F.least(*[F.when(s, at) for s, at in sides])
    step = lambda c: F.shiftright(c, 4)
    b = px.withColumns({"n": times, "met": met}).filter("n > 0").groupBy("sheet_id", step("r").alias("i"), step("g").alias("j"), step("b").alias("k"))
    total = lambda c: F.sum(F.col(c) * F.col("n"))
    g = b.agg(F.sum("n").alias("n"), F.min("met").alias("met"), *[half_up(total(c) / F.sum("n")).alias(c) for c in "rgb"])
    best = g.groupBy("sheet_id").agg(F.max_by(F.struct("r", "g", "b"), F.struct(F.col("n"), -F.col("met"))).alias("m"))
    return best.select("sheet_id", F.col("m.r").alias("br"), F.col("m.g").alias("bg"), F.col("m.b").alias("bb"))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed here, once a row: those built on them don't repeat the expressions (a generator is not merged)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_lab(df: DataFrame, rgb: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """df with the Lab colour of three channels."""
    kept = [n for n in df.columns]
    df = once(df, {f"_{i}": C.linear(F.col(c)) for i, c in enumerate(rgb)})
    df = once(df, {f"_t{i}": t for i, t in enumerate(C.tones([F.col(f"_{i}") for i in range(3)]))})
    return once(df, dict(zip(names, C.from_tones([F.col(f"_t{i}") for i in range(3)])))).select(*kept, *names)


def measured(px: DataFrame, paper: DataFrame) -> DataFrame:
    """Pixels with their Lab colour and the squared distance from the sheet's paper."""
    white = with_lab(paper, ("br", "bg", "bb"), ("pl", "pa", "pv"))
    p = with_lab(px.join(white, "sheet_id"), ("r", "g", "b"), ("l", "a", "v"))
    return once(p, {"d2": C.distance2([F.col(c) for c in ("l", "a", "v")], [F.col(c) for c in ("pl", "pa", "pv")])}).drop("pl", "pa", "pv")


def inked() -> Column:
    """Whether a pixel is further from the paper than it may vary, whatever its colour."""
    return F.col("d2") > PAPER**2


def coloured() -> Column:
    """Ink but for grey halos near the paper."""
    return inked() & ~((F.hypot("a", "v") < HALO) & (F.col("d2") < 4 * PAPER**2))


def means(points: np.ndarray, k: int, rounds: int = 16) -> np.ndarray:
    """k-means: the first point, then always the one farthest from all; empty clusters keep their centre; until no point moves."""
    far = lambda c: ((points[:, None] - np.asarray(c)[None]) ** 2).sum(2)
    centres = [points[0]]
    while len(centres) < min(max(1, k), len(points)):
        centres.append(points[far(centres).min(1).argmax()])
    centres, before = np.array(centres), np.zeros(len(points), int)
    for turn in range(rounds):
        own = far(centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        for axis in range(3):
            sums = np.bincount(own, points[:, axis], len(centres))
            centres[:, axis] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, axis])
        if turn and (own == before).all():
            break
        before = own
    return centres


def blends(rgb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of colours from the segment between two."""
    t = np.clip((rgb - a) @ (b - a) / max(float((b - a) @ (b - a)), 1e-12), 0, 1)
    return ((rgb - a - t[:, None] * (b - a)) ** 2).sum(1)


def trained(lab: np.ndarray, rgb: np.ndarray, solid: np.ndarray, paper: np.ndarray, k: int) -> np.ndarray:
    """Centres of a sample: of all of it, or where enough pixels are inside strokes, of these and what is no blend of two of their inks or the paper."""
    points = lab
    if solid.sum() >= max(8, k):
        cores = means(lab[solid], k)
        inks = [rgb[solid][((lab[solid] - c) ** 2).sum(1).argmin()] for c in cores]
        surfaces = [paper, *inks]
        mixed = np.zeros(len(lab), bool)
        for i, a in enumerate(surfaces):
            for b in surfaces[i + 1 :]:
                mixed |= blends(rgb, a, b) <= 64
        points = np.concatenate([lab[solid], lab[~mixed]])
    out: list = []
    for c in means(points, k):
        if all(((c - m) ** 2).sum() >= MERGE for m in out):
            out.append(c)
    return np.array(out)


def samples(px: DataFrame, paper: DataFrame) -> DataFrame:
    """Coloured pixels at a stride, in reading order, and whether they lie inside a stroke: two away on each side the colour is nearly the same."""
    line, column = Window.partitionBy("sheet_id", "y").orderBy("x"), Window.partitionBy("sheet_id", "x").orderBy("y")
    near = lambda way, w: way(F.struct("x", "y", "r", "g", "b"), 2).over(w)
    p = px.withColumns({"q0": near(F.lag, line), "q1": near(F.lead, line), "q2": near(F.lag, column), "q3": near(F.lead, column)})
    same = lambda q: (F.abs(F.col(q)["x"] - F.col("x")) + F.abs(F.col(q)["y"] - F.col("y")) == 2) & (sum((F.pow(F.col(q)[c] - F.col(c), 2) for c in "rgb"), F.lit(0.0)) <= 64)
    inside = (F.col("x") >= 2) & (F.col("x") < F.col("width") - 2) & (F.col("y") >= 2) & (F.col("y") < F.col("height") - 2)
    p = p.withColumn("solid", F.coalesce(inside & same("q0") & same("q1") & same("q2") & same("q3"), F.lit(False))).drop("q0", "q1", "q2", "q3")
    p = p.withColumn("p", F.col("y") * F.col("width") + F.col("x"))
    stride = F.greatest(F.lit(1), F.floor(F.col("width") * F.col("height") / SAMPLE))
    return measured(p.filter(F.col("p") % stride == 0), paper).filter(coloured())


def centres(px: DataFrame, paper: DataFrame, k: int) -> DataFrame:
    """(sheet_id, centres array<struct<l, a, v>>) of sheets with any ink."""

    def train(key, pdf):
        pdf = pdf.sort_values("p")
        found = trained(pdf[["l", "a", "v"]].to_numpy(float), pdf[["r", "g", "b"]].to_numpy(float), pdf["solid"].to_numpy(bool), pdf[["br", "bg", "bb"]].iloc[0].to_numpy(float), k)
        return pd.DataFrame([(key[0], [dict(zip("lav", map(float, c))) for c in found])], columns=["sheet_id", "centres"])

    cols = ["sheet_id", "p", "l", "a", "v", "r", "g", "b", "br", "bg", "bb", "solid"]
    return samples(px, paper).select(*cols).groupBy("sheet_id").applyInPandas(train, "sheet_id long, centres array<struct<l:double,a:double,v:double>>")


def nearest(points: Column) -> Column:
    """The place of the nearest of an array of Lab colours to (l, a, v); of equals the first."""
    own = [F.col(c) for c in ("l", "a", "v")]
    return F.array_min(F.transform(points, lambda c, i: F.struct(C.distance2(own, [c["l"], c["a"], c["v"]]).alias("d"), i.alias("i"))))["i"]


def palettes(px: DataFrame, k: int) -> DataFrame:
    """Per sheet the inks by the number of their pixels, all pixels counted: (sheet_id, place, r, g, b, n); sheets without ink have none."""
    paper = background(px)
    every = measured(px, paper).filter(coloured()).join(centres(px, paper, k), "sheet_id")
    g = every.groupBy("sheet_id", nearest(F.col("centres")).alias("c")).agg(F.count(F.lit(1)).alias("n"), *[half_up(F.avg(x)).alias(x) for x in "rgb"])
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("n"), "c")) - 1
    return g.select("sheet_id", place.cast("long").alias("place"), "r", "g", "b", "n")


def shadows(px: DataFrame, inks: DataFrame) -> DataFrame:
    """Sheets with two inks and more: whether the darkest grey one is a shadow (sheet_id, paired, score, shadow), that is, whether in most components
    that have it it lies to one side of the other ink, by no more than a part of their width.  ``inks`` are palettes."""
    paper = background(px)
    i = with_lab(inks, ("r", "g", "b"), ("l", "a", "v")).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("place", "r", "g", "b", "l", "a", "v"))).alias("inks")).filter("size(inks) > 1")
    dark = F.array_min(F.transform(F.filter("inks", lambda c: (c["l"] < MOST_L) & (F.hypot(c["a"], c["v"]) < MOST_CHROMA)), lambda c: F.struct(c["l"].alias("l"), c["place"].alias("place"))))["place"]
    own, white = [F.col(c) for c in "rgb"], [F.col(c) for c in ("br", "bg", "bb")]
    best = F.array_min(F.transform("inks", lambda c: F.struct(C.to_segment2(own, white, [c["r"], c["g"], c["b"]]).alias("d"), c["place"].alias("place"))))["place"]
    p = measured(px, paper).filter(inked()).join(i.withColumn("dark", dark).filter("dark is not null"), "sheet_id")
    p = p.select("sheet_id", "width", "height", F.struct((F.col("y") * F.col("width") + F.col("x")).alias("p"), (best == F.col("dark")).alias("dark")).alias("s"))
    sheets = p.groupBy("sheet_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.collect_list("s").alias("s"))

    def judge(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mask = np.zeros((2, int(r.height), int(r.width)), bool)
                at = np.array([(s["p"], s["dark"]) for s in r.s], int)
                mask[at[:, 1], at[:, 0] // int(r.width), at[:, 0] % int(r.width)] = True
                rows.append((r.sheet_id, *offset(mask[0], mask[1])))
            yield pd.DataFrame(rows, columns=["sheet_id", "paired", "score", "shadow"])

    return sheets.mapInPandas(judge, "sheet_id long, paired long, score double, shadow boolean")


def offset(bright: np.ndarray, dark: np.ndarray) -> tuple[int, float, bool]:
    """Components of both masks whose dark part is set off in the common direction, the share of the dark pixels in them, and the verdict."""
    if bright.sum() < 50 or dark.sum() < 50:
        return 0, 0.0, False
    lab = label(bright | dark, diagonal=True)
    y, x = np.nonzero(lab)
    k, is_dark = lab[y, x] - 1, dark[y, x]
    m = int(k.max()) + 1
    total = lambda on, v=None: np.bincount(k[on], None if v is None else v[on], m)
    dc, bc = total(is_dark), total(~is_dark)
    with np.errstate(divide="ignore", invalid="ignore"):
        ox, oy = (total(is_dark, v.astype(float)) / dc - total(~is_dark, v.astype(float)) / bc for v in (x, y))
    left, right = np.full(m, 2**31), np.zeros(m, np.int64)
    np.minimum.at(left, k, x)
    np.maximum.at(right, k, x)
    far = np.hypot(ox, oy)
    fits = (bc >= 20) & (dc >= 20) & (far >= max(2, 0.006 * max(dark.shape))) & (far <= 0.4 * (right - left + 1))
    if not fits.any():
        return 0, 0.0, False
    dx, dy = (float((v[fits] * dc[fits]).sum() / dc[fits].sum()) for v in (ox, oy))
    along = fits.copy()
    along[fits] = (ox[fits] * dx + oy[fits] * dy) / (far[fits] * (np.hypot(dx, dy) or 1)) >= 0.7
    paired, score = int(along.sum()), float(dc[along].sum() / dark.sum())
    return paired, score, score >= SHADOW and paired >= 3


#: Characters of one part and of more (fixed values of the latter among letters and digits).
PARTS = "ij"


def labelled(px: DataFrame, diagonal: bool = False) -> DataFrame:
    """Pixels (sheet_id, width, height, x, y) with their component (4-connected, or with diagonals), its area, and the first of the largest ones of the sheet."""
    g = px.groupBy("sheet_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.collect_list(F.col("y") * F.col("width") + F.col("x")).alias("s"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mask = np.zeros(int(r.height) * int(r.width), bool)
                mask[np.asarray(r.s)] = True
                lab = label(mask.reshape(int(r.height), int(r.width)), diagonal)
                y, x = np.nonzero(lab)
                area = np.bincount(lab[y, x])
                yield pd.DataFrame({"sheet_id": r.sheet_id, "x": x, "y": y, "component": lab[y, x], "area": area[lab[y, x]], "main": int(area.argmax()), "largest": int(area.max())})

    return g.mapInPandas(run, "sheet_id long, x long, y long, component long, area long, main long, largest long")


def layers(px: DataFrame, inks: DataFrame) -> DataFrame:
    """Pixels of glyphs (sheet_id, ch, width, height, x, y, r, g, b, br, bg, bb: paper) and inks (face, centres) by ``face``: each pixel of ink that stays,
    with the place of its colour, and whether islands of the glyph went.

    Specks (under 12 pixels and 3 % of the largest component) go; of letters and digits of one part also components under half of the largest.
    """
    p = measured(px.drop("br", "bg", "bb"), px.select("sheet_id", "br", "bg", "bb").distinct()).filter(coloured()).join(inks, "face").withColumn("place", nearest(F.col("centres")).cast("long"))
    parts = labelled(p)
    j = p.select("sheet_id", "ch", "x", "y", "place").join(parts, ["sheet_id", "x", "y"]).filter(F.col("area") >= F.greatest(F.lit(12), 0.03 * F.col("largest")))
    whole = F.col("ch").rlike("^[A-Za-z0-9]$") & ~F.lit(PARTS).contains(F.col("ch"))
    island = whole & (F.col("component") != F.col("main")) & (F.col("area") < 0.5 * F.col("largest"))
    j = j.withColumn("stray", F.max(island).over(Window.partitionBy("sheet_id")))
    return j.filter(~island).select("sheet_id", "x", "y", "place", "stray")


def spread(masks: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Masks (keys, x, y) with the eight neighbours of each pixel, inside the raster."""
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.col(c) - 1, F.lit(0)), F.least(F.col(c) + 1, F.lit(n - 1))))
    return masks.select(*keys, near("x", width).alias("x"), "y").distinct().select(*keys, "x", near("y", height).alias("y")).distinct()
