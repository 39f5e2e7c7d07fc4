"""Rows of a sheet cut into cells, and the cells' own ink.

Rows are frames of (sheet_id, row, y0, y1, chars, width, height, top, ink): ``ink`` has the lines of the band [y0, y1) and
those around it, from line ``top`` on, in reading order.  Labelling and growing need a raster at hand and run inside a row;
what follows, on components, runs and cells, are joins, windows and groups by (sheet_id, row).  A group is one row of a sheet.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import half_up
from ..sources.shipping import settle
from . import components as K
from . import islands as I

KEYS = ["sheet_id", "row"]
SPECK = 2  # the least area of a component that is assigned to a cell
PAD = 2
REACH = 0.4  # of a row's height: how far its ink is followed beyond its band
COMPONENTS = "sheet_id long, row long, component long, x0 long, x1 long, y0 long, y1 long, area long, centroid double, spots array<int>"
RUNS = "sheet_id long, row long, x0 long, x1 long, alien boolean"
GLYPHS = "sheet_id long, row long, cell long, x0 long, x1 long, top long, bottom long, baseline long, ink long"


def rows_of(sheets: DataFrame, bands: DataFrame) -> DataFrame:
    """Sheets (sheet_id, width, ink) and bands (sheet_id, row, y0, y1, chars) -> rows, with the lines around them that their ink and padding can reach."""
    r = sheets.join(bands, "sheet_id").withColumn("height", (F.size("ink") / F.col("width")).cast("long"))
    reach = F.ceil((F.col("y1") - F.col("y0")) * REACH) + PAD
    top, bottom = F.greatest(F.col("y0") - reach, F.lit(0)), F.least(F.col("y1") + reach, F.col("height"))
    cut = F.slice("ink", (top * F.col("width") + 1).cast("int"), ((bottom - top) * F.col("width")).cast("int"))
    return r.select(*KEYS, "y0", "y1", "chars", F.col("width").cast("long").alias("width"), "height", top.cast("long").alias("top"), cut.alias("ink"))


def count_of(chars: Column) -> Column:
    """Characters of a line (code points)."""
    return F.char_length(chars).cast("long")


def _rasters(batches: Iterator[pd.DataFrame]):
    """Each row with its raster of lines and the places of the band's first line and of the one behind its last in it."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            mask = np.asarray(r.ink, bool).reshape(-1, int(r.width))
            yield r, mask, int(r.y0 - r.top), int(r.y1 - r.top)


def components(rows: DataFrame) -> DataFrame:
    """4-connected components of each row's band, in reading order of their first pixels, with half-open boxes and their pixels
    (line of the sheet * width + column)."""

    def run(batches):
        for r, mask, a, b in _rasters(batches):
            lab = K.label(mask[a:b])
            y, x = np.nonzero(lab)
            if not len(y):
                continue
            each = pd.DataFrame({"component": lab[y, x], "x": x, "y": y + r.y0})
            g = each.groupby("component")
            out = pd.DataFrame({"x0": g["x"].min(), "x1": g["x"].max() + 1, "y0": g["y"].min(), "y1": g["y"].max() + 1, "area": g.size(), "centroid": g["x"].sum() / g.size()}).reset_index()
            each["spot"] = each["y"] * int(r.width) + each["x"]
            out["spots"] = [v.tolist() for _, v in each.groupby("component")["spot"]]
            out.insert(0, "sheet_id", r.sheet_id)
            out.insert(1, "row", r.row)
            yield out[[c.split()[0] for c in COMPONENTS.split(", ")]]

    return rows.mapInPandas(run, COMPONENTS)


def profile(rows: DataFrame) -> DataFrame:
    """rows (without their ink) with ``profile``: the ink of each column inside the band."""
    kept = ["y0", "y1", "chars", "width"]

    def run(batches):
        for pdf in batches:
            yield pdf[[*KEYS, *kept]].assign(profile=[mask[a:b].sum(0).tolist() for _, mask, a, b in _rasters([pdf])])

    return rows.mapInPandas(run, "sheet_id long, row long, y0 long, y1 long, chars string, width long, profile array<bigint>")


def anchored(profiles: DataFrame, expected: Column) -> DataFrame:
    """rows with ``ranges``: as many cells as expected, cut at the column with least ink near each place of an even pitch; of equals the first."""
    filled = F.transform("profile", lambda v: v > 0)
    first = F.coalesce(F.nullif(F.array_position(filled, True), F.lit(0)) - 1, F.lit(0))
    last = F.when(F.array_contains(filled, True), F.col("width") - F.array_position(F.reverse(filled), True) + 1).otherwise(F.col("width"))
    rows = profiles.withColumns({"_n": expected, "_a": first.cast("long"), "_b": last.cast("long")}).withColumn("_p", (F.col("_b") - F.col("_a")) / F.col("_n"))

    def cut(k):
        at = half_up(F.col("_a") + k * F.col("_p"))
        lo, hi = F.greatest(F.col("_a"), half_up(at - 0.35 * F.col("_p"))), F.least(F.col("_b"), half_up(at + 0.35 * F.col("_p")))
        near = F.slice("profile", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
        return F.when(hi > lo, lo + F.array_position(near, F.array_min(near)) - 1).otherwise(at).cast("long")

    inner = F.when(F.col("_n") > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.col("_n") - 1), cut)).otherwise(F.array().cast("array<bigint>"))
    cuts = F.concat(F.array("_a"), inner, F.array("_b"))
    pairs = F.zip_with(F.slice("_c", 1, F.size("_c") - 1), F.slice("_c", 2, F.size("_c") - 1), lambda a, b: F.struct(a.alias("x0"), b.alias("x1")))
    return rows.filter("_n > 0").withColumn("_c", cuts).withColumn("ranges", pairs).drop("_n", "_a", "_b", "_p", "_c")


def component_cells(comps: DataFrame, rows: DataFrame, expected: Column) -> DataFrame:
    """Components (of SPECK pixels and more) with the cell that they belong to, by places of letters and gaps between them.

    No more components than expected are a cell each.  Else neighbours by centroid nearer than 0.4 of the pitch stay together,
    two letters (0.4 of the row's height and more) that are not so near are parted, then the widest gaps, until there are enough cells.
    """
    facts = rows.select(*KEYS, F.col("y1").alias("_y1"), F.col("y0").alias("_y0"), expected.alias("_n"))
    c = comps.filter(F.col("area") >= SPECK).join(facts, KEYS).filter("_n > 0")
    row = Window.partitionBy(*KEYS)
    by_left, by_middle = row.orderBy("x0", "component"), row.orderBy("centroid", "x0", "component")
    c = c.withColumns({
        "_all": F.count(F.lit(1)).over(row), "_left": F.row_number().over(by_left) - 1, "_k": F.row_number().over(by_middle),
        "_pitch": (F.max("x1").over(row) - F.min("x0").over(row)) / F.col("_n"), "_tall": F.col("y1") - F.col("y0") >= (F.col("_y1") - F.col("_y0")) * 0.4,
    })
    after = lambda x: F.lead(x).over(by_middle)
    c = c.withColumns({"_gap": after("x0") - F.col("x1"), "_near": after("centroid") - F.col("centroid") < F.col("_pitch") * 0.4, "_both": F.col("_tall") & after("_tall")})
    kind = F.when(F.col("_gap").isNull() | F.col("_near"), "no").when(F.col("_both"), "must").otherwise("may")
    c = c.withColumn("_kind", kind).withColumn("_must", F.count_if(F.col("_kind") == "must").over(row))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "_kind").orderBy(F.desc("_gap"), "_k"))
    left = F.when(F.col("_kind") == "must", F.col("_n") - 1).otherwise(F.col("_n") - 1 - F.col("_must"))
    c = c.withColumn("_cut", ((F.col("_kind") != "no") & (rank <= left)).cast("long"))
    cell = F.coalesce(F.sum("_cut").over(by_middle.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("cell", F.when(F.col("_all") <= F.col("_n"), F.col("_left")).otherwise(cell).cast("long")).select(*comps.columns, "cell")


def owned_components(comps: DataFrame, ranged: DataFrame) -> DataFrame:
    """Components with the cell whose range has their centroid; an empty cell then takes the nearest group of a neighbour that has more.

    A group ends where centroids are further apart than a quarter of the neighbour's range; the right neighbour is asked first, cells go
    from left to right, until nothing changes.
    """
    one = F.struct("centroid", "x0", "component")
    held = comps.filter(F.col("area") >= SPECK).groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("parts"))
    # the order of a stable sort by centroid of parts in reading order
    each = F.array_sort("parts", lambda a, b: F.when(a["centroid"] < b["centroid"], -1).when(a["centroid"] > b["centroid"], 1).otherwise((a["component"] - b["component"]).cast("int")))

    def run(batches):
        for pdf in batches:
            for sheet, row, parts, ranges in zip(pdf["sheet_id"], pdf["row"], pdf["parts"], pdf["ranges"]):
                edges = [(r["x0"], r["x1"]) for r in ranges]
                cells: list[list] = [[] for _ in edges]
                for p in parts:
                    home = next((i for i, (a, b) in enumerate(edges) if a <= p["centroid"] < b), None)
                    if home is not None:
                        cells[home].append(p)
                settle_empty(cells, [(b - a) * 0.25 for a, b in edges])
                if out := [(sheet, row, p["component"], i) for i, cell in enumerate(cells) for p in cell]:
                    yield pd.DataFrame(out, columns=["sheet_id", "row", "component", "cell"])

    homes = held.withColumn("parts", each).join(ranged.select(*KEYS, "ranges"), KEYS).mapInPandas(run, "sheet_id long, row long, component long, cell long")
    return comps.join(homes, [*KEYS, "component"]).select(*comps.columns, "cell")


def settle_empty(cells: list[list], apart: list[float]) -> None:
    """Fill empty cells from neighbours of more than one group; ``apart`` is, per cell, the distance that parts its groups."""
    breaks = lambda i: [j for j in range(1, len(cells[i])) if cells[i][j]["centroid"] - cells[i][j - 1]["centroid"] > apart[i]]
    changed = True
    while changed:  # a cell that has been filled is never emptied
        changed = False
        for i in range(len(cells)):
            if cells[i]:
                continue
            if i + 1 < len(cells) and (at := breaks(i + 1)):
                cells[i], cells[i + 1] = cells[i + 1][: at[0]], cells[i + 1][at[0] :]
            elif i and (at := breaks(i - 1)):
                cells[i - 1], cells[i] = cells[i - 1][: at[-1]], cells[i - 1][at[-1] :]
            changed = changed or bool(cells[i])


def boxes(owned: DataFrame) -> DataFrame:
    """Per cell the columns from its components' first to their last."""
    return owned.groupBy(*KEYS, "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def owned_cells(owned: DataFrame, ranged: DataFrame) -> DataFrame:
    """Every cell: what it owns, or its range where it owns nothing."""
    cells = ranged.select(*KEYS, F.posexplode("ranges").alias("cell", "r")).select(*KEYS, F.col("cell").cast("long").alias("cell"), F.col("r.x0").alias("a"), F.col("r.x1").alias("b"))
    return cells.join(boxes(owned), [*KEYS, "cell"], "left").select(*KEYS, "cell", F.coalesce("x0", "a").alias("x0"), F.coalesce("x1", "b").alias("x1"))


def runs(rows: DataFrame) -> DataFrame:
    """Runs of columns with ink in a row's band; ``alien``: shallow ink at the head or the foot that goes on beyond the band."""

    def run(batches):
        for r, mask, a, b in _rasters(batches):
            band = mask[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], band.any(0), [False]]).astype(np.int8)))
            wide = np.pad(mask, ((1, 1), (1, 1)))  # line i of the raster is line i + 1 here
            out = []
            for x0, x1 in edge.reshape(-1, 2):
                lines = np.flatnonzero(band[:, x0:x1].any(1))
                over = lambda inside, outside: (mask[inside, x0:x1] & (wide[outside + 1, x0:x1] | wide[outside + 1, x0 + 1 : x1 + 1] | wide[outside + 1, x0 + 2 : x1 + 2])).any()  # noqa: B023, E731
                head = lines[-1] < (b - a) * 0.25 and over(a, a - 1)
                foot = lines[0] > (b - a) - (b - a) * 0.25 and over(b - 1, b)
                out.append((r.sheet_id, r.row, x0, x1, bool(head or foot)))
            if out:
                yield pd.DataFrame(out, columns=["sheet_id", "row", "x0", "x1", "alien"])

    return rows.mapInPandas(run, RUNS)


def gap_cells(found: DataFrame, rows: DataFrame, expected: Column) -> DataFrame:
    """Runs joined into as many cells as expected by the widest gaps between them, cut in their middles; only rows where all of these are
    wide (2 columns, and 0.08 of the height)."""
    line = Window.partitionBy(*KEYS).orderBy("x0")
    r = found.join(rows.select(*KEYS, "y0", "y1", expected.alias("_n")), KEYS).withColumns({"gap": F.lead("x0").over(line) - F.col("x1"), "next": F.lead("x0").over(line), "all": F.count(F.lit(1)).over(Window.partitionBy(*KEYS))})
    r = r.filter((F.col("_n") > 0) & (F.col("all") > F.col("_n"))).withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("gap").desc_nulls_last(), "x0")))
    cut = F.when((F.col("rank") < F.col("_n")) & F.col("gap").isNotNull(), half_up((F.col("x1") + F.col("next")) / 2))
    narrow = F.count_if(cut.isNotNull() & (F.col("gap") < F.greatest(F.lit(2), (F.col("y1") - F.col("y0")) * 0.08)))
    g = r.withColumn("cut", cut).groupBy(*KEYS).agg(narrow.alias("narrow"), F.array_sort(F.collect_list("cut")).alias("cuts"), F.min("x0").alias("a"), F.max("x1").alias("b")).filter("narrow = 0")
    g = g.select(*KEYS, F.concat(F.array("a"), "cuts", F.array("b")).alias("e"))
    cells = F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.get("e", i - 1).alias("x0"), F.get("e", i).alias("x1")))
    return g.select(*KEYS, F.posexplode(cells).alias("cell", "r")).select(*KEYS, F.col("cell").cast("long").alias("cell"), "r.x0", "r.x1")


def parted_cells(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs joined into as many cells (sheet_id, row, n: two and more) as a row has, cut in the middles of the widest gaps (of equals the first); only rows
    with as many runs at least, all of whose cuts are wide: two columns, and 0.18 of a cell."""
    line = Window.partitionBy(*KEYS).orderBy("x0")
    row = Window.partitionBy(*KEYS)
    r = found.join(expected, KEYS).filter("n > 1").withColumns({"next": F.lead("x0").over(line), "a": F.min("x0").over(row), "b": F.max("x1").over(row), "all": F.count(F.lit(1)).over(row)})
    r = r.withColumn("gap", F.col("next") - F.col("x1")).filter("all >= n and b - a >= n")
    r = r.withColumn("rank", F.row_number().over(row.orderBy(F.col("gap").desc_nulls_last(), "x0"))).filter("gap is not null and rank < n")
    g = r.groupBy(*KEYS, "n", "a", "b").agg(F.min("gap").alias("least"), F.array_sort(F.collect_list(half_up((F.col("x1") + F.col("next")) / 2))).alias("cuts"))
    g = g.filter(F.col("least") >= F.greatest(F.lit(2.0), (F.col("b") - F.col("a")) / F.col("n") * 0.18)).select(*KEYS, F.concat(F.array("a"), "cuts", F.array("b")).alias("e"))
    cells = F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e") - 1), lambda p, q: F.struct(p.alias("x0"), q.alias("x1")))
    return g.select(*KEYS, F.posexplode(cells).alias("cell", "r")).select(*KEYS, F.col("cell").cast("long").alias("cell"), "r.x0", "r.x1")


def seam(band: np.ndarray, lo: int, hi: int) -> np.ndarray | None:
    """The column in each line of a path from top to bottom through the columns lo to hi that meets least ink, a step aside at most a line; steps aside
    cost a little; of equal ways to a place that from the left, of equal paths the leftmost end."""
    lo, hi = max(0, lo), min(band.shape[1] - 1, hi)
    if hi < lo or not len(band):
        return None
    ink = band[:, lo : hi + 1].astype(float)
    cost, back = ink[0], []
    for line in ink[1:]:
        ways = np.stack([np.append(np.inf, cost[:-1]), cost, np.append(cost[1:], np.inf)])
        step = ways.argmin(0)
        back.append(step - 1)
        cost = line + ways.min(0) + 0.001 * (step != 1)
    at = int(cost.argmin())
    path = [at]
    for step in reversed(back):
        at += int(step[at])
        path.append(at)
    return np.array(path[::-1]) + lo


def shares(widths: list[int], n: int, typical: float) -> list[int]:
    """How many of n letters each blob holds: by its width, one at least; too many are taken from the fullest, missing ones go to the widest per letter."""
    counts = [max(1, int(np.floor(w / typical + 0.5))) for w in widths]
    while sum(counts) > n and max(counts) > 1:
        counts[int(np.argmax(counts))] -= 1
    while sum(counts) < n:
        counts[int(np.argmax([w / c for w, c in zip(widths, counts)]))] += 1
    return counts


def seam_cells(band: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """n cells between seams (a column a line): a blob of columns each where there are n blobs; of fewer the wide ones are parted at seams; of more the
    row is parted at an even pitch.  None for a row without ink, or that has no n cells."""
    on = band.any(0)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
    if n < 1 or not edge:
        return []
    flat = lambda v: np.full(len(band), v)
    nearest = lambda v: int(np.floor(v + 0.5))

    def cut(at: float, half: float) -> np.ndarray:
        found = seam(band, nearest(at - half), nearest(at + half))
        return flat(nearest(at)) if found is None else found

    def parts(a: int, b: int, k: int, half: float) -> list:
        pitch = (b - a) / k
        lines = [flat(a), *[cut(a + i * pitch, pitch * half) for i in range(1, k)], flat(b)]
        return list(zip(lines, lines[1:]))

    x0, x1 = edge[0][0], edge[-1][1]
    if len(edge) > n:
        return parts(x0, x1, n, 0.42)
    counts = [1] * n if len(edge) == n else shares([b - a for a, b in edge], n, (x1 - x0) / n)
    return [c for (a, b), k in zip(edge, counts) for c in parts(a, b, k, 0.45)]


SEAMS = "sheet_id long, row long, cell long, lefts array<bigint>, rights array<bigint>, ink long"


def seamed(rows: DataFrame, expected: Column) -> DataFrame:
    """Each row's cells between seams, with the ink in them."""

    def run(batches):
        for r, mask, a, b in _rasters(batches):
            band, out = mask[a:b], []
            x = np.arange(band.shape[1])
            for k, (left, right) in enumerate(seam_cells(band, int(r.n))):
                inside = (x >= left[:, None]) & (x < right[:, None])
                out.append((r.sheet_id, r.row, k, left.tolist(), right.tolist(), int((band & inside).sum())))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SEAMS.split(", ")])

    return rows.withColumn("n", expected).mapInPandas(run, SEAMS)


def numbered(ranges: DataFrame) -> DataFrame:
    return ranges.select(*KEYS, (F.row_number().over(Window.partitionBy(*KEYS).orderBy("x0")) - 1).cast("long").alias("cell"), "x0", "x1")


#: Characters that are neither letters, digits nor spaces.
SYMBOL = r"[^\p{L}\p{N} ]"


def _marked(c: str) -> bool:
    base, *rest = unicodedata.normalize("NFD", c)
    return base.isascii() and base.isalpha() and bool(rest) and all(unicodedata.category(m)[0] == "M" for m in rest)


#: Latin letters with a mark as single characters.
COMPOSED = "".join(c for c in map(chr, range(0x80, 0x2200)) if _marked(c))


def has_accent(chars: Column) -> Column:
    """Whether a line has a Latin letter with a mark, composed or not."""
    return chars.rlike(f"[{COMPOSED}]|[A-Za-z]\\p{{M}}")


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ways to cut each row: (sheet_id, row, slicer, cell, x0, x1), and the components with the cells that own them, per slicer."""
    expected = count_of(F.col("chars"))
    comps = settle(components(rows))
    ranged = anchored(profile(rows), expected)
    found = runs(rows)
    clean = I.merged_narrow(found.filter(~F.col("alien")).select(*KEYS, F.col("x0").alias("start"), F.col("x1").alias("stop")), KEYS)
    fewer = found.filter("alien").select(*KEYS).distinct()
    by_parts, by_place = component_cells(comps, rows, expected), owned_components(comps, ranged)
    even = ranged.select(*KEYS, F.posexplode("ranges").alias("cell", "r")).select(*KEYS, F.col("cell").cast("long").alias("cell"), "r.x0", "r.x1")
    ways = {
        "gaps": gap_cells(found, rows, expected), "whitespace": numbered(found), "clean": numbered(clean.join(fewer, KEYS, "left_semi").select(*KEYS, F.col("start").alias("x0"), F.col("stop").alias("x1"))),
        "components": boxes(by_parts), "ownership": owned_cells(by_place, ranged), "anchored": even,
    }
    cells = None
    for name, c in ways.items():
        c = c.select(*KEYS, F.lit(name).alias("slicer"), "cell", "x0", "x1")
        cells = c if cells is None else cells.unionByName(c)
    owners = by_parts.withColumn("slicer", F.lit("components")).unionByName(by_place.withColumn("slicer", F.lit("ownership")))
    return cells, owners


def chosen(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Per row the way to cut it (way, slicer), whether cuts are forced, and the number of cells that were found without force."""
    n = cells.groupBy(*KEYS).pivot("slicer", ["gaps", "whitespace", "clean", "components", "ownership", "anchored"]).count().na.fill(0)
    r = rows.select(*KEYS, "chars", count_of(F.col("chars")).alias("expected")).join(n, KEYS, "left").na.fill(0)
    e = F.col("expected")
    accented, symbols = has_accent(F.col("chars")), F.col("chars").rlike(SYMBOL)
    way = (
        F.when(accented & (F.col("gaps") > 0), "gaps").when(symbols & (F.col("components") == e), "components").when(symbols & (F.col("ownership") == e), "ownership").when(symbols, "anchored")
        .when(F.col("whitespace") == e, "whitespace").when((F.col("whitespace") > e) & (F.col("clean") == e), "clean").when(F.col("components") == e, "components")
        .when((F.col("whitespace") > e) & (F.col("ownership") == e), "ownership").otherwise("anchored")
    )
    r = r.withColumn("way", way)
    forced = (F.col("way") == "anchored") | ((F.col("way") == "ownership") & ~symbols)
    natural = F.when(forced & symbols, F.greatest("components", "ownership")).when(forced, F.col("whitespace")).otherwise(e)
    slicer = F.when(F.col("way").isin("gaps", "clean"), "whitespace").otherwise(F.col("way"))
    return r.select(*KEYS, "way", slicer.alias("slicer"), forced.alias("forced"), natural.alias("natural"))


def spread(mask: np.ndarray) -> np.ndarray:
    """A mask and its eight neighbours."""
    p = np.pad(mask, 1)
    rows = p[:-2] | p[1:-1] | p[2:]
    return rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]


def grown(seed: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """All of ``allowed`` that a path of eight neighbours joins to the seed."""
    now = seed & allowed
    while True:
        more = spread(now) & allowed
        if (more == now).all():
            return now
        now = more


def recovered(mask: np.ndarray, free: np.ndarray, a: int, b: int) -> tuple[int, int, np.ndarray | None]:
    """A cell's first line, the one behind its last, and the ink that is joined to the middle half of the band [a, b) where that reaches
    beyond the band (else none).  ``mask`` is the ink of the cell's columns, with lines around the band; ``free`` is what no other cell owns."""
    line = lambda y: mask[y] if 0 <= y < len(mask) else np.zeros(mask.shape[1], bool)
    beside = lambda v: v | np.append(v[1:], False) | np.append(False, v[:-1])
    if not ((line(a) & beside(line(a - 1))).any() or (line(b - 1) & beside(line(b))).any()):
        return a, b, None
    lines, reach = np.arange(len(mask))[:, None] - a, np.ceil((b - a) * REACH)
    seed = (lines >= np.ceil((b - a) * 0.25)) & (lines < (b - a) * 0.75)
    joined = grown(mask & free & seed, mask & free & (lines >= -reach) & (lines < b - a + reach))
    y = np.flatnonzero(joined.any(1))
    top, bottom = int(min(a, y.min(initial=a))), int(max(b, y.max(initial=b - 1) + 1))
    return top, bottom, None if (top, bottom) == (a, b) else joined


def own_ink(mask: np.ndarray, free: np.ndarray, a: int, b: int, x0: int, x1: int) -> tuple[int, int, np.ndarray]:
    """The lines of a cell in columns [x0, x1), and its ink in these columns: what is free in the band, what is joined to it outside (and
    touches that), and in the padding beyond both only what touches the cell's ink."""
    top, bottom, joined = recovered(mask[:, x0:x1], free[:, x0:x1], a, b)
    lo, hi = max(0, x0 - 1), min(mask.shape[1], x1 + 1)  # what lies beside the columns counts as touching
    lines = np.arange(len(mask))[:, None]
    band, inside = (lines >= a) & (lines < b), (lines >= top) & (lines < bottom)
    may = free[:, lo:hi] & band
    if joined is not None:
        here = np.zeros(may.shape, bool)
        here[:, x0 - lo : x1 - lo] = joined
        may = may | (spread(here) & ~band)
    ink = mask[:, lo:hi]
    may = (may & inside) | (spread(ink & may & inside) & ~inside)
    return top, bottom, (ink & may)[:, x0 - lo : x1 - lo]


def baseline(band: np.ndarray) -> int:
    """The line, from the band's first, where most columns have their last ink; of few such columns the 70th percentile."""
    if not len(band) or not band.any():
        return len(band) - 1
    last = len(band) - 1 - band[::-1].argmax(0)[band.any(0)]
    n = np.bincount(last)
    return int(n.argmax()) if n.max() >= len(last) * 0.12 else int(np.sort(last)[int(len(last) * 0.7)])


def glyphs(rows: DataFrame, cells: DataFrame, owners: DataFrame) -> DataFrame:
    """The cells of rows as glyphs: padded columns and lines, the place of the row's base line in the cell, and the cell's own ink.

    ``cells`` (sheet_id, row, cell, x0, x1); ``owners`` (sheet_id, row, cell, spots), for rows whose cells own components.
    """
    held = cells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("cell", "x0", "x1"))).alias("cells"))
    own = owners.groupBy(*KEYS).agg(F.collect_list(F.struct("cell", "spots")).alias("own"))

    def run(batches):
        for r, mask, a, b in _rasters(batches):
            owner = np.full(mask.shape, -1)
            for part in r.own if r.own is not None else ():
                spots = np.asarray(part["spots"]) - int(r.top) * int(r.width)
                owner.reshape(-1)[spots] = part["cell"]
            base, out = baseline(mask[a:b]) + r.y0, []
            for c in r.cells:
                if c["x1"] <= c["x0"]:
                    continue
                x0, x1 = max(0, c["x0"] - PAD), min(int(r.width), c["x1"] + PAD)
                top, bottom, ink = own_ink(mask, np.isin(owner, (-1, c["cell"])), a, b, x0, x1)
                first, last = max(0, top + r.top - PAD), min(r.height, bottom + r.top + PAD)
                out.append((r.sheet_id, r.row, c["cell"], x0, x1, first, last, base - first, int(ink[first - r.top : last - r.top].sum())))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in GLYPHS.split(", ")])

    return rows.join(held, KEYS).join(own, KEYS, "left").mapInPandas(run, GLYPHS)
