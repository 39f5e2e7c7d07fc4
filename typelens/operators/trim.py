"""Flourish trim: letters placed by their bodies, tails overhanging, and taken back where pairs would run into each other.

A face's letters are few (one glyph a character): its pairs are folded in the row, in their order, as what one gives back changes the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import clamp, upper_median

#: Pairs at risk of being misread, in the order in which they are looked at (fixed values), and letters whose right side is theirs.
PAIRS = "ri rn rm ru rh rl rb rk Ch Cl Ck Cb Cd Gh Gl Gn oi ol nn ll tt hi mi ui ft".split()
RIGHT = "rCG"
SCRIPT, DEEP = 0.4, 0.08  # a script has so many letters with tails of so much of their width


def scripts(bounds: DataFrame) -> DataFrame:
    """(sheet_id, face, first, last, x0, x1: ink and body) -> face, script."""
    deep = F.greatest(F.col("x0") - F.col("first"), F.col("last") - F.col("x1")) >= (F.col("last") - F.col("first") + 1) * DEEP
    return bounds.groupBy("face").agg((F.count_if(deep) / F.count(F.lit(1)) >= SCRIPT).alias("script"))


def depths(sides: DataFrame, letters: DataFrame, strip: DataFrame) -> DataFrame:
    """Per face and pair of PAIRS the least distance (face, k, l, r, d) from the right side of the one to the left side of the other, both drawn in the
    same place, over the lines of the strip that both have.  sides (sheet_id, y, left, right: last column), letters (face, ch, sheet_id), strip (face, y)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p[0]).alias("l"), F.lit(p[1]).alias("r")) for k, p in enumerate(PAIRS)])
    s = sides.join(letters, "sheet_id").join(strip, ["face", "y"], "left_semi").withColumn("p", F.explode(pairs))
    left = s.filter("ch = p.l").select("face", "p", "y", "right")
    right = s.filter("ch = p.r").select("face", "p", "y", "left")
    return left.join(right, ["face", "p", "y"]).groupBy("face", "p.k", "p.l", "p.r").agg(F.min(F.col("left") - F.col("right")).alias("d"))


def fold(letters: Column, pairs: Column, pad: int, pen: Column) -> Column:
    """Letters (ch, first, last, x0, x1: body or null for whole ones, cell) after all pairs (l, r, d) in turn: where a pair runs deeper than ``pen`` into
    each other, the left letter gets back of its right side what is missing, as far as it has any, then the right letter of its left side."""
    whole = lambda g: g["x0"].isNull()
    advance = lambda g: F.when(whole(g), F.greatest(F.lit(1), g["cell"])).otherwise(g["x1"] - g["x0"] + 1 + 2 * pad)
    shift = lambda g: F.when(whole(g), 0).otherwise(pad - g["x0"])
    of = lambda state, ch: F.get(F.filter(state, lambda g: g["ch"] == ch), F.lit(0))

    def step(state, p):
        l, r = of(state, p["l"]), of(state, p["r"])  # noqa: E741
        missing = F.greatest(F.coalesce(-(advance(l) + shift(r) - shift(l) + p["d"]) - pen, F.lit(0)), F.lit(0))
        given = F.when(whole(l), 0).otherwise(F.least(missing, F.greatest(l["last"] - l["x1"], F.lit(0))))
        rest = F.when(whole(r), 0).otherwise(F.least(missing - given, F.greatest(r["x0"] - r["first"], F.lit(0))))
        more = lambda g, ch, n: F.when(g["ch"] == ch, n).otherwise(0)
        return F.transform(state, lambda g: g.withField("x1", (g["x1"] + more(g, p["l"], given)).cast("long")).withField("x0", (g["x0"] - more(g, p["r"], rest)).cast("long")))

    return F.aggregate(pairs, letters, step)


#: Letters that leave by a descender, and those that leave high (fixed values).
DESCENDER, HIGH = "gjqyz", "ovwbdsur"


def tails(glyphs: DataFrame, gate: float = 0.6, most: float = 1.1, least: int = 4) -> DataFrame:
    """Letters that join on their left (sheet_id, face, first, x0: ink and body, xh) -> (sheet_id, entry, scale): the length of the entry in x-heights, and by
    what it is drawn towards the body.  Only in faces of ``least`` such letters and more whose median entry is over ``gate`` are entries over ``most`` shortened."""
    g = glyphs.withColumn("entry", (F.col("x0") - F.col("first")) / F.col("xh"))
    m = g.groupBy("face").agg(upper_median(F.col("entry")).alias("median"), F.count(F.lit(1)).alias("n"))
    long = (F.col("n") >= least) & (F.col("median") > gate) & (F.col("entry") > most)
    return g.join(m, "face").select("sheet_id", "entry", F.when(long, most / F.col("entry")).alias("scale"))


def snaps(glyphs: DataFrame, gate: float = 0.2, spread: float = 0.12, low: float = 0.08, high: float = 0.3, down: float = 0.5, up: float = 0.25) -> DataFrame:
    """Letters that join on both sides (sheet_id, face, ch, first, last, x0, x1, base, ly, ry: lines of the outermost ink in the joining band, xh) ->
    (sheet_id, exit_dy, entry_dy): by how much ends of connectors move on to the face's join line, the median of its entries within ``low`` and ``high``.

    Only in faces of four letters and more whose plain exits ride over their entries by more than ``gate``, or whose entries scatter by more than ``spread``;
    there letters with high exits move too, and ends may also be raised.  All in x-heights; moves under a line are none.
    """
    entry, leave = (F.col("base") - F.col("ly")) / F.col("xh"), (F.col("base") - F.col("ry")) / F.col("xh")
    plain = ~F.lit(DESCENDER + HIGH).contains(F.col("ch"))
    g = glyphs.withColumns({"entry": entry, "plain": plain})
    m = g.groupBy("face").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("plain").alias("k"), upper_median(F.col("entry")).alias("median"), upper_median(F.when(F.col("plain"), leave)).alias("leave"), F.stddev_pop("entry").alias("sd")
    )
    g = g.join(m.filter("n >= 4 and k >= 2"), "face").withColumn("scattered", F.col("sd") > spread).filter(F.col("scattered") | (F.col("leave") - F.col("median") > gate))
    join = F.col("base") - clamp(F.col("median"), low, high) * F.col("xh")

    def move(line, can):
        raw = join - F.col(line)
        dy = F.when(raw >= 0, F.least(down * F.col("xh"), raw)).when(F.col("scattered"), F.greatest(-up * F.col("xh"), raw)).otherwise(F.lit(0.0))
        return F.when(can & (F.abs(dy) >= 1), dy).otherwise(F.lit(0.0))

    leaves = (F.col("plain") | (F.col("scattered") & ~F.lit(DESCENDER).contains(F.col("ch")))) & (F.col("last") > F.col("x1"))
    return g.select("sheet_id", move("ry", leaves).alias("exit_dy"), move("ly", F.col("first") < F.col("x0")).alias("entry_dy"))
