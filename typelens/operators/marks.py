"""Accents: what a letter's decomposition says of its marks, and detached marks given to the letters they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import upper_median
from ..functions.text import nfd
from ..sources.shipping import settle

#: Combining marks that stand under a letter (fixed values), and letters whose caron stands beside them.
BELOW, BESIDE = r"̖-̳̹-̼ͅ", "[ďťľĽ]"
DESCENDING = "gjpqy"


def with_accent(df: DataFrame, char: str = "char") -> DataFrame:
    """df with ``base``, ``above`` and ``below`` of Latin letters with marks; nulls for all other characters."""
    d = df.withColumn("_d", nfd(F.col(char)))
    marked = F.col("_d").rlike(r"^[A-Za-z]\p{M}+$")
    of = lambda c: F.when(marked, c)
    return d.withColumns({"base": of(F.substring("_d", 1, 1)), "above": of(F.col("_d").rlike(rf"[\p{{M}}&&[^{BELOW}]]")), "below": of(F.col("_d").rlike(f"[{BELOW}]"))}).drop("_d")


def box(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}_{c}") for c in ("x0", "x1", "y0", "y1")}


def expected(char: Column, above: Column, below: Column, mark: dict[str, Column], body: dict[str, Column]) -> Column:
    """Whether a mark (half-open boxes) stands where the letter's decomposition has one: over or under its body, no further than 0.65 of its height; or beside it."""
    h, w = body["y1"] - body["y0"], body["x1"] - body["x0"]
    margin = F.greatest(w * 0.25, h * 0.15)
    over = (mark["x1"] >= body["x0"] - margin) & (mark["x0"] <= body["x1"] + margin)
    up = above & (mark["y1"] <= body["y0"] + 1) & (body["y0"] - mark["y1"] <= h * 0.65)
    down = below & (mark["y0"] >= body["y1"] - 1) & (mark["y0"] - body["y1"] <= h * 0.65)
    beside = (
        char.rlike(BESIDE) & (mark["x0"] >= body["x0"] + w * 0.5) & ((mark["x0"] + mark["x1"]) / 2 >= body["x1"] - h * 0.1) & (mark["x0"] - body["x1"] <= h * 0.4)
        & (mark["y1"] <= body["y0"] + h * 0.45) & (mark["y0"] >= body["y0"] - h * 0.65)
    )
    return above.isNotNull() & ((over & (up | down)) | beside)


def bodies(px: DataFrame, cells: DataFrame) -> DataFrame:
    """Labelled pixels (sheet_id, x, y, component, area) and cells (sheet_id, row, cell, char, x0, x1, y0, y1) -> cells with the component that has
    most pixels in them (of equals the first in reading order), its box and area; null for cells without ink."""
    shapes = px.groupBy("sheet_id", "component").agg(F.min("x").alias("b_x0"), (F.max("x") + 1).alias("b_x1"), F.min("y").alias("b_y0"), (F.max("y") + 1).alias("b_y1"), F.count(F.lit(1)).alias("b_area"))
    span = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) - 1))
    rows = cells.select("sheet_id", "row", "y0", "y1").distinct().select("sheet_id", "row", span("y0", "y1").alias("y"))
    places = cells.filter("x1 > x0").select("sheet_id", "row", "cell", span("x0", "x1").alias("x"))
    n = px.join(rows, ["sheet_id", "y"]).join(places, ["sheet_id", "row", "x"]).groupBy("sheet_id", "row", "cell", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("y", "x")).alias("at"))
    first = F.row_number().over(Window.partitionBy("sheet_id", "row", "cell").orderBy(F.desc("n"), "at"))
    best = n.withColumn("k", first).filter("k = 1").select("sheet_id", "row", "cell", F.col("component").alias("body"))
    b = cells.join(best, ["sheet_id", "row", "cell"], "left")
    return b.join(shapes.withColumnRenamed("component", "body"), ["sheet_id", "body"], "left")


def owners(px: DataFrame, cells: DataFrame) -> DataFrame:
    """(sheet_id, mark, row, cell): detached components of two pixels and more with the accented letter that they fit best (of equals the first).

    Ink at the height of a letter and beside it is that letter's own unless it is where its mark belongs; a body that already reaches under its row's base line has
    its lower mark; marks are smaller than their letters.  Pairs are those of one sheet.
    """
    c = settle(with_accent(bodies(px, cells)).filter("body is not null"))
    letter = F.col("char").rlike(r"^\p{L}$") & ~F.coalesce("below", F.lit(False)) & ~F.lit(DESCENDING).contains(F.coalesce("base", "char"))
    foot = c.groupBy("sheet_id", "row").agg(upper_median(F.when(letter, F.col("b_y1"))).alias("foot"))
    c = settle(c.join(foot, ["sheet_id", "row"], "left"))
    shapes = px.groupBy("sheet_id", F.col("component").alias("mark")).agg(F.min("x").alias("m_x0"), (F.max("x") + 1).alias("m_x1"), F.min("y").alias("m_y0"), (F.max("y") + 1).alias("m_y1"), F.count(F.lit(1)).alias("m_area"))
    loose = shapes.filter("m_area >= 2").join(c.select("sheet_id", F.col("body").alias("mark")).distinct(), ["sheet_id", "mark"], "left_anti")
    j, m, b = loose.join(c, "sheet_id"), box("m"), box("b")
    h, w = b["y1"] - b["y0"], b["x1"] - b["x0"]
    fits = expected(F.col("char"), F.col("above"), F.col("below"), m, b)
    aside = F.greatest(F.lit(0), b["x0"] - m["x1"], m["x0"] - b["x1"])
    within = (m["y0"] >= b["y0"]) & (m["y1"] <= b["y1"]) & (aside <= F.greatest(F.lit(2.0), h * 0.12)) & ~F.coalesce(fits, F.lit(False))
    small = (m["y1"] - m["y0"] <= h * 0.55) & (m["x1"] - m["x0"] <= h * 0.9) & (F.col("m_area") <= F.col("b_area") * 0.75)
    has = (m["y0"] >= b["y1"]) & F.col("foot").isNotNull() & (b["y1"] > F.col("foot") + F.greatest(F.lit(2.0), h * 0.05))
    dy = F.greatest(F.lit(0), b["y0"] - m["y1"], m["y0"] - b["y1"])
    dx = F.abs((m["x0"] + m["x1"] - b["x0"] - b["x1"]) / 2)
    score = dy / h + 0.25 * dx / F.greatest(w.cast("double"), h * 0.5)
    g = j.groupBy("sheet_id", "mark").agg(F.bool_or(within).alias("inner"), F.min(F.when(fits & small & ~F.coalesce(has, F.lit(False)), F.struct(score.alias("s"), "row", "cell"))).alias("best"))
    return g.filter("not inner and best is not null").select("sheet_id", "mark", "best.row", "best.cell")
