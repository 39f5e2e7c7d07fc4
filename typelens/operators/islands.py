"""Gaps and islands along an integer axis, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import upper_median


def islands(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Half-open runs [start, stop) of consecutive axis values present in df (distinct per key)."""
    w = Window.partitionBy(*keys).orderBy(axis)
    return df.withColumn("_g", F.col(axis) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(axis).alias("start"), (F.max(axis) + 1).alias("stop")).drop("_g")


def sessions(df: DataFrame, keys: list[str], breaks: Column, *order: Column) -> DataFrame:
    """df with a session number that grows at each row where ``breaks`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("session", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged_narrow(runs: DataFrame, keys: list[str], share: float = 0.35) -> DataFrame:
    """Runs joined over gaps under ``share`` of the upper-median gap; keys with fewer than three runs stay as they are."""
    w = Window.partitionBy(*keys).orderBy("start")
    gaps = runs.withColumn("gap", F.col("start") - F.lag("stop").over(w))
    facts = gaps.groupBy(*keys).agg(F.coalesce(upper_median(F.col("gap")), F.lit(1)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    joined = gaps.join(facts, keys)
    apart = F.col("gap").isNull() | (F.col("_n") < 3) | (F.col("gap") >= share * F.greatest("_m", F.lit(1)))
    return sessions(joined, keys, apart, F.col("start")).groupBy(*keys, "session").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("session")


def widest_gap_cuts(runs: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """The middles of the n - 1 widest gaps, in order of position."""
    w = Window.partitionBy(*keys).orderBy("start")
    gaps = runs.withColumn("from_", F.lag("stop").over(w)).filter("from_ is not null").withColumn("gap", F.col("start") - F.col("from_"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gap"), "start"))
    return gaps.withColumn("_r", rank).filter(F.col("_r") <= n - 1).select(*keys, ((F.col("from_") + F.col("start")) / 2).alias("cut"), "gap")


def spine(df: DataFrame, start, stop, day: str) -> DataFrame:
    """Every day from start to stop (inclusive), with the columns of df where it has the day."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"))).alias(day))
    return days.join(df, day, "left")
