"""Exact dedup: groups of equal texts by a 128-bit content hash, bytes compared inside each group.

Main path: DataFrame functions only.  Rows are grouped by (128-bit hash, text): the hash spreads the rows and
decides almost every comparison, and within equal hashes Spark's aggregation compares the bytes of the texts.
Copies in one partition meet before the shuffle (partial aggregation), so that a group of copies which holds a
third of all rows sends one row per partition.  The way back to the rows is an equi-join on hash and SHA-256;
its group side has one row per group, and adaptive execution splits a hot key on the other side.

Defined results: a null text counts as empty; runs of ASCII white space count as one space; a null doc_id is the
largest (it stays only if its whole group has none); rows that repeat a doc_id each count and all rows with the
group's smallest doc_id are marked kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, row_hash, table, texts


def normalised(col):
    return F.regexp_replace(col, SPACE, " ")


def hash128(col):
    """Two 64-bit hashes with different seeds."""
    return [F.xxhash64(col).alias("h1"), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - 2**64), col).alias("h2")]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = texts(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    groups = (
        rows.select("doc_id", "norm", *hash128(F.col("norm")))
        .groupBy("h1", "h2", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h1", "h2", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    each = rows.select("doc_id", *hash128(F.col("norm")), F.sha2("norm", 256).alias("text_sha256"))
    return each.join(groups, ["h1", "h2", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without later copies: all columns of the rows that stay, exactly one row a group.

    Null texts count as empty; a null doc_id is the largest; of rows that repeat a doc_id the one with the smallest hash of
    all its columns stays; columns may have any names.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    norm = normalised(F.coalesce(text, F.lit("")))
    tag = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), row_hash(docs))
    # only the kept row of each group carries its columns over the shuffle: the partial minimum is per partition;
    # its text goes with it only where it isn't its own normal form
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.when(text != norm, text).alias("t"), text.isNull().alias("none"))
    groups = docs.select(*hash128(norm), norm.alias("norm"), tag.alias("tag"), row.alias("row")).groupBy("h1", "h2", "norm").agg(F.min_by("row", "tag").alias("row"))
    value = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {"text": F.when(~F.col("row.none"), F.coalesce("row.t", "norm")).cast(docs.schema["text"].dataType)}
    return groups.select(*[value[c].alias(c) for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
"""
