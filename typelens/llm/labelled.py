"""Labelled rows for classifiers: a documented, bounded sample for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts


def crc(col, modulus: int):
    """crc32 of the id as text, modulo; null ids have remainder -1 (they are never held out and never learnt from)."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % modulus, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, text, y, part (0..99, by hash): about ``bound`` labelled rows outside the held-out remainder.

    Ids with contradicting labels count as 1.  The labels side has at most about ``bound`` small rows, so it is
    broadcast; the documents are not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter((crc(F.col("doc_id"), modulus) != held_out)).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    share = min(1.0, bound / max(n, 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    known = known.filter(draw < int(share * 1_000_000)).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(100)))
    return texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y", "part")
