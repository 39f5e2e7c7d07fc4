"""From raw documents to packed sequences: five stages, each over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from typelens.llm import exact_dedup, packing, simhash, substring, toxicity
from typelens.llm.common import scratch, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model fitted to the labels of ``sf_dir`` scores under 0.5; null texts are empty ones."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for runs of white space: that with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that are linked by a Jaccard similarity of 0.8 or more: that with the smallest doc_id."""
    return simhash.keep_one_of_near(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that stand in a document with a smaller doc_id."""
    return substring.remove_spans(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a sequence of at most 1024 ids; null and empty texts have the end id."""
    items = settle(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(items).select(*packing.COLUMNS, "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: The model and the tokens have no SQL form; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each over the written result of the one before; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, f"stage{k}"))
            docs = spark.read.parquet(path)
    return docs
