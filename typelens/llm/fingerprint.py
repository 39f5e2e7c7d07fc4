"""Document fingerprints: a canonical exact digest.

A text is brought to a canonical form (NFKC, lower case, NFKC again, runs of white space as one space, no white
space at the ends) and that form is hashed to 128 bits by two seeded XXH64.  Documents are grouped by
(hash, canonical form), so bytes are compared inside equal buckets; were two different forms to share a hash, the
later ones (in the order of their SHA-256) get a number behind the hash, so that fingerprints are equal exactly when forms are.

Main path: DataFrame functions only; the normaliser is ICU's, which Spark ships, called by ``reflect``, and only
for texts with other characters than ASCII.

The following document (ascending doc_id) is found in ranges of 4096 doc_ids: inside a range by a window of at most
4096 different ids, across ranges by the same step, twice, over the first row of each range (65536 ranges at
once); what one window holds at the top stands for 2**44 doc_ids a row.

Defined results: null text counts as empty; a null doc_id comes last; rows that repeat a doc_id follow each other in
the order of their texts; a single document is its own next one; empty texts have the fingerprint of the empty form;
likeness is 1.0 for equal canonical forms, else 0.0 (an exact digest knows no other value); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts

RANGE, WIDER = 4096, 65536
_SALT = 0xC2B2AE3D27D4EB4F - 2**64
#: White space of Unicode (fixed values).
UNICODE_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _icu(col):
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))


def canonical(col):
    """NFKC, lower case, NFKC, white space folded; never null for a text that isn't."""
    plain = F.length(col) == F.octet_length(col)
    folded = F.when(plain, F.lower(col)).otherwise(_icu(F.lower(_icu(col))))
    return F.trim(F.regexp_replace(folded, UNICODE_SPACE, " "))


def digest(canon):
    """128 bits of a canonical form as 32 lowercase hex digits."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit(_SALT), canon)))


def fingerprint_groups(rows: DataFrame) -> DataFrame:
    """From (doc_id, canon): one row per different canonical form - fingerprint, canon, class_id, n_documents."""
    forms = rows.groupBy(digest(F.col("canon")).alias("hash"), "canon").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_documents"))
    forms = forms.select("hash", F.sha2("canon", 256).alias("canon_sha256"), "class_id", "n_documents")  # no text goes on from here
    clash = Window.partitionBy("hash").orderBy("canon_sha256")
    return forms.withColumn("_k", F.row_number().over(clash)).select(
        F.when(F.col("_k") == 1, F.col("hash")).otherwise(F.concat_ws("-", "hash", "_k")).alias("fingerprint"), "hash", "canon_sha256", "class_id", "n_documents"
    )


def _ends(rows: DataFrame, level: int = 0) -> DataFrame:
    """(b, first) with following: for each range b the first row of the next range that has rows, in a circle."""
    if level == 2:  # here a row stands for 2**44 doc_ids
        w = Window.orderBy("b")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.withColumn("following", F.coalesce(F.lead("first").over(w), F.first("first").over(whole)))
    rows = rows.withColumn("u", F.floor(F.col("b") / WIDER))
    w = Window.partitionBy("u").orderBy("b")
    inner = rows.withColumn("following", F.lead("first").over(w))
    heads = _ends(rows.groupBy("u").agg(F.min_by("first", "b").alias("first")).withColumnRenamed("u", "b"), level + 1)
    heads = heads.select(F.col("b").alias("u"), F.col("following").alias("_next"))
    return inner.join(heads, "u").select("b", "first", F.coalesce("following", "_next").alias("following"))


def with_next(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with next_text, the text of the next row by (doc_id, text), after the last the first."""
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(2**62)))
    w = Window.partitionBy("b").orderBy(F.col("doc_id").asc_nulls_last(), F.col("text"))
    first = rows.groupBy("b").agg(F.min_by("text", F.struct("doc_id", "text")).alias("first"))
    ends = _ends(first).select("b", "following")
    inner = rows.withColumn("next_text", F.lead("text").over(w))
    return inner.join(ends, "b").select("doc_id", "text", F.coalesce("next_text", "following").alias("next_text"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, edited: the last quarter of the code points replaced by the start of the next text."""
    return with_next(texts(docs)).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(length(text) / 4) as int))")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_id (smallest doc_id of the same canonical form), n_documents."""
    rows = texts(docs).select("doc_id", canonical(F.col("text")).alias("canon"))
    keys = rows.select("doc_id", digest(F.col("canon")).alias("hash"), F.sha2("canon", 256).alias("canon_sha256"))
    return keys.join(fingerprint_groups(rows), ["hash", "canon_sha256"]).select("doc_id", "fingerprint", "class_id", "n_documents")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = edited_texts(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("c"),
        canonical(F.col("edited")).alias("e"),
        canonical(F.col("next_text")).alias("x"),
    )
    like = lambda a, b: F.when((digest(F.col(a)) == digest(F.col(b))) & (F.col(a) == F.col(b)), 1.0).otherwise(0.0)
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("c")).alias("hash"), F.sha2("c", 256).alias("canon_sha256"),
        F.when(F.col("e") == F.col("c"), F.lit(None)).otherwise(digest(F.col("e"))).alias("edited_hash"),
        like("c", "e").alias("near_edited"), like("c", "x").alias("near_next"),
    )
    groups = fingerprint_groups(texts(docs).select("doc_id", canonical(F.col("text")).alias("canon")))
    return rows.join(groups, ["hash", "canon_sha256"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", F.coalesce("edited_hash", "fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", "class_id"
    )
