"""Fill-in-middle transformation: a share of the texts is cut into prefix, middle and suffix and written in another order.

A text's units are words, each with the white space before it, and a last run of white space.  The ends of all units are
collected once, in a compact array; two look-ups give the places of the cuts, and slices of the text do the rest.  Seeds
come from a digest of the document's number, so that a row gives the same result on any executor and in any order.

Defined results: a null text is an empty one, which stays as it is; texts that hold one of the three marks stay as they
are, so that the marks of an output are always its own; a null doc_id has the seed of an empty number; repeated rows
and empty tables go through; extra columns are ignored, whatever their names.  Whole texts are cut, of any length: a
unit costs four bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> array:
    """0 and the offset behind each unit."""
    ends = array("I", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    return ends


def seeds(seed: int, doc_id) -> tuple[int, ...]:
    """Four numbers of 32 bits from the digest of the seed and a document's number."""
    number = "" if doc_id is None else int(doc_id)
    h = hashlib.sha256(f"{seed}:{number}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in range(0, 16, 4))


def transform(doc_id, text: str, seed: int, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one document; rates are in per cent."""
    ends = unit_ends(text)
    n = len(ends) - 1
    first, second, chosen, order = seeds(seed, doc_id)
    if not text or chosen % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((ends[first % (n + 1)], ends[second % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made from; the first marks are its own, as the text has none."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "spm":
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    else:
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    return prefix + middle + suffix


def _small(it, limit: int = 4_000_000):
    """Series of ids and texts, cut so that a step holds about ``limit`` characters (one text at least)."""
    for ids, text in it:
        start, held, size = 0, 0, text.str.len()
        for i, x in enumerate(size):
            if held and held + x > limit:
                yield ids.iloc[start:i], text.iloc[start:i]
                start, held = i, 0
            held += x
        yield ids.iloc[start:], text.iloc[start:]


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output; ``rate`` of 100 documents are transformed, ``spm`` of 100 of these
    with the suffix first."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    @F.pandas_udf(COLUMNS)
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, text in _small(it):
            rows = [transform(i, t, seed, rate, spm) for i, t in zip(ids, text)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # as text: a series of numbers with a null among them would be one of floats
    rows = texts(docs).select("doc_id", "text", run(F.col("doc_id").cast("string"), "text").alias("r"))
    return rows.select("doc_id", "text", "r.*")


def restore(rows: DataFrame) -> DataFrame:
    """rows with ``output`` and ``form`` -> the same and ``restored``; nulls stay null."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for output, form in it:
            yield pd.Series([None if o is None or f is None else restored(o, f) for o, f in zip(output, form)], dtype=object)

    return rows.withColumn("restored", run("output", "form"))


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The columns of ``fill_middle`` but the texts, and digests of the output and of the text rebuilt from it, made where the
    output is, so that no text but the input's goes between the JVM and Python."""
    ship(docs.sparkSession)
    kept = COLUMNS.replace("output string", "output_sha256 string, restored_sha256 string")
    names = [c.split()[0] for c in kept.split(", ")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    @F.pandas_udf(kept)
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, text in it:
            rows = []
            for i, t in zip(ids, text):
                *counts, output = transform(i, t, seed, rate, spm)
                rows.append((*counts, digest(output), digest(restored(output, counts[1]))))
            yield pd.DataFrame(rows, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return texts(docs).select("doc_id", run(F.col("doc_id").cast("string"), "text").alias("r")).select("doc_id", "r.*")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and digests."""
    return digests(table(spark, sf_dir, "documents"))
