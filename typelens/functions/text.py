"""Text rules of the catalogue."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

#: Failure classes by the first marker that a lower-cased message holds (fixed values).
FAILURES = [
    ("engine did not load", "engine_load"), ("no glyphs", "no_glyphs"), ("rows but your charset", "rows_mismatch"),
    ("no character rows", "no_rows"), ("charset", "charset"), ("worker", "worker"),
]


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """No built-in form of Unicode normalisation gives decompositions; texts of ASCII only need not come here."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def decomposed(x: Column) -> Column:
    return F.when(F.length(x) == F.octet_length(x), x).otherwise(nfkd(x))


def handle(x: Column, limit: int = 32) -> Column:
    """Lower case, decomposed, word characters, dots and dashes only, dashes collapsed, at most ``limit`` characters."""
    s = F.regexp_replace(decomposed(F.lower(x)), r"[^A-Za-z0-9_\s.\-]", "")
    s = F.regexp_replace(F.regexp_replace(F.trim(s), r"[\s_]+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(s, r"^[-.]+|[-.]+$", ""), 1, limit)


def slug(x: Column, limit: int = 32) -> Column:
    s = handle(x, limit)
    return F.when(s == "", "untitled").otherwise(s)


def screened(x: Column, words: list[str], parts: list[str]) -> Column:
    """Whether x, digits and signs read as letters and all else dropped, is one of the words or holds one of the parts."""
    s = F.regexp_replace(F.translate(F.lower(x), "013457@$", "oieastas"), "[^a-z]", "")
    hit = s.isin(words)
    for p in parts:
        hit = hit | F.contains(s, F.lit(p))
    return hit


def redacted(x: Column, limit: int = 1000) -> Column:
    s = F.regexp_replace(x, r"""(?i)(?:data:|blob:|https?://|file://)[^\s"'<>]+""", "[URL]")
    s = F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, limit)
    return F.coalesce(F.when(s != "", s), F.lit("No error message provided."))


def failure_class(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for marker, name in FAILURES:
        out = F.when(F.contains(low, F.lit(marker)), name) if out is None else out.when(F.contains(low, F.lit(marker)), name)
    return out.otherwise("other")


def initials(x: Column) -> Column:
    parts = F.slice(F.filter(F.split(x, r"[\s@.]+"), lambda p: p != ""), 1, 2)
    return F.concat_ws("", F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))))


def script_safe(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("\\u0026")), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def kilobytes(n: Column) -> Column:
    return F.coalesce(F.concat(F.floor(n / 1024.0 + 0.5).cast("string"), F.lit(" KB")), F.lit("–"))


def allowed(email: Column, listed: Column) -> Column:
    """Whether a comma list has the address, whatever its case."""
    return F.array_contains(F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""), F.lower(email))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def row_list(rows: Column) -> Column:
    """Row 2; Rows 1 and 2; Rows 1, 2 and 3. Null for none."""
    text = F.transform(rows, lambda r: r.cast("string"))
    head = F.array_join(F.slice(text, F.lit(1), F.greatest(F.size(text) - 1, F.lit(1))), ", ")
    return F.when(F.size(text) == 1, F.concat(F.lit("Row "), head)).when(F.size(text) > 1, F.concat(F.lit("Rows "), head, F.lit(" and "), F.element_at(text, -1)))


def crowded(cells: Column, chars: list[int]) -> Column:
    """(row, chars, shapes) of the rows, from 1, that list three characters or more and show half as many shapes at most; none if the numbers of rows differ."""
    row = lambda i, n: F.struct(F.lit(i + 1).alias("row"), F.lit(n).alias("chars"), F.get(cells, F.lit(i)).alias("shapes"))
    found = F.filter(F.array(*[row(i, n) for i, n in enumerate(chars)]), lambda x: (x["chars"] >= 3) & (x["shapes"] <= F.floor(x["chars"] / 2)))
    return F.when(F.size(cells) == len(chars), found)


def source_keys(font: Column, meta: Column) -> Column:
    keys = F.transform(F.from_json(meta, "sourceSheets array<struct<key string>>")["sourceSheets"], lambda s: s["key"])
    prefix = F.concat(F.lit("sources/"), font, F.lit("/"))
    own = lambda k: F.startswith(k, prefix) & F.regexp_like(F.substr(k, F.length(prefix) + 1), F.lit(r"^(base|variation-[12]|supplement)\.(png|jpg|webp)$"))
    return F.coalesce(F.filter(keys, own), F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


def armed(raw: Column) -> Column:
    """The strings of a JSON array, composed, one per line; null for anything else, and for an empty array."""
    lines = F.array_join(F.from_json(raw, "array<string>"), "\n")
    text = F.when(F.schema_of_variant(F.try_parse_json(raw)) == "ARRAY<STRING>", lines)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(nfc(text))


def _number(x: str):
    """A number as JSON writers print it: whole ones without a point."""
    v = float(x)
    return int(v) if v.is_integer() and abs(v) < 1e21 else v


@F.pandas_udf(StructType().add("meta", StringType()).add("drop_og", BooleanType()))
def edited_meta(raw: pd.Series, name: pd.Series, license: pd.Series, specimen_changed: pd.Series) -> pd.DataFrame:
    """Types and order of unknown keys must stay, which no schema of a built-in parser keeps; what is no object counts as an empty one."""
    rows = []
    for text, family, terms, changed in zip(raw, name, license, specimen_changed):
        try:
            old = json.loads(text, parse_float=_number)
        except (TypeError, ValueError):
            old = None
        meta = dict(old) if isinstance(old, dict) else {}
        drop = bool(changed) and meta.get("og") is True
        meta |= {"family": family, "license": terms} | ({"og": False} if drop else {})
        rows.append((json.dumps(meta, ensure_ascii=False, separators=(",", ":")), drop))
    return pd.DataFrame(rows, columns=["meta", "drop_og"])


def repeats(text: str, without: str = "") -> tuple[int, int]:
    """How many characters of a text differ, and how many of them come again."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    none = [ord(c) for c in without]
    if codes.max(initial=0) < 1 << 16:
        n = np.bincount(codes, minlength=max(none, default=0) + 1)
        n[none] = 0
    else:
        found, n = np.unique(codes, return_counts=True)
        n = n[~np.isin(found, none)]
    return int((n > 0).sum()), int((n > 1).sum())


def character_counts(docs: DataFrame, without: str = "", empty: int = 0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, distinct_chars (``empty`` for an empty text), repeated; a null text has none.  A text is counted in its row, in one pass over its characters."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [repeats(x, without) if x else (0 if x is None else empty, 0) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), pa.int64()) for c in zip(*found)]], ["doc_id", "distinct_chars", "repeated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, distinct_chars long, repeated long")
