"""WARC: a content-addressed archive.

The archive has two tables in the warehouse: ``payloads`` keeps the bytes of each different payload once under
its SHA-256, verified by SHA-1 and length (records with one SHA-256 that differ in these raise), ``records`` keeps the exact
WARC header of every record.  Both are hash-bucketed by digest, so that the join that puts the original records together
again needs no shuffle.  Of equal payloads the record with the largest page_id is the response, the others revisit it;
payloads shorter than ``least_bytes`` are always responses.

Copies in one partition meet before the shuffle (partial aggregation), so a payload that a third of all pages share
is sent once per partition; its records, not its bytes, meet in one bucket.  Buckets hold about 128 MB of payloads.
DataFrame functions only.

Defined results: null html is an empty payload; a null url gives an empty target; line ends in a url become spaces; a null
page_id is smaller than any other; rows that repeat a page_id: each is a record, and those with the group's largest page_id
are all responses (only rows that are equal in page_id, url and html have one record id); an empty table gives empty
archives; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

BUCKET_BYTES = 128_000_000
#: Alphabet of base32 (RFC 4648; fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"


def base32_sha1(col):
    """Bare upper-case base32 of the SHA-1 of a binary column: 40 hex digits are 8 times 20 bits."""
    hexed = F.sha1(col)
    out = []
    for k in range(8):
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id, own):
    """The name of a record: its page and a hash of its url and digest."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.lpad(F.lower(F.hex(own)), 16, "0"), F.lit(">"))


def record_header(warc_type, ident, url, n_bytes, sha1, refers, date: str):
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")
    revisit = warc_type == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", warc_type), line("WARC-Record-ID", ident), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Refers-To", refers), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(n_bytes.cast("string"))), F.lit(EOL),
    )


def header_field(name: str, pattern: str):
    """The part in brackets of a field's value; lines of a header end in CR and LF, which no value holds."""
    return F.regexp_extract("header", f"{EOL}{name}: {pattern}{EOL}", 1)


class Archive:
    """Names of the two tables of an archive."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, base = spark, name or f"tl_warc_{uuid.uuid4().hex}"
        self.payloads, self.records = f"{base}_payloads", f"{base}_records"


def write_archive(pages: DataFrame, least_bytes: int = 0, buckets: int | None = None, name: str | None = None, date: str | None = None) -> Archive:
    """Write both tables; payload bytes are moved once and stored once.  ``date`` is the records' WARC-Date, by default now."""
    spark = pages.sparkSession
    archive = Archive(spark, name)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
        buckets = max(partitions, -(-size // BUCKET_BYTES))
    store = lambda df, to: df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(to)
    dealt = lambda df: df if buckets == partitions else df.repartition(buckets, "digest")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("own", F.xxhash64("url", "digest"))
    check = F.struct(base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    kept = rows.select("digest", "payload", check.alias("check"), F.struct("page_id", "own").alias("holder")).groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("check").alias("check"), F.max("check").alias("other"), F.max("holder").alias("holder")
    )
    verified = F.when(F.col("check") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one SHA-256")).cast("binary"))
    store(dealt(kept).select("digest", verified.alias("payload"), "check.*", F.col("holder.page_id").alias("holder"), F.col("holder.own").alias("holder_own")), archive.payloads)
    facts = spark.table(archive.payloads).select("digest", "sha1", "n_bytes", "holder", "holder_own")
    heads = rows.select("page_id", "url", "digest", "own").repartition(buckets, "digest").join(facts, "digest")
    kind = F.when((F.col("n_bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("holder")), F.lit("response")).otherwise(F.lit("revisit"))
    header = record_header(kind, record_id(F.col("page_id"), F.col("own")), F.col("url"), F.col("n_bytes"), F.col("sha1"), record_id(F.col("holder"), F.col("holder_own")), date)
    store(heads.select("digest", "page_id", header.alias("header")), archive.records)
    return archive


def read_archive(archive: Archive) -> DataFrame:
    """The original records: page_id, header (exact text), payload (exact bytes, of revisits too)."""
    spark = archive.spark
    return spark.table(archive.records).join(spark.table(archive.payloads).select("digest", "payload"), "digest").select("page_id", "header", "payload")


def drop_archive(archive: Archive) -> None:
    for t in (archive.payloads, archive.records):
        archive.spark.sql(f"DROP TABLE IF EXISTS {t}")


def record_bytes(header, payload):
    """A record as it stands in a WARC file."""
    is_revisit = F.regexp_extract(header, rf"^WARC/1.1{EOL}WARC-Type: (\w+){EOL}", 1) == "revisit"
    return F.concat(F.encode(header, "UTF-8"), F.when(is_revisit, F.lit(b"")).otherwise(payload), F.lit(b"\r\n\r\n"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"))
    refers = header_field("WARC-Refers-To", r"<urn:page:(-?\d+):[0-9a-f]{16}>")
    rows = settle(
        read_archive(archive).select(
            "page_id",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
            header_field("WARC-Type", r"(\w+)").alias("record_type"),
            F.when(refers != "", refers.cast("long")).alias("refers_to"),
        )
    )
    drop_archive(archive)
    return rows
