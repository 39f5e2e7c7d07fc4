"""Fonts and images as bytes: a file is made of each item's name, whole or broken, with metadata or without."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..sources.bindings import fonts, sql
from ..sources.shipping import ship
from . import query

# hexadecimal text that both engines read: n is an item's name in bytes (ASCII), as text h
_BASE = "SELECT id, name, upper(hex(name)) AS h, length(name) AS n FROM {src}"
_SIZE = "lpad(upper(hex(CAST({0} AS BIGINT))), 8, '0')"


def _chunk(kind: str, data: str, size: str) -> str:
    """A PNG chunk; its checksum is not looked at."""
    return f"{_SIZE.format(size)} || '{kind}' || {data} || '00000000'"


_HEAD = "'89504E470D0A1A0A' || " + _chunk("49484452", f"'{'00' * 13}'", "13")
_TAIL = _chunk("49444154", "h", "n") + " || " + _chunk("49454E44", "''", "0")
_LITTLE = "substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2)"


def _riff(kind: str, data: str, size: str) -> str:
    return f"'{kind}' || {_LITTLE.format(_SIZE.format(size))} || {data} || CASE WHEN {size} % 2 = 1 THEN '00' ELSE '' END"


def _webp(flags: str, more: str) -> str:
    body = f"'57454250' || {_riff('56503858', f'''{flags} || '000000000000000000' ''', '10')} || {_riff('56503820', 'h', 'n')}{more}"
    return f"(SELECT '52494646' || {_LITTLE.format(_SIZE.format('length(b) / 2'))} || b FROM (SELECT {body} AS b))"


_SEG = "'{0}' || lpad(upper(hex(CAST(n + 2 AS BIGINT))), 4, '0') || h"
_JPEG = ("'FFD8FFE00004" + "4A46' || ", " || 'FFDA0003AA' || '11FF0022FFD033' || 'FFD9'")
#: The file and what is left of it when its metadata goes (null: it can't be read).
IMAGES = {
    0: (f"{_HEAD} || {_chunk('74455874', 'h', 'n')} || {_TAIL}", f"{_HEAD} || {_TAIL}"),
    1: (f"{_HEAD} || {_TAIL}", f"{_HEAD} || {_TAIL}"),
    2: (_JPEG[0] + _SEG.format("FFE1") + " || " + _SEG.format("FFE2") + " || " + _SEG.format("FFFE") + _JPEG[1], _JPEG[0] + _SEG.format("FFE2") + _JPEG[1]),
    3: (f"substr({_HEAD} || {_TAIL}, 1, 60)", "NULL"),
    4: ("h", "NULL"),
}


def _case(which: int) -> str:
    return "CASE id % 5 " + " ".join(f"WHEN {k} THEN {v[which]}" for k, v in IMAGES.items()) + " END"


def images(spark, d):
    """(id, key, content): pictures under avatars and elsewhere."""
    f = fonts(spark, d).selectExpr("id", "name", "upper(hex(encode(name, 'UTF-8'))) AS h", "octet_length(name) AS n")
    return f.select("id", F.expr(_KEY).alias("key"), F.unhex(F.expr(_case(0))).alias("content"))


_KEY = "CASE WHEN id % 3 = 0 THEN 'avatars/u_' || id || '.png' WHEN id % 3 = 1 THEN 'avatars/u ' || id || '.jpg' ELSE 'og/f.' || id || '.png' END"
_IMG = f", f AS (SELECT id, upper(hex(name)) AS h, length(name) AS n FROM fonts_v), im AS (SELECT id, {_KEY} AS key, {_case(0)} AS b, {_case(1)} AS kept FROM f)"


@query(sql(_IMG + " SELECT id, CASE WHEN kept IS NULL THEN 'unreadable' WHEN kept = b THEN 'clean' ELSE 'change' END AS status, CAST(length(b) // 2 AS BIGINT) AS bytes, sha256(unhex(kept)) AS kept_sha256 FROM im", "fonts_v"))
def stripped_images(spark, d):
    """Pictures without their metadata, and what that was: nothing, a change, or bytes that can't be read."""
    ship(spark)
    i = images(spark, d)
    return i.select("id", B.metadata_status(F.col("content")).alias("status"), F.octet_length("content").cast("long").alias("bytes"), F.sha2(B.stripped(F.col("content")), 256).alias("kept_sha256"))


@query(sql(_IMG + r" SELECT CASE WHEN kept IS NULL THEN 'unreadable' WHEN kept = b THEN 'clean' ELSE 'change' END AS status, count(*) AS n FROM im WHERE key LIKE 'avatars/%' AND regexp_full_match(key, 'avatars/[\w-]+\.(png|jpg|webp)') GROUP BY 1", "fonts_v"))
def image_metadata_audit(spark, d):
    """Tally of the avatars (keys by their prefix, then by their pattern) by what stripping does to them."""
    ship(spark)
    own = images(spark, d).filter(F.col("key").startswith("avatars/") & F.col("key").rlike(r"^avatars/[\w-]+\.(png|jpg|webp)$"))
    return own.groupBy(B.metadata_status(F.col("content")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# a font of two tables: its header, two records (tag, checksum, offset, length), the bodies
_PAD = "h || repeat('0', CAST((8 - length(h) % 8) % 8 AS INT))"
_WORDS = "CAST(list_sum(list_transform(range(0, length(p) // 8), lambda i: ('0x' || substr(p, 8 * i + 1, 8))::BIGINT)) % 4294967296 AS BIGINT)"


def _font(first: str, second: str) -> str:
    record = lambda tag, check, offset, size: f"'{tag}' || {_SIZE.format(check)} || {_SIZE.format(offset)} || {_SIZE.format(size)}"
    return f"'00010000' || '0002' || '000000000000' || {record('61626364', first, '44', '8')} || {record('6E616D65', second, '52', 'n')} || '0000000100000002' || p"


_FONTS = f""", f AS (SELECT id, n, p, {_WORDS} AS s FROM (SELECT id, n, {_PAD} AS p FROM (SELECT id, upper(hex(name)) AS h, length(name) AS n FROM fonts_v))),
ff AS (SELECT id, n, s, CASE WHEN id % 4 = 3 THEN substr(b, 1, 60) ELSE b END AS b, good FROM (SELECT *, {_font("CASE WHEN id % 4 = 2 THEN 9 ELSE 3 END", "CASE WHEN id % 2 = 1 THEN 7 ELSE s END")} AS b, {_font("3", "s")} AS good FROM f))"""


def font_files(spark, d):
    f = fonts(spark, d).selectExpr("id", "upper(hex(encode(name, 'UTF-8'))) AS h", "octet_length(name) AS n").selectExpr("id", "n", f"{_PAD} AS p")
    f = f.withColumn("s", B.checksum(F.unhex("p")))
    whole = F.expr(_font("CASE WHEN id % 4 = 2 THEN 9 ELSE 3 END", "CASE WHEN id % 2 = 1 THEN 7 ELSE s END"))
    return f.select("id", F.unhex(F.when(F.col("id") % 4 == 3, F.substring(whole, 1, 60)).otherwise(whole)).alias("content"))


@query(sql(_FONTS + """ SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE 2 END AS tables, CASE WHEN id % 4 = 3 THEN NULL ELSE 'abcd,name' END AS tags, CASE WHEN id % 4 = 3 THEN NULL ELSE CAST(n AS BIGINT) END AS last_length,
CASE WHEN id % 4 = 3 THEN 'directory cut short' ELSE concat_ws('; ', CASE WHEN id % 4 = 2 THEN 'abcd: checksum' END, CASE WHEN id % 2 = 1 AND s <> 7 THEN 'name: checksum' END) END AS errors, CASE WHEN id % 4 <> 3 THEN sha256(unhex(good)) END AS repaired_sha256 FROM ff""", "fonts_v"))
def font_directories(spark, d):
    """Font files: their tables, what is wrong with their checksums, and the digest of the file with right ones."""
    ship(spark)
    f = font_files(spark, d).withColumn("t", B.directory(F.col("content")))
    return f.select(
        "id", F.size("t").alias("n"), F.transform("t", lambda r: r["tag"]).alias("tags"), F.element_at("t", -1)["length"].alias("last_length"), F.array_join(B.font_errors(F.col("content")), "; ").alias("errors"), F.sha2(B.repaired(F.col("content")), 256).alias("repaired_sha256")
    ).select("id", F.when(F.col("tags").isNotNull(), F.col("n")).alias("tables"), F.array_join("tags", ",").alias("tags"), "last_length", "errors", "repaired_sha256")
