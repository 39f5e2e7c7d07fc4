"""Text, JSON and byte rules applied to the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as X
from ..sources.bindings import activity, fonts, sql, table, users
from ..sources.shipping import ship
from . import query

_SLUG = """substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9_\\s.\\-]', '', 'g')), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 32)"""


@query(sql(f"SELECT id, coalesce(nullif({_SLUG.format(x='name')}, ''), 'untitled') AS slug, {_SLUG.format(x='maker_handle')} AS handle, length({_SLUG.format(x='maker_handle')}) BETWEEN 2 AND 32 AND {_SLUG.format(x='maker_handle')} NOT IN ('admin', 'about') AS valid FROM fonts_v", "fonts_v"))
def slugify_names(spark, d):
    ship(spark)
    h = X.handle(F.col("maker_handle"))
    return fonts(spark, d).select("id", X.slug(F.col("name")).alias("slug"), h.alias("handle"), (F.length(h).between(2, 32) & ~h.isin("admin", "about")).alias("valid"))


@query(sql(""", b AS (SELECT id, split_part(lower(name), ' ', 1) AS base FROM fonts_v), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS rn FROM b)
SELECT id, CASE WHEN rn = 1 THEN base WHEN rn <= 8 THEN base || '-' || CAST(rn AS VARCHAR) ELSE base || '-' || substr(sha256(CAST(id AS VARCHAR)), 1, 5) END AS handle FROM r""", "fonts_v"))
def handle_candidates(spark, d):
    b = fonts(spark, d).select("id", F.split_part(F.lower("name"), F.lit(" "), F.lit(1)).alias("base"))
    rn = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    tail = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 5)
    return b.withColumn("rn", rn).select("id", F.when(F.col("rn") == 1, F.col("base")).when(F.col("rn") <= 8, F.concat_ws("-", "base", F.col("rn").cast("string"))).otherwise(F.concat_ws("-", "base", tail)).alias("handle"))


@query(sql("""SELECT id, name, regexp_replace(translate(lower(name), '013457@$', 'oieastas'), '[^a-z]', '', 'g') IN ('redpart') OR regexp_replace(translate(lower(name), '013457@$', 'oieastas'), '[^a-z]', '', 'g') LIKE '%ring%' AS screened FROM fonts_v""", "fonts_v"))
def banned_words(spark, d):
    """A neutral word list; the list is a parameter."""
    return fonts(spark, d).select("id", "name", X.screened(F.col("name"), ["redpart"], ["ring"]).alias("screened"))


@query(r"""SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(html, '(?i)(?:data:|blob:|https?://|file://)[^\s"''<>]+', '[URL]', 'g'), '\s+', ' ', 'g')), 1, 1000), ''), 'No error message provided.') AS message FROM pages""")
def redact_urls(spark, d):
    return table(spark, d, "pages").select("page_id", X.redacted(F.col("html")).alias("message"))


_CLASS = "CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{n}'" for m, n in X.FAILURES) + " ELSE 'other' END"


@query(f"SELECT conv_id, turn, {_CLASS} AS class FROM conversations")
def classify_errors(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.failure_class(F.col("text")).alias("class"))


@query(sql("""SELECT id, coalesce(json_extract_string(meta, '$.badge'), 'none') AS badge, coalesce(json_extract_string(meta, '$.license'), 'OFL') AS license,
coalesce(CAST(json_extract_string(meta, '$.size') AS BIGINT), 0) AS size FROM fonts_v UNION ALL SELECT -1, 'none', 'OFL', 0""", "fonts_v"))
def meta_merge(spark, d):
    """Defaults under the parsed document; a malformed one gives the defaults only."""
    f = fonts(spark, d).select("id", "meta").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("{broken").alias("meta")))
    m = F.from_json("meta", "badge string, license string, size bigint")
    return f.select("id", m.alias("m")).select("id", F.coalesce("m.badge", F.lit("none")).alias("badge"), F.coalesce("m.license", F.lit("OFL")).alias("license"), F.coalesce("m.size", F.lit(0)).alias("size"))


@query(sql("""SELECT event_id, 'k: ' || CAST(k AS VARCHAR) || chr(10) || 'event: ' || event || CASE WHEN meta <> '' THEN chr(10) || 'meta: ' || meta ELSE '' END AS context, meta <> '' AS substance FROM activity_v""", "activity_v"))
def context_whitelist(spark, d):
    """Known keys only, in a stable order; empty values are left out."""
    line = lambda k, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), F.substring(F.trim(v), 1, 200)))
    raw = activity(spark, d).select("event_id", F.to_json(F.struct("k", "event", "meta", F.lit("dropped").alias("secret"))).alias("raw"))
    p = raw.select("event_id", F.from_json("raw", "k string, event string, meta string").alias("p"))
    return p.select("event_id", F.concat_ws("\n", line("k", F.col("p.k")), line("event", F.col("p.event")), line("meta", F.col("p.meta"))).alias("context"), (F.col("p.meta") != "").alias("substance"))


@query(sql(r"SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(handle, '[\s@.]+'), lambda p: p <> '')[1:2], lambda p: upper(substr(p, 1, 1))), '') AS initials FROM user_v", "user_v"))
def initials(spark, d):
    return users(spark, d).select("id", X.initials(F.col("handle")).alias("initials"))


@query("""SELECT doc_id, CASE WHEN substr(hex(encode(coalesce(text, ''))), 1, 8) = '4F54544F' THEN 'otf' WHEN substr(hex(encode(coalesce(text, ''))), 1, 8) = '774F4632' THEN 'woff2' ELSE 'other' END AS kind, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT -1, 'otf', 8 UNION ALL SELECT -2, 'ttf', 5 UNION ALL SELECT -3, 'png', 8 UNION ALL SELECT -4, 'webp', 12 UNION ALL SELECT -5, 'jpeg', 4""")
def byte_signature(spark, d):
    blobs = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    made = ["4F54544F00000000", "0001000000", "89504E470D0A1A0A", "524946460000000057454250", "FFD8FFE0"]
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-k - 1).cast("long").alias("doc_id"), F.unhex(F.lit(x)).alias("b")) for k, x in enumerate(made)])).alias("s")).select("s.*")
    return blobs.unionByName(more).select("doc_id", B.signature(F.col("b")).alias("kind"), F.octet_length("b").cast("long").alias("bytes"))


@query("""SELECT doc_id, CAST(coalesce(list_sum(list_transform(range(0, len(h) // 8), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT)), 0) % 4294967296 AS BIGINT) AS sum32 FROM
(SELECT doc_id, b || repeat('0', (8 - length(b) % 8) % 8) AS h FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents))""")
def u32_checksum(spark, d):
    ship(spark)
    return table(spark, d, "documents").select("doc_id", B.checksum(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("sum32"))


@query(sql(r"SELECT event_id, meta, regexp_full_match(meta, '[A-Za-z0-9_+.\-]*') AND length(meta) <= 40 AS accepted, replace(replace(replace(event || '<&>', '&', chr(92) || 'u0026'), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e') AS safe FROM activity_v", "activity_v"))
def event_validation(spark, d):
    a = activity(spark, d)
    return a.select("event_id", "meta", (F.col("meta").rlike(r"^[\w+.\-]*$") & (F.length("meta") <= 40)).alias("accepted"), X.script_safe(F.concat("event", F.lit("<&>"))).alias("safe"))


@query(sql("SELECT id, CAST(CAST(floor(glyph_count * 300 / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' AS size, CAST(greatest(16, least(96, floor(480.0 / greatest(1, length(name)) + 0.5))) AS BIGINT) AS px, name || ';' || CASE WHEN badge = 'LARGE' THEN 'big;' ELSE '' END || 'end' AS style FROM fonts_v", "fonts_v"))
def specimen_style(spark, d):
    px = F.least(F.lit(96), F.greatest(F.lit(16), F.floor(480.0 / F.greatest(F.lit(1), F.length("name")) + 0.5)))
    return fonts(spark, d).select("id", X.kilobytes(F.col("glyph_count") * 300).alias("size"), px.cast("long").alias("px"), F.concat_ws(";", "name", F.when(F.col("badge") == "LARGE", "big"), F.lit("end")).alias("style"))


@query(r"""SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_rows, CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS chars, list_distinct(lines)[1] IS NOT NULL AS any_row FROM
(SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: nfc_normalize(regexp_replace(x, '[ \t]+$', ''))), lambda x: x <> '') AS lines FROM documents)""")
def charset_lines(spark, d):
    """The lines of a text as rows of a charset: without blanks at their ends, composed, empty ones dropped."""
    ship(spark)
    lines = F.transform(F.split(X.nfc(F.coalesce("text", F.lit(""))), "\r?\n"), lambda x: F.regexp_replace(x, "[ \t]+$", ""))
    rows = table(spark, d, "documents").select("doc_id", F.filter(lines, lambda x: x != "").alias("l"))
    size = F.size("l").cast("long")
    return rows.select("doc_id", size.alias("n_rows"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), (size > 0).alias("any_row"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS distinct_chars, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS repeated FROM
(SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c NOT IN (' ', chr(10)) GROUP BY 1, 2) GROUP BY doc_id""")
def charset_problems(spark, d):
    """Of all characters of a text, as a character set (spaces and line ends are none): how many differ, how many come again.  An empty text counts as one, as in the SQL."""
    ship(spark)
    return X.character_counts(table(spark, d, "documents").select("doc_id", "text"), " \n", empty=1).filter("distinct_chars > 0")
