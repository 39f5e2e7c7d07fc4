"""Domain views over the test tables, and the same views as SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = {"view": "make_view", "purchase": "build_ok", "error": "build_fail", "click": "download", "signup": "library_download"}
INK = 0.12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("handle"), F.col("c_mktsegment").alias("segment"))


def fonts(spark, d):
    meta = F.concat(F.lit('{"badge":"'), F.col("p_type"), F.lit('","maker":"'), F.col("p_brand"), F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("maker_handle"), F.col("p_type").alias("badge"), F.col("p_size").cast("long").alias("glyph_count"),
        meta.alias("meta"), F.when(F.col("p_type") == "PROMO", "private").otherwise("public").alias("visibility"),
    )


def owned(spark, d):
    vis = F.when(F.col("o_orderstatus") == "P", "private").otherwise("public")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), vis.alias("visibility"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"))


def votes(spark, d, before: str | None = None):
    """One row per (user, font): repeated votes are the first one. ``before`` leaves out later votes at the scan: they are the first of none
    that has an earlier one."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    if before:
        li = li.filter(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("font_id")).agg(F.min("l_shipdate").alias("created_at"))


def activity(spark, d, only: str | None = None):
    """Events in the application's terms; ``only`` keeps one of them, by the stored name, which the scan can use."""
    k = F.get_json_object("props", "$.k").cast("long")
    event = F.create_map(*[F.lit(x) for kv in EVENT.items() for x in kv])[F.col("event_type")]
    rows = table(spark, d, "events").withColumn("k", k)
    if only:
        rows = rows.filter(F.col("event_type").isin([stored for stored, name in EVENT.items() if name == only]))
    return rows.select(
        "event_id", "ts", "user_id", F.to_date("ts").alias("day"), event.alias("event"), "value", "k",
        F.element_at(F.array(F.lit("upload"), F.lit("sample"), F.lit("unknown")), (F.col("k") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("k") % 4).cast("string"))).alias("meta"),
    )


def pixels(spark, d, over=INK):
    """One row per pixel of the 8 x 8 views of the vectors; ink is what is over a value."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), F.posexplode("embedding").alias("i", "value"))
    return v.select("sheet_id", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), F.col("value").cast("double").alias("value"), (F.col("value").cast("double") > over).alias("ink"))


def rasters(spark, d, over=INK):
    """One row per sheet: its ink in reading order, and its width."""
    ink = F.transform("embedding", lambda z: z.cast("double") > over)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), ink.alias("ink"), F.lit(8).alias("width"))


def pixel_rows(spark, d):
    """One row per sheet and scan line: ink as an array of 0/1 - the form that needs no shuffle."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), F.transform("embedding", lambda z: (z.cast("double") > INK).cast("int")).alias("bits"))
    return v.select("sheet_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(v["bits"], y * 8 + 1, 8))).alias("y", "line"))


VIEWS = {
    "user_v": "SELECT c_custkey AS id, c_name AS handle, c_mktsegment AS segment FROM customer",
    "fonts_v": """SELECT p_partkey AS id, p_name AS name, p_brand AS maker_handle, p_type AS badge, CAST(p_size AS BIGINT) AS glyph_count,
        '{"badge":"' || p_type || '","maker":"' || p_brand || '","size":' || CAST(p_size AS VARCHAR) || '}' AS meta,
        CASE WHEN p_type = 'PROMO' THEN 'private' ELSE 'public' END AS visibility FROM part""",
    "owned_v": "SELECT o_orderkey AS id, o_custkey AS owner_id, CASE WHEN o_orderstatus = 'P' THEN 'private' ELSE 'public' END AS visibility, o_orderdate AS created_at, o_orderpriority AS priority FROM orders",
    "votes_v": "SELECT o_custkey AS user_id, l_partkey AS font_id, min(l_shipdate) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "activity_v": """SELECT event_id, ts, user_id, CAST(ts AS DATE) AS day, value, k,
        CASE event_type WHEN 'view' THEN 'make_view' WHEN 'purchase' THEN 'build_ok' WHEN 'error' THEN 'build_fail' WHEN 'click' THEN 'download' WHEN 'signup' THEN 'library_download' END AS event,
        CASE k % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'sample' ELSE 'unknown' END AS source,
        CASE WHEN k % 5 = 0 THEN '' ELSE 'm' || CAST(k % 4 AS VARCHAR) END AS meta
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "pixels_v": f"""SELECT sheet_id, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y, CAST(embedding[i + 1] AS DOUBLE) AS value, CAST(embedding[i + 1] AS DOUBLE) > {INK} AS ink
        FROM (SELECT vec_id AS sheet_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)""",
}

#: The same pixels with twice the ink and more.
VIEWS["paint_v"] = VIEWS["pixels_v"].replace(f"> {INK} AS ink", "> 0 AS ink")


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """SQL text with the named views (and those they need) in front; body may start with further expressions ``, x AS (...)``."""
    with_ = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_} {body}"
