"""Streaming operators, drained over the whole events table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import ingest
from . import query


def _source(spark, d):
    # a file source reads folders; the glob keeps to the one table
    return spark.readStream.schema(ingest.EVENTS).option("pathGlobFilter", "events*").option("recursiveFileLookup", "false").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark, df, mode):
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="typelens-stream-")
    name = f"tl_{uuid.uuid4().hex}"
    return ingest.drain(df, name, mode, f"{shared}/{name}")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return _drain(spark, ingest.daily_counts(_source(spark, d)), "complete")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS h FROM events) GROUP BY 1")
def stream_once_per_hour(spark, d):
    """Append mode gives each admitted event once; they are counted per user."""
    return _drain(spark, ingest.once_per_hour(_source(spark, d)).select("user_id", "event_id"), "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 2")
def stream_rate_limit(spark, d):
    return _drain(spark, ingest.admitted(_source(spark, d), 2), "append")
