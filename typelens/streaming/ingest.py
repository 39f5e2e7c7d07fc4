"""Event ingest as Structured Streaming: validation, daily counters, admission by key and hour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shipping import ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come; event time is the row's own time."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, count), rows later than ``late`` dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("count"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "count")


def once_per_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each (user, type, hour bucket): the key is fixed per bucket, so state can go with the watermark."""
    bucket = F.window("ts", "1 hour").start.alias("bucket")
    return events.withColumn("bucket", bucket).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "bucket"])


#: So many keys of state an hour: one call of Python serves all users of a shard, and its state is the counters of these.
SHARDS = 8


def first_of(user: np.ndarray, order: tuple, users: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that are among the first ``limit`` of their user in an order (keys as for lexsort), counted on from ``counts`` of ``users`` (ascending); the users, the counts."""
    by = np.lexsort((*order, user))
    new, start, size = np.unique(user[by], return_index=True, return_counts=True)
    every = np.union1d(users, new)
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, users)] = counts
    at = np.searchsorted(every, new)
    rank = np.arange(len(by)) - np.repeat(start, size) + np.repeat(total[at], size)
    total[at] += size
    return by[rank < limit], every, total


def admitted(events: DataFrame, limit: int, seconds: int = 3600, late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """At most ``limit`` events per user and epoch bucket, by counters in state that go with the watermark.  No user is one user; no time and no id come last."""
    ship(events.sparkSession)

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        bucket, shard = key
        users, counts = (np.array(x, np.int64) for x in (state.get if state.exists else ((), ())))
        pdf = pd.concat(list(batches))  # a user's rows may come in several
        user, seen, event = (pdf[c].to_numpy() for c in ("user", "seen", "event_id"))
        ok, users, counts = first_of(user, (event, ~seen, pdf["ts"].to_numpy()), users, counts, limit)
        if len(ok):
            yield pd.DataFrame({"event_id": pd.arrays.IntegerArray(event[ok], ~seen[ok]), "user_id": pd.arrays.IntegerArray(user[ok], np.full(len(ok), shard < 0))})
        state.update((users.tolist(), counts.tolist()))
        end = 0 if pd.isna(bucket) else (int(bucket) + 1) * seconds * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    whole = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)  # pandas keeps ids whole where none is null
    rows = events.withWatermark("ts", late).select(
        "ts", F.floor(F.unix_seconds("ts") / seconds).alias("bucket"), F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(shards))).alias("shard"),
        whole("user_id").alias("user"), F.col("event_id").isNotNull().alias("seen"), whole("event_id"),
    )
    return rows.groupBy("bucket", "shard").applyInPandasWithState(run, "event_id long, user_id long", "users array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything there is now: rows that are appended go to files beside the checkpoint; a whole result, which is as
    small as its keys, goes to a table in memory."""
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{checkpoint}-rows").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(f"{checkpoint}-rows")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
