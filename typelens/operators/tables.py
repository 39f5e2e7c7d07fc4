"""Keyed tables as pure functions: new table = f(old table, changes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import first_wins


def mark(df: DataFrame, other: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """df with a boolean: whether other has a row with these keys (nulls never match)."""
    keys = other.select(*[F.col(o).alias(f"_{i}") for i, o in enumerate(on.values())]).distinct().withColumn("_hit", F.lit(True))
    cond = None
    for i, own in enumerate(on):
        c = df[own] == keys[f"_{i}"]
        cond = c if cond is None else cond & c
    return df.join(keys, cond, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{i}" for i in range(len(on))])


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Insert, or add to the count of the row with the same keys."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or replace the row with the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *arrival: Column) -> DataFrame:
    """Insert rows whose keys are new; of several with the same keys the first to arrive."""
    return old.unionByName(first_wins(new, keys, *arrival).join(old, keys, "left_anti").select(*old.columns))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are set after all toggles: an odd number of them."""
    return events.groupBy(*keys).count().filter("count % 2 = 1").drop("count")


def recount(owners: DataFrame, owner_key: str, facts: DataFrame, fact_key: str, name: str) -> DataFrame:
    n = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return owners.join(n, owners[owner_key] == n["_k"], "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def patched(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Update columns by key where a change has a value."""
    c = changes.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in columns])
    out = old.join(c, keys, "left")
    return out.select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in columns else F.col(x) for x in old.columns])


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str, refs: dict[str, str], nulled: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Remove the rows that refer to the keys in ``gone``; where ``nulled`` names a reference, set it to null instead."""
    out = {}
    for name, df in tables.items():
        if name in refs:
            out[name] = df.join(gone.select(F.col(key).alias(refs[name])), refs[name], "left_anti").select(*df.columns)
        elif nulled and name in nulled:
            ref = nulled[name]
            hit = gone.select(F.col(key).alias("_gone"))
            j = df.join(hit, df[ref] == hit["_gone"], "left")
            out[name] = j.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == ref else df[c] for c in df.columns])
        else:
            out[name] = df
    return out


def admitted(calls: DataFrame, key: list[str], ts: str, seconds: int, limit: int, *tie: Column) -> DataFrame:
    """calls with ``allowed``: the first ``limit`` of each key and epoch bucket."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    w = Window.partitionBy(*key, "bucket").orderBy(F.col(ts), *tie)
    return calls.withColumn("bucket", bucket).withColumn("allowed", F.row_number().over(w) <= limit)


def as_of(probes: DataFrame, facts: DataFrame, at: str, date: str, value: str, unit: str = "month") -> DataFrame:
    """For each probe the value of the latest fact at or before it.

    Both sides meet in one pass in time order, a partition per ``unit``; what a unit starts with is the last value of an
    earlier one, found over one row per unit.
    """
    both = probes.select(F.col(at).alias("_t"), F.lit(1).alias("_p"), F.lit(None).cast(facts.schema[value].dataType).alias("_v")).unionByName(
        facts.select(F.col(date).alias("_t"), F.lit(0).alias("_p"), F.col(value).alias("_v"))
    )
    both = both.withColumn("_u", F.date_trunc(unit, "_t"))
    latest = both.groupBy("_u").agg(F.max_by("_v", F.when(F.col("_p") == 0, F.col("_t"))).alias("_end"))
    carried = latest.select("_u", F.last("_end", ignorenulls=True).over(Window.orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    w = Window.partitionBy("_u").orderBy("_t", "_p")
    inside = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_p = 1")
    return inside.join(carried, "_u").select(F.col("_t").alias(at), F.coalesce("_v", "_start").alias(value))


def first_non_empty(parts: list[DataFrame]) -> DataFrame:
    """The rows of the first part that has any."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    least = tagged.agg(F.min("_part").alias("_part"))  # one row
    return tagged.join(F.broadcast(least), "_part", "left_semi").drop("_part")


def ordered_fetch(ids: DataFrame, key: str, df: DataFrame, id_col: str) -> DataFrame:
    """Rows of an id array in the array's order; ids without a row drop out."""
    wanted = ids.select(F.posexplode(key).alias("pos", "_id"))
    return wanted.join(df, wanted["_id"] == df[id_col]).drop("_id")


def erased(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after accounts (gone: id) are erased, in the order that keeps references whole: what hangs on their items, the items, their votes
    with a new count of the items voted for, what they made or was said of them; reports that they filed stay without a name; sessions and the accounts last.

    Tables: fonts (id, owner_id, votes_count), votes and favorites (user_id, font_id), reports (font_id, reported_user_id, reporter_id), and user_id
    tables bug_reports, maker_reviews, member_activity, session, account; users (id).
    """
    own = tables["fonts"].join(gone.select(F.col("id").alias("owner_id")), "owner_id", "left_semi").select("id")
    t = cascade(tables, own, "id", {"votes": "font_id", "favorites": "font_id", "reports": "font_id", "fonts": "id"})
    voted = t["votes"].join(gone.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(F.col("font_id").alias("id")).distinct()
    made = ("votes", "favorites", "bug_reports", "maker_reviews", "member_activity", "session", "account")
    t = cascade(t, gone, "id", {n: "user_id" for n in made} | {"reports": "reported_user_id", "users": "id"})
    t = cascade(t, gone, "id", {}, {"reports": "reporter_id"})
    again = recount(voted, "id", t["votes"], "font_id", "votes_count")
    return t | {"fonts": patched(t["fonts"], again, ["id"], ["votes_count"])}
