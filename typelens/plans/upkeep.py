"""Table upkeep as pure functions: counters, inserts, toggles, cascades, account erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources.bindings import activity, fonts, owned, sql, table, users, votes
from . import query


@query(sql("SELECT id, count(user_id) AS votes_count FROM fonts_v LEFT JOIN votes_v ON font_id = id GROUP BY id", "fonts_v", "votes_v"))
def vote_recount(spark, d):
    return T.recount(fonts(spark, d).select("id"), "id", votes(spark, d), "font_id", "votes_count").select("id", "votes_count")


@query(sql("SELECT o_custkey AS user_id, l_partkey AS font_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) % 2 = 1", "fonts_v"))
def vote_toggle_state(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("font_id"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return T.toggled(li.join(o, li["l_orderkey"] == o["o_orderkey"]), ["user_id", "font_id"])


@query(sql("SELECT CAST(day AS VARCHAR) AS day, event, meta, count(*) AS count FROM activity_v GROUP BY 1, 2, 3", "activity_v"))
def upsert_counter(spark, d):
    """The first 20 days as the stored table, the rest as increments."""
    a = activity(spark, d).withColumn("count", F.lit(1).cast("long")).withColumn("day", F.col("day").cast("string"))
    keys = ["day", "event", "meta"]
    old = a.filter("day < '2024-01-20' or user_id % 2 = 0").groupBy(*keys).agg(F.sum("count").alias("count"))
    return T.add_counts(old, a.filter("not (day < '2024-01-20' or user_id % 2 = 0)"), keys, "count")


@query(sql("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'old' ELSE first_event END AS value FROM
(SELECT user_id, arg_min(event, (ts, event_id)) AS first_event FROM activity_v GROUP BY user_id)""", "activity_v"))
def insert_ignore(spark, d):
    a = activity(spark, d)
    old = a.filter("user_id % 3 = 0").select("user_id").distinct().withColumn("value", F.lit("old"))
    return T.insert_ignore(old, a.select("user_id", F.col("event").alias("value"), "ts", "event_id"), ["user_id"], F.col("ts"), F.col("event_id"))


@query(sql("SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE badge END AS badge FROM fonts_v UNION ALL SELECT -1, 'new'", "fonts_v"))
def upsert_replace(spark, d):
    old = fonts(spark, d).select("id", "badge")
    new = old.filter("id % 5 = 0").select("id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"))).withColumn("badge", F.lit("new"))
    return T.replace_rows(old, new, ["id"])


@query(sql("SELECT id, CASE WHEN id % 7 = 0 AND visibility = 'public' THEN 'renamed' ELSE name END AS name FROM fonts_v", "fonts_v"))
def guarded_update(spark, d):
    """Update by key where the guard holds."""
    f = fonts(spark, d)
    changes = f.filter("id % 7 = 0 and visibility = 'public'").select("id", F.lit("renamed").alias("name"))
    return T.patched(f.select("id", "name"), changes, ["id"], ["name"])


@query(sql("""SELECT 'fonts' AS name, count(*) AS n FROM fonts_v WHERE id % 10 <> 3 UNION ALL SELECT 'votes', count(*) FROM votes_v WHERE font_id % 10 <> 3
UNION ALL SELECT 'reports', count(font_id) FROM (SELECT CASE WHEN l_partkey % 10 <> 3 THEN l_partkey END AS font_id FROM lineitem)""", "fonts_v", "votes_v"))
def cascade_delete(spark, d):
    f = fonts(spark, d).select("id")
    gone = f.filter("id % 10 = 3")
    tables = {"fonts": f, "votes": votes(spark, d), "reports": table(spark, d, "lineitem").select(F.col("l_partkey").alias("font_id"))}
    out = T.cascade(tables, gone, "id", {"fonts": "id", "votes": "font_id"}, {"reports": "font_id"})
    parts = [df.agg(F.count(df.columns[-1] if n == "reports" else F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql(""", gone AS (SELECT id FROM user_v WHERE id % 50 = 1), kept_votes AS (SELECT * FROM votes_v WHERE user_id NOT IN (SELECT id FROM gone))
SELECT f.id, count(v.user_id) AS votes_count, count(*) FILTER (WHERE v.user_id IS NOT NULL AND v.user_id % 2 = 0) AS even FROM fonts_v f LEFT JOIN kept_votes v ON v.font_id = f.id GROUP BY f.id""", "user_v", "fonts_v", "votes_v"))
def account_erasure(spark, d):
    """Votes of erased users go, the counts of all items they voted for are made anew."""
    gone = users(spark, d).filter("id % 50 = 1").select("id")
    kept = T.cascade({"votes": votes(spark, d)}, gone, "id", {"votes": "user_id"})["votes"]
    n = kept.groupBy("font_id").agg(F.count(F.lit(1)).alias("votes_count"), F.count_if(F.col("user_id") % 2 == 0).alias("even"))
    f = fonts(spark, d).select("id")
    return f.join(n, f["id"] == n["font_id"], "left").select("id", F.coalesce("votes_count", F.lit(0)).alias("votes_count"), F.coalesce("even", F.lit(0)).alias("even"))


@query(sql("SELECT o.id, CASE WHEN u.id IS NULL THEN o.owner_id END AS owner_id FROM owned_v o LEFT JOIN (SELECT id FROM user_v WHERE segment = 'MACHINERY') u ON u.id = o.owner_id", "owned_v", "user_v"))
def set_null_owner(spark, d):
    gone = users(spark, d).filter("segment = 'MACHINERY'").select("id")
    return T.cascade({"owned": owned(spark, d).select("id", "owner_id")}, gone, "id", {}, {"owned": "owner_id"})["owned"]


@query(sql("SELECT o.id, CASE WHEN u.id % 100 = 0 THEN u.handle || '-v2' ELSE u.handle END AS handle FROM owned_v o JOIN user_v u ON o.owner_id = u.id", "user_v", "owned_v"))
def rename_cascade(spark, d):
    """Some users get a new handle; every owned item takes its owner's handle, the new one where there is one."""
    u = users(spark, d)
    renamed = T.patched(u.select("id", "handle"), u.filter("id % 100 = 0").select("id", F.concat("handle", F.lit("-v2")).alias("handle")), ["id"], ["handle"])
    return owned(spark, d).join(renamed.withColumnRenamed("id", "owner_id"), "owner_id").select("id", "handle")


@query(sql("SELECT id, 'font' AS target_type, CASE WHEN id % 4 = 0 THEN 'resolved' ELSE 'open' END AS status FROM owned_v", "owned_v"))
def status_transition(spark, d):
    """A rebuilt table with a constant column, then a status change by key."""
    o = owned(spark, d).select("id", F.lit("font").alias("target_type"), F.lit("open").alias("status"))
    return T.patched(o, o.filter("id % 4 = 0").select("id", F.lit("resolved").alias("status")), ["id"], ["status"])


_ACCOUNTS = """, gone AS (SELECT id FROM user_v WHERE id % 20 = 1), v0 AS (SELECT DISTINCT l_partkey % 1500 + 1 AS user_id, l_orderkey AS font_id FROM lineitem), f0 AS (SELECT o_orderkey AS id, o_custkey AS owner_id FROM orders),
own AS (SELECT f0.id FROM f0 SEMI JOIN gone ON gone.id = f0.owner_id), c0 AS (SELECT font_id, count(*) AS n FROM v0 GROUP BY 1), v1 AS (SELECT * FROM v0 WHERE font_id NOT IN (SELECT id FROM own)),
v2 AS (SELECT * FROM v1 WHERE user_id NOT IN (SELECT id FROM gone)), voted AS (SELECT DISTINCT font_id FROM v1 WHERE user_id IN (SELECT id FROM gone)), c2 AS (SELECT font_id, count(*) AS n FROM v2 GROUP BY 1),
f2 AS (SELECT f0.id, CASE WHEN voted.font_id IS NOT NULL THEN coalesce(c2.n, 0) ELSE coalesce(c0.n, 0) END AS votes_count FROM f0 LEFT JOIN voted ON voted.font_id = f0.id LEFT JOIN c2 ON c2.font_id = f0.id LEFT JOIN c0 ON c0.font_id = f0.id WHERE f0.id NOT IN (SELECT id FROM own)),
fav AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS font_id FROM lineitem), rep AS (SELECT event_id, event_id AS font_id, user_id AS reported_user_id, k AS reporter_id FROM activity_v)"""


@query(sql(_ACCOUNTS + """ SELECT 'fonts' AS name, count(*) AS n, CAST(coalesce(sum(votes_count), 0) AS BIGINT) AS total FROM f2 UNION ALL SELECT 'votes', count(*), CAST(coalesce(sum(user_id), 0) AS BIGINT) FROM v2
UNION ALL SELECT 'favorites', count(*), CAST(coalesce(sum(user_id), 0) AS BIGINT) FROM fav WHERE user_id NOT IN (SELECT id FROM gone) AND font_id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'reports', count(*), CAST(count(reporter_id) FILTER (WHERE reporter_id NOT IN (SELECT id FROM gone)) AS BIGINT) FROM rep WHERE font_id NOT IN (SELECT id FROM own) AND reported_user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'bug_reports', count(*), CAST(coalesce(sum(user_id), 0) AS BIGINT) FROM activity_v WHERE event = 'build_fail' AND user_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'maker_reviews', count(*), CAST(coalesce(sum(user_id), 0) AS BIGINT) FROM activity_v WHERE event = 'build_ok' AND user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'member_activity', count(*), CAST(coalesce(sum(user_id), 0) AS BIGINT) FROM activity_v WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'session', count(*), CAST(sum(id) AS BIGINT) FROM user_v WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'account', count(*), CAST(sum(id) AS BIGINT) FROM user_v WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'users', count(*), CAST(sum(id) AS BIGINT) FROM user_v WHERE id NOT IN (SELECT id FROM gone)""", "user_v", "activity_v"))
def account_deletion(spark, d):
    """Every table after one account in twenty is deleted: rows that are left, and a sum over them (votes counted, users, reports with a sender)."""
    u, a = users(spark, d).select("id"), activity(spark, d)
    li = table(spark, d, "lineitem")
    v = li.select((F.col("l_partkey") % 1500 + 1).alias("user_id"), F.col("l_orderkey").alias("font_id")).distinct()
    f = T.recount(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id")), "id", v, "font_id", "votes_count")
    by = lambda rows: rows.select("user_id")
    same = u.select(F.col("id").alias("user_id"))
    tables = {
        "fonts": f, "votes": v, "favorites": li.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("font_id")).distinct(),
        "reports": a.select("event_id", F.col("event_id").alias("font_id"), F.col("user_id").alias("reported_user_id"), F.col("k").alias("reporter_id")),
        "bug_reports": by(a.filter("event = 'build_fail'")), "maker_reviews": by(a.filter("event = 'build_ok'")), "member_activity": by(a), "session": same, "account": same, "users": u,
    }
    left, out = T.erased(tables, u.filter("id % 20 = 1")), None
    measure = {"fonts": F.sum("votes_count"), "reports": F.count("reporter_id"), "users": F.sum("id")}
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(measure.get(name, F.sum("user_id") if "user_id" in df.columns else None), F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out
