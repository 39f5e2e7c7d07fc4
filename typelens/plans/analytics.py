"""Usage analytics: funnel, daily series, adoption, community figures, admission."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import islands as I
from ..operators import tables as T
from ..sources.bindings import activity, fonts, owned, sql, table, users, votes
from . import query

#: Events that count a label even where it is empty (fixed values).
LABELLED = ("build_ok", "build_fail", "download")
EVENTS = ("make_view", "build_ok", "build_fail", "download", "library_download")
CHOICES = (7, 30, 90)


def window_of(days, now: dt.datetime) -> tuple[dt.date, dt.date, dt.date]:
    """(start, end, start of the span before): today included, UTC days; unknown choices are 30 days."""
    try:
        days = int(days)
    except (TypeError, ValueError):
        days = 30
    days = days if days in CHOICES else 30
    end = now.astimezone(dt.UTC).date()
    start = end - dt.timedelta(days=days - 1)
    return start, end, start - dt.timedelta(days=days)


NOW = dt.datetime(2024, 1, 30, 12, tzinfo=dt.UTC)
START, END, BEFORE = window_of(7, NOW)
_IN, _PREV = f"day BETWEEN DATE '{START}' AND DATE '{END}'", f"day >= DATE '{BEFORE}' AND day < DATE '{START}'"


def cube(rows):
    """(day, event, meta, count): the pre-aggregated table."""
    return rows.groupBy("day", "event", "meta").agg(F.count(F.lit(1)).alias("count"))


def totals(c, start, end, before):
    now = F.col("day").between(F.lit(start), F.lit(end))
    prev = (F.col("day") >= F.lit(before)) & (F.col("day") < F.lit(start))
    z = lambda p: F.coalesce(F.sum(F.when(p, F.col("count"))), F.lit(0))
    return c.filter(F.col("day").between(F.lit(before), F.lit(end))).groupBy("event").agg(z(now).alias("current"), z(prev).alias("previous"))


def change_text(cur, prev):
    pct = S.half_up(100.0 * (cur - prev) / F.when(prev != 0, prev))
    return (
        F.when((prev == 0) & (cur == 0), "No change").when(prev == 0, "No events in previous period").when(cur == prev, "No change")
        .otherwise(F.concat(F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("% vs previous period")))
    )


@query(sql(f"SELECT event, CAST(coalesce(sum(CASE WHEN {_IN} THEN 1 END), 0) AS BIGINT) AS current, CAST(coalesce(sum(CASE WHEN {_PREV} THEN 1 END), 0) AS BIGINT) AS previous FROM activity_v WHERE {_IN} OR {_PREV} GROUP BY event", "activity_v"))
def funnel_totals(spark, d):
    return totals(cube(activity(spark, d).filter(F.col("day").between(F.lit(BEFORE), F.lit(END)))), START, END, BEFORE)


@query(sql(f""", days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}' + 3, INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(days.day AS VARCHAR) AS day, {", ".join(f"count(*) FILTER (WHERE event = '{e}') AS {e}" for e in EVENTS)} FROM days LEFT JOIN activity_v a ON a.day = days.day GROUP BY days.day""", "activity_v"))
def funnel_daily_spine(spark, d):
    stop = END + dt.timedelta(days=3)
    c = activity(spark, d).filter(F.col("day").between(F.lit(START), F.lit(stop)))
    n = c.groupBy("day").pivot("event", list(EVENTS)).agg(F.count(F.lit(1)))
    return I.spine(n, str(START), str(stop), "day").select(F.col("day").cast("string").alias("day"), *[F.coalesce(e, F.lit(0)).alias(e) for e in EVENTS])


@query(sql(f"""SELECT event, CASE WHEN meta = '' THEN 'Unspecified' ELSE meta END AS label, count(*) AS count FROM activity_v
WHERE {_IN} AND (meta <> '' OR event IN {LABELLED}) GROUP BY 1, 2""", "activity_v"))
def funnel_breakdown(spark, d):
    c = cube(activity(spark, d)).filter(F.col("day").between(F.lit(START), F.lit(END))).filter((F.col("meta") != "") | F.col("event").isin(*LABELLED))
    return c.groupBy("event", F.when(F.col("meta") == "", "Unspecified").otherwise(F.col("meta")).alias("label")).agg(F.sum("count").alias("count"))


@query(sql(f""", t AS (SELECT source, count(*) FILTER (WHERE event = 'build_ok') AS ok, count(*) FILTER (WHERE event = 'build_fail') AS bad FROM activity_v WHERE {_IN} GROUP BY source)
SELECT source, ok, bad, CASE WHEN ok + bad > 0 THEN CAST(floor(100.0 * ok / (ok + bad) + 0.5) AS BIGINT) END AS rate FROM t UNION ALL SELECT 'none', 0, 0, NULL""", "activity_v"))
def funnel_success_rate(spark, d):
    c = activity(spark, d).filter(F.col("day").between(F.lit(START), F.lit(END)))
    t = c.groupBy("source").agg(F.count_if(F.col("event") == "build_ok").alias("ok"), F.count_if(F.col("event") == "build_fail").alias("bad"))
    t = t.unionByName(spark.range(1).select(F.lit("none").alias("source"), F.lit(0).cast("long").alias("ok"), F.lit(0).cast("long").alias("bad")))
    return t.withColumn("rate", S.percent(F.col("ok"), F.col("ok") + F.col("bad")))


@query(sql(f""", t AS (SELECT user_id, CAST(coalesce(sum(CASE WHEN {_IN} THEN 1 END), 0) AS BIGINT) AS c, CAST(coalesce(sum(CASE WHEN {_PREV} THEN 1 END), 0) AS BIGINT) AS p FROM activity_v GROUP BY 1)
SELECT user_id, c AS current, p AS previous, CASE WHEN p = 0 AND c = 0 THEN 'No change' WHEN p = 0 THEN 'No events in previous period' WHEN p = c THEN 'No change'
ELSE CASE WHEN floor(100.0 * (c - p) / p + 0.5) > 0 THEN '+' ELSE '' END || CAST(CAST(floor(100.0 * (c - p) / p + 0.5) AS BIGINT) AS VARCHAR) || '% vs previous period' END AS change FROM t""", "activity_v"))
def funnel_change_text(spark, d):
    now, prev = F.col("day").between(F.lit(START), F.lit(END)), (F.col("day") >= F.lit(BEFORE)) & (F.col("day") < F.lit(START))
    t = activity(spark, d).groupBy("user_id").agg(F.count_if(now).alias("current"), F.count_if(prev).alias("previous"))
    return t.withColumn("change", change_text(F.col("current"), F.col("previous")))


def members(spark, d):
    a = activity(spark, d)
    inside = F.col("day").between(F.lit(START), F.lit(END))
    ok = F.col("event") == "build_ok"
    g = a.groupBy("user_id").agg(
        F.count_if(inside & ok & (F.col("source") == "upload")).alias("uploads"), F.count_if(inside & ok & (F.col("source") == "sample")).alias("samples"),
        F.count_if(inside & ok).alias("builds"), F.count_if(inside & (F.col("event") == "download")).alias("downloads"),
        F.max(F.when(inside, F.col("day"))).alias("last_day"), F.max(F.when(inside & ok, F.col("day"))).alias("last_build"), F.min(F.when(ok, F.col("day"))).alias("first_build"),
    ).filter("last_day is not null")
    u = users(spark, d).select("id", "handle")
    return g.join(u, g["user_id"] == u["id"]).drop("id")


_MEMBERS = f"""SELECT user_id, handle, count(*) FILTER (WHERE {_IN} AND event = 'build_ok' AND source = 'upload') AS uploads, count(*) FILTER (WHERE {_IN} AND event = 'build_ok' AND source = 'sample') AS samples,
count(*) FILTER (WHERE {_IN} AND event = 'build_ok') AS builds, count(*) FILTER (WHERE {_IN} AND event = 'download') AS downloads, max(CASE WHEN {_IN} THEN day END) AS last_day,
max(CASE WHEN {_IN} AND event = 'build_ok' THEN day END) AS last_build, (SELECT min(day) FROM activity_v b WHERE b.user_id = a.user_id AND b.event = 'build_ok') AS first_build
FROM activity_v a JOIN user_v u ON u.id = a.user_id GROUP BY user_id, handle HAVING max(CASE WHEN {_IN} THEN day END) IS NOT NULL"""


@query(sql(f", m AS ({_MEMBERS}) SELECT user_id, handle, uploads, samples, downloads, CAST(last_day AS VARCHAR) AS last_day, CAST(last_build AS VARCHAR) AS last_build, CAST(first_build AS VARCHAR) AS first_build, count(*) OVER () AS of FROM m ORDER BY m.last_day DESC, user_id LIMIT 100", "activity_v", "user_v"))
def adoption_members(spark, d):
    m = members(spark, d)
    n = m.agg(F.count(F.lit(1)).alias("of"))
    top = m.orderBy(F.desc("last_day"), "user_id").limit(100)
    days = [F.col(c).cast("string").alias(c) for c in ("last_day", "last_build", "first_build")]
    return top.join(F.broadcast(n), F.lit(True)).select("user_id", "handle", "uploads", "samples", "downloads", *days, "of")


@query(sql(f", m AS ({_MEMBERS}) SELECT count(*) FILTER (WHERE builds > 0) AS builders, count(*) FILTER (WHERE downloads > 0) AS downloaders, count(*) FILTER (WHERE first_build < last_build) AS returning FROM m", "activity_v", "user_v"))
def adoption_summary(spark, d):
    return adoption(members(spark, d))


def adoption(m):
    return m.agg(F.count_if(F.col("builds") > 0).alias("builders"), F.count_if(F.col("downloads") > 0).alias("downloaders"), F.count_if(F.coalesce(F.col("first_build") < F.col("last_build"), F.lit(False))).alias("returning"))


@query(sql("""SELECT (SELECT count(*) FROM user_v) AS users, (SELECT count(*) FROM fonts_v WHERE visibility = 'public') AS fonts, (SELECT count(*) FROM fonts_v WHERE visibility = 'private') AS private_fonts,
(SELECT count(*) FROM votes_v) AS votes, (SELECT CAST(coalesce(sum(glyph_count), 0) AS BIGINT) FROM fonts_v WHERE visibility = 'nowhere') AS nothing""", "user_v", "fonts_v", "votes_v"))
def community_totals(spark, d):
    f = fonts(spark, d).agg(F.count_if(F.col("visibility") == "public").alias("fonts"), F.count_if(F.col("visibility") == "private").alias("private_fonts"), F.coalesce(F.sum(F.when(F.col("visibility") == "nowhere", F.col("glyph_count"))), F.lit(0)).alias("nothing"))
    u, v = users(spark, d).agg(F.count(F.lit(1)).alias("users")), votes(spark, d).agg(F.count(F.lit(1)).alias("votes"))
    one = F.lit(True)  # three one-row aggregates side by side
    return u.join(F.broadcast(f), one).join(F.broadcast(v), one).select("users", "fonts", "private_fonts", "votes", "nothing")


@query(sql("SELECT l_partkey AS id, count(*) AS downloads FROM lineitem JOIN fonts_v ON id = l_partkey WHERE visibility = 'public' AND l_returnflag = 'R' GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 DESC, 1 LIMIT 5", "fonts_v"))
def top_downloads(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey")
    f = fonts(spark, d).filter("visibility = 'public'").select("id")
    return li.join(f, li["l_partkey"] == f["id"], "left_semi").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("downloads")).orderBy(F.desc("downloads"), "id").limit(5)


@query(sql("""SELECT 'week' AS span, count(*) AS n, round(avg(value), 6) AS mean FROM activity_v WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'
UNION ALL SELECT 'none', count(*), round(avg(value), 6) FROM activity_v WHERE ts >= TIMESTAMP '2030-01-01' AND ts < TIMESTAMP '2030-01-08'""", "activity_v"))
def review_summary(spark, d):
    """Counts and means of two half-open windows in one scan; the mean of an empty window is null."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    spans = {"week": ("2024-01-24", "2024-01-31"), "none": ("2030-01-01", "2030-01-08")}
    inside = {k: (F.col("ts") >= t(a)) & (F.col("ts") < t(b)) for k, (a, b) in spans.items()}
    one = activity(spark, d).agg(*[c for k, p in inside.items() for c in (F.count_if(p).alias(f"{k}_n"), F.round(F.avg(F.when(p, F.col("value"))), 6).alias(f"{k}_mean"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("span"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_mean").alias("mean")) for k in spans])).alias("s")).select("s.*")


@query(sql("SELECT event_id, user_id, source, meta FROM activity_v WHERE event = 'build_fail' AND ts < DATE '2024-01-29' + 1 ORDER BY ts DESC, event_id DESC LIMIT 50", "activity_v"))
def recent_failures(spark, d):
    a = activity(spark, d, "build_fail").filter((F.col("ts") < F.date_add(F.lit("2024-01-29").cast("date"), 1).cast("timestamp_ntz")))
    return a.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "source", "meta")


_BUCKET = "CAST(floor(epoch_us(ts) / {s}000000.0) AS BIGINT)"


@query(sql(f"SELECT event_id, {_BUCKET.format(s=3600)} AS bucket, row_number() OVER (PARTITION BY user_id % 20, {_BUCKET.format(s=3600)} ORDER BY ts, event_id) <= 3 AS allowed FROM activity_v", "activity_v"))
def rate_limit_admit(spark, d):
    a = activity(spark, d).withColumn("ip", F.col("user_id") % 20)
    return T.admitted(a, ["ip"], "ts", 3600, 3, F.col("event_id")).select("event_id", "bucket", "allowed")


@query(sql(f""", c AS (SELECT k AS font_id, row_number() OVER (PARTITION BY user_id % 10, k, {_BUCKET.format(s=3600)} ORDER BY ts, event_id) AS rn FROM activity_v WHERE event = 'download')
SELECT font_id, count(*) AS downloads FROM c JOIN fonts_v ON id = font_id WHERE rn = 1 AND visibility = 'public' GROUP BY 1""", "activity_v", "fonts_v"))
def download_dedupe(spark, d):
    a = activity(spark, d, "download").withColumn("ip", F.col("user_id") % 10).withColumnRenamed("k", "font_id")
    ok = T.admitted(a, ["ip", "font_id"], "ts", 3600, 1, F.col("event_id")).filter("allowed")
    public = fonts(spark, d).filter("visibility = 'public'").select(F.col("id").alias("font_id"))
    return ok.join(public, "font_id", "left_semi").groupBy("font_id").agg(F.count(F.lit(1)).alias("downloads"))


@query(sql("SELECT CAST(day AS VARCHAR) AS day, event, source, count(*) AS count, greatest(1, max(count(*)) OVER (PARTITION BY event)) AS scale FROM activity_v GROUP BY day, event, source", "activity_v"))
def member_cube(spark, d):
    c = activity(spark, d).groupBy("day", "event", "source").agg(F.count(F.lit(1)).alias("count"))
    return c.select(F.col("day").cast("string").alias("day"), "event", "source", "count", F.greatest(F.lit(1).cast("long"), F.max("count").over(Window.partitionBy("event"))).alias("scale"))


@query(sql("SELECT owner_id, count(*) AS n, strftime(max(created_at), '%m·%d·%Y') AS shown FROM owned_v GROUP BY owner_id", "owned_v"))
def display_dates(spark, d):
    return owned(spark, d).groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("created_at"), "MM·dd·yyyy").alias("shown"))
