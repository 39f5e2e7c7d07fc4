"""The catalogue: wall, search, marks, daily selection, moderation, sitemap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..operators import tables as T
from ..sources.bindings import fonts, owned, sql, table, users, votes
from . import query

_FEATURED = """SELECT font_id, count(*) AS votes FROM votes_v JOIN fonts_v ON fonts_v.id = votes_v.font_id
WHERE visibility = 'public' AND votes_v.created_at >= TIMESTAMP '{a}' AND votes_v.created_at < TIMESTAMP '{b}'
GROUP BY font_id ORDER BY votes DESC, font_id LIMIT 6"""


def featured(spark, d, start: str, stop: str, k: int = 6):
    """The most liked public items of a half-open window, ties by id."""
    v = votes(spark, d, stop).filter((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(stop).cast("timestamp_ntz")))
    public = fonts(spark, d).filter("visibility = 'public'").select("id")
    return v.join(public, v["font_id"] == public["id"], "left_semi").groupBy("font_id").agg(F.count(F.lit(1)).alias("votes")).orderBy(F.desc("votes"), "font_id").limit(k)


@query(sql(_FEATURED.format(a="1998-08-23", b="1998-08-24"), "votes_v", "fonts_v"))
def featured_daily(spark, d):
    return featured(spark, d, "1998-08-23", "1998-08-24")


@query(sql(_FEATURED.format(a="1998-08-01", b="1998-09-01"), "votes_v", "fonts_v"))
def featured_monthly(spark, d):
    return featured(spark, d, "1998-08-01", "1998-09-01")


def featured_by_day(spark, d):
    """(day, font_ids) for every day with votes: what the nightly selection would have stored."""
    v = votes(spark, d)
    public = fonts(spark, d).filter("visibility = 'public'").select("id")
    n = v.join(public, v["font_id"] == public["id"], "left_semi").groupBy(F.to_date("created_at").alias("day"), "font_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("day").orderBy(F.desc("n"), "font_id")
    top = n.withColumn("rn", F.row_number().over(w)).filter("rn <= 6")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "font_id"))), lambda s: s["font_id"].cast("string"))
    return top.groupBy("day").agg(F.concat_ws(",", ids).alias("font_ids"))


_BY_DAY = """, n AS (SELECT CAST(votes_v.created_at AS DATE) AS day, font_id, count(*) AS n FROM votes_v JOIN fonts_v ON fonts_v.id = font_id WHERE visibility = 'public' GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, font_id) AS rn FROM n QUALIFY rn <= 6),
featured AS (SELECT day, string_agg(CAST(font_id AS VARCHAR), ',' ORDER BY rn) AS font_ids FROM top GROUP BY day)"""


@query(sql(_BY_DAY + """, probe AS (SELECT DATE '1992-01-01' + CAST(i * 10 AS INT) AS probe_day FROM range(0, 260) t(i))
SELECT CAST(probe_day AS VARCHAR) AS probe_day, (SELECT font_ids FROM featured WHERE day <= probe_day ORDER BY day DESC LIMIT 1) AS font_ids FROM probe""", "votes_v", "fonts_v"))
def featured_asof(spark, d):
    probes = spark.range(260).select(F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") * 10).cast("int")).alias("probe_day"))
    return T.as_of(probes, featured_by_day(spark, d), "probe_day", "day", "font_ids").select(F.col("probe_day").cast("string").alias("probe_day"), "font_ids")


@query(sql(_BY_DAY + """, d AS (SELECT CAST(votes_v.created_at AS DATE) AS day, font_id, count(*) AS n FROM votes_v JOIN fonts_v ON fonts_v.id = font_id WHERE visibility = 'public' AND votes_v.created_at >= TIMESTAMP '1998-08-23' AND votes_v.created_at < TIMESTAMP '1998-08-24' GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN day = DATE '1998-08-23' THEN font_ids WHEN day = DATE '1998-08-22' THEN 'edited' ELSE font_ids END AS font_ids FROM featured WHERE day <= DATE '1998-08-23' AND day >= DATE '1998-08-01'""", "votes_v", "fonts_v"))
def featured_store(spark, d):
    """The stored selections of a month after the nightly job: yesterday's six replace what was stored for that day, other days stay as they were."""
    stored = featured_by_day(spark, d).filter("day >= '1998-08-01' and day <= '1998-08-23'")
    stored = stored.withColumn("font_ids", F.when(F.col("day").cast("string").isin("1998-08-22"), "edited").when(F.col("day").cast("string") == "1998-08-23", "stale").otherwise(F.col("font_ids")))
    six = featured(spark, d, "1998-08-23", "1998-08-24")
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "font_id"))), lambda s: s["font_id"].cast("string"))
    new = six.groupBy(F.lit("1998-08-23").cast("date").alias("day")).agg(F.concat_ws(",", ids).alias("font_ids"))
    return T.replace_rows(stored, new, ["day"]).select(F.col("day").cast("string").alias("day"), "font_ids")


@query(sql(_BY_DAY + """, probe AS (SELECT unnest([DATE '1991-06-01', DATE '1995-03-17', DATE '1998-08-23']) AS day), got AS (SELECT p.day, (SELECT font_ids FROM featured f WHERE f.day <= p.day ORDER BY f.day DESC LIMIT 1) AS ids FROM probe p),
pop AS (SELECT id, row_number() OVER (ORDER BY n DESC, id DESC) - 1 AS pos FROM (SELECT f.id, count(v.user_id) AS n FROM fonts_v f LEFT JOIN votes_v v ON v.font_id = f.id WHERE f.visibility = 'public' GROUP BY 1) QUALIFY pos < 12)
SELECT CAST(day AS VARCHAR) AS day, pos, id FROM (SELECT day, unnest(string_split(ids, ','))::BIGINT AS id, generate_subscripts(string_split(ids, ','), 1) - 1 AS pos FROM got WHERE ids IS NOT NULL) JOIN (SELECT id FROM fonts_v WHERE visibility = 'public') USING (id)
UNION ALL SELECT CAST(day AS VARCHAR), pos, id FROM got, pop WHERE ids IS NULL""", "votes_v", "fonts_v"))
def featured_current(spark, d):
    """What the front page shows on a day: the latest stored selection in its order, or the twelve most liked public items where none was stored yet."""
    days = spark.createDataFrame([(x,) for x in ("1991-06-01", "1995-03-17", "1998-08-23")], "s string").select(F.to_date("s").alias("probe"))
    got = T.as_of(days, featured_by_day(spark, d), "probe", "day", "font_ids").select(F.col("probe").cast("string").alias("day"), "font_ids")
    public = fonts(spark, d).filter("visibility = 'public'").select("id")
    shown = got.filter("font_ids is not null").select("day", F.posexplode(F.split("font_ids", ",")).alias("pos", "s"))
    shown = shown.select("day", F.col("pos").cast("long").alias("pos"), F.col("s").cast("long").alias("id")).join(public, "id", "left_semi")
    n = votes(spark, d).groupBy(F.col("font_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    top = public.join(n, "id", "left").orderBy(F.coalesce("n", F.lit(0)).desc(), F.desc("id")).limit(12)
    ids = top.agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), (-F.col("id")).alias("id")))).alias("t"))  # twelve rows
    popular = ids.select(F.posexplode("t").alias("pos", "t")).select(F.col("pos").cast("long").alias("pos"), (-F.col("t.id")).alias("id"))
    none = got.filter("font_ids is null").select("day")
    return shown.select("day", "pos", "id").unionByName(none.crossJoin(F.broadcast(popular)).select("day", "pos", "id"))


@query(sql("""SELECT CAST(w.pos AS BIGINT) AS pos, id, name FROM (SELECT unnest(range(0, 5)) AS pos, unnest([40, 7, 999999999, 12, 3]) AS wanted) w JOIN fonts_v ON id = wanted""", "fonts_v"))
def featured_ordered_fetch(spark, d):
    ids = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (40, 7, 999999999, 12, 3)]).alias("ids"))
    return T.ordered_fetch(ids, "ids", fonts(spark, d), "id").select(F.col("pos").cast("long").alias("pos"), "id", "name")


def wall(spark, d, order: str = "popular", term: str | None = None, badge: str | None = None, page: int = 1, size: int = 24):
    """One page of the public wall; unknown orders are popular, sizes are 1 to 60."""
    size, page = max(1, min(size, 60)), max(1, page)
    f = fonts(spark, d).filter("visibility = 'public'")
    if term and term.strip():
        f = f.filter(S.contains_folded(F.col("name"), term.strip()) | S.contains_folded(F.col("maker_handle"), term.strip()))
    if badge:
        f = f.filter(F.get_json_object("meta", "$.badge") == badge)
    n = votes(spark, d).groupBy("font_id").agg(F.count(F.lit(1)).alias("votes_count"), F.max("created_at").alias("last_vote"))
    j = f.join(n, f["id"] == n["font_id"], "left").withColumn("votes_count", F.coalesce("votes_count", F.lit(0)))
    by = [F.desc("votes_count"), F.desc_nulls_last("last_vote"), F.desc("id")] if order != "new" else [F.desc_nulls_last("last_vote"), F.desc("id")]
    return j.orderBy(*by).offset((page - 1) * size).limit(size).select("id", "name", "maker_handle", "votes_count")


_WALL = """, n AS (SELECT font_id, count(*) AS votes_count, max(created_at) AS last_vote FROM votes_v GROUP BY 1)
SELECT id, name, maker_handle, coalesce(votes_count, 0) AS votes_count FROM fonts_v LEFT JOIN n ON font_id = id WHERE visibility = 'public' {where}
ORDER BY {by} LIMIT {n} OFFSET {o}"""
_POP, _NEW = "coalesce(votes_count, 0) DESC, last_vote DESC NULLS LAST, id DESC", "last_vote DESC NULLS LAST, id DESC"


@query(sql(_WALL.format(where="", by=_POP, n=24, o=0), "votes_v", "fonts_v"))
def wall_popular(spark, d):
    return wall(spark, d)


@query(sql(_WALL.format(where="", by=_NEW, n=24, o=24), "votes_v", "fonts_v"))
def wall_new(spark, d):
    return wall(spark, d, "new", page=2)


@query(sql(_WALL.format(where="AND (name ILIKE '%RING%' OR maker_handle ILIKE '%RING%')", by=_POP, n=60, o=0), "votes_v", "fonts_v"))
def wall_search(spark, d):
    return wall(spark, d, term=" RING ", size=600)


@query(sql("SELECT id, replace(name, ' ', '_') AS name FROM fonts_v WHERE replace(name, ' ', '_') ILIKE '%l\\_r%' ESCAPE '\\' OR contains(name, '100%')", "fonts_v"))
def search_escaped(spark, d):
    f = fonts(spark, d).select("id", F.replace("name", F.lit(" "), F.lit("_")).alias("name"), F.col("name").alias("plain"))
    pattern = F.concat(F.lit("%"), S.escape_like(F.lit("l_r")), F.lit("%"))
    return f.filter(F.call_function("ilike", F.col("name"), pattern) | F.contains("plain", F.lit("100%"))).select("id", "name")


@query(sql(_WALL.format(where="AND badge = 'ECONOMY'", by=_POP, n=24, o=0), "votes_v", "fonts_v"))
def wall_badge_json(spark, d):
    return wall(spark, d, badge="ECONOMY")


@query(sql("""SELECT count(*) AS total, CAST(ceil(count(*) / 24.0) AS BIGINT) AS pages, CAST(least(3, ceil(count(*) / 24.0)) AS BIGINT) AS page,
least(3, ceil(count(*) / 24.0)) > 1 AS has_prev, least(3, ceil(count(*) / 24.0)) < ceil(count(*) / 24.0) AS has_next FROM fonts_v WHERE visibility = 'public'""", "fonts_v"))
def wall_page_total(spark, d):
    t = fonts(spark, d).filter("visibility = 'public'").agg(F.count(F.lit(1)).alias("total"))
    t = t.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 24.0))).withColumn("page", F.least(F.lit(3).cast("long"), "pages"))
    return t.select("total", "pages", "page", (F.col("page") > 1).alias("has_prev"), (F.col("page") < F.col("pages")).alias("has_next"))


@query(sql("""SELECT CAST(pos AS BIGINT) AS pos, k.badge FROM (SELECT unnest(range(0, 4)) AS pos, unnest(['STANDARD', 'SMALL', 'UNKNOWN', 'PROMO']) AS badge) k
WHERE k.badge IN (SELECT json_extract_string(meta, '$.badge') FROM fonts_v WHERE visibility = 'public')""", "fonts_v"))
def badges_in_use(spark, d):
    known = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("STANDARD", "SMALL", "UNKNOWN", "PROMO")))).alias("pos", "badge"))
    used = fonts(spark, d).filter("visibility = 'public'").select(F.get_json_object("meta", "$.badge").alias("badge")).distinct()
    return known.join(used, "badge", "left_semi").select(F.col("pos").cast("long").alias("pos"), "badge")


@query(sql("SELECT id, owner_id, EXISTS (SELECT 1 FROM user_v u WHERE u.id = o.owner_id AND u.segment = 'BUILDING') AS maker_exists FROM owned_v o", "owned_v", "user_v"))
def maker_exists_mark(spark, d):
    o = owned(spark, d).withColumn("segment", F.lit("BUILDING"))
    return T.mark(o, users(spark, d), {"owner_id": "id", "segment": "segment"}, "maker_exists").select("id", "owner_id", "maker_exists")


@query(sql("""SELECT id, EXISTS (SELECT 1 FROM votes_v v WHERE v.font_id = f.id AND v.user_id = 1) AS voted, EXISTS (SELECT 1 FROM votes_v v WHERE v.font_id = f.id AND v.user_id = 2) AS favorited
FROM fonts_v f WHERE visibility = 'public'""", "votes_v", "fonts_v"))
def viewer_marks(spark, d):
    v = votes(spark, d)
    f = fonts(spark, d).filter("visibility = 'public'").select("id")
    f = T.mark(f, v.filter("user_id = 1"), {"id": "font_id"}, "voted")
    return T.mark(f, v.filter("user_id = 2"), {"id": "font_id"}, "favorited").select("id", "voted", "favorited")


@query(sql("""SELECT owner_id, count(*) FILTER (WHERE visibility = 'public') AS n_public, count(*) FILTER (WHERE visibility = 'private') AS n_private,
count(*) FILTER (WHERE visibility = 'public' OR owner_id = 7) AS seen_by_7 FROM owned_v GROUP BY owner_id""", "owned_v"))
def owner_listing(spark, d):
    seen = (F.col("visibility") == "public") | (F.col("owner_id") == 7)
    return owned(spark, d).groupBy("owner_id").agg(F.count_if(F.col("visibility") == "public").alias("n_public"), F.count_if(F.col("visibility") == "private").alias("n_private"), F.count_if(seen).alias("seen_by_7"))


@query(sql("""SELECT id, name FROM fonts_v WHERE maker_handle = (SELECT maker_handle FROM fonts_v WHERE id = 10) AND visibility = 'public' AND id <> 10 ORDER BY id DESC LIMIT 4""", "fonts_v"))
def rail_fallback(spark, d):
    f = fonts(spark, d).filter("visibility = 'public'")
    me = fonts(spark, d).filter("id = 10").select("maker_handle")
    same = f.filter("id <> 10").join(F.broadcast(me), "maker_handle", "left_semi").orderBy(F.desc("id")).limit(4).select("id", "name")
    other = f.filter("id <> 10").orderBy(F.desc("id")).limit(4).select("id", "name")
    return T.first_non_empty([same, other])


@query(sql("""SELECT r.id, f.name AS font_name, reported.handle AS reported, reporter.handle AS reporter FROM owned_v r
LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS font_id FROM lineitem GROUP BY 1) li ON li.l_orderkey = r.id LEFT JOIN fonts_v f ON f.id = li.font_id
LEFT JOIN user_v reported ON reported.id = r.owner_id LEFT JOIN user_v reporter ON reporter.id = r.id % 2000
WHERE r.priority = '1-URGENT' ORDER BY r.created_at DESC, r.id DESC LIMIT 200""", "owned_v", "fonts_v", "user_v"))
def moderation_queue(spark, d):
    r = owned(spark, d).filter("priority = '1-URGENT'").orderBy(F.desc("created_at"), F.desc("id")).limit(200)  # the limit first: left joins on keys keep its rows
    of = F.broadcast(r.select(F.col("id").alias("l_orderkey")))  # 200 rows: only their lines are grouped
    li = table(spark, d, "lineitem").join(of, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.min("l_partkey").alias("font_id"))
    f = fonts(spark, d).select(F.col("id").alias("f_id"), F.col("name").alias("font_name"))
    u = users(spark, d)
    a, b = u.select(F.col("id").alias("a_id"), F.col("handle").alias("reported")), u.select(F.col("id").alias("b_id"), F.col("handle").alias("reporter"))
    j = r.join(li, r["id"] == li["l_orderkey"], "left").join(f, F.col("font_id") == F.col("f_id"), "left")
    return j.join(a, F.col("owner_id") == F.col("a_id"), "left").join(b, F.col("id") % 2000 == F.col("b_id"), "left").select("id", "font_name", "reported", "reporter")


@query(sql("""SELECT u.id, u.handle, (SELECT count(*) FROM owned_v o WHERE o.owner_id = u.id) AS fonts, (SELECT coalesce(CAST(sum(glyphs) AS BIGINT), 0) FROM
(SELECT o_custkey, CAST(o_totalprice AS BIGINT) % 7 AS glyphs FROM orders) g WHERE g.o_custkey = u.id) AS glyphs FROM user_v u ORDER BY u.id DESC LIMIT 500""", "owned_v", "user_v"))
def user_list_scalars(spark, d):
    u = users(spark, d).orderBy(F.desc("id")).limit(500)
    of = F.broadcast(u.select(F.col("id").alias("o_custkey")))  # 500 rows: only their orders are grouped
    o = table(spark, d, "orders").join(of, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("fonts"), F.sum(F.rint("o_totalprice").cast("long") % 7).alias("glyphs"))
    return u.join(o, u["id"] == o["o_custkey"], "left").select("id", "handle", F.coalesce("fonts", F.lit(0)).alias("fonts"), F.coalesce("glyphs", F.lit(0)).alias("glyphs"))


@query(sql(""", makers AS (SELECT maker_handle, min(id) AS first_id FROM fonts_v WHERE visibility = 'public' AND regexp_full_match(lower(replace(maker_handle, '#', '-')), '[a-z0-9][a-z0-9._-]*') GROUP BY 1)
SELECT '/' AS loc, NULL AS lastmod UNION ALL SELECT '/about', NULL
UNION ALL SELECT '/f/' || CAST(f.id AS VARCHAR), strftime(max(v.created_at), '%Y-%m-%dT%H:%M:%SZ') FROM fonts_v f LEFT JOIN votes_v v ON v.font_id = f.id WHERE visibility = 'public' GROUP BY f.id
UNION ALL SELECT '/u/' || lower(replace(maker_handle, '#', '-')), CAST(first_id AS VARCHAR) FROM makers""", "fonts_v", "votes_v"))
def sitemap_entries(spark, d):
    f = fonts(spark, d).filter("visibility = 'public'")
    last = votes(spark, d).groupBy("font_id").agg(F.max("created_at").alias("t"))
    fixed = spark.range(1).select(F.explode(F.array(F.lit("/"), F.lit("/about"))).alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    items = f.join(last, f["id"] == last["font_id"], "left").select(F.concat(F.lit("/f/"), F.col("id").cast("string")).alias("loc"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod"))
    h = F.lower(F.replace("maker_handle", F.lit("#"), F.lit("-")))
    makers = f.groupBy("maker_handle").agg(F.min("id").alias("first_id")).filter(h.rlike("^[a-z0-9][a-z0-9._-]*$")).select(F.concat(F.lit("/u/"), h).alias("loc"), F.col("first_id").cast("string").alias("lastmod"))
    return fixed.unionByName(items).unionByName(makers)


@query(sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN s = 'r' THEN 1 ELSE 0 END) AS BIGINT) AS gated FROM (SELECT CASE WHEN visibility = 'public' OR owner_id = 42 THEN 'o' ELSE 'r' END AS s FROM owned_v)", "owned_v"))
def row_gate(spark, d):
    ok = (F.col("visibility") == "public") | (F.col("owner_id") == 42)
    return owned(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("gated"))


@query(sql("SELECT id, name, '@font-face{font-family:\"' || name || '\";src:url(/cdn/' || CAST(id AS VARCHAR) || '.woff2)}' AS css FROM fonts_v WHERE visibility = 'public'", "fonts_v"))
def css_rules(spark, d):
    css = F.concat(F.lit('@font-face{font-family:"'), F.col("name"), F.lit('";src:url(/cdn/'), F.col("id").cast("string"), F.lit(".woff2)}"))
    return fonts(spark, d).filter("visibility = 'public'").select("id", "name", css.alias("css"))
