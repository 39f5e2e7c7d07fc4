"""Pages made of several scans: the dashboard's numbers, makers for the site map, source sheets before they are stored."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..sources.bindings import activity, owned, sql, users, votes
from . import query
from .files import _case, images

_SAFE = "^[a-z0-9][a-z0-9._-]*$"


@query(sql(f""", r AS (SELECT lower(replace(u.handle, '#', '-')) AS h, o.created_at, o.id FROM owned_v o JOIN user_v u ON u.id = o.owner_id WHERE o.visibility = 'public'),
f AS (SELECT h, max(created_at) AS t, arg_max(id, (created_at, id)) AS newest FROM r WHERE regexp_full_match(h, '[a-z0-9][a-z0-9._-]*') GROUP BY h)
SELECT '/u/' || h AS loc, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS lastmod, newest, row_number() OVER (ORDER BY t DESC, newest DESC) AS place FROM f ORDER BY t DESC, newest DESC LIMIT 500""", "owned_v", "user_v"))
def sitemap_makers(spark, d):
    """Makers by their newest public item: the first of a handle among rows from the newest on gives its date; the first 500."""
    h = F.lower(F.replace("handle", F.lit("#"), F.lit("-")))
    o = owned(spark, d).filter("visibility = 'public'").select("owner_id", "created_at", "id")
    r = o.join(users(spark, d).select(F.col("id").alias("owner_id"), h.alias("h")), "owner_id").filter(F.col("h").rlike(_SAFE))
    f = r.groupBy("h").agg(F.max(F.struct(F.col("created_at").alias("t"), "id")).alias("m")).select("h", "m.t", F.col("m.id").alias("newest"))
    top = f.orderBy(F.desc("t"), F.desc("newest")).limit(500)
    place = F.row_number().over(Window.orderBy(F.desc("t"), F.desc("newest")))  # over 500 rows
    return top.select(F.concat(F.lit("/u/"), "h").alias("loc"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod"), "newest", place.cast("long").alias("place"))


@query(sql("""SELECT 'members' AS name, count(*) AS n FROM user_v UNION ALL SELECT 'public items', count(*) FROM owned_v WHERE visibility = 'public' UNION ALL SELECT 'votes', count(*) FROM votes_v
UNION ALL SELECT 'open reports', count(*) FROM owned_v WHERE priority = '1-URGENT' UNION ALL SELECT 'builds', count(*) FROM activity_v WHERE event = 'build_ok' UNION ALL SELECT 'failures', count(*) FROM activity_v WHERE event = 'build_fail'
UNION ALL SELECT 'downloads', count(*) FROM activity_v WHERE event IN ('download', 'library_download')""", "user_v", "owned_v", "votes_v", "activity_v"))
def dashboard_numbers(spark, d):
    """Seven independent scans as one job: Spark runs their stages side by side."""
    o, a = owned(spark, d), activity(spark, d)
    of_event = lambda *names: a.filter(F.col("event").isin(*names))
    parts = {
        "members": users(spark, d), "public items": o.filter("visibility = 'public'"), "votes": votes(spark, d), "open reports": o.filter("priority = '1-URGENT'"), "builds": of_event("build_ok"), "failures": of_event("build_fail"),
        "downloads": of_event("download", "library_download"),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: What a visitor is told (fixed values), the most files, and the largest.
TOO_MANY, BAD_SIZE, BAD_TYPE = "Publish up to three source sheets.", "Each source sheet must be between 1 byte and 10 MB.", "Source sheets must be PNG, JPEG, or WebP images."
MOST, LARGEST = 3, 10 * 1024 * 1024


def prepared(font: Column, files: Column, supplement: Column) -> Column:
    """Files (kind, size) in order, and a supplement of the same form or null, as struct<error, keys>: keys by place and kind, or why they are refused (their
    number, then any size, then any kind)."""
    known = F.create_map(F.lit("png"), F.lit("png"), F.lit("jpeg"), F.lit("jpg"), F.lit("webp"), F.lit("webp"))
    role = lambda i: F.when(i == 0, "base").otherwise(F.concat(F.lit("variation-"), i.cast("string")))
    named = F.transform(files, lambda f, i: F.struct(role(i).alias("role"), f["kind"].alias("kind"), f["size"].alias("size")))
    more = F.when(supplement.isNull(), F.slice(named, 1, 0)).otherwise(F.array(F.struct(F.lit("supplement").alias("role"), supplement["kind"].alias("kind"), supplement["size"].alias("size"))))
    every = F.concat(named, more)
    error = (
        F.when(F.size(files) > MOST, TOO_MANY).when(F.exists(every, lambda f: (f["size"] <= 0) | (f["size"] > LARGEST)), BAD_SIZE).when(F.exists(every, lambda f: known[f["kind"]].isNull()), BAD_TYPE)
    )
    keys = F.transform(every, lambda f: F.concat(F.lit("sources/"), font, F.lit("/"), f["role"], F.lit("."), known[f["kind"]]))
    return F.struct(error.alias("error"), F.when(error.isNull(), keys).alias("keys"))


_KIND = "CASE WHEN ({0}) % 5 IN (0, 1, 3) THEN 'png' WHEN ({0}) % 5 = 2 THEN 'jpg' END"
_FILE = f"(SELECT id, {_KIND.format('id')} AS kind, length({_case(0)}) // 2 * CASE WHEN id % 23 = 0 THEN 0 WHEN id % 29 = 0 THEN 1000000 ELSE 1 END AS size FROM (SELECT id, upper(hex(name)) AS h, length(name) AS n FROM fonts_v))"


@query(sql(f""", fl AS {_FILE}, g AS (SELECT f.id, f.id % 5 = 4 AND count(*) = 3 AS more, list({{'r': CASE WHEN k.id - f.id = 0 THEN 'base' WHEN f.id % 5 = 4 AND k.id = f.id + 2 THEN 'supplement' ELSE 'variation-' || CAST(k.id - f.id AS VARCHAR) END, 'k': k.kind, 's': k.size}} ORDER BY k.id) AS fs
FROM fl f JOIN fl k ON k.id >= f.id AND k.id < f.id + CASE f.id % 5 WHEN 4 THEN 3 WHEN 3 THEN 4 ELSE f.id % 5 + 1 END GROUP BY f.id)
SELECT id, CASE WHEN len(fs) - more::INT > 3 THEN '{TOO_MANY}' WHEN len(list_filter(fs, lambda f: f.s <= 0 OR f.s > {LARGEST})) > 0 THEN '{BAD_SIZE}' WHEN len(list_filter(fs, lambda f: f.k IS NULL)) > 0 THEN '{BAD_TYPE}' END AS error,
CASE WHEN len(fs) - more::INT <= 3 AND len(list_filter(fs, lambda f: f.s <= 0 OR f.s > {LARGEST} OR f.k IS NULL)) = 0 THEN array_to_string(list_transform(fs, lambda f: 'sources/' || id || '/' || f.r || '.' || f.k), ' ') END AS keys FROM g""", "fonts_v"))
def source_preparation(spark, d):
    """Items with one to four files each, the bytes of items from their number on: the keys under which they are stored, or why they are not."""
    size = F.octet_length("content").cast("long") * F.when(F.col("id") % 23 == 0, 0).when(F.col("id") % 29 == 0, 1000000).otherwise(1)
    f = images(spark, d).select("id", F.struct(F.col("id").alias("at"), B.signature(F.col("content")).alias("kind"), size.alias("size")).alias("file"))
    many = F.when(F.col("id") % 5 == 4, 3).when(F.col("id") % 5 == 3, 4).otherwise(F.col("id") % 5 + 1)
    # a file goes to the items that have it among theirs: those up to three before
    to = f.select(F.explode(F.sequence(F.col("id") - 3, F.col("id"))).alias("id"), "file").filter(F.col("file.at") - F.col("id") < many)
    g = to.join(f.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("file")).alias("fs"))
    has = (F.col("id") % 5 == 4) & (F.element_at("fs", -1)["at"] == F.col("id") + 2)
    files = F.when(has, F.slice("fs", F.lit(1), F.size("fs") - 1)).otherwise(F.col("fs"))
    p = g.select("id", prepared(F.col("id").cast("string"), files, F.when(has, F.element_at("fs", -1))).alias("p"))
    return p.select("id", "p.error", F.array_join("p.keys", " ").alias("keys"))
