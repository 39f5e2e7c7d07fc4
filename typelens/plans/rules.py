"""Small rules of the pages: allow lists, keys, lists, unions, metadata edits, queues, spacing and peaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..sources.bindings import activity, fonts, owned, sql, table, users
from ..sources.shipping import ship
from . import query
from .glyphs import _PROF, profiles, sheet_cells
from .raster import ink_rows

ADMINS = " CUSTOMER#000000007@example.org , customer#000000042@Example.org ,, "


@query(sql(f"SELECT id, list_contains(list_filter(list_transform(string_split('{ADMINS}', ','), lambda x: lower(trim(x))), lambda x: x <> ''), lower(handle || '@example.org')) AS admin FROM user_v", "user_v"))
def admin_allowlist(spark, d):
    return users(spark, d).select("id", X.allowed(F.concat("handle", F.lit("@example.org")), F.lit(ADMINS)).alias("admin"))


@query("SELECT page_id, NOT regexp_matches(coalesce(url, ''), '[<>&]') AS accepted FROM pages")
def reject_markup(spark, d):
    return table(spark, d, "pages").select("page_id", (~F.coalesce("url", F.lit("")).rlike("[<>&]")).alias("accepted"))


@query(sql("SELECT id, coalesce(nullif(trim(CASE WHEN glyph_count % 4 = 0 THEN '  ' ELSE ' ' || badge END), ''), name) AS specimen FROM fonts_v", "fonts_v"))
def specimen_fallback(spark, d):
    word = F.when(F.col("glyph_count") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "badge"))
    return fonts(spark, d).select("id", F.coalesce(F.nullif(F.trim(word), F.lit("")), "name").alias("specimen"))


@query("""WITH o AS (SELECT l_orderkey AS sheet, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS cells FROM lineitem GROUP BY 1),
r AS (SELECT sheet, cells, list_filter([1, 2, 3], lambda i: cells[i] <= [13, 13, 5][i]) AS rows FROM o WHERE len(cells) = 3)
SELECT sheet, CASE len(rows) WHEN 1 THEN 'Row ' || rows[1] WHEN 2 THEN 'Rows ' || rows[1] || ' and ' || rows[2] ELSE 'Rows 1, 2 and 3' END AS crowded,
CAST(list_sum(list_transform(rows, lambda i: cells[i])) AS BIGINT) || CASE WHEN list_sum(list_transform(rows, lambda i: cells[i])) = 1 THEN ' shape' ELSE ' shapes' END AS shapes FROM r WHERE len(rows) > 0""")
def crowded_rows(spark, d):
    """Sheets of three rows set against 26, 26 and 10 characters: the rows in which at most half as many shapes were found."""
    t = sheet_cells(spark, d, F.col("l_quantity"))
    t = t.select("sheet", X.crowded(F.col("cells"), [26, 26, 10]).alias("rows")).filter("size(rows) > 0")
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["shapes"])
    return t.select("sheet", X.row_list(F.transform("rows", lambda x: x["row"])).alias("crowded"), X.plural(total, "shape", "shapes").alias("shapes"))


#: Families of object keys that may be served (fixed values).
KEYS = [
    ("avatar", r"^avatars/[\w-]+\.(png|jpg|webp)$"), ("card", r"^og/[\w.-]+\.png$"), ("bug", r"^bugs/[0-9a-f-]{36}\.(jpg|png)$"), ("font", r"^fonts/[\w.-]+\.(otf|ttf|woff2)$"),
]
_KEY = """CASE id % 7 WHEN 0 THEN 'fonts/f-' || id || '.woff2' WHEN 1 THEN 'og/f.' || id || '.png' WHEN 2 THEN 'avatars/u_' || id || '.webp' WHEN 3 THEN 'avatars/u.' || id || '.gif'
WHEN 4 THEN 'bugs/' || substr(md5(CAST(id AS STRING)), 1, 8) || '-0000-4000-8000-' || substr(md5(CAST(id AS STRING)), 1, 12) || '.png' WHEN 5 THEN 'fonts/../' || id || '.otf' ELSE 'fonts/a b' || id || '.ttf' END"""
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(key, '{p}') THEN '{n}'" for n, p in KEYS) + " END"


def keys(spark, d):
    return fonts(spark, d).select("id", F.expr(_KEY).alias("key"))


@query(sql(f", k AS (SELECT id, {_KEY} AS key FROM fonts_v), f AS (SELECT *, {_FAMILY} AS family FROM k) SELECT key, family, CASE WHEN family IN ('font', 'card') THEN regexp_extract(key, '^(?:fonts|og)/(.*)\\.[a-z0-9]+$', 1) END AS font_id FROM f", "fonts_v"))
def object_keys(spark, d):
    """The family of each key (none: not served) and the font that a font's or a card's key names."""
    family = F.coalesce(*[F.when(F.col("key").rlike(p), n) for n, p in KEYS])
    k = keys(spark, d).withColumn("family", family)
    return k.select("key", "family", F.when(F.col("family").isin("font", "card"), F.regexp_extract("key", r"^(?:fonts|og)/(.*)\.[a-z0-9]+$", 1)).alias("font_id"))


@query(sql(f", k AS (SELECT id, {_KEY} AS key FROM fonts_v) SELECT id, key FROM k WHERE key LIKE 'avatars/%' AND regexp_matches(key, '{KEYS[0][1]}')", "fonts_v"))
def avatar_rows(spark, d):
    return keys(spark, d).filter(F.startswith("key", F.lit("avatars/")) & F.col("key").rlike(KEYS[0][1]))


_SHEETS = """CASE WHEN id % 5 = 0 THEN '{broken' WHEN id % 5 = 1 THEN '{"sourceSheets":7}' ELSE '{"og":true,"sourceSheets":[{"key":"sources/' || id || '/base.png","size":4},{"key":"sources/' || (id + 1) || '/base.png"},{"key":null},{"key":"sources/' || id || '/variation-'
|| (id % 4) || '.jpg"}]}' END"""


@query(sql(f""", m AS (SELECT id, {_SHEETS} AS meta FROM fonts_v), k AS (SELECT id, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.sourceSheets[*].key') ELSE [] END AS keys FROM m)
SELECT id, array_to_string(list_filter(keys, lambda x: x IS NOT NULL AND starts_with(x, 'sources/' || id || '/') AND regexp_matches(substr(x, length('sources/' || id || '/') + 1), '^(base|variation-[12]|supplement)\\.(png|jpg|webp)$')), ' ') AS keys FROM k""", "fonts_v"))
def source_sheet_keys(spark, d):
    """Of the keys in the metadata those of the font's own sheets; none where the metadata is malformed."""
    return fonts(spark, d).select("id", F.array_join(X.source_keys(F.col("id").cast("string"), F.expr(_SHEETS)), " ").alias("keys"))


_ARMED = """CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["' || name || '","e' || chr(769) || '"]' WHEN 3 THEN '["a",1]' WHEN 4 THEN '{broken' ELSE '{"a":"b"}' END"""


@query(sql(f", m AS (SELECT id, {_ARMED.replace('chr(769)', 'chr(769)')} AS raw, name FROM fonts_v) SELECT id, CASE WHEN id % 6 = 2 THEN name || chr(10) || nfc_normalize('e' || chr(769)) END AS lines FROM m", "fonts_v"))
def armed_charset(spark, d):
    """A JSON array of strings, at least one, composed; else none."""
    ship(spark)
    raw = F.expr(_ARMED.replace("chr(769)", "decode(unhex('CC81'), 'UTF-8')"))
    return fonts(spark, d).select("id", X.armed(raw).alias("lines"))


_RAW = """CASE id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '[1]' WHEN 2 THEN '{"og":true,' || substr(meta, 2) ELSE meta END"""


@query(sql("""SELECT id, CASE WHEN id % 5 < 2 THEN '{' WHEN id % 5 = 2 THEN CASE WHEN id % 2 = 0 THEN '{"og":false,' ELSE '{"og":true,' END || substr(meta, 2, length(meta) - 2) || ',' ELSE substr(meta, 1, length(meta) - 1) || ',' END
|| '"family":"' || name || '","license":"cc0"}' AS meta, id % 5 = 2 AND id % 2 = 0 AS drop_og FROM fonts_v""", "fonts_v"))
def meta_edit(spark, d):
    """An edit of name and licence; all other keys stay as they are, and a card goes when the specimen is another."""
    ship(spark)
    f = fonts(spark, d).select("id", X.edited_meta(F.expr(_RAW), F.col("name"), F.lit("cc0"), F.col("id") % 2 == 0).alias("e"))
    return f.select("id", "e.meta", "e.drop_og")


_PAIRS = [("H", "O"), ("n", "o"), ("o", "u"), ("o", "o")]


@query(sql(_PROF + f" SELECT a.face, a.sheet_id AS left_id, b.sheet_id AS right_id FROM (VALUES {', '.join(map(str, _PAIRS))}) p(l, r) JOIN prof a ON a.ch = p.l JOIN prof b ON b.ch = p.r AND b.face = a.face", "pixels_v"))
def variant_pairs(spark, d):
    """A list of pairs for every variant of either character of a face."""
    p = profiles(spark, d).select("face", "sheet_id", "ch")
    follows = F.create_map(*[x for l in dict(_PAIRS) for x in (F.lit(l), F.array(*[F.lit(r) for a, r in _PAIRS if a == l]))])
    left = p.select("face", F.col("sheet_id").alias("left_id"), F.explode(follows[F.col("ch")]).alias("r"))
    return left.join(p.select("face", F.col("sheet_id").alias("right_id"), F.col("ch").alias("r")), ["face", "r"]).select("face", "left_id", "right_id")


@query(sql(""", h AS (SELECT id, 'hero' AS part, row_number() OVER (ORDER BY id) AS pos FROM fonts_v WHERE badge = 'LARGE' QUALIFY pos <= 6), w AS (SELECT id, 'wall' AS part, 6 + row_number() OVER (ORDER BY id) AS pos FROM fonts_v WHERE visibility = 'public' QUALIFY pos <= 30),
u AS (SELECT id, min(pos) AS pos, arg_max(part, pos) AS part FROM (FROM h UNION ALL FROM w) GROUP BY id) SELECT id, part, row_number() OVER (ORDER BY pos) AS place FROM u""", "fonts_v"))
def hero_and_wall(spark, d):
    """The first six large fonts and the first 24 public ones: each id once, at its first place, as its last row has it."""
    f = fonts(spark, d)
    top = lambda rows, n, part, base: rows.select("id").orderBy("id").limit(n).select("id", F.lit(part).alias("part"), (base + F.row_number().over(Window.orderBy("id"))).alias("pos"))
    u = top(f.filter("badge = 'LARGE'"), 6, "hero", 0).unionByName(top(f.filter("visibility = 'public'"), 24, "wall", 6))
    u = u.groupBy("id").agg(F.min("pos").alias("pos"), F.max_by("part", "pos").alias("part"))
    return u.select("id", "part", F.row_number().over(Window.orderBy("pos")).cast("long").alias("place"))


@query(sql("SELECT event, meta, count(*) AS n, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, meta) AS place FROM activity_v GROUP BY 1, 2", "activity_v"))
def breakdown_order(spark, d):
    n = activity(spark, d).groupBy("event", "meta").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("event").orderBy(F.desc("n"), "meta")).cast("long"))


@query(sql("SELECT day, count(*) AS n, row_number() OVER (ORDER BY day DESC) AS place FROM activity_v GROUP BY 1", "activity_v"))
def daily_newest_first(spark, d):
    n = activity(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("day"))).cast("long"))


@query(sql(", p AS (SELECT owner_id, id, (row_number() OVER (PARTITION BY owner_id ORDER BY id) - 1) // 4 AS batch FROM owned_v) SELECT owner_id, batch, count(*) AS n, min(id) AS first_id FROM p GROUP BY 1, 2", "owned_v"))
def batches(spark, d):
    """An owner's items in batches of four."""
    at = F.row_number().over(Window.partitionBy("owner_id").orderBy("id")) - 1
    p = owned(spark, d).select("owner_id", "id", F.floor(at / 4).alias("batch"))
    return p.groupBy("owner_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


EXPECTED = "zHHOnabz"


@query(sql(_PROF + f", e AS (SELECT face, list_filter(string_split('zHOnab', ''), lambda c: NOT list_contains(list(DISTINCT ch), c)) AS m FROM prof GROUP BY face) SELECT face, array_to_string(m, '') AS missing FROM e", "pixels_v"))
def missing_characters(spark, d):
    """Expected characters, each once and in order, that the face lacks."""
    wanted = F.array_distinct(F.array(*map(F.lit, EXPECTED)))
    return profiles(spark, d).groupBy("face").agg(F.collect_set("ch").alias("has")).select("face", F.array_join(F.array_except(wanted, "has"), "").alias("missing"))


@query("""WITH g AS (SELECT p_partkey AS id, p_size * 20 - 40 AS advance, -((p_partkey % 9) * 50) AS l, p_partkey * 7 % 1200 AS r FROM part), x AS (SELECT *, r - l AS ink, greatest(0, -l) + greatest(0, r - advance) AS over FROM g)
SELECT id, advance <= 0 OR (ink > 0 AND over > 100 AND (advance < ink * 0.75 OR over > greatest(ink * 0.35, 200))) AS problem, advance <= 0 AS problem_overlapping FROM x""")
def spacing_problems(spark, d):
    """Glyphs whose ink goes far out of their advance, and those without one, which alone are problems where overlaps are meant."""
    g = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20 - 40).alias("advance"), (-((F.col("p_partkey") % 9) * 50)).alias("l"), (F.col("p_partkey") * 7 % 1200).alias("r"))
    args = [F.col(c).cast("double") for c in ("advance", "l", "r")]
    return g.select("id", S.spacing_problem(*args, F.lit(1000.0)).alias("problem"), S.spacing_problem(*args, F.lit(1000.0), overlap=True).alias("problem_overlapping"))


_BASE = "https://m.ththth.example.net/en/25"


@query(f"""WITH p AS (SELECT page_id, string_split(url, '/') AS a, string_split('{_BASE}', '/') AS b FROM pages) SELECT page_id, array_to_string(list_filter(a, lambda x, i: x = b[i]), '|') AS shared FROM p""")
def shared_by_position(spark, d):
    """The parts of an address that a given one has at the same place."""
    p = table(spark, d, "pages").select("page_id", F.split("url", "/").alias("a"), F.split(F.lit(_BASE), "/").alias("b"))
    return p.select("page_id", F.array_join(F.filter("a", lambda x, i: x == F.get("b", i)), "|").alias("shared"))


@query("""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size <> 1 THEN p_size - 5 END AS pct, p_size * 10 AS h FROM part)
SELECT id, coalesce(pct > 0, false) AS tight, round(CASE WHEN pct > 0 THEN least(greatest(pct, 1), 12) / 100.0 ELSE 0.05 END, 6) AS bearing, CAST(least(3, greatest(1, ceil(320.0 / h))) AS BIGINT) AS detail FROM s""")
def build_flags(spark, d):
    """Flags of a spacing percentage (none, zero and less: as drawn) and the supersampling of a cell's height."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 1, F.col("p_size") - 5).alias("pct"), (F.col("p_size") * 10).alias("h"))
    tight = F.coalesce(F.col("pct") > 0, F.lit(False))
    return s.select("id", tight.alias("tight"), F.round(F.when(tight, S.clamp(F.col("pct"), 1, 12) / 100.0).otherwise(0.05), 6).alias("bearing"), S.clamp(F.ceil(F.lit(320.0) / F.col("h")), 1, 3).cast("long").alias("detail"))


@query(sql(", b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0) SELECT event, count(*) AS n FROM activity_v a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.user_id) GROUP BY 1", "activity_v"))
def ban_gate(spark, d):
    """Events of users who are not banned."""
    banned = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return activity(spark, d).join(banned, "user_id", "left_anti").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN true WHEN c_mktsegment = 'HOUSEHOLD' THEN false ELSE c_acctbal < 0 END AS banned, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'spam' WHEN c_mktsegment = 'HOUSEHOLD' OR c_acctbal >= 0 THEN NULL ELSE 'old' END AS reason FROM customer""")
def ban_flags(spark, d):
    """Users after one segment is banned and another's bans are lifted."""
    on, off = F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment") == "HOUSEHOLD"
    banned = F.when(on, True).when(off, False).otherwise(F.col("c_acctbal") < 0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), banned.alias("banned"), F.when(on, "spam").when(~off & (F.col("c_acctbal") < 0), "old").alias("reason"))


@query("SELECT conv_id, turn, role, length(text) AS size FROM conversations ORDER BY conv_id DESC, turn DESC, text DESC LIMIT 100")
def latest_reviews(spark, d):
    c = table(spark, d, "conversations").orderBy(F.desc("conv_id"), F.desc("turn"), F.desc("text")).limit(100)
    return c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))


@query("SELECT substr(sha256(s_name), 1, 12) AS id, s_name AS handle, DATE '2024-01-30' AS created_at, false AS banned, 0 AS reports FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, DATE '1970-01-01', c_acctbal < 0, 0 FROM customer")
def insert_defaults(spark, d):
    """Users and new ones, who get an id and the columns' defaults."""
    old = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("handle"), F.to_date(F.lit("1970-01-01")).alias("created_at"), (F.col("c_acctbal") < 0).alias("banned"), F.lit(0).alias("reports"))
    new = table(spark, d, "supplier").select(F.substring(F.sha2("s_name", 256), 1, 12).alias("id"), F.col("s_name").alias("handle"), F.to_date(F.lit("2024-01-30")).alias("created_at"))
    return old.unionByName(new.withColumns({"banned": F.lit(False), "reports": F.lit(0)}))


@query(sql(""", r AS (SELECT sheet_id, y, count(*) FILTER (WHERE ink) AS ink FROM pixels_v GROUP BY 1, 2), w AS (SELECT *, max(ink) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, max(ink) OVER (PARTITION BY sheet_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b FROM r)
SELECT sheet_id, y, ink FROM w WHERE ink > 0 AND ink = m AND ink > coalesce(b, 0)""", "pixels_v"))
def row_peaks(spark, d):
    """Rows with most ink within two rows; of equals the first."""
    w = Window.partitionBy("sheet_id").orderBy("y")
    r = ink_rows(spark, d).select("sheet_id", "y", "ink", F.max("ink").over(w.rowsBetween(-2, 2)).alias("m"), F.max("ink").over(w.rowsBetween(-2, -1)).alias("b"))
    return r.filter("ink > 0 and ink = m and ink > coalesce(b, 0)").select("sheet_id", "y", "ink")
