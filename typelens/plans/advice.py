"""What is known of an uploaded sheet before it is traced: flat bands, size, crowded rows, and the advice that follows; reports of failures.

A screen is made from each vector: 64 lines of 8 pixels, four lines a shade, some of them with grain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..sources.bindings import INK, activity, sql, table, users
from . import query

LINES, WIDE = 64, 8
#: A line is flat under the first, a band at least this share of the height, a screenshot from this share on; greys; distance from the page's shade.
FLAT, BAND, SCREEN, GREYS, TOLERANCE = 1.0, 0.02, 0.05, (20, 235), 6


def flat_share(lines: Column) -> Column:
    """From an array of (mean, sd) per line: the share of lines in flat bands of one grey that isn't the page's, the page being the commonest flat
    shade (in steps of four; of equals the uppermost)."""
    flat = F.filter(lines, lambda r: r["sd"] < FLAT)
    shades = F.transform(flat, lambda r: F.floor(r["mean"] / 4 + 0.5))
    kinds = F.array_distinct(shades)
    counted = F.transform(kinds, lambda k, i: F.struct(F.size(F.filter(shades, lambda v: v == k)).alias("n"), (-i).alias("first"), k.alias("k")))
    page = F.coalesce(F.array_max(counted)["k"] * 4, F.lit(-4))
    least = F.greatest(F.lit(2), F.ceil(F.size(lines) * BAND))
    grey = lambda r: (r["sd"] < FLAT) & r["mean"].between(*GREYS) & (F.abs(r["mean"] - page) > TOLERANCE)
    marks = F.transform(lines, lambda r: F.struct(r["mean"].alias("m"), grey(r).alias("on")))
    closed = lambda a: a["n"] + F.when(a["run"] >= least, a["run"]).otherwise(0)

    def step(a, r):
        goes_on = r["on"] & ((a["run"] == 0) | (F.abs(r["m"] - a["m"]) < 2))
        state = lambda n, run, m: F.struct(n.cast("long").alias("n"), run.cast("long").alias("run"), m.cast("double").alias("m"))
        more = state(a["n"], a["run"] + 1, F.when(a["run"] == 0, r["m"]).otherwise(a["m"]))
        return F.when(goes_on, more).otherwise(state(closed(a), r["on"].cast("long"), r["m"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("m"))
    return F.when(F.size(lines) > 0, F.aggregate(marks, start, step, closed) / F.size(lines)).otherwise(0.0)


def screens(spark, d):
    """(sheet_id, lines): mean and deviation of each line of a screen."""
    at = lambda k: F.get("embedding", k).cast("double")
    shade = lambda y: S.clamp(F.floor(at((y - y % 8).cast("int")) * 3) * 60 + 130, 0, 255)
    grain = lambda y: F.when(at(y.cast("int")) > 0.15, 9).otherwise(0)

    def line(y):
        px = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda x: (shade(y) + x % 2 * grain(y)).cast("double"))
        mean = F.aggregate(px, F.lit(0.0), lambda a, v: a + v) / WIDE
        square = F.aggregate(px, F.lit(0.0), lambda a, v: a + v * v) / WIDE
        return F.struct(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sd"))

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), line).alias("lines"))


_SHARE = f"""WITH RECURSIVE px AS (SELECT vec_id AS sheet_id, y, x, least(255, greatest(0, floor(CAST(embedding[y - y % 8 + 1] AS DOUBLE) * 3) * 60 + 130)) + x % 2 * CASE WHEN CAST(embedding[y + 1] AS DOUBLE) > 0.15e0 THEN 9 ELSE 0 END AS v FROM embeddings, range(0, {LINES}) a(y), range(0, {WIDE}) b(x)),
ln AS (SELECT sheet_id, y, avg(v) AS mean, stddev_pop(v) AS sd FROM px GROUP BY 1, 2),
pg AS (SELECT sheet_id, arg_max(k, (n, -first)) * 4 AS page FROM (SELECT sheet_id, floor(mean / 4 + 0.5) AS k, count(*) AS n, min(y) AS first FROM ln WHERE sd < 1 GROUP BY 1, 2) GROUP BY 1),
mk AS (SELECT ln.sheet_id, y, mean, sd < 1 AND mean >= 20 AND mean <= 235 AND abs(mean - coalesce(page, -4)) > 6 AS lit FROM ln LEFT JOIN pg USING (sheet_id)),
st AS (SELECT sheet_id, CAST(-1 AS BIGINT) AS y, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS run, 0.0::DOUBLE AS m FROM mk GROUP BY 1
UNION ALL SELECT s.sheet_id, s.y + 1, CASE WHEN k.lit AND (s.run = 0 OR abs(k.mean - s.m) < 2) THEN s.n ELSE s.n + CASE WHEN s.run >= 2 THEN s.run ELSE 0 END END, CASE WHEN k.lit AND (s.run = 0 OR abs(k.mean - s.m) < 2) THEN s.run + 1 ELSE k.lit::BIGINT END,
CASE WHEN k.lit AND s.run > 0 AND abs(k.mean - s.m) < 2 THEN s.m ELSE k.mean END FROM st s JOIN mk k ON k.sheet_id = s.sheet_id AND k.y = s.y + 1),
share AS (SELECT sheet_id, (n + CASE WHEN run >= 2 THEN run ELSE 0 END) / {LINES} AS share FROM st WHERE y = {LINES - 1})"""


@query(_SHARE + " SELECT sheet_id, round(share, 6) AS share, share >= 0.05e0 AS screenshot FROM share")
def flat_band_share(spark, d):
    """The share of a screen's lines in flat grey bands, and whether it is a screenshot's."""
    s = screens(spark, d).select("sheet_id", flat_share(F.col("lines")).alias("share"))
    return s.select("sheet_id", F.round("share", 6).alias("share"), (F.col("share") >= SCREEN).alias("screenshot"))


@query(_SHARE + " SELECT sheet_id AS id, 296 + sheet_id % 7 * 100 < 800 AS small, share >= 0.05e0 AS screenshot FROM share")
def sheet_signals(spark, d):
    """Sheets whose longer side is under 800 pixels, and those whose flat bands are a screenshot's."""
    s = screens(spark, d).select("sheet_id", flat_share(F.col("lines")).alias("share"))
    return s.select(F.col("sheet_id").alias("id"), (F.greatest(F.lit(296) + F.col("sheet_id") % 7 * 100, F.lit(571)) < 800).alias("small"), (F.col("share") >= SCREEN).alias("screenshot"))


#: What visitors read (fixed values).
SHOT = "This looks like a screenshot. The gray bars from the app get read as part of your sheet. Crop down to just the letters, or type them on a plain white page and export that."
SMALL = ("This image is only ", " pixels, so the letters can blur into each other. Export it at a larger size, or zoom in before you take the screenshot.")
ONE = ("Row ", " has ", " in the charset, but the maker only found ")
SPACE = " Letters that touch get read as one shape, so add some space between them. Turning up the letter spacing in your editor does it."
MANY = " have far fewer shapes than characters in the charset."


def advised(width: Column, height: Column, share: Column, cells: Column, chars: list[int], suggested: Column) -> Column:
    """The lines of advice for a sheet, the most useful first: a screenshot, a small image, crowded rows (not where a charset is being suggested)."""
    shot = F.when(share >= SCREEN, F.lit(SHOT))
    small = F.when(F.greatest(width, height) < 800, F.concat(F.lit(SMALL[0]), width.cast("string"), F.lit(" × "), height.cast("string"), F.lit(SMALL[1])))
    rows = F.when(~suggested, X.crowded(cells, chars))
    first = F.get(rows, F.lit(0))
    one = F.concat(F.lit(ONE[0]), first["row"].cast("string"), F.lit(ONE[1]), X.plural(first["chars"], "character", "characters"), F.lit(ONE[2]), X.plural(first["shapes"], "shape", "shapes"), F.lit(" there." + SPACE))
    many = F.concat(X.row_list(F.transform(rows, lambda r: r["row"])), F.lit(MANY + SPACE))
    return F.array_compact(F.array(shot, small, F.when(F.size(rows) == 1, one).when(F.size(rows) > 1, many)))


CHARS = (7, 7, 3)
_PARTS = [(0, 24), (24, 24), (48, 16)]


@query(_SHARE + f""", cl AS (SELECT vec_id AS sheet_id, [{", ".join(f"len(list_filter(range({a + 1}, {a + n + 1}), lambda i: CAST(embedding[i] AS DOUBLE) > {INK} AND (i = {a + 1} OR CAST(embedding[greatest(i - 1, 1)] AS DOUBLE) <= {INK})))" for a, n in _PARTS)}] AS cells FROM embeddings),
cr AS (SELECT *, list_filter([1, 2, 3], lambda i: cells[i] <= [3, 3, 1][i]) AS rows FROM cl),
a AS (SELECT sheet_id, list_filter([CASE WHEN share >= 0.05e0 THEN '{SHOT}' END, CASE WHEN 296 + sheet_id % 7 * 100 < 800 AND 571 < 800 THEN '{SMALL[0]}' || CAST(296 + sheet_id % 7 * 100 AS VARCHAR) || ' × 571{SMALL[1]}' END,
CASE WHEN sheet_id % 5 = 0 THEN NULL WHEN len(rows) = 1 THEN '{ONE[0]}' || CAST(rows[1] AS VARCHAR) || '{ONE[1]}' || CAST({list(CHARS)}[rows[1]] AS VARCHAR) || ' characters{ONE[2]}' || CAST(cells[rows[1]] AS VARCHAR) || CASE WHEN cells[rows[1]] = 1 THEN ' shape' ELSE ' shapes' END || ' there.{SPACE}'
WHEN len(rows) = 2 THEN 'Rows ' || CAST(rows[1] AS VARCHAR) || ' and ' || CAST(rows[2] AS VARCHAR) || '{MANY}{SPACE}' WHEN len(rows) = 3 THEN 'Rows 1, 2 and 3{MANY}{SPACE}' END], lambda x: x IS NOT NULL) AS lines FROM cr JOIN share USING (sheet_id))
SELECT sheet_id, CAST(len(lines) AS BIGINT) AS n, array_to_string(lines, chr(10)) AS lines FROM a""")
def upload_advice(spark, d):
    """What a visitor is told of a screen: its flat bands, its size, and the runs of ink in three rows set against seven, seven and three characters."""
    bits = F.transform("embedding", lambda v: v.cast("double") > INK)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), bits.alias("bits"))
    begins = lambda a, n: F.size(F.filter(F.sequence(F.lit(a), F.lit(a + n - 1)), lambda i: F.get("bits", i) & ((i == a) | ~F.get("bits", F.greatest(i - 1, F.lit(0))))))
    cells = e.select("sheet_id", F.array(*[begins(a, n) for a, n in _PARTS]).alias("cells"))
    s = screens(spark, d).select("sheet_id", flat_share(F.col("lines")).alias("share")).join(cells, "sheet_id")
    lines = advised(F.lit(296) + F.col("sheet_id") % 7 * 100, F.lit(571), F.col("share"), F.col("cells"), list(CHARS), F.col("sheet_id") % 5 == 0)
    return s.select("sheet_id", lines.alias("l")).select("sheet_id", F.size("l").cast("long").alias("n"), F.array_join("l", "\n").alias("lines"))


#: What a report may hold, in this order, with the longest string of each (fixed values; 0: 100).
CONTEXT = {
    "where": 40, "phase": 20, "stage": 40, "kind": 20, "error": 500, "errorClass": 40, "warning": 300, "preset": 20, "fineDetail": 0, "spacing": 0, "trimFlourishes": 0, "connect": 0, "italic": 0,
    "naturalVariation": 0, "charsetLines": 0, "detectedRows": 0, "glyphCount": 0, "flaggedCount": 0, "sheetW": 0, "sheetH": 0, "userAgent": 300, "viewport": 20, "dpr": 0,
}


def context(raw: Column) -> Column:
    """array<struct<k, v>>: the known keys of a JSON object that have a string (trimmed, cut, not empty), a number or a truth value; empty for other JSON
    and for what is none."""
    v = F.try_parse_json(raw)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    show = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    one = lambda k, most: F.when(kind(k) == "STRING", F.nullif(F.substring(F.trim(show(k)), 1, most or 100), F.lit(""))).when(kind(k).rlike("^(BIGINT|DECIMAL.*|DOUBLE|BOOLEAN)$"), show(k))
    each = F.array(*[F.struct(F.lit(k).alias("k"), one(k, most).alias("v")) for k, most in CONTEXT.items()])
    return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array().cast("array<struct<k:string,v:string>>")).otherwise(F.filter(each, lambda x: x["v"].isNotNull()))


def context_text(fields: Column) -> Column:
    return F.array_join(F.transform(fields, lambda x: F.concat_ws(": ", x["k"], x["v"])), "\n")


_RAW = """CASE k % 7 WHEN 0 THEN '{"error":"  bad " ,"phase":"build","secret":"x","sheetW":' || k || ',"connect":true,"dpr":1.5}' WHEN 1 THEN '{"where":"","stage":["a"],"kind":{"a":1},"viewport":"' || repeat('9', 30) || '"}'
WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{broken' WHEN 4 THEN '{"spacing":-' || k || ',"warning":" ' || event || '","glyphCount":null}' WHEN 5 THEN '' ELSE '{"error":7,"italic":false}' END"""
_KIND = "json_type(j, '$.{k}')"
_FIELD = "CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN '{k}: ' || nullif(substr(trim(json_extract_string(j, '$.{k}')), 1, {n}), '') WHEN json_type(j, '$.{k}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') THEN '{k}: ' || json_extract_string(j, '$.{k}') END"
_CONTEXT = f""", raw_v AS (SELECT *, {_RAW} AS raw FROM activity_v), ctx_v AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(CAST(raw AS JSON)) = 'OBJECT' THEN CAST(raw AS JSON) END AS j FROM raw_v),
line_v AS (SELECT *, array_to_string(list_filter([{", ".join(_FIELD.format(k=k, n=n or 100) for k, n in CONTEXT.items())}], lambda x: x IS NOT NULL), chr(10)) AS context, coalesce(json_type(j, '$.error') = 'VARCHAR' AND trim(json_extract_string(j, '$.error')) <> '', false) AS error FROM ctx_v)"""


@query(sql(_CONTEXT + " SELECT event_id, context, error OR trim(meta) <> '' OR k % 10 = 0 AS substance FROM line_v", "activity_v"))
def bug_contexts(spark, d):
    """What is kept of a report's context, and whether there is anything to act on: a note, an error or a sheet."""
    a = activity(spark, d).withColumn("c", context(F.expr(_RAW)))
    return a.select("event_id", context_text(F.col("c")).alias("context"), (F.exists("c", lambda x: (x["k"] == "error") & ~x["v"].rlike("^[0-9]+$")) | (F.trim("meta") != "") | (F.col("k") % 10 == 0)).alias("substance"))


@query(sql(_CONTEXT + " SELECT event_id, handle, context FROM line_v LEFT JOIN user_v ON user_v.id = line_v.user_id WHERE event = 'build_fail' AND k % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 200", "activity_v", "user_v"))
def bug_queue(spark, d):
    """The newest 200 open reports with their contexts and their senders, if known."""
    a = activity(spark, d, "build_fail").filter("k % 3 <> 0").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    a = a.select("event_id", "user_id", context_text(context(F.expr(_RAW))).alias("context"))
    return a.join(users(spark, d).select(F.col("id").alias("user_id"), "handle"), "user_id", "left").select("event_id", "handle", "context")
