"""Glyphs, spacing, layouts, pairs and seams. A glyph is a sheet's ink; its character comes from a fixed alphabet by sheet number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.bindings import pixels, sql, table
from ..sources.shipping import ship
from . import query

ALPHABET = "HIOnouilxvwz"
_CH = f"substr('{ALPHABET}', CAST(sheet_id % {len(ALPHABET)} AS INT) + 1, 1)"
_PROF = f""", prof AS (SELECT sheet_id, sheet_id // 50 AS face, {_CH} AS ch, CAST(coalesce(max(x) FILTER (WHERE ink) - min(x) FILTER (WHERE ink) + 1, 0) AS BIGINT) AS width,
CAST(coalesce(max(y) FILTER (WHERE ink) - min(y) FILTER (WHERE ink) + 1, 0) AS BIGINT) AS height, count(*) FILTER (WHERE ink) AS area, max(y) FILTER (WHERE ink) AS base FROM pixels_v GROUP BY sheet_id)"""


def profiles(spark, d):
    """One row per glyph: face (50 sheets), character, width, height, area, last ink row."""
    p = pixels(spark, d)
    ink = lambda c: F.when(F.col("ink"), F.col(c))
    g = p.groupBy("sheet_id").agg(
        F.coalesce(F.max(ink("x")) - F.min(ink("x")) + 1, F.lit(0)).alias("width"), F.coalesce(F.max(ink("y")) - F.min(ink("y")) + 1, F.lit(0)).alias("height"),
        F.count_if("ink").alias("area"), F.max(ink("y")).alias("base"),
    )
    ch = F.substring(F.lit(ALPHABET), (F.col("sheet_id") % len(ALPHABET)).cast("int") + 1, F.lit(1))
    return g.withColumn("face", F.floor(F.col("sheet_id") / 50)).withColumn("ch", ch)


@query(sql(_PROF + " SELECT sheet_id, face, ch, width, height, area FROM prof", "pixels_v"))
def glyph_profile(spark, d):
    return profiles(spark, d).select("sheet_id", "face", "ch", "width", "height", "area")


@query(sql(_PROF + """, m AS (SELECT face, list_sort(list(width) FILTER (WHERE width > 0))[CAST(floor(count(*) FILTER (WHERE width > 0) / 2) AS BIGINT) + 1] AS m FROM prof GROUP BY face)
SELECT sheet_id, width, m AS median, CASE WHEN width > 1.9 * m THEN 'wide' WHEN width < 0.34 * m THEN 'narrow' ELSE '' END AS flag FROM prof JOIN m USING (face)""", "pixels_v"))
def glyph_outliers(spark, d):
    """Widths far from the face's upper median; faces without ink have no flags."""
    p = profiles(spark, d)
    m = p.groupBy("face").agg(S.upper_median(F.when(F.col("width") > 0, F.col("width"))).alias("median"))
    flag = F.when(F.col("width") > 1.9 * F.col("median"), "wide").when(F.col("width") < 0.34 * F.col("median"), "narrow").otherwise("")
    return p.join(m, "face").select("sheet_id", "width", "median", flag.alias("flag"))


def spacing(samples):
    """From (face, ch, width, counter), one row per face and character: side bearing in per cent of the em (8 pixels) and what it comes from."""
    inner = (F.col("counter") > 0) & (F.col("counter") < F.col("width"))
    a = samples.groupBy("face").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inner).alias("k"), S.middle_median(F.col("width")).alias("w"), S.middle_median(F.when(inner, F.col("counter"))).alias("c")
    )
    few, enough = F.col("n") < 3, F.col("k") >= 3
    pct = S.half_up(S.clamp(F.when(enough, F.col("c") * 0.16).otherwise(F.col("w") * 0.065) / 8 * 100, 2.5, 7.0) * 10) / 10
    return a.select(
        "face", F.when(few, "fallback").when(enough, "counters").otherwise("proportions").alias("source"),
        F.when(~few & enough, F.col("k")).otherwise(F.col("n")).alias("samples"), F.when(few, F.lit(3.5)).otherwise(pct).alias("pct"),
    )


@query(sql(_PROF + """, gp AS (SELECT sheet_id, y, max(x - before - 1) AS c FROM (SELECT sheet_id, y, x, lag(x) OVER (PARTITION BY sheet_id, y ORDER BY x) AS before FROM pixels_v WHERE ink) GROUP BY 1, 2),
hh AS (SELECT sheet_id, 8 - min(y) AS h FROM pixels_v WHERE ink GROUP BY 1),
ct AS (SELECT sheet_id, list_sort(list(c))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS counter FROM gp JOIN hh USING (sheet_id) WHERE c > h * 0.04e0 AND y >= greatest(0, ceil(8 - h * 0.7e0)) AND y <= least(7, 8 - h * 0.25e0) GROUP BY 1),
s AS (SELECT face, ch, width, coalesce(counter, 0) AS counter FROM prof LEFT JOIN ct USING (sheet_id) WHERE ch IN ('H', 'O', 'n', 'o', 'u') AND width > 0 QUALIFY row_number() OVER (PARTITION BY face, ch ORDER BY sheet_id DESC) = 1),
a AS (SELECT face, count(*) AS n, count(*) FILTER (WHERE counter > 0 AND counter < width) AS k, median(width) AS w, median(counter) FILTER (WHERE counter > 0 AND counter < width) AS c FROM s GROUP BY face)
SELECT face, CASE WHEN n < 3 THEN 'fallback' WHEN k >= 3 THEN 'counters' ELSE 'proportions' END AS source, CASE WHEN n >= 3 AND k >= 3 THEN k ELSE n END AS samples,
CASE WHEN n < 3 THEN 3.5 ELSE floor(greatest(2.5, least(7.0, (CASE WHEN k >= 3 THEN c * 0.16 ELSE w * 0.065 END) / 8 * 100)) * 10 + 0.5) / 10 END AS pct FROM a""", "pixels_v"))
def auto_spacing(spark, d):
    """Bearings by the counters of the last sample of each reference character; a counter is the upper median of the widest gaps of the rows between
    0.25 and 0.7 of the glyph's height over the base line (its foot), gaps of 0.04 of that height and less being none."""
    w = Window.partitionBy("sheet_id", "y").orderBy("x")
    ink = pixels(spark, d).filter("ink").withColumn("gap", F.col("x") - F.lag("x").over(w) - 1).withColumn("h", 8 - F.min("y").over(Window.partitionBy("sheet_id")))
    rows = ink.groupBy("sheet_id", "y", "h").agg(F.max("gap").alias("c"))
    body = (F.col("y") >= F.greatest(F.lit(0), F.ceil(8 - F.col("h") * 0.7))) & (F.col("y") <= F.least(F.lit(7), 8 - F.col("h") * 0.25))
    counters = rows.filter(body & (F.col("c") > F.col("h") * 0.04)).groupBy("sheet_id").agg(S.upper_median(F.col("c")).alias("counter"))
    p = profiles(spark, d).filter(F.col("ch").isin(*"HOnou") & (F.col("width") > 0)).join(counters, "sheet_id", "left")
    return spacing(S.first_wins(p.withColumn("counter", F.coalesce("counter", F.lit(0))), ["face", "ch"], F.desc("sheet_id")))


_STEM = f"n >= 4 AND abs(slope) <= 0.08 AND off <= 0.32 AND {_CH} IN ('H', 'I', 'i', 'l')"


@query(sql(""", pt AS (SELECT sheet_id, y, (min(x) + max(x)) / 2.0 AS x FROM pixels_v WHERE ink AND y BETWEEN 2 AND 5 GROUP BY 1, 2), """ + f"""f AS (SELECT sheet_id, regr_slope(x, y) AS slope, count(x) AS n, var_pop(x) AS vx, var_pop(y) AS vy FROM pt GROUP BY 1),
g AS (SELECT sheet_id, n, slope, sqrt(greatest(0, vx - slope * slope * vy)) AS off FROM f), s AS (SELECT DISTINCT sheet_id FROM pixels_v)
SELECT sheet_id // 50 AS face, count(DISTINCT {_CH}) FILTER (WHERE {_STEM}) AS votes, count(DISTINCT {_CH}) FILTER (WHERE {_STEM}) >= 3 AS upright FROM s LEFT JOIN g USING (sheet_id) GROUP BY 1""", "pixels_v"))
def stem_vote(spark, d):
    """Characters whose centre line between 0.2 and 0.7 of the x-height (8) over the base line (7) is straight and upright."""
    p = pixels(spark, d)
    ink = F.col("ink") & F.col("y").between(2, 5)
    pt = p.groupBy("sheet_id", "y").agg(((F.min(F.when(ink, F.col("x"))) + F.max(F.when(ink, F.col("x")))) / 2).alias("x"))
    at = F.when(F.col("x").isNotNull(), F.col("y"))
    f = pt.groupBy("sheet_id").agg(F.regr_slope("x", "y").alias("slope"), F.count("x").alias("n"), F.var_pop("x").alias("vx"), F.var_pop(at).alias("vy"))
    off = F.sqrt(F.greatest(F.lit(0.0), F.col("vx") - F.col("slope") * F.col("slope") * F.col("vy")))
    ch = F.substring(F.lit(ALPHABET), (F.col("sheet_id") % len(ALPHABET)).cast("int") + 1, F.lit(1))
    good = (F.col("n") >= 4) & (F.abs("slope") <= 0.08) & (off <= 0.32) & ch.isin(*"HIil")
    v = f.groupBy(F.floor(F.col("sheet_id") / 50).alias("face")).agg(F.count_distinct(F.when(good, ch)).alias("votes"))
    return v.withColumn("upright", F.col("votes") >= 3)


@query(sql(_PROF + """, r AS (SELECT face, CASE WHEN count(*) FILTER (WHERE ch IN ('H', 'I')) >= 3 THEN median(height) FILTER (WHERE ch IN ('H', 'I')) END AS caps,
CASE WHEN count(*) FILTER (WHERE ch IN ('x', 'v', 'w', 'z', 'o', 'n', 'u')) >= 3 THEN median(height) FILTER (WHERE ch IN ('x', 'v', 'w', 'z', 'o', 'n', 'u')) END AS xh FROM prof GROUP BY face)
SELECT face, round(caps, 6) AS caps, round(xh, 6) AS xh, round(coalesce(xh / nullif(caps, 0), 0.7), 6) AS ratio FROM r""", "pixels_v"))
def reference_heights(spark, d):
    """Medians of classes of characters that have at least three samples."""
    def med(chars):
        own = F.col("ch").isin(*chars)
        return F.when(F.count_if(own) >= 3, S.middle_median(F.when(own, F.col("height"))))

    r = profiles(spark, d).groupBy("face").agg(med("HI").alias("caps"), med("xvwzonu").alias("xh"))
    return r.select("face", F.round("caps", 6).alias("caps"), F.round("xh", 6).alias("xh"), F.round(F.coalesce(F.try_divide("xh", "caps"), F.lit(0.7)), 6).alias("ratio"))


@query(sql(_PROF + """, m AS (SELECT face, median(base) AS ref FROM prof WHERE base IS NOT NULL GROUP BY face HAVING count(*) >= 3)
SELECT sheet_id, CASE WHEN abs(ref - base) <= 0.001 OR abs(ref - base) > 4 THEN 0.0 ELSE round(ref - base, 6) END AS shift FROM prof JOIN m USING (face) WHERE base IS NOT NULL""", "pixels_v"))
def baseline_alignment(spark, d):
    p = profiles(spark, d).filter("base is not null")
    m = p.groupBy("face").agg(S.middle_median(F.col("base")).alias("ref"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    gap = F.col("ref") - F.col("base")
    return p.join(m, "face").select("sheet_id", F.when((F.abs(gap) <= 0.001) | (F.abs(gap) > 4), F.lit(0.0)).otherwise(F.round(gap, 6)).alias("shift"))


#: Letters with straight sides, and those that lean or cross (fixed values of the two classes of pairs).
STRAIGHT = "HIilnu"
STRIP = (0, 6)  # lines of a glyph (of 8) between 0.15 and 1.1 of the x-height over the base line


def facing(lines, glyphs):
    """Lines (sheet_id, y, left, right: columns of a glyph's box with ink, half-open) and glyphs (sheet_id, face, ch, width) -> per pair of
    neighbouring glyphs of a face the least distance between the right side of one and the left side of the next, over the lines of the strip
    that both have; negative where they reach into each other.  A glyph's advance is its box and one column, kerned by the difference of widths.
    """
    g = glyphs.select("face", "sheet_id", "ch", F.col("width").alias("w"), (F.col("sheet_id") + 1).alias("next_id"))
    r = g.select(F.col("sheet_id").alias("next_id"), F.col("face").alias("next_face"), F.col("ch").alias("next_ch"), F.col("w").alias("next_w"))
    pairs = g.join(r, "next_id").filter("face = next_face and w > 0 and next_w > 0")
    strip = lines.filter(F.col("y").between(*STRIP))
    both = pairs.join(strip.select("sheet_id", "y", "right"), "sheet_id").join(strip.select(F.col("sheet_id").alias("next_id"), "y", "left"), ["next_id", "y"])
    gap = F.col("w") + 1 + (F.col("w") - F.col("next_w")) + F.col("left") - F.col("right")
    kind = F.when(F.lit(STRAIGHT).contains(F.col("ch")) & F.lit(STRAIGHT).contains(F.col("next_ch")), "straight").otherwise("crossing")
    return both.groupBy("face", "sheet_id", F.concat("ch", "next_ch").alias("pair"), kind.alias("kind")).agg(F.min(gap).alias("gap"))


def side_lines(spark, d):
    """Per line of a glyph's box the first column with ink and the one behind the last, from the box's left."""
    p = pixels(spark, d).filter("ink").groupBy("sheet_id", "y").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    left = p.groupBy("sheet_id").agg(F.min("a").alias("x0"))
    return p.join(left, "sheet_id").select("sheet_id", "y", (F.col("a") - F.col("x0")).alias("left"), (F.col("b") - F.col("x0")).alias("right"))


_FACING = _PROF + f""", sl AS (SELECT sheet_id, y, min(x) AS a, max(x) + 1 AS b FROM pixels_v WHERE ink GROUP BY 1, 2), sd AS (SELECT *, min(a) OVER (PARTITION BY sheet_id) AS x0 FROM sl),
fc AS (SELECT l.face, l.sheet_id, l.ch || r.ch AS pair, CASE WHEN contains('{STRAIGHT}', l.ch) AND contains('{STRAIGHT}', r.ch) THEN 'straight' ELSE 'crossing' END AS kind, min(l.width + 1 + l.width - r.width + (q.a - q.x0) - (p.b - p.x0)) AS gap
FROM prof l JOIN prof r ON r.sheet_id = l.sheet_id + 1 AND r.face = l.face JOIN sd p ON p.sheet_id = l.sheet_id JOIN sd q ON q.sheet_id = r.sheet_id AND q.y = p.y WHERE p.y BETWEEN {STRIP[0]} AND {STRIP[1]} GROUP BY ALL)"""


@query(sql(_FACING + " SELECT face, kind, count(*) AS pairs, round(stddev_pop(gap), 6) AS sd, greatest(0, max(-gap)) AS depth, CASE WHEN min(gap) < 0 THEN arg_min(pair, (gap, sheet_id)) ELSE '' END AS worst_pair FROM fc GROUP BY 1, 2", "pixels_v"))
def pair_gaps(spark, d):
    """Neighbouring glyphs of a face as pairs, by class: the spread of their gaps, and the pair that reaches deepest into each other."""
    f = facing(side_lines(spark, d), profiles(spark, d))
    g = f.groupBy("face", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.stddev_pop("gap"), 6).alias("sd"), F.min("gap").alias("least"), F.min_by("pair", F.struct("gap", "sheet_id")).alias("pair"))
    return g.select("face", "kind", "pairs", "sd", F.greatest(F.lit(0), -F.col("least")).alias("depth"), F.when(F.col("least") < 0, F.col("pair")).otherwise("").alias("worst_pair"))


@query(sql(_FACING + """, rk AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY gap, sheet_id) - 1 AS k, count(*) OVER (PARTITION BY face) AS n FROM fc)
SELECT face, any_value(n) AS pairs, max(gap) FILTER (WHERE k = n // 2) AS median, max(gap) AS widest, arg_max(pair, (gap, -sheet_id)) AS widest_pair, round(sqrt(avg(gap * gap) - avg(gap) * avg(gap)), 5) AS rhythm FROM rk GROUP BY face""", "pixels_v"))
def face_rhythm(spark, d):
    """A face's gaps: their upper median, the widest one and its pair, and the spread."""
    f = facing(side_lines(spark, d), profiles(spark, d))
    w = Window.partitionBy("face")
    r = f.withColumns({"k": F.row_number().over(w.orderBy("gap", "sheet_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    return r.groupBy("face").agg(
        F.first("n").alias("pairs"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("gap"))).alias("median"), F.max("gap").alias("widest"), F.max_by("pair", F.struct("gap", -F.col("sheet_id"))).alias("widest_pair"),
        F.round(F.stddev_pop("gap"), 5).alias("rhythm"),
    )


@query(sql(_PROF + """, pr AS (SELECT a.face, a.ch AS l, b.ch AS r, a.sheet_id * 1000 + b.sheet_id % 50 AS seq, greatest(-32768, least(32767, a.width - b.width)) AS kern FROM prof a JOIN prof b ON a.face = b.face AND (b.sheet_id = a.sheet_id + 1 OR b.sheet_id = a.sheet_id + 13)),
d AS (SELECT *, row_number() OVER (PARTITION BY face, l, r ORDER BY seq DESC) AS rn FROM pr) SELECT face, l, r, CAST(kern AS BIGINT) AS kern FROM d WHERE rn = 1 AND kern <> 0""", "pixels_v"))
def kern_dedupe(spark, d):
    """Pairs by a pair list (the next glyph, the 13th next); of equal pairs the last one counts, zero kerns go."""
    p = profiles(spark, d).select("face", "sheet_id", "ch", "width")
    steps = p.withColumn("right_id", F.explode(F.array(F.col("sheet_id") + 1, F.col("sheet_id") + 13)))
    r = p.select(F.col("face").alias("f2"), F.col("sheet_id").alias("right_id"), F.col("ch").alias("r"), F.col("width").alias("w2"))
    j = steps.join(r, "right_id").filter("face = f2").select("face", F.col("ch").alias("l"), "r", (F.col("sheet_id") * 1000 + F.col("right_id") % 50).alias("seq"), S.clamp(F.col("width") - F.col("w2"), -32768, 32767).alias("kern"))
    return S.first_wins(j, ["face", "l", "r"], F.desc("seq")).filter("kern <> 0").select("face", "l", "r", "kern")


def read_zone(rows, prefix=""):
    """From (key, x, runs, ink) columns: gap and crossing columns, most runs, pooling ratio."""
    return rows.groupBy("sheet_id").agg(
        F.count_if(F.col("runs") == 0).alias("gap_cols"), F.count_if(F.col("runs") >= 2).alias("cross_cols"), F.max("runs").alias("max_runs"),
        (S.half_up(F.max("ink") / S.upper_median(F.col("ink")) * 100) / 100).alias("pool"),
    )


_ZONE = """, st AS (SELECT sheet_id, x, y, ink, ink AND NOT coalesce(lag(ink) OVER (PARTITION BY sheet_id, x ORDER BY y), false) AS begins FROM pixels_v),
c AS (SELECT sheet_id, x, count(*) FILTER (WHERE begins) AS runs, count(*) FILTER (WHERE ink) + 1 AS ink FROM st GROUP BY 1, 2),
z AS (SELECT sheet_id, count(*) FILTER (WHERE runs = 0) AS gap_cols, count(*) FILTER (WHERE runs >= 2) AS cross_cols, max(runs) AS max_runs, floor(max(ink) / list_sort(list(ink))[5] * 100 + 0.5) / 100 AS pool FROM c GROUP BY 1)"""


def zones(spark, d):
    w = Window.partitionBy("sheet_id", "x").orderBy("y")
    st = pixels(spark, d).withColumn("begins", F.col("ink") & ~F.coalesce(F.lag("ink").over(w), F.lit(False)))
    return read_zone(st.groupBy("sheet_id", "x").agg(F.count_if("begins").alias("runs"), (F.count_if("ink") + 1).alias("ink")))


@query(sql(_ZONE + " SELECT sheet_id, gap_cols, cross_cols, max_runs, pool FROM z", "pixels_v"))
def seam_zones(spark, d):
    return zones(spark, d)


#: Pairs whose crossings and pooling count for a vote (fixed values).
BIGRAMS = "an ne en nn mi in re er ou un th he ic ck ow wn el ll or ab cd de ef ro br fr lo oo ee aw wa na am ma ar ra av va on no wo".split()


def verdict(a, b):
    """worse, better or tie: any gap more is worse; then crossings by more than two, then pooling by more than one."""
    g, c, p = a("gap_cols") - b("gap_cols"), a("cross_cols") - b("cross_cols"), a("pool") - b("pool")
    return F.when((g > 0) | (c > 2), "worse").when(c < -2, "better").when(p > 1, "worse").when(p < -1, "better").otherwise("tie")


_V = "CASE WHEN g > 0 OR c > 2 THEN 'worse' WHEN c < -2 THEN 'better' WHEN p > 1 THEN 'worse' WHEN p < -1 THEN 'better' ELSE 'tie' END"
_SEAM = _ZONE + f""", s AS (SELECT a.sheet_id, a.sheet_id // 50 AS face, a.sheet_id // 2 AS k, a.gap_cols - b.gap_cols AS g, a.cross_cols - b.cross_cols AS c, a.pool - b.pool AS p FROM z a JOIN z b ON b.sheet_id = a.sheet_id + 1 WHERE a.sheet_id % 2 = 0),
v AS (SELECT sheet_id, face, {_CH} AS ch, substr('{ALPHABET}', CAST((k + face) % {len(ALPHABET)} AS INT) + 1, 1) AS follower, k % 4 AS form, k // 4 % 4 AS follower_form, {_V} AS verdict, g > 0 AS gap FROM s)"""


def seams(spark, d):
    """Even sheets as the joined form, the next sheet as the plain form; the pair and its join forms (0 to 3) come from the sheet number."""
    z = zones(spark, d)
    a, b = z.filter("sheet_id % 2 = 0").alias("a"), z.withColumn("sheet_id", F.col("sheet_id") - 1).alias("b")
    k, face = F.floor(F.col("sheet_id") / 2), F.floor(F.col("sheet_id") / 50)
    letter = lambda n: F.substring(F.lit(ALPHABET), (n % len(ALPHABET)).cast("int") + 1, F.lit(1))
    return a.join(b, "sheet_id").select(
        "sheet_id", face.alias("face"), letter(F.col("sheet_id")).alias("ch"), letter(k + face).alias("follower"), (k % 4).alias("form"), (F.floor(k / 4) % 4).alias("follower_form"),
        verdict(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("verdict"), (F.col("a.gap_cols") > F.col("b.gap_cols")).alias("gap"),
    )


@query(sql(_SEAM + " SELECT sheet_id, verdict FROM v", "pixels_v"))
def seam_verdict(spark, d):
    return seams(spark, d).select("sheet_id", "verdict")


_BIG = ", ".join(f"'{b}'" for b in BIGRAMS)


@query(sql(_SEAM + f""", u AS (SELECT * FROM v WHERE form IN (1, 3) QUALIFY row_number() OVER (PARTITION BY face, ch, follower ORDER BY sheet_id) = 1),
t AS (SELECT face, ch, count(*) FILTER (WHERE follower_form < 2) AS base_seams, count(*) FILTER (WHERE follower_form < 2 AND gap) AS gaps, count(*) FILTER (WHERE ch || follower IN ({_BIG}) AND verdict = 'worse') AS worse,
count(*) FILTER (WHERE ch || follower IN ({_BIG}) AND verdict = 'better') AS better FROM u GROUP BY 1, 2) SELECT face, ch, base_seams, gaps, worse, better FROM t WHERE (base_seams > 0 AND gaps * 3 >= base_seams) OR worse > better""", "pixels_v"))
def seam_drops(spark, d):
    """By face, the characters whose exit join is given up."""
    return dropped(seams(spark, d), ["face"])


def dropped(seams, keys):
    """Characters with exit joins (form 1 or 3) of which a third or more of the seams to followers without an entry join (form 2 or 3) open
    gaps, or whose common pairs are more often worse than better; a pair counts once, as it is first seen."""
    u = S.first_wins(seams.filter("form in (1, 3)"), [*keys, "ch", "follower"], F.col("sheet_id"))
    plain, common = F.col("follower_form") < 2, F.concat("ch", "follower").isin(BIGRAMS)
    t = u.groupBy(*keys, "ch").agg(
        F.count_if(plain).alias("base_seams"), F.count_if(plain & F.col("gap")).alias("gaps"),
        F.count_if(common & (F.col("verdict") == "worse")).alias("worse"), F.count_if(common & (F.col("verdict") == "better")).alias("better"),
    )
    return t.filter("(base_seams > 0 and gaps * 3 >= base_seams) or worse > better")


_AZ, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FIVE = ["ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", "abcdefghijklm", "nopqrstuvwxyz", _DIGITS]
#: Known layouts and their rows (fixed values).
LAYOUTS = [
    ("A to Z", [_AZ]), ("0 to 9", [_DIGITS]), ("A to Z and 0 to 9", [_AZ, _DIGITS]), ("A to Z and a to z", [_AZ, _AZ.lower()]), ("A to Z, a to z and 0 to 9", [_AZ, _AZ.lower(), _DIGITS]),
    ("A to Z, a to z, 0 to 9 and a row of punctuation", [_AZ, _AZ.lower(), _DIGITS, ".,!?:;'-&@#"]), ("A to Z in two rows", _FIVE[:2]), ("A to Z in two rows, then 0 to 9", [*_FIVE[:2], _DIGITS]),
    ("A to Z and a to z in four rows", _FIVE[:4]), ("A to Z, a to z and 0 to 9 in five rows", _FIVE), ("A to Z, a to z and 0 to 9 in five rows, then a row of punctuation", [*_FIVE, ".,!?:;'\"-&@#"]),
    ("A to Z, a to z and 0 to 9 in five rows, then 2 rows of symbols", [*_FIVE, "!?@#$%^&*()-_+=[]", "{};:'\",.<>/\\|"]),
]


def row_tolerance(line: str) -> tuple[int, int]:
    """A row's length and by how much a count may differ from it; rows of symbols have more room."""
    n, symbols = len(line), not any(c.isalnum() for c in line)
    return n, max(3, int(n * 0.35 + 0.5)) if symbols else max(1, int(n * 0.15 + 0.5))


def layout_drift(cells, lines):
    """Sum over the rows of the differences in units of tolerance; null if one is out of it or the numbers of rows differ."""
    off = [(F.abs(F.get(cells, F.lit(i)) - n), tol) for i, (n, tol) in enumerate(map(row_tolerance, lines))]
    fits, total = F.size(cells) == len(lines), F.lit(0.0)
    for x, tol in off:
        fits, total = fits & (x <= tol), total + x / tol
    return F.when(fits, F.round(total, 9))


def best_layout(cells):
    """(d, n): drift and name of the layout that fits best; no name if two fit alike, null if none fits."""
    fit = F.array_sort(F.filter(F.array(*[F.struct(layout_drift(cells, lines).alias("d"), F.lit(n).alias("n")) for n, lines in LAYOUTS]), lambda x: x["d"].isNotNull()))
    first, second = F.get(fit, F.lit(0)), F.get(fit, F.lit(1))
    return F.struct(first["d"].alias("d"), F.when(second["d"].isNull() | (second["d"] > first["d"]), first["n"]).alias("n"))


def sheet_cells(spark, d, cells):
    """An order as a sheet, its lines as rows: the number of cells in each."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("i"), cells.cast("long").alias("c"))
    return li.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("cells"))


_ROWS = ", ".join(f"({k}, '{name}', {len(lines)}, {i + 1}, {n}, {tol})" for k, (name, lines) in enumerate(LAYOUTS) for i, (n, tol) in enumerate(map(row_tolerance, lines)))


@query(f"""WITH o AS (SELECT l_orderkey AS sheet, CAST(l_quantity AS BIGINT) AS cells, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n_rows FROM lineitem),
l AS (SELECT * FROM (VALUES {_ROWS}) t(k, name, n_rows, pos, n, tol)),
x AS (SELECT sheet, name, round(sum(abs(cells - n) / tol), 9) AS drift FROM o JOIN l USING (n_rows, pos) GROUP BY sheet, name HAVING bool_and(abs(cells - n) <= tol)),
b AS (SELECT sheet, min(name) AS name, min(drift) AS drift, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY sheet ORDER BY drift) AS rk FROM x) WHERE rk = 1 GROUP BY sheet)
SELECT s.sheet, CASE WHEN n = 1 THEN name END AS layout, round(drift, 6) AS drift FROM (SELECT DISTINCT sheet FROM o) s LEFT JOIN b USING (sheet)""")
def layout_match(spark, d):
    """Every sheet's counts against the known layouts, row by row."""
    t = sheet_cells(spark, d, F.col("l_quantity"))
    return t.select("sheet", best_layout(F.col("cells")).alias("b")).select("sheet", F.col("b.n").alias("layout"), F.round("b.d", 6).alias("drift"))


@query(sql(_PROF + """, base AS (SELECT face, ch, min(sheet_id) AS sheet_id FROM prof WHERE sheet_id % 2 = 0 GROUP BY 1, 2), more AS (SELECT face, ch, min(sheet_id) AS sheet_id FROM prof WHERE sheet_id % 2 = 1 GROUP BY 1, 2)
SELECT face, ch, sheet_id, '' AS suffix FROM base UNION ALL SELECT m.face, m.ch, m.sheet_id, 'alt' FROM more m WHERE EXISTS (SELECT 1 FROM base b WHERE b.face = m.face AND b.ch = m.ch)""", "pixels_v"))
def variant_union(spark, d):
    """Base glyphs and the variants whose character the base has."""
    p = profiles(spark, d)
    of = lambda odd: p.filter(F.col("sheet_id") % 2 == odd).groupBy("face", "ch").agg(F.min("sheet_id").alias("sheet_id"))
    base, more = of(0), of(1)
    return base.withColumn("suffix", F.lit("")).unionByName(more.join(base, ["face", "ch"], "left_semi").withColumn("suffix", F.lit("alt")))


@query(sql(_PROF + """, base AS (SELECT face, ch, min(sheet_id) AS sheet_id FROM prof WHERE sheet_id % 3 = 0 GROUP BY 1, 2), more AS (SELECT face, ch, min(sheet_id) AS sheet_id FROM prof WHERE sheet_id % 3 <> 0 GROUP BY 1, 2)
SELECT face, ch, sheet_id FROM base UNION ALL SELECT m.face, m.ch, m.sheet_id FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.face = m.face AND b.ch = m.ch)""", "pixels_v"))
def supplement_anti(spark, d):
    """Base glyphs (every third sheet) and, of all others as supplement, the first of each character that the base lacks."""
    p = profiles(spark, d)
    base = p.filter("sheet_id % 3 = 0").groupBy("face", "ch").agg(F.min("sheet_id").alias("sheet_id"))
    more = S.first_wins(p.filter("sheet_id % 3 <> 0").select("face", "ch", "sheet_id"), ["face", "ch"], F.col("sheet_id"))
    return base.unionByName(more.join(base, ["face", "ch"], "left_anti"))


def short_rows(cells):
    """Consecutive capitals for a narrow grid (or both cases for 52 cells), one line per row, further cells unassigned; null where nothing is clear."""
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c)
    every = lambda n: F.forall(cells, lambda c: c == n)
    clear = (F.size(cells) > 0) & F.forall(cells, lambda c: c.between(1, 26)) & (F.forall(cells, lambda c: c < 10) | total.isin(26, 52)) & ~every(13) & ~every(26)
    line = F.rpad(F.when(total == 52, _AZ + _AZ.lower()).otherwise(_AZ), total.cast("int"), "□")
    start = lambda i: F.aggregate(F.slice(cells, F.lit(1), i), F.lit(0).cast("long"), lambda a, c: a + c)
    return F.when(clear, F.array_join(F.transform(cells, lambda c, i: F.substring(line, (start(i) + 1).cast("int"), c.cast("int"))), "\n"))


@query(f"""WITH o AS (SELECT l_orderkey AS sheet, list(CAST(ceil(l_quantity / 5) AS BIGINT) ORDER BY l_linenumber, CAST(ceil(l_quantity / 5) AS BIGINT)) AS cells FROM lineitem GROUP BY 1),
t AS (SELECT sheet, cells, list_sum(cells) AS total, rpad(CASE WHEN list_sum(cells) = 52 THEN '{_AZ + _AZ.lower()}' ELSE '{_AZ}' END, CAST(list_sum(cells) AS INT), '□') AS line FROM o)
SELECT sheet, CASE WHEN list_min(cells) >= 1 AND list_max(cells) <= 26 AND (list_max(cells) < 10 OR total IN (26, 52)) AND NOT (list_min(cells) = list_max(cells) AND list_max(cells) IN (13, 26))
THEN array_to_string(list_transform(cells, lambda c, i: substr(line, CAST(coalesce(list_sum(cells[1:i - 1]), 0) AS BIGINT) + 1, c)), chr(10)) END AS charset FROM t""")
def short_row_charset(spark, d):
    return sheet_cells(spark, d, F.ceil(F.col("l_quantity") / 5)).select("sheet", short_rows(F.col("cells")).alias("charset"))


@query(sql(""", b AS (SELECT sheet_id, y, ink, ink AND NOT coalesce(lag(ink) OVER (PARTITION BY sheet_id, y ORDER BY x), false) AS begins, x FROM pixels_v),
r AS (SELECT sheet_id, y, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id, y ORDER BY x) AS run FROM b WHERE ink), l AS (SELECT sheet_id // 50 AS face, count(*) AS n FROM r GROUP BY sheet_id, y, run)
SELECT face, count(*) AS runs, list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_run, CASE WHEN count(*) >= 20 AND list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] / 8.0 < 0.2 THEN 1 ELSE 0 END::BIGINT AS lift FROM l GROUP BY face""", "pixels_v"))
def stroke_floor(spark, d):
    w = Window.partitionBy("sheet_id", "y").orderBy("x")
    b = pixels(spark, d).withColumn("begins", (F.col("ink") & ~F.coalesce(F.lag("ink").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(w)).filter("ink")
    l = b.groupBy("sheet_id", "y", "run").agg(F.count(F.lit(1)).alias("n"))
    g = l.groupBy(F.floor(F.col("sheet_id") / 50).alias("face")).agg(F.count(F.lit(1)).alias("runs"), S.upper_median(F.col("n")).alias("median_run"))
    return g.withColumn("lift", F.when((F.col("runs") >= 20) & (F.col("median_run") / 8.0 < 0.2), 1).otherwise(0).cast("long"))


@query(sql(""", e AS (SELECT sheet_id, x, y, ink, ink AND NOT coalesce(lag(ink) OVER (PARTITION BY sheet_id, y ORDER BY x), false) AS b, ink AND NOT coalesce(lead(ink) OVER (PARTITION BY sheet_id, y ORDER BY x), false) AS z FROM pixels_v)
SELECT sheet_id, CAST(sum(CASE WHEN z THEN (x + 1) ELSE 0 END) - sum(CASE WHEN b THEN x ELSE 0 END) AS BIGINT) AS area FROM e GROUP BY sheet_id""", "pixels_v"))
def signed_area(spark, d):
    """Area of the outline by its vertical edges (the shoelace sum over pixel runs)."""
    w = Window.partitionBy("sheet_id", "y").orderBy("x")
    e = pixels(spark, d).withColumn("b", F.col("ink") & ~F.coalesce(F.lag("ink").over(w), F.lit(False))).withColumn("z", F.col("ink") & ~F.coalesce(F.lead("ink").over(w), F.lit(False)))
    return e.groupBy("sheet_id").agg((F.sum(F.when(F.col("z"), F.col("x") + 1).otherwise(0)) - F.sum(F.when(F.col("b"), F.col("x")).otherwise(0))).alias("area"))


def merge_bands(bands: list[tuple[int, int]], height: float, most: int = 5) -> list[tuple[int, int]]:
    """Groups of at most ``most`` bands, one of which is a body and the rest small and near, at least cost; else unchanged."""
    n = len(bands)
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * n
    for stop in range(1, n + 1):
        for start in range(max(0, stop - most), stop):
            group = bands[start:stop]
            sizes = sorted(b - a for a, b in group)
            gaps = [q[0] - p[1] for p, q in zip(group, group[1:])]
            if best[start] is None or any(s > 0.55 * height for s in sizes[:-1]) or sizes[-1] <= 0.55 * height or any(g > 0.65 * height for g in gaps):
                continue
            cost = best[start][0] + sum(g / height + 0.1 for g in gaps)
            if best[stop] is None or cost < best[stop][0]:
                best[stop] = (cost, start)
    if best[n] is None:
        return bands
    out, stop = [], n
    while stop:
        start = best[stop][1]
        out.append((bands[start][0], bands[stop - 1][1]))
        stop = start
    return out[::-1]


@query()
def band_merge_dp(spark, d):
    """Row bands of each sheet merged into bodies with their marks; a sheet at a time, by dynamic programming."""
    from .raster import row_runs

    ship(spark)
    bands = row_runs(spark, d).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("bands"))

    def run(it):
        for pdf in it:
            rows = [(s, k, a, b) for s, bs in zip(pdf["sheet_id"], pdf["bands"]) for k, (a, b) in enumerate(merge_bands([(int(x["start"]), int(x["stop"])) for x in bs], max(int(x["stop"]) - int(x["start"]) for x in bs)))]
            yield pd.DataFrame(rows, columns=["sheet_id", "band", "start", "stop"])

    return bands.mapInPandas(run, "sheet_id long, band long, start long, stop long")
