"""Prefix trie of conversations: a node for each distinct sequence of first turns, with sums over its subtree.

1. Turns become digests of 128 bits (SHA-256 of role and text) and byte counts, so that no text is shuffled.  They are
   numbered by one range partitioning over (conversation, turn): numbers inside a partition, and offsets for the few
   conversations that reach over a partition's border.  A conversation of any length is spread over tasks.
2. The key of a prefix is the running exclusive-or of hashes of (depth, digest), two lanes of 64 bits.  A node's members are
   checked to have one parent key, depth and digest, from which follows, level by level, that their prefixes are equal.
3. Nodes of a single member need no trie: below the last shared node they form one chain.  Shared nodes are decomposed into
   heavy paths: the child with most members (ties: the smallest key) carries its parent's path on, each other child begins
   one.  A light child has at most half of its parent's members, so a path lies under at most log2(members) others.  Path and
   level are read off each conversation's own chain, by running aggregates.
4. Level by level from the lowest: what light children and single chains give is added to the node that they hang on, sums
   run from the foot of each path to its head, and heads hand them on.

Running aggregates work in blocks of BLOCK depths with a carry from block to block, so that no group is longer; joins on a
node's key meet one row of the node, and adaptive execution splits their other side where it is skewed.

Defined results: null roles and texts are empty; turns are ordered by number, null first, rows of one number by their
digest; rows of a null conv_id belong to no conversation and are left out; repeated rows are turns like others; an empty table has no
node, not even the root; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, scratch, settle, table

BLOCK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digested(convs: DataFrame) -> DataFrame:
    """conv_id, turn, digest, bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return convs.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )


def numbered(convs: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, bytes: places by turn, null first, then digest."""
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    rows = digested(convs).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"))

    def count(it):
        last, n = None, 0  # the conversation that the batch before ended in, and its rows so far
        for b in it:
            conv = b.column(0).to_numpy()
            if len(conv):
                first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
                place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
                if conv[0] == last:
                    place[: first[1] if len(first) > 1 else None] += n
                last, n = conv[-1], int(place[-1]) + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], ["conv_id", "digest", "bytes", "part", "place"])

    rows = settle(mapped(rows, count, "conv_id long, digest binary, bytes long, part int, place long"))
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("conv_id").orderBy("part")
    # a row for each border that a conversation reaches over: at most one a partition, so it may be broadcast
    over = parts.withColumn("shift", F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, -1))).filter("shift > 0").select("conv_id", "part", "shift")
    place = F.col("place") + F.coalesce("shift", F.lit(0))
    return rows.join(F.broadcast(over), ["conv_id", "part"], "left").select("conv_id", place.alias("place"), "digest", "bytes")


def sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth from 1, digest, bytes) of conversations that begin as the first of their five, and their lengths (conv_id, n).

    The first h turns of conversation c - c % 5, and then c's own behind its first h; h is crc32(c) % 9.
    """
    turns = settle(numbered(convs))
    own = settle(sizes(turns).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")))
    held = F.least("h", F.coalesce(F.col("m"), F.lit(0)))
    own = own.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left").withColumn("held", held)
    own = settle(own.select("conv_id", "n", "base", "h", "held"))
    heads = turns.filter("conv_id % 5 = 0 and place < 8").withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "h"), "base").filter("place < h")
    heads = heads.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    # a row of a conversation for each block of its turns
    blocks = own.select("conv_id", "h", "held", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}"))).alias("block"))
    rest = turns.withColumn("block", F.expr(f"place div {BLOCK}")).join(blocks, ["conv_id", "block"]).filter("place >= h")
    rest = rest.select("conv_id", (F.col("held") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    return heads.unionByName(rest), own.select("conv_id", (F.col("held") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def running(rows: DataFrame, keys: list[str], at: str, sums: dict[str, tuple[Callable, Callable, Column]], strict: bool = False) -> DataFrame:
    """rows with running aggregates along ``at`` (longs, distinct in a key), each up to its row or, if strict, before it (null for none).

    ``sums`` has, per new column, an associative aggregate, the same as a function of two columns, and what goes into it; nulls are left out.
    """
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    within = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    above = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_block").agg(*[f(c).alias(f"_{n}") for n, (f, _, c) in sums.items()])
    carry = carry.select(*keys, "_block", *[f(F.col(f"_{n}")).over(above).alias(f"_{n}") for n, (f, _, _) in sums.items()])
    out = rows.withColumns({n: f(c).over(within) for n, (f, _, c) in sums.items()}).join(carry, [*keys, "_block"])
    total = lambda n, two: F.coalesce(two(F.col(n), F.col(f"_{n}")), F.col(n), F.col(f"_{n}"))
    return out.withColumns({n: total(n, two) for n, (_, two, _) in sums.items()}).drop("_block", *[f"_{n}" for n in sums])


XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
SUM = (F.sum, lambda a, b: a + b)
MAX = (F.max, lambda a, b: F.greatest(a, b))


def keyed(turns: DataFrame) -> DataFrame:
    """Turns with the key of the prefix that they end (k1, k2) and of the one before (p1, p2; 0, 0 at the root)."""
    lanes = {"k1": F.xxhash64("depth", "digest"), "k2": F.xxhash64(F.lit("second lane"), "digest", "depth")}
    rows = running(turns, ["conv_id"], "depth", {k: (*XOR, c) for k, c in lanes.items()})
    return rows.withColumns({f"p{k[1]}": F.col(k).bitwiseXOR(c) for k, c in lanes.items()})


def one(column: str) -> Column:
    """The only value of a column in a group; an error if two prefixes fell on one key."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.raise_error(F.lit(f"prefixes of one key differ in {column}")))


def shared_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of two members and more, but for the root: key, parent's key, conv_id, depth, n, bytes."""
    facts = [one(c).alias(c) for c in ("p1", "p2", "depth", "bytes")]
    checked = [F.min("digest").alias("d0"), F.max("digest").alias("d1")]
    nodes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), *facts, *checked)
    same = F.when(F.col("d0") == F.col("d1"), F.col("n")).otherwise(F.raise_error(F.lit("prefixes of one key differ in digest")))
    return nodes.withColumn("n", same).filter("n > 1").drop("d0", "d1")


def list_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, conv_id) -> k1, k2, ends_sha256: the digest of each key's ids in ascending order, joined by commas.

    Ids are joined in ranges of 4096, and the ranges of a key go through one digest as a stream: nothing is collected.
    """
    ranges = ends.groupBy(*KEY, F.shiftright("conv_id", 12).alias("at")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ranges = ranges.repartition(*KEY).sortWithinPartitions(*KEY, "at").select(*KEY, "ids")

    def run(it):
        key, h = None, None
        for b in it:
            out = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), x)) for x in out], schema)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), (*key, h.hexdigest())))], schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return mapped(ranges, run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns (conv_id, depth from 1, digest, bytes) and the lengths of all conversations (conv_id, n), those without turns too -> the nodes.

    Per node: its key (k1, k2; 0, 0 for the root), heavy path (head1, head2: the key of its head) and level (paths above it), null for
    nodes of one member, and COLUMNS.
    """
    spark = turns.sparkSession
    rows = settle(keyed(turns))
    nodes = settle(shared_nodes(rows))
    heavy = nodes.groupBy("p1", "p2").agg(F.max_by(F.struct(*KEY), F.struct("n", *KEY)).alias("k")).select("k.*", F.lit(False).alias("light"))
    nodes = nodes.join(heavy, KEY, "left").withColumn("light", F.coalesce("light", F.lit(True)))
    everyone = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n > 0")

    # every conversation's chain, with what it has of shared nodes
    chain = rows.select("conv_id", "depth", *KEY).join(nodes.select(*KEY, F.col("conv_id").alias("rep"), "light", F.lit(True).alias("shared")), KEY, "left")
    chain = chain.join(convs.withColumnRenamed("n", "length"), "conv_id").withColumn("last", F.col("depth") == F.col("length")).drop("length")
    begun = F.when(F.col("light"), F.struct("depth", *KEY))
    chain = running(chain, ["conv_id"], "depth", {"head": (*MAX, begun), "level": (*SUM, F.col("light").cast("long"))})
    chain = settle(running(chain, ["conv_id"], "depth", {"up": (*MAX, F.when(F.col("shared"), F.struct("depth", "rep", *KEY)))}, strict=True))
    paths = chain.filter("shared and conv_id = rep").select(
        *KEY, F.coalesce("head.k1", F.lit(0)).alias("head1"), F.coalesce("head.k2", F.lit(0)).alias("head2"), F.coalesce("level", F.lit(0)).alias("level"), F.col("up.rep").alias("up")
    )
    single = chain.filter("shared is null").select("conv_id", "depth", *KEY, "last", "up", (F.col("depth") == F.coalesce("up.depth", F.lit(0)) + 1).alias("first"))

    # what hangs on each shared node, or on the root, without being one
    foot = lambda k: F.coalesce(f"up.{k}", F.lit(0)).alias(k)
    loose = single.filter("first").groupBy(foot("k1"), foot("k2")).agg(F.count(F.lit(1)).alias("loose"))
    below = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("below"))
    root = everyone.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "n", "conv_id", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"))
    at_root = F.col("depth") == 0
    full = root.unionByName(nodes.drop("light")).join(paths, KEY, "left").join(loose, KEY, "left").join(below, KEY, "left")
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("loose", "below")} | {c: F.when(at_root, F.lit(0)).otherwise(F.col(c)) for c in ("head1", "head2", "level")})
    full = full.withColumn("n_children", F.col("loose") + F.col("below")).withColumn("leaves", F.col("loose") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes"))
    full.write.partitionBy("level").parquet(path := scratch(spark, "trie"))
    full = spark.read.schema(full.schema).parquet(path)

    deepest = full.agg(F.max("level")).first()[0]
    summed, handed = [], None
    for level in range(deepest or 0, -1, -1) if deepest is not None else ():
        now = full.filter(F.col("level") == level)
        if handed is not None:
            now = now.join(handed, KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in ("leaves", "saved")}).drop("leaves_", "saved_")
        now = running(now.withColumn("foot", -F.col("depth")), ["head1", "head2"], "foot", {"n_leaves": (*SUM, F.col("leaves")), "saved_tokens": (*SUM, F.col("saved"))})
        now = settle(now)
        summed.append(now)
        heads = now.filter("k1 = head1 and k2 = head2 and depth > 0")
        handed = heads.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("leaves_"), F.sum("saved_tokens").alias("saved_"))

    ends = chain.filter("shared and last").select(*KEY, "conv_id").unionByName(convs.filter("n = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    least = everyone.select(F.col("conv_id").alias("least"))
    alone = single.select(
        *KEY, F.lit(None).cast("long").alias("head1"), F.lit(None).cast("long").alias("head2"), F.lit(None).cast("long").alias("level"), "conv_id", "depth",
        F.when(~F.col("first"), F.col("conv_id")).otherwise(F.col("up.rep")).alias("up"), F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    if not summed:
        return alone.withColumn("parent_conv_id", F.col("up")).select(*KEY, "head1", "head2", "level", *COLUMNS)
    many = summed[0]
    for other in summed[1:]:
        many = many.unionByName(other)
    many = many.join(list_digests(ends), KEY, "left").select(
        *KEY, "head1", "head2", "level", "conv_id", "depth", "up", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )
    out = many.unionByName(alone).crossJoin(F.broadcast(least))  # one row
    return out.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("up", "least"))).select(*KEY, "head1", "head2", "level", *COLUMNS)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations"))).select(*COLUMNS)


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS ts FROM t GROUP BY conv_id),
crc_0 AS (SELECT i, list_reduce(range(0, 9), lambda a, k: CASE WHEN k = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM (SELECT unnest(range(0, 256)) AS i)),
crc_1 AS (SELECT list(v ORDER BY i) AS tab FROM crc_0),
h AS (SELECT conv_id, ts, (xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(conv_id AS VARCHAR), k, 1)) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9)::BIGINT AS h FROM l, crc_1),
c AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS k FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM c)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
f AS (SELECT nodes.*, coalesce(kids.n, 0) AS kids FROM nodes LEFT JOIN kids USING (k)),
up AS (SELECT k[1:a] AS k, sum((kids = 0)::BIGINT) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * octet_length(encode(k[d].t)) ELSE 0 END) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN up ON up.k = f.k LEFT JOIN nodes p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
"""
