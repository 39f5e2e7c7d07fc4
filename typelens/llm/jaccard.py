"""Near copies by the exact Jaccard similarity of sets of five-word shingles: two texts are linked if it is 0.8 or more.

Search by SimHash first: fingerprints that differ in three bits or fewer (``simhash.near_links``) propose links, which the sets
confirm or not.  Links between texts further apart in their fingerprints are then found by prefix filtering, among sets that
SimHash has not connected.

Prefix filtering: all shingles stand in one order (common ones last, then by hash).  Sets with a similarity of
4 / 5 share a shingle among the first n - ceil(4 n / 5) + 1 of each, so every linked pair meets in the bucket of such a
shingle, and at the first one they share, what follows in both is long enough for the overlap needed.  Which shingles are
common is learnt from a sample of the texts; it decides the size of buckets, not the result.  Pairs of a bucket are
compared exactly, by the sets of the candidates alone; pairs that even parities of their sets, four to eight for a shingle,
tell apart (two sets differ in at least as many shingles as parities) are left out before.  A bucket of more than ``cap`` sets gives at first the pairs with a
few of its members only; then the pairs whose members these links have not yet connected.  So no link between
components is lost.

Shingles are told apart by 64-bit hashes.  Equal sets are one node; a text with no words has the empty set, equal only
to another; a text with fewer words than a shingle has one shingle, the whole sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batches, mapped, row_hash, settle, with_maps
from .components import components

PIVOTS = 4
#: So many texts at most are picked (or dropped) by a broadcast list of their ids; more of them by a join of two shuffles.
BROADCAST = 500_000
HELD = 500_000
#: Pairs of sets that a task compares.
COMPARED = 2_000
PAIRS = "a long, b long, token long, n int, pos int"


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    from xxhash import xxh3_64_intdigest as h

    w = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    return np.array(sorted({h(b" ".join(w[k : k + words])) for k in range(max(len(w) - words + 1, 1 if w else 0))}), np.uint64)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set (sorted) by which it is searched, common ones last."""
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        hot = common[at] == own
        own = np.concatenate([own[~hot], own[hot]])
    return own[: len(own) - (4 * len(own) + 4) // 5 + 1]


def parities(own: np.ndarray) -> bytes:
    """Of 2**k parts of all shingles, four or more for each in the set, whether the set holds an odd number."""
    parts = 1 << min(max((4 * len(own)).bit_length(), 8), 17)
    return np.packbits(np.bincount((own & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).tobytes()


def parities_apart(x: bytes, y: bytes) -> int:
    """How many parities differ; the finer ones are folded to the coarser."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def _pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, run: np.ndarray, up: np.ndarray | None = None) -> np.ndarray:
    """Pairs inside runs (rows ascend by run and n) that can be linked and meet at their first common shingle."""
    out, at, k = [np.zeros((0, 2), np.int64)], np.arange(len(node)), 1
    while len(at := at[at + k < len(node)]) and len(at := at[(run[at] == run[at + k]) & (5 * n[at] >= 4 * n[at + k])]):
        x, y = at, at + k
        ok = (node[x] != node[y]) & (9 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= 4 * (n[x] + n[y]))
        if up is not None:
            ok &= up[x] != up[y]
        x, y = x[ok], y[ok]
        out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1))
        k += 1
    return np.unique(np.concatenate(out), axis=0)


def _buckets(it, width: int):
    """Columns as arrays, whole buckets (equal first columns) at a time."""
    held = [np.zeros(0, np.int64)] * width
    for b in it:
        now = [np.concatenate([x, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for x, c in zip(held, b.columns)]
        if len(now[0]):
            cut = int(np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))[-1])
            if cut:
                yield [x[:cut] for x in now]
            held = [x[cut:] for x in now]
    if len(held[0]):
        yield held


def _candidates(rows: DataFrame, cap: int) -> DataFrame:
    """rows (token, node, n, pos, up) -> pairs (a, b) of different ``up``; members of larger buckets have a null b and are given back."""

    def made(a, b, *rest):
        cols = [pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)]
        rest = [pa.array(x.astype(t)) for x, t in zip(rest, (np.int64, np.int32, np.int32))] or [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([*cols, *rest], ["a", "b", "token", "n", "pos"])

    def run(it):
        waiting, held = [], 0  # a pair meets in many buckets: it is given out once for about ``HELD`` of them

        def given():
            pairs = np.unique(np.concatenate(waiting), axis=0)
            waiting.clear()
            return made(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

        for token, node, n, pos, up in _buckets(it, 5):
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(starts, len(token)))
            bucket, large = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes > cap, sizes)
            small = ~large & np.repeat(sizes > 1, sizes)
            found = [_pairs(node[small], n[small], pos[small], bucket[small], up[small])]
            for s, e in zip(starts[sizes > cap].tolist(), (starts + sizes)[sizes > cap].tolist()):
                for p in (s + np.lexsort((node[s:e], pos[s:e]))[:PIVOTS]).tolist():
                    ok = (5 * n[s:e] >= 4 * n[p]) & (4 * n[s:e] <= 5 * n[p]) & (up[s:e] != up[p])
                    found.append(np.stack([np.minimum(node[s:e][ok], node[p]), np.maximum(node[s:e][ok], node[p])], 1))
            waiting.append(np.unique(np.concatenate(found), axis=0))
            held += len(waiting[-1])
            if held > HELD:
                yield given()
                held = 0
            if large.any():
                yield made(node[large], None, token[large], n[large], pos[large])
        if held:
            yield given()

    return settle(mapped(rows.repartition("token").sortWithinPartitions("token", "n", "node"), run, PAIRS))


def _unconnected(rows: DataFrame) -> DataFrame:
    """rows (token, node, n, pos, up) of large buckets -> pairs (a, b) of different ``up``."""

    def run(it):
        for token, node, n, pos, up in _buckets(it, 5):
            pairs = _pairs(node, n, pos, np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])), up)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    return mapped(rows.repartition("token").sortWithinPartitions("token", "n", "node"), run, "a long, b long")


def _linked(pairs: DataFrame, nodes: DataFrame, sets_of) -> DataFrame:
    """Those of the pairs (a, b), which are settled, whose sets have a similarity of 4 / 5 or more.

    nodes (node, n, bits) has sizes and parities; sets_of gives (node, own) of some nodes, so many at most.
    """
    most = pairs.count()
    end = lambda k, *names: nodes.select(F.col("node").alias(k), *[F.col(c).alias(x) for c, x in zip(("n", "bits"), names)])
    known = pairs.distinct().join(end("a", "m", "x"), "a").join(end("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")

    def possible(it):
        for b in it:
            if b.num_rows:
                differ = np.array([parities_apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())])
                sizes = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(3).to_numpy(zero_copy_only=False)
                yield b.select(["a", "b"]).filter(pa.array(9 * differ <= sizes))

    pairs = settle(mapped(known, possible, "a long, b long"), most)
    most = pairs.count()
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * most)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return settle(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), most, COMPARED)


def near_roots(docs: DataFrame, words: int = 5, cap: int = 64, one_in: int = 16, often: int = 8, most: int = 200_000, distance: int = 3) -> tuple[DataFrame, int]:
    """docs (doc_id, text, _tl_row) -> (doc_id, _tl_row, root) and the number of rows: those with one root are connected by links."""

    def sampled(it):
        for b in batches(it):
            own = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["token"])

    some = mapped(docs.filter(F.pmod("_tl_row", F.lit(one_in)) == 0), sampled, "token long").groupBy("token").count().filter(F.col("count") >= often)
    common = np.sort(np.array([r["token"] for r in some.orderBy(F.desc("count"), "token").limit(most).collect()], np.int64).view(np.uint64))  # ``most`` at most

    def sketched(it):
        from xxhash import xxh3_64_intdigest

        for b in batches(it):
            own = [shingles(t, words) for t in b.column(1).to_pylist()]
            node = np.array([xxh3_64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
            n = np.array([len(x) for x in own], np.int32)
            bits = pa.array([parities(x) for x in own], pa.binary())
            fp = np.array([simhash.simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node), pa.array(n), bits, pa.array(fp)], ["doc_id", "_tl_row", "node", "n", "bits", "fp"])

    def searched(it):
        from xxhash import xxh3_64_intdigest

        for b in batches(it):
            own = [shingles(t, words) for t in b.column(0).to_pylist()]
            node = np.array([xxh3_64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([len(x) for x in own], pa.int32()), _lists([prefix(x, common) for x in own])], ["node", "n", "first"])

    fps = settle(mapped(docs, sketched, "doc_id long, _tl_row long, node long, n int, bits binary, fp long"))
    nodes, n_rows = fps.select("node", "n", "bits").dropDuplicates(["node"]), fps.count()
    # the texts are read again for the prefixes, so that these are not stored between
    rows = mapped(docs.select("text"), searched, "node long, n int, first array<long>").dropDuplicates(["node"])

    def own_sets(it):
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t, words) for t in b.column(1).to_pylist()])], ["node", "own"])

    def sets_of(some: DataFrame, most: int) -> DataFrame:
        one = fps.join(some, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_tl_row", "doc_id")).alias("k")).select("node", F.col("k._tl_row").alias("_r"), F.col("k.doc_id").alias("_d"))
        one = settle(one, most)
        if one.count() <= BROADCAST:
            one = F.broadcast(one)
        text = docs.join(one, (F.col("_tl_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("node", "text")
        return mapped(text, own_sets, "node long, own array<long>").dropDuplicates(["node"])

    # first by SimHash: fingerprints within the distance, each link checked by the sets
    none = F.lit(0).cast("long")
    prints = fps.groupBy("node").agg(F.min("fp").alias("fp")).select("node", "fp", none.alias("v1"), none.alias("v2"))
    close = simhash.near_links(settle(prints, n_rows), distance).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _linked(close.filter("a <> b"), nodes, sets_of)
    # then, of sets that are not connected by that, those further apart in their fingerprints
    rows = rows.join(components(links), "node", "left").select(F.posexplode("first").alias("pos", "token"), "node", "n", F.coalesce("root", "node").alias("up"))
    found = _candidates(rows.select("token", "node", "n", "pos", "up"), cap)
    links = links.unionByName(_linked(found.filter("b is not null").select("a", "b"), nodes, sets_of))
    roots = components(links)
    large = found.filter("b is null").select("token", F.col("a").alias("node"), "n", "pos")
    if n_large := large.count():
        placed = large.join(roots, "node", "left").select("token", "node", "n", "pos", F.coalesce("root", "node").alias("up"))
        more = _linked(settle(_unconnected(placed), n_large), nodes, sets_of)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return fps.select("doc_id", "_tl_row", "node").join(roots, "node", "left").select("doc_id", "_tl_row", F.coalesce("root", "node").alias("root")), n_rows


def keep_one_of_near(docs: DataFrame, **settings) -> DataFrame:
    """The documents, all columns, without near copies: of each group of linked ones that with the smallest doc_id stays.

    Null texts count as empty, and empty texts are one group; a null doc_id is the largest; of rows that repeat a doc_id the
    one with the smallest hash of all its columns stays, of rows that are equal in all columns one; columns may have any names.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.select(F.struct(*every).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_hash(docs).alias("_tl_row"))
    roots, n_rows = near_roots(tagged.select("doc_id", "text", "_tl_row"), **settings)
    same = roots.groupBy("root", "doc_id", "_tl_row").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tl_row"))).alias("rank"))
    least = same.groupBy("root").agg(F.min("rank").alias("least"))
    judged = same.join(least, "root").select(F.col("doc_id").alias("_d"), F.col("_tl_row").alias("_r"), "copies", F.col("rank").eqNullSafe(F.col("least")).alias("stays"))
    judged = settle(judged, n_rows)
    gone, again = judged.filter("not stays or copies > 1").select("_d", "_r"), judged.filter("stays and copies > 1").select("_d", "_r")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST else df
    on = (F.col("_tl_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    kept = tagged.join(few(gone), on, "left_anti").select("row.*")
    if again.isEmpty():
        return kept
    twice = tagged.join(few(again), on, "left_semi")
    one = twice.dropDuplicates(["doc_id", "_tl_row"]).select("row.*") if with_maps(docs) else twice.select("row.*").dropDuplicates()
    return kept.unionByName(one)
