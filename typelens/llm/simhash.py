"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Search by the generalised pigeonhole principle.  The 64 bits are grouped into m parts, correlated bits together
(co-occurrence counts of all fingerprints); with part thresholds t_1 .. t_m that add up to ``distance - m + 1``
(-1 leaves a part out), any two fingerprints within the distance agree on some part i up to t_i bits.  A dynamic
programme chooses m and the thresholds that make the fewest estimated candidates: measured numbers of equal part
values, carried to larger thresholds by the distribution of differing bits.  Every fingerprint is then put under its own
part values and under those within t_i bits; buckets are verified by XOR and bit count.

Equal fingerprints are one node before the search.  A bucket of more than ``cap`` nodes is not compared pairwise: its
bits outside the part are cut into ``distance + 1`` further pieces, of which two linked nodes share one, and its nodes
go to the finer buckets in the next pass, again and again until few free bits are left.  From a bucket only a spanning
forest of its links leaves.  So no pass compares all pairs of a large group, and no link between components is lost.

Defined results: a null text is an empty one; an empty text (no words) has fingerprint zero and is linked like any
other; a text with fewer words than a shingle has one shingle, the whole sequence; a null doc_id never is a component's
id unless it has no other; repeated doc_ids are separate rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mapped, settle, table, texts
from .components import components

SEED = 42
STEP = 1 << 16
NODE = ["node", "fp", "v1", "v2"]


def simhash(text: str, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest as h

    w = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        hashes = np.array([h(b" ".join(w), SEED)], np.uint64)
    else:
        joined = b" ".join(w)
        ends = list(itertools.accumulate(map(len, w), lambda x, y: x + y + 1))
        starts = [0, *[e + 1 for e in ends[: len(w) - words]]]
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[k : k + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(it):
        for b in batches(it):
            fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return mapped(texts(docs), run, "doc_id long, fp long")


# -- statistics and plan ------------------------------------------------------------------------------------------


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """64 x 64 numbers of nodes with both bits set, over all nodes."""

    def run(it):
        total = np.zeros((64, 64), np.int64)
        for b in it:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fp), STEP):
                x = np.unpackbits(fp[k : k + STEP].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], ["i", "n"])

    out = np.zeros(4096, np.int64)
    for r in mapped(nodes.select("fp"), run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        out[r["i"]] = r["n"]
    return out.reshape(64, 64)


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m parts of nearly equal width, each filled with the bits most correlated to it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, parts = list(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        part = [free.pop(int(np.argmax([corr[b, free].sum() for b in free])))]
        while len(part) < width:
            part.append(free.pop(int(np.argmax([corr[b, part].sum() for b in free]))))
        parts.append(sorted(part))
    return parts


def within(p_differs: np.ndarray) -> np.ndarray:
    """Probability of at most 0, 1, 2 .. differing bits, bits taken as independent."""
    d = np.array([1.0])
    for x in p_differs:
        d = np.append(d, 0) * (1 - x) + np.append(0, d) * x
    return np.cumsum(d)


def allocate(candidates: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1 .. distance) that add up to distance - m + 1 with the smallest sum of candidates[i][t + 1]."""
    best = {0: (0.0, [])}
    for row in candidates:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                new = (cost + row[t + 1], [*chosen, t])
                if used + t + 1 not in step or new[0] < step[used + t + 1][0]:
                    step[used + t + 1] = new
        best = step
    return best[distance + 1]  # the sum of (t + 1) is distance + 1


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def plan(nodes: DataFrame, distance: int, choices=(2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds for these nodes."""
    n = nodes.count()
    both = bit_counts(nodes)
    p = np.diag(both) / max(n, 1)
    layouts = [correlated_parts(both, n, m) for m in choices if m <= distance + 1]  # more parts than that would leave some out for nothing
    flat = [part for parts in layouts for part in parts]

    def keys(it):
        for b in it:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, part in enumerate(flat):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(_gather(fp, part).view(np.int64))], ["i", "v"])

    same = mapped(nodes.select("fp"), keys, "i int, v long").groupBy("i", "v").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s"))
    equal = {r["i"]: r["s"] for r in same.collect()}  # one row per part
    best, k = None, 0
    for parts in layouts:
        rows = []
        for part in parts:
            w = within(2 * p[part] * (1 - p[part]))
            grow = w / max(w[0], 1e-300)
            probes = np.cumsum([1.0, *np.cumprod([(len(part) - j) / (j + 1) for j in range(distance)])])
            pairs = [min(equal.get(k, 0.0) * g, float(n) * n) for g in grow[: distance + 1]]
            row = [0.0] + [c + 1000.0 * n * q for c, q in zip(pairs, probes)]
            rows.append(row + [float("inf")] * (distance + 2 - len(row)))  # a probe (written, shuffled, sorted) costs about 1000 comparisons (5 microseconds against 5 nanoseconds)
            k += 1
        cost, chosen = allocate(rows, distance)
        if best is None or cost < best[0]:
            best = (cost, parts, chosen)
    return best[1], best[2]


# -- probing ------------------------------------------------------------------------------------------------------


def _probe(nodes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, mask, node, fp, v1, v2): each node under its own value and the values within the threshold of each part."""
    schema = "key long, mask long, node long, fp long, v1 long, v2 long"

    def run(it):
        for b in it:
            whole = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (part, t) in enumerate(zip(parts, thresholds)):
                mask = sum(1 << x for x in part)
                for r in range(t + 1):
                    for flip in itertools.combinations(range(len(part)), r):
                        v = _gather(whole.view(np.uint64), part) ^ np.uint64(sum(1 << x for x in flip))
                        key = _mix(_mix(v) ^ np.uint64(i + 1))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(v), np.uint64(mask), np.uint64).view(np.int64)), *b.columns], ["key", "mask", *NODE])

    return mapped(nodes.select(*NODE), run, schema)


def forest(node: np.ndarray, fp: np.ndarray, v1: np.ndarray, v2: np.ndarray, run: np.ndarray, distance: int, also: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside runs (run: ascending numbers of buckets), each link to its tree's first row."""
    up = np.arange(len(fp))  # parents; flat before every step, so equal parents mean one tree
    at, k = np.arange(len(fp)), 1
    while len(at := at[at + k < len(fp)]) and len(at := at[run[at] == run[at + k]]):
        new = at[up[at] != up[at + k]]
        close = new[np.bitwise_count(fp[new] ^ fp[new + k]) <= distance]
        if len(close):
            differ = np.bitwise_count(v1[close] ^ v1[close + k]).astype(int) + np.bitwise_count(v2[close] ^ v2[close + k])
            close = close[differ <= also]
        for x, y in zip(close.tolist(), (close + k).tolist()):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        if len(close):
            while (up != (flat := up[up])).any():
                up = flat
        k += 1
    child = np.flatnonzero(node[up] != node)
    return list(zip(node[child].tolist(), node[up[child]].tolist()))


def _verify(rows: DataFrame, distance: int, also: int, cap: int, floor_bits: int = 8) -> DataFrame:
    """One pass over sorted buckets: rows with null key are links (node, fp), others go to finer buckets."""
    schema = "key long, mask long, node long, fp long, v1 long, v2 long"
    u = np.uint64

    def pack(key, mask, *of_node):
        cols = [pa.array(np.asarray(x, u).view(np.int64)) for x in of_node]
        ends = [pa.nulls(len(of_node[0]), pa.int64()) if x is None else pa.array(np.asarray(x, u).view(np.int64)) for x in (key, mask)]
        return pa.RecordBatch.from_arrays([*ends, *cols], ["key", "mask", *NODE])

    def finer(key: int, mask: int, node, fp, v1, v2):
        free = [x for x in range(64) if not mask >> x & 1]
        for j in range(distance + 1):
            piece = free[j :: distance + 1]
            if piece:
                k = _mix(_mix(_gather(fp, piece)) ^ u((key * 31 + j + 1) & (2**64 - 1)))
                yield pack(k, np.full(len(fp), u(mask | sum(1 << x for x in piece)), u), node, fp, v1, v2)

    def linked(key, *of_node):
        if len(key):
            links = forest(*of_node, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])), distance, also)
            if links:
                a, b = (np.array(x, u) for x in zip(*links))
                none = np.zeros(len(a), u)
                yield pack(None, None, a, b, none, none)

    def run(it):
        held = [np.zeros(0, u)] * 6
        hot = None  # key of a bucket that has gone over the cap
        for b in it:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64).view(u) for c in b.columns]
            now = [np.concatenate([x, y]) for x, y in zip(held, new)]
            key, mask = now[:2]
            if not len(key):
                continue
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            ends = np.append(starts[1:], len(key))
            keep = np.ones(len(key), bool)
            for s, e in zip(starts.tolist(), ends.tolist()):
                if int(key[s]) == hot or (e - s > cap and 64 - int(mask[s]).bit_count() > floor_bits):
                    yield from finer(int(key[s]), int(mask[s]), *(x[s:e] for x in now[2:]))
                    keep[s:e] = False
                    hot = int(key[s])
            tail = np.arange(len(key)) >= starts[-1]
            done = keep & ~tail
            yield from linked(key[done], *(x[done] for x in now[2:]))
            held = [x[keep & tail] for x in now]
        yield from linked(held[0], *held[2:])

    return mapped(rows.select("key", "mask", *NODE), run, schema)


def near_links(nodes: DataFrame, distance: int = 3, also: int = 128, cap: int = 32_768, choices=(2, 3, 4)) -> DataFrame:
    """(a, b): links that connect exactly the nodes which chains of links connect.

    nodes (node, fp, v1, v2) are distinct; two are linked if fp differs in at most ``distance`` bits and (v1, v2) in at most ``also``.
    """
    parts, thresholds = plan(nodes, distance, choices)
    rows, links = _probe(nodes, parts, thresholds), None
    probes = nodes.count() * sum(math.comb(len(part), r) for part, t in zip(parts, thresholds) for r in range(t + 1))
    while True:
        # a bucket may hold a node twice (own value and flipped): no harm
        done = settle(_verify(rows.repartition("key").sortWithinPartitions("key", "node"), distance, also, cap), probes)
        new = done.filter("key is null").select(F.col("node").alias("a"), F.col("fp").alias("b"))
        links = new if links is None else links.unionByName(new)
        rows = done.filter("key is not null")
        probes = rows.count()
        if not probes:
            return links


def grouped(fps: DataFrame, links_of) -> DataFrame:
    """fps (doc_id, node, ...) with component_id, the smallest doc_id of the documents that links connect."""
    nodes = settle(fps.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in NODE[1:]]))
    roots = components(links_of(nodes)).withColumnRenamed("node", "_n")
    rooted = nodes.join(roots, nodes["node"] == roots["_n"], "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.select("node", "root").join(least, "root").select("node", "root", "component_id"), "node")


def near_groups(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links)."""
    zero = F.lit(0).cast("long")
    fps = settle(fingerprints(docs, words)).select("doc_id", F.col("fp").alias("node"), "fp", zero.alias("v1"), zero.alias("v2"))
    return grouped(fps, lambda nodes: near_links(nodes, distance)).select("doc_id", "fp", "component_id")


def keep_one_of_near(docs: DataFrame, **settings) -> DataFrame:
    """The documents, all columns, without near copies: see ``jaccard.keep_one_of_near``, which searches by these fingerprints first."""
    from . import jaccard  # it imports this module

    return jaccard.keep_one_of_near(docs, **settings)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), words=3, distance=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
