"""Best-fit packing: hierarchical residual packing of pieces into sequences of a fixed size.

Documents are cut only if they are longer than a sequence: full pieces, and one shorter first piece.  A full piece
is a sequence.  The rest is dealt over leaves of bounded size; each leaf packs its items best-fit, largest
first, emits the bins that are nearly full and hands all underfull bins on, as items, to the next level, which has as many
nodes as they need.  So it goes on until one node is left, or until a level saves less than one bin in 200: then those
that are left don't fit into each other, and are emitted as they are.  Bins are dealt anew at each level, by a hash of
their number and the level.  A node holds about ``leaf`` bins or ``10 * leaf`` pieces, whatever the corpus.

Defined results: a null or empty text is one piece with the end id only; null doc_ids and repeated rows are packed
like all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, byte_bpe, mapped, settle, table, texts

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""

    def run(it):
        encode, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        for b in batches(it):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * s : 4 * e]
                    for to, x in zip(rows, (doc, k, s, e - s, zlib.crc32(part), part)):
                        to.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], [*COLUMNS, "ids"][: len(rows)])

    return mapped(texts(docs), run, PIECE + ", ids binary" * with_ids)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit f: there is a bin with f free
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        s = sizes[i]
        fits = some >> s
        if fits:
            free = (fits & -fits).bit_length() - 1 + s
            k = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
            bins[k].append(i)
        else:
            free, k = room, len(bins)
            bins.append([i])
        if left := free - s:
            if not by_free[left]:
                some |= 1 << left
            by_free[left].append(k)
    return bins


def _pack_node(rows: DataFrame, size: int, level: int, nearly: float) -> DataFrame:
    """rows: pieces with seq (the bin they are in) and offset -> the same with new bins; open: goes to the next level."""

    def run(it):
        parts = [b for b in it if b.num_rows]  # one node
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        t = t.sort_by([("seq", "ascending"), ("offset", "ascending")])
        seq, length = t["seq"].to_numpy(), t["length"].to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        ends = np.append(heads[1:], len(seq))
        fill = np.add.reduceat(length, heads)
        packed = best_fit(fill.tolist(), size)
        full = np.array([fill[x].sum() for x in packed])
        order = np.concatenate([np.arange(heads[i], ends[i]) for x in packed for i in x])
        n_rows = np.array([sum(int(ends[i] - heads[i]) for i in x) for x in packed])
        bins = np.repeat(np.arange(len(packed)), n_rows)
        before = np.cumsum(length[order]) - length[order]
        first = np.cumsum(n_rows) - n_rows
        offset = before - np.repeat(before[first], n_rows)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        out = t.take(pa.array(order)).drop_columns(["seq", "offset"])
        out = out.append_column("seq", pa.array(base + bins)).append_column("offset", pa.array(offset)).append_column("open", pa.array((full < nearly * size)[bins]))
        yield from out.to_batches(max_chunksize=50_000)

    return mapped(rows.select(*COLUMNS, "seq", "offset"), run, PIECE + ", seq long, offset long, open boolean")


def pack(items: DataFrame, size: int = 1024, leaf: int = 50_000, nearly: float = 0.98, least_gain: float = 0.005) -> DataFrame:
    """Pieces (as from ``pieces``, settled) with sequence_id and offset."""
    whole = items.filter(F.col("length") >= size).withColumn("seq", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rows = items.filter(F.col("length") < size).withColumn("seq", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    bins = n_pieces = rows.count()
    out, level = whole.select(*COLUMNS, "seq", "offset"), 1
    while True:
        nodes = max(1, math.ceil(bins / leaf), math.ceil(n_pieces / (10 * leaf)))
        done = settle(_pack_node(rows.repartition(nodes, F.xxhash64("seq", F.lit(level))), size, level, nearly))
        n = {r["open"]: r for r in done.groupBy("open").agg(F.countDistinct("seq").alias("bins"), F.count(F.lit(1)).alias("pieces")).collect()}  # two rows
        total = sum(r["bins"] for r in n.values())
        if nodes == 1 or True not in n or (level > 1 and bins - total < least_gain * bins):
            return out.unionByName(done.select(*COLUMNS, "seq", "offset")).withColumnRenamed("seq", "sequence_id")
        out = out.unionByName(done.filter("not open").select(*COLUMNS, "seq", "offset"))
        rows, bins, n_pieces, level = done.filter("open"), n[True]["bins"], n[True]["pieces"], level + 1


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    items = settle(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return pack(items).select(*COLUMNS, "sequence_id", "offset")
