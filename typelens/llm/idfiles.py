"""Token-ID output: files of blocks coded by an adaptive context-mixing range coder, in ascending doc_id order.

The documents are range-partitioned by doc_id; each partition is a file, a row of items in ascending order.  An item is a
prior (the frequencies of ids that the blocks behind it, up to the next prior, start from) or a block.  A block holds at
most 1024 ids, resets the model to its prior (see ``idcoder``) and can be read with nothing but that:

    4 bytes  magic ``TLI2``          4 bytes  number of ids        4 bytes  CRC-32 of the ids (little-endian unsigned 16-bit)
    4 bytes  documents in the block  4 bytes  length of the range-coded words
    per document 13 bytes: doc_id (8, signed), ids of it in this block (4), flags (1: no doc_id, 2: goes on from before)
    the range-coded words

    a prior: 4 bytes magic ``TLIP``, 4 bytes CRC-32 of the rest, the rest as ``idcoder.Prior.dump`` gives it

All numbers are little-endian.  The items are stored as (file, block, data) rows through Spark's own writer, so that a
task that is run again replaces its file, on any storage that Spark writes to; the data column of a file in block order
is the file.  Many blocks are coded side by side; a task holds a bounded number of ids at a time (4 million and one batch).

Defined results: a null or empty text has the end id only; a null doc_id comes last; rows that repeat a doc_id follow each
other in the order of their texts; an empty table writes no blocks; a damaged block or prior raises, and so do ids that
don't fit in 16 bits; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, mapped, scratch, settle, table, texts, word_bpe
from .idcoder import Prior, decode, encode

MAGIC, HEAD, DOC = b"TLI2", struct.Struct("<4s4I"), struct.Struct("<qIB")
PRIOR, PRIOR_HEAD = b"TLIP", struct.Struct("<4sI")
BLOCK, LANES = 1024, 4096


def pack_blocks(ids: list[np.ndarray], docs: list[list[tuple[int, int, int]]]) -> list[bytes]:
    """The prior of some blocks, and they."""
    prior = Prior.of(ids)
    data = prior.dump()
    out = [PRIOR_HEAD.pack(PRIOR, zlib.crc32(data)) + data]
    for x, entries, words in zip(ids, docs, encode(ids, prior)):
        head = HEAD.pack(MAGIC, len(x), zlib.crc32(x.astype("<u2").tobytes()), len(entries), len(words))
        out.append(head + b"".join(DOC.pack(*e) for e in entries) + words)
    return out


def unpack_prior(item: bytes) -> Prior:
    magic, crc = PRIOR_HEAD.unpack_from(item)
    if magic != PRIOR or zlib.crc32(item[PRIOR_HEAD.size :]) != crc:
        raise ValueError("a prior of token ids fails its checksum")
    return Prior.load(item[PRIOR_HEAD.size :])


def unpack_blocks(blocks: list[bytes], prior: Prior | None) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """The ids and the documents of blocks that start from one prior."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    coded, entries = [], []
    for b, (magic, _, _, n_docs, n_words) in zip(blocks, heads):
        at = HEAD.size + n_docs * DOC.size
        if prior is None or magic != MAGIC or len(b) != at + n_words:
            raise ValueError("not a block of token ids, or cut short, or without its prior")
        entries.append(list(DOC.iter_unpack(b[HEAD.size : at])))
        coded.append(b[at:])
    ids = decode(coded, [h[1] for h in heads], prior)
    for x, h in zip(ids, heads):
        if zlib.crc32(x.astype("<u2").tobytes()) != h[2]:
            raise ValueError("a block of token ids fails its checksum")
    return list(zip(ids, entries))


def write_ids(docs: DataFrame, tokenizer: str, out: str, end_id: int = 1, file_chars: int = 24_000_000) -> str:
    """Write the files to the folder ``out``, one for about ``file_chars`` bytes of text."""
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_chars))
    rows = rows.withColumn("none", F.col("doc_id").isNull()).repartitionByRange(files, "none", "doc_id", F.xxhash64("text")).sortWithinPartitions("none", "doc_id", "text")

    def run(it):
        encode_texts, end = word_bpe(tokenizer), np.array([end_id], "<u4").tobytes()
        file, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        entries: list[list[tuple[int, int, int]]] = []
        open_ids, open_n, open_docs = [], 0, []

        def close():
            nonlocal open_ids, open_n, open_docs
            ids.append(np.concatenate(open_ids))
            entries.append(open_docs)
            open_ids, open_n, open_docs = [], 0, []

        def flush():
            nonlocal number
            data = pack_blocks(ids, entries)
            at = list(range(number, number + len(data)))
            number += len(data)
            ids.clear()
            entries.clear()
            return pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["file", "block", "data"])

        for b in batches(it):
            raw = encode_texts(b.column(1).to_pylist())
            every = np.frombuffer(b"".join([x for r in raw for x in (r, end)]), "<u4")
            if every.max() > 0xFFFF:
                raise ValueError("an id doesn't fit in 16 bits")
            every = every.astype(np.uint16)
            stop = 0
            for doc, r in zip(b.column(0).to_pylist(), raw):
                start, stop = stop, stop + len(r) // 4 + 1
                x, at = every[start:stop], 0
                while at < len(x):
                    part = x[at : at + BLOCK - open_n]
                    open_ids.append(part)
                    open_docs.append((doc or 0, len(part), (doc is None) + 2 * (at > 0)))
                    open_n, at = open_n + len(part), at + len(part)
                    if open_n == BLOCK:
                        close()
                        if len(ids) == LANES:
                            yield flush()
        if open_n:
            close()
        if ids:
            yield flush()

    mapped(rows.select("doc_id", "text"), run, "file int, block int, data binary").write.parquet(out)
    return out


def _as_binary(ids: np.ndarray) -> tuple:
    return (ids.astype("<u4").tobytes(),)


def read_ids(spark: SparkSession, path: str, of=_as_binary, columns: str = "ids binary") -> DataFrame:
    """One row per document, from the files: file, place (in its file), doc_id, and what ``of`` makes of its ids.

    By default that is ids, unsigned 32-bit ones in a binary; ``of`` gets an array and returns a tuple for ``columns``.
    """
    schema = f"file int, place long, doc_id long, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(it):
        held: list[np.ndarray] = []
        who = None  # (file, doc_id or None)
        place, now = 0, None
        rows: list[tuple] = []

        def give():
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        def done():
            nonlocal place
            if who is not None:
                rows.append((who[0], place, who[1], *of(np.concatenate(held))))
                place += 1
                held.clear()

        prior, waiting = None, []  # blocks of one prior that are decoded together

        def unpacked():
            nonlocal place, now, who
            for file, (ids, entries) in zip([f for f, _ in waiting], unpack_blocks([x for _, x in waiting], prior)):
                at = 0
                for doc, n, flags in entries:
                    if not flags & 2:
                        done()
                        if file != now:
                            now, place = file, 0
                        who = (file, None if flags & 1 else doc)
                    held.append(ids[at : at + n])
                    at += n
            waiting.clear()

        for b in it:
            for file, item in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                is_prior = item[:4] == PRIOR
                if waiting and (is_prior or len(waiting) == LANES):
                    unpacked()
                if is_prior:
                    prior = unpack_prior(item)
                else:
                    waiting.append((file, item))
            if rows:
                yield give()
        if waiting:
            unpacked()
        done()
        if rows:
            yield give()

    blocks = spark.read.schema("file int, block int, data binary").parquet(path)
    return mapped(blocks.repartition("file").sortWithinPartitions("file", "block"), run, schema)


def offsets(rows: DataFrame) -> DataFrame:
    """rows (file, place, n) with start: the ids of all documents before; the sums of files meet in one small window."""
    totals = rows.groupBy("file").agg(F.sum("n").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.orderBy("file")) - F.col("total")).select("file", "before")
    own = Window.partitionBy("file").orderBy("place")
    return rows.withColumn("inside", F.sum("n").over(own) - F.col("n")).join(before, "file").withColumn("start", F.col("before") + F.col("inside"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "ids"))

    def digest(ids):
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    rows = settle(read_ids(spark, path, digest, "n long, ids_crc32 long"))
    return offsets(rows).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")
