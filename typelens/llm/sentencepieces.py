"""SentencePiece encoding and decoding by a table of distinct chunks.

In a model none of whose pieces holds a white-space marker behind another character, no piece reaches over the place
between a character and a marker.  A text is therefore cut before single spaces between two other characters; each
distinct marked word of a batch is segmented once by the library, kept in the worker's table of chunks (of bounded
size), and the ids are put back by position.  Decoding goes through the library.  With any other model the whole
text is encoded at once (the model is looked at when it is loaded).

The work is a map over rows: no shuffle, no state beyond the table, nothing that grows with the corpus.

Defined results: a null text is an empty one; an empty text gives begin and end ids only; null ids decode to null;
null doc_ids, repeated rows and empty tables go through; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkIds, batches, mapped, table, texts

MARK = "▁"
_KEPT: dict[str, tuple] = {}


class MarkedChunks(ChunkIds):
    """Chunks that may not end in a literal marker either."""

    @staticmethod
    def chunks(text: str) -> list[str]:
        if MARK not in text:
            return ChunkIds.chunks(text)
        out: list[str] = []
        for p in ChunkIds.chunks(text):
            if out and out[-1].endswith(MARK):
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
        return out


def crossing(sp) -> bool:
    """Whether a piece has a marker behind another character."""
    return any(MARK in (s := sp.id_to_piece(i)).lstrip(MARK) and not sp.is_byte(i) for i in range(sp.get_piece_size()))


def model(path: str) -> tuple:
    """(processor, function from texts to packed ids without begin and end)."""
    if path not in _KEPT:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda x: sp.encode(x, num_threads=1)
        if crossing(sp):
            _KEPT[path] = sp, lambda x: [np.array(i, "<u4").tobytes() for i in whole(x)]
        else:
            _KEPT[path] = sp, MarkedChunks(whole, "")
    return _KEPT[path]


def encode(docs: DataFrame, path: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit)."""

    def run(it):
        sp, chunks = model(path)
        head = np.array([sp.bos_id()] * bos, "<u4").tobytes()
        tail = np.array([sp.eos_id()] * eos, "<u4").tobytes()
        for b in batches(it):
            ids = [head + x + tail for x in chunks(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return mapped(texts(docs), run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids) -> doc_id, ids, text."""

    def run(it):
        sp, _ = model(path)
        for b in it:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = part.column(1).to_pylist()
                text = [None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return mapped(rows.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """doc_id, ids, text: ``decode`` of ``encode`` in one pass, so that a task has one Python worker instead of two."""

    def run(it):
        sp, chunks = model(path)
        head = np.array([sp.bos_id()] * bos, "<u4").tobytes()
        tail = np.array([sp.eos_id()] * eos, "<u4").tobytes()
        for b in batches(it, 2_000_000):
            ids = [head + x + tail for x in chunks(b.column(1).to_pylist())]
            text = [sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return mapped(texts(docs), run, "doc_id long, ids binary, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
