"""Substring dedup: relative Lempel-Ziv parsing against blocks of earlier documents.

A reference block holds the documents of a range of doc_ids.  All blocks are indexed: each sends every different
window of ``words`` words in it, as a 64-bit hash, to the bucket that owns the hash's range, and a bucket tells each
block which of its hashes an earlier block has, and which block (the first).  That only says where to look.  The words of
such a stretch then go to the reference block, which parses them from left to right: the window that comes next is looked up
in the block's index and compared word by word; from its first place there the factor goes on for as long as the words
agree; the next factor starts with the first window that isn't inside this one, so that windows over the boundary
are looked up like all others.  Windows that stand in an earlier document of the same block are found inside the block, in
the same way.  Factors have at least ``words`` words and become duplicate spans.

A window whose words the first block doesn't have, only its hash, goes on to every other earlier block that sent the
hash; so the result doesn't depend on the hashes.

Scale: the text is shuffled once, by block, and that exchange serves all passes; a block sends a hash once however often
it holds it, so that a passage which a third of all documents share is sent once per block; the answer is a bit per hash
and a reference per duplicate; the words of duplicates travel once more.  A block holds about ``block_bytes`` bytes of text
if doc_ids are spread evenly (one document at least), a bucket the hashes of about ``bucket_chars`` characters and eight
bytes a block for each window that all blocks share.

Defined results: a null text has no words; a document with fewer words than a window keeps them all; equal doc_ids are
not earlier than each other; a row with null doc_id has all others before it and is before none; an empty table gives no
rows; extra columns are ignored (``remove_spans`` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import ship, table, texts

U = np.uint64
STEP = U(0xD6E8FEB86659FD93)
#: Blocks of rows without doc_id start here.
NULLS = 1 << 62
#: What a block (or bucket) tells another, one row for each that it tells something: stretches of words to be parsed (words), or
#: factors (n windows from word ``at`` of the block's words).
MESSAGE = "key long, block long, at array<long>, n array<long>, ref_doc array<long>, ref_at array<long>, hash array<long>, words array<binary>"
_LISTS = ("at", "n", "ref_doc", "ref_at", "hash", "words")
_MESSAGE = pa.schema([("key", pa.int64()), ("block", pa.int64())] + [(c, pa.list_(pa.binary() if c == "words" else pa.int64())) for c in _LISTS])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(hashes: np.ndarray, words: int, bits: int = 64) -> np.ndarray:
    """A hash for each run of ``words`` word hashes, of which the upper ``bits`` count."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = np.zeros(n, U)
    for j in range(words):
        acc = acc * STEP + hashes[j : j + n]
    return mix(acc) >> U(64 - bits) << U(64 - bits)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


class Docs:
    """The words of a block's documents, in ascending doc_id order: the order is the same in every pass."""

    def __init__(self, t: pa.Table):
        rows = sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), range(t.num_rows)), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        self.ids, self.order = [r[0] for r in rows], [r[2] for r in rows]
        self.texts = [r[1].encode() for r in rows]
        self.split = [x.split() for x in self.texts]
        self.ends = np.cumsum([len(w) for w in self.split])
        self.starts = self.ends - [len(w) for w in self.split]


class Block(Docs):
    """The index of a block: windows in classes of equal words."""

    def __init__(self, t: pa.Table, words: int, bits: int = 64):
        super().__init__(t)
        self.size, self.bits = words, bits
        self.words = list(itertools.chain.from_iterable(self.split))
        self.number: defaultdict = defaultdict(itertools.count().__next__)
        self.flat = np.fromiter(map(self.number.__getitem__, self.words), np.int64, len(self.words))
        self.number.default_factory = None
        self.hashes = np.fromiter(map(xxh3_64_intdigest, self.number), U, len(self.number))
        n = np.maximum(self.ends - self.starts - words + 1, 0)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(n.sum()) + np.repeat(self.starts - (np.cumsum(n) - n), n)
        self.h = windows(self.hashes[self.flat], words, bits)[self.at] if len(self.at) else np.zeros(0, U)
        self._classes()

    def _classes(self) -> None:
        """kind: the class of each window; first: the first window of each class; head: its hash (ascending)."""
        self.head, self.first, self.kind = np.unique(self.h, return_index=True, return_inverse=True)
        rep = self.at[self.first][self.kind]
        same = np.ones(len(self.at), bool)
        for j in range(self.size):
            same &= self.flat[self.at + j] == self.flat[rep + j]
        if not same.all():  # different words under one hash
            some = np.flatnonzero(np.isin(self.kind, self.kind[~same]))
            rows = self.flat[self.at[some][:, None] + np.arange(self.size)]
            self.kind[some] = len(self.head) + np.unique(rows, axis=0, return_inverse=True)[1].ravel()
            _, first, kind = np.unique(self.kind, return_index=True, return_inverse=True)
            by = np.argsort(self.h[first], kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            self.first, self.kind = first[by], place[kind]
            self.head = self.h[self.first]

    def earlier(self) -> np.ndarray:
        """Per window: whether a document of this block with a smaller doc_id has it."""
        rank, last, k = [], object(), -1
        for i in self.ids:  # equal ids have equal ranks
            if i is None or i != last:
                k, last = k + 1, i
            rank.append(k)
        rank, null = np.array(rank, np.int64), np.array([i is None for i in self.ids], bool)
        first = self.owner[self.first][self.kind]
        return (rank[first] < rank[self.owner]) & ~null[first] if len(self.at) else np.zeros(0, bool)

    def own_factors(self, here: np.ndarray) -> list[tuple]:
        """(at, windows, doc_id, place) of the factors whose reference is this block."""
        k = np.flatnonzero(here)
        if not len(k):
            return []
        ref = self.first[self.kind[k]]
        new = np.concatenate([[True], (np.diff(self.at[k]) != 1) | (np.diff(self.owner[k]) != 0) | (np.diff(self.at[ref]) != 1) | (np.diff(self.owner[ref]) != 0)])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(k)))
        doc = self.owner[ref[heads]]
        return [(int(at), int(n), self.ids[d], int(p)) for at, n, d, p in zip(self.at[k[heads]], sizes, doc, self.at[ref[heads]] - self.starts[doc])]

    def parse(self, stretch: list[bytes]) -> tuple[list[tuple], list[tuple]]:
        """Factors (first word, windows, doc_id, place) of some words by this block; windows that it doesn't have (first word, hash)."""
        ids = np.array([self.number.get(w, -1) for w in stretch], np.int64)
        own = np.array([self.hashes[i] if i >= 0 else xxh3_64_intdigest(w) for i, w in zip(ids.tolist(), stretch)], U)
        h = windows(own, self.size, self.bits)
        lo, hi = np.searchsorted(self.head, h, "left").tolist(), np.searchsorted(self.head, h, "right").tolist()
        factors, missing, i = [], [], 0
        while i < len(h):
            for k in range(lo[i], hi[i]):
                p = int(self.at[self.first[k]])
                if (self.flat[p : p + self.size] == ids[i : i + self.size]).all():
                    doc = int(self.owner[self.first[k]])
                    n = min(len(ids) - i, int(self.ends[doc]) - p)
                    differ = np.flatnonzero(self.flat[p : p + n] != ids[i : i + n])
                    n = (int(differ[0]) if len(differ) else n) - self.size + 1
                    factors.append((i, n, self.ids[doc], p - int(self.starts[doc])))
                    i += n
                    break
            else:
                missing.append((i, int(h[i].view(np.int64))))
                i += 1
        return factors, missing


def _messages(rows: list[tuple], *tables: pa.Table) -> pa.Table:
    """rows (key, block, at, n, ref_doc, ref_at, hash, words) as messages, and those of the tables."""
    groups: dict[tuple, list] = {}
    for key, block, *rest in rows:
        groups.setdefault((key, block, rest[-1] is None), []).append(rest)
    cols: list[list] = [[k[0] for k in groups], [k[1] for k in groups]]
    for i, name in enumerate(_LISTS):
        cols.append([None if name == "words" and k[2] else [r[i] for r in g] for k, g in groups.items()])
    return pa.concat_tables([pa.table([pa.array(c, f.type) for c, f in zip(cols, _MESSAGE)], schema=_MESSAGE), *(t.select(_MESSAGE.names).cast(_MESSAGE) for t in tables)])


def _each(t: pa.Table, *names: str):
    """block and some columns of the rows that messages stand for."""
    for block, *lists in zip(t["block"].to_pylist(), *[t[c].to_pylist() for c in names]):
        for row in zip(*lists):
            yield block, *row


def _ask(words: int, bits: int, buckets: int):
    """A block's different hashes, to the buckets: key is -1 - bucket."""

    def run(key, t):
        head = np.unique(Block(t, words, bits).head)
        ends = np.searchsorted(bucket_of(head, buckets), np.arange(buckets + 1))  # ascending, as the hashes are
        some = [k for k in range(buckets) if ends[k + 1] > ends[k]]
        parts = [head[ends[k] : ends[k + 1]].astype("<u8").tobytes() for k in some]
        return pa.table({"key": pa.array([-1 - k for k in some], pa.int64()), "block": pa.array([key[0].as_py()] * len(some), pa.int64()), "hashes": pa.array(parts, pa.binary())})

    return run


def _answer(key, t):
    """For each block that asked: a bit per hash (an earlier block has it), the different references, their numbers."""
    t = t.sort_by("block")
    blocks = t["block"].to_numpy()
    parts = [np.frombuffer(x.as_buffer(), "<u8") for x in t["hashes"]]
    sizes = np.array([len(p) for p in parts])
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    owner = np.repeat(blocks, sizes)
    source = np.empty(len(h), np.int64)
    source[order] = owner[order][head][np.cumsum(head) - 1]
    found = (source < owner) & (source < NULLS)
    out: list[list] = [[], [], [], []]
    for block, s, e in zip(blocks.tolist(), (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist()):
        hit = found[s:e]
        if hit.any():
            refs, which = np.unique(source[s:e][hit], return_inverse=True)
            for to, x in zip(out, (block, np.packbits(hit).tobytes(), refs.astype("<i8").tobytes(), which.astype("<u4").tobytes())):
                to.append(x)
    b = pa.array([-1 - key[0].as_py()] * len(out[0]), pa.int32())
    return pa.table({"key": pa.array(out[0], pa.int64()), "bucket": b, **{n: pa.array(x, pa.binary()) for n, x in zip(("bits", "refs", "which"), out[1:])}})


def _request(words: int, bits: int, buckets: int):
    """Stretches of words to the blocks that may have them; factors inside the block to the block itself."""

    def run(key, docs, answers):
        if not docs.num_rows:
            return _messages([])
        b, block = Block(docs, words, bits), key[0].as_py()
        head = np.unique(b.head)
        source = np.full(len(head), -1, np.int64)
        ends = np.searchsorted(bucket_of(head, buckets), np.arange(buckets + 1))
        for bucket, hit, refs, which in zip(*[answers[c].to_pylist() for c in ("bucket", "bits", "refs", "which")]):
            s, e = ends[bucket], ends[bucket + 1]
            at = s + np.flatnonzero(np.unpackbits(np.frombuffer(hit, np.uint8), count=e - s))
            source[at] = np.frombuffer(refs, "<i8")[np.frombuffer(which, "<u4")]
        here = b.earlier()
        out = [(block, None, at, n, doc, place, None, None) for at, n, doc, place in b.own_factors(here)]
        ref = source[np.searchsorted(head, b.h)]
        k = np.flatnonzero(~here & (ref >= 0)) if len(ref) else []
        if len(k):
            new = np.concatenate([[True], (np.diff(b.at[k]) != 1) | (np.diff(b.owner[k]) != 0) | (np.diff(ref[k]) != 0)])
            heads = np.flatnonzero(new)
            for s, e in zip(heads.tolist(), np.append(heads[1:], len(k)).tolist()):
                at = int(b.at[k[s]])
                out.append((int(ref[k[s]]), block, at, None, None, None, None, b" ".join(b.words[at : at + e - s + words - 1])))
        return _messages(out)

    return run


def _reply(words: int, bits: int, buckets: int, last: bool):
    """Parses of what came to a block; windows that it doesn't have go to their bucket, unless it is the last pass."""

    def run(key, docs, messages):
        asked = messages.filter(messages["words"].is_valid())
        known = messages.filter(messages["words"].is_null())
        out: list[tuple] = []
        if asked.num_rows and docs.num_rows:
            b, block = Block(docs, words, bits), key[0].as_py()
            for target, at, stretch in _each(asked, "at", "words"):
                stretch = stretch.split(b" ")
                factors, missing = b.parse(stretch)
                out += [(target, None, at + i, n, doc, place, None, None) for i, n, doc, place in factors]
                for i, h in [] if last else missing:
                    bucket = int(bucket_of(np.array([h]).view(U), buckets)[0])
                    out.append((-1 - bucket, target, at + i, block, None, None, h, b" ".join(stretch[i : i + words])))
        return _messages(out, known)

    return run


def _elsewhere(key, hashes, messages):
    """Windows that their first block doesn't have (n: that block), to all other earlier blocks that sent the hash."""
    lost = messages.filter(messages["words"].is_valid())
    known = messages.filter(messages["words"].is_null())
    out: list[tuple] = []
    if lost.num_rows:
        parts = [np.frombuffer(x.as_buffer(), "<u8") for x in hashes["hashes"]]
        h, owner = np.concatenate(parts), np.repeat(hashes["block"].to_numpy(), [len(p) for p in parts])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        for target, at, tried, own, stretch in _each(lost, "at", "n", "hash", "words"):
            own = np.array([own]).view(U)[0]
            for block in owner[np.searchsorted(h, own, "left") : np.searchsorted(h, own, "right")].tolist():
                if block < target and block < NULLS and block != tried:
                    out.append((block, target, at, None, None, None, None, stretch))
    return _messages(out, known)


def _cover(words: int, with_text: bool):
    """The documents of a block with their spans."""

    def run(key, docs, messages):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text")}
        b = Docs(docs)
        spans: dict[int, set] = defaultdict(set)
        for _, s, n, doc, place in _each(messages, "at", "n", "ref_doc", "ref_at"):
            k = int(np.searchsorted(b.ends, s, "right"))
            spans[k].add((s - int(b.starts[k]), n + words - 1, doc, place))
        for k, (doc, text, w) in enumerate(zip(b.ids, b.texts, b.split)):
            own = sorted(spans.get(k, ()))
            keep = np.ones(len(w), bool)
            for s, n, _, _ in own:
                keep[s : s + n] = False
            out["doc_id"].append(doc)
            out["n_words"].append(len(w))
            out["n_removed"].append(int(len(w) - keep.sum()))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(itertools.compress(w, keep.tolist()) if own else w)).hexdigest())
            out["spans"].append([{"start": s, "words": n, "doc": d, "at": p} for s, n, d, p in own])
            out["text"].append(_cut(text, w, keep).decode() if with_text and own else text.decode() if with_text else None)
        span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "doc", "at")]))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": span, "text": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()} | {"rest": docs["rest"].take(pa.array(b.order, pa.int64()))})

    return run


def _cut(text: bytes, words: list[bytes], keep: np.ndarray) -> bytes:
    """The text without the removed words and the white space behind each."""
    out, at = [], 0
    for k, (w, stays) in enumerate(zip(words, keep.tolist())):
        start = text.index(w, at)
        end = start + len(w)
        while end < len(text) and text[end] in b" \t\n\r\x0b\x0c":
            end += 1
        out.append(text[(0 if k == 0 else start) : end] if stays else b"")
        at = end
    return b"".join(out)


def _spans(rows: DataFrame, words: int, block_bytes: int, bucket_chars: int, hash_bits: int, with_text: bool) -> DataFrame:
    """rows (doc_id, text, rest) -> doc_id, n_words, n_removed, kept_sha256, spans, text, rest."""
    spark = rows.sparkSession
    ship(spark)
    size, low, high = rows.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    size = size or 0
    width = 1 if low is None else min(max(1, (high - low + 1) * block_bytes // max(size, 1)), 1 << 62)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_chars))
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) + F.lit(NULLS)
    number = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low or 0)) / F.lit(width)).cast("long")
    rows = rows.withColumn("key", F.coalesce(number, spread))
    by = lambda df: df.groupBy("key")
    settings = (words, hash_bits, buckets)
    asked = by(rows).applyInArrow(_ask(*settings), "key long, block long, hashes binary")
    answers = by(asked).applyInArrow(_answer, "key long, bucket int, bits binary, refs binary, which binary")
    requests = by(rows).cogroup(by(answers)).applyInArrow(_request(*settings), MESSAGE)
    replies = by(rows).cogroup(by(requests)).applyInArrow(_reply(*settings, False), MESSAGE)
    others = by(asked).cogroup(by(replies)).applyInArrow(_elsewhere, MESSAGE)
    factors = by(rows).cogroup(by(others)).applyInArrow(_reply(*settings, True), MESSAGE)
    out = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, words: long, doc: long, at: long>>, text string")
    return by(rows).cogroup(by(factors)).applyInArrow(_cover(words, with_text), T.StructType([*out.fields, rows.schema["rest"]]))


def duplicate_spans(docs: DataFrame, words: int = 13, block_bytes: int = 1_000_000, bucket_chars: int = 24_000_000, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start: first word, words: length, doc and at: document and word of the reference).

    A weak hash (``hash_bits``) makes it slower, nothing else.
    """
    rows = texts(docs).withColumn("rest", F.lit(0))
    return _spans(rows, words, block_bytes, bucket_chars, hash_bits, False).drop("rest", "text")


def remove_spans(docs: DataFrame, words: int = 50, block_bytes: int = 1_000_000, bucket_chars: int = 24_000_000) -> DataFrame:
    """The documents, all columns, their texts without duplicate spans; n_chars, if there, is counted anew.

    Null texts stay null; rows that repeat a doc_id or all columns stay, each on its own; columns may have any names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    rows = _spans(rows, words, block_bytes, bucket_chars, 64, True)
    value = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(~F.col("rest.none"), F.col("text"))} | {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(value["n_chars"])
    return rows.select(*[value[c].alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
