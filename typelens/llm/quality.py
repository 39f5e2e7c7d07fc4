"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted in three blocks of terms - trigrams of character classes, hashed words, bands of repetition and
length - each weighted (square root of the share, inverse document frequency for words) and scaled to its own length.  A
truncated singular value decomposition of the labelled sample gives the latent space; the labelled vectors in it
(``bound`` rows of ``rank`` 4-byte numbers, about a megabyte) and the term matrix go to every executor.  Each document is
compared with all of them, exactly, as blocked matrix products; the labels of its ``neighbours`` nearest vote, weighted
by their cosine.

Fitting takes a bounded sample of labelled rows; scoring is a map over all whole texts.

Defined results: a null text is an empty one; an empty text has the zero vector, whose vote is the mean label of
the sample; without labels the score is 0; null doc_ids and repeated rows are scored like others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mapped, table, texts
from .labelled import crc, sample

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
PART = 1 << 21
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, x in enumerate((BASE, BASE_INVERSE)):
            a = np.full(max(n, PART + 1), x, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word: prefix sums of a polynomial over the bytes, cut at white space into steps of bounded size."""
    out, at = [], 0
    while at < len(text):
        end = min(at + PART, len(text))
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut > at else len(text)
        b = np.frombuffer(text, np.uint8, end - at, at)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + U(1)) * up[: len(b)], out=sums[1:])
        out.append(mix((sums[stop] - sums[start]) * down[start]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


WORDS = 2048
#: Classes of bytes: lower, upper, digit, space, line end, full stop, comma, exclamation, bar, other marks, bytes of other letters.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]], _CLASS[46], _CLASS[44], _CLASS[[33, 63]], _CLASS[124] = 3, 4, 5, 6, 7, 8
_CLASS[[*range(34, 44), 45, 47, *range(58, 63), 64, *range(91, 97), 123, 125, 126]] = 9
_CLASS[[*range(0, 9), *range(14, 32), 127]] = 9
_CLASS[128:] = 10
K = 11
BANDS = 24
TERMS = K**3 + WORDS + BANDS


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the terms of a text; counts of the three blocks are shares of their block."""
    data = text.encode()
    shape = np.zeros(K**3)
    for at in range(0, max(len(data) - 2, 0), PART):
        c = _CLASS[np.frombuffer(data, np.uint8, min(PART + 2, len(data) - at), at)]
        shape += np.bincount(c[:-2] * (K * K) + c[1:-1] * K + c[2:], minlength=K**3)
    h = word_hashes(data)
    words = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS).astype(float)
    bands = np.zeros(BANDS)
    if len(h):
        again = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
        different = len(np.unique(h)) / len(h)
        bands[min(int(again * 8), 7)] += 1
        bands[8 + min(int(different * 8), 7)] += 1
        bands[16 + min(int(np.log2(len(h) + 1) / 2), 7)] += 1
    full = np.concatenate([shape / max(shape.sum(), 1), words / max(words.sum(), 1), bands / 3])
    some = np.flatnonzero(full)
    return some.astype(np.int32), full[some]


def weighted(some: np.ndarray, share: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(TERMS, np.float32)
    x[some] = np.sqrt(share) * idf[some]
    for a, b, part in ((0, K**3, 0.8), (K**3, K**3 + WORDS, 0.3), (K**3 + WORDS, TERMS, 0.5)):
        if length := float(np.linalg.norm(x[a:b])):
            x[a:b] *= part / length
    return x


class Neighbours:
    def __init__(self, prior: float = 0.0, neighbours: int = 15):
        self.prior, self.k, self.idf, self.axes, self.vectors, self.y = prior, neighbours, None, None, None, None

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, z: np.ndarray) -> np.ndarray:
        out = np.empty(len(z))
        k = min(self.k, len(self.y))
        for s in range(0, len(z), 512):
            near = z[s : s + 512] @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, top, 1), 0).astype(float) ** 4
            total = w.sum(1)
            out[s : s + 512] = np.where(total > 0, (w * self.y[top]).sum(1) / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.axes is None:
            return np.full(len(texts), float(self.prior))
        out = np.empty(len(texts))
        for s in range(0, len(texts), 512):
            part = texts[s : s + 512]
            out[s : s + 512] = self.vote(self.project(np.stack([weighted(*terms(t), self.idf) for t in part])))
        return out


def axes_of(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from fixed random numbers."""
    q = np.random.default_rng(17).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, bound: int = 5000, rank: int = 48, neighbours: int = 15) -> Neighbours:
    rows = sample(docs, labels, label, modulus, held_out, bound)

    def count(it):
        for b in batches(it):
            got = [terms(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary()), b.column(1), b.column(2)], ["some", "share", "y", "doc_id"])

    got = mapped(rows.select("text", "y", "doc_id"), count, "some binary, share binary, y int, doc_id long").toPandas().sort_values(["doc_id", "some"])
    y = (got["y"].to_numpy() > 0).astype(float)
    model = Neighbours(float(y.mean()) if len(y) else 0.0, neighbours)
    if len(y) < 2 or len(set(y)) < 2:
        return model
    sparse = [(np.frombuffer(s, np.int32), np.frombuffer(v, "<f4")) for s, v in zip(got["some"], got["share"])]
    seen = np.bincount(np.concatenate([s for s, _ in sparse]), minlength=TERMS)
    model.idf = np.log((1 + len(y)) / (1 + seen)).astype(np.float32) + 1
    model.idf[: K**3] = 1
    x = np.stack([weighted(s, v, model.idf) for s, v in sparse])
    model.axes = axes_of(x, rank)
    model.vectors, model.y = model.project(x), y
    return model


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """doc_id, score."""

    def run(it):
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    return mapped(texts(docs), run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (crc(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
