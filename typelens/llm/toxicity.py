"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of learnt lexicons (whole words, word beginnings, both also after undoing obfuscation),
how often and how near lexicon words stand to the second person, shares of capitals, digits and punctuation marks,
rates of obfuscated words (digits or symbols inside, stretched letters, spelled-out words).  The lexicons are words and
word beginnings with high log-odds in the labelled sample; what the trees learn from is measured with lexicons of the
other folds, and the isotonic curve is fitted to rows that the trees haven't seen.

Fitting takes a bounded sample (``bound`` labelled rows, ``lexicon`` entries); scoring is a map over all whole texts with
the fitted model (at most about a megabyte) in the closure: no shuffle, nothing that grows with the corpus.

Defined results: a null text is an empty one; empty texts get the score of the feature vector of zeros; without
labels of both kinds every score is their mean (0 without labels); null doc_ids and repeated rows are scored like others; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, mapped, table, texts
from .labelled import crc, sample

EDGES = "\"'`.,;:!?()[]{}<>|/\\*#$%&@~^_-+=«»„“”‘’…¡¿"
#: Second person in English, German, French and Spanish (fixed values).
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
UNMASK = str.maketrans("013457@$!|", "oieastasil")
STEM = 4
NAMES = ["words", "stems", "unmasked", "weight", "hits", "second", "near", "nearest", "capitals", "all_caps", "exclaims", "questions", "other_marks", "digits", "inside", "stretched", "spelled"]
_INSIDE = re.compile(r"[^\W\d_][0-9@$*!|]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?:(?<=\s)|^)(?:\w[ .\-_*]){3,}\w(?=\s|$)")


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def lexicon_terms(text: str) -> set[tuple[int, str]]:
    """(0, word) and (1, word beginning) of a text, once each."""
    own = {w.translate(UNMASK) if not w.isalpha() else w for w in set(words_of(text)) if 2 < len(w) <= 40}
    return {(0, w) for w in own} | {(1, w[:STEM]) for w in own if len(w) > STEM}


def features(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    w = words_of(text)
    n, chars = max(len(w), 1), len(text)
    at, weight, whole, begin, masked = [], 0.0, 0, 0, 0
    for i, x in enumerate(w):
        if x in lexicon:
            at.append(i)
            whole += 1
            weight += lexicon[x]
        elif x[:STEM] in stems and len(x) > STEM:
            at.append(i)
            begin += 1
            weight += stems[x[:STEM]]
        elif x and not x.isalpha():
            y = x.translate(UNMASK)
            if y in lexicon or (len(y) > STEM and y[:STEM] in stems):
                at.append(i)
                masked += 1
    second = [i for i, x in enumerate(w) if x in SECOND]
    gaps = []
    if at and second:
        s = np.array(second)
        k = np.searchsorted(s, at)
        left, right = np.abs(s[np.maximum(k - 1, 0)] - at), np.abs(s[np.minimum(k, len(s) - 1)] - at)
        gaps = np.minimum(left, right).tolist()
    b = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    capitals, letters = int(b[65:91].sum()), int(b[65:91].sum() + b[97:123].sum())
    marks = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
    odd = int(b[48:58].sum() + b[64] + b[36] + b[42] + b[33] + b[124])
    return [
        whole / n, begin / n, masked / n, weight / n, float(len(at)), len(second) / n, sum(g <= 5 for g in gaps) / n, 1 / (1 + min(gaps)) if gaps else 0.0,
        capitals / max(letters, 1), sum(x.isupper() and len(x) > 2 for x in text.split()) / n if capitals * 4 > letters else 0.0,
        b[33] / chars, b[63] / chars, (marks - b[33] - b[63]) / chars, b[48:58].sum() / chars,
        len(_INSIDE.findall(text)) / n if odd else 0.0, len(_STRETCHED.findall(text)) / n, len(_SPELLED.findall(text)) / n,
    ]


class Trees:
    """Boosted regression trees on the logistic loss, splits at quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            feature, cut, value = np.full(2 ** (self.depth + 1), -1), np.zeros(2 ** (self.depth + 1)), np.zeros(2 ** (self.depth + 1))
            for k in range(2**self.depth - 1):
                own = np.flatnonzero(node == k)
                best = self._split(binned[own], g[own], h[own]) if len(own) > 1 else None
                if best:
                    f, b = best
                    feature[k], cut[k] = f, self.edges[f][b]
                    node[own] = 2 * k + 1 + (binned[own, f] > b)
            for k in np.unique(node):
                own = node == k
                value[k] = self.rate * g[own].sum() / (h[own].sum() + self.ridge)
            raw += value[node]
            self.trees.append((feature, cut, value))
        return self

    def _split(self, b, g, h):
        best, found = 1e-6, None
        whole = g.sum() ** 2 / (h.sum() + self.ridge)
        for f, e in enumerate(self.edges):
            if not len(e):
                continue
            gs = np.cumsum(np.bincount(b[:, f], g, len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(b[:, f], h, len(e) + 1))[:-1]
            ns = np.cumsum(np.bincount(b[:, f], minlength=len(e) + 1))[:-1]
            gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - whole
            gain[(ns < self.least) | (len(g) - ns < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (f, k)
        return found

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                goes = f >= 0
                node = np.where(goes, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw, probability), both ascending; each block is smoothed by half a case of each kind."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order], y[order]):
        blocks.append([r, r, v, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    x, p = [], []
    for lo, hi, s, n in blocks:
        x += [lo, hi]
        p += [(s + 0.5) / (n + 1)] * 2
    return np.array(x), np.maximum.accumulate(np.array(p))


class Model:
    def __init__(self, prior=0.0):
        self.prior, self.lexicon, self.stems, self.trees, self.knots = prior, {}, {}, None, None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.prior))
        x = np.array([features(t, self.lexicon, self.stems) for t in texts], float).reshape(len(texts), len(NAMES))
        raw = self.trees.raw(x)
        # a small share of the raw score keeps the order inside a calibrated block
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, bound: int = 24_000, lexicon: int = 4000, folds: int = 4, odds: float = 2.5) -> Model:
    """A model from about ``bound`` labelled rows; each row's features come from lexicons of the other folds."""
    rows = sample(docs, labels, label, modulus, held_out, bound)

    def terms(it):
        for b in batches(it):
            n: dict[tuple, list[int]] = {}
            for text, y, part in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for t in lexicon_terms(text):
                    n.setdefault((*t, part % folds), [0, 0])[y > 0] += 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([n[k][1] for k in keys], pa.int64()), pa.array([n[k][0] for k in keys], pa.int64())], ["kind", "term", "fold", "pos", "neg"])

    totals = np.zeros((folds, 2), np.int64)
    for r in rows.groupBy((F.col("part") % folds).alias("fold"), (F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["fold"], r["y"]] = r["n"]
    n_neg, n_pos = (int(x) for x in totals.sum(0))
    model = Model(n_pos / max(n_pos + n_neg, 1))
    if not n_pos or not n_neg:
        return model
    least = max(4, -(-n_pos // 100))
    each = mapped(rows.select("text", "y", "part"), terms, "kind int, term string, fold int, pos long, neg long").groupBy("kind", "term")
    counts = each.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(folds) for c in ("pos", "neg")])
    top = counts.filter(F.col("pos") >= least).withColumn("odds", F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)))
    top = top.filter(F.col("odds") >= odds).orderBy(F.desc("odds"), F.desc("pos"), "kind", "term").limit(lexicon).collect()  # at most ``lexicon`` rows

    def lists(without: int | None) -> tuple[dict, dict]:
        out: tuple[dict, dict] = {}, {}
        p, n = (n_pos, n_neg) if without is None else (n_pos - int(totals[without, 1]), n_neg - int(totals[without, 0]))
        for r in top:
            a, b = (r["pos"], r["neg"]) if without is None else (r["pos"] - r[f"pos{without}"], r["neg"] - r[f"neg{without}"])
            w = float(np.log((a + 0.5) / (p + 1)) - np.log((b + 0.5) / (n + 1)))
            if a >= max(2, least - 1) and w >= odds:
                out[r["kind"]][r["term"]] = w
        return out

    others = [lists(k) for k in range(folds)]
    model.lexicon, model.stems = lists(None)

    def measure(it):
        for b in batches(it):
            x = [features(t, *others[part % folds]) for t, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "part"])

    got = mapped(rows.select("text", "y", "part"), measure, "x array<double>, y int, part long").toPandas()
    x, y, part = np.array(got["x"].tolist()), (got["y"].to_numpy() > 0).astype(float), got["part"].to_numpy()
    order = np.lexsort([*x.T, y, part])  # the rows' order depends on the cluster
    x, y, part = x[order], y[order], part[order]
    a = part < 75
    if len(y) < 20 or a.all() or len(set(y[a])) < 2 or len(set(y[~a])) < 2:
        return model
    model.trees = Trees().fit(x[a], y[a])
    model.knots = isotonic(model.trees.raw(x[~a]), y[~a])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(it):
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    return mapped(texts(docs), run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is under the limit.

    Null and empty texts have the score of an empty one; null doc_ids and repeated rows are judged each on their own;
    columns may have any names.
    """
    at = docs.columns.index("text")
    names = ["text" if k == at else f"c{k}" for k in range(len(docs.columns))]  # a name with a dot is no column's to the map below
    schema = T.StructType([*[T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema)], T.StructField("score", T.DoubleType())])

    def run(it):
        for b in batches(it):
            scores = model.scores([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*names, "score"])

    return mapped(docs.toDF(*names), run, schema).filter(F.col("score") < limit).drop("score").toDF(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (crc(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
