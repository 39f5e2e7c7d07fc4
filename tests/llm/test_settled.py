"""Frames of known size are settled in few files, whatever the number of shuffle partitions; the word tokeniser and the coder's tables."""

import glob
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from typelens.llm import components as C
from typelens.llm import simhash
from typelens.llm.common import packed, settle, shared_dir, word_bpe
from typelens.llm.idcoder import CONF, Lanes, Prior


@pytest.fixture
def many(spark):
    """60 shuffle partitions that adaptive execution doesn't put together."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def files(spark):
    return len(glob.glob(shared_dir(spark).removeprefix("file://") + "/*/rdd-*/part-*"))


def test_components_write_few_files(many):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    links = settle(many.createDataFrame(pairs, "a long, b long"))
    before = files(many)
    roots = {r["node"]: r["root"] for r in C.components(links).collect()}
    assert 0 < files(many) - before <= 20
    up = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert [roots.get(x, x) for x in range(400)] == up


def test_near_copies_write_few_files(many):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(12)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:110] + ["other"] + w[111:]) for w in base]
    docs = many.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    before = files(many)
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_near(docs).collect()) == list(range(12))
    assert files(many) - before <= 60 + 40  # the buckets of the prefixes are one file for each partition


def test_word_pieces_are_encoded_like_the_library_does():
    """Pieces known, new, long, without words and of other alphabets, one after another, and the same ids when all are known."""
    path = P.path("word_bpe_49k.json")
    rng = random.Random(7)
    texts = ["", " ", " a ", "\n\x0b\x0c a\r\tb", "İstanbul ISS", "é" * 50 + " x", "x" * 100 + " y " + "z" * 40, "a×b÷c", "it's they'LL 3.14", "\x1c a", "日本 a", "<|x|>", "a\xa0b"]
    texts += ["".join(rng.choice("aA1.' \n\tßÀſ×İ~<|") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    library = Tokenizer.from_file(path)
    want = [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    encode = word_bpe(path)
    assert encode(texts) == want and encode(texts[::-1]) == want[::-1] and encode([]) == []


def test_coder_tables_move_as_stated():
    """An id that was right gains confidence (3 at most), another loses it, one without any is replaced."""
    ids = [7, 9]
    m = Lanes(8, Prior.of([np.array(ids, np.uint16)]))
    m.predict()
    m.t1[m.at1], m.t2[m.at2] = [id + c * CONF for id in ids for c in range(4)], [id + c * CONF for id in ids for c in range(4)]
    at1, at2, _ = m.at1, m.at2, m.predict()
    m.seen(np.full(8, 7, np.int32))
    want = [7 + c * CONF for c in (1, 2, 3, 3)] + [7] + [9 + c * CONF for c in (0, 1, 2)]
    assert m.t1[at1].tolist() == want and m.t2[at2].tolist() == want
