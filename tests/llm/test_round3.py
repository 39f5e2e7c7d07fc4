"""The trie encoder, the fill-in-middle transformation and the conversation trie against libraries and plain models."""

import hashlib
import random
import re
import struct
import zlib


import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from typelens.llm import exact_dedup, fill_middle, prefix_trie, simhash, substring, toxicity, trie_bpe

SCHEMA = "doc_id long, text string, ids string, n string, output long, r int"
PATH = P.path("word_bpe_49k.json")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_texts(n, seed):
    """Words, runs, marks and letters of many alphabets, strings of added tokens among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.randrange(5)
        if kind == 0:
            out.append("".join(rng.choice("abcdeilnost '\n") for _ in range(rng.randint(0, 200))))
        elif kind == 1:
            out.append("".join(rng.choice("aA1. <|endoftext|>éßİΣςσ́  日本") for _ in range(rng.randint(0, 60))))
        elif kind == 2:
            out.append("".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0x250, 0x3000), rng.randint(0x1F300, 0x1F700)])) for _ in range(rng.randint(0, 40))))
        elif kind == 3:
            out.append(rng.choice(["a", "ab", ".", "!?", "=", "lo", "ha"]) * rng.randint(1, 400))
        else:
            out.append(" ".join(rng.choice(["the", "<|startoftext|>", "they're", "O'Neil", "x<|endoftext|>y", "Straße", "...........", "don’t", "<S>", "3.14"]) for _ in range(rng.randint(0, 30))))
    return out


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(odd_texts(400, 7)))
    out += [(1000, None), (1001, ""), (1002, " \t\r\n"), (1003, out[4][1]), (1003, out[4][1]), (None, "null id"), (None, None), (-7, "below zero " * 3000), (2**60, "a" * 30_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA).withColumn("a.b", F.create_map(F.lit(1), F.lit(2))).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_trie_bpe(docs, rows, none):
    """The library's ids and its decoding of every text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = trie_bpe.round_trip(docs, PATH).collect()
    assert sorted([(r.doc_id, bytes(r.ids), r.text) for r in got], key=key) == sorted(want, key=key)
    two = trie_bpe.decode(trie_bpe.encode(docs, PATH), PATH).collect()
    assert sorted([(r.doc_id, bytes(r.ids), r.text) for r in two], key=key) == sorted(want, key=key)
    assert trie_bpe.round_trip(none, PATH).count() == 0
    gap = trie_bpe.decode(docs.select(F.lit(1).alias("doc_id"), F.lit(None).cast("binary").alias("ids")).limit(1), PATH).first()
    assert gap.text is None


def test_trie_is_bounded():
    """Emptied tables change no id; a new node is made once, whichever words share it."""
    group = odd_texts(200, 11)
    roomy, tight = trie_bpe.TrieBpe(PATH), trie_bpe.TrieBpe(PATH, most_nodes=50, most_pieces=20)
    assert [roomy.encode([t])[0] for t in group] == [tight.encode([t])[0] for t in group]
    assert len(tight.pieces) <= 20
    trie = roomy.trie
    trie.clear()
    last = lambda w: w[:-1] + chr(ord(w[-1]) + trie_bpe.LAST)
    trie.encode([last("running"), last("runner"), last("runn")])
    assert len(trie.last) - 1 == len("runn") + len("ing") + len("er") + 1


def model(i, text, seed=42, rate=50, spm=80):
    """The contract, step by step."""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (0, 0)])
def test_fill_middle(docs, rows, none, rate, spm):
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    want = sorted([(i, *model(i, t or "", 42, rate, spm)) for i, t in rows], key=key)
    full = fill_middle.restore(fill_middle.fill_middle(docs, 42, rate, spm)).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in full], key=key) == want
    assert all(r.restored == r.text for r in full)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = fill_middle.digests(docs, 42, rate, spm).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, set()).add(sha(t or ""))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for r in got], key=key) == sorted([(*w[:5], sha(w[5])) for w in want], key=key)
    assert all(r.restored_sha256 in text[r.doc_id] for r in got)
    assert fill_middle.digests(none).count() == 0
    forms = {w[2] for w in want}
    assert forms == {"plain"} if rate == 0 else forms == {"plain", "psm", "spm"}


def test_marks_at_the_cuts(spark):
    """Parts that end in pieces of a mark are rebuilt."""
    rows = [(i, t) for i, t in enumerate(["< <S <P <M < S> P> M>", "<S", "<<< S>S> <P", "M> <M <"] * 100)]
    got = fill_middle.restore(fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100)).collect()
    assert all(r.restored == r.text for r in got) and len({r.form for r in got}) == 2


def trie_model(rows, rebuild=True):
    """Nodes by prefix tuples."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32], (r, x)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:]) if rebuild else tuple(v)
    members, ends, children = {}, {}, {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], set()).add(c)
        ends.setdefault(v, []).append(c)
    for v in members:
        if v:
            children.setdefault(v[:-1], []).append(v)
    leaves, saved = {}, {}
    for v in sorted(members, key=len, reverse=True):
        kids = children.get(v, [])
        leaves[v] = sum(leaves[k] for k in kids) or 1
        saved[v] = sum(saved[k] for k in kids) + ((len(members[v]) - 1) * len(v[-1][1].encode()) if v else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        [(min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(children.get(v, [])), leaves[v], saved[v], sha(ends.get(v, []))) for v, m in members.items()], key=str
    )


CONVS = "conv_id long, turn int, role string, text string, head long, k1 long, up string"


def conversations(kind):
    rng = random.Random(kind)
    if kind == "mixed":  # few different turns, so that prefixes are shared at all depths; nulls; repeated rows; a gap in the numbers
        rows = [(c, t if rng.random() < 0.97 else None, rng.choice(["u", "a", None, ""]), rng.choice(["x", "yé", None, ""])) for c in range(200) if c % 11 for t in range(rng.randint(0, 9))]
        return rows + rows[:40] + [(None, 0, "u", "lost"), (10**15, 3, "u", "x")]
    if kind == "one":
        return [(7, 0, "u", "x")]
    if kind == "copies":  # a group of copies, one of them longer, and a turn that many begin with
        return [(5 * c, t, "u", f"t{t}" if c % 3 else f"s{t and c}") for c in range(150) for t in range(6)] + [(5, 6, "u", "more")]
    # long ones: a heavy path over several blocks, with a branch in each; a conversation that holds most rows
    rows = [(c, t, "u", f"w{t if t < 7 * c else (c, t)}") for c in range(5, 40, 5) for t in range(40)]
    return rows + [(50, t, "u", f"w{t}") for t in range(300)] + [(55, t, "u", f"w{t}") for t in range(290)]


@pytest.mark.parametrize("kind, block", [("mixed", 4096), ("mixed", 2), ("one", 4096), ("copies", 4096), ("long", 4096), ("long", 8)])
def test_prefix_trie(spark, monkeypatch, kind, block):
    """The rebuilt trie against tuples, in blocks of any size, and the plain trie of conversations as they are."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(kind)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CONVS).withColumn("a.b", F.create_map(F.lit(1), F.lit(2))).repartition(3)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df))
    assert sorted([tuple(r) for r in got.select(*prefix_trie.COLUMNS).collect()], key=str) == trie_model(rows)
    con = duckdb.connect()
    pdf = df.drop("a.b").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", pdf)
    assert sorted(con.execute(prefix_trie.SQL).fetchall(), key=str) == trie_model(rows)
    if block == 4096:
        turns = prefix_trie.numbered(df)
        plain = prefix_trie.prefix_trie(turns.withColumn("depth", F.col("place") + 1).drop("place"), prefix_trie.sizes(turns))
        assert sorted([tuple(r) for r in plain.select(*prefix_trie.COLUMNS).collect()], key=str) == trie_model(rows, rebuild=False)
        level = plain.agg(F.max("level")).first()[0]
        assert 2**level <= len({r[0] for r in rows})


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], CONVS)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).count() == 0


def test_turnless_conversation(spark):
    """Conversations whose base is absent lose their first turns; those without any left are members of the root alone."""
    rows = [(c, 0, "u", "x") for c in range(1, 60) if c % 5]
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CONVS)))
    want = trie_model(rows)
    assert sorted([tuple(r) for r in got.select(*prefix_trie.COLUMNS).collect()], key=str) == want and want[0][3] > want[1][3]


ODD = "doc_id long, text string, `a.b` string, score map<string,int>, row struct<x:map<int,int>>"


def test_stages_with_odd_columns(spark):
    """Columns with dots and maps go through every stage that keeps columns; repeated rows and nulls too."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, "p", {"k": 1}, ({1: 2},)), (2, long, "q", None, None), (3, long + " end", None, {}, ({},)), (3, long + " end", None, {}, ({},)), (4, None, "r", {"a": 2, "b": 3}, (None,)), (None, "", "s", None, None)]
    docs = spark.createDataFrame(rows, ODD)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    for stage, left in ((lambda d: toxicity.reject(d, model), 6), (exact_dedup.keep_first, 3), (simhash.keep_one_of_near, 2), (substring.remove_spans, 6)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == left
        assert {(r["doc_id"], r["a.b"], str(r["score"])) for r in got} <= {(r[0], r[2], str(r[3])) for r in rows}
