"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns, brute force."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from typelens.llm import exact_dedup, fingerprint, idfiles, packing, quality, sentencepieces, simhash, substring, toxicity, warc
from typelens.llm.common import byte_bpe, scratch, word_bpe
from typelens.llm.idcoder import Prior, decode, encode

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, block string, node long, start string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    long = " ".join(rng.choice(vocab) for _ in range(4000))
    out += [(100, None), (101, ""), (102, " \t\n"), (103, out[3][1]), (104, out[3][1].replace(" ", "\n", 2)), (105, "Ａ ﬁ É"), (106, "a fi é"), (107, long), (108, "x " + long[:9000]), (108, "again " + long[500:3000]), (None, out[3][1]), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "s") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, rows, empty):
    got = {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for r in exact_dedup.exact_groups(docs).collect():
        got.setdefault(r["text_sha256"], []).append((r["doc_id"], r["keep_id"], r["group_size"]))
    want = {}
    for i, t in rows:
        want.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    assert {k: sorted(x[0] for x in v if x[0] is not None) for k, v in got.items()} == {k: sorted(i for i in v if i is not None) for k, v in want.items()}
    for k, v in got.items():
        ids = [i for i in want[k] if i is not None]
        assert {x[1:] for x in v} == {(min(ids) if ids else None, len(want[k]))}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_fingerprint(docs, rows, empty):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").lower())).strip(" ")
    seed = xxhash.xxh64_intdigest((fingerprint._SALT % 2**64).to_bytes(8, "little"), 42)
    for i, t in rows:
        if i is not None and i != 108:
            c = canon(t).encode()
            assert got[i] == f"{xxhash.xxh64_intdigest(c, 42):016x}{xxhash.xxh64_intdigest(c, seed):016x}"
    assert got[3] == got[103] == got[104] and got[100] == got[101] == got[102] and got[105] == got[106]
    nxt = {r["doc_id"]: r["next_text"] for r in fingerprint.edited_texts(docs.filter("doc_id < 108")).collect()}
    order = sorted(i for i, _ in rows if i is not None and i < 108)
    text = {i: t or "" for i, t in rows}
    assert all(nxt[a] == text[b] for a, b in zip(order, order[1:] + order[:1]))
    assert fingerprint.fingerprints(empty).count() == 0


def brute_windows(rows, n):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            m = first.get(tuple(w[k : k + n]))
            if m is not None and (i is None or m < i):
                keep[k : k + n] = [False] * n
        out.append((i, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep) if y).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, bits, block", [(3, 64, 600), (13, 64, 600), (3, 6, 600), (3, 0, 3000), (13, 4, 1), (5, 64, 10**9)])
def test_substring(docs, rows, empty, n, bits, block):
    """Against brute force, with weak hashes too: other words under one hash, in a block and between blocks."""
    spans = substring.duplicate_spans(docs, words=n, block_bytes=block, hash_bits=bits)
    got = spans.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_windows(rows, n)
    words = {}
    for i, t in rows:
        words.setdefault(i, []).append(WORDS.findall(t or ""))
    for r in got:  # a span is a factor: its words stand at its place in its reference
        for x in r["spans"]:
            assert r["doc_id"] is None or x["doc"] < r["doc_id"]
            piece = lambda i, s: [w[s : s + x["words"]] for w in words[i]]
            assert x["words"] >= n and any(a == b and len(a) == x["words"] for a in piece(r["doc_id"], x["start"]) for b in piece(x["doc"], x["at"]))
    if bits == 64 and block < 10**9:
        cut = substring.remove_spans(docs, words=n, block_bytes=block)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        text = {r["doc_id"]: r["text"] for r in cut.collect()}
        kept = {i: h for i, _, _, h in brute_windows([r for r in rows if r[0] not in (None, 108)], n)}
        assert all(hashlib.sha256(" ".join(WORDS.findall(text[i] or "")).encode()).hexdigest() == h for i, h in kept.items())
        assert substring.duplicate_spans(empty).count() == 0 == substring.remove_spans(empty).count()


def test_substring_tells_words_apart(spark):
    """Two words that any polynomial modulo 2**64 hashes alike: a Thue-Morse word and its complement."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{word} {tail}"), (2**62, f"{other} {tail}"), (-(2**62), f"{tail} {word}"), (3, f"{word} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.duplicate_spans(docs, block_bytes=100).collect()} == {1: 0, 2**62: 0, -(2**62): 0, 3: 13}


def brute_simhash(t, n=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORDS.findall(t)
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [32_768, 4])
def test_near_links(spark, cap):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(rng.choice([1, 1, 30]))}
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x, x, 0, 0) for x in signed], "node long, fp long, v1 long, v2 long")
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(pairs):
        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return [root(x) for x in range(len(fps))]

    want = join((a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3)
    up[:] = range(len(fps))
    at = {x: k for k, x in enumerate(signed)}
    links = simhash.near_links(nodes, 3, cap=cap).collect()
    assert all((fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() >= 0 for r in links)
    assert join((at[r["a"]], at[r["b"]]) for r in links) == want


def test_simhash(docs, rows, empty):
    got = simhash.near_groups(docs)
    fp = {r["doc_id"]: r["fp"] % 2**64 for r in got.collect()}
    assert all(fp[i] == brute_simhash(t) for i, t in rows if i not in (None, 108))
    comp = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert comp[103] == comp[104] == 3 and comp[101] == comp[100] == 100
    kept = simhash.keep_one_of_near(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and 3 in ids and 103 not in ids and 107 in ids
    assert simhash.near_groups(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = 64
    items = packing.pieces(docs, P.path("byte_bpe_50k.json"), size=size)
    out = packing.pack(items, size=size, leaf=20).collect()
    total = 0
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        if i not in (None, 108):
            assert [r["length"] for r in own][1:] == [size] * (len(own) - 1) and sum(r["length"] for r in own) == len(ids)
            assert all(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    assert sum(n for v in bins.values() for _, n in v) == total and len(bins) <= -(-total // size) + 3
    assert packing.pack(packing.pieces(empty, P.path("byte_bpe_50k.json"))).count() == 0


def check_bins(out, size):
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in bins.values():
        ends = list(itertools.accumulate([0, *[n for _, n in sorted(v)]]))
        assert [o for o, _ in sorted(v)] == ends[:-1] and ends[-1] <= size
    return len(bins)


def test_packing_over_levels(spark):
    """Many small leaves: pieces of all sizes end in few bins; large pieces that fit into nothing end the levels; equal rows are spread."""
    rng = random.Random(2)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    lengths = [rng.randint(1, 63) for _ in range(3000)]
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], schema)
    out = packing.pack(items, size=64, leaf=100).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000)) and check_bins(out, 64) <= 1.06 * sum(lengths) / 64
    assert check_bins(packing.pack(items, size=64).collect(), 64) <= 1.02 * sum(lengths) / 64  # one leaf
    same = spark.createDataFrame([(7, 0, 0, 40, 0)] * 500 + [(None, 0, 0, 20, 0)] * 500 + [(8, 0, 0, 64, 0)] * 3, schema)
    out = packing.pack(same, size=64, leaf=50).collect()
    assert len(out) == 1003 and check_bins(out, 64) <= 520
    big = spark.createDataFrame([(i, 0, 0, 40, 0) for i in range(2000)], schema)
    assert check_bins(packing.pack(big, size=64, leaf=50).collect(), 64) == 2000


def test_tokenizers_agree():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alpha = ["a", "B", " ", "  ", "\n", "é", "́", "'s", "'", ".", "1", "Σ", "\xa0", "\x85", "日", "🙂", "İ", "\x00", "\x01", "ſ", "×", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "'S"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for name, fn in (("byte_bpe_50k.json", byte_bpe), ("word_bpe_49k.json", word_bpe)):
        want = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in fn(P.path(name))(texts)] == want


def test_sentencepiece(docs, rows, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()}
    assert sorted(map(str, sentencepieces.round_trip(docs, path).collect())) == sorted(map(str, sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()))
    assert sentencepieces.round_trip(empty, path).count() == 0
    for i, t in rows:
        if i not in (None, 108):
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["text"] == sp.decode(ids)
    _, fn = sentencepieces.model(path)
    odd = ["a ▁b", "a▁ b", " a", "a ", "a  b", "▁", "\n a", "a　b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in fn(odd)] == sp.encode(odd)
    assert sentencepieces.encode(empty, path).count() == 0


def test_idcoder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, h, n).astype(np.uint16) for h, n in ((65536, 700), (3, 3000), (1, 50), (65536, 0), (400, 1), (65536, 40_000))]
    blocks += [np.repeat(np.arange(60, dtype=np.uint16), 50), np.zeros(0, np.uint16)]
    prior = Prior.of(blocks)
    again = Prior.load(prior.dump())
    coded = encode(blocks, prior)
    assert all((a == b).all() for a, b in zip(blocks, decode(coded, [len(b) for b in blocks], again)))
    alone = [decode([c], [len(b)], again)[0] for b, c in zip(blocks, coded)]  # no block needs another
    assert all((a == b).all() for a, b in zip(blocks, alone))
    assert len(coded[6]) < 700 and Prior.of([]).dump() and encode([], prior) == [] == decode([], [], prior)


def test_idcoder_is_smaller_than_zlib():
    texts = [r[0] or "" for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    ids = np.frombuffer(b"".join(word_bpe(P.path("word_bpe_49k.json"))(texts)), "<u4").astype(np.uint16)
    blocks = [ids[k : k + idfiles.BLOCK] for k in range(0, len(ids), idfiles.BLOCK)]
    prior = Prior.of(blocks)
    ours, theirs = [len(x) for x in encode(blocks, prior)], [len(zlib.compress(x.tobytes(), 9)) for x in blocks]
    assert sum(ours) + len(prior.dump()) < 0.8 * sum(theirs)
    assert sum(a < b for a, b in zip(ours, theirs)) > 0.97 * len(blocks)
    share = np.bincount(ids) / len(ids)
    assert sum(ours) * 8 < -(share[share > 0] * np.log2(share[share > 0])).sum() * len(ids)  # less than the ids' entropy without context


def test_idfiles(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = idfiles.write_ids(docs, P.path("word_bpe_49k.json"), scratch(spark, "t"))
    got = idfiles.offsets(idfiles.read_ids(spark, path).withColumn("n", F.octet_length("ids") / 4)).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n"]
    text = dict(rows)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == t.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [1] for r in got if r["doc_id"] not in (None, 108))
    assert len(got) == len(rows)
    first, block = (r["data"] for r in spark.read.parquet(path).orderBy("file", "block").limit(2).collect())
    prior = idfiles.unpack_prior(first)
    assert len(idfiles.unpack_blocks([block], prior)) == 1
    for bad in (block[:-1], block[:8] + b"\0\0\0\0" + block[12:]):
        with pytest.raises(ValueError):
            idfiles.unpack_blocks([bad], prior)
    with pytest.raises(ValueError):
        idfiles.unpack_blocks([block], None)
    with pytest.raises(ValueError):
        idfiles.unpack_prior(first[:-1])
    repeated = {i: sorted(x for j, x in rows if j == i) for i in (108,)} | {None: sorted(x or "" for j, x in rows if j is None)}
    for i, all_texts in repeated.items():
        own = [np.frombuffer(r["ids"], "<u4").tolist() for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] == i]
        assert own == [t.encode(x, add_special_tokens=False).ids + [1] for x in all_texts]
    assert max(r["start"] for r in got if r["doc_id"] is not None) < min(r["start"] for r in got if r["doc_id"] is None)
    assert idfiles.read_ids(spark, idfiles.write_ids(empty, P.path("word_bpe_49k.json"), scratch(spark, "e"))).count() == 0


def test_warc(spark, empty):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "b\r\nc", "x"), (3, None, None), (4, "d", ""), (None, "e", "x"), (5, "f", "y")], "page_id long, url string, html string")
    a = warc.write_archive(pages, buckets=3)
    got = {r["page_id"]: r for r in warc.read_archive(a).collect()}
    assert spark.table(a.payloads).count() == 3 and bytes(got[1]["payload"]) == b"x" and bytes(got[3]["payload"]) == b""
    assert "WARC-Type: revisit" in got[1]["header"] and "WARC-Type: response" in got[2]["header"] and "WARC-Refers-To: <urn:page:2:" in got[1]["header"]
    raw = warc.read_archive(a).select("page_id", warc.record_bytes(F.col("header"), F.col("payload")).alias("r")).collect()
    assert all(bytes(r["r"]).startswith(b"WARC/1.1\r\n") and bytes(r["r"]).endswith(b"\r\n\r\n") for r in raw)
    warc.drop_archive(a)
    small = warc.write_archive(pages, least_bytes=2, buckets=3)
    assert all("WARC-Type: response" in r["header"] for r in warc.read_archive(small).collect())
    warc.drop_archive(small)


def test_warc_with_hostile_pages(spark, tmp_path):
    """Urls that look like header lines, repeated pages, long payloads; records name each other by ids that exist."""
    evil = "http://x/ WARC-Refers-To: <urn:page:99:0123456789abcdef>"
    long = "é" * 300_000
    rows = [(1, evil, "a"), (2, f"u\r\nWARC-Type: revisit\r\n{evil}\r\n\r\n", "b"), (3, f"u\x85WARC-Type: revisit\u2028{evil}", "c"), (4, "l", long), (5, "m", long), (6, "p", "d"), (6, "q", "d"), (5, "r", "d"), (7, "s", None), (8, "t", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.op6_warc(spark, str(tmp_path)).collect())
    assert got == [(1, "response", None, 1), (2, "response", None, 1), (3, "response", None, 1), (4, "revisit", 5, 600_000), (5, "response", None, 600_000), (5, "revisit", 6, 1), (6, "response", None, 1), (6, "response", None, 1), (7, "revisit", 8, 0), (8, "response", None, 0)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tl_warc")]
    a = warc.write_archive(spark.read.parquet(f"{tmp_path}/pages.parquet"), date="2020-01-02T03:04:05Z")
    heads = [r["header"] for r in warc.read_archive(a).collect()]
    ids = re.findall("WARC-Record-ID: (<[^>]*>)\r\n", "".join(heads))
    assert len(set(ids)) == len(rows) and {x for h in heads for x in re.findall("\r\nWARC-Refers-To: (<[^>]*>)\r\nWARC-P", h)} <= set(ids)
    for h in heads:
        lines = h.split("\r\n")
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""] and "WARC-Date: 2020-01-02T03:04:05Z" in lines and all(re.match(r"[A-Za-z-]+: ", x) for x in lines[1:-2])
    warc.drop_archive(a)


@pytest.mark.parametrize("module, label, hold", [(toxicity, "toxic", 0), (quality, "quality", 2)])
def test_classifiers(spark, docs, empty, module, label, hold):
    d = "/root/testdata/sf0.01"
    model = module.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    s = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert all(0 <= x <= 1 for x in s.values()) and s[100] == s[101]
    name = "op10_toxicity" if label == "toxic" else "op4_quality"
    out = getattr(module, name)(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (out["predicted"] == out[label]).mean() > 0.85
    none = module.fit(empty, spark.createDataFrame([], f"doc_id long, {label} int"))
    assert {r["score"] for r in module.score(docs, none).collect()} == {0.0}
    assert module.score(empty, model).count() == 0


def brute_cut(rows, n):
    """The texts without words that a window which a smaller doc_id has covers, and without the white space behind them."""
    first = {}
    for i, t in sorted(rows):
        w = WORDS.findall(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in rows:
        w = WORDS.findall(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        lead, *_ = re.split("[^\x20\x09-\x0d]", t, maxsplit=1)
        out[i] = (lead if 0 not in gone else "") + "".join(x for k, x in enumerate(re.findall("[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", t)) if k not in gone)
    return out


def test_pipeline(spark, tmp_path):
    """run() against every stage done by hand, on documents with exact and near copies, shared passages and toxic ones."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet").limit(600)
    pairs = near_copies(8, ("truncated", "appended", "block", "scattered"), 0.7, 0.95, n=8)
    passage = " ".join(f"q{k}" for k in range(70))
    more = [x for i, p in enumerate(pairs) for x in ((10**6 + 2 * i, p[0]), (10**6 + 2 * i + 1, p[1]))]
    more += [(2 * 10**6 + i, f"start {i} {i} {passage}\n end {i}") for i in range(5)] + [(3 * 10**6, pairs[0][0].replace(" ", "  ")), (3 * 10**6 + 1, None), (3 * 10**6 + 2, " ")]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")

    rows = sorted((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect())
    model = toxicity.fit(table, labels)
    calm = [(i, t) for (i, t), x in zip(rows, model.scores([t for _, t in rows])) if x < 0.5]
    first = {}
    for i, t in calm:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), (i, t))
    single = sorted(first.values())
    root = {i: i for i, _ in single}
    sets = {i: {tuple(w[k : k + 5]) for w in [WORDS.findall(t.lower())] for k in range(max(len(w) - 4, 1))} for i, t in single}
    for k, (i, t) in enumerate(single):
        for j, u in single[:k]:
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    cut = brute_cut([(i, t) for i, t in single if root[i] == i], 50)
    assert len(rows) > len(calm) > len(single) > len(cut) and any(t != cut[i] for i, t in single if i in cut)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in cut.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    out = C.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    assert check_bins(out, 1024) <= 1.03 * sum(x[3] for x in want) / 1024 + 1


def test_stages_with_odd_rows(spark, docs, empty):
    """Clashing names, repeated rows, nulls and empty tables in every stage."""
    import corpus_pipeline as C

    names = ["_tl_row", "_r", "_d", "score", "score_", "row", "tag", "norm", "h1", "copies", "root", "key", "rest", "bits"]
    odd = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d  e f g"), (None, None), (4, None), (5, ""), (None, "x y z")], "doc_id long, text string")
    odd = odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    model = toxicity.Model(0.1)
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == 7 and toxicity.reject(odd, toxicity.Model(0.9)).count() == 0
    for stage, ids in ((C.drop_copies, [1, 4, None]), (C.drop_near_copies, [1, 4, None]), (C.cut_repeats, [1, 1, 2, 4, 5, None, None])):
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is None, x)) == ids
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())
        assert stage(spark, odd.limit(0), "").count() == 0
    assert C.pack(spark, odd, "").count() == 7 and C.pack(spark, odd.limit(0), "").count() == 0


def brute_jaccard(x, y):
    own = lambda t: {tuple(w[k : k + 5]) for w in [WORDS.findall(t.lower())] for k in range(max(len(w) - 4, 1))}
    a, b = own(x), own(y)
    return len(a & b) / len(a | b)


def near_copies(seed, kinds, least, most, n=40, passage=()):
    """Pairs (text, changed text) with a Jaccard similarity in [least, most)."""
    rng, out = np.random.default_rng(seed), []
    word = lambda k: [f"w{x}" for x in np.minimum(rng.zipf(1.2, k), 20_000)]
    while len(out) < n * len(kinds):
        a, kind = [*passage, *word(int(rng.choice([60, 200, 800])))], kinds[len(out) % len(kinds)]
        k = int(len(a) * rng.uniform(0.02, 0.3))
        at = int(rng.integers(0, len(a) - k))
        b = {"truncated": a[: len(a) - k], "appended": a + word(k), "block": a[:at] + word(k) + a[at + k :]}.get(kind) or [f"z{i}" if rng.random() < 0.05 else x for i, x in enumerate(a)]
        if least <= brute_jaccard(" ".join(a), " ".join(b)) < most:
            out.append((" ".join(a), " ".join(b)))
    return out


@pytest.mark.parametrize("passage, settings", [((), {}), (tuple(f"p{k}" for k in range(60)), {"cap": 6, "one_in": 1}), (tuple(f"p{k}" for k in range(60)), {"cap": 6, "often": 10**6})])
def test_near_copies_are_found(spark, passage, settings):
    pairs = near_copies(3, ("truncated", "appended", "block"), 0.8, 0.9, passage=passage)
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_of_near(docs, **settings).collect()}
    assert kept == {2 * i for i in range(len(pairs))}


def test_no_copies_below_the_similarity(spark):
    pairs = near_copies(4, ("truncated", "appended", "block", "scattered"), 0.6, 0.8, n=15)
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    assert simhash.keep_one_of_near(docs).count() == 2 * len(pairs)
    edge = [" ".join(f"w{k}" for k in range(n)) for n in (94, 76, 75)]  # 90, 72 and 71 shingles: 72 of 90 is 0.8, 71 of 90 is less
    for texts, n in ((edge[:2], 1), (edge[::2], 2)):
        assert simhash.keep_one_of_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == n
