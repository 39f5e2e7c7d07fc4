"""Helpers that several operators share: input frames, shared storage, shipping code, chunk tables."""

from __future__ import annotations

import array
import itertools
import json
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: How the strings of the added tokens of the vocabularies begin (fixed value).
ADDED = "<|"


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_typelens_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="typelens-"), "typelens_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(out)
    sc._typelens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = getattr(spark.sparkContext, "_typelens_shared", None) or tempfile.mkdtemp(prefix="typelens-shared-")
        spark.sparkContext._typelens_shared = conf
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/typelens-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there (lineage is cut).

    ``rows``, if known: how many it may have.  It is then written by one task for each ``per_file`` of them, not one for
    each partition of a shuffle: every file of a checkpoint starts processes (``chmod``) from the executor where Hadoop
    has no native library, and such a process has the executor's whole memory once more until it is another program.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty ones; other columns are left out, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def with_maps(df: DataFrame) -> list[str]:
    """Columns that hold a map somewhere: these have no order and no hash."""
    return [f.name for f in df.schema if "map<" in f.dataType.simpleString()]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, whatever their names; of those with maps their JSON text."""
    maps = set(with_maps(df))
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if c in maps else F.col(f"`{c}`") for c in df.columns])


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with the package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batches(it, max_chars: int = 8_000_000):
    """Cut Arrow batches so that a step holds about max_chars bytes of text at once (one text at least).

    Expects a string column named ``text``.
    """
    for b in it:
        n = b.num_rows
        if not n:
            continue
        if b.nbytes <= max_chars:
            yield b
            continue
        size = pc.binary_length(b.column(b.schema.get_field_index("text"))).to_pylist()
        start, held = 0, 0
        for i, x in enumerate(size):
            if held and held + (x or 0) > max_chars:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += x or 0
        yield b.slice(start)


class ChunkIds:
    """Ids of texts, each distinct chunk encoded once.

    A text is cut before single spaces that stand between two characters which are not white space;
    no token of the vocabularies used here reaches over such a place, so that the ids of the chunks in a
    row are the ids of the text.  ``encode`` gets a list of chunks and returns a list of id lists.
    ``lead`` is put before every chunk but the first (the space that belongs to the following chunk).
    The later half of a table of chunks is dropped when it holds ``most`` entries (common chunks come early),
    which bounds memory and changes nothing else.
    """

    def __init__(self, encode, lead: str, most: int = 400_000):
        self.encode, self.lead, self.most = encode, lead, most
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {} if lead else self.first

    @staticmethod
    def chunks(text: str) -> list[str]:
        parts = text.split(" ")
        if text.isprintable() and "  " not in text and text[:1] != " " and text[-1:] != " ":
            # no white space but single spaces (isprintable is false for all other white space)
            return parts
        for p in parts:
            if not p or p[0].isspace() or p[-1].isspace():
                break
        else:
            return parts
        out: list[str] = []
        for p in parts:
            if out and (not p or p[0].isspace() or not out[-1] or out[-1][-1].isspace()):
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        first, rest, lead = self.first, self.rest, self.lead
        for d in [first, *[rest] * (rest is not first)]:
            if len(d) > self.most:
                for c in list(d)[len(d) // 2 :]:
                    del d[c]
        out: list = []
        missing: dict[tuple[bool, str], None] = {}
        holes = []  # (text, place, chunk) still to be filled
        for k, t in enumerate(texts):
            if not t:
                out.append(b"")
                continue
            p = self.chunks(t)
            got = list(map(rest.get, p))
            got[0] = first.get(p[0])
            if None in got:
                for i, g in enumerate(got):
                    if g is None:
                        key = (i == 0 and rest is not first, p[i])
                        missing[key] = None
                        holes.append((k, i, key))
                out.append(got)
            else:
                out.append(b"".join(got))
        keys = list(missing)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            for (is_first, c), ids in zip(part, self.encode([c if is_first or not lead else lead + c for is_first, c in part])):
                (first if is_first else rest)[c] = missing[is_first, c] = packed(ids)
        for k, i, key in holes:
            out[k][i] = missing[key]
        return [x if isinstance(x, bytes) else b"".join(x) for x in out]


def packed(ids) -> bytes:
    return array.array("I", ids).tobytes()


_ENCODERS: dict[tuple, object] = {}


def _vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {w: i for w, i in json.load(f)["model"]["vocab"].items() if not w.startswith("<|")}


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def _ids(encoding, text: str) -> bytes:
    return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def byte_bpe(path: str):
    """Function from texts to packed ids for a byte-level BPE file of the tokenizers library.

    The texts go through tiktoken with the file's vocabulary, whose ids are the ranks of its merges: the same ids several
    times faster (tests hold them against the tokenizers library).  Texts that may hold the string of an added token go
    through the tokenizers library itself.
    """
    if (path, "byte") not in _ENCODERS:
        import tiktoken

        byte = _byte_of()
        ranks = {bytes(byte[c] for c in w): i for w, i in _vocabulary(path).items()}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        one = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        others = hf_chunks(path, " ")
        _ENCODERS[path, "byte"] = lambda texts: [_ids(one, t) if ADDED not in t else others([t])[0] for t in texts]
    return _ENCODERS[path, "byte"]


def word_bpe(path: str):
    """Function from texts to packed ids for a BPE file with word ends that drops white space and case.

    Texts of ASCII, white space and Latin letters up to U+017F, whose normal form and lower case are plain, are cut at white
    space, which no token reaches over.  Each different piece is cut into words, each ended by a control character that it
    doesn't hold, and these go through tiktoken, where that character stands for the word end (ids are ranks, a character
    with its word end has a smaller one than any merge, so the merges are the same).  The ids of short pieces are kept in
    a table of bounded size, as in ``ChunkIds``; the pieces of about 3 million characters are looked up once each (an Arrow
    dictionary) and their ids gathered from there.  All other texts go through the tokenizers library, those that may hold
    the string of an added token as they are.
    """
    if (path, "word") not in _ENCODERS:
        import tiktoken

        byte, end, mark = _byte_of(), "</w>", "\x01"
        ranks = {bytes(byte[c] for c in w.removesuffix(end)) + mark.encode() * w.endswith(end): i for w, i in _vocabulary(path).items()}
        one = tiktoken.Encoding("word", pat_str=f"[^{mark}]+{mark}", mergeable_ranks=ranks, special_tokens={})
        is_end = np.zeros(max(ranks.values()) + 1, bool)
        is_end[[i for w, i in ranks.items() if w.endswith(mark.encode())]] = True
        words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ſ]+").findall
        # the bytes of ASCII text and white space, and of U+00C0 to U+017F: three first bytes, any second
        allowed = bytes([*range(0x20, 0x7F), *b"\t\n\r\x0b\x0c", *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
        others = hf_chunks(path, "")
        known: dict[str, int] = {}  # numbers of pieces; piece k has the ids from ends[k] to ends[k + 1]
        ids, ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

        def add(pieces: list[str]) -> None:
            """Number new pieces and put their ids behind the others."""
            nonlocal ids, ends
            parts = list(map(str.lower, pieces))  # letters alone are one word
            sizes = np.ones(len(parts), np.int64)
            for i in np.flatnonzero(~np.fromiter(map(str.isalpha, parts), bool, len(parts))).tolist():
                own = words(parts[i])
                parts[i], sizes[i] = mark.join(own), len(own)
            flat = mark.join(parts) + mark  # a mark with no word before it has no id
            more = one.encode_to_numpy(flat, disallowed_special=()).astype("<u4")
            at = np.concatenate([[0], np.flatnonzero(is_end[more]) + 1])
            if len(at) != sizes.sum() + 1:
                raise ValueError("word ends and tokens disagree")
            known.update(zip(pieces, range(len(known), len(known) + len(pieces))))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + at[np.cumsum(sizes)]])

        def keep(n: int) -> None:
            """Forget all pieces but the first n."""
            nonlocal ids, ends
            for x in list(itertools.islice(known, n, None)):
                del known[x]
            ids, ends = ids[: ends[n]].copy(), ends[: n + 1].copy()

        def encode_group(texts: list[str]) -> list[bytes]:
            pieces = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
            coded = pieces.flatten().dictionary_encode()
            own = coded.dictionary.to_numpy(zero_copy_only=False)
            number = np.fromiter(map(known.get, own.tolist(), itertools.repeat(-1)), np.int32, len(own))
            holes = np.flatnonzero(number < 0)
            long = np.fromiter(map(len, own[holes]), np.int64, len(holes)) > 32
            holes, kept = holes[np.argsort(long, kind="stable")], len(known) + len(holes) - long.sum()
            number[holes] = np.arange(len(known), len(known) + len(holes))
            add(own[holes].tolist())
            k = number[coded.indices.to_numpy()]
            size = np.diff(ends).astype(np.int32)[k]
            to = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            raw = ids[np.repeat(ends[:-1][k] - to[:-1], size) + np.arange(to[-1])].tobytes()
            if kept < len(known):
                keep(kept)
            at = (4 * to[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]).tolist()
            return [raw[s:e] for s, e in zip(at, at[1:])]

        def encode(texts: list[str]) -> list[bytes]:
            out: list = [None] * len(texts)
            group, held = [], 0

            def close():
                nonlocal held
                if len(known) > 600_000:
                    keep(300_000)
                for i, x in zip(group, encode_group([texts[i] for i in group])):
                    out[i] = x
                group.clear()
                held = 0

            for k, t in enumerate(texts):
                if t.encode().translate(None, allowed) or ADDED in t:
                    out[k] = others([t])[0]
                    continue
                group.append(k)
                held += len(t)
                if held > 3_000_000:
                    close()
            if group:
                close()
            return out

        _ENCODERS[path, "word"] = encode
    return _ENCODERS[path, "word"]


def hf_chunks(path: str, lead: str):
    """Function from texts to packed ids by the chunk table of a tokenizers file, kept by the Python worker."""
    key = (path, lead)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        batch = getattr(t, "encode_batch_fast", t.encode_batch)
        table = ChunkIds(lambda x: [e.ids for e in batch(x, add_special_tokens=False)], lead)
        # the string of an added token may hold white space and takes some of its neighbours' with it: such texts are not cut
        _ENCODERS[key] = lambda texts: [packed(t.encode(x, add_special_tokens=False).ids) if ADDED in x else table([x])[0] for x in texts]
    return _ENCODERS[key]
