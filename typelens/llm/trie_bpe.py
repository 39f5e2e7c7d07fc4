"""Byte-pair encoding by a trie of distinct words, and decoding.

For every prefix of a word, its encoding is the encoding of a shorter prefix and one more token: of the tokens that the
prefix ends with, exactly one stands after the last token of the prefix before it so that the two, joined and encoded
anew, come out as they are.  That token is the prefix's state.  Distinct words go into a trie whose nodes are prefixes;
words taken in sorted order visit it depth first, each new node gets its state from the nodes on the path to it, and a
node that several words share gets it once.  The ids of a word are read from its last node by following the states back.

The work is a map over rows: a Python worker keeps a trie, and a table of the ids of white-space-delimited pieces, over
the batches it gets; ids are put back by the pieces' positions.  Both are emptied when they reach a stated size, which
changes nothing but time.  Nothing is shuffled, and a lost executor's rows are simply done again.

Normalisation and the cut into words are those of the tokenizers file.  Texts of ASCII, white space and Latin letters up
to U+017F have a plain lower case and normal form and are cut here; all others are normalised and cut by the library,
and their words go into the same trie.  Strings of added tokens are ids of their own, cut out before all else.

Defined results: a null text is an empty one, with no ids; null ids decode to null; null doc_ids, repeated rows and
empty tables go through; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _byte_of, batches, mapped, packed, table, texts

END = "</w>"
#: A word's last symbol stands this far above the character that it would be elsewhere.
LAST = 0x10000
_KEPT: dict[str, "TrieBpe"] = {}


class WordTrie:
    """A trie over words of symbols (strings of one character each, the last one raised by LAST), with the last token of every prefix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        raised = lambda w: w[: -len(END) - 1] + chr(ord(w[-len(END) - 1]) + LAST) if w.endswith(END) and len(w) > len(END) else w
        self.ids = {raised(w): i for w, i in vocab.items()}
        self.word = {i: w for w, i in self.ids.items()}
        self.rank = {(raised(a), raised(b)): k for k, (a, b) in enumerate(merges)}
        self.heads = {w[:k] for w in self.ids for k in range(1, len(w) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.ends: dict[str, tuple[tuple[int, int], ...]] = {}
        self.clear()

    def clear(self) -> None:
        """Back to the root alone."""
        self.child: dict[int, int] = {}  # by node and symbol
        self.last, self.before, self.reach = array("i", [-1]), array("i", [0]), array("i", [0])

    def merged(self, symbols: str) -> list[str]:
        """The tokens of two short strings put together: the best-ranked pair is merged, the leftmost first, until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in itertools.pairwise(parts)]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the right token stays whole behind the left one (-1: at a word's beginning)."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            pair = [self.word[t] for t in (left, right) if t >= 0]
            known = self.fits[left, right] = self.merged("".join(pair)) == pair
        return known

    def tokens_at(self, head: str) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that the beginning of a token ends with, the longest first."""
        found = self.ends.get(head)
        if found is None:
            found = self.ends[head] = tuple((self.ids[head[-k:]], k) for k in range(len(head), 0, -1) if head[-k:] in self.ids)
        return found

    def grow(self, word: str, path: list[int], depth: int) -> int:
        """A new node for the first ``depth`` symbols of a word; ``path`` has the nodes above it."""
        reach, heads, last, fits = self.reach[path[-1]] + 1, self.heads, self.last, self.fits  # reach: of the longest end that a token begins with
        head = word[depth - reach : depth]
        while head and head not in heads:
            head = head[1:]
        for token, k in self.tokens_at(head):
            left = last[path[depth - k]]
            known = fits.get((left, token))
            if known or (known is None and self.follows(left, token)):
                last.append(token)
                self.before.append(path[depth - k])
                self.reach.append(len(head))
                return len(last) - 1
        raise ValueError("no token ends this prefix")

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words, which are visited in sorted order, so that the trie is walked depth first."""
        out, path, previous = {}, [0], ""
        for word in sorted(words):
            same = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                same += 1
            del path[same + 1 :]
            for depth in range(same + 1, len(word) + 1):
                edge = path[-1] << 20 | ord(word[depth - 1])
                node = self.child.get(edge)
                if node is None:
                    node = self.child[edge] = self.grow(word, path, depth)
                path.append(node)
            previous, node, ids = word, path[-1], []
            while node:
                ids.append(self.last[node])
                node = self.before[node]
            out[word] = ids[::-1]
        return out


class TrieBpe:
    """Texts to packed ids and back, for a tokenizers file of a byte-level BPE with word ends and no decoder."""

    def __init__(self, path: str, most_nodes: int = 800_000, most_pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocab = file["model"]["vocab"]
        self.tokens = {i: w for w, i in (vocab | added).items()}
        self.added = {w: packed([i]) for w, i in added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.trie = WordTrie({w: i for w, i in vocab.items() if w not in added}, [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]])
        self.letter = {b: c for c, b in _byte_of().items()}
        self.most_nodes, self.most_pieces = most_nodes, most_pieces
        self.plain = re.compile(r"[\x20-\x7e\t\n\r\x0b\x0cÀ-ſ]*").fullmatch
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ſ]+").findall
        self.pieces: dict[str, bytes] = {}

    def _symbols(self, word: str) -> str:
        """A word's bytes in the byte-level alphabet, the last one as a word's last symbol."""
        s = word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.letter.__getitem__, word.encode()))
        return s[:-1] + chr(ord(s[-1]) + LAST)

    def _words(self, symbols: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of words (as symbols), each distinct word taken through the trie once."""
        if len(self.trie.last) > self.most_nodes:
            self.trie.clear()
        known = self.trie.encode(list(dict.fromkeys(itertools.chain.from_iterable(symbols))))
        return [packed(itertools.chain.from_iterable(map(known.__getitem__, x))) for x in symbols]

    def _library_words(self, text: str) -> list[str]:
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [w[:-1] + chr(ord(w[-1]) + LAST) for w, _ in cut if w]

    def _plain_group(self, group: list[str]) -> list[bytes]:
        parts = list(map(str.split, group))
        flat = list(itertools.chain.from_iterable(parts))
        got = list(map(self.pieces.get, flat))
        if None in got:
            holes = [i for i, g in enumerate(got) if g is None]
            new = list(dict.fromkeys(flat[i] for i in holes))
            found = dict(zip(new, self._words([list(map(self._symbols, self.words(p.lower()))) for p in new])))
            for i in holes:
                got[i] = found[flat[i]]
            self.pieces.update((p, x) for p, x in found.items() if len(p) <= 32)
            if len(self.pieces) > self.most_pieces:
                for p in list(self.pieces)[self.most_pieces // 2 :]:
                    del self.pieces[p]
        ends = [0, *itertools.accumulate(map(len, parts))]
        return [b"".join(got[s:e]) for s, e in itertools.pairwise(ends)]

    def encode(self, group: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts: list[list] = []  # per text: packed ids, or the place of a stretch in one of the two lists below
        plain, others = [], []
        for t in group:
            row, at = [], 0
            for m in [*self.cut.finditer(t), None]:
                stretch = t[at : m.start() if m else len(t)]
                if stretch:
                    into = plain if self.plain(stretch) else others
                    row.append((into is plain, len(into)))
                    into.append(stretch)
                if m:
                    row.append(self.added[m[0]])
                    at = m.end()
            parts.append(row)
        done = {True: self._plain_group(plain), False: self._words(list(map(self._library_words, others)))}
        return [b"".join([x if isinstance(x, bytes) else done[x[0]][x[1]] for x in row]) for row in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens' own strings with one space between them, as a tokenizer without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def trie_bpe(path: str) -> TrieBpe:
    """The encoder of a file, kept by the Python worker."""
    if path not in _KEPT:
        _KEPT[path] = TrieBpe(path)
    return _KEPT[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit)."""

    def run(it):
        bpe = trie_bpe(path)
        for b in batches(it, 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encode(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return mapped(texts(docs), run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids) -> doc_id, ids, text."""

    def run(it):
        bpe = trie_bpe(path)
        for b in it:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                text = [None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return mapped(rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")), run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: ``decode`` of ``encode`` in one pass, so that a task has one Python worker instead of two."""

    def run(it):
        bpe = trie_bpe(path)
        for b in batches(it, 2_000_000):
            ids = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "text"])

    return mapped(texts(docs), run, "doc_id long, ids binary, text string")


def op11_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    rows = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
