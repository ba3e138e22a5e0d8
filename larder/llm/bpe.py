"""BPE with word ends: segment trees over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import byte_column, read, vocabulary

NONE = np.iinfo(np.int32).max
CACHE = 250_000  # words a worker remembers; forgotten all at once when full
LONG = 64  # symbols from which a word gets a tree of its own


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if it is printable, else the next from 256 on."""
    own = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizers file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = dict(model["vocab"]), model["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: x.encode() for x, i in [*vocab.items(), *self.added.items()]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + self.suffix] for x in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int32)
        self.known: dict[bytes, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where the vocabulary has no merge."""
        want = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def split(self, word: bytes) -> list[bytes | int]:
        """A word between white space as pieces that merge on their own; added tokens as ids."""
        if word.isalpha():  # ASCII letters
            return [word.lower()]
        text, out, at = word.decode("utf-8", "replace"), [], 0
        for m in [*self.special.finditer(text), None] if "<" in text else [None]:
            part = text[at : m.start() if m else None]
            if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            # letter by letter: a final sigma has no form of its own here
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            out += [x.encode() for x in self.pieces.findall(part)]
            if m:
                out.append(self.added[m[0]])
                at = m.end()
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (little-endian, 32 bits). Pieces of about one length share one array of trees."""
        out = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for size in (1, 2, 4, 8, 16, 32, LONG):
            for rows in np.array_split(own := np.flatnonzero((lengths <= size) & (lengths > size // 2)), max(1, len(own) * size // 500_000)):
                if len(rows):
                    ids, keep = self._forest([pieces[i] for i in rows], lengths[rows], size)
                    flat, start = ids[keep].astype("<u4").tobytes(), 0
                    for i, end in zip(rows.tolist(), (4 * np.cumsum(keep.sum(1))).tolist(), strict=True):
                        out[i], start = flat[start:end], end
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._tree(pieces[i]).astype("<u4").tobytes()
        return out

    def _symbols(self, piece: bytes) -> np.ndarray:
        b = np.frombuffer(piece, np.uint8)
        ids = self.inner[b]
        ids[-1] = self.final[b[-1]]
        return ids

    def _forest(self, pieces: list[bytes], length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One tree a piece, all in one array; each step merges the leftmost lowest pair of every piece that still has one."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(n, size)
        sym = self.inner[raw]
        sym[np.arange(n), length - 1] = self.final[raw[np.arange(n), length - 1]]
        there = np.arange(size) < length[:, None]
        if size == 1:
            return sym, there
        nxt = np.tile(np.arange(1, size + 1), (n, 1))
        prv = np.tile(np.arange(-1, size), (n, 1))  # one column more: the end's
        tree = np.full((n, 2 * size), NONE, np.int32)
        tree[:, size : 2 * size - 1] = np.where(there[:, 1:], self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, size - 1), NONE)
        for a in [size >> k for k in range(1, size.bit_length())]:
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        levels = size.bit_length() - 1
        w = np.flatnonzero(tree[:, 1] != NONE)
        while len(w):
            root, node = tree[w, 1], np.ones(len(w), np.int64)
            for _ in range(levels):
                node = 2 * node + (tree[w, 2 * node] != root)
            i = node - size
            j = nxt[w, i]
            k, p = nxt[w, j], prv[w, i]
            sym[w, i], nxt[w, i], there[w, j] = self.made[root], k, False
            prv[w, k] = i
            more = k < length[w]
            tree[w, size + i] = np.where(more, self.ranks(sym[w, i], sym[w, np.where(more, k, 0)]), NONE)
            tree[w, size + j] = NONE
            has = p >= 0
            p = np.where(has, p, i)
            tree[w, size + p] = np.where(has, self.ranks(sym[w, p], sym[w, i]), tree[w, size + p])
            for leaf in (size + i, size + j, size + p):
                for _ in range(levels):
                    leaf >>= 1
                    tree[w, leaf] = np.minimum(tree[w, 2 * leaf], tree[w, 2 * leaf + 1])
            w = w[tree[w, 1] != NONE]
        return sym, there

    def _tree(self, piece: bytes) -> np.ndarray:
        """One long piece: the same tree, updated path by path."""
        sym = self._symbols(piece)
        n = len(sym)
        size = 1 << (n - 1).bit_length()
        full = np.full(2 * size, NONE, np.int32)
        full[size : size + n - 1] = self.ranks(sym[:-1], sym[1:])
        for a in [size >> k for k in range(1, size.bit_length())]:
            full[a : 2 * a] = np.minimum(full[2 * a : 4 * a : 2], full[2 * a + 1 : 4 * a : 2])
        tree, ids, made = full.tolist(), sym.tolist(), self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        there = bytearray(b"\1" * n)
        rank = self._rank

        def put(node: int, value: int) -> None:
            node += size
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while (root := tree[1]) != NONE:
            node = 1
            while node < size:
                node = 2 * node + (tree[2 * node] != root)
            i = node - size
            j = nxt[i]
            k, p = nxt[j], prv[i]
            ids[i], nxt[i], there[j] = int(made[root]), k, 0
            put(j, NONE)
            if k < n:
                prv[k] = i
                put(i, rank(ids[i], ids[k]))
            else:
                put(i, NONE)
            if p >= 0:
                put(p, rank(ids[p], ids[i]))
        return np.array(ids, np.int32)[np.frombuffer(there, np.uint8) > 0]

    def _rank(self, a: int, b: int) -> int:
        want = a << 32 | b
        at = int(self.key.searchsorted(want))
        return int(self.rank[at]) if at < len(self.key) and self.key[at] == want else int(NONE)

    def learn(self, words: Iterable[bytes]) -> None:
        """Encodes all words that aren't known yet, together."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        cut = list(map(self.split, new))
        pieces = list({x for c in cut for x in c if isinstance(x, bytes)})
        ids: dict[bytes | int, bytes] = dict(zip(pieces, self.merge(pieces), strict=True))
        ids |= {i: i.to_bytes(4, "little") for i in self.added.values()}
        for w, c in zip(new, cut, strict=True):
            self.known[w] = ids[c[0]] if len(c) == 1 else b"".join([ids[x] for x in c])

    def encode(self, texts: list[bytes], at_once: int = 4_000_000) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, as without special tokens around it. White space ends words, so a text's ids are those of its words."""
        at = 0
        while at < len(texts):
            end, room = at, at_once
            while end < len(texts) and (end == at or len(texts[end]) <= room):
                room -= len(texts[end])
                end += 1
            # added tokens keep their case; all else is lower-cased anyway
            split = [(t if b"<|" in t else t.lower()).split() for t in texts[at:end]]
            self.learn({w for s in split for w in s})
            get = self.known.__getitem__
            for s in split:
                yield np.frombuffer(b"".join(map(get, s)), "<u4")
            at = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the tokens with a space between, which is what a file without decoder gives; unknown ids are left out."""
        names = self.names
        return b" ".join([names[i] for i in ids.tolist() if i in names])


_ready: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder a worker and file."""
    if path not in _ready:
        _ready[path] = WordBpe(path)
    return _ready[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` (array<int>) and `decoded` (string) more, replacing columns of these names."""
    base = docs.drop("ids", "decoded")
    # base.schema is one object for all who ask: a longer one is a new one
    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in small(whole):
                ids = [x.astype(np.int32) for x in bpe.encode(byte_column(batch, "text"))]
                decoded = [bpe.decode(x).decode() for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*batch.schema.names, "ids", "decoded"])

    return base.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document of (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is as the empty one: no ids, and the digests of nothing. Rows that repeat an id are rows of
    their own; a null id stays null. Narrow: each row is encoded where it is read. A text of any length is
    encoded whole; words beyond 64 bytes get a tree of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode(byte_column(batch, "text")):
                n.append(len(ids))
                a.append(sha(ids.tobytes()).hexdigest())
                b.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
