"""Toxic spans by a linear-chain conditional random field; documents by its marginals."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, group_shingles, hashes, held_out, read, training, written

BITS = 18
STRIP = b""".,;:!?"'()[]{}|#$%&*<>"""
PREFIXES = (3, 4, 5, 6)  # bytes
WIDTH = 1 + len(PREFIXES)  # features of a word at most
TRAIN_ROWS = 1_500  # labelled documents of each class that are learned from, about; their texts whole
LEAST = 4  # toxic documents that a feature must be in to label a token
TIMES = 40  # how much commoner, by share of documents, it must be in toxic ones
SURE = 8.5  # nats of evidence that this is no chance, by the numbers of documents with it
CACHE = 400_000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[int]:
    """Hashed: the word without marks around it, and its beginnings."""
    w = word.strip(STRIP)
    parts = [b"=" + w, *(b"%d" % n + w[:n] for n in PREFIXES if len(w) >= n)]
    return [zlib.crc32(p) >> (32 - BITS) for p in parts]


def marginals(e: np.ndarray, length: np.ndarray, trans: np.ndarray, block: int = 64, pairs: np.ndarray | None = None) -> np.ndarray:
    """P(label 1) of each token by forward-backward, for sequences laid end to end; `pairs`, if given, gets the expected number of each (label before, label).

    e: log-odds of label 1 by the token itself; trans[i, j]: log weight of j after i; before a text stands 0.
    Each block of tokens is one product of 2x2 matrices, all blocks are taken at once; only the vectors
    between blocks go from block to block. Exact for any length.
    """
    t = np.exp(trans)
    blocks = -(-length // block)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return np.zeros(0)
    pos = np.arange(len(e)) - np.repeat(np.cumsum(length) - length, length)
    row, col = np.repeat(first, length) + pos // block, pos % block
    a, live = np.ones((block, total)), np.zeros((block, total), bool)
    a[col, row], live[col, row] = np.exp(np.clip(e, -30, 30)), True
    p = np.tile(np.eye(2), (total, 1, 1))
    for k in range(block):
        q = p @ t
        q[:, :, 1] *= a[k][:, None]
        q /= q.max((1, 2), keepdims=True)
        p = np.where(live[k][:, None, None], q, p)
    start, end = np.empty((total, 2)), np.empty((total, 2))
    v, w = np.tile([1.0, 0.0], (len(length), 1)), np.ones((len(length), 2))
    for j in range(int(blocks.max())):
        d = np.flatnonzero(blocks > j)
        start[first[d] + j] = v[d]
        x = np.einsum("ni,nij->nj", v[d], p[first[d] + j])
        v[d] = x / x.sum(1, keepdims=True)
        at = first[d] + blocks[d] - 1 - j
        end[at] = w[d]
        x = np.einsum("nij,nj->ni", p[at], w[d])
        w[d] = x / x.sum(1, keepdims=True)
    alpha = np.empty((block + 1, total, 2))
    alpha[0] = v = start
    for k in range(block):
        x = v @ t
        x[:, 1] *= a[k]
        x /= x.sum(1, keepdims=True)
        alpha[k + 1] = v = np.where(live[k][:, None], x, v)
    out, w = np.empty((block, total)), end
    for k in range(block - 1, -1, -1):
        x = alpha[k + 1] * w
        out[k] = x[:, 1] / x.sum(1)
        y = w.copy()
        y[:, 1] *= a[k]
        if pairs is not None:
            both = alpha[k][:, :, None] * t * y[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pairs += both[live[k]].sum(0)
        y = y @ t.T
        y /= y.sum(1, keepdims=True)
        w = np.where(live[k][:, None], y, w)
    return out[col, row]


@dataclass
class Texts:
    """Training texts as numbers: `token` is the word of each token, texts end to end; `grid` the WIDTH features of each word, filled up with 1 << BITS."""

    token: np.ndarray
    length: np.ndarray
    grid: np.ndarray
    name: np.ndarray  # a 64-bit hash of each word

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Texts:
        words = list(dict.fromkeys(w for t in texts for w in t))
        number = {w: i for i, w in enumerate(words)}
        return cls(np.array([number[w] for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64), word_grid(words), hashes(words))

    def some(self, keep: np.ndarray) -> Texts:
        return Texts(self.token[np.repeat(keep, self.length)], self.length[keep], self.grid, self.name)

    def runs(self, size: int) -> Iterator[slice]:
        """Runs of texts of about `size` tokens."""
        edge = np.cumsum(self.length)
        a = 0
        while a < len(edge):
            b = max(a + 1, int(np.searchsorted(edge, (edge[a - 1] if a else 0) + size, "right")))
            yield slice(a, b)
            a = b


def word_grid(words: list[bytes]) -> np.ndarray:
    grid = np.full((len(words), WIDTH), 1 << BITS, np.int32)
    for i, w in enumerate(words):
        f = features(w)
        grid[i, : len(f)] = f
    return grid


@dataclass
class Crf:
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    link: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))  # of document scores
    known: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def evidence(self, words: list[bytes]) -> np.ndarray:
        known, weight = self.known, self.weight
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.bias + float(weight[features(w)].sum())
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The marginals of the tokens of each text."""
        length = np.array([len(t) for t in texts], np.int64)
        p = marginals(self.evidence([w for t in texts for w in t]), length, self.trans)
        return np.split(p, np.cumsum(length)[:-1])

    def summary(self, p: np.ndarray) -> tuple[float, float]:
        """Log-odds of the likeliest token, and how many tokens are toxic."""
        if not len(p):
            return -12.0, 0.0
        top = float(np.clip(p.max(), 1e-6, 1 - 1e-6))
        return float(np.log(top / (1 - top))), float(np.log1p(p[p > 0.05].sum()))

    def score(self, p: np.ndarray) -> float:
        z = self.link @ np.array([1.0, *self.summary(p)])
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def fit(self, texts: Texts, toxic: np.ndarray, rounds: int = 40, least: int = LEAST, times: float = TIMES) -> Crf:
        """Labels tokens, then fits the field to them, then the score to the documents' labels.

        A token counts as toxic in a toxic document if one of its features is in `least` toxic documents, `times` as
        often in those as in others by share, and by SURE more often. Copies within a class count once.
        """
        keep = originals(texts, toxic)  # copies of one text would make all its words look telling
        texts, toxic = texts.some(keep), toxic[keep]
        n = np.maximum(np.bincount(toxic, minlength=2), 1)
        own = np.repeat(np.arange(len(toxic)), texts.length)
        pair = distinct((own[:, None] << (BITS + 1) | texts.grid[texts.token]).ravel())
        y, f = toxic[pair >> (BITS + 1)], pair & ((1 << (BITS + 1)) - 1)
        clean, bad = (np.bincount(f[y == k], minlength=(1 << BITS) + 1) for k in (0, 1))
        sure = np.zeros(len(bad))
        for c, k in ((bad, n[1]), (clean, n[0])):
            sure += c * np.log(np.maximum(c, 1e-9) / k / np.maximum(bad + clean, 1e-9) * n.sum())
        telling = (bad >= least) & (bad / n[1] >= times * (clean + 0.05) / n[0]) & (sure >= SURE)
        telling[-1] = False
        goal = telling[texts.grid].any(1)[texts.token] & (toxic[own] > 0)
        if goal.any():
            self._fit_field(texts, goal, rounds)
        marks = []
        edge = np.concatenate([[0], np.cumsum(texts.length)])
        e = self.bias + np.append(self.weight, 0.0)[texts.grid].sum(1)[texts.token]
        for part in texts.runs(1 << 18):
            p = marginals(e[edge[part.start] : edge[part.stop]], texts.length[part], self.trans)
            marks += [[1.0, *self.summary(q)] for q in np.split(p, np.cumsum(texts.length[part])[:-1])]
        x = np.array(marks).reshape(-1, 3)
        self.link = logistic(x, toxic.astype(float), np.array([1e-3, 1e-2, 1e-2]) * max(1, len(x)) * 0.01)
        return self

    def _fit_field(self, texts: Texts, goal: np.ndarray, rounds: int) -> None:
        """Ascends the likelihood of the labels: of the features' weights, the bias and the four transitions, each by what was seen less what the field expects."""
        token, length, grid = texts.token, texts.length, texts.grid
        n = len(token)
        begin = np.zeros(n, bool)
        begin[(np.cumsum(length) - length)[length > 0]] = True
        before = np.where(begin, 0, np.concatenate([[0], goal[:-1]])).astype(int)
        seen = np.bincount(before * 2 + goal, minlength=4).reshape(2, 2).astype(float)
        weight, bias = np.zeros((1 << BITS) + 1), self.bias
        trans = np.log((seen + 1) / (seen + 1).sum(1, keepdims=True))
        trans -= trans[:, :1]  # of two labels one is free
        m, v = np.zeros_like(weight), np.zeros_like(weight)
        hot, edge = goal.astype(float), np.concatenate([[0], np.cumsum(length)])
        m4, v4 = np.zeros(5), np.zeros(5)
        for r in range(1, rounds + 1):
            e = bias + weight[grid].sum(1)[token]
            expected, d = np.zeros((2, 2)), np.empty(n)
            for part in texts.runs(1 << 18):
                a, b = edge[part.start], edge[part.stop]
                d[a:b] = marginals(e[a:b], length[part], trans, pairs=expected) - hot[a:b]
            by_word = np.bincount(token, d, len(grid))
            g = np.bincount(grid.ravel(), np.repeat(by_word, WIDTH), len(weight)) + 0.02 * weight
            g[-1] = 0
            few = np.append((expected - seen).ravel() + 0.02 * trans.ravel(), d.sum())
            few[[0, 2]] = 0  # fixed, as above
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            m4 += 0.1 * (few - m4)
            v4 += 0.01 * (few * few - v4)
            rate = np.sqrt(1 - 0.99**r) / (1 - 0.9**r)
            weight -= 0.3 * rate * m / (np.sqrt(v) + 1e-3)
            few = 0.1 * rate * m4 / (np.sqrt(v4) + 1e-3)
            trans -= few[:4].reshape(2, 2)
            bias -= few[4]
        self.weight, self.bias, self.trans = weight[:-1].astype(np.float32), float(bias), trans


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression with a ridge: Newton's steps, each halved until the loss falls. A fit that doesn't reach a flat gradient is an error."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w * w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        q = 0.5 + 0.5 * np.tanh(x @ w / 2)
        g = x.T @ (q - y) + ridge * w
        if np.abs(g).max() <= 1e-6 * max(1, len(x)):
            return w
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), g)
        size = 1.0
        while (then := loss(w - size * step)) > now - 1e-4 * size * float(g @ step) and size > 1e-12:
            size /= 2
        w, now = w - size * step, then
    raise ArithmeticError(f"the document score didn't converge: gradient {g}")


def distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def originals(texts: Texts, toxic: np.ndarray, size: int = 16, same: int = 4) -> np.ndarray:
    """Whether a text shares fewer than `same` of its `size` least shingles with those of its class before it."""
    s, own = group_shingles(texts.name[texts.token], texts.length)
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    edge = np.searchsorted(own, np.arange(len(texts.length) + 1)).tolist()
    seen: tuple[set[int], set[int]] = (set(), set())
    keep = np.ones(len(texts.length), bool)
    for i, (a, b, y) in enumerate(zip(edge[:-1], edge[1:], toxic.tolist(), strict=True)):
        least = set(s[a : min(b, a + size)].tolist())
        keep[i] = len(least & seen[y]) < min(same, max(1, len(least)))
        seen[y].update(least)
    return keep


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 4) -> Crf:
    """The field, learned from the whole texts of about `rows` labelled documents of each class, chosen by hash of the id.

    Rows without label or text teach nothing; several labels of one id count as toxic if one is. Words become
    numbers in the executors: the driver gets a hash a token, and the features of each distinct word once.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training("doc_id", folds)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = own.groupBy("toxic").count()
    share = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    some = own.join(F.broadcast(count), "toxic").where(share < rows / F.col("count")).select("doc_id", "toxic")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), byte_column(batch, "text"), strict=True):
                words = text.lower().split()
                own = list(set(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([y], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (hashes(words), hashes(own), word_grid(own)))],
                    names=["doc_id", "toxic", "tokens", "words", "grid"],
                )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, g in zip(batch.column("words").to_pylist(), batch.column("grid").to_pylist(), strict=True):
                grid = np.frombuffer(g, np.int32).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array([x.tobytes() for x in grid], pa.binary())], names=["word", "grid"])

    # at most a few thousand ids, by the bound above
    picked = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")
    picked = written(picked.mapInArrow(numbers, "doc_id long, toxic int, tokens binary, words binary, grid binary"), "labelled")
    got = picked.select("doc_id", "toxic", "tokens").orderBy("doc_id", "tokens").toPandas()
    if got.empty:
        return Crf()
    words = picked.select("words", "grid").mapInArrow(split, "word long, grid binary").groupBy("word").agg(F.first("grid").alias("grid")).toPandas()
    name = words["word"].to_numpy(np.int64)
    order = np.argsort(name)
    name, grid = name[order], np.frombuffer(b"".join(words["grid"].iloc[order]), np.int32).reshape(-1, WIDTH)
    length = np.array([len(t) // 8 for t in got["tokens"]], np.int64)
    token = np.searchsorted(name, np.frombuffer(b"".join(got["tokens"]), np.int64))
    toxic = got["toxic"].to_numpy(np.int64)
    del words, got
    return Crf().fit(Texts(token, length, grid, name.view(np.uint64)), toxic)


def scored(docs: DataFrame, model: Crf, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and spans: from where to where in the text, in characters, each run of tokens above the threshold goes.

    Whole texts of any length; null and empty ones get the score of a text without tokens. Narrow: rows are
    scored where they are read; repeated and null ids are rows like any other, other columns are not looked at.
    """
    offsets = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _sliced(whole):
                own = byte_column(batch, "text")
                tags = model.tag([t.lower().split() for t in own])
                spans = [_spans(t, p > threshold) for t, p in zip(own, tags, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([model.score(p) for p in tags], pa.float64()), pa.array(spans, offsets)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def _sliced(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _spans(text: bytes, on: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    if not len(edge):
        return []
    at = [m.span() for m in WORDS.finditer(text)]
    place = lambda k: len(text[:k].decode("utf-8", "replace"))
    return [{"start": place(at[a][0]), "end": place(at[b - 1][1])} for a, b in edge.reshape(-1, 2)]


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
