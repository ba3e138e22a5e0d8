"""Language ID by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, free, held_out, read, training, written

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
TRAIN_ROWS = 400  # documents of each language that are learned from, about; their texts whole
LANGUAGES = 10_000  # whose counts are broadcast
LETTER = re.compile(rb"[A-Za-z]")


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of `size`, the last filled with zeros."""
    n = max(1, -(-len(text) // size))
    return np.frombuffer(text.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


class ByteCnn:
    """Filters of several widths over one-hot bytes (so each is a table of 256 rows a position), the largest response of each over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.base = np.zeros(len(classes), np.float32)
        self.floor = 0.0  # scores below it say that a text is in no language of these

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, at = [], []
        for f in self.filters:
            n = x.shape[1] - len(f) + 1
            y = f[0][x[:, :n]]
            for k in range(1, len(f)):
                y += f[k][x[:, k : k + n]]
            if where:
                at.append(i := y.argmax(1))
                tops.append(np.take_along_axis(y, i[:, None], 1)[:, 0])
            else:
                tops.append(y.max(1))
        return np.concatenate(tops, 1) + self.bias, at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for a in range(0, len(x), 128):  # what fits the cache
            h, _ = self.pooled(x[a : a + 128])
            out[a : a + 128] = softmax(np.maximum(h, 0) @ self.out + self.base)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """Adam on cross-entropy; only a filter's largest response has a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.out, self.base]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 128):
                rows = order[a : a + 128]
                h, at = self.pooled(x[rows], where=True)
                r = np.maximum(h, 0)
                g = softmax(r @ self.out + self.base)
                g[np.arange(len(rows)), y[rows]] -= 1
                g /= len(rows)
                gh = (g @ self.out.T) * (h > 0)
                grads = []
                for n, f in enumerate(self.filters):
                    own, gf = gh[:, n * FILTERS : (n + 1) * FILTERS], np.zeros_like(f)
                    for k in range(len(f)):
                        np.add.at(gf[k], (x[rows[:, None], at[n] + k], np.arange(FILTERS)[None, :]), own)
                    grads.append(gf)
                grads += [gh.sum(0), r.T @ g, g.sum(0)]
                t += 1
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for p, q, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (q - mm)
                    vv += 0.001 * (q * q - vv)
                    p -= step * mm / (np.sqrt(vv) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def told(model: ByteCnn, texts: list[bytes]) -> np.ndarray:
    """Each text's probabilities of the languages: the mean over its windows, by their bytes."""
    x = [windows(t) for t in texts]
    at = np.cumsum([0, *map(len, x)])
    p = model.predict(np.concatenate(x)).astype(np.float64)
    weight = np.full(len(p), float(WINDOW))
    weight[at[1:] - 1] = [len(t) - WINDOW * (len(w) - 1) for t, w in zip(texts, x, strict=True)]
    q = np.add.reduceat(p * weight[:, None], at[:-1])
    return q / q.sum(1, keepdims=True)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, folds: int = 4) -> ByteCnn | None:
    """The network, learned from the whole texts of about `rows` documents of each language, by hash of the id; None without labelled rows that have a letter.

    Languages are counted first, without their texts; the sample is taken where the rows are read.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & training("doc_id", folds))
    count = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    share = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    few = count.count() <= LANGUAGES
    some = known.select("doc_id", "lang", "text").join(F.broadcast(count) if few else count, "lang").where(share < rows / F.col("n"))

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = byte_column(batch, "text")
            keep = pa.array([has_letter(t) for t in text], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(text, pa.binary())], names=["lang", "text"]).filter(keep)

    got = some.select("lang", "text").mapInArrow(lettered, "lang string, text binary").orderBy("lang", "text").toPandas()
    if got.empty:
        return None
    classes = sorted(got["lang"].unique())
    texts, y = got["text"].tolist(), np.searchsorted(classes, got["lang"].to_numpy())
    x = [windows(t) for t in texts]
    model = ByteCnn(classes).fit(np.concatenate(x), np.repeat(y, [len(w) for w in x]))
    q = np.concatenate([told(model, texts[a : a + 256]) for a in range(0, len(texts), 256)])
    right = q.argmax(1) == y
    # half of the least score of a training document that is told right, but above what chance gives every language
    least = float(q.max(1)[right].min()) if right.any() else 0.0
    model.floor = min(least, max(1.1 / len(classes), least / 2))
    return model


def predict(docs: DataFrame, model: ByteCnn | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (all, if not given) with two more of these names: the language, and its probability over the whole text.

    `und` with score 0 for a null text, a text without letters, or where nothing was learned. Narrow: each
    row is scored where it is read; rows that repeat an id are rows of their own. A kept column may not have one
    of the two names: common.free() gives one that no column has.
    """
    own = keep or docs.columns
    hidden = free("text", [*own, *names])
    base = docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").alias(hidden))
    schema = base.drop(hidden).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = byte_column(batch, hidden)
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                if rows:
                    q = told(model, [texts[i] for i in rows])
                    score[rows] = q.max(1)
                    for i, k in zip(rows, q.argmax(1).tolist(), strict=True):
                        lang[i] = model.classes[k]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], *names])

    return base.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs), keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
