"""Language-model scores by a probabilistic suffix tree over the bytes of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, held_out, mix, read, text_words, written

DEPTH = 6  # bytes of the longest context
HEAD = 2  # contexts of so many bytes or fewer are few at any size (of the alphabet, not of the corpus): each task has them all
LEAST = 2  # training symbols after a context that is a state
GAIN = 3.0  # nats of training text that a context must save over the next shorter one, for each of its symbols
CHUNK_MB = 12  # of text that one task holds together, about
MB = 1 << 20
GAP, END = b" ", b"\n"  # after each word, and after the last one of a text; neither is in a word
BYTE = np.uint64(8)
END_HASH = np.uint64(0xD1B54A32D192ED03)


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """Documents with the chunk that scores them and whether they teach; null texts are empty, null ids teach nothing twice: they have no crc and are trained on."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        held_out("doc_id", 7).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts end to end, words and one end each; the tokens of each text; the symbols of each token, with the GAP after a word."""
    h, length, width = text_words(texts)
    end = np.zeros(len(h) + len(texts), bool)
    end[np.cumsum(length + 1) - 1] = True
    out, wide = np.full(len(end), END_HASH), np.ones(len(end), np.int64)
    out[~end], wide[~end] = h, width + 1
    return out, length + 1, wide


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of each text, its words with a GAP after each and one END, with the `depth` symbols before it, and the symbols of each text. Before a text there are ENDs.

    A gram is one number: the nearest symbol before is the highest byte, so that the contexts that end alike
    lie together when sorted; the symbol itself is the lowest.
    """
    words = [t.lower().split() for t in texts]
    parts = [GAP.join([*w, END]) for w in words]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join([END * depth + p for p in parts]), np.uint8)
    own = np.ones(len(raw), bool)
    at = np.cumsum(size + depth) - size
    for d in range(1, depth + 1):
        own[at - d] = False
    out = raw.astype(np.uint64)
    for d in range(1, depth + 1):
        out[d:] |= raw[:-d].astype(np.uint64) << np.uint64(8 * (depth - d + 1))
    return out[own], size


def shortened(gram: np.ndarray, depth: int, d: int) -> np.ndarray:
    """Grams of `depth` with the last d symbols before alone."""
    return ((gram >> np.uint64(8 * (depth - d + 1))) << BYTE) | (gram & np.uint64(255))


def blocks(texts: list[bytes], size: int = 2 * MB) -> Iterator[slice]:
    """Runs of texts of about `size` bytes: what is held at once beside the distinct grams."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i + 1 == len(texts):
            yield slice(a, i + 1)
            a, held = i + 1, 0


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their numbers."""
    if len(key) and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key, kind="stable")  # mostly runs that are sorted
        key, n = key[order], n[order]
    new = starts(key)
    return key[new], np.add.reduceat(n, new) if len(new) else n


def starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def numbered(x: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them."""
    order = np.argsort(x, kind=kind)
    y = x[order]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return y[new], at


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """The order that lays what is of one bucket together, and where each bucket that has anything lies."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    own = bucket[order]
    edge = [*starts(own).tolist(), len(own)]
    return order, {int(own[a]): slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)}


def taught(texts: list[bytes], teach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and how often each was seen in training."""
    g, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in blocks(texts):
        own, size = grams(texts[part])
        own = (own << np.uint64(1)) | np.repeat(teach[part], size).astype(np.uint64)
        own.sort()
        new = starts(own)
        k = np.diff(np.append(new, len(own)))
        own = own[new]
        own, k = summed(own >> np.uint64(1), np.where(own & np.uint64(1), k, 0))
        g.append(own)
        n.append(k.astype(np.int32))
    return summed(np.concatenate(g), np.concatenate(n).astype(np.int64))


def packed(x: np.ndarray, kind: str) -> bytes:
    """By planes of bytes, as these compress."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def unpacked(x: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """All contexts that end in the same HEAD + 1 bytes meet in one bucket."""
    end = gram >> np.uint64(8 * (DEPTH - HEAD))
    new = starts(end)
    return np.repeat((mix(end[new]) % np.uint64(buckets)).astype(np.int64), np.diff(np.append(new, len(end))))


class SuffixTree:
    """States by depth: sorted context numbers, and for each the log10 probability of every symbol it was seen with; others fall to the next shorter state at a price."""

    def __init__(self, root: np.ndarray):
        seen = root + 0.5  # all 256 symbols can come
        self.root = np.log10(seen / seen.sum())
        self.context: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.pairs: list[np.ndarray] = [np.zeros(0, np.uint64)]  # (state number << 8 | symbol), sorted
        self.value: list[np.ndarray] = [np.zeros(0)]
        self.back: list[np.ndarray] = [np.zeros(0)]  # what an unseen symbol costs at a state

    def add(self, gram: np.ndarray, n: np.ndarray, depth: int, least: int = LEAST, gain: float = GAIN) -> None:
        """One more depth, from training grams of `depth`. A context stays if it was seen `least` times and its symbols are so much likelier than in the state it would fall to: counts weigh the divergence."""
        d = len(self.context)
        gram, n = summed(shortened(gram, depth, d), n)
        context = gram >> BYTE
        new = starts(context)
        kinds = np.diff(np.append(new, len(context)))
        total = np.add.reduceat(n, new) if len(new) else n
        shorter = self.look(gram, d)
        all_, many = np.repeat(total, kinds), np.repeat(kinds, kinds)
        # what is left, kinds / (total + kinds), goes to the shorter state
        mine = np.log10((n + many * 10**shorter) / (all_ + many))
        saved = np.add.reduceat(n * (mine - shorter), new) * np.log(10) if len(new) else total
        stays = (total >= least) & (saved >= gain * kinds)
        own = np.repeat(stays, kinds)
        self.context.append(context[new][stays])
        number = np.repeat(np.arange(stays.sum()), kinds[stays]).astype(np.uint64)
        self.pairs.append((number << BYTE) | (gram[own] & np.uint64(255)))
        self.value.append(mine[own])
        self.back.append(np.log10(kinds / (total + kinds))[stays])

    def look(self, gram: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 P(symbol | the longest suffix of the context that is a state)."""
        out, price = np.zeros(len(gram)), np.zeros(len(gram))
        left = np.arange(len(gram))
        for d in range(len(self.context) - 1, 0, -1):
            states = self.context[d]
            if not len(states) or not len(left):
                continue
            x = gram[left] >> np.uint64(8 * (depth - d + 1))
            at = np.minimum(np.searchsorted(states, x), len(states) - 1)
            hit = np.flatnonzero(states[at] == x)
            rows, at = left[hit], at[hit]
            want = (at.astype(np.uint64) << BYTE) | (gram[rows] & np.uint64(255))
            k = np.minimum(np.searchsorted(self.pairs[d], want), len(self.pairs[d]) - 1)
            seen = self.pairs[d][k] == want
            out[rows[seen]] = price[rows[seen]] + self.value[d][k[seen]]
            price[rows[~seen]] += self.back[d][at[~seen]]
            done = np.zeros(len(left), bool)
            done[hit[seen]] = True
            left = left[~done]
        out[left] = price[left] + self.root[(gram[left] & np.uint64(255)).astype(np.int64)]
        return out

    def deeper(self, gram: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> SuffixTree:
        """With the states of the depths up to `depth` that the training grams of that depth make; this one is not changed."""
        out = SuffixTree.__new__(SuffixTree)
        out.root, out.context, out.pairs, out.value, out.back = self.root, self.context[:], self.pairs[:], self.value[:], self.back[:]
        while len(out.context) <= depth:
            out.add(gram, n, depth)
        return out


def head(own: DataFrame) -> SuffixTree:
    """The states of HEAD bytes or fewer, from training counts of the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2_000):
                g, _ = grams(byte_column(whole.slice(a, 2_000), "text"), HEAD)
                g, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    got = own.where("NOT held_out").select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    g, n = got["g"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    return SuffixTree(np.bincount((g & np.uint64(255)).astype(np.int64), n, 256)).deeper(g, n, HEAD)


def gather(own: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk, one row for each bucket of which it has anything, so no more rows than distinct tokens and grams of the chunks: these with their training counts, sorted and packed."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts, teach = byte_column(table, "text"), ~table.column("held_out").to_numpy()
        h, length, _ = tokens(texts)
        h, at = numbered(h)
        count = np.bincount(at, np.repeat(teach, length), len(h)).astype(np.int64)
        g, n = taught(texts, teach)
        nothing = {"h": b"", "c": b"", "g": b"", "n": b""}
        rows: dict[int, dict] = {}
        order, place = by_bucket((h % np.uint64(buckets)).astype(np.int64))
        h, count = h[order], count[order]
        for b, i in place.items():
            rows[b] = nothing | {"h": packed(steps(h[i]), "<u8"), "c": packed(count[i], "<i8")}
        order, place = by_bucket(bucket_of(g, buckets))
        g, n = g[order], n[order]
        for b, i in place.items():
            rows[b] = rows.get(b, nothing) | {"g": packed(steps(g[i]), "<u8"), "n": packed(n[i], "<i8")}
        return pa.Table.from_pylist([{"bucket": b, "chunk": key[0].as_py()} | r for b, r in rows.items()], schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *[(x, pa.binary()) for x in "hcgn"]]))

    return own.groupBy("chunk").applyInArrow(run, "bucket int, chunk int, h binary, c binary, g binary, n binary")


def answered(rows: DataFrame, tree: SuffixTree) -> DataFrame:
    """For each bucket and chunk, in the order of what was asked: the corpus's training counts of the tokens (c) and the grams' log10 probabilities (p); v, in one row of a bucket, is the number of its distinct trained tokens."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        def together(name: str, number: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            each = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in table.column(name).to_pylist()]
            own, at = numbered(np.concatenate(each), "stable")  # runs that are sorted
            n = np.concatenate([unpacked(x, "<i8") for x in table.column(number).to_pylist()])
            return own, np.bincount(at, n, len(own)).astype(np.int64), at, np.cumsum([0, *map(len, each)])

        _, count, at, edge = together("h", "c")
        g, n, where, cut = together("g", "n")
        p = held.value.deeper(g[n > 0], n[n > 0]).look(g)
        chunks = table.column("chunk").to_pylist()
        out = [{"chunk": c, "bucket": key[0].as_py(), "c": packed(count[at[edge[k] : edge[k + 1]]], "<i8"), "p": packed(p[where[cut[k] : cut[k + 1]]], "<f4"), "v": int((count > 0).sum()) if k == 0 else 0} for k, c in enumerate(chunks)]
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("c", pa.binary()), ("p", pa.binary()), ("v", pa.int64())]))

    return rows.groupBy("bucket").applyInArrow(run, "chunk int, bucket int, c binary, p binary, v long")


def scores(docs: DataFrame, chunk_mb: float = CHUNK_MB) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and what of both scores is of its known tokens: base_known, score_known.

    Tokens are the lower-cased words and one end; the base is the add-one unigram over the V distinct
    training tokens and one unknown. The score is the tree's log10 probability of the text as a sequence of
    bytes, words with one space after each and the end: of each symbol after the longest suffix of what is
    before it, over words' beginnings, that is a state. A token has its bytes and the space after it, known or
    not. So the base gives all unknown tokens one symbol, the tree each its own spelling. The tree learns
    from all training symbols. Null texts are empty (the end alone), null ids count as trained on; repeated
    rows are rows of their own. An empty table gives no rows. Documents are dealt out by hash in chunks of
    about `chunk_mb`, on which no figure depends; the states lie in buckets by the last bytes of their
    contexts, and a chunk asks for those of its own distinct grams only.
    """
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-int(size) // int(chunk_mb * MB)))
    own = chunked(docs, chunks)
    asked = answered(gather(own, chunks), head(own))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = byte_column(left, "text")
        got = {r["bucket"]: r for r in right.select(["bucket", "c", "p"]).to_pylist()}

        def filled(bucket: np.ndarray, name: str, kind: str) -> np.ndarray:
            order, place = by_bucket(bucket)
            out = np.empty(len(bucket), kind)
            for b, i in place.items():
                out[order[i]] = unpacked(got[b][name], kind)
            return out

        hashed, length, wide = tokens(texts)
        h, at = numbered(hashed)
        c = filled((h % np.uint64(chunks)).astype(np.int64), "c", "<i8")[at]
        base = np.log10(c + 1.0)
        parts_, own = list(blocks(texts)), []
        for part in parts_:
            own.append(numbered(grams(texts[part])[0]))
        g = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in own]])
        g.sort(kind="stable")
        g = g[starts(g)]
        p = filled(bucket_of(g, chunks), "p", "<f4")
        each = np.zeros(len(hashed))
        start = np.cumsum(length) - length
        for part, (x, place) in zip(parts_, own, strict=True):
            i, j = start[part.start], start[part.start] + length[part].sum()
            x = p[np.searchsorted(g, x)][place].astype(np.float64)
            each[i:j] = np.add.reduceat(x, np.cumsum(wide[i:j]) - wide[i:j])
        add = (lambda x: np.add.reduceat(x, start)) if len(texts) else (lambda x: x)
        v = np.zeros(len(texts), np.int64)
        v[:1] = sum(right.column("v").to_pylist())
        known = c > 0
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": length, "n_known": add(known.astype(np.int64)),
            "base": add(base), "score": add(each), "score_known": add(np.where(known, each, 0.0)), "v": v,
        })

    out = written(own.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, score_known double, v long"), "scores")
    t, v = out.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    least = F.lit(float(np.log10(t + v + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(t)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * least).alias("base_score"), "score", (F.col("base") - F.col("n_known") * least).alias("base_known"), "score_known")


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents")).drop("base_known", "score_known")
