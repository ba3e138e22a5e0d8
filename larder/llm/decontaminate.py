"""Benchmark decontamination: suffix arrays of the documents, in which every suffix of the test items is searched.

Documents are cut into shards of some megabytes. A word's symbol is its number in the items' vocabulary. Runs of words whose pairs stand next to each other in some item, too, are all that can hold a match; the suffixes of these runs are sorted by prefix doubling, and the interval of suffixes that begin as a test suffix does is narrowed word by word, by binary search, until it is empty. That gives each test suffix its longest verbatim match and the places of its window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, STEP, byte_column, free, mix, pieces, read, word_hashes

WINDOW = 10  # words
SHARD = 8 << 20  # bytes of text a suffix array is built of, but for a longer text alone
BLOCK = 1 << 20  # words of items that are broadcast and searched at once; further items make further blocks

GAPS = np.zeros(256, bool)
GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
SYMBOLS = np.where(GAPS, np.uint64(0), LETTERS)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, A-Z lower-cased, end to end, and how many each text has. Words are runs of letters, digits and all that isn't ASCII."""
    h, at, _ = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8), SYMBOLS, GAPS)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return h, np.diff(np.searchsorted(at, ends), prepend=0)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * STEP + b)


class Among:
    """Which of many hashes are in a set, and where: a bitmap passes over nearly all of the others before the sorted set is searched."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h, and in the set, of what is in both."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        same = self.values[found] == h[at]
        return at[same], found[same]


@dataclass
class Items:
    """A block of test items: their symbols end to end, each item closed by a 0, and a window for each suffix that begins one."""

    ids: list[str]
    vocabulary: Among
    pairs: Among
    single: np.ndarray  # symbols that are an item of one word
    symbols: np.ndarray
    start: np.ndarray  # of each suffix
    owner: np.ndarray  # its item
    window: np.ndarray  # words of the window that begins there; 0 if none does
    least: int  # words of the shortest window

    @staticmethod
    def of(rows: list[tuple[str, bytes]], window: int) -> Items:
        h, length = words([t for _, t in rows])
        vocabulary = Among(h)
        owner = np.repeat(np.arange(len(rows)), length)
        symbols = np.zeros(len(h) + len(rows) + window, np.int64)
        start = np.arange(len(h)) + owner
        symbols[start] = np.searchsorted(vocabulary.values, h) + 1
        place = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
        size = np.repeat(length, length)
        span = np.where((size < window) & (place == 0), size, np.where(size - place >= window, window, 0))
        inside = owner[1:] == owner[:-1]
        return Items([i for i, _ in rows], vocabulary, Among(pair(h[:-1], h[1:])[inside]), np.unique(symbols[start[size == 1]]), symbols, start, owner, span, int(span[span > 0].min()) if len(h) else 0)


def runs(h: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all runs stand, run after run, and which of them end a run. A run has every pair of neighbours in common with the items, and no fewer words than the shortest window."""
    linked, _ = items.pairs(pair(h[:-1], h[1:])) if len(h) > 1 else (np.zeros(0, np.int64), None)
    linked = linked[doc[linked] == doc[linked + 1]]
    inside = np.zeros(len(h) + 1, bool)  # whether a word belongs with the one before
    inside[linked + 1] = True
    taken = inside[:-1] | inside[1:]
    if len(items.single):
        at, symbol = items.vocabulary(h)
        taken[at[np.isin(symbol + 1, items.single)]] = True
    at = np.flatnonzero(taken)
    first = np.flatnonzero(~inside[at])
    length = np.diff(np.append(first, len(at)))
    keep = np.repeat(length >= items.least, length)
    last = np.zeros(len(at), bool)
    last[first + length - 1] = True
    return at[keep], last[keep]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling: ranks of 2**k symbols make those of twice as many."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, k = len(symbols), 1
    while k < n and rank.max(initial=0) < n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank)


def bound(symbols: np.ndarray, order: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """For each interval of suffixes, alike in `depth` symbols, the first whose next symbol is `want` or more (after: is more)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        got = symbols[order[mid] + depth]
        less = got <= want[open_] if after else got < want[open_]
        lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
    return lo


def search(symbols: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur: the interval of suffixes that begin with each, the suffix of the items it is, and the words of that suffix's longest match. symbols end in a 0, as runs do: no item has it."""
    n = len(items.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    first, end, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    on, depth = np.arange(n), 0
    while len(on):
        want = items.symbols[items.start[on] + depth]
        a = bound(symbols, order, depth, lo[on], hi[on], want, False)
        b = bound(symbols, order, depth, a, hi[on], want, True)
        alive = (a < b) & (want > 0)
        on, a, b = on[alive], a[alive], b[alive]
        lo[on], hi[on] = a, b
        depth += 1
        longest[on] = depth
        whole = on[items.window[on] == depth]
        first[whole], end[whole] = lo[whole], hi[whole]
    found = np.flatnonzero(end > first)
    return first[found], end[found], found, longest[found]


def occurrences(h: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of each window that occurs: the word it begins at and its words, once; and, once each, pairs (document, item) of windows in common, as document * items + item; with the longest match of each document (by its number)."""
    longest = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, np.int64)
    none = np.zeros(0, np.int64)
    if not items.least:
        return none, none, none, longest
    at, last = runs(h, doc, items)
    if not len(at):
        return none, none, none, longest
    place = np.arange(len(at)) + np.cumsum(last) - last  # a 0 follows each run
    symbols = np.zeros(len(at) + int(last.sum()) + 1, np.int64)
    word = np.zeros(len(symbols), np.int64)
    symbols[place] = np.searchsorted(items.vocabulary.values, h[at]) + 1
    word[place] = at
    order = suffix_array(symbols)
    lo, hi, suffix, depth = search(symbols, order, items)
    begins, spans, pairs = [none], [none], [none]
    groups: dict[tuple[int, int, int], list[int]] = {}
    for k, key in enumerate(zip(lo.tolist(), hi.tolist(), items.window[suffix].tolist(), strict=True)):
        groups.setdefault(key, []).append(k)
    for (a, b, span), same in groups.items():  # equal windows of several items
        here = word[order[a:b]]
        begins.append(here)
        spans.append(np.full(len(here), span))
        docs, own = np.unique(doc[here]), np.unique(items.owner[suffix[same]])
        pairs.append((docs[:, None] * len(items.ids) + own).ravel())
    for a, b, d in zip(*deepest(lo, hi, depth, suffix, symbols, order, items), strict=True):
        np.maximum.at(longest, doc[word[order[a:b]]], d)
    return np.concatenate(begins), np.concatenate(spans), np.unique(np.concatenate(pairs)), longest


def deepest(lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, suffix: np.ndarray, symbols: np.ndarray, order: np.ndarray, items: Items) -> tuple[list[int], list[int], list[int]]:
    """Intervals of suffixes, and words that they have in common with a test suffix: from a window's on, as long as any is left."""
    on, d = np.arange(len(lo)), items.window[suffix].copy()
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    lo, hi = lo.copy(), hi.copy()
    seen: set[tuple[int, int, int]] = set()
    while len(on):
        for key in set(zip(lo[on].tolist(), hi[on].tolist(), d[on].tolist(), strict=True)) - seen:
            seen.add(key)
            for x, v in zip(out, key, strict=True):
                x.append(v)
        on = on[d[on] < depth[on]]
        for k in np.unique(d[on]).tolist():
            same = on[d[on] == k]
            want = items.symbols[items.start[suffix[same]] + k]
            lo[same] = bound(symbols, order, k, lo[same], hi[same], want, False)
            hi[same] = bound(symbols, order, k, lo[same], hi[same], want, True)
        d[on] += 1
    return out


def blocks(bench: DataFrame, key: str, text: str, window: int, size: int) -> Iterator[Items]:
    """Test items in blocks of some words; no more than one block and one partition are in the driver."""
    rows, held = [], 0
    for r in bench.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).toLocalIterator():
        rows.append((r[0], r[1].encode()))
        held += len(rows[-1][1]) // 2 + 1  # words at most
        if held >= size:
            yield Items.of(rows, window)
            rows, held = [], 0
    if rows:
        yield Items.of(rows, window)


def shard(texts: list[bytes], tests: Iterable[Items]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]], np.ndarray]:
    """Of each text: its words, the spans of words that are hit, the items found, and the longest match."""
    h, length = words(texts)
    doc = np.repeat(np.arange(len(texts)), length)
    edge = np.zeros(len(h) + 1, np.int64)
    found: list[set[str]] = [set() for _ in texts]
    longest = np.zeros(len(texts), np.int64)
    for items in tests:
        begin, span, pairs, most = occurrences(h, doc, items)
        edge += np.bincount(begin, minlength=len(edge)) - np.bincount(begin + span, minlength=len(edge))
        longest[: len(most)] = np.maximum(longest[: len(most)], most)
        for p in pairs.tolist():
            found[p // len(items.ids)].add(items.ids[p % len(items.ids)])
    hit = np.cumsum(edge[:-1]) > 0
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if hit.any():
        first = np.cumsum(length) - length
        starts = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & np.append(False, doc[1:] == doc[:-1])))
        ends = np.flatnonzero(hit & ~(np.append(hit[1:], False) & np.append(doc[1:] == doc[:-1], False))) + 1
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            spans[doc[a]].append((a - int(first[doc[a]]), b - int(first[doc[a]])))
    return length, spans, [sorted(x) for x in found], longest


KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def matches(docs: DataFrame, bench: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None, name: str = "match", size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """docs (or its columns `keep`) with a struct: the text's words, the spans of words (from 0, end exclusive) inside occurrences of windows of test items, the ids of those items sorted as strings, and the longest verbatim match, in words, of what holds a window.

    A null or empty text has no words and no match; an item without words is in nothing. Items that share an id are one item; a null id reads as an empty one. Rows that repeat an id are rows of their own. A very long text is a shard alone. Without documents there is no row, without items no match. The struct's name gets a suffix if it is taken.
    """
    spark = docs.sparkSession
    tests: list[Broadcast] = [spark.sparkContext.broadcast(x) for x in blocks(bench, key, text, window, block)]
    keep = docs.columns if keep is None else keep

    def held() -> Iterator[Items]:
        for b in tests:
            yield b.value
            if len(tests) > 1:  # one block at a time stays in memory
                vars(b).pop("_value", None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, size):
            n, spans, items, longest = shard(byte_column(batch, text), held())
            columns = [pa.array(n, pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], KIND[1].type), pa.array(items, KIND[2].type), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.StructArray.from_arrays(columns, fields=list(KIND))], names=[*keep, free(name, keep)])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(free(name, keep), T.StructType.fromDDL("n_words bigint, spans array<struct<begin: bigint, end: bigint>>, items array<string>, longest bigint"))
    return docs.mapInArrow(of, schema)


def decontaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The documents that have no window of a test item."""
    name = free("match", docs.columns)
    return matches(docs, bench, name=name, **how).where(F.size(f"{name}.spans") == 0).drop(name)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of documents is in benchmark."""
    found = matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("match.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    return found.select("doc_id", F.col("match.n_words").alias("n_words"), hit.alias("n_hit"), F.size("match.items").cast("long").alias("n_items"), F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"), F.col("match.longest").alias("longest_match")).withColumn("contaminated", F.col("n_hit") > 0)


WORDS = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(t="text")} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS.format(t="text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s, array_to_string(w[p : ], ' ') AS rest
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s, w FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d), sizes WHERE p + n - 1 <= len(w)),
hits AS (SELECT g.r, g.p, g.n, item, rest, array_to_string(g.w[g.p : ], ' ') AS here FROM grams AS g JOIN win USING (n, s)),
touched AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r),
deep AS (
  SELECT r, max(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[:k] = b[:k]))) AS longest
  FROM (SELECT r, string_split(here, ' ') AS a, string_split(rest, ' ') AS b FROM (SELECT DISTINCT r, p, here, rest FROM hits)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(longest, 0)::BIGINT AS longest_match, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN touched USING (r) LEFT JOIN items USING (r) LEFT JOIN deep USING (r)
"""
