"""A trie of the beginnings that conversations share.

Conversations are sorted by their turns' hashes, over all machines; the tree is the Cartesian tree of the longest common prefixes (LCP) of neighbours. Each range of the sorted rows is a block: there, the nearest smaller LCP on either side of each row gives its nodes (a row begins those of the depths its LCP lacks, all that share an interval and an LCP being one) and the end of their intervals, over which all columns are sums. What reaches a block's first or last row is told by one record a block; a sweep over these records, as many as partitions, closes the intervals that cross blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, parts, read, written
from .merkle import CRC

WIDTH = 16  # bytes of a turn's hash
FEW = 100_000  # records of block edges that are broadcast at most; beyond, they are joined by shuffle
NONE = hashlib.sha256(b"").hexdigest()
COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

EDGE = pa.struct([(c, pa.int64()) for c in ("depth", "rows", "least", "children", "leaves", "saved", "words")])
NODE = [("what", pa.int32()), ("block", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("above", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())]
BLOCK = pa.schema([*NODE, ("first", pa.binary()), ("last", pa.binary()), ("least_lcp", pa.int64()), ("into", pa.list_(EDGE)), ("out", pa.list_(EDGE))])
_EDGE = "array<struct<depth:long,rows:long,least:long,children:long,leaves:long,saved:long,words:long>>"
_NODE = "what int, block long, conv_id long, depth long, parent long, above int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
SWEPT = pa.schema([("what", pa.int32()), ("block", pa.int64()), ("depth", pa.int64()), ("side", pa.int32()), ("own_block", pa.int64()), ("own_side", pa.int32()), ("conv_id", pa.int64()), ("above_block", pa.int64()), ("above_side", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
_SWEPT = "what int, block long, depth long, side int, own_block long, own_side int, conv_id long, above_block long, above_side int, n_convs long, n_children long, n_leaves long, saved_tokens long"
INTO, OUT = 0, 1  # the two sides of a block


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Of each conversation: its id, its turns' hashes end to end (seq) and the words of each turn's text. It has the first h turns of the conversation at the last multiple of `every`, then its own after its first h; h is the crc32 of its id modulo `heads`.

    Turns stand by number, null first; those of one number by the md5 of their content. A null role or text is an empty one. Rows without a conv_id are no conversation's.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", said.alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    own = written(own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "own-turns")
    first = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).join(first, "base", "left").withColumn("h", h)
    all_turns = F.concat(F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(own, 1, 0)")), F.expr("slice(own, h + 1, size(own))"))
    both = both.select("conv_id", all_turns.alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join("turns.said", "")).alias("seq"), F.col("turns.words").alias("words"))


def ragged(size: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, end to end."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def lcps(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Turns of each row, and how many the row shares with the one before (the first: -1)."""
    raw = np.frombuffer(b"".join(seq.to_pylist()), ">u8").reshape(-1, WIDTH // 8)
    size = pc.binary_length(seq).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
    start = np.cumsum(size) - size
    both = np.minimum(size[:-1], size[1:])
    k = ragged(both)
    differs = (raw[np.repeat(start[:-1], both) + k] != raw[np.repeat(start[1:], both) + k]).any(axis=1)
    out = np.append(-1, both)
    row = np.repeat(np.arange(1, len(size)), both)
    np.minimum.at(out, row[differs], k[differs])
    return size, out


def smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest before and after it that holds less: -1 and len(x) if none does."""
    before, after, stack = np.full(len(x), -1), np.full(len(x), len(x)), []
    for i, v in enumerate(x.tolist()):
        while stack and stack[-1][1] > v:
            after[stack.pop()[0]] = i
        if stack:
            before[i] = before[stack[-1][0]] if stack[-1][1] == v else stack[-1][0]
        stack.append((i, v))
    return before, after


class Least:
    """The least of any range of an array, by ranges of powers of two."""

    def __init__(self, x: np.ndarray):
        self.by = [x]
        while 2 * (k := 1 << (len(self.by) - 1)) <= len(x):
            self.by.append(np.minimum(self.by[-1][:-k], self.by[-1][k:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        level = np.frexp((b - a).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.by[k][a[at]], self.by[k][b[at] - (1 << k)])
        return out


def block(number: int, ids: np.ndarray, seq: pa.Array, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes that lie inside a block of sorted rows, and its record: what reaches its edges, depth by depth."""
    n = len(ids)
    size, lcp = lcps(seq)
    before, after = smaller(lcp)
    count = size - lcp  # a row's nodes: of depths lcp + 1 to its turns; the first row's, from the root, may be those of earlier blocks
    begin = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(n), count)
    depth = lcp[row] + 1 + ragged(count)
    end = row + 1  # the first row after that shares fewer turns
    while True:
        go = np.flatnonzero(end < n)
        go = go[lcp[end[go]] >= depth[go]]
        if not len(go):
            break
        end[go] = after[end[go]]
    inner = (row > 0) & (end < n)
    up = np.where(depth - 1 > lcp[row], np.arange(len(row)) - 1, begin[before[row]] + depth - 1 - lcp[before[row]] - 1)
    up[0] = 0
    children = np.bincount(up[inner], minlength=len(row))
    at_last = np.where(depth > 0, np.repeat(np.cumsum(size) - size, count) + depth - 1, 0)
    own_words = np.where(depth > 0, words[at_last] if len(words) else 0, 0)
    total = lambda x: np.append(0, np.cumsum(np.where(inner, x, 0)))
    span = end - row
    saved, leaves = total((span - 1) * own_words), total(children == 0)
    over = lambda x: x[begin[end]] - x[np.arange(len(row))]
    saved, leaves, least = over(saved), over(leaves), Least(ids)(row, end)
    same = np.append(False, (lcp[1:] == size[1:]) & (size[1:] == size[:-1]))  # rows that repeat the one before
    group = np.append(np.flatnonzero(~same), n)
    stop = np.zeros(n, np.int64)
    stop[group[:-1]] = group[1:]
    whole = np.flatnonzero((depth == size[row]) & (stop[row] > 0))  # nodes where conversations end, all of one group
    said = {int(k): ",".join(map(str, ids[row[k] : stop[row[k]]].tolist())) for k in whole}
    k = np.flatnonzero(inner)
    high = up[k]
    crossing = ~inner[high]
    rows = {
        "what": np.zeros(len(k)), "block": np.full(len(k), number), "conv_id": least[k], "depth": depth[k], "parent": np.where(crossing, -1, least[high]), "above": np.where(crossing, np.where(row[high] > 0, OUT, INTO), -1),
        "n_convs": span[k], "n_children": children[k], "n_leaves": leaves[k], "saved_tokens": saved[k],
    }
    hashed = [hashlib.sha256(said[x].encode()).hexdigest() if x in said else NONE for x in k.tolist()]
    nodes = [*[pa.array(rows[c], t) if c != "parent" else pa.array(rows[c], t, mask=crossing) for c, t in NODE[:-1]], pa.array(hashed)]
    rest = [pa.nulls(len(k), f.type) for f in list(BLOCK)[len(NODE) :]]
    yield pa.RecordBatch.from_arrays([*nodes, *rest], schema=BLOCK)
    edges = np.flatnonzero(~inner)
    lists: list[list[dict]] = [[], []]
    for x in edges.tolist():
        lists[INTO if row[x] == 0 else OUT].append({"depth": int(depth[x]), "rows": int(span[x]), "least": int(least[x]), "children": int(children[x]), "leaves": int(leaves[x]), "saved": int(saved[x]), "words": int(own_words[x])})
    lists[OUT].sort(key=lambda e: e["depth"])
    record = {"what": 1, "block": number, "first": seq[0].as_py(), "last": seq[n - 1].as_py(), "least_lcp": int(lcp[1:].min()) if n > 1 else None, "into": lists[INTO], "out": lists[OUT]}
    ends = [{"what": 2, "block": number, "depth": int(depth[x]), "above": INTO if row[x] == 0 else OUT, "ends": said[x]} for x in edges.tolist() if x in said]
    yield pa.RecordBatch.from_pylist([record, *ends], schema=BLOCK)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is None or not table.num_rows:
        return
    words = table.column("words").combine_chunks()
    yield from block(TaskContext.get().partitionId(), table.column("conv_id").to_numpy(), table.column("seq").combine_chunks(), words.flatten().to_numpy())


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks' records, in order: the nodes that reach an edge, and which of them each block's incoming depths are. Open nodes are a stack, one a depth."""
    stack: list[dict] = []
    out: list[dict] = []
    last = b""

    def push(e: dict, number: int, side: int) -> None:
        if stack:
            stack[-1]["children"] += 1
        stack.append(e | {"block": number, "side": side, "more": 0, "tips": 0})

    def close(depth: int) -> None:
        """Nodes deeper than this end here."""
        while stack and len(stack) - 1 > depth:
            e = stack.pop()
            above = stack[-1] if stack else None
            e["more"] += (e["rows"] - 1) * e["words"]
            e["tips"] += not e["children"]
            out.append({"what": 0, "depth": e["depth"], "own_block": e["block"], "own_side": e["side"], "conv_id": e["least"], "above_block": above and above["block"], "above_side": above and above["side"], "n_convs": e["rows"], "n_children": e["children"], "n_leaves": e["leaves"] + e["tips"], "saved_tokens": e["saved"] + e["more"]})
            if above:
                above["more"] += e["more"]
                above["tips"] += e["tips"]

    for batch in batches:
        for r in batch.to_pylist():
            alike = shared(last, r["first"]) if stack else -1
            close(alike)
            for e in r["into"]:
                if e["depth"] <= alike:
                    own = stack[e["depth"]]
                    own["least"] = min(own["least"], e["least"])
                    for c in ("rows", "children", "leaves", "saved"):
                        own[c] += e[c]
                else:
                    push(e, r["block"], INTO)
                own = stack[e["depth"]]
                out.append({"what": 1, "block": r["block"], "depth": e["depth"], "side": INTO, "own_block": own["block"], "own_side": own["side"]})
            if r["least_lcp"] is not None:
                close(r["least_lcp"])
            for e in r["out"]:
                push(e, r["block"], OUT)
                out.append({"what": 1, "block": r["block"], "depth": e["depth"], "side": OUT, "own_block": r["block"], "own_side": OUT})
            last = r["last"]
        yield pa.RecordBatch.from_pylist(out, schema=SWEPT)
        out.clear()
    close(-1)
    yield pa.RecordBatch.from_pylist(out, schema=SWEPT)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, whose pieces come in order; one piece is held at a time."""
    key, state, out = None, None, []

    def done() -> None:
        if key is not None:
            out.append((*key, state.hexdigest()))

    for batch in batches:
        for b, d, s, ends in zip(*[batch.column(c).to_pylist() for c in ("own_block", "depth", "own_side", "ends")], strict=True):
            if key != (b, d, s):
                done()
                key, state = (b, d, s), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    done()
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["own_block", "depth", "own_side", "ends_sha256"])


def trie(sequences: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, seq, words; see rebuilt): its smallest member, depth, parent, members, children, childless nodes below it, tokens saved, and the hash of the ids that end there.

    Conversations alike in all turns share all their nodes, however many they are: rows are dealt by (seq, conv_id). A conversation of many turns is one row of a hash a turn. One without turns is a member of the root alone. Without conversations there is no node. What one task holds is a range of rows; records of block edges, which one task sweeps, are as many as ranges, of a row a depth. The hash of one node's ids takes them in order, so the ids (not the turns) of one very large group of equal conversations pass through one task, in pieces of a range each.
    """
    spark = sequences.sparkSession
    rows = written(sequences, "sequences")
    rows = rows.repartitionByRange(parts(spark), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    found = written(rows.mapInArrow(blocks, f"{_NODE}, first binary, last binary, least_lcp long, into {_EDGE}, out {_EDGE}"), "trie-blocks")
    records = found.where("what = 1").select("block", "first", "last", "least_lcp", "into", "out")
    swept = written(records.repartition(1).sortWithinPartitions("block").mapInArrow(sweep, _SWEPT), "swept")
    own = ["own_block", "depth", "own_side"]
    cross = swept.where("what = 0").drop("what", "block", "side")
    edge = swept.where("what = 1").select("block", "depth", "side", "own_block", "own_side")
    few = (lambda df: F.broadcast(df)) if swept.count() <= FEW else (lambda df: df)
    pieces = found.where("what = 2").select("block", "depth", F.col("above").alias("side"), "ends").join(few(edge), ["block", "depth", "side"])
    ends = pieces.repartition(*own).sortWithinPartitions(*own, "block", "side").select(*own, "ends").mapInArrow(hashed, "own_block long, depth long, own_side int, ends_sha256 string")
    parents = cross.select(F.col("own_block").alias("above_block"), F.col("own_side").alias("above_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    crossing = cross.join(parents, ["above_block", "above_side", "depth"], "left").join(ends, own, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    heads = edge.join(cross.select(*own, "conv_id"), own).select("block", (F.col("depth") + 1).alias("depth"), F.col("side").alias("above"), F.col("conv_id").alias("head"))
    nodes = found.where("what = 0")
    loose = nodes.where("above >= 0").join(few(heads), ["block", "depth", "above"]).withColumn("parent", F.col("head"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    of = lambda df: df.withColumnsRenamed({"parent": "parent_conv_id", "ends": "ends_sha256"}).select(*names)
    return of(nodes.where("above < 0")).unionByName(of(loose)).unionByName(crossing.select(*names))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(read(spark, sf_dir, "conversations")))


OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS said, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, {CRC.format(id="c")} % 4 AS h, list({{'said': said, 'words': words}} ORDER BY turn NULLS FIRST, said) AS turns FROM t GROUP BY c),
seqs AS (SELECT o.c, list_concat(CASE WHEN o.h > 0 THEN coalesce(b.turns[1 : o.h], []) ELSE [] END, o.turns[o.h + 1 :]) AS turns FROM own AS o LEFT JOIN own AS b ON b.c = o.c - o.c % 20),
flat AS (SELECT c, len(turns) AS n, array_to_string(list_transform(turns, lambda x: x.said), '') AS seq, list_transform(turns, lambda x: x.words) AS words FROM seqs),
places AS (SELECT c, n, words, seq, unnest(range(0, n + 1)) AS d FROM flat),
nodes AS (SELECT d, seq[1 : 32 * d] AS k, count(*) AS n_convs, min(c) AS conv_id, any_value(CASE WHEN d > 0 THEN words[d] ELSE 0 END) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM places GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, k[1 : 32 * (d - 1)] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sums AS (
  SELECT u AS d, k[1 : 32 * u] AS k, sum((n_convs - 1) * words) AS saved, count(*) FILTER (childless) AS leaves
  FROM (SELECT nodes.d, nodes.k, n_convs, words, kids.n IS NULL AS childless, unnest(range(0, nodes.d + 1)) AS u FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.k = nodes.k) GROUP BY 1, 2)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes AS x JOIN sums ON sums.d = x.d AND sums.k = x.k LEFT JOIN kids ON kids.d = x.d AND kids.k = x.k LEFT JOIN nodes AS p ON p.d = x.d - 1 AND p.k = x.k[1 : 32 * (x.d - 1)]
"""
