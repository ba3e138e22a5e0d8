"""Line dedup by an exact set-similarity join: rarity order, prefix, position and length filters.

A line's tokens are its 5-word shingles; a line of fewer words has its whole sequence as its one token.
A row is known by (id, th), its id and a hash of its text, and a line by (id, th, line). Sets of tokens have
names of 128 bits (fp1, fp2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, group_shingles, mix, parts, pieces, read, word_hashes, written

SIZE = 5  # words of a shingle
SKETCH = 1 << 20  # counters of shingle frequencies: fixed, so what is broadcast does not grow
BLOCKS = 16
SEEN = 200_000  # sets that a task remembers, so as not to send them again
FEW = 8  # sets with a token that are all held against each other, and pivots of commoner tokens
HELD = 4_096  # rows of one token that the stream holds; of more it gives each on
TOP, OF = 3, 4  # similarity 3/4
NAME = ["fp1", "fp2"]
PLACE = ["id", "th", "line"]
NULL_ID = -(1 << 63)


def key() -> list[Column]:
    """id and th of a row. A null id comes before all others; its texts have hashes of their own, so that it is no other's row."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th")]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*key(), "text")


def line_shingles(texts: list[bytes], least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all lines with `least` words or more and the line of each, in line order; the text and the number of each such line."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    h, at, _ = word_hashes(raw)
    ends = np.flatnonzero(raw == 10)
    line = np.searchsorted(ends, at)  # all lines of all texts, counted on
    own, length = np.unique_counts(line) if len(line) else (line, line)
    if least > 1:
        keep = length >= least
        h, own, length = h[np.repeat(keep, length)], own[keep], length[keep]
    s, group = group_shingles(h, length, SIZE)
    if (group[1:] < group[:-1]).any():  # shorter lines' tokens come behind
        order = np.argsort(group.astype(np.uint16) if len(length) < 1 << 16 else group, kind="stable")
        s, group = s[order], group[order]
    edge = np.cumsum([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], ends + 1])[own]
    text = np.searchsorted(edge, begin, "right")
    first = np.searchsorted(ends, np.concatenate([[0], edge[:-1]]))  # the first line of each text
    return s, group, text, own - first[text]


def ordered(s: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each line, distinct, by rank and then by value."""
    key = (line.astype(np.uint64) << np.uint64(48)) | (rank.astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
    order = np.argsort(key)
    key, t = key[order], s[order]
    if (line >> 16).any() or ((key[1:] == key[:-1]) & (t[1:] < t[:-1])).any():  # what the key leaves out decides
        order = np.lexsort((s, rank, line))
        t = s[order]
    line = line[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (line[1:] != line[:-1])
    return t[new], line[new]


def repeated(s: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether a token has been in its line before."""
    key = mix(s + line.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    twice = np.sort(key)
    twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
    out = np.zeros(len(s), bool)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        order = np.lexsort((at, s[at], line[at]))
        x, y = s[at][order], line[at][order]
        out[at[order[1:]]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return out


def set_names(s: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a name for each line's set, whatever the order of its tokens."""
    out = []
    for salt in (0x94D049BB133111EB, 0xA24BAED4963EE407):
        acc = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(salt)))])
        out.append(mix(acc[start[1:]] - acc[start[:-1]]).view(np.int64))
    return out[0], out[1]


def bounds(line: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(line, np.arange(n + 1))


def line_sets_of(texts: list[bytes], least: int = 1, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """line_shingles() with the tokens of a line distinct, rare ones first if counts are given."""
    s, line, text, number = line_shingles(texts, least)
    if counts is None:
        own = ~repeated(s, line)
        return s[own], line[own], text, number
    return *ordered(s, line, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]), text, number


def line_table(docs: DataFrame, least: int = 1) -> DataFrame:
    """One pass over keyed texts: id, th, line, fp1, fp2 of each line, and, in rows with a block, counts of their tokens in SKETCH counters."""
    schema = "id long, th long, line int, fp1 long, fp2 long, block int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in pieces(batches):
            s, line, text, number = line_sets_of(byte_column(batch, "text"), least)
            total += np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            at, n = pa.array(text), len(text)
            fp = set_names(s, bounds(line, n))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), pa.array(number, pa.int32()), *map(pa.array, fp), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        own = [pa.nulls(BLOCKS, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*own, pa.array(range(BLOCKS), pa.int32()), pa.array(packed(total), pa.binary())], names=names)

    return docs.mapInArrow(run, schema)


def packed(total: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.minimum(total, 2**31 - 1).astype("<i4").reshape(BLOCKS, -1)]


def frequencies(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, as ranks of 16 bits by logarithm: 2 MB at any size. rows: block, counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BLOCKS, SKETCH // BLOCKS), np.int64)
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                total[b] += np.frombuffer(x.as_buffer(), "<i4")
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed(total.ravel()), pa.binary())], names=["block", "counts"])

    while rows.rdd.getNumPartitions() > 64:  # a tree of sums, so that no task adds more than a few dozen
        rows = written(rows.coalesce(max(1, rows.rdd.getNumPartitions() // 32)).mapInArrow(add, "block int, counts binary"), "counts")
    got = rows.coalesce(1).mapInArrow(add, "block int, counts binary").toPandas().sort_values("block")
    total = np.concatenate([np.frombuffer(x, "<i4") for x in got["counts"]]) if len(got) else np.zeros(SKETCH, np.int32)
    return np.round(np.log2(total + 1.0) * 2000).astype(np.uint16)


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """g (token), fp1, fp2, ni (size of the set and place in rarity order) for the rarest tokens of each line: as many as two sets of the wanted similarity cannot both do without.

    Lines of fewer than SIZE words are not among them: a set of one token is like none but its equals, which
    have the same name. A task gives the rows of a set once, or again where it has met SEEN others.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            s, line, text, _ = line_sets_of(byte_column(batch, "text"), SIZE, held.value)
            start = bounds(line, len(text))
            fp1, fp2 = set_names(s, start)
            fresh = np.zeros(len(fp1), bool)
            fresh[np.unique(fp1, return_index=True)[1]] = True
            both = (fp1 ^ mix(fp2.view(np.uint64)).view(np.int64)).tolist()
            fresh &= ~np.fromiter(map(seen.__contains__, both), bool, len(both))
            if len(seen) > SEEN:
                seen.clear()
            seen.update(x for x, new in zip(both, fresh.tolist(), strict=True) if new)
            n = np.diff(start)
            i = np.arange(len(s)) - np.repeat(start[:-1], n)
            most = np.where(fresh, n - -(-TOP * n // OF) + 1, 0)
            keep = i < np.repeat(most, n)
            own, i = line[keep], i[keep]
            yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(fp1[own]), pa.array(fp2[own]), pa.array(n[own] << 32 | i)], names=["g", "fp1", "fp2", "ni"])

    return docs.select("text").mapInArrow(run, "g long, fp1 long, fp2 long, ni long")


def fits(n: np.ndarray | Column, i: np.ndarray | Column, m: np.ndarray | Column, j: np.ndarray | Column, least: Callable, most: Callable) -> np.ndarray | Column:
    """Whether sets of n and m tokens that meet at places i and j of their orders can be similar enough, by length and by what is left behind the places."""
    return (OF * least(n, m) >= TOP * most(n, m)) & ((TOP + OF) * least(n - i, m - j) >= TOP * (n + m))


def paired(sorted_rows: DataFrame) -> DataFrame:
    """Of rows that lie sorted by g: the pairs (fp1, fp2, yfp1, yfp2; g null) of sets that share a token, where it is in up to FEW sets; the members (g, fp1, fp2, n, i) of commoner tokens. A stream that holds HELD rows of a token at most."""
    names = ["g", "fp1", "fp2", "yfp1", "yfp2", "n", "i"]

    def rows_of(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns["fp1"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in names], names=names)

    def members(x: np.ndarray) -> pa.RecordBatch:
        return rows_of(g=x[0], fp1=x[1], fp2=x[2], n=x[3] >> 32, i=x[3] & (2**32 - 1))

    def closed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """x: g, fp1, fp2, ni of whole tokens."""
        same = x[0, 1:] == x[0, :-1]
        more = np.zeros(x.shape[1], bool)
        more[1:] |= same
        more[:-1] |= same
        x = x[:, more]
        x = x[:, np.lexsort(x[2::-1])]
        x = x[:, np.concatenate([[True], (x[:3, 1:] != x[:3, :-1]).any(0)])] if x.shape[1] else x
        if not x.shape[1]:
            return
        begin = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
        k = np.diff(np.append(begin, x.shape[1]))
        run, large = np.repeat(np.arange(len(k)), k), np.repeat(k > FEW, k)
        if large.any():
            yield members(x[:, large])
        x, run = x[:, ~large], run[~large]
        n, i = x[3] >> 32, x[3] & (2**32 - 1)
        for d in range(1, FEW):
            a = np.flatnonzero(run[d:] == run[:-d])
            b = a + d
            ok = fits(n[a], i[a], n[b], i[b], np.minimum, np.maximum)
            a, b = a[ok], b[ok]
            if len(a):
                yield rows_of(fp1=x[1, a], fp2=x[2, a], yfp1=x[1, b], yfp2=x[2, b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = np.zeros((4, 0), np.int64), None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in ("g", "fp1", "fp2", "ni")])
            if hot is not None:
                n = int(np.searchsorted(x[0] != hot, True))
                yield members(x[:, :n])
                x = x[:, n:]
                hot = hot if not x.shape[1] else None
            x = np.concatenate([held, x], 1)
            if not x.shape[1]:
                continue
            last = int(np.searchsorted(x[0] == x[0, -1], True))
            yield from closed(x[:, :last])
            held = x[:, last:]
            if held.shape[1] > HELD:
                yield members(held)
                held, hot = held[:, :0], int(held[0, 0])
        yield from closed(held)

    return sorted_rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def name_of(x: str) -> list[Column]:
    return [F.col(c).alias(x + c) for c in NAME]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later set (fp1, fp2) of each pair (xfp1, xfp2, yfp1, yfp2) whose full sets are similar enough. sets: fp1, fp2, s (the set's tokens), and the id, th, line where it is first."""
    both = pairs
    for x in "xy":
        both = both.join(sets.select(*name_of(x), *[F.col(c).alias(x + c) for c in ("s", *PLACE)]), [x + c for c in NAME])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ok = []
            for p, q in zip(whole.column("xs"), whole.column("ys"), strict=True):
                a, b = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                x = np.concatenate([a, b])
                x.sort()
                n = int((x[1:] == x[:-1]).sum())
                ok.append(OF * n >= TOP * (len(a) + len(b) - n))
            own = whole.filter(pa.array(ok, pa.bool_()))
            later = np.zeros(own.num_rows, bool)
            for c in reversed(PLACE):
                x, y = own.column("x" + c).to_numpy(), own.column("y" + c).to_numpy()
                later = (x > y) | ((x == y) & later)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(later, own.column("x" + c).to_numpy(), own.column("y" + c).to_numpy())) for c in NAME], names=NAME)

    return both.mapInArrow(run, "fp1 long, fp2 long")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp1, fp2, s (packed tokens) and place of the wanted lines, given as id, th, line: each row brings only those."""
    asked = wanted.groupBy("id", "th").agg(F.collect_list("line").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            some, at, numbers = [], [], []
            for n, (text, asked) in enumerate(zip(byte_column(batch, "text"), batch.column("asked").to_pylist(), strict=True)):
                own = text.split(b"\n")
                some += [own[k] for k in asked]
                at += [n] * len(asked)
                numbers += asked
            s, line, text, _ = line_sets_of(some)
            start = bounds(line, len(text))
            sets = [s[a:b].astype("<u8").tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            row = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, set_names(s, start)), pa.array(sets, pa.binary()), batch.column("id").take(row), batch.column("th").take(row), pa.array(numbers, pa.int32())], names=[*NAME, "s", *PLACE])

    return docs.join(asked, ["id", "th"]).mapInArrow(run, "fp1 long, fp2 long, s binary, id long, th long, line int").dropDuplicates(NAME)


def later_matches(shared: DataFrame, first: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Names of the sets that have an earlier similar one, from what paired() gives and the first line of each set (fp1, fp2, o: a struct that sorts by place).

    As with documents, no token gives all pairs of its lines. The sets of a token of up to FEW are all paired.
    Of a commoner token first the pivots, the earliest of each of FEW hash slices, are held against the other
    members. Copies of one line have found their match then. What has none yet is held against all
    earlier members of the token, once: nothing is left out.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        """The later sets of the pairs that are similar."""
        names = pairs.select(F.explode(F.array(F.struct(F.col("xfp1").alias("fp1"), F.col("xfp2").alias("fp2")), F.struct(F.col("yfp1").alias("fp1"), F.col("yfp2").alias("fp2")))).alias("n")).select("n.*").distinct()
        return written(confirmed(pairs, written(sets_of(names), "sets")).distinct(), "found")

    def candidates(later: DataFrame, earlier: DataFrame) -> DataFrame:
        p = earlier.select("g", *name_of("y"), F.col("o").alias("py"), F.col("n").alias("m"), F.col("i").alias("j"))
        met = later.join(p, "g").where((F.col("py") < F.col("o")) & fits(*map(F.col, ("n", "i", "m", "j")), F.least, F.greatest))
        x, y = F.struct("fp1", "fp2"), F.struct(F.col("yfp1").alias("fp1"), F.col("yfp2").alias("fp2"))
        met = met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
        return met.select(*[F.col(f"{x}.{c}").alias(x + c) for x in "xy" for c in NAME])

    pairs = shared.where("g IS NULL").select(*name_of("x"), "yfp1", "yfp2")
    large = shared.where("g IS NOT NULL").select("g", *NAME, "n", "i").dropDuplicates(["g", *NAME])
    large = written(large.join(first, NAME), "large")
    hot = bool(large.take(1))
    if hot:
        pivots = large.groupBy("g", F.pmod(F.xxhash64(*NAME), F.lit(FEW)).alias("slice")).agg(F.min(F.struct("o", "fp1", "fp2", "n", "i")).alias("p")).select("g", "p.*")
        pairs = pairs.unionByName(candidates(large, pivots))
    pairs = written(pairs.distinct(), "pairs")
    found = verified(pairs)
    if not hot:
        return found
    rest = large.join(found, NAME, "left_anti")
    # the earliest of a token has nothing before it
    least = large.groupBy("g").agg(F.min("o").alias("least"))
    rest = written(rest.join(least, "g").where("o > least").drop("least"), "open")
    if not rest.take(1):
        return found
    new = verified(written(candidates(rest, large).distinct().join(pairs, pairs.columns, "left_anti"), "pairs"))
    return found.unionByName(new).distinct()


def removed_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """id, th, line (from 0) of the lines that go: those with a similar line before them, by (id, th, line), anywhere in the table.

    Similar: the sets of tokens have Jaccard 3/4 or more; equal sets are. The line before need not stay
    itself. Lines without words and lines of null texts stay, so do those of fewer than `least` words. Rows
    with null ids come first; rows that repeat an id are rows of their own, in the order of their texts'
    hashes; rows that repeat both id and text lose the same lines. An empty table gives no rows; columns other
    than doc_id and text are not looked at. Texts of any length are read whole.
    """
    docs = keyed(docs)
    both = written(line_table(docs, least), "lines")
    every = both.where("block IS NULL").select(*PLACE, *NAME)
    first = written(every.groupBy(*NAME).agg(F.min(F.struct(*PLACE)).alias("o")), "first")
    counts = frequencies(both.where("block IS NOT NULL").select("block", "counts"))
    rows = prefixes(docs, counts).repartition(parts(docs.sparkSession), "g").sortWithinPartitions("g")
    shared = written(paired(rows), "shared")
    found = later_matches(shared, first, lambda names: line_sets(docs, first.join(names, NAME, "left_semi").select("o.*")))
    # what stays is the first line of each set that has no earlier similar one: no join deals all copies of a line by its name
    stay = first.join(found, NAME, "left_anti").select("o.*")
    return every.select(*PLACE).join(stay, PLACE, "left_anti").distinct()


def without_repeats(docs: DataFrame, least: int = 1) -> DataFrame:
    """docs with the removed lines cut from `text`; all rows and columns stay, whatever their names."""
    gone = removed_lines(docs, least).groupBy("id", "th").agg(F.collect_list("line").alias("numbers"))
    row = docs.select(F.struct(*docs.columns).alias("row"), *key())
    text = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("numbers", i)), "\n")
    out = row.join(gone, ["id", "th"], "left")
    return out.select(*[F.when(F.col("numbers").isNull(), F.col("row.text")).otherwise(text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the numbers of the removed lines."""
    docs = read(spark, sf_dir, "documents")
    gone = removed_lines(docs).groupBy("id", "th").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    n = docs.select("doc_id", *key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return n.join(gone, ["id", "th"], "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.col("removed").cast("array<long>"), F.array().cast("array<long>")).alias("removed"))
