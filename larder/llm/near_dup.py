"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, mix, pieces, read, shingle_sets, written
from .graph import components

SLOTS = 128
BAND = 4  # slots of a band: a pair at 0.75 shares one of 32 bands but in 5 of a million cases
FEW = 8  # ids of a band that are all held against each other, and pivots of larger bands
CHUNK = 1 << 17  # elements whose permutations are held at once
DIFFER = 64  # of the 256 bits of two sketches, at most, for a pair to be looked at
WORDS = 16  # longs of the bitmap that bounds what two sets do not share


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots) signatures of the sets whose elements (uint64 hashes) belong to `owner`, sorted by it.

    Each element draws a permutation of the slots step by step; in step j it offers j plus a fraction to the
    slot that its permutation has at j. What is offered later is larger, so a set is done as soon as all its
    slots hold less than the next step can offer; large sets end after two or three steps.
    """
    sign = np.full((n, slots), np.iinfo(np.uint64).max)
    flat = sign.ravel()
    for a in range(0, len(elements), CHUNK):
        x, own = elements[a : a + CHUNK], owner[a : a + CHUNK].astype(np.int64)
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
        row = np.arange(len(x))
        for j in range(slots):
            draw = mix(x[row] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
            k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            np.minimum.at(flat, own[row] * slots + slot, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
            sets = np.unique(own[row])
            open_ = np.zeros(n, bool)
            open_[sets] = sign[sets].max(1) >= np.uint64((j + 1) << 32)
            row = row[open_[own[row]]]
            if not len(row):
                break
    return sign


def band_keys(sign: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each run of `band` slots; the run's place is part of it."""
    n, slots = sign.shape
    acc = np.tile(np.arange(slots // band, dtype=np.uint64), (n, 1))
    for k in range(band):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sign[:, k::band][:, : slots // band])
    return acc.view(np.int64)


def sketch(sign: np.ndarray) -> np.ndarray:
    """Two bits of each of the 128 slots, as four longs."""
    h = mix(sign)
    bits = np.stack([(h >> np.uint64(1)) & np.uint64(1), (h >> np.uint64(2)) & np.uint64(1)], 2).reshape(len(sign), 4, 64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, fp1 and fp2 (128 bits that name the set), bands, s (256 bits of the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, size = shingle_sets(byte_column(batch, "text"))
            sign = superminhash(flat, np.repeat(np.arange(len(size)), size), len(size))
            fp = []
            for salt in (0, 0xA24BAED4963EE407):
                acc = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(salt)))])
                end = np.cumsum(size)
                fp.append(pa.array((acc[end] - acc[end - size]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(size), *fp, lists(band_keys(sign)), lists(sketch(sign))], names=["doc_id", "th", "n_shingles", "fp1", "fp2", "bands", "s"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, fp1 long, fp2 long, bands array<long>, s array<long>")


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def packed_sets(texts: DataFrame) -> DataFrame:
    """id and set: the text's shingles, sorted, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, size = shingle_sets(byte_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])], pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def sets_in(batch: pa.RecordBatch, name: str = "set") -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(name)]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= 75 * union. sets: id, set."""
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(sets_in(batch, "set_a"), sets_in(batch, "set_b"), strict=True):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                n = int((x[at] == y).sum())
                ok.append(100 * n >= 75 * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def alike(x: str, y: str, most: int | None = DIFFER) -> Column:
    """Whether two ids can be linked at all: by their sizes, and by two bits of each slot of their signatures.

    At a similarity of 0.75 the 256 bits differ in 32 places, with a deviation of 6.3; a pair that differs in
    over 64 is passed over, which a linked pair does once in some million cases (as the bands do). `most` None:
    the sizes alone, so that only the bands can miss a pair.
    """
    sizes = 100 * F.least(f"{x}n", f"{y}n") >= 75 * F.greatest(f"{x}n", f"{y}n")
    if most is None:
        return sizes
    differ = sum(F.bit_count(F.col(f"{x}s")[k].bitwiseXOR(F.col(f"{y}s")[k])) for k in range(4))
    return (differ <= most) & sizes


def lone_shingles(sets: DataFrame) -> DataFrame:
    """id and lone: the number of its shingles that no other of these sets has; ids without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column("id").to_pylist(), sets_in(batch), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), i))], names=["h", "id"])

    rows = sets.select("id", "set").mapInArrow(run, "h long, id long")
    once = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))


def bitmaps(sets: DataFrame) -> DataFrame:
    """id and bits: each shingle of the set flips one of WORDS * 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.bincount((s % np.uint64(WORDS * 64)).astype(np.int64), minlength=WORDS * 64) & 1 for s in sets_in(batch)]
            packed = [np.packbits(b.astype(np.uint8)).view(np.int64) for b in bits]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.list_(pa.int64()))], names=["id", "bits"])

    return sets.select("id", "set").mapInArrow(run, "id long, bits array<long>")


def can_link(x: str, y: str) -> Column:
    """Exact: the bits in which two bitmaps differ are each of a shingle that only one set has, and linked sets have at most a seventh of both sizes of those."""
    differ = sum(F.bit_count(F.col(f"{x}bits")[k].bitwiseXOR(F.col(f"{y}bits")[k])) for k in range(WORDS))
    return 7 * differ <= F.col(f"{x}n") + F.col(f"{y}n")


def link_classes(members: DataFrame, sets: DataFrame, differ: int | None = DIFFER) -> DataFrame:
    """(id, component) of the ids that are linked, from members (g, k, id, s, n): ids that share a band g, of k ids, are candidates.

    No band gives all its pairs. First a band's pivots are held against its members: all of a band of up to
    FEW ids, else the smallest id of each of FEW hash slices. A band of copies of one text is one component
    then. Where a large band is not, the ids outside its largest component are held against all members of
    other components, once: so every pair in a band is compared or joined already, at any size. Passed over
    are only pairs that cannot be linked: one has too few shingles that any other open id has, too, or their
    bitmaps differ in more bits than a linked pair's sets do in shingles.
    """
    slice_ = F.when(F.col("k") <= FEW, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(FEW)))
    pivots = members.groupBy("g", slice_.alias("slice")).agg(F.min(F.struct("id", "s", "n")).alias("p")).select("g", F.col("p.id").alias("pid"), F.col("p.s").alias("ps"), F.col("p.n").alias("pn"))
    pairs = members.join(pivots, "g").where(F.when(F.col("k") <= FEW, F.col("pid") < F.col("id")).otherwise(F.col("pid") != F.col("id")) & alike("", "p", differ))
    pairs = written(pairs.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct(), "pairs")
    links = written(confirmed(pairs, sets), "links")
    component = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    own = members.where(F.col("k") > FEW).join(component, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    main = own.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("cs")).where("cs > 1").select("g", "main")
    own = written(own.join(main, "g"), "open")
    if not own.take(1):
        return component
    still = sets.join(own.select("id").distinct(), "id", "left_semi")
    alone = lone_shingles(still)
    own = own.join(alone, "id", "left").withColumn("m", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    # what two sets share is at least 3/7 of both sizes together, and no more than either shares with anyone
    able = written(own.where(4 * F.col("m") >= 3 * F.col("n")).join(bitmaps(still), "id"), "open")
    out = able.where("c <> main").select("g", F.col("id").alias("pid"), F.col("s").alias("ps"), F.col("bits").alias("pbits"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("c").alias("pc"))
    fits = 7 * F.least("m", "pm") >= 3 * (F.col("n") + F.col("pn"))
    more = able.join(out, "g").where((F.col("c") != F.col("pc")) & fits & alike("", "p", differ) & can_link("", "p"))
    more = more.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    new = written(confirmed(written(more, "pairs"), sets), "links")
    return components(links.unionByName(new).select(F.col("a").alias("u"), F.col("b").alias("v"))) if new.take(1) else component


def near_duplicates(docs: DataFrame, differ: int | None = DIFFER) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id it reaches over links), kept, th (xxhash64 of its text).

    Texts with one shingle set are one class, whatever their number; only classes are banded and compared, under
    numbers of their own. Null and wordless texts have no shingles, link with nothing and stay. Rows with a null
    id link with nothing either: component_id is null, kept true. Rows that repeat an id are rows of their own,
    each linked by its text, and all that have the smallest id of their component are kept. Ties do not arise:
    ids decide. An empty table gives no rows; other columns are not looked at. Texts are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sign = written(signatures(docs), "signatures")
    able = sign.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("bands").alias("bands"), F.first("s").alias("s"), F.first("n_shingles").alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "fp1", "fp2", "r.doc_id", "r.th", "bands", "s", "n"), "classes")
    every = classes.select(F.explode("bands").alias("g"), "id")
    shared = every.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = written(every.join(shared, "g").join(classes.select("id", "s", "n"), "id"), "members")
    ids = members.select("id").distinct().join(classes.select("id", "doc_id", "th"), "id")
    texts = docs.withColumn("th", F.xxhash64("text")).join(ids, ["doc_id", "th"]).select("id", "text")
    component = link_classes(members, written(packed_sets(texts).dropDuplicates(["id"]), "sets"), differ)
    linked = component.join(classes.select("id", "doc_id"), "id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "component").select("id", "component_id")
    named = classes.join(linked, "id", "left").select("fp1", "fp2", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sign.select("doc_id", "th", "n_shingles", "fp1", "fp2", (F.col("n_shingles") > 0).alias("able")).join(named.withColumn("able", F.lit(True)), ["fp1", "fp2", "able"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "th")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("th")
