"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. NAME.bin holds raw ids, little-endian, 16 bits each if the vocabulary allows and 32
otherwise, document after document: first those without a key, then by key. NAME.idx is an .npz archive:
`nulls`, the number of documents without a key; `keys` of the others and `offsets` (of all, n + 1, in ids) in
file order; and the hash over the distinct keys: `sizes` and `bits` of its levels, and for each slot `prints`
(32 bits of the key's hash), `first` (its first document) and `count`. A manifest table lists the shards in
order, with the ids before each.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_column, mix, new_dir, parts, pieces, read, vocabulary, word_hashes

CACHE = 1_000_000  # words that a worker remembers, in some 30 bytes each
ROOM = 200_000  # words that are learned at once
CORES = 300_000  # words without their marks that it remembers
MARKS = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
SIGMA = "Σ".encode()  # its lower case depends on what follows
ROLL = 32 << 20  # bytes of ids after which a shard ends
LEAST = -(1 << 63)


class Numbered:
    """Numbers for 64-bit hashes, in the order in which they come: open addressing, all of an array at once."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most).bit_length())
        self.hash, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.count = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            there = self.hash[at]
            hit = there == h[left]
            out[left[hit]] = self.number[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that aren't there yet; none is 0."""
        number = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.hash[at] == 0
            self.hash[at[free]] = h[free]  # of several for one place the last stays
            own = self.hash[at] == h
            self.number[at[own]] = number[own]
            h, number, at = h[~own], number[~own], (at[~own] + 1) & ((1 << self.bits) - 1)


class LibraryEncoder:
    """The tokenizers library, asked once for each word: white space always ends a token, so a text's ids are those of its words.

    Of a word that is letters with ASCII marks behind, letters and marks are asked for apart, as the
    vocabulary's pattern cuts between them; letters go to the library many words at a time, as a token that ends a
    word says so. The ids of up to CACHE words are remembered, by 64-bit hashes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cores: dict[bytes, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered(CACHE + ROOM)
        self.start, self.size = np.zeros(CACHE + ROOM, np.int64), np.zeros(CACHE + ROOM, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0

    def asked(self, words: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(words), 10_000):
            out += [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(words[a : a + 10_000], add_special_tokens=False)]
        return out

    def letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters alone."""
        out: list[bytes] = []
        for a in range(0, len(words), 1_000):
            some = [w.decode() for w in words[a : a + 1_000]]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or (len(ids) and cut[-1] != len(ids)):
                out += self.asked(some)
                continue
            flat = ids.astype(self.kind).tobytes()
            cut = [0, *(cut * self.width).tolist()]
            out += [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, lower-cased."""
        cores, cut, odd = self.cores, [], []
        if len(cores) > CORES:
            cores.clear()
        for k, w in enumerate(words):
            c = w.rstrip(MARKS)
            if c.isalpha() or (c and not c.isascii() and SIGMA not in c and c.decode("utf-8", "replace").isalpha()):
                cut.append((k, c, w[len(c) :]))
            else:
                odd.append(k)
        some = list({c for _, c, _ in cut if c not in cores})
        cores.update(zip(some, self.letters(some), strict=True))
        some = list({m for _, _, m in cut if m and m not in cores})
        cores.update(zip(some, self.asked([m.decode() for m in some]), strict=True))
        out = [b""] * len(words)
        for k, c, m in cut:
            out[k] = cores[c] + cores[m] if m else cores[c]
        for k, x in zip(odd, self.asked([words[k].decode("utf-8", "replace") for k in odd]), strict=True):
            out[k] = x
        return out

    def learn(self, h: np.ndarray, words: list[bytes]) -> None:
        ids = self.words(words)
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        a, n = self.known.count, len(ids)
        self.known.add(h)
        self.start[a : a + n], self.size[a : a + n] = self.used + np.cumsum(size) - size, size
        if self.used + len(flat) > len(self.flat):
            more = np.zeros(2 * (self.used + len(flat)), self.kind)
            more[: self.used] = self.flat[: self.used]
            self.flat = more
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. One with what may be an added token, which keeps its case, goes to the library as it is."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        whole = [i for i, t in enumerate(texts) if b"<|" in t]
        for i, x in zip(whole, self.asked([texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
            out[i] = np.frombuffer(x, self.kind)
        rest = [i for i, t in enumerate(texts) if b"<|" not in t]
        raw = b"\n".join([texts[i] for i in rest])
        h, at, width = word_hashes(np.frombuffer(raw, np.uint8))
        h |= np.uint64(1)  # 0 is an empty place
        order = np.argsort(h)
        sorted_ = h[order]
        new = starts(sorted_)
        own = sorted_[new]
        for a in range(0, len(own), ROOM):
            if self.known.count > CACHE and a == 0:
                self._forget()
            part = slice(a, a + ROOM)
            miss = np.flatnonzero(self.known.find(own[part]) < 0)
            one = order[new[part]][miss]
            self.learn(own[part][miss], [raw[x : x + n].lower() for x, n in zip(at[one].tolist(), width[one].tolist(), strict=True)])
            if self.known.count > CACHE and a + ROOM < len(own):
                return self._in_halves(texts)
        number = np.empty(len(h), np.int64)
        number[order] = np.repeat(self.known.find(own), np.diff(np.append(new, len(h))))
        size = self.size[number].astype(np.int64)
        upto = np.cumsum(size)
        flat = self.flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.start[number] - upto + size, size)]
        ends = np.searchsorted(at, np.cumsum([len(texts[i]) + 1 for i in rest]))
        cut = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist() if rest else [0]
        for i, x, y in zip(rest, cut[:-1], cut[1:], strict=True):
            out[i] = flat[x:y]
        return out

    def _in_halves(self, texts: list[bytes]) -> list[np.ndarray]:
        """More distinct words than can be remembered: a text alone is asked for as it is."""
        if len(texts) == 1:
            return [np.frombuffer(self.asked([texts[0].decode("utf-8", "replace")])[0], self.kind)]
        half = len(texts) // 2
        return self.encode(texts[:half]) + self.encode(texts[half:])


_ready: dict[str, LibraryEncoder] = {}


def perfect_hash(keys: np.ndarray, slack: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys, by levels of bits: at each level keys that fall alone set their bit, the others go on."""
    sizes, bits, left, level = [], [], keys.view(np.uint64), 0
    while len(left):
        size = max(64, int(slack * len(left)) // 64 * 64 + 64)
        at = place(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


def slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    """The slot of each key, -1 for some that aren't in the index: constant time a key, for a few levels."""
    ranks = np.cumsum(bits) if ranks is None else ranks
    out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    u = keys.view(np.uint64)
    for level, size in enumerate(sizes.tolist()):
        at = start + place(u[left], level, size)
        hit = bits[at]
        out[left[hit]] = ranks[at[hit]] - 1
        left = left[~hit]
        start += size
    return out


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def index(keys: np.ndarray, nulls: int, offsets: np.ndarray) -> bytes:
    """The index file of a shard: `nulls` documents without a key, then those of these sorted keys, repeats next to each other."""
    first = starts(keys)
    own, count = keys[first], np.diff(np.append(first, len(keys)))
    sizes, bits = perfect_hash(own)
    at = slots(own, sizes, bits)
    table = {"prints": np.zeros(len(own), np.uint32), "first": np.zeros(len(own), np.int64), "count": np.zeros(len(own), np.int64)}
    for name, values in (("prints", prints(own)), ("first", first + nulls), ("count", count)):
        table[name][at] = values
    np.savez(out := io.BytesIO(), keys=keys, nulls=nulls, offsets=offsets, sizes=sizes, bits=np.packbits(bits), n_bits=len(bits), **table)
    return out.getvalue()


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.width = width
        with self.fs.open_input_file(self.path + ".idx") as f:
            data = np.load(io.BytesIO(f.read()))
        self.keys, self.nulls, self.offsets, self.sizes = data["keys"], int(data["nulls"]), data["offsets"], data["sizes"]
        self.bits = np.unpackbits(data["bits"])[: int(data["n_bits"])].astype(bool)
        self.prints, self.first, self.count = data["prints"], data["first"], data["count"]
        self.ranks = np.cumsum(self.bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the stored fingerprint says that it isn't here."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        at = slots(keys, self.sizes, self.bits, self.ranks)
        return np.where((at >= 0) & (self.prints[at] == prints(keys)), at, -1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of the documents from `first` on, `last` left out."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        with self.fs.open_input_file(self.path + ".bin") as f:
            f.seek(a * self.width)
            return np.frombuffer(f.read((b - a) * self.width), f"<u{self.width}").astype("<u4")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of all documents of a key: one, or more if the table repeats it; none if it isn't here."""
        if key is None:
            a, n = 0, self.nulls
        else:
            slot = int(self.slots(np.array([key], np.int64))[0])
            if slot < 0:
                return []
            a, n = int(self.first[slot]), int(self.count[slot])
        return np.split(self.ids(a, a + n), self.offsets[a + 1 : a + n] - self.offsets[a]) if n else []


def bounds(docs: DataFrame, n: int) -> np.ndarray:
    """Ids that cut the table into n ranges of about as many documents, from the ids alone; a common one is there several times."""
    if n < 2:
        return np.zeros(0, np.int64)
    share = [k / n for k in range(1, n)]
    got = docs.agg(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), share, max(10_000, 20 * n)).alias("b")).first()["b"]
    return np.array(got if got is not None else [], np.int64)


def ranges(keys: np.ndarray, null: np.ndarray, th: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The range of each document, in order of (key, th): documents of a common key are dealt to its ranges by their hash."""
    lo, hi = np.searchsorted(edge, keys, "left"), np.searchsorted(edge, keys, "right")
    within = ((th >> np.uint64(32)) * (hi - lo + 1).astype(np.uint64)) >> np.uint64(32)
    return np.where((keys == LEAST) & ~null, hi, lo + within.astype(np.int64)).astype(np.int32)


def encoded(docs: DataFrame, path: str, n: int, end: int) -> DataFrame:
    """part (one of n ranges), doc_id, th (hash of the ids) and ids (packed, with the end id) of each document, encoded where it is read."""
    edge = docs.sparkSession.sparkContext.broadcast(bounds(docs, n))  # n - 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready.setdefault(path, _ready.get(path) or LibraryEncoder(path))
        stop = np.array([end], encoder.kind).tobytes()
        for batch in pieces(batches):
            ids = [x.tobytes() + stop for x in encoder.encode(byte_column(batch, "text"))]
            th = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
            key = batch.column("doc_id")
            null = key.is_null().to_numpy(zero_copy_only=False)
            part = ranges(key.fill_null(LEAST).to_numpy(), null, th, edge.value)
            yield pa.RecordBatch.from_arrays([pa.array(part), key, pa.array((th ^ np.uint64(1 << 63)).view(np.int64)), pa.array(ids, pa.binary())], names=["part", "doc_id", "th", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, doc_id long, th long, ids binary")


def write(docs: DataFrame, path: str, folder: str, end: int = 1) -> DataFrame:
    """Writes the shards below `folder` and returns the manifest table, one row a shard.

    Documents are encoded where they are read; only ids are dealt out, by range of the key, and sorted
    within: null keys first, repeats of a key in order of a hash of their ids, so that reruns agree. A null
    text is as an empty one: it has the end id alone. An empty table gives an empty manifest; other columns are not
    looked at. A shard ends after ROLL bytes, so a task holds one shard at most, or one document of more. Files
    get new names in every attempt, and only the manifest says which count: a task that is run again leaves
    no wrong rows.
    """
    spark = docs.sparkSession
    fs, place_ = pafs.FileSystem.from_uri(folder)
    fs.create_dir(place_, recursive=True)
    n = parts(spark)
    width = LibraryEncoder(path).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, rows = TaskContext.get().partitionId(), [], 0, []

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            table = pa.Table.from_batches(held)
            key = table.column("doc_id").combine_chunks()
            nulls = key.null_count
            keys = key.slice(nulls).to_numpy()
            out, base = pafs.FileSystem.from_uri(folder)
            name = f"{part:06d}-{len(rows):04d}-{uuid.uuid4().hex[:12]}"
            length = []
            with out.open_output_stream(f"{base}/{name}.bin") as f:
                for batch in held:  # a binary column is one run of bytes
                    ids = batch.column("ids")
                    at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
                    f.write(ids.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])))
                    length.append(np.diff(at) // width)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(length))])
            with out.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(index(keys, nulls, offsets))
            least, most = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
            rows.append({"part": part, "seq": len(rows), "path": f"{folder}/{name}", "width": width, "nulls": nulls, "least": least, "most": most, "n_docs": table.num_rows, "n_ids": int(offsets[-1])})
            held, size = [], 0

        for batch in pieces(batches, "ids"):
            held.append(batch)
            size += batch.column("ids").nbytes
            if size >= ROLL:
                flush()
        flush()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string() if c == "path" else pa.int64()) for c in rows[0]]))

    dealt = encoded(docs, path, n, end).repartitionById(n, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th")
    made = dealt.mapInArrow(run, "part long, seq long, path string, width long, nulls long, least long, most long, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in order, with `base`, the ids of all shards before each. One row a shard is ordered here, in one task: some three millions at 100 TB."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def lookup(spark: SparkSession, folder: str, key: int | None) -> list[np.ndarray]:
    """The ids of one key, from the shards whose range holds it."""
    own = F.col("nulls") > 0 if key is None else (F.col("least") <= key) & (F.col("most") >= key)
    rows = manifest(spark, folder).where(own).orderBy("part", "seq").collect()
    return [x for r in rows for x in Shard(r["path"], r["width"]).get(key)]


def read_back(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32. Each is found through the hash index; repeats of a key follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, width, base in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "base")), strict=True):
                shard = Shard(path, width)
                n = len(shard.keys)
                new = starts(shard.keys)
                at = np.repeat(shard.first[shard.slots(shard.keys[new])] - new, np.diff(np.append(new, n))) + np.arange(n)
                at = np.concatenate([np.arange(shard.nulls), at])
                raw = memoryview(shard.ids(0, len(shard.offsets) - 1)).cast("B")
                a, b = shard.offsets[at], shard.offsets[at + 1]
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                key = pa.array(np.concatenate([np.zeros(shard.nulls, np.int64), shard.keys]), mask=np.arange(len(at)) < shard.nulls)
                for k in range(0, len(at), 10_000):
                    some = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays([key[some], pa.array(base + a[some]), pa.array((b - a)[some]), pa.array(crc[some], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.select("path", "width", "base").repartition(parts(shards.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), new_dir(spark, "tokens")))
