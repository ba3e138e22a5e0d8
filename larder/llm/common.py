"""What the text operators share: words, hashes, tables written to the shared folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is set, one in the warehouse, or a temporary one if Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        local = spark.sparkContext.master.split("[")[0] == "local"
        where = "file://" + tempfile.mkdtemp(prefix="larder-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/larder-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, taken: list[str]) -> str:
    """A column name that is none of those taken, whatever their case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at space and \\x09-\\x0D (bytes.split() does just that)."""
    return text.lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), for arrays of uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
STRIDE = 1 << 19  # bytes whose words are hashed at once


def _letters() -> np.ndarray:
    """A number for each byte: A-Z as a-z, white space nothing."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
    t[65:91] = t[97:123]
    t[SPACE] = 0
    return t


LETTERS = _letters()


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, modulo 2**64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = STEP, pow(int(STEP), -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(raw: np.ndarray, letters: np.ndarray = LETTERS, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of some bytes, A-Z lower-cased, where it begins and its bytes: a polynomial's prefix sums, taken for all words at once. Words lie between the bytes of `gaps`, whose `letters` are 0."""
    hashed, begins, widths = [], [], []
    a = 0
    while a < len(raw):
        b = min(len(raw), a + STRIDE)
        while b < len(raw):  # to the end of a word, however long it is
            gap = np.flatnonzero(gaps[raw[b : b + STRIDE]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(len(raw), b + STRIDE)
        part = raw[a:b]
        up, down = _powers(max(2 * STRIDE, len(part) + 1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * up[: len(part)], out=total[1:])
        edge = np.flatnonzero(np.diff(gaps[part], prepend=True, append=True))
        x, y = edge[::2], edge[1::2]
        hashed.append(mix((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64)))
        begins.append(x + a)
        widths.append(y - x)
        a = b
    if not hashed:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashed), np.concatenate(begins), np.concatenate(widths)


def group_shingles(h: np.ndarray, length: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the groups of words that lie end to end, `length` words each, and the group of each: runs of `size` words, or the whole of a shorter group."""
    group = np.repeat(np.arange(len(length)), length)
    s, own = shingle_row(h, size), group[: max(0, len(h) - size + 1)]
    s = s[: len(own)]
    inside = own == group[size - 1 :]
    s, own = s[inside], own[inside]
    start = np.cumsum(length) - length
    for n in range(1, size):
        short = np.flatnonzero(length == n)
        if len(short):
            acc = np.full(len(short), n, np.uint64)
            for k in range(n):
                acc = mix(acc * STEP + h[start[short] + k])
            s, own = np.concatenate([s, acc]), np.concatenate([own, short])
    return s, own


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts end to end, how many each text has, and the bytes of each word."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    h, at, width = word_hashes(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(at, ends), prepend=0), width


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts end to end, each sorted and distinct, and their sizes; none without words."""
    h, length, _ = text_words(texts)
    s, own = group_shingles(h, length, size)
    if (own[1:] < own[:-1]).any():
        order = np.argsort(own, kind="stable")
        s, own = s[order], own[order]
    edge = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[new], np.bincount(own[new], minlength=len(texts))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence where it is shorter; none without words."""
    return shingle_sets([text], size)[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows with about `size` bytes of text: a row of more is alone."""
    for whole in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < whole.num_rows:
            b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + size, "right")))
            yield whole.slice(a, b - a)
            a = b


def shingle_row(h: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of each run of `size` words, or of all of them if they are fewer."""
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    acc = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return acc


def training(column: str, folds: int, out: int = 2) -> Column:
    """Rows whose crc32 of the id as text leaves another remainder than `out`."""
    return ~held_out(column, folds, out)


def held_out(column: str, folds: int, out: int = 2) -> Column:
    """A null id has no crc: such rows are held out of learning by no fold and count as not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == out, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_dir() -> str:
    return os.path.dirname(vocabulary("x"))
