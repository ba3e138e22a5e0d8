"""Quality by tokeniser fertility: how public vocabularies cut a text, against bands of its language or script."""

from __future__ import annotations

import base64
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP, byte_column, mix, pieces, read, tokenizer_dir, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\f"
CACHE = 400_000  # words from which a worker forgets those it met once
FAMILIES = 10_000  # languages and scripts whose bands are broadcast, some 200 bytes each; more are joined in a shuffle
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: A text is out of its group's band beyond this many quartile ranges from the quartiles; only where they are equal, beyond LEAST (a share of the median, or plainly).
WIDE = {"chars_per_token": 4.0, "chars_per_byte_token": 4.0, "byte_share": 4.0, "entropy": 1.5}
LEAST = {"chars_per_token": 0.25, "chars_per_byte_token": 0.25, "byte_share": 0.05, "entropy": 0.15}
SCRIPT = regex.compile(r"(\p{Latin})|(\p{Cyrillic})|(\p{Greek})|(\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Hangul})|(\p{Arabic})|(\p{L})")
ODD = re.compile(r" [^\S ]")  # a space and other white space: pieces may begin elsewhere
SCRIPTS = ("Latin", "Cyrillic", "Greek", "East Asian", "Arabic", "other")


class Vocabularies:
    """A piece vocabulary with byte fallback and a byte-level one; both end tokens at white space, so words are cut once and remembered.

    Words have numbers. Of each: its byte-level tokens, its uses, and where its piece ids lie in one array of those of all words.
    """

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        with open(f"{folder}/{RANKS}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for x, i in ranks.items() if x[:1] == b" "]] = True
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.n_bytes = self.uses = self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, until the next call; new ones are cut."""
        if len(self.number) > CACHE:
            self.forget()
        old = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(itertools.islice(self.number, old, None))
        n_bytes, length, ids = [self.n_bytes], [self.length], [self.ids]
        for a in range(0, len(new), 2_000):
            text = b" ".join(new[a : a + 2_000]).decode("utf-8", "replace")
            some = text.split(" ")
            cut = self.pieces.encode(some, num_threads=1)
            length.append(np.fromiter(map(len, cut), np.int64, len(cut)))
            ids.append(np.fromiter(itertools.chain.from_iterable(cut), np.uint32, int(length[-1].sum())))
            n_bytes.append(self.byte_tokens(text, some))
        self.n_bytes, self.length, self.ids = map(np.concatenate, (n_bytes, length, ids))
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.uses = np.bincount(number, minlength=len(self.number)) + np.pad(self.uses, (0, len(new)))
        return number

    def byte_tokens(self, text: str, words: list[str]) -> np.ndarray:
        """The byte-level tokens of each word of a text. Its pieces begin at each space, if no other white space follows one."""
        cut = self.bytes.encode_ordinary
        if ODD.search(text) or ODD.match(" " + text[:1]):
            return np.fromiter((len(cut(" " + w)) for w in words), np.int64, len(words))
        tokens = np.array(cut(" " + text), np.int64)
        return np.diff(np.flatnonzero(self.opens[tokens]), append=len(tokens))

    def piece_ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of words end to end, and how many each has."""
        length, ids = self.length[number], [self.ids[:0]]
        for a in range(0, len(number), 200_000):
            n, some = length[a : a + 200_000], number[a : a + 200_000]
            at = np.repeat(self.begin[some] - (np.cumsum(n) - n), n)
            ids.append(self.ids[at + np.arange(len(at))])
        return np.concatenate(ids), length

    def forget(self) -> None:
        """Keeps the words used twice or more, or none if these are too many. Their uses count anew."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > CACHE // 2:
            keep = keep[:0]
        words = list(self.number)
        self.ids, self.n_bytes = self.piece_ids(keep)[0], self.n_bytes[keep]
        self.length = self.length[keep]
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.uses = np.zeros(len(keep), np.int64)
        self.number = defaultdict(itertools.count(len(keep)).__next__, zip([words[i] for i in keep.tolist()], range(len(keep)), strict=True))


_ready: dict[str, Vocabularies] = {}


def base_measures(text: bytes, words: list[bytes], number: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    word_chars = chars - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    repeat = 0
    if len(words) > WINDOW:
        x = mix(number.astype(np.uint64) + np.uint64(1))
        h = x[: len(x) - WINDOW + 1]
        for k in range(1, WINDOW):
            h = h * STEP + x[k : len(x) - WINDOW + 1 + k]
        s = np.sort(h)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:-1] > 0).sum())
    return word_chars, symbols, dup, repeat


def script(text: str) -> str:
    """The script of most letters; `none` without letters."""
    n = np.zeros(len(SCRIPTS), np.int64)
    for m in SCRIPT.finditer(text):
        n[m.lastindex - 1] += 1
    return SCRIPTS[int(n.argmax())] if n.any() else "none"


def measures(docs: DataFrame, folder: str) -> DataFrame:
    """Per document the base columns and what the vocabularies make of its words; `family` is its language, or the script where that is null."""
    schema = "doc_id long, family string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, chars_per_byte_token double, byte_share double, entropy double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _ready.setdefault(folder, _ready.get(folder) or Vocabularies(folder))
        for batch in pieces(batches, size=1 << 21):
            texts = byte_column(batch, "text")
            split = [t.split() for t in texts]
            number = vocab.numbers([w for s in split for w in s])
            ids, n_pieces = vocab.piece_ids(number)
            ends = np.cumsum([len(s) for s in split])
            of_words = np.concatenate([[0], np.cumsum(n_pieces)])
            of_bytes = np.concatenate([[0], np.cumsum(vocab.n_bytes[number])])
            rows = []
            for lang, text, words, b in zip(batch.column("lang").to_pylist(), texts, split, ends.tolist(), strict=True):
                a = b - len(words)
                base = base_measures(text, words, number[a:b])
                i, j = int(of_words[a]), int(of_words[b])
                if j > i:
                    own = np.sort(ids[i:j])
                    n = np.diff(np.flatnonzero(own[1:] != own[:-1]), prepend=-1, append=j - i - 1) / (j - i)
                    # of what a text of so many tokens can have at most
                    entropy = float(-(n * np.log2(n)).sum() / np.log2(max(2, min(j - i, len(vocab.fallback)))))
                    more = (base[0] / (j - i), base[0] / max(1, int(of_bytes[b] - of_bytes[a])), float(vocab.fallback[own].mean()), entropy)
                else:
                    more = (None,) * 4
                rows.append((lang if lang is not None else script(text.decode("utf-8", "replace")), len(words), *base, *more))
            kinds = [pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=names)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def verdicts(docs: DataFrame, folder: str) -> DataFrame:
    """measures with base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not that, and all
    four measures within the bands of the family, which come from the quartiles over all its documents that
    pass the base rules; the share of fallback bytes has an upper bound alone, entropy a lower one alone.
    Null and empty texts have no words and fail. Rows that repeat an id are rows of their own; an empty table
    gives no rows. Null languages fall back to the script of the text.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(measures(docs, folder).withColumn("base_failed", failed), "fertility")
    q = {c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{c}") for c in LEAST}
    bands = rows.where("NOT base_failed").groupBy("family").agg(*q.values())
    inside = F.lit(True)
    for c, least in LEAST.items():
        lo, mid, hi = (F.col(f"q_{c}")[i] for i in range(3))
        room = F.when(hi > lo, WIDE[c] * (hi - lo)).otherwise(F.lit(least) * (mid if c.startswith("chars") else 1))
        if c != "byte_share":
            inside &= F.col(c) >= lo - room
        if c != "entropy":
            inside &= F.col(c) <= hi + room
    bands = written(bands, "bands")
    few = bands.count() <= FAMILIES
    out = rows.join(F.broadcast(bands) if few else bands, "family", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return out.select(*rows.columns, "kept")


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(read(spark, sf_dir, "documents"), tokenizer_dir())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "chars_per_byte_token", "byte_share", "entropy")
