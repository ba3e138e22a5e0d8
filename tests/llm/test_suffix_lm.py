"""The suffix tree's scores against a plain tree of dictionaries, in one chunk and in several."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import suffix_lm

SCHEMA = "doc_id long, text string"


def symbols(text):
    return b"".join(w + b" " for w in text.lower().encode().split()) + b"\n"


def plain(texts):
    """log10 P(symbol | what is before it), by dictionaries of contexts of up to 6 bytes."""
    after = defaultdict(Counter)
    for t in texts:
        s = b"\n" * 6 + symbols(t)
        for i in range(6, len(s)):
            for d in range(7):
                after[s[i - d : i]][s[i]] += 1
    states = {b""}

    def p(context, x):
        if not context:
            return (after[b""][x] + 0.5) / (sum(after[b""].values()) + 128)
        if context not in states:
            return p(context[1:], x)
        k = after[context]
        return (k[x] + len(k) * p(context[1:], x)) / (sum(k.values()) + len(k))

    for c in sorted(after, key=len)[1:]:
        k, many = after[c], sum(after[c].values())
        saved = sum(n * math.log((n + len(k) * p(c[1:], x)) / (many + len(k)) / p(c[1:], x)) for x, n in k.items())
        if many >= 2 and saved >= 3 * len(k):
            states.add(c)
    return p, states


def corpus():
    rng = np.random.default_rng(5)
    words = ["w" + "".join(rng.choice(list("abcdé"), 4)) for _ in range(30)]
    texts = [" ".join(words[int(k)] for k in np.cumsum(rng.integers(1, 3, 60)) % 30) for _ in range(40)]
    return [*texts, "", " X \n y ", texts[3], " ".join(reversed(texts[4].split())), "zzzqq", "wabcdd"]


def test_scores_equal_a_plain_tree(spark):
    texts = corpus()
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    p, states = plain([t for i, t in enumerate(texts) if not out[i]])
    assert any(b" " in c[1:-1] for c in states)  # over a word's beginning
    known = {w for i, t in enumerate(texts) if not out[i] for w in t.lower().split()}
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    for chunk_mb in (16, 0.001):
        rows = {r["doc_id"]: r for r in suffix_lm.scores(docs, chunk_mb).collect()}
        for i, t in enumerate(texts):
            s = b"\n" * 6 + symbols(t)
            each = [math.log10(p(s[k - 6 : k], s[k])) for k in range(6, len(s))]
            assert rows[i]["score"] == pytest.approx(sum(each), rel=1e-5)
            at, own = 0, each[-1]
            for w in t.lower().split():
                n = len(w.encode()) + 1
                own += sum(each[at : at + n]) if w in known else 0
                at += n
            assert rows[i]["score_known"] == pytest.approx(own, rel=1e-5)


def test_order_and_spelling_count(spark):
    texts = corpus()
    new = {1000: texts[4], 1001: " ".join(sorted(texts[4].split())), 1002: "wabcd", 1003: "jjjjj"}
    new = {next(i for i in range(k * 100, k * 100 + 99) if zlib.crc32(str(i).encode()) % 7 == 2): t for k, t in new.items()}  # held out
    rows = suffix_lm.scores(spark.createDataFrame([*enumerate(texts), *new.items()], SCHEMA)).collect()
    a, b, c, d = (next(r["score"] for r in rows if r["doc_id"] == i) for i in new)
    assert a > b + 1 and c > d + 1
