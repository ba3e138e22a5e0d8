"""Windows of test items in documents, against a plain search of word lists."""

import re

import numpy as np
import pytest

from larder.llm import decontaminate

SCHEMA = "doc_id long, text string, match string, Match_ int"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found, longest = words(text), set(), set(), 0
        for item, t in items:
            v = words(t)
            n = min(len(v), window)
            for p in range(len(v) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit.update(range(q, q + n))
                        found.add(item or "")
                        k = n
                        while q + k < len(w) and p + k < len(v) and w[q + k] == v[p + k]:
                            k += 1
                        longest = max(longest, k)
        spans = [(a, next(b for b in range(a, len(w) + 1) if b not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((doc_id, len(w), spans, sorted(found), longest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(5)
    some = [f"w{i}" for i in range(60)]
    passage = [" ".join(rng.choice(some, n)) for n in (10, 11, 25, 60)]
    items = [("7", passage[0]), ("7", passage[1]), ("10", passage[2]), ("9", passage[2][: len(passage[2]) // 2]), ("2", passage[3]), ("3", None), (None, "ünïque one, two"), ("4", ""), ("5", "Solo"), ("6", "!?"), ("11", passage[3]), ("12", "twin word " * 9)]
    noise = [" ".join(rng.choice(some, 30)) for _ in range(30)]
    texts = [None, "", "?!", "solo", "a SOLO, b", *noise, *passage, *[f"{n}. {p.upper()}! {n}" for n, p in zip(noise, passage * 4, strict=False)], "twin word " * 40, "Ünïque one two", "ünïque one two", *[p[:-4] for p in passage], " ".join(passage), "w1 " * 300 + passage[2] + " w1" * 300, " ".join(passage[2].split()[:15] + passage[3].split()[:12] + passage[2].split()[15:])]
    docs = [(None if i == 9 else 8 if i == 7 else i, t) for i, t in enumerate(texts)]
    return docs, items


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], SCHEMA).repartition(2)
    m = decontaminate.matches(d, spark.createDataFrame(items, "item_id string, text string"), **how)
    assert m.columns[:-1] == d.columns
    rows = [(r[0], r[-1]) for r in m.collect()]
    return sorted([(i, m.n_words, [tuple(s) for s in m.spans], m.items, m.longest) for i, m in rows], key=str)


def test_matches(spark, tables):
    docs, items = tables
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, size=300, block=30) == want  # many shards, many blocks of items
    long = [x for x in items if x[1] and len(words(x[1])) > 9]
    assert found(spark, docs, long) == plain(docs, long)
    assert found(spark, docs, items, window=4) == plain(docs, items, 4)


def test_empty(spark, tables):
    docs, items = tables
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, docs, [("1", None), ("2", "")]) == plain(docs, [])


def test_removed(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], SCHEMA)
    left = decontaminate.decontaminated(d, spark.createDataFrame(items, "item_id string, text string"))
    assert left.columns == d.columns
    assert sorted((r[0] or -1 for r in left.collect())) == sorted(i or -1 for i, _, spans, _, _ in plain(docs, items) if not spans)


def test_long_text(spark):
    """A text of megabytes, in which an item stands at the very end."""
    item = " ".join(f"k{i}" for i in range(12))
    docs = [(1, "lorem ipsum " * 300_000 + item), (2, "k1 k2 " * 200_000)]
    assert found(spark, docs, [("a", item)]) == [(1, 600_012, [(600_000, 600_012)], ["a"], 12), (2, 400_000, [], [], 0)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        x = rng.integers(0, 3, n)
        assert decontaminate.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
