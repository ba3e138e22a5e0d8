"""Line dedup with short lines, against all-pairs comparison."""

import numpy as np

from larder.llm import common, line_dedup


def shingle(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_short_lines_go_too(spark):
    texts = ["and ornd.\nAND  ornd.\n\n  \nx", "x\nx y\nand ornd. so\nx y z w", "one two three four five\nx y z w\nx y z w v", "y x", "and ornd.", "a a a a a a\na a a a a\na a a a\na"]
    texts += ["hot line\nline %d here of its own" % i for i in range(300)]
    lines = [(i, k, shingle(common.lower_words(line.encode()))) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    want = {(i, k) for n, (i, k, s) in enumerate(lines) if s and any(4 * len(s & e) >= 3 * len(s | e) for _, _, e in lines[:n])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {(0, 1), (1, 0), (2, 1), (4, 0)} <= want and len(want) > 300
    assert {(r["id"], r["line"]) for r in line_dedup.removed_lines(docs).collect()} == want


def test_a_hot_line_is_sent_once_a_task(spark):
    docs = spark.createDataFrame([(i, "this line is in every document of all") for i in range(3000)], "doc_id long, text string").coalesce(1)
    counted = line_dedup.line_table(line_dedup.keyed(docs)).where("block IS NOT NULL").select("block", "counts")
    rows = line_dedup.prefixes(docs, line_dedup.frequencies(counted))
    assert rows.count() == rows.distinct().count() > 0


def test_rows_that_share_an_id_or_have_none(spark):
    x, y, z = "one two three four five six", "seven eight nine ten eleven twelve", "a line of its own in one row"
    rows = [(1, x), (4, f"{y}\n{x}"), (4, f"first\n{z}"), (None, f"{x}\nshort"), (None, "short"), (7, y), (7, y), (8, None), (9, ""), (10, " \n\t")]
    docs = spark.createDataFrame([(i, t, "s", 1, "o") for i, t in rows], "doc_id long, text string, th string, row long, numbers string").repartition(3)
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert {r["th"] for r in out.collect()} == {"s"}
    # rows without an id come first: their x stays, one of their two "short" goes
    kept = [t for i, t in got if i is None]
    assert sorted(kept) in (sorted([f"{x}\nshort", ""]), sorted([x, "short"]))
    assert [t for i, t in got if i == 1] == [""]
    assert sorted(t for i, t in got if i == 4) == sorted([y, f"first\n{z}"])
    assert [t for i, t in got if i in (7, 8, 9, 10)] == [" \n\t", "", "", None, ""] or sorted(str(t) for i, t in got if i in (7, 8, 9, 10)) == sorted(["", "", "None", "", " \n\t"])


def test_common_tokens(spark, monkeypatch):
    """A token in many sets that are alike, or not, with a stream that holds few rows."""
    monkeypatch.setattr(line_dedup, "HELD", 5)
    rng = np.random.default_rng(4)
    texts = []
    for i in range(120):
        words = [f"t{k}" for k in range(24)]
        for at in rng.choice(24, rng.integers(0, 4), replace=False):
            words[at] = f"x{i}" if rng.random() < 0.5 else f"y{at}"
        texts.append(" ".join(words) + (f"\nown line of text {i} here" if i % 3 else ""))
    lines = [(i, k, shingle(line.split())) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    want = {(i, k) for n, (i, k, s) in enumerate(lines) if any(4 * len(s & e) >= 3 * len(s | e) for _, _, e in lines[:n])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert 20 < len(want) < len(lines) - 20
    assert {(r["id"], r["line"]) for r in line_dedup.removed_lines(docs).collect()} == want
