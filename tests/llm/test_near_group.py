"""A group of near copies of which only some are linked."""

import numpy as np

from larder.llm import near_dup


def test_group_of_half_linked_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        words = [f"w{k}" for k in range(150)]
        for at in rng.choice(150, rng.integers(3, 12), replace=False):
            words[at] = f"y{at}" if rng.random() < 0.7 else f"x{i}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    name = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((name[a], name[b]))
                name = [x if c == y else c for c in name]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 1 < len(set(name)) < len(rows)
    assert [got[i] for i in range(len(rows))] == name
