"""Components over a whole table against all pairs of sets that share a shingle, with and without the sketch filter."""

from collections import Counter, defaultdict

from larder.llm import common, near_dup

DATA = "/root/testdata/sf0.01"


def test_all_pairs_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = common.lower_words((r["text"] or "").encode())
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    shared = Counter((a, b) for ids in having.values() for n, b in enumerate(ids) for a in ids[:n])
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            least[y] = x
    want = {i: find(i) for i in sets}
    assert sum(i != c for i, c in want.items()) > 20
    for differ in (near_dup.DIFFER, None):
        assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, differ).collect()} == want
