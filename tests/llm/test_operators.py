"""Each text operator against a plain version, on small tables with nulls, repeats and odd texts."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from larder.llm import bpe, common, fertility, hnsw, langid, line_dedup, mixing, near_dup, suffix_lm, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, g long"
ODD = [None, "", "   \n\t", "x", "a b c d", "Hello wörld it's 12 <|endoftext|> ok", "ΣΑΣ ΟΔΟΣ", "x" * 3000, "ab" * 200 + "!?" * 90, "日本語テキスト" * 9, "one two three four five\nONE two three four five\nother"]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    texts = [*ODD, *base, *base[:4], *[b.replace(b.split()[7], "zz", 1) for b in base[:6]], *["\n".join([base[i], base[i + 1]]) for i in range(5)]]
    rows = [(None if i == 3 else i if i != 5 else 4, t, None, None if i % 7 == 0 else "s%d" % (i % 4), None, "clash", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.limit(0)


def tokenizer():
    return Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))


def test_bpe(docs):
    t, path = tokenizer(), common.vocabulary("word_bpe_49k.json")
    want = []
    for i, x in local(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, path).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(empty(docs), path).count() == 0
    out = bpe.encode_documents(docs, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "g", "ids", "decoded"]


def test_token_shards(spark, docs, tmp_path):
    t, folder = tokenizer(), f"file://{tmp_path}/t"
    got = token_store.read_back(token_store.write(docs, common.vocabulary("word_bpe_49k.json"), folder)).collect()
    of = {}
    for i, x in local(docs):
        of.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, len(x), crc(x)) for i, xs in of.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert sorted(x.tolist() for x in token_store.lookup(spark, folder, 4)) == sorted(of[4])
    assert token_store.lookup(spark, folder, 10**9) == []
    assert sorted(x.tolist() for x in token_store.lookup(spark, folder, None)) == sorted(of[None])
    odd = spark.createDataFrame([(None, "a b")] * 30 + [(-(2**63), t) for t in ("c", "d e", "f")] + [(k % 3, f"g {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    again = [token_store.read_back(token_store.write(odd, common.vocabulary("word_bpe_49k.json"), f"{folder}-{k}")).orderBy("start").collect() for k in range(2)]
    assert again[0] == again[1] and [r["doc_id"] for r in again[0]] == [None] * 30 + [-(2**63)] * 3 + sorted(k % 3 for k in range(40))
    assert len(token_store.lookup(spark, f"{folder}-0", -(2**63))) == 3
    assert token_store.read_back(token_store.write(empty(docs), common.vocabulary("word_bpe_49k.json"), folder + "e")).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    sizes, bits = token_store.perfect_hash(keys)
    assert sorted(token_store.slots(keys, sizes, bits).tolist()) == list(range(len(keys)))


def shingle(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(docs):
    rows = [(i, shingle(common.lower_words((t or "").encode()))) for i, t in local(docs)]
    comp = [i for i, _ in rows]
    link = [[a for a in range(len(rows)) if rows[a][0] is not None and rows[b][0] is not None and rows[b][1] and 100 * len(rows[a][1] & rows[b][1]) >= 75 * len(rows[a][1] | rows[b][1])] for b in range(len(rows))]
    for _ in rows:
        comp = [min([comp[b], *(comp[a] for a in link[b])]) if comp[b] is not None else None for b in range(len(rows))]
    want = [(i, len(s), c, c is None or c == i) for (i, s), c in zip(rows, comp, strict=True)]
    assert sorted(map(tuple, near_dup.near_duplicates(docs).drop("th").collect()), key=str) == sorted(want, key=str)
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_rows_of_one_id_are_linked_each_by_its_text(spark):
    words = [f"w{k}" for k in range(40)]
    a, b = " ".join(words), " ".join(f"v{k}" for k in range(40))
    rows = [(1, a + " tail"), (2, b + " tail"), (4, a), (4, b), (6, a), (7, "x y"), (7, "x y")]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect())
    assert got == [(1, 1, True), (2, 2, True), (4, 1, False), (4, 2, False), (6, 1, False), (7, 7, True), (7, 7, True)]


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    s = near_dup.superminhash(np.concatenate([x[:800], x[200:]]), np.repeat([0, 1], 800), 2)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15
    assert (near_dup.superminhash(x[:3], np.zeros(3, int), 1) < 128 << 32).all()


def test_line_dedup(docs):
    lines = sorted((i, k, shingle(line.lower().split())) for i, t in local(docs) if i is not None and t and i != 4 for k, line in enumerate(t.encode().split(b"\n")) if line.split())
    own = docs.where("doc_id <> 4")
    want = {(i, k) for n, (i, k, s) in enumerate(lines) if any(4 * len(s & e) >= 3 * len(s | e) for _, _, e in lines[:n])}
    assert want and {(r["id"], r["line"]) for r in line_dedup.removed_lines(own).collect()} == want
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.removed_lines(empty(docs)).count() == 0


def test_mix(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    goal = {r["source"]: r["target"] for r in out}
    total = sum(r["size"] for r in out)
    assert sum(goal.values()) == pytest.approx(1.5 * total)
    for s, t in goal.items():
        own = [r for r in out if r["source"] == s]
        assert t - max(r["size"] for r in own) <= sum(r["taken"] for r in own) <= t + 1e-6
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix(empty(docs)).count() == 0


def test_suffix_tree(docs):
    rows = {r["doc_id"]: r for r in suffix_lm.scores(docs.where("doc_id <> 4")).collect()}
    text = {i: common.lower_words((t or "").encode()) + [None] for i, t in local(docs) if i is not None and i != 4}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in text}
    c = Counter(w for i, ws in text.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in text.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    assert suffix_lm.scores(empty(docs)).count() == 0


def test_fertility(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in fertility.verdicts(docs, common.tokenizer_dir()).collect()}
    for i, t in local(docs):
        w = (t or "").encode().split()
        r = got[(i, len(w))]
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert fertility.base_measures(b"a b c d e f g h i\n#\n#\n\na b c d e f g h", b"a b c d e f g h i # # a b c d e f g h".split(), np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 0, 1, 2, 3, 4, 5, 6, 7])) == (19, 2, 1, 16)
    assert fertility.verdicts(empty(docs), common.tokenizer_dir()).count() == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    e, length, trans = rng.normal(0, 2, 11), np.array([3, 0, 8]), rng.normal(0, 1, (2, 2))
    got, at = toxicity.marginals(e, length, trans, block=4), 0
    for n in length:
        total = np.zeros((n, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(e[at + k] * y[k] + trans[y[k - 1] if k else 0, y[k]] for k in range(n)))
            for k in range(n):
                total[k, y[k]] += w
        assert np.allclose(got[at : at + n], total[:, 1] / total.sum(1))
        at += n


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(empty(docs), toxicity.train(empty(docs), labels)).count() == 0


def test_language_id(spark, docs):
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(real)
    good = langid.predict(real, model).where("lang = lang_pred").count()
    assert good > 0.9 * real.count()
    out = {r["text"]: (r["lang_pred"], r["p"]) for r in langid.predict(docs, model, names=("lang_pred", "p")).collect()}
    assert out[None] == out[""] == out["   \n\t"] == ("und", 0.0) and out["x" * 3000][0] != "und"
    assert langid.train(docs) is None and {r[0] for r in langid.predict(docs, None, ["text"]).select("lang_pred").collect()} == {"und"}


def test_nearest_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [None] * 8, 1), (2400, [1.0], 1)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), shard_rows=500).collect()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10].tolist()
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]]) for m in mine)
        hit += len(set(want) & {m[1] for m in mine})
    assert hit >= 0.9 * 150 and len(got) == 150
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
