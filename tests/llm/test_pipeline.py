"""Each stage of the pipeline against a plain version, on the rows that the stage before kept."""

from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larder.llm import common, langid, mixing

DATA = "/root/testdata/sf0.001"


def shingle(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 4 * len(a & b) >= 3 * len(a | b)


@pytest.fixture(scope="module")
def kept(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], DATA), name.replace(" ", "-")))
    for before, after in zip(frames[:-2], frames[1:-1], strict=True):
        assert after.columns == before.columns
    return [f.collect() for f in frames]


def test_languages(spark, kept):
    docs, out = kept[0], kept[1]
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(table)
    assert 0 < model.floor < 1
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(table, model, keep=["doc_id"]).collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, (lang, score) in told.items() if lang != "und" and score >= model.floor)
    lettered = {r["doc_id"] for r in docs if r["text"] is not None and langid.has_letter(r["text"].encode())}
    assert {r["doc_id"] for r in out} <= lettered and len(out) > 0.98 * len(lettered)


def test_lines(kept):
    lines, want = [], {}
    for r in sorted(kept[1], key=lambda r: r["doc_id"]):
        stay = []
        for line in r["text"].split("\n"):
            s = shingle(common.lower_words(line.encode()))
            if not s or not any(alike(s, e) for e in lines):
                stay.append(line)
            if s:
                lines.append(s)
        want[r["doc_id"]] = "\n".join(stay)
    assert {r["doc_id"]: r["text"] for r in kept[2]} == want


def test_near_duplicates(kept):
    own = sorted((r["doc_id"], shingle(common.lower_words(r["text"].encode()))) for r in kept[2])
    least = {i: i for i, _ in own}
    links = [(i, j) for n, (i, a) in enumerate(own) for j, b in own[:n] if a and b and alike(a, b)]
    for _ in own:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert sorted(r["doc_id"] for r in kept[3]) == [i for i, _ in own if least[i] == i]


def test_mix(kept):
    documents = kept[3]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in documents])
    want = {i: taken // size for i, size, _, _, taken in c.execute(mixing.OP7_SQL).fetchall() if size}
    got = Counter(r["doc_id"] for r in kept[4])
    assert {i: got[i] for i in want} == want


def test_encode(kept):
    t = Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    want = sorted((r["doc_id"], t.encode(r["text"], add_special_tokens=False).ids) for r in kept[4])
    assert sorted((r["doc_id"], r["ids"]) for r in kept[5]) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in kept[5])


def odd(spark):
    """Nulls in any column, empty and repeated texts, repeated rows and ids, clashing names."""
    real = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "in", "in", "in") for r in real]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", None, None, "in", None, "in"), (rows[2][0], rows[3][1], None, "s", 1, "in", "in", "in")]
    rows += [(5001, None, "en", "s", None, "in", "in", "in"), (5002, "", None, None, 0, "in", "in", "in"), (5003, "123 !", "en", "s", 5, "in", "in", "in"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score string, row string, _text string").repartition(3)


def test_stages_take_odd_tables(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, DATA), "odd-" + name.replace(" ", "-"))
        got = out.collect()
        assert got and {r["score"] for r in got} <= {"in", None} and {r["row"] for r in got} <= {"in", None}
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        if name == "language ID":
            assert not {5001, 5002, 5003} & {r["doc_id"] for r in got} and all(r["text"] for r in got)
        if name == "MinHash near-dedup":
            first = docs.orderBy("doc_id").where("doc_id IS NOT NULL").first()["doc_id"]
            assert {5001, 5002, 5003} <= {r["doc_id"] for r in got} and sum(r["doc_id"] is None for r in got) == 2
            assert max(Counter((r["doc_id"], r["text"]) for r in got if r["text"] and r["doc_id"] is not None).values()) == 1 and first is not None
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_without_labelled_languages(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "", None), (5, "été", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.languages(spark, docs, DATA).collect()) == [1, 5]
