"""The manifest against a plain one, built list by list."""

import hashlib
import zlib

from pyspark.sql import functions as F

from larder.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, hash string, G int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])


def tree(hashes):
    """The top, and for each hash its siblings level by level as (before, after)."""
    paths, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level, at = [h(*level[k : k + 3]) for k in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    built = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    if not names:
        return []
    root, over = tree([built[g][0] for g in names])
    out = []
    for g, above in zip(names, over, strict=True):
        for r, path in zip(groups[g], built[g][1], strict=True):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            again = leaf(r | {"text": r["text"].replace("\n", "") if even and r["text"] else r["text"]})
            for before, after in path + above:
                again = h(before, again, after)
            out.append((r["doc_id"], leaf(r), built[g][0], root, h(*[x for step in path + above for x in step]), again, again == root))
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    docs = spark.createDataFrame([tuple(r.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars", "idx", "hash", "G")) for r in rows], SCHEMA)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_manifest(spark, tmp_path):
    def row(doc_id, text, source, **more):
        return {"doc_id": doc_id, "text": text, "lang": None, "source": source, "n_chars": None if text is None else len(text)} | more

    rows = [row(i, f"été {i}\nline", "hot", lang="fr") for i in range(40)]
    rows += [row(100, "a\n" * 200_000, None), row(101, None, None), row(None, "no id\n", None), row(102, "", "")]
    rows += [row(200, "same\ntext", "twice"), row(200, "same\ntext", "twice"), row(200, "other\n", "twice"), row(-5, "below\nnought", "twice", hash="x", idx=3)]
    rows += [row(300, "alone\n", "Zé"), row(301, "alone\n", "n"), row(302, "\n", "sn")]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_small(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    one = [{"doc_id": 7, "text": "one", "lang": "en", "source": "s", "n_chars": 3}]
    assert found(spark, one, tmp_path) == plain(one)
    assert found(spark, one, tmp_path)[0][4] == h()


def test_other_fields(spark):
    """Any columns, order and fanout; without altered values nothing is changed."""
    rows = merkle.manifest(spark.range(10).withColumn("k", F.lit("a")), fields=("id",), group="k", order="id", fanout=10).collect()
    assert len({r.root for r in rows}) == 1 and rows[0].root == h(*[h(f"1:{i}") for i in range(10)])
    assert all(r.changed is None and len(r.path) == 1 for r in rows)
