"""A manifest of a dataset as Merkle trees: a subroot for each source, a root over them, a proof for each row.

Levels are DataFrames, all in built-in functions: places in a source, divided by the fanout, make groups whose sorted hashes give the parents. Proofs are made from the top down: each level's runs of children are joined with the siblings of their parent, so that rows are a third as many at each step up and no leaf is joined once a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .ranks import numbered

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of a row: each field as its bytes, a colon and its value, or a dash if it is null."""
    said = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said])


def levels(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """Level by level, from the leaves (g, idx, n, hash, ...) up to the tops, of which n is 1. most: the largest n."""
    out = [nodes]
    while most > 1:
        rest = [c for c in out[-1].columns if c not in ("g", "idx", "n", "hash", "children")]
        runs = out[-1].where("n > 1").groupBy("g", F.expr(f"idx div {fanout}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash", *rest))).alias("children"), F.first("n").alias("n"))
        runs = runs.select("g", F.col("parent").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(F.array_join("children.hash", "")).alias("hash"), "children")
        out.append(written(runs, f"merkle-{len(out)}"))
        most = -(-most // fanout)
    return out


def with_siblings(built: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves, each with its siblings from its own run up (path). tops: g, and of each top its path, with whatever else its leaves are to carry."""
    carried = [c for c in tops.columns if c not in ("g", "path")]
    paths = None
    for k in range(len(built) - 1, -1, -1):
        rest = [c for c in built[k].columns if c not in ("g", "idx", "n", "hash", "children")]
        found = built[k].where("n = 1").join(tops, "g").select("g", "idx", "hash", *rest, "path", *carried)
        if paths is not None:
            run = built[k + 1].select("g", "idx", "children").join(paths.select("g", "idx", "path", *carried), ["g", "idx"])
            child = run.select("g", "path", *carried, "children", F.posexplode("children").alias("pos", "child"))
            step = F.struct(F.array_join(F.expr("slice(children.hash, 1, pos)"), "").alias("before"), F.array_join(F.expr("slice(children.hash, pos + 2, size(children))"), "").alias("after"))
            found = child.select("g", "child.idx", "child.hash", *[f"child.{c}" for c in rest], F.concat(F.array(step), "path").alias("path"), *carried).unionByName(found)
        paths = found
    return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, step: digest(step["before"], acc, step["after"]))


def proof(path: Column) -> Column:
    """One hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Each row's order column, leaf, subroot, root and path; with `altered` (other values for fields) also the leaf of the altered row, null where nothing changes.

    A null group is one of its own and comes first; rows of a null or repeated order value are rows of their own, those alike in it stand by their leaf, and equal rows have equal leaves. Empty and long texts are values like others. Other columns take no part, whatever their names. An empty table gives no row. A group of one row has its leaf as subroot, a single subroot is the root.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    changed = F.lit(None).cast("string")
    if altered:
        new = {c: altered.get(c, own[c]) for c in fields}
        differs = F.lit(False)
        for c in altered:
            differs = differs | ~new[c].eqNullSafe(own[c])
        changed = F.when(differs, leaf(new))
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit("n"))
    rows = written(docs.select(key.alias("g"), F.col(f"`{order}`").alias("id"), leaf(own).alias("hash"), changed.alias("changed")), "leaves")
    placed = written(numbered(rows, ["g"], ["id", "hash"]), "placed")
    built = levels(placed, placed.agg(F.max("n")).first()[0] or 0, fanout)
    tops = built[0].where("n = 1").select("g", "hash")
    for level in built[1:]:
        tops = tops.unionByName(level.where("n = 1").select("g", "hash"))
    tops = written(tops, "subroots")
    above = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("own"), "hash"), ["g"], ["own"])
    over = levels(written(above, "over"), tops.count(), fanout)
    root = over[-1].select("g", F.col("hash").alias("root"))
    sub = with_siblings(over, root.select("g", F.array().cast(f"array<{STEP}>").alias("path")))
    sub = written(sub.join(root, "g").select(F.col("own").alias("g"), F.col("hash").alias("subroot"), "root", "path"), "subpaths")
    found = with_siblings(built, sub)
    return found.select(F.col("id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path", "changed")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents; every other row, by its id's crc32, loses its newlines and is held against the root."""
    docs = read(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    lost = F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, altered={"text": lost})
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 has no function in SQL: its eight steps for each character of the decimal id.
CRC = "xor(list_reduce(list_transform(string_split({id}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295)"
LEAF = "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"

OP11_SQL = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS g, {LEAF.format(text="text")} AS leaf,
    CASE WHEN {CRC.format(id="doc_id")} % 2 = 0 THEN {LEAF.format(text="replace(text, chr(10), '')")} END AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM base),
lev(k, g, idx, n, hash) AS (
  SELECT 0, g, idx, n, leaf FROM leaves
  UNION ALL
  SELECT any_value(k) + 1, g, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM lev WHERE n > 1 GROUP BY g, idx // 3),
tops AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM lev WHERE n = 1),
over_all(k, idx, n, hash) AS (
  SELECT 0, idx, n, hash FROM tops
  UNION ALL
  SELECT any_value(k) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM over_all WHERE n > 1 GROUP BY idx // 3),
near AS (
  SELECT r, k, coalesce(string_agg(hash, '' ORDER BY l.idx) FILTER (l.idx < d.idx // (3 ** k)::BIGINT), '') AS before, coalesce(string_agg(hash, '' ORDER BY l.idx) FILTER (l.idx > d.idx // (3 ** k)::BIGINT), '') AS after
  FROM leaves AS d JOIN lev AS l ON l.g = d.g AND l.n > 1 AND l.idx // 3 = d.idx // (3 ** (k + 1))::BIGINT GROUP BY r, k
  UNION ALL
  SELECT r, 1000 + k, coalesce(string_agg(o.hash, '' ORDER BY o.idx) FILTER (o.idx < t.idx // (3 ** k)::BIGINT), ''), coalesce(string_agg(o.hash, '' ORDER BY o.idx) FILTER (o.idx > t.idx // (3 ** k)::BIGINT), '')
  FROM leaves AS d JOIN tops AS t ON t.g = d.g JOIN over_all AS o ON o.n > 1 AND o.idx // 3 = t.idx // (3 ** (k + 1))::BIGINT GROUP BY r, k),
steps AS (SELECT r, list({{'before': before, 'after': after}} ORDER BY k) AS path FROM near GROUP BY r)
SELECT doc_id, leaf, t.hash AS subroot, o.hash AS root,
  sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.before || s.after), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(coalesce(path, []), lambda a, s: {{'before': sha256(s.before || a.before || s.after), 'after': ''}}, {{'before': coalesce(changed, leaf), 'after': ''}}).before AS folded_root,
  folded_root = root AS verified
FROM leaves LEFT JOIN steps USING (r) JOIN tops AS t USING (g), (SELECT hash FROM over_all WHERE n = 1) AS o
"""
