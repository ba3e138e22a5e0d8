"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read, written

DIGITS = 3  # hex digits of a bucket: 4,096 buckets a level
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """Per document: id, source, size in words, and the hash that decides; a null text has size 0."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), *more)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source: source_size, target, whole passes and the budget left for a partial pass.

    Weights repeat over the sources in code point order, null last. All targets together are `share` of
    all words, and none is above `most` times its source: in order of the share at which a source is full,
    the first that is not full fixes the share of all that follow. One row a source is sorted here.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy())
    level = (share * whole - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    own = own.withColumn("target", F.least(F.coalesce(first * F.col("weight"), F.lit(float("inf"))), (most * F.col("source_size")).cast("double")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return own.select("source", "source_size", "target", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("budget"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with `bound`: the smallest hash that the source's partial pass leaves out; null if it takes all.

    Words are summed by source and hash bucket; the bucket in which the budget runs out is opened by the
    next digits, again and again, until it holds one hash. Only sums by bucket are ordered, at most 4,096
    of a source; documents are never sorted. Rows of one hash (repeated ids) go in or stay out together.
    """
    state = written(goals.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("string").alias("bound"), F.lit(False).alias("done")), "mix")
    for depth in range(0, 32, DIGITS):
        if not state.where("not done").take(1):
            break
        open_ = state.where("not done").alias("s")
        inside = sized.alias("d").join(open_, F.col("d.source").eqNullSafe(F.col("s.source")) & F.startswith(F.col("d.h"), F.col("s.prefix")))
        bucket = inside.groupBy(F.col("s.source").alias("source"), F.substring("d.h", depth + 1, DIGITS).alias("b")).agg(F.sum("d.size").alias("words"), F.min("d.h").alias("lo"), F.max("d.h").alias("hi"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        bucket = bucket.withColumn("upto", upto).alias("b").join(open_, F.col("b.source").eqNullSafe(F.col("s.source")))
        over = bucket.where(F.col("base") + F.col("upto") > F.col("budget")).groupBy(F.col("s.source").alias("source")).agg(F.min_by(F.struct("b", "lo", "hi", (F.col("base") + F.col("upto") - F.col("words")).alias("base")), "b").alias("x")).alias("o")
        found = state.alias("s").join(over, F.col("s.source").eqNullSafe(F.col("o.source")), "left")
        keep, one = F.col("s.done"), F.col("x.lo") == F.col("x.hi")
        state = written(
            found.select(
                "s.source", "budget",
                F.when(keep | F.col("x").isNull(), F.col("prefix")).otherwise(F.concat("prefix", "x.b")).alias("prefix"),
                F.when(keep | F.col("x").isNull(), F.col("s.base")).otherwise(F.col("x.base")).alias("base"),
                F.when(keep, F.col("bound")).when(one, F.col("x.lo")).alias("bound"),
                (keep | F.col("x").isNull() | F.coalesce(one, F.lit(False))).alias("done"),
            ), "mix",
        )
    return goals.alias("g").join(state.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.*", "s.bound")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, keep: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted) and copies; with `keep` also `row`, a struct of all its columns.

    Null text or id: size 0, or the hash of the empty string. Null sources are one source, the last. Rows
    that repeat an id share a hash, so they are taken alike. Reruns agree: only ids decide. An empty table
    gives no rows. Other columns are not looked at.
    """
    sized = written(sizes(docs), "sizes")
    goals = written(targets(sized, weights, share, most), "targets")
    bound = thresholds(sized, goals)
    copies = F.col("passes") + F.when(F.col("budget") <= 0, 0).when(F.col("bound").isNull(), 1).otherwise((F.col("d.h") < F.col("bound")).cast("long"))
    if keep:
        sized = sizes(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = sized.alias("d").join(bound.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    return joined.select("d.doc_id", "d.source", "d.size", "g.source_size", "g.target", (F.col("d.size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), *(["d.row"] if keep else []))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, source_size::DOUBLE / weight AS k,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
f AS (SELECT level FROM l WHERE level * weight <= 2 * source_size ORDER BY k, level LIMIT 1),
t AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM f) * weight, 'infinity'::DOUBLE), (2 * source_size)::DOUBLE) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.*, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN budget > 0 AND upto <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
