"""Labels of receipts matched to ingredients, token by token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import fold_sql, tokens
from larder.sources.tables import table

LEAST = 0.66  # share of an ingredient's words that a label must have
PRODUCT = ("widget", "bolt")  # words that name a product: an ingredient without one of a label's is none for it


def best_ingredients(labels: DataFrame, index: DataFrame, product: tuple[str, ...]) -> DataFrame:
    """label, ingredient, matched, score, from labels (label, tokens) and index (ingredient, place, tokens).

    Two words match if they are equal, or one of four letters or more begins the other. Most matched words
    win, then the larger share of the ingredient's, then its number of words, then the first in the index.
    Labels are compared once for each distinct list of words, and words once for each distinct pair, which a
    join on their first four letters finds.
    """
    distinct = labels.select(F.array_distinct("tokens").alias("tokens")).distinct()
    words = distinct.select("tokens", F.explode("tokens").alias("w"))
    own = index.select("ingredient", "place", F.size("tokens").alias("n"), F.explode("tokens").alias("v"))
    left = words.select("w").distinct().withColumn("key", F.substring("w", 1, 4))
    right = own.select("v").distinct().withColumn("key", F.substring("v", 1, 4))
    begins = (F.length("w") >= 4) & F.expr("startswith(v, w)") | (F.length("v") >= 4) & F.expr("startswith(w, v)")
    alike = left.join(right, "key").where((F.col("w") == F.col("v")) | begins).select("w", "v")
    found = words.join(alike, "w").join(own, "v").groupBy("tokens", "ingredient", "place", "n")
    found = found.agg(F.countDistinct("v").cast("long").alias("matched"), F.array_distinct(F.collect_list(F.when(F.col("w").isin(*product), F.col("w")))).alias("named"))
    asked = F.size(F.filter("tokens", lambda w: w.isin(*product)))
    score = F.col("matched") / F.col("n")
    fits = found.where((score >= LEAST) & (F.size("named") == asked))
    order = F.struct("matched", score, "n", -F.col("place"))
    best = fits.groupBy("tokens").agg(F.max_by(F.struct("ingredient", "matched", score.alias("score")), order).alias("x"))
    return labels.withColumn("tokens", F.array_distinct("tokens")).join(best, "tokens").select("label", "x.ingredient", "x.matched", "x.score")


def label_ingredient(spark: SparkSession, d: str) -> DataFrame:
    """The ingredient that each part's type and name stand for; ingredients are the distinct names, in the order of their first part."""
    part = table(spark, d, "part")
    index = part.groupBy("p_name").agg(F.min("p_partkey").alias("place")).select(F.col("p_name").alias("ingredient"), "place", F.array_distinct(tokens(F.col("p_name"))).alias("tokens"))
    labels = part.select(F.col("p_partkey").alias("label"), tokens(F.concat_ws(" ", "p_type", "p_name")).alias("tokens"))
    return best_ingredients(labels, index, PRODUCT)


def tag_list(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each part, split at commas, spaces and slashes, without blanks and repeats, in their order."""
    tags = F.filter(F.split(F.concat_ws(",", F.lower("p_type"), F.lower("p_name"), F.lower("p_type")), "[,/ ]+"), lambda t: t != "")
    return table(spark, d, "part").select(F.col("p_partkey").alias("label"), F.explode(F.array_distinct(tags)).alias("tag"))


STOP = "('', 'de', 'du', 'des', 'la', 'le', 'les', 'the', 'of', 'a')"


def _words(x: str) -> str:
    return f"unnest(string_split(regexp_replace({fold_sql(x)}, '[^a-z0-9]+', ' ', 'g'), ' '))"


CUT = "CASE WHEN length(r) > 3 AND regexp_matches(r, '[sx]$') THEN left(r, length(r) - 1) ELSE r END"
QUERIES = {f.__name__: f for f in (label_ingredient, tag_list)}
SQL = {
    "label_ingredient": f"""WITH l0 AS (SELECT p_partkey AS label, {_words("concat_ws(' ', p_type, p_name)")} AS r FROM part),
      l AS (SELECT DISTINCT label, {CUT} AS w FROM l0 WHERE r NOT IN {STOP}),
      i0 AS (SELECT p_name AS ingredient, min(p_partkey) AS place FROM part GROUP BY 1),
      i1 AS (SELECT *, {_words("ingredient")} AS r FROM i0),
      i AS (SELECT DISTINCT ingredient, place, {CUT} AS v FROM i1 WHERE r NOT IN {STOP}),
      s AS (SELECT ingredient, count(*) AS n FROM i GROUP BY 1),
      m AS (SELECT label, ingredient, place, w, v FROM l JOIN i ON w = v OR (length(w) >= 4 AND starts_with(v, w)) OR (length(v) >= 4 AND starts_with(w, v))),
      g AS (SELECT label, ingredient, place, count(DISTINCT v) AS matched, count(DISTINCT w) FILTER (w IN {PRODUCT}) AS named FROM m GROUP BY ALL),
      a AS (SELECT label, count(*) FILTER (w IN {PRODUCT}) AS asked FROM l GROUP BY 1),
      f AS (SELECT label, ingredient, place, matched, matched / n AS score, n FROM g JOIN s USING (ingredient) JOIN a USING (label) WHERE named = asked AND matched / n >= {LEAST}),
      k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY matched DESC, score DESC, n DESC, place) AS rn FROM f)
      SELECT label, ingredient, matched, score FROM k WHERE rn = 1""",
    "tag_list": """WITH t AS (SELECT p_partkey AS label, unnest(string_split_regex(concat_ws(',', lower(p_type), lower(p_name), lower(p_type)), '[,/ ]+')) AS tag FROM part)
      SELECT DISTINCT label, tag FROM t WHERE tag <> ''""",
}
