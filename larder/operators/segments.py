"""Words that a reader of images ran together, cut again by a lexicon into the fewest words.

Each distinct word is cut once. Its pieces meet the lexicon in a join, so the lexicon is data of any size; what is found is a few edges a word, over which the best cut of each beginning is a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.tables import table

LEAST, LONGEST, MOST = 8, 12, 5  # letters of a word that is cut, letters of a piece, pieces
CUT = "struct<n:int,said:string>"


def _best(edges: Column, size: Column) -> Column:
    """The cut of the whole word with the fewest pieces, by edges (stop, start, piece) in order; of equal ones that whose last piece begins first."""
    none = F.lit(None).cast(CUT)
    empty = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, F.struct(F.lit(0).alias("n"), F.lit("").alias("said"))).otherwise(none))

    def step(acc: Column, e: Column) -> Column:
        before, now = F.get(acc, e["start"]), F.get(acc, e["stop"])
        new = F.struct((before["n"] + 1).alias("n"), F.ltrim(F.concat(before["said"], F.lit(" "), e["piece"])).alias("said"))
        better = before.isNotNull() & (now.isNull() | (before["n"] + 1 < now["n"]))
        return F.transform(acc, lambda v, i: F.when((i == e["stop"]) & better, new).otherwise(v))

    return F.get(F.aggregate(edges, empty, step), size)


def cuts(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, said: each distinct word of LEAST letters or more that isn't in the lexicon (piece) and is wholly covered by two to MOST of its pieces; lower case on both sides."""
    lexicon = lexicon.select("piece").where((F.col("piece") != "") & (F.length("piece") <= LONGEST)).distinct()
    words = words.select("word").where(F.length("word") >= LEAST).distinct().join(lexicon, F.col("word") == F.col("piece"), "left_anti")
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    at = at.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word") - F.col("start")))).alias("n"))
    at = at.select("word", "start", (F.col("start") + F.col("n")).alias("stop"), F.substring(F.col("word"), F.col("start") + 1, F.col("n")).alias("piece"))
    found = at.join(lexicon, "piece").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("stop", "start", "piece"))).alias("edges"))
    return found.withColumn("best", _best(F.col("edges"), F.length("word"))).where(F.col("best.n").between(2, MOST)).select("word", F.col("best.said").alias("said"))


def unglued(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key and text with its words cut. A word's first capital stays; what isn't letters stays as it is. A null text is null."""
    parts = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}+|[^\p{L}]+"), 0)).alias("pos", "x"))
    parts = parts.withColumn("word", F.lower("x"))
    found = cuts(parts.where(F.col("x").rlike(r"^\p{L}")), lexicon)
    parts = parts.join(found, "word", "left")
    capital = F.col("x").rlike(r"^\p{Lu}")
    said = F.when(F.col("said").isNull(), F.col("x")).when(capital, F.concat(F.upper(F.left("said", F.lit(1))), F.substring("said", 2, 1_000_000))).otherwise(F.col("said"))
    again = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("x")))).alias("x"))
    return texts.join(again, key, "left").select(key, F.when(F.col(text).isNotNull(), F.coalesce(F.array_join("x.x", ""), F.lit(""))).alias(text))


def part_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The words that parts' names and kinds are made of."""
    part = table(spark, d, "part")
    return part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("piece")).distinct()


def glued_orders(spark: SparkSession, d: str) -> DataFrame:
    """The names of each order's lines, run together: some with their kind, some with a letter that is in no word."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    x = F.when(F.col("l_returnflag") == "A", F.concat(F.initcap(name), F.lower("p_type"))).when(F.col("l_returnflag") == "R", F.concat(name, F.lit("q"))).otherwise(name)
    li = li.select(F.col("l_orderkey").alias("recipe"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), x.alias("x"))
    return li.groupBy("recipe").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "x")))["x"], ", ").alias("text"))


def unglued_orders(spark: SparkSession, d: str) -> DataFrame:
    return unglued(glued_orders(spark, d), "recipe", "text", part_lexicon(spark, d))


QUERIES = {"unglued_orders": unglued_orders}
SQL = {
    "unglued_orders": f"""WITH RECURSIVE lex AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS piece FROM part),
      li AS (SELECT l_orderkey AS recipe, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS e, replace(p_name, ' ', '') AS g, lower(p_type) AS k, l_returnflag AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
      x AS (SELECT recipe, a, b, c, e, CASE f WHEN 'A' THEN upper(g[1]) || g[2:] || k WHEN 'R' THEN g || 'q' ELSE g END AS x FROM li),
      w AS (SELECT DISTINCT lower(x) AS word FROM x WHERE length(x) >= {LEAST} AND lower(x) NOT IN (SELECT piece FROM lex)),
      cut(word, stop, n, starts, said) AS (SELECT word, 0, 0, [0][2:], '' FROM w
        UNION ALL SELECT word, stop + length(piece), n + 1, list_prepend(stop, starts), trim(said || ' ' || piece) FROM cut JOIN lex ON length(piece) BETWEEN 1 AND {LONGEST} AND starts_with(word[stop + 1 :], piece)),
      best AS (SELECT word, n, said FROM cut WHERE stop = length(word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY n, starts) = 1),
      y AS (SELECT recipe, a, b, c, e, CASE WHEN n BETWEEN 2 AND {MOST} THEN CASE WHEN regexp_matches(x, '^\\p{{Lu}}') THEN upper(said[1]) || said[2:] ELSE said END ELSE x END AS x FROM x LEFT JOIN best ON word = lower(x))
      SELECT recipe, string_agg(x, ', ' ORDER BY a, b, c, e) AS text FROM y GROUP BY 1""",
}
