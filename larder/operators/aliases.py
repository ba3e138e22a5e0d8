"""Labels of receipts to packs, by what was learned of them: here, then elsewhere, then by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import tokens
from larder.operators.labels import NOISE, label_quantity, label_words, normalised
from larder.operators.matching import LEAST, PRODUCT, best_ingredients
from larder.sources.tables import table

NEAR = 0.02  # share of a pack's quantity by which a label's may differ


def best_elsewhere(aliases: DataFrame) -> DataFrame:
    """label, there: of the aliases of all stores that have a pack and aren't ignored the one with most hits, then the first store's."""
    usable = aliases.where("NOT ignored AND pack IS NOT NULL")
    return usable.groupBy("label").agg(F.max_by("pack", F.struct("hits", -F.col("store"))).alias("there"))


def by_words(labels: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """label, ingredient, likely: what a label's words name, and of its packs (ingredient, pack, quantity) the one nearest to the quantity on the label; none if that quantity fits no pack, and the first pack where the label says none."""
    own = labels.select("label", label_words(F.col("label")).alias("tokens"), label_quantity(F.col("label"))["value"].alias("asked"))
    found = best_ingredients(own.select("label", "tokens"), index, PRODUCT).select("label", "ingredient")
    held = found.join(own.select("label", "asked"), "label").join(packs, "ingredient", "left")
    far = F.abs(F.col("quantity") - F.col("asked"))
    fits = F.col("asked").isNull() | (far <= F.col("quantity") * NEAR)
    return held.groupBy("label", "ingredient").agg(F.min_by(F.when(fits, F.col("pack")), F.when(fits, F.struct(F.coalesce(far, F.lit(0.0)), F.col("pack")))).alias("likely"))


def matched(labels: DataFrame, aliases: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """The rows of labels (store, label, ...) with status, pack and ingredient.

    An alias of the store decides: ignored, or known. Else the alias with most hits elsewhere is suggested, else what the label's words name; else the label is unknown. Labels reach the words' comparison only if no alias has them, each once. aliases: store, label, pack, ignored, hits, one row for a store and label.
    """
    here = aliases.select("store", "label", F.lit(True).alias("learned"), "ignored", F.col("pack").alias("own"))
    out = labels.join(here, ["store", "label"], "left").join(best_elsewhere(aliases), "label", "left")
    left = out.where("learned IS NULL AND there IS NULL").select("label").distinct()
    out = out.join(by_words(left, index, packs), "label", "left")
    status = F.when(F.col("ignored"), "ignored").when(F.col("learned"), "known").when(F.col("there").isNotNull() | F.col("ingredient").isNotNull(), "suggested").otherwise("unknown")
    pack = F.when(F.col("learned"), F.when(~F.col("ignored"), F.col("own"))).otherwise(F.coalesce("there", "likely"))
    return out.select(*labels.columns, status.alias("status"), pack.alias("pack"), F.when(F.col("learned").isNull() & F.col("there").isNull(), F.col("ingredient")).alias("ingredient"))


#: SQL that Spark and DuckDB read alike: an odd size is printed a little wrong, tax 0.08 hides the name.
PRINTED = "upper(concat(p_type, ' ', CASE WHEN CAST(round(l_tax * 100) AS INT) = 8 THEN 'divers' ELSE p_name END, ' ', CAST(p_size * 25 + CASE WHEN p_size % 7 = 0 THEN 10 ELSE 0 END AS STRING), 'G'))"


def receipt_matches(spark: SparkSession, d: str) -> DataFrame:
    """The labels of billed lines, by store, matched by what lines that are still open taught at full price."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.select(F.col("l_suppkey").alias("store"), normalised(F.expr(PRINTED)).alias("label"), F.col("l_partkey").alias("pack"), (F.col("l_returnflag") == "N").alias("skip"), "l_linestatus", "l_discount")
    taught = li.where("l_linestatus = 'O' AND l_discount < 0.015").groupBy("store", "label").agg(F.max("pack").alias("pack"), F.min("skip").alias("ignored"), F.count(F.lit(1)).alias("hits"))
    labels = li.where("l_linestatus = 'F'").groupBy("store", "label").agg(F.count(F.lit(1)).alias("lines"))
    part = table(spark, d, "part")
    index = part.groupBy("p_name").agg(F.min("p_partkey").alias("place")).select(F.col("p_name").alias("ingredient"), "place", F.array_distinct(tokens(F.col("p_name"))).alias("tokens"))
    packs = part.select(F.col("p_name").alias("ingredient"), F.col("p_partkey").alias("pack"), (F.col("p_size") * 25.0).alias("quantity"))
    return matched(labels, taught, index, packs)


_CUT = "list_transform({}, lambda w: CASE WHEN length(w) > {} AND regexp_matches(w, '[sx]$') THEN left(w, length(w) - 1) ELSE w END)"
_ALIKE = "(w = v OR (length(w) >= 4 AND starts_with(v, w)) OR (length(v) >= 4 AND starts_with(w, v)))"
QUERIES = {"receipt_matches": receipt_matches}
SQL = {
    "receipt_matches": f"""WITH li AS (SELECT l_suppkey AS store, {PRINTED} AS label, l_partkey AS pack, l_returnflag = 'N' AS skip, l_linestatus AS s, l_discount AS disc FROM lineitem JOIN part ON l_partkey = p_partkey),
      al AS (SELECT store, label, max(pack) AS pack, bool_and(skip) AS ignored, count(*) AS hits FROM li WHERE s = 'O' AND disc < 0.015::DOUBLE GROUP BY 1, 2), la AS (SELECT store, label, count(*) AS lines FROM li WHERE s = 'F' GROUP BY 1, 2),
      el AS (SELECT label, pack AS there FROM al WHERE NOT ignored QUALIFY row_number() OVER (PARTITION BY label ORDER BY hits DESC, store) = 1),
      un AS (SELECT label, list_distinct({_CUT.format(f"list_filter(string_split(lower(label), ' '), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN {NOISE})", 4)}) AS ws, CAST(regexp_extract(label, '([0-9]+)G$', 1) AS DOUBLE) AS asked FROM (SELECT DISTINCT label FROM la)),
      ing AS (SELECT p_name AS ingredient, min(p_partkey) AS place, list_distinct({_CUT.format("string_split(lower(p_name), ' ')", 3)}) AS vs FROM part GROUP BY 1),
      sc AS (SELECT label, ingredient, asked, len(vs) AS n, place, len(list_filter(vs, lambda v: len(list_filter(ws, lambda w: {_ALIKE})) > 0)) AS hit, len(list_filter(ws, lambda w: w IN {PRODUCT})) AS wanted, len(list_filter(ws, lambda w: w IN {PRODUCT} AND len(list_filter(vs, lambda v: {_ALIKE})) > 0)) AS named FROM un, ing),
      be AS (SELECT label, ingredient, asked FROM sc WHERE hit > 0 AND hit / n >= {LEAST}::DOUBLE AND named = wanted QUALIFY row_number() OVER (PARTITION BY label ORDER BY hit DESC, hit / n DESC, n DESC, place) = 1),
      pk AS (SELECT label, ingredient, arg_min(p_partkey, {{'a': abs(p_size * 25 - asked), 'b': p_partkey}}) FILTER (abs(p_size * 25 - asked) <= p_size * 25 * {NEAR}::DOUBLE) AS likely FROM be JOIN part ON p_name = ingredient GROUP BY 1, 2)
      SELECT la.store, la.label, lines, CASE WHEN al.ignored THEN 'ignored' WHEN al.label IS NOT NULL THEN 'known' WHEN there IS NOT NULL OR ingredient IS NOT NULL THEN 'suggested' ELSE 'unknown' END AS status,
        CASE WHEN al.label IS NOT NULL THEN CASE WHEN NOT al.ignored THEN al.pack END ELSE coalesce(there, likely) END AS pack, CASE WHEN al.label IS NULL AND there IS NULL THEN ingredient END AS ingredient
      FROM la LEFT JOIN al ON al.store = la.store AND al.label = la.label LEFT JOIN el ON el.label = la.label LEFT JOIN pk ON pk.label = la.label""",
}
