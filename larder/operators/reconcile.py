"""Receipts against lists and prices: what was paid, what was found, which prices to note, what goes to stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.operators.filters import KNOWN, known
from larder.operators.prices import NOW, current_price
from larder.plans.packs import OFFERS, offers, plan
from larder.sources.tables import LINES, lines, table

LEAST, MOST = 1, 100_000  # cents that a price may have


def items(spark: SparkSession, d: str) -> DataFrame:
    """A household's list: the lines of its open orders, with an ingredient (none for some), a section and an estimate."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("list"))
    section = F.when(F.col("pack") % 10 == 0, "check").when(F.col("pack") % 10 == 1, "stock").otherwise("buy")
    return lines(spark, d).join(o, "receipt").select("list", F.concat_ws("-", "receipt", "line", "pack", "store").alias("item"), F.when(F.col("pack") % 9 > 0, F.col("pack") % 60).alias("ingredient"), section.alias("section"), (F.col("paid") - F.col("paid") % 100).alias("estimated"))


def bought(spark: SparkSession, d: str) -> DataFrame:
    """Receipt lines of a household's closed orders; their ingredient is that of the pack, else that of the line."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("list"))
    of_pack = F.when(F.col("pack") % 7 > 0, F.col("pack") % 60)
    of_line = F.when(F.col("store") % 3 > 0, F.col("store") % 60)
    return known(spark, d).join(o, "receipt").select("list", F.concat_ws("-", "receipt", "line", "pack", "store", "day", "qty").alias("id"), F.coalesce(of_pack, of_line).alias("ingredient"), "status", "non_food", "paid")


LISTS = f"""it AS (SELECT o_custkey AS list, concat_ws('-', receipt, line, pack, store) AS item, CASE WHEN pack % 9 > 0 THEN pack % 60 END AS ingredient,
  CASE pack % 10 WHEN 0 THEN 'check' WHEN 1 THEN 'stock' ELSE 'buy' END AS section, paid - paid % 100 AS estimated FROM li JOIN orders ON o_orderkey = receipt WHERE o_orderstatus = 'O'),
bt AS (SELECT o_custkey AS list, concat_ws('-', receipt, line, pack, store, day, qty) AS id, coalesce(CASE WHEN pack % 7 > 0 THEN pack % 60 END, CASE WHEN store % 3 > 0 THEN store % 60 END) AS ingredient, status, non_food, paid
  FROM kn JOIN orders ON o_orderkey = receipt WHERE o_orderstatus = 'F'),
mt AS (SELECT list, ingredient, CAST(sum(paid) AS BIGINT) AS paid, count(*) AS n FROM bt WHERE status IN ('known', 'applied') AND NOT non_food AND ingredient IS NOT NULL GROUP BY 1, 2),
rw AS (SELECT it.*, mt.paid, mt.n IS NOT NULL AS found FROM it LEFT JOIN mt USING (list, ingredient) WHERE section <> 'stock' AND (section <> 'check' OR mt.n IS NOT NULL)),
ex AS (SELECT bt.* FROM bt WHERE status <> 'ignored' AND NOT non_food AND paid > 0
  AND NOT (status IN ('known', 'applied') AND ingredient IS NOT NULL AND EXISTS (SELECT 1 FROM rw WHERE rw.list = bt.list AND rw.ingredient = bt.ingredient)))"""


def by_ingredient(b: DataFrame) -> DataFrame:
    own = b.where("status IN ('known', 'applied') AND NOT non_food AND ingredient IS NOT NULL")
    return own.groupBy("list", "ingredient").agg(F.sum("paid").alias("paid"), F.count(F.lit(1)).alias("n"))


def compared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows of lists with what was paid for them, and the receipt lines that are on no list.

    Stock is left out, so is what was to be checked and wasn't bought. Two rows of one ingredient both count what was
    paid for it, as lists show it; a line is an extra if no row has its ingredient.
    """
    b = bought(spark, d)
    rows = items(spark, d).where("section <> 'stock'").join(by_ingredient(b), ["list", "ingredient"], "left").withColumn("found", F.col("n").isNotNull()).where("section <> 'check' OR found")
    used = rows.where("ingredient IS NOT NULL").select("list", "ingredient").distinct().withColumn("used", F.lit(True))
    extra = b.join(used, ["list", "ingredient"], "left").where("status <> 'ignored' AND NOT non_food AND paid > 0 AND NOT (status IN ('known', 'applied') AND used IS NOT NULL)")
    return rows, extra


def list_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Of each list what was estimated, paid for its rows, paid beside it, found and missing."""
    rows, extra = compared(spark, d)
    buy = F.col("section") == "buy"
    mine = rows.groupBy("list").agg(
        F.sum(F.when(buy, F.col("estimated")).otherwise(0)).alias("estimated"), F.sum(F.when(buy & F.col("found"), F.col("estimated")).otherwise(0)).alias("matched_estimated"),
        F.sum(F.when(buy & F.col("found"), F.col("paid")).otherwise(0)).alias("matched_paid"), F.coalesce(F.sum("paid"), F.lit(0)).alias("row_paid"),
        F.count_if(buy & ~F.col("found") & F.col("ingredient").isNotNull()).alias("missing"), F.count_if("found").alias("matched"),
    )
    beside = extra.groupBy("list").agg(F.sum("paid").alias("extras"), F.count(F.lit(1)).alias("n_extras"))
    out = mine.join(beside, "list", "left").withColumn("extras", F.coalesce("extras", F.lit(0))).withColumn("n_extras", F.coalesce("n_extras", F.lit(0)))
    return out.withColumn("paid", F.col("row_paid") + F.col("extras")).drop("row_paid")


def off_list(spark: SparkSession, d: str) -> DataFrame:
    return compared(spark, d)[1].groupBy("list", F.coalesce("ingredient", F.lit(-1)).alias("ingredient")).agg(F.sum("paid").alias("paid"))


def ticked_items(spark: SparkSession, d: str) -> DataFrame:
    """Rows that receipts tick: not of the stock section, their ingredient bought."""
    return items(spark, d).where("section <> 'stock'").join(by_ingredient(bought(spark, d)), ["list", "ingredient"], "left_semi").groupBy("list").agg(F.count(F.lit(1)).alias("ticked"))


def receipt_prices(spark: SparkSession, d: str) -> DataFrame:
    """The price that a receipt gives a pack: by weight what 1,000 g cost, else by article, for another quantity on the label by that; the last of a day in a store stays."""
    own = known(spark, d).where("status IN ('known', 'applied') AND qty > 0 AND paid > 0")
    held, on_label = (F.col("pack") % 4 + 1) * 250.0, F.when(F.col("pack") % 5 == 0, (F.col("line") % 4 + 1) * 250.0)
    each = F.col("paid") / F.col("qty")
    other = F.abs(on_label - held) > held * 0.02
    cents = F.when(F.col("pack") % 3 == 0, F.round(F.col("paid") / (F.col("qty") * 1000) * held)).when(other, F.round(each / on_label * held)).otherwise(F.round(each)).cast("long")
    own = own.withColumn("cents", cents).where(F.col("cents").between(LEAST, MOST))
    last = F.row_number().over(W.partitionBy("pack", "store", "day").orderBy(F.desc("receipt"), F.desc("line"), F.desc("cents")))
    return own.withColumn("k", last).where("k = 1").select("pack", "store", "day", "cents")


def price_form(spark: SparkSession, d: str) -> DataFrame:
    """Prices typed for each pack and store that are new: other cents, another promotion, or the price so far was an estimate; none above MOST."""
    now = current_price(spark, d)
    typed = now.select("pack", "store", (F.col("cents") + F.when(F.col("pack") % 3 == 0, 0).otherwise(F.col("pack") % 50 - 10)).alias("new"), (F.col("pack") % 20 == 7).alias("new_promo"))
    both = typed.join(now, ["pack", "store"])
    return both.where((F.col("new") <= MOST) & ((F.col("new") != F.col("cents")) | (F.col("new_promo") != F.col("promo")) | (F.col("pack") % 8 == 0))).select("pack", "store", F.col("cents").alias("before"), F.col("new").alias("cents"), F.col("new_promo").alias("promo"))


def list_to_stock(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a purchase and worth keeping: half a piece, else 15 and 2 percent of the need, in the cheapest store of each ingredient."""
    own = offers(spark, d).where("need IS NOT NULL").withColumn("p", plan(*map(F.col, ("need", "unit", "q", "c", "bulk"))))
    one = own.groupBy("ingredient", "unit", "need").agg(F.min(F.struct("p.cents", "store", "p.surplus")).alias("x"))
    keep = F.when(F.col("unit") == "piece", F.col("x.surplus") >= 0.5).otherwise(F.col("x.surplus") >= F.greatest(F.lit(15.0), F.col("need") * 0.02))
    return one.where(keep).select("ingredient", "unit", F.col("x.surplus").alias("qty"), F.col("x.store").alias("store"))


def previous_price(spark: SparkSession, d: str) -> DataFrame:
    """Regular prices of a pack in a store with the one before, the day it held and the days between."""
    order = W.partitionBy("pack", "store").orderBy("day", "receipt", "line", "paid")
    own = known(spark, d).where("status = 'applied'").withColumn("before", F.lag("paid").over(order)).withColumn("since", F.lag("day").over(order))
    return own.where("before IS NOT NULL").select("pack", "store", "day", "paid", "before", F.datediff("day", "since").alias("days"))


QUERIES = {f.__name__: f for f in (list_comparison, off_list, ticked_items, receipt_prices, price_form, list_to_stock, previous_price)}
SQL = {
    "list_comparison": f"""WITH {LINES}, {KNOWN}, {LISTS},
      m AS (SELECT list, CAST(sum(CASE WHEN section = 'buy' THEN estimated ELSE 0 END) AS BIGINT) AS estimated, CAST(sum(CASE WHEN section = 'buy' AND found THEN estimated ELSE 0 END) AS BIGINT) AS matched_estimated,
        CAST(sum(CASE WHEN section = 'buy' AND found THEN paid ELSE 0 END) AS BIGINT) AS matched_paid, coalesce(sum(paid), 0) AS row_paid, count(*) FILTER (section = 'buy' AND NOT found AND ingredient IS NOT NULL) AS missing, count(*) FILTER (found) AS matched FROM rw GROUP BY 1),
      e AS (SELECT list, sum(paid) AS extras, count(*) AS n_extras FROM ex GROUP BY 1)
      SELECT list, estimated, matched_estimated, matched_paid, missing, matched, CAST(coalesce(extras, 0) AS BIGINT) AS extras, coalesce(n_extras, 0) AS n_extras, CAST(row_paid + coalesce(extras, 0) AS BIGINT) AS paid FROM m LEFT JOIN e USING (list)""",
    "off_list": f"WITH {LINES}, {KNOWN}, {LISTS} SELECT list, coalesce(ingredient, -1) AS ingredient, CAST(sum(paid) AS BIGINT) AS paid FROM ex GROUP BY 1, 2",
    "ticked_items": f"WITH {LINES}, {KNOWN}, {LISTS} SELECT list, count(*) AS ticked FROM it WHERE section <> 'stock' AND EXISTS (SELECT 1 FROM mt WHERE mt.list = it.list AND mt.ingredient = it.ingredient) GROUP BY 1",
    "receipt_prices": f"""WITH {KNOWN}, h AS (SELECT *, (pack % 4 + 1) * 250::DOUBLE AS held, CASE WHEN pack % 5 = 0 THEN (line % 4 + 1) * 250::DOUBLE END AS lab, paid / qty::DOUBLE AS each FROM kn WHERE status IN ('known', 'applied') AND qty > 0 AND paid > 0),
      c AS (SELECT *, CAST(CASE WHEN pack % 3 = 0 THEN round(paid / (qty * 1000)::DOUBLE * held) WHEN abs(lab - held) > held * 0.02::DOUBLE THEN round(each / lab * held) ELSE round(each) END AS BIGINT) AS cents FROM h),
      k AS (SELECT *, row_number() OVER (PARTITION BY pack, store, day ORDER BY receipt DESC, line DESC, cents DESC) AS k FROM c WHERE cents BETWEEN {LEAST} AND {MOST}) SELECT pack, store, day, cents FROM k WHERE k = 1""",
    "price_form": f"""WITH {NOW}, t AS (SELECT pack, store, cents AS before, promo AS was, cents + CASE WHEN pack % 3 = 0 THEN 0 ELSE pack % 50 - 10 END AS cents, pack % 20 = 7 AS promo FROM now)
      SELECT pack, store, before, cents, promo FROM t WHERE cents <= {MOST} AND (cents <> before OR promo <> was OR pack % 8 = 0)""",
    "list_to_stock": f"""WITH {OFFERS}, j AS (SELECT plan.*, unit, need, row_number() OVER (PARTITION BY ingredient ORDER BY plan.cents, store) AS k FROM plan JOIN o3 USING (ingredient, store) WHERE need IS NOT NULL)
      SELECT ingredient, unit, surplus AS qty, store FROM j WHERE k = 1 AND CASE WHEN unit = 'piece' THEN surplus >= 0.5 ELSE surplus >= greatest(15, need * 0.02::DOUBLE) END""",
    "previous_price": f"""WITH {KNOWN}, l AS (SELECT *, lag(paid) OVER w AS before, lag(day) OVER w AS since FROM kn WHERE status = 'applied' WINDOW w AS (PARTITION BY pack, store ORDER BY day, receipt, line, paid))
      SELECT pack, store, day, paid, before, CAST(day - since AS INTEGER) AS days FROM l WHERE before IS NOT NULL""",
}
