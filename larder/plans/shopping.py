"""From recipes to a shopping list: cost, needs, stock, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.prices import BEST, best_offer
from larder.operators.stock import ALIVE, stock_available
from larder.plans import packs
from larder.sources.tables import LINES, LOTS, lines, table

WEEK = ("1998-01-05", "1998-01-11")
PACKS = (1, 6, 10)  # pieces of the packs on sale; a pack of n costs n single ones less 3 n percent


def recipe_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of each recipe at best offers, and how many of its ingredients have none; seldom bought ones count as unpriced."""
    offer = best_offer(spark, d).where("n_stores > 1").select("pack", "cents")
    rows = lines(spark, d).join(offer, "pack", "left")
    return rows.groupBy("receipt").agg(F.coalesce(F.sum(F.col("qty") * F.col("cents")), F.lit(0)).alias("cents"), F.count_if(F.col("cents").isNull()).alias("missing"), F.count(F.lit(1)).alias("ingredients"))


def week_entries(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderdate").cast("date").between(*(F.lit(x).cast("date") for x in WEEK)) & (F.col("o_orderstatus") != "P")).select(F.col("o_orderkey").alias("receipt"))


def shopping_needs(spark: SparkSession, d: str) -> DataFrame:
    """What the week's recipes need of each pack, and for how many of them."""
    return lines(spark, d).join(week_entries(spark, d), "receipt").groupBy("pack").agg(F.sum("qty").alias("needed"), F.countDistinct("receipt").alias("uses"))


def net_needs(spark: SparkSession, d: str) -> DataFrame:
    """Needs less stock, with the section of the list each falls in."""
    both = shopping_needs(spark, d).join(stock_available(spark, d).select("pack", F.col("qty").alias("stock")), "pack", "left").withColumn("stock", F.coalesce("stock", F.lit(0)))
    used = F.least("needed", "stock")
    net = F.col("needed") - used
    section = F.when((F.col("stock") > 0) & (net <= 0), "stock").when(F.col("pack") % 10 == 0, "check").otherwise("buy")
    return both.select("pack", "needed", "uses", used.alias("used"), net.alias("net"), section.alias("section"))


def shopping_list(spark: SparkSession, d: str) -> DataFrame:
    """For what must be bought: the cheapest whole packs that cover it, by `packs.plan`: in the need's own row, however large it is."""
    need = net_needs(spark, d).where("section <> 'stock'").join(best_offer(spark, d).select("pack", "store", "cents"), "pack")
    cost = [F.floor(F.col("cents") * n * (100 - (3 * n if n > 1 else 0)) / 100).cast("long") for n in PACKS]
    p = packs.plan(F.col("net").cast("double"), F.lit("piece"), F.array(*[F.lit(float(n)) for n in PACKS]), F.array(*cost), F.lit(None).cast("long"))
    return need.withColumn("p", p).select("pack", "store", "section", "net", F.col("p.cents").alias("cents"), F.col("p.surplus").cast("long").alias("surplus"), F.col("p.x").alias("singles"), F.col("p.y").alias("sixes"), F.col("p.z").alias("tens"))


def budget_prorata(spark: SparkSession, d: str) -> DataFrame:
    """Each household's weekly budget over a clamped period of at most 31 days."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("household"), F.round(F.abs("c_acctbal") * 100).cast("long").alias("weekly"), (F.col("c_custkey") % 40 + 1).alias("asked"))
    days = F.least(F.col("asked"), F.lit(31))
    return c.select("household", "weekly", days.alias("days"), F.round(F.col("weekly") * days / 7).cast("long").alias("budget"))


NEEDS = LOTS + f""", w AS (SELECT o_orderkey AS receipt FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}' AND o_orderstatus <> 'P'),
needs AS (SELECT pack, CAST(sum(qty) AS BIGINT) AS needed, count(DISTINCT receipt) AS uses FROM li JOIN w USING (receipt) GROUP BY pack)"""
NET = NEEDS + f""", st AS (SELECT pack, CAST(sum(qty) AS BIGINT) AS stock FROM lots WHERE {ALIVE} GROUP BY pack),
bo AS (SELECT needs.*, coalesce(stock, 0) AS stock FROM needs LEFT JOIN st USING (pack)),
net AS (SELECT pack, needed, uses, least(needed, stock) AS used, needed - least(needed, stock) AS net,
  CASE WHEN stock > 0 AND needed <= stock THEN 'stock' WHEN pack % 10 = 0 THEN 'check' ELSE 'buy' END AS section FROM bo)"""
QUERIES = {f.__name__: f for f in (recipe_cost, shopping_needs, net_needs, shopping_list, budget_prorata)}
SQL = {
    "recipe_cost": f"""WITH {BEST}, {LINES} SELECT receipt, CAST(coalesce(sum(qty * o.cents), 0) AS BIGINT) AS cents, count(*) FILTER (o.cents IS NULL) AS missing, count(*) AS ingredients
      FROM li LEFT JOIN (SELECT pack, cents FROM best WHERE n_stores > 1) o USING (pack) GROUP BY receipt""",
    "shopping_needs": f"WITH {NEEDS} SELECT * FROM needs",
    "net_needs": f"WITH {NET} SELECT * FROM net",
    "shopping_list": f"""WITH {BEST}, {NET},
      n AS (SELECT net.pack, best.store, section, net, best.cents FROM net JOIN best USING (pack) WHERE section <> 'stock'),
      m AS (SELECT *, greatest(1, ceil(net / 6.0)::BIGINT) AS most6, greatest(1, ceil(net / 10.0)::BIGINT) AS most10, (net + 1) * (greatest(1, ceil(net / 6.0)::BIGINT) + 1) * (greatest(1, ceil(net / 10.0)::BIGINT) + 1) <= {packs.COMBINATIONS} AS few FROM n),
      y AS (SELECT *, unnest(range(0, most6 + 1)) AS y FROM m WHERE few),
      x AS (SELECT * EXCLUDE (z), z, greatest(0, net - 6 * y - 10 * z) AS x FROM (SELECT *, unnest(range(0, most10 + 1)) AS z FROM y)
        UNION ALL SELECT m.*, CASE k WHEN 6 THEN most6 ELSE 0 END, CASE k WHEN 10 THEN most10 ELSE 0 END, CASE k WHEN 1 THEN net ELSE 0 END FROM m, (VALUES (1), (6), (10)) v(k) WHERE NOT few),
      c AS (SELECT *, x * cents + y * CAST(floor(cents * 6 * 82 / 100.0) AS BIGINT) + z * CAST(floor(cents * 10 * 70 / 100.0) AS BIGINT) AS total, x + 6 * y + 10 * z - net AS surplus FROM x),
      pick AS (SELECT *, row_number() OVER (PARTITION BY pack, store, section, net ORDER BY total, surplus, x + y + z, x, y, z) AS rn FROM c)
      SELECT pack, store, section, net, CAST(total AS BIGINT) AS cents, CAST(surplus AS BIGINT) AS surplus, CAST(x AS BIGINT) AS singles, CAST(y AS BIGINT) AS sixes, CAST(z AS BIGINT) AS tens FROM pick WHERE rn = 1""",
    "budget_prorata": """SELECT c_custkey AS household, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS weekly, least(c_custkey % 40 + 1, 31) AS days,
      CAST(round(CAST(round(abs(c_acctbal) * 100) AS BIGINT) * least(c_custkey % 40 + 1, 31) / 7::DOUBLE) AS BIGINT) AS budget FROM customer""",
}
