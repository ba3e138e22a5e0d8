"""Prices: the current one, the best offer, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.sources.tables import PRICES, prices, table


def current(p: DataFrame) -> DataFrame:
    """The latest price of each pack and store, promotions included: one combinable max, no sort of the history."""
    last = F.max_by(F.struct("cents", "day", "promo"), F.struct("day", "receipt", "line", "cents"))
    return p.groupBy("pack", "store").agg(last.alias("x")).select("pack", "store", "x.cents", "x.day", "x.promo")


def best(now: DataFrame) -> DataFrame:
    """The cheapest store of each pack; the first in order of stores wins ties."""
    return now.groupBy("pack").agg(F.min(F.struct("cents", "store")).alias("x"), F.count(F.lit(1)).alias("n_stores")).select("pack", "x.store", "x.cents", "n_stores")


def changes(p: DataFrame) -> DataFrame:
    """Changes of a regular price of a pack in a store, by 10 cents and 10 percent of the one before at least: rises, and either way where the one before was an estimate (of a line 7)."""
    order = W.partitionBy("pack", "store").orderBy("day", "receipt", "line", "cents")
    own = p.where("NOT promo").withColumn("before", F.lag("cents").over(order)).withColumn("guess", F.lag("line").over(order) == 7)
    diff = F.col("cents") - F.col("before")
    large = (F.abs(diff) >= 10) & (F.abs(diff) * 10 >= F.col("before"))
    return own.where(large & ((diff > 0) | F.col("guess"))).select("pack", "store", "day", "before", "cents", diff.alias("diff"), F.round(diff * 100 / F.col("before")).cast("long").alias("percent"), F.when(F.col("guess"), "recalibration").otherwise("rise").alias("kind"))


def current_price(spark: SparkSession, d: str) -> DataFrame:
    return current(prices(spark, d))


def best_offer(spark: SparkSession, d: str) -> DataFrame:
    return best(current_price(spark, d))


def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes(prices(spark, d))


def reference_price(spark: SparkSession, d: str) -> DataFrame:
    """Cents by kilogram, litre or piece of each pack's best offer; packs hold p_size units."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("pack"), F.col("p_size").cast("long").alias("size"))
    factor = F.when(F.col("pack") % 3 == 2, 1).otherwise(1000)
    return best_offer(spark, d).join(part, "pack").select("pack", "store", "cents", F.when(F.col("size") > 0, F.round(F.col("cents") * factor / F.col("size")).cast("long")).alias("per_reference"))


def price_history_top(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """The latest k prices of each pack."""
    rank = F.row_number().over(W.partitionBy("pack").orderBy(F.desc("day"), F.desc("receipt"), F.desc("line"), F.desc("store"), F.desc("cents")))
    return prices(spark, d).withColumn("rank", rank).where(F.col("rank") <= k).select("pack", "rank", "store", "day", "cents")


NOW = PRICES + """, r AS (SELECT *, row_number() OVER (PARTITION BY pack, store ORDER BY day DESC, receipt DESC, line DESC, cents DESC) AS rn FROM p),
now AS (SELECT pack, store, cents, day, promo FROM r WHERE rn = 1)"""
BEST = NOW + """, b AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY cents, store) AS k, count(*) OVER (PARTITION BY pack) AS n_stores FROM now),
best AS (SELECT pack, store, cents, n_stores FROM b WHERE k = 1)"""

QUERIES = {f.__name__: f for f in (current_price, best_offer, price_changes, reference_price, price_history_top)}
SQL = {
    "current_price": f"WITH {NOW} SELECT * FROM now",
    "best_offer": f"WITH {BEST} SELECT * FROM best",
    "price_changes": f"""WITH {PRICES}, l AS (SELECT *, lag(cents) OVER w AS before, lag(line) OVER w = 7 AS guess FROM p WHERE NOT promo WINDOW w AS (PARTITION BY pack, store ORDER BY day, receipt, line, cents))
      SELECT pack, store, day, before, cents, cents - before AS diff, CAST(round((cents - before) * 100 / before::DOUBLE) AS BIGINT) AS percent, CASE WHEN guess THEN 'recalibration' ELSE 'rise' END AS kind
      FROM l WHERE abs(cents - before) >= 10 AND abs(cents - before) * 10 >= before AND (cents > before OR guess)""",
    "reference_price": f"""WITH {BEST} SELECT pack, store, cents, CASE WHEN p_size > 0 THEN CAST(round(cents * CASE WHEN pack % 3 = 2 THEN 1 ELSE 1000 END / p_size::DOUBLE) AS BIGINT) END AS per_reference
      FROM best JOIN part ON p_partkey = pack""",
    "price_history_top": f"""WITH {PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY day DESC, receipt DESC, line DESC, store DESC, cents DESC) AS rank FROM p)
      SELECT pack, CAST(rank AS INTEGER) AS rank, store, day, cents FROM r WHERE rank <= 15""",
}
