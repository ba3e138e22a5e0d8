"""Stock lots: what is there, what expires, what a need takes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.sources.tables import LOTS, lots

TODAY = "1998-06-01"


def unexpired(day: str) -> Column:
    return F.col("expires").isNull() | (F.col("expires") >= F.lit(day).cast("date"))


def stock_available(spark: SparkSession, d: str) -> DataFrame:
    return lots(spark, d).where(unexpired(TODAY)).groupBy("pack").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("lots"))


def stock_fefo(spark: SparkSession, d: str) -> DataFrame:
    """What a need of 40 takes of each lot: first what expires first, undated lots last."""
    order = W.partitionBy("pack").orderBy(F.coalesce("expires", F.lit("9999-12-31").cast("date")), "receipt", "line", "store", "qty")
    before = F.coalesce(F.sum("qty").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("qty"), 40 - before)).cast("long")
    out = lots(spark, d).where(unexpired(TODAY)).withColumn("taken", taken).where("taken > 0")
    return out.select("pack", "receipt", "line", "expires", "qty", "taken", (F.col("qty") - F.col("taken")).alias("left"))


def stock_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lots of one pack, place and date (or none) are one."""
    return lots(spark, d).groupBy("pack", (F.col("store") % 3).alias("place"), "expires").agg(F.sum("qty").alias("qty"))


def expiring_soon(spark: SparkSession, d: str) -> DataFrame:
    left = F.datediff("expires", F.lit(TODAY).cast("date"))
    return lots(spark, d).where(F.col("expires").isNotNull() & (left <= 3)).select("pack", "receipt", "line", "expires", left.alias("days_left"), (left < 0).alias("expired"))


ALIVE = f"(expires IS NULL OR expires >= DATE '{TODAY}')"
QUERIES = {f.__name__: f for f in (stock_available, stock_fefo, stock_merge, expiring_soon)}
SQL = {
    "stock_available": f"WITH {LOTS} SELECT pack, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS lots FROM lots WHERE {ALIVE} GROUP BY pack",
    "stock_fefo": f"""WITH {LOTS}, b AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY pack ORDER BY coalesce(expires, DATE '9999-12-31'), receipt, line, store, qty ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lots WHERE {ALIVE}),
      t AS (SELECT *, CAST(greatest(0, least(qty, 40 - before)) AS BIGINT) AS taken FROM b)
      SELECT pack, receipt, line, expires, qty, taken, qty - taken AS "left" FROM t WHERE taken > 0""",
    "stock_merge": f"WITH {LOTS} SELECT pack, store % 3 AS place, expires, CAST(sum(qty) AS BIGINT) AS qty FROM lots GROUP BY ALL",
    "expiring_soon": f"WITH {LOTS} SELECT pack, receipt, line, expires, CAST(expires - DATE '{TODAY}' AS INTEGER) AS days_left, expires < DATE '{TODAY}' AS expired FROM lots WHERE expires - DATE '{TODAY}' <= 3",
}
