"""The household's relations over the tables at hand, and the same as SQL.

A part is an ingredient pack, a supplier a store, a line item a price seen in a store or a line of a
receipt, an order a recipe or a receipt, a customer a household member, an event a planned meal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """df computed once for all that read it: in the checkpoint folder if the session has one, else by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack, store, day, cents, promo, and the line that orders prices of one day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pack"),
        F.col("l_suppkey").alias("store"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("cents"),
        (F.col("l_discount") >= 0.08).alias("promo"),
        F.col("l_orderkey").alias("receipt"),
        F.col("l_linenumber").alias("line"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt, line, pack, store, qty (whole), paid (cents)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("receipt"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pack"), F.col("l_suppkey").alias("store"),
        F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("paid"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("flag"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock lots: pack, qty, expires (null for some), receipt and line as id."""
    return lines(spark, sf_dir).where("flag = 'R'").select("pack", "qty", F.when(F.col("line") != 7, F.col("day")).alias("expires"), "receipt", "line", "store")


PRICES = """p AS (SELECT l_partkey AS pack, l_suppkey AS store, CAST(l_shipdate AS DATE) AS day,
  CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS cents, l_discount >= 0.08 AS promo, l_orderkey AS receipt, l_linenumber AS line FROM lineitem)"""
LINES = """li AS (SELECT l_orderkey AS receipt, l_linenumber AS line, l_partkey AS pack, l_suppkey AS store, CAST(l_quantity AS BIGINT) AS qty,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS paid, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag FROM lineitem)"""
LOTS = LINES + """, lots AS (SELECT pack, qty, CASE WHEN line <> 7 THEN day END AS expires, receipt, line, store FROM li WHERE flag = 'R')"""
