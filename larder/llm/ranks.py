"""Row numbers within groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, written

FEW_RUNS = 100_000  # rows of two longs and a group's key that are broadcast at most; beyond, they are joined by shuffle


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "idx", size: str = "n") -> DataFrame:
    """df with the place of each row in its group by `order` (from 0) and the group's number of rows.

    Rows are dealt by ranges of (group, order) and sorted there, so a large group lies in several ranges; what came before a range is a sum over the ranges, of which there are as many as partitions. Group columns must not be null. Rows alike in group and order stand in any order.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    dealt = df.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt, "ranges").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("part", *group).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    every = Window.partitionBy(*group)
    runs = runs.select("part", *group, (F.coalesce(F.sum("rows").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(every).alias(size))
    runs = written(runs, "runs")
    if runs.count() <= FEW_RUNS:
        runs = F.broadcast(runs)
    return dealt.join(runs, ["part", *group]).withColumn(name, F.col("at") + F.col("shift")).drop("at", "part", "shift")
