"""Incremental loads: new files of changed rows, and the newest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions the largest row, so that reruns agree."""
    rest = [c for c in rows.columns if c not in (key, version)]
    last = F.max(F.struct(version, *rest)).alias("x")
    return rows.groupBy(key).agg(last).select(*[F.col(c) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns])


def load_changes(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, once: bool = True) -> StreamingQuery:
    """Appends files of `source` that were not loaded before to `target`, as Parquet.

    The checkpoint says which files are done, so a run after a failure neither loses nor repeats one. With
    `once`, it ends when all that is there is loaded (a scheduler starts the next run); else it goes on.
    """
    stream = spark.readStream.schema(schema).parquet(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.trigger(processingTime="1 minute").start()


def revisions(spark: SparkSession, source: str, schema: str, key: str, version: str) -> DataFrame:
    """A stream of the highest version seen of each key: what a client that polls for changes compares."""
    return spark.readStream.schema(schema).parquet(source).groupBy(key).agg(F.max(version).alias(version))
