"""A table kept by a stream: each batch adds a folder of its newest rows, a read merges them, a compaction folds them into a base.

A batch writes what it changes and nothing else, so its cost doesn't grow with the table. Its folder bears its id and is overwritten as a whole: a batch that was killed and comes again leaves what one run would have. Folders without their `_SUCCESS` aren't read.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from larder.streaming.changes import newest

#: Folders of changes that are merged on read before a compaction.
MOST_FOLDERS = 50


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the whole folders `kind`=n under path, ascending: one name a batch since the last compaction but few."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [int(m[1]) for n in names if (m := re.fullmatch(kind + r"=(\d+)", n))]
    return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}/_SUCCESS")))


def _parts(spark: SparkSession, path: str, before: int | None = None) -> tuple[list[int], list[int]]:
    base = [b for b in _folders(spark, path, "base") if before is None or b < before][-1:]
    return base, [b for b in _folders(spark, path, "batch") if b > (base[0] if base else -1) and (before is None or b < before)]


def read(spark: SparkSession, path: str, schema: str, key: str, version: str, deleted: str = "deleted", keep_deleted: bool = False) -> DataFrame:
    """The newest row of each key (of equal versions the largest row), without those marked deleted; no row for an empty table. A null key is a key of its own, a null version the oldest."""
    base, batches = _parts(spark, path)
    paths = [f"{path}/base={b}" for b in base] + [f"{path}/batch={b}" for b in batches]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    rows = newest(rows, key, version)
    return rows if keep_deleted else rows.where(~F.coalesce(F.col(deleted), F.lit(False)))


def compact(spark: SparkSession, path: str, schema: str, key: str, version: str) -> int | None:
    """Folds all batches into a new base, tombstones with them (an older row may come late); its number, or None if there is nothing to fold. The folders that it replaces stay, for readers that began before, until `vacuum`."""
    _, batches = _parts(spark, path)
    if not batches:
        return None
    read(spark, path, schema, key, version, keep_deleted=True).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")
    return batches[-1]


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes bases before the newest and the batches that are in it. The newest batch stays, so that it can come again."""
    bases, batches = _folders(spark, path, "base"), _folders(spark, path, "batch")
    if not bases:
        return
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = [f"base={b}" for b in bases[:-1]] + [f"batch={b}" for b in batches[:-1] if b <= bases[-1]]
    for name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


def writer(path: str, schema: str, key: str, version: str, most: int = MOST_FOLDERS) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` calls: keeps a batch's newest row of each key, under the batch's id."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        newest(rows, key, version).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if len(_parts(spark, path)[1]) >= most:
            compact(spark, path, schema, key, version)

    return write


def upsert(stream: DataFrame, path: str, checkpoint: str, schema: str, key: str, version: str, once: bool = True, most: int = MOST_FOLDERS) -> StreamingQuery:
    """Keeps the table at `path` by the rows of `stream`."""
    out = stream.writeStream.foreachBatch(writer(path, schema, key, version, most)).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.trigger(processingTime="1 minute").start()


class Progress(StreamingQueryListener):
    """The progress of streams as rows: query, batch, rows, label (120 characters), at. A row a query and label at most every `every` seconds; the newest `most` rows are kept, as they are the driver's."""

    def __init__(self, every: float = 2.0, most: int = 1000) -> None:
        self.every, self.most = every, most
        self._rows: list[tuple] = []
        self._last: dict[str, tuple[float, str]] = {}
        self._lock = threading.Lock()

    def add(self, query: str, batch: int, rows: int, label: str, now: float | None = None) -> None:
        now = time.time() if now is None else float(now)
        with self._lock:
            then, what = self._last.get(query, (float("-inf"), ""))
            if now - then < self.every and label == what:
                return
            self._last[query] = (now, label)
            self._rows = [*self._rows, (query, batch, rows, label[:120], now)][-self.most :]

    def onQueryStarted(self, event) -> None:
        self.add(str(event.id), -1, 0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.add(str(p.id), p.batchId, p.numInputRows, f"batch {p.batchId}")

    def onQueryIdle(self, event) -> None:
        self.add(str(event.id), -1, 0, "idle")

    def onQueryTerminated(self, event) -> None:
        self.add(str(event.id), -1, 0, f"failed: {event.exception}" if event.exception else "ended")

    def rows(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), "query string, batch long, rows long, label string, at double")
