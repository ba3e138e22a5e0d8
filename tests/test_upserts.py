"""A table kept by a stream: the newest row wins, a batch that comes again changes nothing, progress becomes rows."""

import time

import pytest

from larder.streaming import upserts

SCHEMA = "id long, version long, text string, deleted boolean"
ARGS = (SCHEMA, "id", "version")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_upsert(spark, tmp_path):
    source, path, done = (f"file://{tmp_path}/{x}" for x in ("source", "table", "done"))
    assert rows(upserts.read(spark, path, *ARGS)) == []

    def load(*new):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        upserts.upsert(spark.readStream.schema(SCHEMA).parquet(source), path, done, *ARGS, most=3).awaitTermination(60)
        return rows(upserts.read(spark, path, *ARGS))

    listener = upserts.Progress(every=0)
    spark.streams.addListener(listener)
    assert load((1, 1, "a", False), (2, 5, "b", False), (1, 2, "c", None)) == [(1, 2, "c", None), (2, 5, "b", False)]
    assert load((2, 4, "late", False), (1, 3, None, True), (None, 1, "n", False)) == [(2, 5, "b", False), (None, 1, "n", False)]
    assert upserts._parts(spark, path) == ([], [0, 1])
    assert load((1, 1, "later", False), (3, 1, "x", False)) == [(2, 5, "b", False), (3, 1, "x", False), (None, 1, "n", False)]
    assert upserts._parts(spark, path) == ([2], [])  # folded, its tombstone kept
    upserts.vacuum(spark, path)
    assert upserts._folders(spark, path, "batch") == [2]
    assert load((1, 4, "back", False))[0] == (1, 4, "back", False)
    spark.streams.removeListener(listener)
    until = time.time() + 20
    while time.time() < until and listener.rows(spark).where("label = 'ended'").count() == 0:
        time.sleep(0.5)
    assert listener.rows(spark).where("rows = 3").count() == 2


def test_killed_batch(spark, tmp_path):
    """A batch that fails after its write, or leaves a half-written folder, comes again and leaves one result."""
    source, path, done = (f"file://{tmp_path}/{x}" for x in ("source", "table", "done"))
    spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", False)], SCHEMA).coalesce(1).write.parquet(source)
    write = upserts.writer(path, *ARGS)

    def killed(batch, n):
        write(batch, n)
        (tmp_path / "table" / f"batch={n}" / "_SUCCESS").unlink()
        raise RuntimeError("killed")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    with pytest.raises(Exception, match="killed"):
        stream.writeStream.foreachBatch(killed).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination(60)
    assert rows(upserts.read(spark, path, *ARGS)) == []
    for _ in range(2):
        upserts.upsert(stream, path, done, *ARGS).awaitTermination(60)
        assert rows(upserts.read(spark, path, *ARGS)) == [(1, 1, "a", False), (2, 1, "b", False)]
    write(spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", False)], SCHEMA), 0)
    assert rows(upserts.read(spark, path, *ARGS)) == [(1, 1, "a", False), (2, 1, "b", False)]


def test_progress_rows(spark):
    p = upserts.Progress(every=2.0, most=3)
    for now, label in ((0, "a"), (1, "a"), (1.5, "b"), (4, "b"), (4.1, "c" * 200)):
        p.add("q", 1, 5, label, now)
    assert [(r.label, r.at) for r in p.rows(spark).orderBy("at").collect()] == [("b", 1.5), ("b", 4), ("c" * 120, 4.1)]
