"""Incremental loads take each file once; the newest version of a key wins."""

from larder.streaming import changes

SCHEMA = "id long, version long, text string"


def test_incremental_load(spark, tmp_path):
    source, target, done = (f"file://{tmp_path}/{x}" for x in ("source", "target", "done"))

    def load(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        changes.load_changes(spark, source, target, done, SCHEMA).awaitTermination(60)
        return spark.read.schema(SCHEMA).parquet(target)

    assert load([(1, 1, "a"), (2, 1, None)]).count() == 2
    every = load([(1, 2, "b"), (None, 1, "c"), (1, 2, "b")])
    assert every.count() == 5
    assert sorted(changes.newest(every, "id", "version").collect(), key=str) == sorted([(1, 2, "b"), (2, 1, None), (None, 1, "c")], key=str)


def test_revisions(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], SCHEMA).write.parquet(source)
    query = changes.revisions(spark, source, SCHEMA, "id", "version").writeStream.format("memory").queryName("revisions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("revisions").collect())) == [(1, 3), (2, 2)]
