"""The queue of all households: each has a head, and one of all of them is read at a time."""

import datetime

import duckdb
import pytest

from larder import catalogue

DAY = datetime.datetime(1998, 6, 1)
EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
IMPORTS = [(11, 3, DAY, "signup", 5.0), (12, 3, DAY, "signup", 6.0), (13, 1, DAY, "signup", 7.0), (5, 2, DAY, "signup", 20.0), (6, 2, DAY, "view", 1.0)]
RECEIPTS = [(8, 2, "O", DAY, "5-LOW"), (7, 2, "O", DAY, "5-LOW"), (1, 3, "O", DAY, "5-LOW"), (2, 4, "F", DAY, "5-LOW"), (None, 5, "O", DAY, "5-LOW"), (9, None, "O", DAY, "5-LOW")]
HEADS = {(3, 0, 11, 0, 12), (1, 0, 13, 0, 11), (2, 1, 7, 0, 11), (5, 1, None, 0, 11), (None, 1, 9, 0, 11)}


@pytest.mark.parametrize(("imports", "receipts", "heads"), [(IMPORTS, RECEIPTS, HEADS), (IMPORTS[:1], [], {(3, 0, 11, None, None)}), ([], RECEIPTS[:3], {(2, 1, 7, 1, 1), (3, 1, 1, 1, 7)}), ([], [], set())])
def test_each_household_has_a_head_that_waits_for_the_first_of_all(spark, tmp_path, imports, receipts, heads):
    c = duckdb.connect()
    for name, rows, schema in (("events", imports, EVENTS), ("orders", receipts, ORDERS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["queue_head"](spark, str(tmp_path)).select("household", "kind", "id", "busy_kind", "busy_id").collect()]
    assert len(got) == len(heads)
    assert set(got) == heads == set(c.execute(catalogue.SQL["queue_head"]).fetchall())
