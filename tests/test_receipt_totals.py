"""Receipts whose total is below nothing or over 9,999.99 euros, against their SQL."""

import datetime

import duckdb
import pytest

from larder import catalogue

DAY = datetime.datetime(1998, 6, 1)
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
CHEAP, DEAR = (1, 1, 1, 1, 1.0, 951.0, 0.10, 0.02, "N", "O", DAY), (50.0, 2449.5, 0.0, 0.04, "A", "F", DAY)
ORDERS = [CHEAP, (3, 1, 1, 1, 1.0, 950.04, 0.08, 0.02, "A", "F", DAY), *((2, 2, 1, n, *DEAR) for n in range(1, 7)), (2, 1, 1, 7, 1.0, 930.0, 0.0, 0.07, "R", "F", DAY), *((4, 2, 1, n, *DEAR) for n in range(1, 5)), (4, 1, 1, 5, 1.0, 930.0, 0.09, 0.07, "R", "F", DAY)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, c = tmp_path_factory.mktemp("receipts"), duckdb.connect()
    for name, rows, schema in (("lineitem", ORDERS, LINES), ("part", [(1, "hot bolt", "", "", 3, 1.0), (2, "red rod", "", "", 20, 1.0)], PARTS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["receipt_heads", "receipt_articles", "receipt_packs"])
def test_totals_are_read_as_they_are(spark, tables, name):
    d, c = tables
    theirs = c.execute(catalogue.SQL[name])
    cols = [x[0] for x in theirs.description]
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, d).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(theirs.fetchall(), key=str)
    if name == "receipt_heads":
        assert {r[cols.index("receipt")]: r[cols.index("total")] < 0 for r in got} == {1: True, 2: False, 3: True, 4: False} and max(r[cols.index("total")] for r in got) > 999_999
