"""Every relational query against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from larder import catalogue

DATA = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return cols, sorted(tuple(map(plain, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    import pandas as pd

    got = catalogue.QUERIES[name](spark, DATA)
    mine = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns, dtype=object)
    cur = duck.execute(catalogue.SQL[name])
    theirs = pd.DataFrame(cur.fetchall(), columns=[x[0] for x in cur.description], dtype=object)
    assert rows(mine) == rows(theirs)
