"""Pack plans against known answers: milk, eggs, carrots by weight."""

import pytest
from pyspark.sql import functions as F

from larder.plans import packs

MILK, EGGS, CARROTS = ("ml", [1000.0, 6000.0, 90000.0], [125, 719, 99999], None), ("piece", [6.0, 12.0, 360.0], [219, 399, 99999], None), ("g", [90000.0] * 3, [99999] * 3, 140)
CASES = [(MILK, 600.0, 125, 400.0), (MILK, 5500.0, 719, 500.0), (MILK, 1010.0, 125, -10.0), (MILK, 1020.0, 250, 980.0), (EGGS, 3.0, 219, 3.0), (EGGS, 7.0, 399, 5.0), (EGGS, 13.0, 618, 5.0), (CARROTS, 430.0, 63, 20.0), (MILK, None, 125, 0.0)]


def test_known_plans(spark):
    rows = [(i, *what, need) for i, (what, need, _, _) in enumerate(CASES)]
    own = spark.createDataFrame(rows, "i int, unit string, q array<double>, c array<long>, bulk long, need double")
    got = own.withColumn("p", packs.plan(*map(F.col, ("need", "unit", "q", "c", "bulk")))).orderBy("i").collect()
    for r, (_, _, cents, surplus) in zip(got, CASES, strict=True):
        assert (r["p"]["cents"], r["p"]["surplus"]) == (cents, pytest.approx(surplus)), r


def test_too_many_combinations(spark):
    own = spark.createDataFrame([("piece", [1.0, 2.0, 3.0], [10, 19, 27], None, 1000.0)], "unit string, q array<double>, c array<long>, bulk long, need double")
    p = own.select(packs.plan(*map(F.col, ("need", "unit", "q", "c", "bulk"))).alias("p")).first()["p"]
    assert (p["cents"], p["x"], p["y"], p["z"]) == (334 * 27, 0, 0, 334)
