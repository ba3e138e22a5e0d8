"""Columns that must multiply, line by line."""

from pyspark.sql import functions as F

from larder.operators import repairs


def test_columns(spark):
    lines = ["PAIN 0,55 4 2,20", "PAIN 0,55 4 2,28", "LAIT 0,99 I 0,99 A", "LAIT 8,99 7 0,99", "EAU 1,00 71 1,10", "THE 2,00 9 6,04 €", "RIZ 2,00", "SEL 3,00 2 4,40", "", "OIE 1,00 3 30,00", "OIE 0,00 3 3,00"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, x string").select("id", repairs.repaired(F.col("x")).alias("r"))
    got = [None if r.r is None else tuple(r.r) for r in sorted(df.collect())]
    assert got == [(4, 55, 220, False), (4, 55, 220, True), (1, 99, 99, False), (1, 99, 99, True), (1, 110, 110, True), (3, 201, 604, True), None, None, None, (30, 100, 3000, True), None]
