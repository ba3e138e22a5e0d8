"""Receipts are read once, where their text is: nothing is dealt out again."""

from larder.operators import receipts
from larder.operators.labels import label_quantity
from larder.sources import rendered
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan(df, kind):
    return str(getattr(df._jdf.queryExecution(), kind)())


def test_articles_need_no_exchange_beyond_that_of_the_text(spark):
    alone = plan(rendered.receipts(spark, DATA), "sparkPlan").count("FileScan")
    for query in (receipts.receipt_articles, receipts.receipt_heads, receipts.receipt_packs):
        assert plan(query(spark, DATA), "sparkPlan").count("FileScan") == alone
    text = spark.createDataFrame([(1, "PAIN 1,20\nTOTAL 1,20")], "receipt long, text string")
    assert "Exchange" not in plan(receipts.parsed(text), "executedPlan")


def test_details_that_wait_and_rates_of_one_letter(spark):
    text = "2 x 0,89\nYAOURT 1,78 A\n0,500 kg x 4,00\nBEURRE ?????\nREMISE 0,10-\nRIZ 2,00 B\n3 x 9,99\nTOTAL 9,00\nTVA A 5,50 %\nTVA A 20,00 %"
    rows = receipts.parsed(spark.createDataFrame([(1, text), (2, None), (3, "TOTAL 1,00")], "receipt long, text string")).collect()
    got = sorted((r.n, r.label, r.qty, r.unit, r.cents, r.discount, r.rate, r.note) for r in rows)
    assert got == [(1, "YAOURT", 2.0, "piece", 178, 0, 5.5, None), (2, "BEURRE", 0.5, "kg", 532, 10, None, "deduced from the total"), (3, "RIZ", 3.0, "piece", 200, 0, None, None)]


def test_a_label_is_searched_once_for_its_quantity(spark):
    x = F.col("x")
    labels = spark.createDataFrame([("LAIT 6X1L",), ("RIZ 500G",), ("OEUFS X12",), ("JAMBON 4P",), ("PAIN",), ("SEL 0KG",), (None,)], "x string")
    df = labels.select("x", label_quantity(x).alias("q"))
    assert plan(df, "analyzed").count("RLIKE") == 3
    assert {r.x: r.q and tuple(r.q) for r in df.collect()} == {"LAIT 6X1L": (6000.0, "ml"), "RIZ 500G": (500.0, "g"), "OEUFS X12": (12.0, "piece"), "JAMBON 4P": (4.0, "piece"), "PAIN": None, "SEL 0KG": None, None: None}
