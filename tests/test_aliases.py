"""The chain of what is known of a label."""

from larder.operators import aliases


def test_chain(spark):
    labels = spark.createDataFrame([(1, "LAIT"), (1, "PAIN"), (2, "LAIT"), (2, "PAIN"), (3, "SEL"), (1, "RED BOLT 500G"), (1, "RED BOLT 730G"), (1, "RED BOLT"), (1, "ZZZ"), (4, "")], "store long, label string")
    learned = spark.createDataFrame(
        [(1, "LAIT", 10, False, 2), (1, "PAIN", None, True, 9), (3, "PAIN", 20, False, 3), (4, "PAIN", 21, False, 5), (5, "PAIN", 22, True, 99), (9, "LAIT", 11, False, 1), (8, "SEL", None, False, 4)],
        "store long, label string, pack long, ignored boolean, hits long",
    )
    index = spark.createDataFrame([("red bolt", 1, ["red", "bolt"]), ("blue bolt", 2, ["blue", "bolt"])], "ingredient string, place long, tokens array<string>")
    packs = spark.createDataFrame([("red bolt", 7, 250.0), ("red bolt", 8, 505.0), ("red bolt", 9, 500.0)], "ingredient string, pack long, quantity double")
    got = {(r.store, r.label): (r.status, r.pack, r.ingredient) for r in aliases.matched(labels, learned, index, packs).collect()}
    assert got == {
        (1, "LAIT"): ("known", 10, None), (1, "PAIN"): ("ignored", None, None), (2, "LAIT"): ("suggested", 10, None), (2, "PAIN"): ("suggested", 21, None), (3, "SEL"): ("unknown", None, None),
        (1, "RED BOLT 500G"): ("suggested", 9, "red bolt"), (1, "RED BOLT 730G"): ("suggested", None, "red bolt"), (1, "RED BOLT"): ("suggested", 7, "red bolt"), (1, "ZZZ"): ("unknown", None, None), (4, ""): ("unknown", None, None),
    }
