"""What SQL cannot say: weeks filled in turn, leftovers placed, seeded chance, seeds that are wrong."""

import zlib

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from larder.operators import labels, writes
from larder.plans import menu

DATA = "/root/testdata/sf0.001"


def test_week_has_one_dish_a_slot_and_no_dish_twice(spark):
    rows = menu.week_menu(spark, DATA).toPandas()
    assert len(rows)
    assert not rows.duplicated(["household", "day", "rank"]).any()
    orders = spark.read.parquet(f"{DATA}/orders.parquet").toPandas()
    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas()
    events["day"], events["rank"] = (events["ts"].dt.normalize() - pd.Timestamp(menu.WEEK)).dt.days + 1, (events["event_type"] != "click").astype(int)
    busy = set(map(tuple, events[["user_id", "day", "rank"]].to_numpy().tolist()))
    assert not busy & set(map(tuple, rows[["household", "day", "rank"]].to_numpy().tolist()))
    assert set(rows["household"]) == {h for h in orders["o_custkey"] if any((h, d, r) not in busy for d in range(1, 8) for r in (0, 1))}
    assert not rows[~rows["leftover"]].duplicated(["household", "recipe"]).any()
    rest = rows[rows["leftover"]].merge(rows[~rows["leftover"]], on=["household", "recipe"])
    assert len(rest) and ((rest["day_x"] == rest["day_y"] + 1) & (rest["rank_x"] == 0) & (rest["rank_y"] == 1)).all()


def test_week_by_hand():
    slots = pd.DataFrame({"day": [1, 1, 2, 2], "rank": [0, 1, 0, 1]})
    pool = pd.DataFrame({"recipe": [5, 6, 7], "score": [90.0, 80.0, 60.0], "kind": [1, 1, 2]})
    out = menu.filled(slots, pool)
    # 6 is like 5 and counts two thirds, so 7 goes before it; its dinner serves the next noon
    assert out.to_numpy().tolist() == [[1, 0, 5, False], [1, 1, 7, False], [2, 0, 7, True], [2, 1, 6, False]]


def test_leftovers_take_free_slots_or_are_frozen(spark):
    batch = pd.DataFrame({"meal": [1, 2, 3], "slot": [0, 1, 3], "portions": [2, 0, 1]})
    assert menu.placed(batch) == [(1, 2, False), (1, 3, False), (3, 4, False)]
    assert menu.placed(batch, most=1) == [(1, -1, True), (1, -1, True), (3, 4, False)]
    rows = menu.placed_leftovers(spark, DATA).toPandas()
    assert len(rows) and not rows[~rows["frozen"]].duplicated(["household", "slot"]).any()


def test_chance_is_that_of_crc32(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").limit(20).collect()
    got = {r["meal"]: r["thousandths"] for r in labels.seeded_jitter(spark, DATA).collect()}
    for r in e:
        key = f"1-{r['user_id']}-{r['ts']:%Y-%m-%d}-{r['event_type']}"
        assert got[r["event_id"]] == zlib.crc32(key.encode()) % 1000


def test_a_wrong_seed_stops_the_run(spark):
    ingredients = spark.createDataFrame([("flour", "g")], "ingredient string, base string")
    good = [("bread", "flour", 0.5, "kg")]
    assert writes.checked_recipes(spark.createDataFrame(good, "recipe string, ingredient string, qty double, unit string"), ingredients).first()["qty"] == 500
    for bad in (("bread", "salt", 1.0, "g"), ("bread", "flour", 1.0, "piece")):
        with pytest.raises(PySparkException, match="bad line of bread"):
            writes.checked_recipes(spark.createDataFrame([*good, bad], "recipe string, ingredient string, qty double, unit string"), ingredients).collect()
