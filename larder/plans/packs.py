"""Which packs to buy where: the cheapest plan of each ingredient and store, the store to choose, what is used of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.prices import NOW, current_price

# fixed values: what a plan may fall short, and when a search is too large
SHORT, SHORT_MOST, COMBINATIONS = 0.02, 15.0, 20_000
SIZES = (1, 6, 10)  # packs of an ingredient, in pieces or in 250 g or ml; n cost n single ones less 3 n percent
MAIN, PRODUCE, AISLE = 1, 2, "SMALL"  # the household's two stores, and the aisle bought in the second


def offers(spark: SparkSession, d: str) -> DataFrame:
    """ingredient, store, unit, need (null: to taste), q (what the packs hold), c (their cents), bulk (cents of 1,000 by weight, null for none)."""
    p = current_price(spark, d).select(F.col("pack").alias("ingredient"), "store", "cents")
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("ingredient"), F.col("p_type").alias("aisle"))
    unit = F.element_at(F.array(*map(F.lit, ("g", "ml", "piece"))), (F.col("ingredient") % 3 + 1).cast("int"))
    own = p.join(part, "ingredient").withColumn("unit", unit).withColumn("step", F.when(F.col("unit") == "piece", 1.0).otherwise(250.0))
    need = F.when(F.col("ingredient") % 11 > 0, (F.col("ingredient") % 37 + 1) * F.when(F.col("unit") == "piece", 1.0).otherwise(90.0))
    price = [F.floor(F.col("cents") * n * (100 - 3 * n) / 100).cast("long") for n in SIZES]
    bulk = F.when((F.col("aisle") == AISLE) & (F.col("unit") != "piece"), F.col("cents") * 3)
    return own.select("ingredient", "store", "aisle", "unit", need.alias("need"), F.array(*[F.col("step") * n for n in SIZES]).alias("q"), F.array(*price).alias("c"), bulk.alias("bulk"))


def plan(need: Column, unit: Column, q: Column, c: Column, bulk: Column) -> Column:
    """The cheapest plan (cents, surplus, packs, counts, weighed): ties to less surplus, then to fewer packs.

    Packs may fall short of a need by SHORT, at most by SHORT_MOST; never for pieces. Counts of the two larger packs
    are tried up to what covers the need alone, the smallest fills the rest: in one row, without a shuffle. Beyond
    COMBINATIONS only packs of one size are tried. By weight, one buys steps of 50. Without a need it is one
    of the cheapest pack.
    """
    target = need - F.when(unit == "piece", 0.0).otherwise(F.least(need * SHORT, F.lit(SHORT_MOST)))
    most = [F.greatest(F.lit(1), F.ceil(target / q[k] - 1e-9)).cast("long") for k in range(3)]
    none = F.lit(0).cast("long")

    def made(x: Column, y: Column, z: Column) -> Column:
        n = (x, y, z)
        cents = sum(a * c[k] for k, a in enumerate(n))
        got = sum(a * q[k] for k, a in enumerate(n))
        return F.struct(cents.cast("long").alias("cents"), F.round(got - need, 3).alias("surplus"), (x + y + z).alias("packs"), x.alias("x"), y.alias("y"), z.alias("z"), F.lit(0.0).alias("weighed"))

    def filled(y: Column, z: Column) -> Column:
        return made(F.greatest(none, F.ceil((target - y * q[1] - z * q[2]) / q[0] - 1e-9)).cast("long"), y, z)

    every = F.transform(F.sequence(none, most[1]), lambda y: F.array_min(F.transform(F.sequence(none, most[2]), lambda z: filled(y, z))))
    single = F.array(made(most[0], none, none), made(none, most[1], none), made(none, none, most[2]))
    small = (most[0] + 1) * (most[1] + 1) * (most[2] + 1) <= COMBINATIONS
    steps = F.ceil(need / 50 - 1e-9) * 50.0
    loose = F.struct(F.round(steps / 1000 * bulk).cast("long").alias("cents"), F.round(steps - need, 3).alias("surplus"), F.lit(1).cast("long").alias("packs"), none.alias("x"), none.alias("y"), none.alias("z"), steps.alias("weighed"))
    wanted = F.array_min(F.concat(F.when(small, every).otherwise(single), F.when(bulk.isNotNull(), F.array(loose)).otherwise(F.array().cast("array<struct<cents:bigint,surplus:double,packs:bigint,x:bigint,y:bigint,z:bigint,weighed:double>>"))))
    k = F.array_position(c, F.array_min(c))
    one = F.struct(F.array_min(c).alias("cents"), F.lit(0.0).alias("surplus"), F.lit(1).cast("long").alias("packs"), (k == 1).cast("long").alias("x"), (k == 2).cast("long").alias("y"), (k == 3).cast("long").alias("z"), F.lit(0.0).alias("weighed"))
    return F.when(need > 1e-4, wanted).otherwise(one)


def pack_plan(spark: SparkSession, d: str) -> DataFrame:
    own = offers(spark, d).withColumn("p", plan(*map(F.col, ("need", "unit", "q", "c", "bulk"))))
    return own.select("ingredient", "store", "p.*")


def priced(spark: SparkSession, d: str) -> DataFrame:
    """ingredient, store, aisle, need, cents of the plan, used (cents of what is needed alone, at the store's best price by unit)."""
    own = offers(spark, d).withColumn("p", plan(*map(F.col, ("need", "unit", "q", "c", "bulk"))))
    by_unit = F.array_min(F.concat(F.transform(F.arrays_zip("q", "c"), lambda x: x["c"] / x["q"]), F.when(F.col("bulk").isNotNull(), F.array(F.col("bulk") / 1000)).otherwise(F.array().cast("array<double>"))))
    return own.select("ingredient", "store", "aisle", "need", F.col("p.cents").alias("cents"), F.round(F.col("need") * by_unit).cast("long").alias("used"))


def choose_store(spark: SparkSession, d: str) -> DataFrame:
    """Each ingredient's store: the one that its aisle goes to, the main one, the other, if they have a price; else the cheapest, the first of equals. With the best price elsewhere, the possible saving, and the cents of what is used."""
    own = priced(spark, d)
    first, second = F.when(F.col("aisle") == AISLE, PRODUCE).otherwise(MAIN), F.lit(MAIN)
    place = F.when(F.col("store") == first, 0).when(F.col("store") == second, 1).when(F.col("store") == PRODUCE, 2).otherwise(3)
    choice = F.min(F.struct(place.alias("place"), F.when(place == 3, F.col("cents")).alias("by"), "store", "cents", "used")).alias("x")
    out = own.groupBy("ingredient").agg(choice, F.min(F.struct("cents", "store")).alias("b"))
    saving = F.when(F.col("x.store") == F.col("b.store"), 0).otherwise(F.greatest(F.lit(0), F.col("x.cents") - F.col("b.cents")))
    return out.select("ingredient", "x.store", "x.cents", F.col("b.store").alias("best_store"), F.col("b.cents").alias("best_cents"), saving.cast("long").alias("saving"), F.col("x.used").alias("used"))


OFFERS = NOW + f""", o AS (SELECT pack AS ingredient, store, p_type AS aisle, cents, CASE pack % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'piece' END AS unit FROM now JOIN part ON p_partkey = pack),
o2 AS (SELECT *, CASE WHEN unit = 'piece' THEN 1.0 ELSE 250.0 END::DOUBLE AS a, CASE WHEN ingredient % 11 > 0 THEN (ingredient % 37 + 1) * CASE WHEN unit = 'piece' THEN 1.0 ELSE 90.0 END END::DOUBLE AS need,
  CAST(floor(cents * 97 / 100::DOUBLE) AS BIGINT) AS c1, CAST(floor(cents * 6 * 82 / 100::DOUBLE) AS BIGINT) AS c2, CAST(floor(cents * 10 * 70 / 100::DOUBLE) AS BIGINT) AS c3,
  CASE WHEN aisle = '{AISLE}' AND unit <> 'piece' THEN cents * 3 END AS bulk FROM o),
o3 AS (SELECT *, need - CASE WHEN unit = 'piece' THEN 0::DOUBLE ELSE least(need * {SHORT}::DOUBLE, {SHORT_MOST}::DOUBLE) END AS target FROM o2),
o4 AS (SELECT *, greatest(1, ceil(target / a - 1e-9::DOUBLE))::BIGINT AS m1, greatest(1, ceil(target / (6 * a) - 1e-9::DOUBLE))::BIGINT AS m2, greatest(1, ceil(target / (10 * a) - 1e-9::DOUBLE))::BIGINT AS m3 FROM o3 WHERE need > 1e-4),
e AS (SELECT *, y.y, z.z FROM o4, LATERAL (SELECT unnest(range(0, m2 + 1)) AS y) y, LATERAL (SELECT unnest(range(0, m3 + 1)) AS z) z WHERE (m1 + 1) * (m2 + 1) * (m3 + 1) <= {COMBINATIONS}),
f AS (SELECT ingredient, store, need, a, c1, c2, c3, greatest(0, ceil((target - y * 6 * a - z * 10 * a) / a - 1e-9::DOUBLE))::BIGINT AS x, y, z FROM e
  UNION ALL SELECT ingredient, store, need, a, c1, c2, c3, CASE k WHEN 1 THEN m1 ELSE 0 END, CASE k WHEN 2 THEN m2 ELSE 0 END, CASE k WHEN 3 THEN m3 ELSE 0 END FROM o4, (VALUES (1), (2), (3)) v(k) WHERE (m1 + 1) * (m2 + 1) * (m3 + 1) > {COMBINATIONS}),
g AS (SELECT ingredient, store, x * c1 + y * c2 + z * c3 AS cents, round((x + 6 * y + 10 * z) * a - need, 3) AS surplus, x + y + z AS packs, x, y, z, 0::DOUBLE AS weighed FROM f
  UNION ALL SELECT ingredient, store, CAST(round(ceil(need / 50 - 1e-9::DOUBLE) * 50 / 1000 * bulk) AS BIGINT), round(ceil(need / 50 - 1e-9::DOUBLE) * 50 - need, 3), 1, 0, 0, 0, ceil(need / 50 - 1e-9::DOUBLE) * 50::DOUBLE FROM o3 WHERE need > 1e-4 AND bulk IS NOT NULL
  UNION ALL SELECT ingredient, store, least(c1, c2, c3), 0, 1, CASE WHEN c1 <= least(c2, c3) THEN 1 ELSE 0 END, CASE WHEN c2 < c1 AND c2 <= c3 THEN 1 ELSE 0 END, CASE WHEN c3 < least(c1, c2) THEN 1 ELSE 0 END, 0 FROM o3 WHERE need IS NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY ingredient, store ORDER BY cents, surplus, packs, x, y, z, weighed) AS rn FROM g),
plan AS (SELECT ingredient, store, CAST(cents AS BIGINT) AS cents, surplus::DOUBLE AS surplus, CAST(packs AS BIGINT) AS packs, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, weighed::DOUBLE AS weighed FROM h WHERE rn = 1)"""

QUERIES = {f.__name__: f for f in (pack_plan, choose_store)}
SQL = {
    "pack_plan": f"WITH {OFFERS} SELECT * FROM plan",
    "choose_store": f"""WITH {OFFERS},
      u AS (SELECT plan.*, aisle, CAST(round(need * least(c1 / a, c2 / (6 * a), c3 / (10 * a), coalesce(bulk / 1000::DOUBLE, 'infinity'::DOUBLE))) AS BIGINT) AS used FROM plan JOIN o3 USING (ingredient, store)),
      pl AS (SELECT *, CASE WHEN store = CASE WHEN aisle = '{AISLE}' THEN {PRODUCE} ELSE {MAIN} END THEN 0 WHEN store = {MAIN} THEN 1 WHEN store = {PRODUCE} THEN 2 ELSE 3 END AS place FROM u),
      k AS (SELECT *, row_number() OVER (PARTITION BY ingredient ORDER BY place, CASE WHEN place = 3 THEN cents END NULLS FIRST, store) AS k1, row_number() OVER (PARTITION BY ingredient ORDER BY cents, store) AS k2 FROM pl)
      SELECT p.ingredient, p.store, p.cents, b.store AS best_store, b.cents AS best_cents, CAST(CASE WHEN p.store = b.store THEN 0 ELSE greatest(0, p.cents - b.cents) END AS BIGINT) AS saving, p.used
      FROM k p JOIN k b ON p.ingredient = b.ingredient AND p.k1 = 1 AND b.k2 = 1""",
}
