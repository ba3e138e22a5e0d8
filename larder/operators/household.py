"""Portions, units, labels and places: the scalar rules of recipes and of the household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions import units
from larder.sources.tables import LINES, lines, table

TODAY = "2026-10-07"
# fixed values: typical weights of a unit in grams by the ingredient's slug (the first rule that fits), and grams of a millilitre
TYPICAL = ((0, "ring", "tranche", 12.0), (1, "bolt|gear", "morceau", 30.0), (2, "plate", "feuille", 5.0), (3, "(^|-)red-", "poignee", 25.0), (4, "widget", "morceau", 40.0))
DENSITY = ((0, "anvil", 1.2), (1, "blue", 0.55), (2, "gear|bolt", 0.85))
GUESTS, MEALS, PORTIONS = 20, 4, 50


def number(x: Column) -> Column:
    """Two decimals at most, with a comma, without needless zeros."""
    two = F.format_string("%.2f", F.round(x, 2))
    return F.replace(F.regexp_replace(F.regexp_replace(two, "0+$", ""), "\\.$", ""), F.lit("."), F.lit(","))


def base_label(q: Column, base: Column) -> Column:
    """A quantity in its base unit as one reads it: 1500 g as 1,5 kg."""
    g = F.when(q >= 1000, F.concat(number(q / 1000), F.lit(" kg"))).otherwise(F.concat(number(q), F.lit(" g")))
    ml = F.when(q >= 1000, F.concat(number(q / 1000), F.lit(" L"))).when((q >= 100) & (q % 10 == 0), F.concat(number(q / 10), F.lit(" cl"))).otherwise(F.concat(number(q), F.lit(" ml")))
    return F.when(base == "g", g).when(base == "ml", ml).otherwise(F.concat(number(q), F.when(q > 1, " pièces").otherwise(" pièce")))


def scaled_label(q: Column, unit: Column) -> Column:
    """A recomputed quantity: larger units from a limit on, halves as fractions."""
    whole = F.floor(q)
    half = F.abs(q - whole - 0.5) < 0.01
    counted = unit.isin("piece", "cac", "cas", "verre", "dl") & (half | (F.abs(q - whole) < 0.01))
    text = F.when(half & (whole > 0), F.concat(whole.cast("string"), F.lit(" ½"))).when(half, "½").otherwise(whole.cast("string"))
    name = F.when((q > 1) & unit.isin("piece", "verre", "pincee"), F.concat(unit, F.lit("s"))).otherwise(unit)
    big = F.when((unit == "g") & (q >= 1000), F.concat(number(q / 1000), F.lit(" kg"))).when((unit == "ml") & (q >= 1000), F.concat(number(q / 1000), F.lit(" L"))).when((unit == "cl") & (q >= 100), F.concat(number(q / 100), F.lit(" L")))
    return F.coalesce(big, F.concat_ws(" ", F.when(counted, text).otherwise(number(q)), name))


def unit_labels(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of line items, exact in quarters, as labels of both kinds."""
    q = F.col("l_quantity") * F.col("l_linenumber") * F.when(F.col("l_suppkey") % 3 == 0, 60).otherwise(1) / 4
    unit = F.element_at(F.array(*[F.lit(u[0]) for u in units.UNITS]), (F.col("l_partkey") % 11 + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, ("g", "ml", "piece"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    own = table(spark, d, "lineitem").select(q.alias("qty"), unit.alias("unit"), base.alias("base")).distinct()
    return own.select("qty", "unit", "base", base_label(F.col("qty"), F.col("base")).alias("label"), scaled_label(F.col("qty"), F.col("unit")).alias("scaled"))


def typical_units(spark: SparkSession, d: str) -> DataFrame:
    """Each ingredient's typical unit in its base unit, and the weight of a spoon by its density: the first rule that fits its slug."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("ingredient"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("slug"), F.col("p_size").cast("double").alias("size"))
    grams = F.coalesce(*[F.when(F.col("slug").rlike(p), g) for _, p, _, g in TYPICAL])
    unit = F.coalesce(*[F.when(F.col("slug").rlike(p), F.lit(u)) for _, p, u, _ in TYPICAL])
    density = F.coalesce(*[F.when(F.col("slug").rlike(p), x) for _, p, x in DENSITY])
    weight = F.when(F.col("size") > 5, F.col("size") * 4)
    in_base = F.when(F.col("ingredient") % 3 == 0, grams).when(F.col("ingredient") % 3 == 1, grams / F.coalesce(density, F.lit(1.0))).otherwise(grams / weight)
    out = part.select("ingredient", unit.alias("unit"), F.round(in_base, 2).alias("qty"), F.round(15 * density, 1).alias("spoon"))
    return out.where("unit IS NOT NULL OR spoon IS NOT NULL")


def new_units(spark: SparkSession, d: str) -> DataFrame:
    """Typical units that an ingredient doesn't have yet (those of size under 10 have a morceau)."""
    have = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("ingredient"), F.lit("morceau").alias("unit"))
    return typical_units(spark, d).where("unit IS NOT NULL").join(have, ["ingredient", "unit"], "left_anti").select("ingredient", "unit", "qty")


def members(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers as members of its household; one in six has a coefficient by hand, one in nine no birth date."""
    birth = F.when(F.col("c_custkey") % 9 > 0, F.date_sub(F.lit(TODAY).cast("date"), (F.col("c_custkey") * 37 % 9000).cast("int")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("household"), birth.alias("birth"), (F.col("c_custkey") % 6 == 0).alias("by_hand"), (F.col("c_custkey") % 11 / 10).alias("stored"))


def member_share(day: Column) -> Column:
    years = units.age(F.col("birth"), day)
    return F.when(F.col("by_hand") | F.col("birth").isNull(), F.col("stored")).otherwise(units.coefficient(years))


def member_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Months and years of each member on a day, as a label, and the category, by coefficient where the birth date is not known."""
    day = F.lit(TODAY).cast("date")
    years = units.age(F.col("birth"), day)
    months = (F.year(day) - F.year("birth")) * 12 + F.month(day) - F.month("birth") - (F.dayofmonth(day) < F.dayofmonth("birth")).cast("int")
    label = F.when(months < 24, F.concat(months.cast("string"), F.lit(" mois"))).otherwise(F.concat(years.cast("string"), F.lit(" ans")))
    category = F.when(F.col("birth").isNull(), F.when(F.col("stored") <= 0.3, "toddler").when(F.col("stored") < 0.8, "child").otherwise("adult")).when(years < 3, "toddler").when(years < 15, "child").otherwise("adult")
    return members(spark, d).select("member", months.cast("long").alias("months"), label.alias("label"), category.alias("category"), F.round(member_share(day) * 10).cast("long").alias("tenths"))


def household_portions(spark: SparkSession, d: str) -> DataFrame:
    """Portions of each household on a day, in tenths, and of those who eat on a Saturday noon: all but the absent, each tenth member."""
    share = F.round(member_share(F.lit(TODAY).cast("date")) * 10).cast("long")
    here = F.when(F.col("member") % 10 != 4, share).otherwise(0)
    return members(spark, d).groupBy("household").agg(F.sum(share).alias("tenths"), F.sum(here).alias("saturday"), F.count_if(F.col("member") % 10 == 4).alias("absent"))


def serving_factor(spark: SparkSession, d: str) -> DataFrame:
    """By what each recipe's quantities are multiplied.

    Batches: the wanted quantity, at most 20 yields. Portions: by hand in halves up to 50, else the eaters' shares
    and guests at 1 and 0.6, rounded to 2; nothing falls back to the yield; times 1 to 4 meals.
    """
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("recipe"), F.col("o_custkey").alias("c"), F.round("o_totalprice").cast("long").alias("t"))
    n = F.col("recipe")
    base = (n % 6 + 1).cast("double")
    wanted = F.when(n % 5 > 0, (F.col("t") % 900).cast("double") / 4)
    total = F.when(wanted > 0, F.least(wanted, base * 20)).otherwise(base)
    hand = F.when((n % 7 == 0) & (n % 900 > 0), F.least(F.greatest(F.round(n % 900 / 4 * 2) / 2, F.lit(0.5)), F.lit(float(PORTIONS))))
    guests = F.least(F.col("c") % 25, F.lit(GUESTS)) + F.least(F.col("t") % 23, F.lit(GUESTS)) * 0.6
    counted = F.round(F.when(F.col("c") % 4 > 0, guests).otherwise(0.0), 2)
    each = F.coalesce(hand, counted)
    each = F.when(each > 0, each).otherwise(base)
    times = F.greatest(F.lit(1), F.least(F.col("c") % 6, F.lit(MEALS)))
    batch = n % 3 == 0
    return o.select("recipe", batch.alias("batch"), F.round(F.when(batch, total / base).otherwise(each * times / base), 4).alias("factor"), F.round(F.when(batch, total).otherwise(each * times), 2).alias("total"))


def batch_choices(spark: SparkSession, d: str) -> DataFrame:
    """Half, one, two and three times a yield; half only of even numbers, or of grams."""
    own = table(spark, d, "part").select(F.col("p_partkey").alias("recipe"), F.col("p_size").cast("long").alias("yield"), (F.col("p_partkey") % 2 == 0).alias("grams"))
    every = own.withColumn("times", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 3.0)))))
    return every.where("times >= 1 OR grams OR yield % 2 = 0").select("recipe", "times", (F.col("yield") * F.col("times")).alias("qty"))


def cost_per_yield(spark: SparkSession, d: str) -> DataFrame:
    """Cents of one portion, or of 100 g where a recipe yields grams; cheap: portions, all priced, up to 150 cents times a thousand here."""
    own = lines(spark, d).groupBy(F.col("receipt").alias("recipe")).agg(F.sum("paid").alias("cents"), F.bool_and(F.col("qty") > 1).alias("complete"))
    grams = F.col("recipe") % 4 == 0
    size = F.when(grams, (F.col("recipe") % 9 + 1) * 250).otherwise(F.col("recipe") % 6 + 1)
    each = F.round(F.col("cents") * F.when(grams, 100).otherwise(1) / size).cast("long")
    return own.select("recipe", each.alias("each"), (~grams & F.col("complete") & (each <= 1_500_000)).alias("cheap"))


def storage_places(spark: SparkSession, d: str) -> DataFrame:
    """Freezer, fridge or cupboard by aisle."""
    place = F.when(F.col("p_type") == "PROMO", "freezer").when(F.col("p_type").isin("SMALL", "MEDIUM"), "fridge").otherwise("cupboard")
    return table(spark, d, "part").groupBy(place.alias("place"), "p_type").agg(F.count(F.lit(1)).alias("ingredients"))


def learned_units(spark: SparkSession, d: str) -> DataFrame:
    """What an answer about a unit teaches: a unit of one's own, the weight of a piece, or a density (grams of a millilitre, four decimals)."""
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("unit", "piece", "spoon", "cup"))), (n % 4 + 1).cast("int"))
    grams = F.col("p_size").cast("double") * 3
    return table(spark, d, "part").select(
        n.alias("ingredient"), F.when(kind == "unit", grams).alias("own_unit"), F.when(kind == "piece", grams).alias("piece_weight"),
        F.when(kind == "spoon", F.round(grams / 15, 4)).when(kind == "cup", F.round(grams / 200, 4)).alias("density"),
    )


def unit_payload(spark: SparkSession, d: str) -> DataFrame:
    """For each type of part: names by brand as one JSON object, and how many unit codes are valid."""
    part = table(spark, d, "part")
    names = part.groupBy("p_type", "p_brand").agg(F.min("p_name").alias("name"))
    payload = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_brand", "name")))))
    code = F.concat(F.when(part.p_partkey % 2 == 0, "u:").otherwise("U:"), F.replace("p_name", F.lit(" "), F.lit("-")))
    valid = part.groupBy("p_type").agg(F.count_if(code.rlike("^u:[a-z0-9][a-z0-9-]{0,35}$")).alias("valid"))
    return names.groupBy("p_type").agg(payload.alias("payload")).join(valid, "p_type")


def stock_labels(spark: SparkSession, d: str) -> DataFrame:
    """When stock expires, as a label, and its quantity as a form shows it: kilograms from 1,000 g on."""
    day = F.lit("1998-06-01").cast("date")
    left = F.datediff("day", day)
    label = F.when(left < 0, "expired").when(left == 0, "today").when(left == 1, "tomorrow").when(left <= 3, F.concat(left.cast("string"), F.lit(" days"))).otherwise(F.date_format("day", "dd/MM/yyyy"))
    q = F.col("qty") * 60
    own = lines(spark, d).where(F.col("day").between("1998-05-28", "1998-06-10"))
    return own.select("receipt", "line", "pack", label.alias("label"), F.when(q >= 1000, q / 1000).otherwise(q.cast("double")).alias("value"), F.when(q >= 1000, "kg").otherwise("g").alias("unit")).distinct()


NUM = lambda x: f"replace(regexp_replace(regexp_replace(printf('%.2f', CAST(round(CAST({x} AS DECIMAL(18, 4)), 2) AS DOUBLE)), '0+$', ''), '\\.$', ''), '.', ',')"
MEMBERS = f"""mb AS (SELECT c_custkey AS member, c_nationkey AS household, CASE WHEN c_custkey % 9 > 0 THEN CAST(DATE '{TODAY}' - CAST(c_custkey * 37 % 9000 AS INTEGER) AS DATE) END AS birth, c_custkey % 6 = 0 AS by_hand, c_custkey % 11 / 10 AS stored FROM customer),
ms AS (SELECT *, date_part('year', age(DATE '{TODAY}', birth)) AS years, date_part('year', age(DATE '{TODAY}', birth)) * 12 + date_part('month', age(DATE '{TODAY}', birth)) AS months FROM mb),
mt AS (SELECT *, CAST(round(10 * CASE WHEN by_hand OR birth IS NULL THEN stored WHEN years < 1 THEN 0 WHEN years < 3 THEN 0.3 WHEN years < 5 THEN 0.5 WHEN years < 12 THEN 0.7 WHEN years < 15 THEN 0.8 ELSE 1 END) AS BIGINT) AS tenths FROM ms)"""
TYPICAL_SQL = f"""sl AS (SELECT p_partkey AS ingredient, replace(lower(p_name), ' ', '-') AS slug, p_size FROM part),
ty AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(slug, '{p}') THEN {g}" for _, p, _, g in TYPICAL)} END::DOUBLE AS grams, CASE {' '.join(f"WHEN regexp_matches(slug, '{p}') THEN '{u}'" for _, p, u, _ in TYPICAL)} END AS unit,
  CASE {' '.join(f"WHEN regexp_matches(slug, '{p}') THEN {x}" for _, p, x in DENSITY)} END::DOUBLE AS density, CASE WHEN p_size > 5 THEN p_size * 4::DOUBLE END AS weight FROM sl),
tu AS (SELECT ingredient, unit, round(CASE ingredient % 3 WHEN 0 THEN grams WHEN 1 THEN grams / coalesce(density, 1) ELSE grams / weight END, 2) AS qty, round(15 * density, 1) AS spoon FROM ty WHERE unit IS NOT NULL OR density IS NOT NULL)"""
QUERIES = {f.__name__: f for f in (unit_labels, typical_units, new_units, member_profiles, household_portions, serving_factor, batch_choices, cost_per_yield, storage_places, learned_units, unit_payload, stock_labels)}
UNIT_LIST = "[" + ", ".join(f"'{u[0]}'" for u in units.UNITS) + "]"
SQL = {
    "unit_labels": f"""WITH q AS (SELECT DISTINCT l_quantity * l_linenumber * CASE WHEN l_suppkey % 3 = 0 THEN 60 ELSE 1 END / 4 AS qty, {UNIT_LIST}[l_partkey % 11 + 1] AS unit, ['g', 'ml', 'piece'][l_partkey % 3 + 1] AS base FROM lineitem),
      n AS (SELECT *, floor(qty) AS w, abs(qty - floor(qty) - 0.5) < 0.01 AS half, abs(qty - floor(qty)) < 0.01 AS round_, CASE WHEN qty > 1 AND unit IN ('piece', 'verre', 'pincee') THEN unit || 's' ELSE unit END AS name FROM q)
      SELECT qty, unit, base, CASE WHEN base = 'g' THEN CASE WHEN qty >= 1000 THEN {NUM('qty / 1000')} || ' kg' ELSE {NUM('qty')} || ' g' END
        WHEN base = 'ml' THEN CASE WHEN qty >= 1000 THEN {NUM('qty / 1000')} || ' L' WHEN qty >= 100 AND qty % 10 = 0 THEN {NUM('qty / 10')} || ' cl' ELSE {NUM('qty')} || ' ml' END
        ELSE {NUM('qty')} || CASE WHEN qty > 1 THEN ' pièces' ELSE ' pièce' END END AS label,
        CASE WHEN unit = 'g' AND qty >= 1000 THEN {NUM('qty / 1000')} || ' kg' WHEN unit = 'ml' AND qty >= 1000 THEN {NUM('qty / 1000')} || ' L' WHEN unit = 'cl' AND qty >= 100 THEN {NUM('qty / 100')} || ' L'
        WHEN unit IN ('piece', 'cac', 'cas', 'verre', 'dl') AND (half OR round_) THEN CASE WHEN half AND w > 0 THEN CAST(w AS BIGINT) || ' ½' WHEN half THEN '½' ELSE CAST(CAST(w AS BIGINT) AS VARCHAR) END || ' ' || name
        ELSE {NUM('qty')} || ' ' || name END AS scaled FROM n""",
    "typical_units": f"WITH {TYPICAL_SQL} SELECT * FROM tu",
    "new_units": f"WITH {TYPICAL_SQL} SELECT ingredient, unit, qty FROM tu WHERE unit IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = ingredient AND p_size < 10 AND unit = 'morceau')",
    "member_profiles": f"""WITH {MEMBERS} SELECT member, CAST(months AS BIGINT) AS months, CASE WHEN months < 24 THEN months || ' mois' ELSE years || ' ans' END AS label,
      CASE WHEN birth IS NULL THEN CASE WHEN stored <= 0.3 THEN 'toddler' WHEN stored < 0.8 THEN 'child' ELSE 'adult' END WHEN years < 3 THEN 'toddler' WHEN years < 15 THEN 'child' ELSE 'adult' END AS category, tenths FROM mt""",
    "household_portions": f"WITH {MEMBERS} SELECT household, CAST(sum(tenths) AS BIGINT) AS tenths, CAST(sum(CASE WHEN member % 10 <> 4 THEN tenths ELSE 0 END) AS BIGINT) AS saturday, count(*) FILTER (member % 10 = 4) AS absent FROM mt GROUP BY 1",
    "serving_factor": """WITH o AS (SELECT o_orderkey AS recipe, o_custkey AS c, CAST(round(o_totalprice) AS BIGINT) AS t, (o_orderkey % 6 + 1)::DOUBLE AS base FROM orders),
      w AS (SELECT *, CASE WHEN recipe % 5 > 0 THEN (t % 900)::DOUBLE / 4 END AS wanted, CASE WHEN recipe % 7 = 0 AND recipe % 900 > 0 THEN least(greatest(round(recipe % 900 / 4::DOUBLE * 2) / 2, 0.5), 50) END AS hand,
        round(CASE WHEN c % 4 > 0 THEN least(c % 25, 20) + least(t % 23, 20) * 0.6::DOUBLE ELSE 0 END, 2) AS counted FROM o),
      e AS (SELECT *, CASE WHEN wanted > 0 THEN least(wanted, base * 20) ELSE base END AS total, CASE WHEN coalesce(hand, counted) > 0 THEN coalesce(hand, counted) ELSE base END * greatest(1, least(c % 6, 4)) AS parts FROM w)
      SELECT recipe, recipe % 3 = 0 AS batch, round(CASE WHEN recipe % 3 = 0 THEN total / base ELSE parts / base END, 4) AS factor, round(CASE WHEN recipe % 3 = 0 THEN total ELSE parts END, 2) AS total FROM e""",
    "batch_choices": "SELECT p_partkey AS recipe, t::DOUBLE AS times, p_size * t::DOUBLE AS qty FROM part, (VALUES (0.5), (1), (2), (3)) v(t) WHERE t >= 1 OR p_partkey % 2 = 0 OR p_size % 2 = 0",
    "cost_per_yield": f"""WITH {LINES}, g AS (SELECT receipt AS recipe, CAST(sum(paid) AS BIGINT) AS cents, bool_and(qty > 1) AS complete FROM li GROUP BY 1),
      e AS (SELECT *, CAST(CASE WHEN recipe % 4 = 0 THEN round(cents * 100 / ((recipe % 9 + 1) * 250)::DOUBLE) ELSE round(cents / (recipe % 6 + 1)::DOUBLE) END AS BIGINT) AS each FROM g)
      SELECT recipe, each, recipe % 4 <> 0 AND complete AND each <= 1500000 AS cheap FROM e""",
    "storage_places": "SELECT CASE WHEN p_type = 'PROMO' THEN 'freezer' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'fridge' ELSE 'cupboard' END AS place, p_type, count(*) AS ingredients FROM part GROUP BY 1, 2",
    "learned_units": """SELECT p_partkey AS ingredient, CASE WHEN p_partkey % 4 = 0 THEN p_size * 3::DOUBLE END AS own_unit, CASE WHEN p_partkey % 4 = 1 THEN p_size * 3::DOUBLE END AS piece_weight,
      CASE p_partkey % 4 WHEN 2 THEN round(p_size * 3::DOUBLE / 15, 4) WHEN 3 THEN round(p_size * 3::DOUBLE / 200, 4) END AS density FROM part""",
    "unit_payload": """WITH n AS (SELECT p_type, p_brand, min(p_name) AS name FROM part GROUP BY 1, 2),
      j AS (SELECT p_type, '{' || string_agg('"' || p_brand || '":"' || name || '"', ',' ORDER BY p_brand) || '}' AS payload FROM n GROUP BY 1)
      SELECT p_type, payload, valid FROM j JOIN (SELECT p_type, count(*) FILTER (p_partkey % 2 = 0) AS valid FROM part GROUP BY 1) v USING (p_type)""",
    "stock_labels": f"""WITH {LINES}, s AS (SELECT DISTINCT receipt, line, pack, day, qty * 60 AS q, CAST(day - DATE '1998-06-01' AS INTEGER) AS n FROM li WHERE day BETWEEN DATE '1998-05-28' AND DATE '1998-06-10')
      SELECT receipt, line, pack, CASE WHEN n < 0 THEN 'expired' WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n <= 3 THEN n || ' days' ELSE strftime(day, '%d/%m/%Y') END AS label,
        CASE WHEN q >= 1000 THEN q / 1000::DOUBLE ELSE q::DOUBLE END AS value, CASE WHEN q >= 1000 THEN 'kg' ELSE 'g' END AS unit FROM s""",
}
