"""What changes tables: loads, merges, replacements and removals, each as the table that results.

A table is written anew from what these give, in a folder of its own, and takes the place of the old one; no row is changed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators.filters import MEALS, meals
from larder.sources.tables import table


def upserted(old: DataFrame, new: DataFrame, keys: list[str], merged: dict[str, Column]) -> DataFrame:
    """old with the rows of new merged in: of a key in both, `merged` says what its other columns become, by o.x and n.x. Each side has a key once."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[c.alias(k) for k, c in merged.items()])


def replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in new give way to new's."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def without(rows: DataFrame, scope: DataFrame, *keys: str) -> DataFrame:
    return rows.join(scope, list(keys), "left_anti")


def learned_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that receipts taught: known ones count one more hit for each new sight, new ones begin with theirs."""
    part = table(spark, d, "part").select(F.lower("p_name").alias("label"), "p_partkey", "p_size")
    old = part.where("p_size < 20").groupBy("label").agg(F.count(F.lit(1)).alias("hits"), F.min("p_partkey").alias("pack"))
    new = part.where("p_size >= 40").groupBy("label").agg(F.count(F.lit(1)).alias("hits"), F.max("p_partkey").alias("pack"))
    return upserted(old, new, ["label"], {"hits": F.coalesce("o.hits", F.lit(0)) + F.coalesce("n.hits", F.lit(0)), "pack": F.coalesce("n.pack", "o.pack")})


def seeded(spark: SparkSession, d: str) -> DataFrame:
    """Tuples of (name, sizes, prices) as ingredients, packs and prices; a slug that is there already is skipped, never overwritten."""
    rows = [("Red Bolt", [1, 6], [120, 650]), ("Crème de riz", [250, 500], [89, 160]), ("Huile d'olive", [750], [799]), ("Thé vert", [20, 100], [210, 890])]
    new = spark.createDataFrame(rows, "name string, sizes array<long>, prices array<long>").withColumn("slug", text.slug(F.col("name")))
    there = table(spark, d, "part").select(text.slug(F.col("p_name")).alias("slug")).distinct()
    packs = without(new, there, "slug").select("slug", F.posexplode(F.arrays_zip("sizes", "prices")).alias("position", "p"))
    return packs.select("slug", (F.col("position") + 1).cast("long").alias("position"), F.col("p.sizes").alias("qty"), F.col("p.prices").alias("cents"))


def checked_recipes(lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Lines of seed recipes (recipe, ingredient, qty, unit) with their ingredient; a run stops at one that names no ingredient or has a unit that can't be converted."""
    both = lines.join(ingredients, "ingredient", "left")
    wrong = F.col("base").isNull() | ((F.col("unit") != F.col("base")) & ~(F.col("unit").isin("kg", "g") & (F.col("base") == "g")))
    return both.withColumn("qty", F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("bad line of"), "recipe", "ingredient")).cast("double")).otherwise(F.col("qty") * F.when((F.col("unit") == "kg") & (F.col("base") == "g"), 1000.0).otherwise(1.0)))


def seeded_recipes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").groupBy(F.col("p_name").alias("ingredient")).agg(F.lit("g").alias("base"))
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("recipe"), F.col("p_name").alias("ingredient"), F.lit(2.5).alias("qty"), F.when(F.col("p_partkey") % 2 == 0, "kg").otherwise("g").alias("unit"))
    return checked_recipes(lines, part).select("recipe", "ingredient", "qty")


def synced(spark: SparkSession, d: str) -> DataFrame:
    """Documents to read: those without a receipt, and those changed since, whose receipt is still under review."""
    docs = table(spark, d, "orders").where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("doc"), F.col("o_orderdate").cast("date").alias("modified"))
    have = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc"), F.date_sub(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 3).cast("int")).alias("seen"), (F.col("o_orderstatus") == "O").alias("review"))
    both = docs.join(have, "doc", "left")
    return both.where("seen IS NULL OR (review AND modified > seen)").select("doc", F.when(F.col("seen").isNull(), "new").otherwise("changed").alias("why"))


def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    return synced(spark, d).groupBy("why").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" read")).alias("line"))


def replaced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Recipes that are saved again have their lines replaced, here each eleventh by one line."""
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_linenumber").cast("long").alias("line"))
    new = table(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("recipe"), F.lit(100).cast("long").alias("line"))
    return replaced(old, new, "recipe").groupBy("recipe").agg(F.count(F.lit(1)).alias("lines"), F.max("line").alias("last"))


def reset_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a reset of some households would remove, by table, and what would stay: nothing is removed to know."""
    gone = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("household"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("household"))
    own = [(name, rows) for name, rows in (("orders", orders), ("meals", meals(spark, d).select("household")))]
    out = [rows.join(gone.withColumn("gone", F.lit(True)), "household", "left").agg(F.lit(name).alias("table"), F.count_if(F.col("gone").isNotNull()).alias("removed"), F.count_if(F.col("gone").isNull()).alias("kept")) for name, rows in own]
    return out[0].unionByName(out[1])


def wiped_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stay when the recipes of status P are wiped with all that hangs on them."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return without(table(spark, d, "lineitem"), gone, "l_orderkey").groupBy(F.col("l_orderkey").alias("recipe")).agg(F.count(F.lit(1)).alias("lines"))


def rebuilt_list(spark: SparkSession, d: str) -> DataFrame:
    """A list built anew: needs give the quantities; what was ticked or locked stays so; rows typed by hand stay; what is needed no longer goes."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ingredient"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("qty"))
    old = li.where("n = 1").groupBy("ingredient").agg(F.sum("qty").alias("qty"), F.bool_or(F.col("qty") > 45).alias("ticked"), (F.col("ingredient") % 13 == 0).alias("by_hand"))
    new = li.where("n = 2").groupBy("ingredient").agg(F.sum("qty").alias("qty"))
    out = upserted(old, new, ["ingredient"], {"qty": F.when(F.col("n.qty").isNotNull(), F.col("n.qty")).when(F.col("o.by_hand"), F.col("o.qty")), "ticked": F.coalesce("o.ticked", F.lit(False)), "by_hand": F.coalesce("o.by_hand", F.lit(False))})
    return out.where("qty IS NOT NULL")


def toggled_favourites(spark: SparkSession, d: str) -> DataFrame:
    """Favourites after some were toggled: those in just one of the two."""
    old = meals(spark, d).where("slot = 'view'").select("household", F.col("day").alias("recipe")).distinct()
    new = meals(spark, d).where("slot = 'click'").select("household", F.col("day").alias("recipe")).distinct()
    return old.unionByName(new).groupBy("household", "recipe").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("household", "recipe")


def copied_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Drafts made of all recipes, their lines copied, with the parent they come from."""
    all_recipes = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent"))
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber", "l_partkey")
    return own.join(all_recipes, "parent").groupBy((F.col("parent") + 10_000_000).alias("recipe"), "parent").agg(F.count(F.lit(1)).alias("lines"), F.lit("draft").alias("status"))


def week_after(spark: SparkSession, d: str) -> DataFrame:
    """A household's meals after its proposals (signups) were cleared, its accepted ones (clicks over 90) kept, its leftovers of cleared dishes gone with them, and one day's meals moved to the next."""
    m = meals(spark, d)
    cleared = m.where("slot = 'signup'").select("household", "day").distinct()
    kept = m.where("slot <> 'signup'")
    kept = kept.where("slot <> 'error'").unionByName(without(kept.where("slot = 'error'"), cleared, "household", "day"))
    day = F.when(F.dayofmonth("day") == 10, F.date_add("day", 1)).otherwise(F.col("day"))
    return kept.select("household", day.alias("day"), F.when((F.col("slot") == "click") & (F.col("value") > 90), "accepted").otherwise(F.col("slot")).alias("state")).groupBy("household", "day", "state").agg(F.count(F.lit(1)).alias("n"))


def tags_after(spark: SparkSession, d: str) -> DataFrame:
    """Tags found by slug, then by lower name, else made; built-in ones can't be removed."""
    have = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), text.slug(F.col("n_name")).alias("slug"))
    asked = spark.createDataFrame([("Nation_3",), ("nation 4",), ("Neuf été",)], "typed string").withColumn("slug", text.slug(F.col("typed")))
    by_slug = asked.join(have.select("slug", F.col("id").alias("a")), "slug", "left").join(have.select(F.lower("name").alias("low"), F.col("id").alias("b")), F.lower("typed") == F.col("low"), "left")
    return by_slug.select("typed", F.coalesce("a", "b").alias("id"), F.when(F.col("a").isNull() & F.col("b").isNull(), F.col("slug")).alias("made"))


def discarded_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports to discard: not published, one's own, and on no plan; and whether the rest need review."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("import"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("status"))
    planned = meals(spark, d).where("slot = 'purchase'").select(F.col("household").alias("author")).distinct()
    gone = without(o.where("status <> 'F' AND author % 2 = 1"), planned, "author").select("import", F.lit(True).alias("gone"))
    return o.join(gone, "import", "left").groupBy(F.coalesce("gone", F.lit(False)).alias("gone"), (F.col("status") == "O").alias("review")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (learned_labels, seeded, seeded_recipes, synced, sync_summary, replaced_lines, reset_counts, wiped_recipes, rebuilt_list, toggled_favourites, copied_recipes, week_after, tags_after, discarded_imports)}
SLUG = "regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')"
SYNC = """sy AS (SELECT a.o_orderkey AS doc, CASE WHEN b.o_orderkey IS NULL THEN 'new' ELSE 'changed' END AS why FROM orders a LEFT JOIN orders b ON a.o_orderkey = b.o_orderkey AND b.o_orderkey % 2 = 0
  WHERE a.o_custkey % 3 > 0 AND (b.o_orderkey IS NULL OR (b.o_orderstatus = 'O' AND b.o_orderkey % 3 > 0)))"""
SQL = {
    "learned_labels": """WITH o AS (SELECT lower(p_name) AS label, count(*) AS hits, min(p_partkey) AS pack FROM part WHERE p_size < 20 GROUP BY 1), n AS (SELECT lower(p_name) AS label, count(*) AS hits, max(p_partkey) AS pack FROM part WHERE p_size >= 40 GROUP BY 1)
      SELECT label, coalesce(o.hits, 0) + coalesce(n.hits, 0) AS hits, coalesce(n.pack, o.pack) AS pack FROM o FULL JOIN n USING (label)""",
    "seeded": f"""SELECT * FROM (VALUES ('red-bolt', 1::BIGINT, 1::BIGINT, 120::BIGINT), ('red-bolt', 2, 6, 650), ('creme-de-riz', 1, 250, 89), ('creme-de-riz', 2, 500, 160), ('huile-dolive', 1, 750, 799), ('the-vert', 1, 20, 210), ('the-vert', 2, 100, 890)) t(slug, position, qty, cents)
      WHERE slug NOT IN (SELECT {SLUG} FROM part)""",
    "seeded_recipes": "SELECT p_partkey AS recipe, p_name AS ingredient, CASE WHEN p_partkey % 2 = 0 THEN 2500 ELSE 2.5 END::DOUBLE AS qty FROM part",
    "synced": f"WITH {SYNC} SELECT * FROM sy",
    "sync_summary": f"WITH {SYNC} SELECT why, count(*) || ' read' AS line FROM sy GROUP BY 1",
    "replaced_lines": "WITH a AS (SELECT l_orderkey AS recipe, l_linenumber::BIGINT AS line FROM lineitem WHERE l_orderkey % 11 > 0 UNION ALL SELECT o_orderkey, 100 FROM orders WHERE o_orderkey % 11 = 0) SELECT recipe, count(*) AS lines, max(line) AS last FROM a GROUP BY 1",
    "reset_counts": """WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey < 5)
      SELECT 'orders' AS "table", count(*) FILTER (o_custkey IN (SELECT * FROM g)) AS removed, count(*) FILTER (o_custkey NOT IN (SELECT * FROM g)) AS kept FROM orders
      UNION ALL SELECT 'meals', count(*) FILTER (user_id IN (SELECT * FROM g)), count(*) FILTER (user_id NOT IN (SELECT * FROM g)) FROM events""",
    "wiped_recipes": "SELECT l_orderkey AS recipe, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "rebuilt_list": """WITH o AS (SELECT l_partkey AS ingredient, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, bool_or(l_quantity > 45) AS ticked FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
      n AS (SELECT l_partkey AS ingredient, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem WHERE l_linenumber = 2 GROUP BY 1),
      j AS (SELECT ingredient, CASE WHEN n.qty IS NOT NULL THEN n.qty WHEN ingredient % 13 = 0 THEN o.qty END AS qty, coalesce(ticked, false) AS ticked, CASE WHEN o.ingredient IS NULL THEN false ELSE ingredient % 13 = 0 END AS by_hand FROM o FULL JOIN n USING (ingredient)) SELECT * FROM j WHERE qty IS NOT NULL""",
    "toggled_favourites": f"WITH {MEALS}, u AS (SELECT DISTINCT household, day AS recipe, slot FROM me WHERE slot IN ('view', 'click')) SELECT household, recipe FROM u GROUP BY 1, 2 HAVING count(*) = 1",
    "copied_recipes": "SELECT l_orderkey + 10000000 AS recipe, l_orderkey AS parent, count(*) AS lines, 'draft' AS status FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2",
    "week_after": f"""WITH {MEALS}, c AS (SELECT DISTINCT household, day FROM me WHERE slot = 'signup'), k AS (SELECT * FROM me WHERE slot NOT IN ('signup', 'error') UNION ALL SELECT me.* FROM me WHERE slot = 'error' AND NOT EXISTS (SELECT 1 FROM c WHERE c.household = me.household AND c.day = me.day))
      SELECT household, CAST(CASE WHEN day(day) = 10 THEN day + 1 ELSE day END AS DATE) AS day, CASE WHEN slot = 'click' AND value > 90 THEN 'accepted' ELSE slot END AS state, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "tags_after": "SELECT * FROM (VALUES ('Nation_3', 3::BIGINT, NULL), ('nation 4', 4, NULL), ('Neuf été', NULL, 'neuf-ete')) t(typed, id, made)",
    "discarded_imports": """WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
      SELECT o_orderstatus <> 'F' AND o_custkey % 2 = 1 AND o_custkey NOT IN (SELECT user_id FROM p) AS gone, o_orderstatus = 'O' AS review, count(*) AS n FROM orders GROUP BY 1, 2""",
}
