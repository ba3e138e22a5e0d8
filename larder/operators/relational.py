"""Filters, joins, groups and scalar functions of the household's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions import text, units
from larder.sources.tables import LINES, lines, table

TODAY = "2026-10-07"


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def store_aisle_totals(spark: SparkSession, d: str) -> DataFrame:
    """Paid by store and aisle, with the subtotal of each store."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("pack"), F.col("p_type").alias("aisle"))
    rows = lines(spark, d).join(part, "pack")
    return rows.groupingSets([["store", "aisle"], ["store"]], "store", "aisle").agg(F.sum("paid").alias("paid"), F.grouping("aisle").cast("int").alias("subtotal"))


def menu_use_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (day, slot) of each household's planned meals."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("household")).agg(F.countDistinct(F.col("ts").cast("date"), "event_type").alias("meals"))


def recipes_with_ingredient(spark: SparkSession, d: str) -> DataFrame:
    """Recipes that use a pack of size 1: a semi join."""
    small = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("pack"))
    has = lines(spark, d).join(small, "pack", "left_semi").select("receipt")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("receipt"), F.col("o_orderstatus").alias("status")).join(has, "receipt", "left_semi")


def empty_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists (orders) without item, receipt and stock: three anti joins, on large lines, on returned ones and on planned meals of the household."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("list"), F.col("o_custkey").alias("household"))
    li = lines(spark, d).withColumnRenamed("receipt", "list")
    e = table(spark, d, "events").select(F.col("user_id").alias("household"))
    return o.join(li.where("qty > 25"), "list", "left_anti").join(li.where("flag = 'R'"), "list", "left_anti").join(e, "household", "left_anti").select("list")


def equipment_covered(spark: SparkSession, d: str) -> DataFrame:
    """Recipes all of whose stores are owned (those of even number with a positive balance): what is missing is found first, then the recipes without any."""
    owned = table(spark, d, "supplier").where("s_suppkey % 2 = 0 AND s_acctbal > 0").select(F.col("s_suppkey").alias("store"))
    needed = lines(spark, d).select("receipt", "store").distinct()
    missing = needed.join(owned, "store", "left_anti").select("receipt").distinct()
    return needed.select("receipt").distinct().join(missing, "receipt", "left_anti")


def meal_grid(spark: SparkSession, d: str) -> DataFrame:
    """Seven days by four slots for each nation's household, with the members that eat."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("household"))
    grid = n.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("slot", F.explode(F.array(*map(F.lit, ("breakfast", "lunch", "snack", "dinner")))))
    members = F.sequence(F.lit(1), (F.col("household") % 4 + 1).cast("int"))
    absent = F.when(F.col("day") > 5, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return grid.select("household", "day", "slot", F.size(F.array_except(members, absent)).cast("long").alias("eaters"))


def list_link(spark: SparkSession, d: str) -> DataFrame:
    """Each receipt's list of the same household: from a day before it to four days after its start, the nearest first, then the newest."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("household"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"))
    lists = o.where("status = 'O'").select("household", F.col("id").alias("list"), F.col("day").alias("start"), F.date_add("day", 6).alias("stop"))
    both = o.where("status = 'F'").join(lists, "household").where((F.col("start") <= F.date_add("day", 4)) & (F.col("stop") >= F.date_sub("day", 1)))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.abs(F.datediff("start", "day")), F.desc("list")))
    return both.withColumn("rank", rank).where("rank = 1").select(F.col("id").alias("receipt"), "household", "list", F.datediff("start", "day").alias("gap"))


def paid_vs_estimated(spark: SparkSession, d: str) -> DataFrame:
    """Of each receipt what was paid for lines on the list (flag A or R) and off it (N)."""
    on = F.col("flag") != "N"
    return lines(spark, d).groupBy("receipt").agg(
        F.coalesce(F.sum(F.when(on, F.col("paid"))), F.lit(0)).alias("listed"), F.coalesce(F.sum(F.when(~on, F.col("paid"))), F.lit(0)).alias("extra"),
        F.count_if(on).alias("n_listed"), F.count_if(~on).alias("n_extra"), F.sum("paid").alias("paid"),
    )


def cook_from_stock(spark: SparkSession, d: str, k: int = 24) -> DataFrame:
    """The 24 recipes of which most is in stock: at least a quarter of their lines."""
    own = lines(spark, d).groupBy("receipt").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("flag") == "R").alias("covered"), F.sum(F.when(F.col("flag") != "R", F.col("paid")).otherwise(0)).alias("missing_cents"))
    own = own.where("covered > 0 AND covered * 4 >= total").withColumn("ratio", F.round(F.col("covered") * 100 / F.col("total")).cast("long"))
    return own.orderBy(F.desc("ratio"), "missing_cents", "receipt").limit(k)


def receipts_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 30: open ones first, then the newest."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("receipt"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("day"))
    return o.orderBy(F.when(F.col("status") == "O", 0).otherwise(1), F.desc("day"), F.desc("receipt")).offset(30).limit(30)


def unit_to_base(spark: SparkSession, d: str) -> DataFrame:
    """Three of each unit in each ingredient's base unit; null where data is missing."""
    unit = spark.createDataFrame(units.UNITS, "unit string, dimension string, factor double")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("pack"), F.element_at(F.array(*map(F.lit, ("g", "ml", "piece"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("base"), F.when(F.col("p_size") > 5, F.col("p_size") / 8).alias("density"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") * 4.0).alias("piece_g"))
    both = part.join(F.broadcast(unit))  # eleven rows, fixed
    return both.select("pack", "unit", units.to_base(F.lit(3.0), F.col("dimension"), F.col("factor"), F.col("base"), F.col("density"), F.col("piece_g")).alias("qty"))


def practical_round(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_quantity") * F.col("l_linenumber") / 8).alias("qty"), F.element_at(F.array(*map(F.lit, [u[0] for u in units.UNITS])), (F.col("l_partkey") % 11 + 1).cast("int")).alias("unit"))
    return li.distinct().select("qty", "unit", units.practical(F.col("qty"), F.col("unit")).alias("practical"))


def member_ages(spark: SparkSession, d: str) -> DataFrame:
    birth = F.date_sub(F.lit(TODAY).cast("date"), (F.col("c_custkey") * 37 % 9000).cast("int"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("member"), birth.alias("birth"))
    years = units.age(F.col("birth"), F.lit(TODAY).cast("date"))
    return c.select("member", "birth", years.alias("years"), (units.coefficient(years) * 10).cast("long").alias("tenths"))


def week_start(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("monday")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.weekday("o_orderdate")).alias("weekdays"))


def search_folded(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose folded text holds a folded word."""
    return table(spark, d, "documents").where(F.contains(text.fold(F.col("text")), F.lit("etion"))).select("doc_id", "source")


def label_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the names of parts and how many parts have each."""
    return table(spark, d, "part").select(F.explode(F.array_distinct(text.tokens(F.col("p_name")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def carried_header(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a conversation under the last user turn before it."""
    order = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order).alias("header"))


def slot_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """What stands before and after each planned meal of a household."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(order).alias("before"), F.lead("event_type").over(order).alias("after"))


U = ", ".join(f"('{u}', '{dim}', {f}::DOUBLE)" for u, dim, f in units.UNITS)
QUERIES = {f.__name__: f for f in (status_counts, store_aisle_totals, menu_use_counts, recipes_with_ingredient, empty_lists, equipment_covered, meal_grid, list_link, paid_vs_estimated, cook_from_stock, receipts_page, unit_to_base, practical_round, member_ages, week_start, search_folded, label_tokens, carried_header, slot_neighbours)}
SQL = {
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "store_aisle_totals": f"WITH {LINES} SELECT store, p_type AS aisle, CAST(sum(paid) AS BIGINT) AS paid, CAST(grouping(p_type) AS INTEGER) AS subtotal FROM li JOIN part ON p_partkey = pack GROUP BY GROUPING SETS ((store, p_type), (store))",
    "menu_use_counts": "SELECT user_id AS household, count(DISTINCT (CAST(ts AS DATE), event_type)) AS meals FROM events GROUP BY 1",
    "recipes_with_ingredient": "SELECT o_orderkey AS receipt, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1)",
    "empty_lists": f"WITH {LINES} SELECT o_orderkey AS list FROM orders WHERE NOT EXISTS (SELECT 1 FROM li WHERE receipt = o_orderkey AND qty > 25) AND NOT EXISTS (SELECT 1 FROM li WHERE receipt = o_orderkey AND flag = 'R') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)",
    "equipment_covered": f"WITH {LINES} SELECT receipt FROM li LEFT JOIN supplier ON s_suppkey = store AND s_suppkey % 2 = 0 AND s_acctbal > 0 GROUP BY receipt HAVING count(*) FILTER (s_suppkey IS NULL) = 0",
    "meal_grid": """SELECT n_nationkey::BIGINT AS household, CAST(day AS INTEGER) AS day, slot, CAST(n_nationkey % 4 + 1 - CASE WHEN day > 5 THEN 1 ELSE 0 END AS BIGINT) AS eaters
      FROM nation, range(1, 8) t(day), (VALUES ('breakfast'), ('lunch'), ('snack'), ('dinner')) s(slot)""",
    "list_link": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS household, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders),
      j AS (SELECT r.id AS receipt, r.household, l.id AS list, CAST(l.day - r.day AS INTEGER) AS gap FROM o r JOIN o l ON r.household = l.household AND r.status = 'F' AND l.status = 'O' AND l.day <= r.day + 4 AND l.day + 6 >= r.day - 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY receipt ORDER BY abs(gap), list DESC) AS rn FROM j)
      SELECT receipt, household, list, gap FROM k WHERE rn = 1""",
    "paid_vs_estimated": f"""WITH {LINES} SELECT receipt, CAST(coalesce(sum(paid) FILTER (flag <> 'N'), 0) AS BIGINT) AS listed, CAST(coalesce(sum(paid) FILTER (flag = 'N'), 0) AS BIGINT) AS extra,
      count(*) FILTER (flag <> 'N') AS n_listed, count(*) FILTER (flag = 'N') AS n_extra, CAST(sum(paid) AS BIGINT) AS paid FROM li GROUP BY receipt""",
    "cook_from_stock": f"""WITH {LINES}, g AS (SELECT receipt, count(*) AS total, count(*) FILTER (flag = 'R') AS covered, CAST(sum(CASE WHEN flag <> 'R' THEN paid ELSE 0 END) AS BIGINT) AS missing_cents FROM li GROUP BY receipt)
      SELECT *, CAST(round(covered * 100 / total::DOUBLE) AS BIGINT) AS ratio FROM g WHERE covered > 0 AND covered * 4 >= total ORDER BY ratio DESC, missing_cents, receipt LIMIT 24""",
    "receipts_page": "SELECT o_orderkey AS receipt, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, day DESC, receipt DESC LIMIT 30 OFFSET 30",
    "unit_to_base": f"""WITH u(unit, dim, f) AS (VALUES {U}),
      p AS (SELECT p_partkey AS pack, CASE p_partkey % 3 WHEN 0 THEN 'mass' WHEN 1 THEN 'volume' ELSE 'piece' END AS target, CASE WHEN p_size > 5 THEN p_size / 8::DOUBLE END AS density, CASE WHEN p_size % 4 > 0 THEN p_size * 4::DOUBLE END AS piece_g FROM part),
      g AS (SELECT *, 3::DOUBLE * f AS value, CASE dim WHEN 'mass' THEN 3::DOUBLE * f WHEN 'volume' THEN 3::DOUBLE * f * density ELSE 3::DOUBLE * f * piece_g END AS grams FROM p, u)
      SELECT pack, unit, CASE WHEN dim = target THEN value WHEN target = 'mass' THEN grams WHEN target = 'volume' THEN grams / density ELSE grams / piece_g END AS qty FROM g""",
    "practical_round": """WITH l AS (SELECT DISTINCT l_quantity * l_linenumber / 8::DOUBLE AS qty, ['g','kg','pincee','ml','cl','dl','l','cac','cas','verre','piece'][l_partkey % 11 + 1] AS unit FROM lineitem),
      s AS (SELECT *, CAST(CASE WHEN unit = 'piece' THEN CASE WHEN qty < 1 THEN 0.5 ELSE 1 END WHEN unit IN ('g', 'ml') THEN CASE WHEN qty < 20 THEN 1 WHEN qty < 500 THEN 5 WHEN qty < 1000 THEN 10 ELSE 50 END
        WHEN unit IN ('kg', 'l') THEN CASE WHEN qty < 1 THEN 0.05 ELSE 0.1 END WHEN unit = 'cl' THEN CASE WHEN qty < 10 THEN 0.5 ELSE 1 END WHEN unit = 'pincee' THEN 1 ELSE 0.5 END AS DOUBLE) AS step FROM l)
      SELECT qty, unit, CASE WHEN qty <= 0 THEN 0 ELSE greatest(round(round(qty / step) * step, 2), step) END AS practical FROM s""",
    "member_ages": f"""WITH c AS (SELECT c_custkey AS member, CAST(DATE '{TODAY}' - CAST(c_custkey * 37 % 9000 AS INTEGER) AS DATE) AS birth FROM customer),
      a AS (SELECT *, CAST(date_part('year', age(DATE '{TODAY}', birth)) AS INTEGER) AS years FROM c)
      SELECT *, CAST(CASE WHEN years < 1 THEN 0 WHEN years < 3 THEN 3 WHEN years < 5 THEN 5 WHEN years < 12 THEN 7 WHEN years < 15 THEN 8 ELSE 10 END AS BIGINT) AS tenths FROM a""",
    "week_start": "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, count(*) AS n, count(DISTINCT isodow(o_orderdate)) AS weekdays FROM orders GROUP BY 1",
    "search_folded": f"SELECT doc_id, source FROM documents WHERE contains({text.fold_sql('text')}, 'etion')",
    "label_tokens": f"""WITH t AS (SELECT p_partkey, unnest(string_split(regexp_replace({text.fold_sql('p_name')}, '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM part),
      c AS (SELECT DISTINCT p_partkey, CASE WHEN length(w) > 3 AND regexp_matches(w, '[sx]$') THEN left(w, length(w) - 1) ELSE w END AS token FROM t WHERE w <> '' AND w NOT IN ('de','du','des','la','le','les','the','of','a'))
      SELECT token, count(*) AS n FROM c GROUP BY token""",
    "carried_header": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations",
    "slot_neighbours": "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}
