"""Predicates, joins, groups, orders and set operations of the household's pages, one query each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions import text
from larder.operators.prices import NOW, current_price
from larder.sources.tables import LINES, lines, table

ME = 7
DAY = "1998-06-01"
SLOTS = ("view", "click", "signup", "purchase", "error")  # the day's order of meals
NOON = ("click", "purchase")


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Only the filters whose value is given."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def recipes(spark: SparkSession, d: str) -> DataFrame:
    """An order as a recipe: author, status, minutes (some unknown), day."""
    o = table(spark, d, "orders")
    minutes = lambda k, n: F.when(F.col("o_orderkey") % k > 0, (F.col("o_orderkey") * k) % n).cast("int")
    return o.select(F.col("o_orderkey").alias("recipe"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("status"), minutes(5, 40).alias("prep"), minutes(7, 30).alias("cook"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"))


RECIPES = """re AS (SELECT o_orderkey AS recipe, o_custkey AS author, o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey * 5) % 40 END AS prep,
  CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey * 7) % 30 END AS cook, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority FROM orders)"""


def meals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("meal"), F.col("user_id").alias("household"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("slot"), "value")


MEALS = "me AS (SELECT event_id AS meal, user_id AS household, CAST(ts AS DATE) AS day, event_type AS slot, value FROM events)"


def visible(me: Column) -> Column:
    return (F.col("status") == "F") | (F.col("author") == me)


def visible_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Published recipes and one's own; one's own may be edited."""
    return recipes(spark, d).where(visible(F.lit(ME))).select("recipe", "status", (F.col("author") == ME).alias("can_edit"))


def chosen_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Filters that count only if given: by status, not by priority."""
    return filtered(recipes(spark, d), status="P", priority=None).select("recipe", "priority")


def named_ingredient(spark: SparkSession, d: str) -> DataFrame:
    """Equal but for case, or equal as a slug."""
    name = F.col("p_name")
    return table(spark, d, "part").where((F.lower(name) == "red bolt") | (text.slug(name) == "blue-gear")).select(F.col("p_partkey").alias("ingredient"), text.slug(name).alias("slug"))


def quick_recipes(spark: SparkSession, d: str) -> DataFrame:
    minutes = F.coalesce("prep", F.lit(0)) + F.coalesce("cook", F.lit(0))
    return recipes(spark, d).where((minutes > 0) & (minutes <= 30)).select("recipe", minutes.cast("long").alias("minutes"))


def in_season(spark: SparkSession, d: str, month: int = 6) -> DataFrame:
    """Null without a seasonal ingredient, else whether all of these have the month."""
    size = F.col("p_size").cast("int")
    months = F.when(size % 4 > 0, F.transform(F.sequence(size, size + 6), lambda m: m % 12 + 1))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("pack"), months.alias("months"))
    own = lines(spark, d).join(part, "pack")
    return own.groupBy(F.col("receipt").alias("recipe")).agg(F.bool_and(F.when(F.col("months").isNotNull(), F.array_contains("months", month))).alias("in_season"))


def list_status(spark: SparkSession, d: str) -> DataFrame:
    """What a list is, from its state and its days (seven, both ends counted)."""
    stop = F.date_add("day", 6)
    status = F.when(F.col("status") == "F", "archived").when(stop < F.lit(DAY).cast("date"), "past").when(F.col("day") > F.lit(DAY).cast("date"), "to come").otherwise("current")
    return recipes(spark, d).select(F.col("recipe").alias("list"), status.alias("state"), (F.datediff(stop, F.col("day")) + 1).alias("days"))


def known(spark: SparkSession, d: str) -> DataFrame:
    """Receipt lines with what the matcher knows: status, VAT in percent, whether they are no food, what was paid less the discount."""
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_linenumber") == 7, "ignored").when(F.col("l_returnflag") == "N", "known").when(F.col("l_linenumber") % 5 == 0, "pending").otherwise("applied")
    vat = F.round(F.col("l_tax") * 250).cast("int")
    gross = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(
        F.col("l_orderkey").alias("receipt"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("pack"), status.alias("status"), vat.alias("vat"),
        ((F.col("l_linenumber") == 6) | (vat >= 19)).alias("non_food"), (gross - F.round(gross * F.col("l_discount")).cast("long")).alias("paid"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("long").alias("qty"),
    )


KNOWN = """kn AS (SELECT l_orderkey AS receipt, l_linenumber AS line, l_suppkey AS store, l_partkey AS pack,
  CASE WHEN l_linenumber = 7 THEN 'ignored' WHEN l_returnflag = 'N' THEN 'known' WHEN l_linenumber % 5 = 0 THEN 'pending' ELSE 'applied' END AS status, CAST(round(l_tax * 250) AS INTEGER) AS vat,
  l_linenumber = 6 OR CAST(round(l_tax * 250) AS INTEGER) >= 19 AS non_food,
  CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(CAST(round(l_extendedprice * 100) AS BIGINT) * l_discount) AS BIGINT) AS paid, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)"""


def non_food(spark: SparkSession, d: str) -> DataFrame:
    return known(spark, d).groupBy("receipt").agg(F.count_if("non_food").alias("n"), F.sum(F.when(F.col("non_food"), F.col("paid")).otherwise(0)).alias("paid"))


def fully_known(spark: SparkSession, d: str) -> DataFrame:
    """Receipts with a product, all of whose products are known, applied or ignored."""
    own = known(spark, d).groupBy("receipt").agg(F.count_if(F.col("status") != "ignored").alias("products"), F.bool_and(F.col("status") != "pending").alias("done"), F.sum("paid").alias("paid"))
    return own.where("done AND products > 0").select("receipt", "products", "paid")


def price_sheet(spark: SparkSession, d: str, store: int = 5) -> DataFrame:
    """Of each aisle the packs that the store has a price for; all packs of an aisle where it has none."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("pack"), F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")).alias("aisle"))
    own = part.join(current_price(spark, d).where(F.col("store") == store).select("pack", "cents"), "pack", "left")
    some = F.count("cents").over(W.partitionBy("aisle"))
    return own.withColumn("some", some).where("some = 0 OR cents IS NOT NULL").select("aisle", "pack", "cents")


def leftovers(spark: SparkSession, d: str) -> DataFrame:
    """An error is the rest of the household's last purchase of that day: joined to its source dish, with the meal's siblings."""
    m = meals(spark, d)
    rest = m.where("slot = 'error'")
    dish = m.where("slot = 'purchase'").select("household", "day", F.col("meal").alias("source"), F.col("value").alias("worth"))
    last = dish.groupBy("household", "day").agg(F.max_by(F.struct("source", "worth"), "source").alias("s")).select("household", "day", "s.*")
    siblings = m.groupBy("household", "day", "slot").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    return rest.join(last, ["household", "day"]).join(siblings, ["household", "day", "slot"]).select("meal", "source", "worth", "siblings")


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each nation, none counted as 0, and whether it has any."""
    s = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("n"), "s_suppkey")
    n = table(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.n, "left").groupBy(F.col("n_name").alias("tag")).agg(F.count("s_suppkey").alias("recipes"), (F.count("s_suppkey") > 0).alias("used"))


def last_cooked(spark: SparkSession, d: str) -> DataFrame:
    """The last day of each pack within 28 days before a day, and how long that is ago."""
    day = F.lit(DAY).cast("date")
    own = lines(spark, d).where((F.col("day") < day) & (F.col("day") >= F.date_sub(day, 28)))
    return own.groupBy("pack").agg(F.max("day").alias("last")).select("pack", "last", F.datediff(day, "last").alias("days"))


def next_position(spark: SparkSession, d: str) -> DataFrame:
    """Where the next line of an order goes: ten behind the last, ten without any."""
    last = lines(spark, d).groupBy("receipt").agg(F.max("line").alias("last"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("receipt"))
    return o.join(last, "receipt", "left").select("receipt", (F.coalesce(F.col("last"), F.lit(0)) + 10).cast("long").alias("position"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each pack in a receipt; of lines of one number the smallest store, then quantity."""
    first = F.min(F.struct("line", "store", "qty", "paid")).alias("x")
    return lines(spark, d).groupBy("receipt", "pack").agg(first).select("receipt", "pack", "x.line", "x.store", "x.qty")


def list_signature(spark: SparkSession, d: str) -> DataFrame:
    """40 hex characters of SHA-1 over a list's entries in order, and whether it is the one of its lines but the last."""
    own = lines(spark, d).select("receipt", F.concat_ws(":", F.lpad(F.col("line").cast("string"), 3, "0"), F.lpad(F.col("pack").cast("string"), 9, "0"), F.col("store").cast("string"), F.col("qty").cast("string"), F.col("paid").cast("string")).alias("x"))
    every = F.array_sort(F.collect_list("x"))
    sign = lambda a: F.sha1(F.array_join(a, ",").cast("binary"))
    return own.groupBy("receipt").agg(sign(every).alias("signature"), (sign(every) != sign(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(1))))).alias("stale"))


def week_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of a household's week: dishes alone, what is left of them costs nothing more."""
    week = F.date_trunc("week", "day").cast("date").alias("monday")
    cents = F.round(F.col("value") * 100).cast("long")
    return meals(spark, d).groupBy("household", week).agg(F.sum(F.when(F.col("slot") != "error", cents).otherwise(0)).alias("cents"), F.count_if(F.col("slot") != "error").alias("dishes"))


def cut_at_total(spark: SparkSession, d: str) -> DataFrame:
    """The last line up to which a receipt's lines add up to the total printed on it, here that of its first two."""
    order = W.partitionBy("receipt").orderBy("line", "pack", "store", "qty", "paid")
    own = lines(spark, d).withColumn("k", F.row_number().over(order)).withColumn("upto", F.sum("paid").over(order.rowsBetween(W.unboundedPreceding, 0)))
    total = F.max(F.when(F.col("k") == 2, F.col("upto"))).over(W.partitionBy("receipt"))
    return own.withColumn("total", total).where("upto = total").groupBy("receipt").agg(F.max("k").alias("lines"), F.max("total").alias("total"))


def free_slots(spark: SparkSession, d: str) -> DataFrame:
    """How many noon meals of the household's day are still open from each one on."""
    here = W.partitionBy("household", "day").orderBy("meal").rowsBetween(0, W.unboundedFollowing)
    return meals(spark, d).select("meal", F.count_if(F.col("slot").isin(*NOON)).over(here).alias("open"))


def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    """Discounts (returned lines) go to the product line before them in their receipt; those before any product go nowhere."""
    order = W.partitionBy("receipt").orderBy("line", "pack", "store", "qty", "paid")
    own = lines(spark, d).withColumn("k", F.row_number().over(order))
    own = own.withColumn("product", F.last(F.when(F.col("flag") != "R", F.col("k")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).where("product IS NOT NULL")
    return own.groupBy("receipt", "product").agg(F.sum(F.when(F.col("flag") != "R", F.col("paid")).otherwise(0)).alias("total"), F.sum(F.when(F.col("flag") == "R", F.col("paid")).otherwise(0)).alias("discount"), F.count_if(F.col("flag") == "R").alias("details"))


def repeated_block(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose roles begin with a block that follows itself: the shortest such block."""
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    n = F.floor(F.size("r") / 2).cast("int")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (2 * k <= F.size("r")) & (F.slice("r", 1, k) == F.slice("r", k + 1, k)))
    return roles.select("conv_id", F.array_min(ends).alias("block")).where("block IS NOT NULL")


def folded_order(spark: SparkSession, d: str) -> DataFrame:
    """Names in order without case and accents, ids decide between equals."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("recipe"), F.concat(F.element_at(F.array(*map(F.lit, ("Œuf ", "éclair ", "Ananas ", "zeste "))), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_mktsegment")).alias("title"))
    return own.select("recipe", text.fold(F.col("title")).alias("folded"), F.row_number().over(W.partitionBy(F.col("recipe") % 10).orderBy(text.fold(F.col("title")), "recipe")).alias("place"))


def store_order(spark: SparkSession, d: str) -> DataFrame:
    """The main store, then the one for produce, then the others by position and name: active ones alone."""
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("store"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).alias("position"), F.col("s_nationkey").alias("nation"))
    rank = F.when(F.col("store") % 20 == 3, 0).when(F.col("store") % 20 == 8, 1).otherwise(2)
    return s.select("store", "nation", F.row_number().over(W.partitionBy("nation").orderBy(rank, "position", "name")).alias("place"))


def slot_order(spark: SparkSession, d: str) -> DataFrame:
    """A household's meals of a day by the order of slots, not by the alphabet; the key that orders all its meals."""
    rank = F.array_position(F.array(*map(F.lit, SLOTS)), F.col("slot"))
    key = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("-"), rank.cast("string"))
    return meals(spark, d).select("meal", key.alias("key"), F.row_number().over(W.partitionBy("household", "day").orderBy(rank, "meal")).alias("place"))


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three best of each household, ties to the smaller id."""
    score = F.round(F.col("value")).cast("long")
    place = F.row_number().over(W.partitionBy("household").orderBy(F.desc(score), "meal"))
    return meals(spark, d).select("household", "meal", score.alias("score"), place.alias("place")).where("place <= 3")


def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Ids left out of a list: those left out before and not shown now, and those shown and not kept; and the slots of a household that can be filled, in its order."""
    n = F.col("c_custkey")
    before, shown, kept = F.array(n, n + 1, n + 2), F.array(n + 1, n + 2, n + 3), F.array(n + 2)
    out = F.array_union(F.array_except(before, shown), F.array_except(shown, kept))
    slots = F.array_intersect(F.when(n % 2 == 0, F.array(*map(F.lit, reversed(SLOTS)))).otherwise(F.array(*map(F.lit, SLOTS))), F.array(*map(F.lit, NOON)))
    return table(spark, d, "customer").select(n.alias("list"), F.array_join(F.array_sort(out), ",").alias("excluded"), F.array_join(slots, ",").alias("slots"), F.size(F.array_distinct(F.array_union(before, shown))).cast("long").alias("ids"))


def all_moves(spark: SparkSession, d: str) -> DataFrame:
    """Meals and receipts of a household under one another."""
    a = meals(spark, d).select("household", "day", F.lit("meal").alias("kind"))
    b = recipes(spark, d).select(F.col("author").alias("household"), "day", F.lit("receipt").alias("kind"))
    return a.unionByName(b).groupBy("household", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))


def queue_head(spark: SparkSession, d: str) -> DataFrame:
    """Of each household its first open import, else its first open receipt; beside it the one that keeps it waiting.

    One is read at a time in all: what waits does so for the first open import of any household, else the first open
    receipt, itself left out. Ids that are null come last.
    """
    i = meals(spark, d).where("slot = 'signup' AND value < 20").select("household", F.lit(0).alias("kind"), F.col("meal").alias("id"))
    r = recipes(spark, d).where("status = 'O'").select(F.col("author").alias("household"), F.lit(1).alias("kind"), F.col("recipe").alias("id"))
    u = i.unionByName(r).withColumn("x", F.struct("kind", F.col("id").isNull().alias("last"), "id"))
    first = u.agg(F.min("x").alias("first"))
    second = u.join(F.broadcast(first), F.col("x") != F.col("first")).agg(F.min("x").alias("second"))
    own = u.groupBy("household").agg(F.min("x").alias("x")).join(F.broadcast(first.join(second)))
    busy = F.when(F.col("x") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return own.withColumn("busy", busy).select("household", "x.kind", "x.id", F.col("busy.kind").alias("busy_kind"), F.col("busy.id").alias("busy_id"))


FOLDED = text.fold_sql("title")
QUERIES = {f.__name__: f for f in (visible_recipes, chosen_recipes, named_ingredient, quick_recipes, in_season, list_status, non_food, fully_known, price_sheet, leftovers, tag_counts, last_cooked, next_position, first_lines, list_signature, week_cost, cut_at_total, free_slots, detail_rows, repeated_block, folded_order, store_order, slot_order, best_scores, set_algebra, all_moves, queue_head)}
RANK = "list_position([" + ", ".join(f"'{s}'" for s in SLOTS) + "], slot)"
SQL = {
    "visible_recipes": f"WITH {RECIPES} SELECT recipe, status, author = {ME} AS can_edit FROM re WHERE status = 'F' OR author = {ME}",
    "chosen_recipes": f"WITH {RECIPES} SELECT recipe, priority FROM re WHERE status = 'P'",
    "named_ingredient": "SELECT p_partkey AS ingredient, replace(lower(p_name), ' ', '-') AS slug FROM part WHERE lower(p_name) = 'red bolt' OR lower(p_name) = 'blue gear'",
    "quick_recipes": f"WITH {RECIPES} SELECT recipe, coalesce(prep, 0) + coalesce(cook, 0) AS minutes FROM re WHERE coalesce(prep, 0) + coalesce(cook, 0) BETWEEN 1 AND 30",
    "in_season": f"""WITH {LINES}, s AS (SELECT p_partkey AS pack, CASE WHEN p_size % 4 > 0 THEN list_contains([(p_size + k) % 12 + 1 FOR k IN range(0, 7)], 6) END AS has FROM part)
      SELECT receipt AS recipe, bool_and(has) AS in_season FROM li JOIN s USING (pack) GROUP BY 1""",
    "list_status": f"""WITH {RECIPES} SELECT recipe AS list, CASE WHEN status = 'F' THEN 'archived' WHEN day + 6 < DATE '{DAY}' THEN 'past' WHEN day > DATE '{DAY}' THEN 'to come' ELSE 'current' END AS state, 7::INTEGER AS days FROM re""",
    "non_food": f"WITH {KNOWN} SELECT receipt, count(*) FILTER (non_food) AS n, CAST(sum(CASE WHEN non_food THEN paid ELSE 0 END) AS BIGINT) AS paid FROM kn GROUP BY 1",
    "fully_known": f"WITH {KNOWN} SELECT receipt, count(*) FILTER (status <> 'ignored') AS products, CAST(sum(paid) AS BIGINT) AS paid FROM kn GROUP BY 1 HAVING bool_and(status <> 'pending') AND count(*) FILTER (status <> 'ignored') > 0",
    "price_sheet": f"""WITH {NOW}, s AS (SELECT p_type || '-' || p_size AS aisle, p_partkey AS pack, cents FROM part LEFT JOIN (SELECT * FROM now WHERE store = 5) n ON p_partkey = pack),
      c AS (SELECT *, count(cents) OVER (PARTITION BY aisle) AS known FROM s) SELECT aisle, pack, cents FROM c WHERE known = 0 OR cents IS NOT NULL""",
    "leftovers": f"""WITH {MEALS}, l AS (SELECT household, day, max(meal) AS source, arg_max(value, meal) AS worth FROM me WHERE slot = 'purchase' GROUP BY ALL),
      s AS (SELECT household, day, slot, count(*) - 1 AS siblings FROM me GROUP BY ALL)
      SELECT meal, source, worth, siblings FROM me JOIN l USING (household, day) JOIN s USING (household, day, slot) WHERE slot = 'error'""",
    "tag_counts": "SELECT n_name AS tag, count(s_suppkey) AS recipes, count(s_suppkey) > 0 AS used FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_suppkey % 7 = 0 GROUP BY 1",
    "last_cooked": f"WITH {LINES} SELECT pack, max(day) AS last, CAST(DATE '{DAY}' - max(day) AS INTEGER) AS days FROM li WHERE day < DATE '{DAY}' AND day >= DATE '{DAY}' - 28 GROUP BY 1",
    "next_position": "SELECT o_orderkey AS receipt, CAST(coalesce(max(l_linenumber), 0) + 10 AS BIGINT) AS position FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "first_lines": f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY receipt, pack ORDER BY line, store, qty, paid) AS k FROM li) SELECT receipt, pack, line, store, qty FROM r WHERE k = 1",
    "list_signature": f"""WITH {LINES}, x AS (SELECT receipt, concat_ws(':', lpad(line::VARCHAR, 3, '0'), lpad(pack::VARCHAR, 9, '0'), store, qty, paid) AS x FROM li),
      g AS (SELECT receipt, list_sort(list(x)) AS a FROM x GROUP BY 1)
      SELECT receipt, sha1(array_to_string(a, ',')) AS signature, sha1(array_to_string(a, ',')) <> sha1(array_to_string(a[1:greatest(len(a) - 1, 1)], ',')) AS stale FROM g""",
    "week_cost": f"WITH {MEALS} SELECT household, CAST(date_trunc('week', day) AS DATE) AS monday, CAST(sum(CASE WHEN slot <> 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents, count(*) FILTER (slot <> 'error') AS dishes FROM me GROUP BY 1, 2",
    "cut_at_total": f"""WITH {LINES}, k AS (SELECT *, row_number() OVER w AS k, sum(paid) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM li WINDOW w AS (PARTITION BY receipt ORDER BY line, pack, store, qty, paid)),
      t AS (SELECT *, max(CASE WHEN k = 2 THEN upto END) OVER (PARTITION BY receipt) AS total FROM k)
      SELECT receipt, CAST(max(k) AS INTEGER) AS lines, CAST(max(total) AS BIGINT) AS total FROM t WHERE upto = total GROUP BY 1""",
    "free_slots": f"WITH {MEALS} SELECT meal, count(*) FILTER (slot IN {NOON}) OVER (PARTITION BY household, day ORDER BY meal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM me",
    "detail_rows": f"""WITH {LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY receipt ORDER BY line, pack, store, qty, paid) AS k FROM li),
      p AS (SELECT *, max(CASE WHEN flag <> 'R' THEN k END) OVER (PARTITION BY receipt ORDER BY k ROWS UNBOUNDED PRECEDING) AS product FROM k)
      SELECT receipt, CAST(product AS INTEGER) AS product, CAST(sum(CASE WHEN flag <> 'R' THEN paid ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN flag = 'R' THEN paid ELSE 0 END) AS BIGINT) AS discount, count(*) FILTER (flag = 'R') AS details
      FROM p WHERE product IS NOT NULL GROUP BY 1, 2""",
    "repeated_block": """WITH r AS (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY 1),
      k AS (SELECT conv_id, r, unnest(range(1, len(r) // 2 + 1)) AS k FROM r) SELECT conv_id, CAST(min(k) AS INTEGER) AS block FROM k WHERE r[1:k] = r[k + 1:2 * k] GROUP BY 1""",
    "folded_order": f"""WITH t AS (SELECT c_custkey AS recipe, ['Œuf ', 'éclair ', 'Ananas ', 'zeste '][c_custkey % 4 + 1] || c_mktsegment AS title FROM customer)
      SELECT recipe, {FOLDED} AS folded, CAST(row_number() OVER (PARTITION BY recipe % 10 ORDER BY {FOLDED}, recipe) AS INTEGER) AS place FROM t""",
    "store_order": """SELECT s_suppkey AS store, s_nationkey AS nation, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 20 WHEN 3 THEN 0 WHEN 8 THEN 1 ELSE 2 END, s_suppkey % 5, s_name) AS INTEGER) AS place FROM supplier WHERE s_acctbal > 0""",
    "slot_order": f"WITH {MEALS} SELECT meal, strftime(day, '%Y-%m-%d') || '-' || {RANK} AS key, CAST(row_number() OVER (PARTITION BY household, day ORDER BY {RANK}, meal) AS INTEGER) AS place FROM me",
    "best_scores": f"WITH {MEALS}, r AS (SELECT household, meal, CAST(round(value) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY household ORDER BY CAST(round(value) AS BIGINT) DESC, meal) AS INTEGER) AS place FROM me) SELECT * FROM r WHERE place <= 3",
    "set_algebra": """SELECT c_custkey AS list, array_to_string([c_custkey, c_custkey + 1, c_custkey + 3], ',') AS excluded, CASE WHEN c_custkey % 2 = 0 THEN 'purchase,click' ELSE 'click,purchase' END AS slots, 4::BIGINT AS ids FROM customer""",
    "all_moves": f"WITH {MEALS}, {RECIPES}, u AS (SELECT household, day, 'meal' AS kind FROM me UNION ALL SELECT author, day, 'receipt' FROM re) SELECT household, kind, count(*) AS n, max(day) AS last FROM u GROUP BY 1, 2",
    "queue_head": f"""WITH {MEALS}, {RECIPES}, u AS (SELECT household, 0 AS kind, meal AS id FROM me WHERE slot = 'signup' AND value < 20 UNION ALL SELECT author, 1, recipe FROM re WHERE status = 'O'),
      k AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY kind, id) AS k FROM u), o AS (SELECT kind, id, row_number() OVER (ORDER BY kind, id) AS n FROM (SELECT DISTINCT kind, id FROM u))
      SELECT household, k.kind, k.id, b.kind AS busy_kind, b.id AS busy_id FROM k JOIN o ON o.kind = k.kind AND o.id IS NOT DISTINCT FROM k.id LEFT JOIN o b ON b.n = CASE WHEN o.n = 1 THEN 2 ELSE 1 END WHERE k = 1""",
}
