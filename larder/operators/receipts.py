"""Receipts as text: each line classed by what it says, details tied to the article above, totals checked.

A receipt stays one row: its lines are an array, which patterns class line by line and one pass ties together. A
receipt is some dozens of lines, so no array is large, and nothing is dealt out again after its text is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.operators.labels import TODAY, label_quantity, normalised, read_date
from larder.sources import rendered

PRICE = r"(-?[0-9]{1,4}[,.][0-9]{2}-?)(?: ?€)?(?: +([A-Z]))?$"
PAID = PRICE.replace("{1,4}", "{1,7}")  # totals are longer than prices of a line
WEIGHT = r"^([0-9]+[,.][0-9]{3}) ?kg ?x ?([0-9]+[,.][0-9]{2})"
COUNT = r"^([0-9]{1,2}) ?x ?([0-9]+[,.][0-9]{2})"
TOTAL = r"^(TOTAL(?! (REMISE|PROMO|HT|TVA))|NET A PAYER|A PAYER)"
SKIP = r"^(SOUS TOTAL|TVA|CB|CARTE|VISA|ESPECES|RENDU|TICKET|CAISSE|MERCI|SIRET|TEL|WWW|DATE|FIDELITE|BIENVENUE)"
DISCOUNT = r"^(REMISE|REDUCTION|PROMO|COUPON|RABAIS)"
VAT = r"^TVA +([A-Z]) +([0-9]{1,2}[,.][0-9]{2}) ?%"
NAMED = ("TOT", "NET", "A P", "SOU", "TVA", "CAR", "VIS", "ESP", "REN", "TIC", "CAI", "MER", "SIR", "TEL", "WWW", "DAT", "FID", "BIE", "REM", "RED", "PRO", "COU", "RAB", "NOM")  # how the words above begin, beside CB: a quick look before patterns
ARTICLE = "struct<label:string,cents:bigint,unread:boolean,vat:string,discount:bigint,qty:double,kg:boolean>"


def _cents(price: Column) -> Column:
    """Cents of what PAID found; null without, or with a sign before and behind."""
    value = F.replace(F.replace(F.replace(price, F.lit(",")), F.lit(".")), F.lit("-")).try_cast("long")
    return F.when(price.endswith("-"), F.when(~price.startswith("-"), -value)).when(price.startswith("-"), -value).otherwise(value)


def _decimal(x: Column, pattern: str, group: int) -> Column:
    return F.replace(F.regexp_extract(x, pattern, group), F.lit(","), F.lit(".")).try_cast("double")


def receipt_lines(receipts: DataFrame) -> DataFrame:
    """receipts (receipt, text), with lines: an array of kind, label, cents, qty, each, vat (letter) and x of every line that says something."""
    said = F.filter(F.transform(F.split(F.regexp_replace("text", "  +", " "), "[\n\x0b\f\r\x85\u2028\u2029]"), lambda x: F.trim(x)), lambda x: x != "")
    priced = F.transform(said, lambda x: F.struct(x.alias("x"), F.split(F.regexp_replace(x, PAID, "\n$1\n$2"), "\n").alias("p")))  # what is before the price, the price, its letter
    parted = F.transform(priced, lambda r: F.struct(r["x"].alias("x"), normalised(r["p"][0]).alias("label"), F.coalesce(F.get(r["p"], F.lit(1)), F.lit("")).alias("price"), F.coalesce(F.get(r["p"], F.lit(2)), F.lit("")).alias("vat")))

    def kind(r: Column) -> Column:
        x, label, paid, digit = r["x"], r["label"], r["price"] != "", (r["x"] >= "0") & (r["x"] < ":")
        amount = F.when(digit & x.rlike(WEIGHT), "weight").when(digit & x.rlike(COUNT), "times")
        bare = F.coalesce(amount, F.when(paid & label.rlike("[A-Z]{2}"), "article").when(F.contains(x, F.lit("???")), "unread").otherwise("other"))
        vat = label.startswith("TVA") & F.when(paid, normalised(x)).otherwise(label).rlike(VAT.replace("%", ""))
        named = F.when(paid & label.rlike(TOTAL), "total").when(vat, "vat").when(label.startswith("NOMBRE"), "count").when(paid & label.rlike(DISCOUNT), "discount").when(label.rlike(SKIP), "skip")
        return F.when((F.left(label, F.lit(2)) == "CB") | F.left(label, F.lit(3)).isin(*NAMED), F.coalesce(named, bare)).otherwise(bare)

    classed = F.transform(parted, lambda r: F.struct(kind(r).alias("kind"), r.alias("r")))

    def read(k: Column) -> Column:
        r, weight, times = k["r"], k["kind"] == "weight", k["kind"] == "times"
        qty = F.when(weight, _decimal(r["x"], WEIGHT, 1)).when(times, _decimal(r["x"], COUNT, 1))
        each = F.when(weight, _decimal(r["x"], WEIGHT, 2)).when(times, _decimal(r["x"], COUNT, 2))
        return F.struct(k["kind"].alias("kind"), r["label"].alias("label"), F.when(r["price"] != "", _cents(r["price"])).alias("cents"), qty.alias("qty"), F.round(each * 100).cast("long").alias("each"), r["vat"].alias("vat"), r["x"].alias("x"))

    return receipts.withColumn("lines", F.transform(classed, read))


def _tied(body: Column) -> Column:
    """The articles of a receipt's lines with their details and discounts: ARTICLE each, in order.

    The fold's state: the articles that are done, the last one, the price before (of the last article that has one),
    and the details that wait for the article behind.
    """
    none = F.lit(None)
    wait = lambda qty, kg: F.struct(qty.cast("double").alias("qty"), kg.cast("boolean").alias("kg"))
    state = lambda done, last, price, waits: F.struct(done.alias("done"), last.alias("last"), price.cast("long").alias("price"), waits.alias("waits"))
    with_last = lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["last"]))

    def article(a: Column, discount: Column, qty: Column, kg: Column) -> Column:
        return F.struct(a["label"].alias("label"), a["cents"].alias("cents"), a["unread"].alias("unread"), a["vat"].alias("vat"), discount.alias("discount"), qty.alias("qty"), kg.alias("kg"))

    def told(a: Column, w: Column) -> Column:
        return F.when(a.isNotNull(), article(a, a["discount"], F.greatest(a["qty"], w["qty"]), a["kg"] | w["kg"]))

    def step(s: Column, x: Column) -> Column:
        own = F.struct(x["label"].alias("label"), x["cents"].alias("cents"), (x["kind"] == "unread").alias("unread"), x["vat"].alias("vat"))
        new = state(with_last(s), article(own, F.lit(0).cast("long"), s["waits"]["qty"], s["waits"]["kg"]), F.coalesce(x["cents"], s["price"]), wait(none, F.lit(False)))
        cut = state(s["done"], F.when(s["last"].isNotNull(), article(s["last"], s["last"]["discount"] + F.coalesce(F.abs(x["cents"]), F.lit(0).cast("long")), s["last"]["qty"], s["last"]["kg"])), s["price"], s["waits"])
        detail, weight = wait(x["qty"], x["kind"] == "weight"), x["kind"] == "weight"
        fits = F.round(F.round(x["qty"] * 1000) * x["each"] / 1000) == s["price"]  # thousandths are exact
        here = state(s["done"], told(s["last"], detail), s["price"], s["waits"])
        later = state(s["done"], s["last"], s["price"], wait(F.greatest(s["waits"]["qty"], x["qty"]), s["waits"]["kg"] | weight))
        return F.when(x["kind"].isin("article", "unread"), new).when(x["kind"] == "discount", cut).when(fits, here).otherwise(later)

    zero = state(F.array().cast(f"array<{ARTICLE}>"), none.cast(ARTICLE), none, wait(none, F.lit(False)))
    return F.aggregate(body, zero, step, lambda s: with_last(state(s["done"], told(s["last"], s["waits"]), s["price"], s["waits"])))


def read_receipts(receipts: DataFrame) -> DataFrame:
    """receipts with lines, total, and articles: an array of label, qty, unit, cents, discount, paid, rate, non_food, note.

    A weight or a count completes the article before it if that has no other, else the one behind it; a discount
    goes to the article before. What is behind the total is no article. One unreadable line takes what is missing
    to the total, if that is up to 200 euros. Of two rates of one letter the first counts.
    """
    every = receipt_lines(receipts)
    place = F.array_position("lines.kind", F.lit("total")).cast("int")
    every = every.withColumn("place", F.when(place > 0, place))
    body = F.filter(F.coalesce(F.slice("lines", F.lit(1), F.col("place") - 1), "lines"), lambda x: x["kind"].isin("article", "unread", "weight", "times", "discount"))
    rates = F.transform(F.filter("lines", lambda x: x["kind"] == "vat"), lambda x: F.struct(F.regexp_extract(x["x"], VAT, 1).alias("vat"), _decimal(x["x"], VAT, 2).alias("rate")))
    every = every.withColumn("total", F.get("lines.cents", F.col("place") - 1)).withColumn("tied", _tied(body)).withColumn("rates", rates)
    gap = F.col("total") - F.aggregate("tied", F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["cents"], F.lit(0).cast("long")) - a["discount"])
    lone = F.size(F.filter("tied", lambda a: a["unread"])) == 1
    every = every.withColumn("gap", F.when(lone, gap)).withColumn("gap", F.when(F.col("gap").between(1, 20_000), F.col("gap")))
    found = F.transform("tied", lambda a: F.struct(a.alias("a"), F.when(a["unread"] & F.col("gap").isNotNull(), F.col("gap")).otherwise(a["cents"]).alias("cents"), F.get(F.filter("rates", lambda r: r["vat"] == a["vat"]), F.lit(0))["rate"].alias("rate")))
    articles = F.transform(F.filter(found, lambda f: f["cents"].isNotNull()), lambda f: F.struct(
        f["a"]["label"].alias("label"), F.coalesce(f["a"]["qty"], F.lit(1.0)).alias("qty"), F.when(f["a"]["kg"], "kg").otherwise("piece").alias("unit"), f["cents"].alias("cents"), f["a"]["discount"].alias("discount"), (f["cents"] - f["a"]["discount"]).alias("paid"),
        f["rate"].alias("rate"), F.coalesce(f["rate"] >= 19, F.lit(False)).alias("non_food"), F.when(f["a"]["unread"] & F.col("gap").isNotNull(), "deduced from the total").alias("note"),
    ))
    return every.select("receipt", "lines", "total", articles.alias("articles"))


def parsed(receipts: DataFrame) -> DataFrame:
    """Articles: receipt, n, label, qty, unit, cents, discount, paid, vat rate, non_food, note."""
    rows = read_receipts(receipts).select("receipt", "total", F.posexplode_outer("articles").alias("pos", "a")).where("pos IS NOT NULL")  # an inner one would be filtered first, and so read twice
    return rows.select("receipt", (F.col("pos") + 1).alias("n"), "a.*", "total")


def split_discount(cents: Column, parts: Column, place: Column) -> Column:
    """A saving on a lot dealt to its articles in whole cents: what doesn't divide goes to the first."""
    return F.floor(cents / parts) + F.when(place == 0, cents % parts).otherwise(0)


def receipt_articles(spark: SparkSession, d: str) -> DataFrame:
    return parsed(rendered.receipts(spark, d)).drop("total")


def receipt_heads(spark: SparkSession, d: str) -> DataFrame:
    """Each receipt's day, printed total and what its articles come to; whether they agree."""
    own = read_receipts(rendered.receipts(spark, d))
    days = F.transform(F.filter("lines.x", lambda x: (x >= "-") & (x < ":")), lambda x: read_date(F.regexp_extract(x, "^([0-9./-]+)", 1)))  # digits, points and signs are in this range
    own = own.select("receipt", "total", F.array_max(days).alias("day"), F.aggregate("articles.paid", F.lit(0).cast("long"), lambda s, x: s + x).alias("paid"), F.size("articles").cast("long").alias("articles"))
    head = F.struct("receipt", "day", "total", "paid", "articles", (F.col("paid") == F.col("total")).alias("agrees"))
    return own.select(F.explode_outer(F.filter(F.array(head), lambda h: h["articles"] > 0)).alias("h")).where("h IS NOT NULL").select("h.*")


def receipt_packs(spark: SparkSession, d: str) -> DataFrame:
    """For each article the pack that fits its label among 200, 500 and 1,000: the exact one within 2 %, else the nearest; for a weight the loose one."""
    own = parsed(rendered.receipts(spark, d)).select("receipt", "n", "unit", label_quantity(F.col("label"))["value"].alias("q"))
    packs = F.array(*map(F.lit, (200.0, 500.0, 1000.0)))
    own = own.withColumn("near", F.array_min(F.transform(packs, lambda p: F.struct(F.abs(p - F.col("q")).alias("far"), p.alias("pack")))))
    return own.select("receipt", "n", F.when(F.col("unit") == "kg", "loose").when(F.col("q").isNull(), "piece").when(F.col("near.far") <= F.col("near.pack") * 0.02, "exact").otherwise("nearest").alias("how"), F.when((F.col("unit") != "kg") & F.col("q").isNotNull(), F.col("near.pack")).alias("pack"))


def lot_savings(spark: SparkSession, d: str) -> DataFrame:
    """A saving of each order dealt to its lines by place."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("receipt"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    by = W.partitionBy("receipt")
    place = F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return li.select("receipt", place.alias("place"), split_discount(F.col("receipt") % 100, F.count(F.lit(1)).over(by), place).cast("long").alias("share"))


#: What the printed lines stand for: an unread line is an article if it is its receipt's only one and the gap is small.
_STOOD = rendered.PRINTED + """,
r0 AS (SELECT *, form = 7 AS lost, count(*) FILTER (form = 7) OVER (PARTITION BY receipt) AS n_lost, CAST(sum(paid) OVER (PARTITION BY receipt) AS BIGINT) AS total FROM printed),
r1 AS (SELECT *, row_number() OVER (PARTITION BY receipt ORDER BY a, b, c, e) AS n FROM r0 WHERE NOT lost OR (n_lost = 1 AND value BETWEEN 1 AND 20000)),
r2 AS (SELECT receipt, CAST(n AS INTEGER) AS n, name || CASE WHEN lost THEN '' ELSE ' ' || p_size * 25 || 'G' END AS label, CASE form WHEN 2 THEN q / 10 WHEN 4 THEN q ELSE 1 END::DOUBLE AS qty, CASE WHEN form = 2 THEN 'kg' ELSE 'piece' END AS unit, value AS cents,
  CASE WHEN off THEN 34 ELSE 0 END::BIGINT AS discount, CASE WHEN lost THEN NULL WHEN flag = 'A' THEN 5.5 WHEN flag = 'N' THEN 20 END::DOUBLE AS rate, CASE WHEN lost THEN 'deduced from the total' END AS note, total, CASE WHEN lost THEN NULL ELSE p_size * 25 END AS size FROM r1)"""
QUERIES = {f.__name__: f for f in (receipt_articles, receipt_heads, receipt_packs, lot_savings)}
SQL = {
    "receipt_articles": f"WITH {_STOOD} SELECT receipt, n, label, qty, unit, cents, discount, cents - discount AS paid, rate, coalesce(rate >= 19, false) AS non_food, note FROM r2",
    "receipt_heads": f"""WITH {_STOOD}, s AS (SELECT receipt, CAST(sum(cents - discount) AS BIGINT) AS paid, max(total) AS total, count(*) AS articles FROM r2 GROUP BY 1), h AS (SELECT receipt, max(strptime(day, '%d/%m/%Y')::DATE) FILTER (day = top) AS day FROM (SELECT *, max(day) OVER (PARTITION BY receipt) AS top FROM printed) GROUP BY 1)
      SELECT receipt, CASE WHEN day BETWEEN DATE '2020-01-01' AND DATE '{TODAY}' THEN day END AS day, total, paid, articles, paid = total AS agrees FROM h JOIN s USING (receipt)""",
    "receipt_packs": f"""WITH {_STOOD}, p AS (SELECT receipt, n, unit, size, unnest([200.0, 500.0, 1000.0])::DOUBLE AS pack FROM r2), k AS (SELECT *, row_number() OVER (PARTITION BY receipt, n ORDER BY abs(pack - size), pack) AS k FROM p)
      SELECT receipt, n, CASE WHEN unit = 'kg' THEN 'loose' WHEN size IS NULL THEN 'piece' WHEN abs(pack - size) <= pack * 0.02::DOUBLE THEN 'exact' ELSE 'nearest' END AS how, CASE WHEN unit <> 'kg' AND size IS NOT NULL THEN pack END AS pack FROM k WHERE k = 1""",
    "lot_savings": """WITH k AS (SELECT l_orderkey AS receipt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
      SELECT receipt, CAST(place AS INTEGER) AS place, (receipt % 100) // n + CASE WHEN place = 0 THEN (receipt % 100) % n ELSE 0 END AS share FROM k""",
}
