"""Labels and notes as text: normalised, cut, read as numbers, dates and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text
from larder.sources import rendered
from larder.sources.tables import table

# fixed values: abbreviations of receipts, words that say nothing of a product, misleading beginnings
SHORT = {"ECR": "ecreme", "PDT": "pomme terre", "BEUR": "beurre", "FROM": "fromage", "CHOC": "chocolat", "YAOU": "yaourt", "OEUFS": "oeuf", "POUL": "poulet", "JAMB": "jambon", "CR": "creme", "STK": "steak", "HACH": "hache"}
NOISE = ("bio", "uht", "marque", "lot", "pack", "sachet", "boite", "brique", "bouteille", "kg", "cl", "ml", "france", "origine", "piece", "extra", "format", "filet", "les", "des", "aux", "avec", "sans", "pour")
TODAY = "2026-10-07"
OTHER = r"[\x00-\x24\x26-\x2B\x2D\x3A-\x40\x5B-\x{10FFFF}]+"  # not A-Z0-9%/,. written as ranges: ten times as fast as the negation


def normalised(x: Column) -> Column:
    """Upper case without accents; letters, digits and %/,. alone, one space between."""
    return F.trim(F.regexp_replace(F.upper(text.fold(x)), OTHER, " "))


def label_words(x: Column) -> Column:
    """Tokens of a normalised label: abbreviations spelled out; words of three letters or more without digits that say something; plurals cut."""
    full = F.create_map(*[F.lit(v) for pair in SHORT.items() for v in pair])
    bare = F.transform(F.split(x, " "), lambda w: F.regexp_replace(w, "^[.,/]+|[.,/]+$", ""))
    words = F.flatten(F.transform(bare, lambda w: F.split(F.coalesce(full[w], F.lower(w)), " ")))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]") & ~w.isin(*NOISE))
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 4) & w.rlike("[sx]$"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)))


def label_quantity(x: Column) -> Column:
    """struct(value, unit) of a normalised label: '6X1L', '500G', 'X12' or '1P'; grams, millilitres or pieces."""
    several, one, pieces = r"\b([0-9]{1,3}) ?X ?([0-9]+(?:[.,][0-9]+)?) ?(KG|G|L|CL|ML)\b", r"\b([0-9]+(?:[.,][0-9]+)?) ?(KG|G|L|CL|ML)\b", r"\bX ?([0-9]{1,2})\b|\b([0-9]{1,2}) ?P\b"
    part = lambda p, *groups: [F.regexp_extract(x, p, k) for k in groups]
    said = F.when(F.contains(x, F.lit("X")) & x.rlike(several), F.array(*part(several, 1, 2, 3))).when(x.rlike(one), F.array(F.lit("1"), *part(one, 1, 2))).when(x.rlike(pieces), F.array(F.concat(*part(pieces, 1, 2)), F.lit("1"), F.lit("")))

    def read(s: Column) -> Column:
        value = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
        number = value(s[0]) * value(s[1]) * F.when(s[2].isin("KG", "L"), 1000.0).when(s[2] == "CL", 10.0).otherwise(1.0)
        return F.struct(number.alias("value"), F.when(s[2] == "", "piece").when(s[2].isin("KG", "G"), "g").otherwise("ml").alias("unit"))

    return F.get(F.filter(F.transform(F.array(said), read), lambda q: q["value"] > 0), F.lit(0))


def read_number(x: Column) -> Column:
    """'½', '1 ½', '1/2', '1 1/2' and decimals with a comma; null for what is no number."""
    mixed = r"^([0-9]+) +([0-9]) ?/ ?([0-9])$"
    whole = F.trim(F.replace(x, F.lit("½"), F.lit("")))
    n = lambda p, k: F.regexp_extract(x, p, k).try_cast("double")
    return (
        F.when(F.contains(x, F.lit("½")), F.coalesce(F.when(whole != "", whole).try_cast("double"), F.lit(0.0)) + 0.5)
        .when(x.rlike(mixed), n(mixed, 1) + n(mixed, 2) / n(mixed, 3)).when(x.rlike("^[0-9]+/[0-9]+$"), n("^([0-9]+)/([0-9]+)$", 1) / n("^([0-9]+)/([0-9]+)$", 2))
        .otherwise(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    )


def read_date(x: Column) -> Column:
    """d.m.y, d/m/y or ISO; null before 2020, after today, and for days that are none."""
    local = r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$"
    part = lambda k: F.lpad(F.regexp_extract(x, local, k), 2, "0")
    day = F.when(x.rlike(local), F.concat_ws("-", F.regexp_extract(x, local, 3), part(2), part(1))).when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), x).try_cast("date")
    return F.when((day >= F.lit("2020-01-01").cast("date")) & (day <= F.lit(TODAY).cast("date")), day)


def read_minutes(x: Column) -> Column:
    """'1 h 30', '2h' or '45 min' in minutes, if a text names just one duration."""
    hour, minute = r"([0-9]+) ?h(?: ?([0-9]{1,2}))?", r"([0-9]+) ?min"
    n = lambda p, k: F.coalesce(F.regexp_extract(x, p, k).try_cast("long"), F.lit(0))
    hours, minutes = F.regexp_count(x, F.lit(hour)), F.regexp_count(x, F.lit(minute))
    return F.when((hours == 1) & (minutes == 0), n(hour, 1) * 60 + n(hour, 2)).when((hours == 0) & (minutes == 1), n(minute, 1))


def signed_cents(x: Column) -> Column:
    """An amount with its sign before or behind; null if it can't be read."""
    bare = F.regexp_replace(x, "[ €]", "")
    value = F.when(bare.rlike("^-?[0-9]+([.,][0-9]{1,2})?$|^[0-9]+([.,][0-9]{1,2})?-$"), F.replace(F.regexp_replace(bare, "-", ""), F.lit(","), F.lit(".")).cast("decimal(18,2)"))
    return (F.when(F.contains(bare, F.lit("-")), -value).otherwise(value) * 100).cast("long")


def euros(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))


def minutes_label(m: Column) -> Column:
    rest = F.when(m % 60 > 0, F.concat(F.lit(" "), F.lpad((m % 60).cast("string"), 2, "0"))).otherwise("")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h"), rest))


def _rows(spark: SparkSession, d: str, what: str) -> DataFrame:
    """What order lines say as labels, numbers, dates and so on, each text once."""
    return rendered.phrases(spark, d).select(F.col(what).alias("x")).distinct()


def label_forms(spark: SparkSession, d: str) -> DataFrame:
    """Labels normalised, as tokens, as keys of aliases and as slugs."""
    own = _rows(spark, d, "label").withColumn("label", normalised(F.col("x")))
    return own.select("x", "label", F.array_join(label_words(F.col("label")), " ").alias("words"), text.slug(F.col("x")).alias("slug"))


def label_quantities(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "label").withColumn("q", label_quantity(normalised(F.col("x")))).where("q IS NOT NULL").select("x", "q.value", "q.unit")


def numbers_read(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "number").select("x", read_number(F.col("x")).alias("value"))


def dates_read(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "date").select("x", read_date(F.col("x")).alias("day"))


def times_read(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "time").select("x", read_minutes(F.col("x")).alias("minutes"))


def amounts_read(spark: SparkSession, d: str) -> DataFrame:
    """Amounts as typed (never below nothing) and as printed (with a sign before or behind)."""
    return _rows(spark, d, "amount").select("x", text.euros_to_cents(F.col("x")).alias("typed"), signed_cents(F.col("x")).alias("printed"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """A name without its parentheses, its parts at commas, and the parts in parentheses."""
    x = F.col("x")
    bare = F.trim(F.regexp_replace(x, r"\(.*?\)", " "))
    inside = F.replace(F.regexp_extract(x, r"\((.*?)\)", 1), F.lit("…"), F.lit(""))
    every = F.transform(F.concat(F.array(bare), F.split(bare, ","), F.split(inside, ",")), lambda v: F.trim(v))
    return _rows(spark, d, "name").select("x", F.explode(F.array_distinct(F.filter(every, lambda v: v != ""))).alias("variant"))


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts that are within a few letters of a mistyped word: two from eight letters on, one from five, else none. Only names of nearly the same length are held together."""
    words = spark.createDataFrame([("red wigdet",), ("blu bolt",), ("hot gear",), ("smal anvil",), ("oldbolt",)], "w string").withColumn("n", F.length("w"))
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    room = F.when(F.col("n") >= 8, 2).when(F.col("n") >= 5, 1).otherwise(0)
    near = names.withColumn("n", F.explode(F.sequence(F.length("name") - 2, F.length("name") + 2))).join(words, "n")
    return near.select("w", "name", F.levenshtein("w", "name").alias("far"), room.alias("room")).where("far <= room").select("w", "name", "far")


def seeded_jitter(spark: SparkSession, d: str) -> DataFrame:
    """A small number that a seed, a recipe, a day and a slot decide."""
    key = F.concat_ws("-", F.lit("1"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), "event_type")
    return table(spark, d, "events").select(F.col("event_id").alias("meal"), (F.crc32(key.cast("binary")) % 1000).alias("thousandths"))


def money_labels(spark: SparkSession, d: str) -> DataFrame:
    """Totals as euros, minutes as hours, and a list's days in French."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("receipt"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.col("o_orderkey") % 200).alias("m"), F.col("o_orderdate").cast("date").alias("a"))
    months = F.array(*map(F.lit, MONTHS))
    stop = F.date_add("a", 6)
    name = lambda day: F.element_at(months, F.month(day))
    same = F.concat(F.dayofmonth("a").cast("string"), F.lit(" au "), F.dayofmonth(stop).cast("string"), F.lit(" "), name(stop))
    other = F.concat(F.dayofmonth("a").cast("string"), F.lit(" "), name("a"), F.lit(" au "), F.dayofmonth(stop).cast("string"), F.lit(" "), name(stop))
    return o.select("receipt", euros(F.col("cents")).alias("euros"), minutes_label(F.col("m")).alias("duration"), F.when(F.month("a") == F.month(stop), same).otherwise(other).alias("period"))


def repaired_text(spark: SparkSession, d: str) -> DataFrame:
    """Misread signs repaired, ligatures spelled out, addresses and blank lines cut, and what a text is about by its first key word."""
    x = F.replace(F.replace(F.col("x"), F.lit("ﬁ"), F.lit("fi")), F.lit("œ"), F.lit("oe"))
    x = F.regexp_replace(x, "https?://[^ ]+ ?", "")
    x = F.regexp_replace(x, "(^|\n)Page [0-9]+/[0-9]+\n", "$1")
    x = F.regexp_replace(F.regexp_replace(x, "([0-9])O", "$10"), "\\bl,([0-9])", "1,$1")
    x = F.regexp_replace(x, "\n+ *", "\n")
    f = text.fold(x)
    kind = F.when(f.rlike("soupe|veloute"), "soup").when(f.rlike("tarte|gateau"), "dessert").when(f.rlike("poulet|boeuf"), "main").otherwise("other")
    protein = F.when(f.rlike("poisson|saumon"), "fish").when(f.rlike("poulet"), "poultry").when(f.rlike("boeuf"), "beef").otherwise("none")
    return _rows(spark, d, "note").select("x", x.alias("clean"), kind.alias("kind"), protein.alias("protein"))


def guessed_stores(spark: SparkSession, d: str) -> DataFrame:
    """The store that a document names: learned names first, then key words; the first source wins."""
    source = F.lower("source")
    learned = F.when(source.isin("src3", "src12"), "learned")
    return table(spark, d, "documents").select("doc_id", F.coalesce(learned, F.when(F.contains(source, F.lit("1")), "by word")).alias("store")).where("store IS NOT NULL")


def answers_read(spark: SparkSession, d: str) -> DataFrame:
    """The fixed shape of a JSON answer, read from each event's properties and written again."""
    shape = F.from_json("props", "k long")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), shape["k"].alias("k"), F.to_json(F.struct(shape["k"].alias("k"), F.col("event_type").alias("kind"))).alias("answer"))


def pasted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of 10 to 30,000 characters are taken, with their lines counted."""
    n = F.length("text")
    return table(spark, d, "documents").where(n.between(10, 30_000)).select("doc_id", n.cast("long").alias("n"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def _phrases(what: str) -> str:
    return rendered.PHRASES + f", v AS (SELECT DISTINCT {what} AS id, {what} AS x FROM phrases)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper({text.fold_sql(x)}), '[^A-Z0-9%/,.]', ' ', 'g'), ' +', ' ', 'g'))"


QTY = r"""q AS (SELECT id, regexp_extract(n, '\b([0-9]{1,3}) ?X ?([0-9]+(?:[.,][0-9]+)?) ?(KG|G|L|CL|ML)\b', ['a', 'b', 'u']) AS s, regexp_extract(n, '\b([0-9]+(?:[.,][0-9]+)?) ?(KG|G|L|CL|ML)\b', ['b', 'u']) AS o,
  regexp_extract(n, '\bX ?([0-9]{1,2})\b', 1) || regexp_extract(n, '\b([0-9]{1,2}) ?P\b', 1) AS p FROM n),
r AS (SELECT id, p, CASE WHEN s.u <> '' THEN s.a::DOUBLE * replace(s.b, ',', '.')::DOUBLE WHEN o.u <> '' THEN replace(o.b, ',', '.')::DOUBLE WHEN p <> '' THEN p::DOUBLE END AS v, CASE WHEN s.u <> '' THEN s.u WHEN o.u <> '' THEN o.u END AS u FROM q)"""
QUERIES = {f.__name__: f for f in (label_forms, label_quantities, numbers_read, dates_read, times_read, amounts_read, name_variants, fuzzy_names, seeded_jitter, money_labels, repaired_text, guessed_stores, answers_read, pasted_texts)}
SHORT_SQL = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT.items()) + " ELSE lower(w) END"
SQL = {
    "label_forms": f"""WITH {_phrases('label')}, n AS (SELECT id, x, {_norm('x')} AS n FROM v),
      w0 AS (SELECT id, generate_subscripts(string_split(n, ' '), 1) AS i, regexp_replace(unnest(string_split(n, ' ')), '^[.,/]+|[.,/]+$', '', 'g') AS w FROM n),
      w1 AS (SELECT id, i, generate_subscripts(string_split({SHORT_SQL}, ' '), 1) AS j, unnest(string_split({SHORT_SQL}, ' ')) AS w FROM w0),
      w2 AS (SELECT id, i, j, CASE WHEN length(w) > 4 AND regexp_matches(w, '[sx]$') THEN left(w, length(w) - 1) ELSE w END AS w FROM w1 WHERE length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN {NOISE}),
      w3 AS (SELECT id, w, min(i * 10 + j) AS k FROM w2 GROUP BY 1, 2), g AS (SELECT id, string_agg(w, ' ' ORDER BY k) AS words FROM w3 GROUP BY 1)
      SELECT n.id AS x, n AS label, coalesce(words, '') AS words, regexp_replace(regexp_replace(regexp_replace({text.fold_sql('x')}, '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM n LEFT JOIN g USING (id)""",
    "label_quantities": f"WITH {_phrases('label')}, n AS (SELECT id, {_norm('x')} AS n FROM v), {QTY} SELECT id AS x, v * CASE WHEN u IN ('KG', 'L') THEN 1000 WHEN u = 'CL' THEN 10 ELSE 1 END AS value, CASE WHEN u IS NULL THEN 'piece' WHEN u IN ('KG', 'G') THEN 'g' ELSE 'ml' END AS unit FROM r WHERE v > 0",
    "numbers_read": f"""WITH {_phrases('number')} SELECT id AS x, CASE WHEN contains(x, '½') THEN coalesce(TRY_CAST(nullif(trim(replace(x, '½', '')), '') AS DOUBLE), 0) + 0.5
      WHEN regexp_matches(x, '^[0-9]+ +[0-9]/[0-9]$') THEN split_part(x, ' ', 1)::DOUBLE + split_part(split_part(x, ' ', 2), '/', 1)::DOUBLE / split_part(x, '/', 2)::DOUBLE
      WHEN regexp_matches(x, '^[0-9]+/[0-9]+$') THEN split_part(x, '/', 1)::DOUBLE / split_part(x, '/', 2)::DOUBLE ELSE TRY_CAST(replace(x, ',', '.') AS DOUBLE) END AS value FROM v""",
    "dates_read": rf"""WITH {_phrases('date')}, p AS (SELECT id, CASE WHEN regexp_matches(x, '^[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}$') THEN coalesce(try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%d/%m/%Y')) WHEN regexp_matches(x, '^[0-9]{{4}}-') THEN try_strptime(x, '%Y-%m-%d') END::DATE AS day FROM v)
      SELECT id AS x, CASE WHEN day BETWEEN DATE '2020-01-01' AND DATE '{TODAY}' THEN day END AS day FROM p""",
    "times_read": r"""WITH """ + _phrases('time') + r""", c AS (SELECT id, x, len(regexp_extract_all(x, '[0-9]+ ?h')) AS h, len(regexp_extract_all(x, '[0-9]+ ?min')) AS m FROM v)
      SELECT id AS x, CASE WHEN h = 1 AND m = 0 THEN regexp_extract(x, '([0-9]+) ?h', 1)::BIGINT * 60 + coalesce(TRY_CAST(regexp_extract(x, '[0-9]+ ?h ?([0-9]{1,2})', 1) AS BIGINT), 0) WHEN h = 0 AND m = 1 THEN regexp_extract(x, '([0-9]+) ?min', 1)::BIGINT END AS minutes FROM c""",
    "amounts_read": f"""WITH {_phrases('amount')}, b AS (SELECT id, regexp_replace(x, '[ €]', '', 'g') AS b FROM v)
      SELECT id AS x, CASE WHEN regexp_matches(b, '^[0-9]+([.,][0-9]+)?$') THEN CAST(round(replace(b, ',', '.')::DECIMAL(18, 4) * 100) AS BIGINT) END AS typed,
        CASE WHEN regexp_matches(b, '^-?[0-9]+([.,][0-9]{{1,2}})?$|^[0-9]+([.,][0-9]{{1,2}})?-$') THEN CAST(replace(replace(b, '-', ''), ',', '.')::DECIMAL(18, 2) * 100 * CASE WHEN contains(b, '-') THEN -1 ELSE 1 END AS BIGINT) END AS printed FROM b""",
    "name_variants": rf"""WITH {_phrases('name')}, p AS (SELECT id, trim(regexp_replace(x, '\(.*?\)', ' ', 'g')) AS bare, replace(regexp_extract(x, '\((.*?)\)', 1), '…', '') AS inside FROM v),
      a AS (SELECT id, bare AS t FROM p UNION ALL SELECT id, unnest(string_split(bare, ',')) FROM p UNION ALL SELECT id, unnest(string_split(inside, ',')) FROM p) SELECT DISTINCT id AS x, trim(t) AS variant FROM a WHERE trim(t) <> ''""",
    "fuzzy_names": """WITH w(w) AS (VALUES ('red wigdet'), ('blu bolt'), ('hot gear'), ('smal anvil'), ('oldbolt')), n AS (SELECT DISTINCT p_name AS name FROM part)
      SELECT w, name, CAST(levenshtein(w, name) AS INTEGER) AS far FROM w, n WHERE levenshtein(w, name) <= CASE WHEN length(w) >= 8 THEN 2 WHEN length(w) >= 5 THEN 1 ELSE 0 END""",
    "seeded_jitter": "SELECT event_id AS meal, CAST(" + text.crc32_sql("('1-' || user_id || '-' || strftime(ts, '%Y-%m-%d') || '-' || event_type)") + " % 1000 AS BIGINT) AS thousandths FROM events",
    "money_labels": f"""WITH o AS (SELECT o_orderkey AS receipt, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % 200 AS m, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 6 AS b, {list(MONTHS)} AS mo FROM orders)
      SELECT receipt, c // 100 || ',' || lpad((c % 100)::VARCHAR, 2, '0') || ' €' AS euros, CASE WHEN m < 60 THEN m || ' min' ELSE m // 60 || ' h' || CASE WHEN m % 60 > 0 THEN ' ' || lpad((m % 60)::VARCHAR, 2, '0') ELSE '' END END AS duration,
        CASE WHEN month(a) = month(b) THEN day(a) || ' au ' || day(b) || ' ' || mo[month(b)] ELSE day(a) || ' ' || mo[month(a)] || ' au ' || day(b) || ' ' || mo[month(b)] END AS period FROM o""",
    "repaired_text": rf"""WITH {_phrases('note')}, a AS (SELECT x, regexp_replace(regexp_replace(replace(replace(x, 'ﬁ', 'fi'), 'œ', 'oe'), 'https?://[^ ]+ ?', '', 'g'), '(^|\n)Page [0-9]+/[0-9]+\n', '\1', 'g') AS y FROM v),
      b AS (SELECT x, regexp_replace(regexp_replace(regexp_replace(y, '([0-9])O', '\1' || '0', 'g'), '\bl,([0-9])', '1,\1', 'g'), '\n+ *', chr(10), 'g') AS clean FROM a), f AS (SELECT *, {text.fold_sql('clean')} AS f FROM b)
      SELECT x, clean, CASE WHEN regexp_matches(f, 'soupe|veloute') THEN 'soup' WHEN regexp_matches(f, 'tarte|gateau') THEN 'dessert' WHEN regexp_matches(f, 'poulet|boeuf') THEN 'main' ELSE 'other' END AS kind,
        CASE WHEN regexp_matches(f, 'poisson|saumon') THEN 'fish' WHEN contains(f, 'poulet') THEN 'poultry' WHEN contains(f, 'boeuf') THEN 'beef' ELSE 'none' END AS protein FROM f""",
    "guessed_stores": "SELECT doc_id, CASE WHEN source IN ('src3', 'src12') THEN 'learned' ELSE 'by word' END AS store FROM documents WHERE source IN ('src3', 'src12') OR contains(source, '1')",
    "answers_read": """SELECT event_id AS id, CAST(props->>'k' AS BIGINT) AS k, '{"k":' || (props->>'k') || ',"kind":"' || event_type || '"}' AS answer FROM events""",
    "pasted_texts": "SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS lines FROM documents WHERE length(text) BETWEEN 10 AND 30000",
}
