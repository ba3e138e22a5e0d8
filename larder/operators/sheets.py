"""Labels of recipe sheets matched to ingredients in stages; what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from larder.functions.text import fold_sql, slug, tokens
from larder.operators import ingredient_lines
from larder.sources import rendered
from larder.sources.tables import kept, table

# fixed values: words that say nothing, words that describe a product without changing it, colours, other names of ingredients
STOP = ("de", "du", "des", "la", "le", "les", "l", "d", "au", "aux", "a", "en", "et", "un", "une", "ou", "pour", "avec", "sans", "ici", "sur", "dans")
DESCRIBING = (
    "rape", "rapee", "emince", "emincee", "hache", "hachee", "coupe", "coupee", "fondu", "fondue", "mou", "molle", "pele", "lave", "cuit", "cuite", "cru", "crue", "frais", "fraiche", "moulu", "moulue", "entier", "entiere",
    "mur", "mure", "gros", "petit", "moyen", "bio", "vierge", "extra", "pressee", "premiere", "froid", "fermier", "label", "affine", "affinee", "vieux", "jeune", "moi", "mois", "an",
)
COLOURS = ("vert", "verte", "rouge", "jaune", "orange", "blanc", "blanche", "noir", "noire", "violet", "violette")
SYNONYMS = {
    "oignon": "Oignon jaune", "creme epaisse": "Crème fraîche épaisse", "creme fraiche": "Crème fraîche épaisse", "creme fraiche epaisse": "Crème fraîche épaisse", "creme": "Crème liquide entière", "creme liquide": "Crème liquide entière",
    "creme fleurette": "Crème liquide entière", "sel": "Sel fin", "poivre": "Poivre noir moulu", "lait": "Lait demi-écrémé", "beurre": "Beurre doux", "farine": "Farine de blé T55", "sucre": "Sucre en poudre", "riz": "Riz long",
    "jaune oeuf": "Oeufs", "blanc oeuf": "Oeufs", "emmental": "Emmental râpé", "lardons": "Lardons fumés", "tomates pelees": "Tomates pelées en conserve", "tomate concassee": "Tomates pelées en conserve",
    "pate courte": "Pâtes (spaghetti, penne…)", "pate longue": "Pâtes (spaghetti, penne…)", "macaroni": "Pâtes (spaghetti, penne…)", "mini macaroni": "Pâtes (spaghetti, penne…)", "coquillette": "Pâtes (spaghetti, penne…)",
    "torsade": "Pâtes (spaghetti, penne…)", "tagliatelle": "Pâtes (spaghetti, penne…)", "fusilli": "Pâtes (spaghetti, penne…)", "farfalle": "Pâtes (spaghetti, penne…)", "blanc poulet": "Filet de poulet", "escalope poulet": "Filet de poulet",
}
VIA = ("alias", "synonyme", "nom", "nom", "partiel", "approchant")  # by stage; a name equal to the label comes before one within it


def _singular(words: tuple[str, ...]) -> list[str]:
    return sorted({w[:-1] if len(w) > 3 and w[-1] in "sx" else w for w in words})


IGNORED, COLOUR = _singular(DESCRIBING), _singular(COLOURS)
WEAK = sorted({*IGNORED, *COLOUR})
def variants(names: DataFrame) -> DataFrame:
    """(name, place, tokens) of each way to write a name: without what is in brackets, its comma parts, the parts in the brackets."""
    bare = F.trim(F.regexp_replace("name", r"\(.*?\)", " "))
    inside = F.replace(F.regexp_extract("name", r"\((.*?)\)", 1), F.lit("…"), F.lit(""))
    parts = F.concat(F.array(bare), F.split(bare, ","), F.split(inside, ","))
    every = F.array_distinct(F.transform(parts, lambda v: F.trim(v)))
    return names.select("name", F.posexplode(every).alias("part", "v")).select("name", F.struct("name", "part").alias("place"), tokens(F.col("v"), STOP).alias("tokens")).where(F.size("tokens") > 0)


def _cuts(word: Column) -> Column:
    """A word with none, one or two letters left out: two words at most two edits apart share one of these."""

    def once(words: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))))

    one = once(F.array(word))
    return F.array_distinct(F.concat(F.array(word), one, once(one)))


def close_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(w, v): equal words, and those one edit apart from five letters on, two from eight on, by the shorter's length. Found by equal remains, so no word meets all others."""
    long_left, long_right = (x.where(F.length(c) >= 5).select(c, F.explode(_cuts(F.col(c))).alias("cut")) for x, c in ((left, "w"), (right, "v")))
    shorter = F.least(F.length("w"), F.length("v"))
    near = long_left.join(long_right, "cut").select("w", "v").where((F.col("w") != F.col("v")) & (F.levenshtein("w", "v") <= F.when(shorter >= 8, 2).otherwise(1))).distinct()
    return near.unionByName(left.join(right, F.col("w") == F.col("v")).select("w", "v"))


def match_labels(labels: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, ingredient, via, candidates, from labels (id, label), names (name) and aliases (key, name).

    Stages: a learned alias, a synonym, a name equal to the label, the longest name within it if what is left
    only describes, a name that holds all it says, a name alike but for a letter or two. The first stage with
    one name alone decides: a tie gives none. Without a name, candidates are the five that share most words,
    where one that only describes weighs a tenth, then by name. Labels without words, or null, get nothing. Each distinct
    list of words is compared once, with names that share a word; names that are alike in places and words
    are told by name.
    """
    said = labels.select("id", F.coalesce(tokens(F.col("label"), STOP), F.array().cast("array<string>")).alias("tokens"))
    said = said.withColumn("key", F.array_join("tokens", " "))
    own = said.where("key <> ''").select("key", "tokens").distinct()
    plain = F.filter("tokens", lambda w: ~w.isin(*IGNORED))
    own = own.withColumn("plain", plain).withColumn("read", F.when(F.size(plain) > 0, plain).otherwise(F.col("tokens")))
    index = variants(names).withColumnRenamed("tokens", "words").withColumn("name_key", F.array_join("words", " "))

    alias = own.join(aliases, "key").select("key", F.lit(0).alias("stage"), F.lit(0).alias("size"), "name")
    other = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    slugs = names.select(slug(F.col("name")).alias("slug"), "name")
    synonym = own.select("key", slug(other[F.col("key")]).alias("slug")).join(slugs, "slug").select("key", F.lit(1).alias("stage"), F.lit(0).alias("size"), "name")
    exact = own.join(index, F.col("key") == F.col("name_key")).select("key", F.lit(2).alias("stage"), F.lit(0).alias("size"), "name")

    word = F.explode(F.array_distinct("tokens")).alias("w")
    hits = own.select("key", "tokens", "plain", word).join(index.select("name", "place", "words", F.explode("words").alias("w")), "w")
    weight = F.when(F.col("w").isin(*WEAK), 1).otherwise(10)
    hits = hits.groupBy("key", "name", "place", "words", "tokens", "plain").agg(F.sum(weight).alias("score"))
    rest = F.array_except("tokens", "words")
    coloured = F.arrays_overlap("words", F.array(*map(F.lit, COLOUR)))
    describes = F.forall(rest, lambda w: w.rlike("^[0-9]+$") | w.isin(*IGNORED) | (w.isin(*COLOUR) & ~coloured))
    inside = hits.where((F.size(F.array_except("words", "tokens")) == 0) & describes).select("key", F.lit(3).alias("stage"), F.size("words").alias("size"), "name")
    partial = hits.where((F.size("plain") > 0) & (F.size(F.array_except("plain", "words")) == 0)).select("key", F.lit(4).alias("stage"), F.lit(0).alias("size"), "name")

    at = own.select("key", "read", F.posexplode("read").alias("i", "w"))
    there = index.select("name", "place", "words", F.posexplode("words").alias("i", "v"))
    alike = at.join(close_words(at.select("w").distinct(), there.select("v").distinct()), "w").join(there, ["i", "v"]).where(F.size("read") == F.size("words"))
    near = alike.groupBy("key", "name", "place", "read", "words").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == F.size("read")) & (F.col("read") != F.col("words")))
    near = near.select("key", F.lit(5).alias("stage"), F.lit(0).alias("size"), "name")

    found = alias.unionByName(synonym).unionByName(exact).unionByName(inside).unionByName(partial).unionByName(near)
    found = found.groupBy("key", "stage", "size").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    found = found.groupBy("key", "stage").agg(F.max_by(F.struct("name", "last"), "size").alias("x")).where("x.name = x.last")
    found = found.groupBy("key").agg(F.min_by(F.struct("stage", F.col("x.name").alias("name")), "stage").alias("x")).select("key", "x.stage", F.col("x.name").alias("ingredient"))

    best = hits.where("score >= 10").groupBy("key", "name").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "name"))).where("rank <= 5")
    best = best.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("shared"))

    out = said.select("id", "key").join(found, "key", "left").join(best, "key", "left")
    offered = F.when(F.col("stage") == 5, F.array("ingredient")).when(F.col("stage").isNull(), F.col("shared"))
    via = F.when(F.col("stage").isNotNull(), F.element_at(F.array(*map(F.lit, VIA)), F.col("stage") + 1))
    return out.select("id", "ingredient", via.alias("via"), F.coalesce(F.array_join(offered, "|"), F.lit("")).alias("candidates"))


def _frame(spark: SparkSession, rows: list[tuple], *columns: tuple[str, T.DataType]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in columns]))


def sheet_matches(spark: SparkSession, d: str) -> DataFrame:
    """The names that recipes' sheets are read to have, each once, and the parts that they name; what was learned of labels comes first."""
    texts = ingredient_lines.section_lines(rendered.sheets(spark, d), "recipe").select("text").distinct()  # orders repeat what they say: each text is read once
    read = kept(ingredient_lines.ingredients(texts).select("name").distinct())  # every stage of the matching reads them
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return match_labels(read.select(F.col("name").alias("id"), F.col("name").alias("label")), names, learned_aliases(spark, d).select("key", F.col("ingredient").alias("name")))


def part_labels(parts: DataFrame) -> DataFrame:
    """Labels made of part names: as they are, with a describing word, the last word alone, one letter wrong, with a colour of theirs, turned round."""
    name, words = F.col("p_name"), F.split("p_name", " ")
    kind = F.col("p_partkey") % 6
    label = F.when(kind == 0, name).when(kind == 1, F.concat(name, F.lit(" bio"))).when(kind == 2, F.element_at(words, -1)).when(kind == 3, F.concat(F.substring("p_name", 1, 2), F.lit("z"), F.substring("p_name", 4, 100)))
    return parts.select(F.col("p_partkey").alias("id"), label.when(kind == 4, F.concat(F.lit("rouge "), name)).otherwise(F.array_join(F.reverse(words), " ")).alias("label"))


def part_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every part's label matched to the names of parts."""
    parts = table(spark, d, "part")
    none = _frame(spark, [], ("key", T.StringType()), ("name", T.StringType()))
    return match_labels(part_labels(parts), parts.select(F.col("p_name").alias("name")).distinct(), none)


def learned_aliases(spark: SparkSession, d: str) -> DataFrame:
    """What confirmed matches teach: by the label's words the ingredient confirmed last and how often; not where they are the ingredient's own."""
    parts = table(spark, d, "part")
    seen = parts.select("p_partkey", F.col("p_name").alias("ingredient")).join(part_labels(parts), F.col("p_partkey") == F.col("id"))
    key = lambda c: F.array_join(tokens(F.col(c), STOP), " ")
    taught = seen.select("id", "ingredient", key("label").alias("key"), key("ingredient").alias("own")).where("key <> '' AND key <> own")
    return taught.groupBy("key").agg(F.max_by("ingredient", "id").alias("ingredient"), F.count(F.lit(1)).alias("hits"))


def broth_cubes(spark: SparkSession, d: str) -> DataFrame:
    """Broth as cubes of half a litre, by quarters, a quarter at least."""
    ml = F.col("l_quantity").cast("double") * 25
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("recipe")).agg(F.sum(F.greatest(F.ceil(ml / 500 * 4) / 4, F.lit(0.25))).alias("cubes"))


def _tokens_sql(x: str) -> str:
    words = f"list_filter(string_split(trim(regexp_replace({fold_sql(x)}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {STOP})"
    return f"list_transform({words}, lambda w: CASE WHEN length(w) > 3 AND regexp_matches(w, '[sx]$') THEN left(w, length(w) - 1) ELSE w END)"


def _slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({fold_sql(x)}, '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _match_sql(labels: str, names: str, aliases: str) -> str:
    """All labels against all names, stage by stage."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    synonyms = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in SYNONYMS.items())
    stages = ((2, "t = i"), (3, "contained"), (4, "len(p) > 0 AND list_has_all(i, p)"), (5, "len(i) = len(r) AND i <> r AND len(list_filter(range(1, len(r) + 1), lambda k: i[k] <> r[k] AND NOT (least(length(i[k]), length(r[k])) >= 5 AND levenshtein(i[k], r[k]) <= CASE WHEN least(length(i[k]), length(r[k])) >= 8 THEN 2 ELSE 1 END))) = 0"))
    return f"""WITH lab(id, label) AS ({labels}), nam(name) AS ({names}), ali(key, name) AS ({aliases}), syn(key, target) AS (VALUES {synonyms}),
      tok AS (SELECT id, coalesce({_tokens_sql('label')}, []) AS t FROM lab), red AS (SELECT *, array_to_string(t, ' ') AS key, list_filter(t, lambda w: w NOT IN {tuple(IGNORED)}) AS p FROM tok),
      own AS (SELECT *, CASE WHEN len(p) > 0 THEN p ELSE t END AS r FROM red),
      bare AS (SELECT name, trim(regexp_replace(name, '\\(.*?\\)', ' ', 'g')) AS b, replace(regexp_extract(name, '\\((.*?)\\)', 1), '…', '') AS c FROM nam),
      var AS (SELECT name, b AS v FROM bare UNION SELECT name, trim(unnest(string_split(b, ','))) FROM bare UNION SELECT name, trim(unnest(string_split(c, ','))) FROM bare),
      idx AS (SELECT name, {_tokens_sql('v')} AS i FROM var), pairs AS (SELECT own.*, idx.* FROM own, idx WHERE len(t) > 0 AND len(i) > 0),
      cmp AS (SELECT *, list_has_all(t, i) AND len(list_filter(t, lambda w: NOT list_contains(i, w) AND NOT (regexp_matches(w, '^[0-9]+$') OR w IN {tuple(IGNORED)} OR (w IN {tuple(COLOUR)} AND NOT list_has_any(i, {COLOUR}))))) = 0 AS contained,
        list_sum(list_transform(list_filter(i, lambda w: list_contains(t, w)), lambda w: CASE WHEN w IN {tuple(WEAK)} THEN 1 ELSE 10 END)) AS score FROM pairs),
      hit AS (SELECT id, 0 AS stage, 0 AS size, ali.name FROM own JOIN ali USING (key) UNION ALL SELECT id, 1, 0, nam.name FROM own JOIN syn USING (key) JOIN nam ON {_slug_sql('syn.target')} = {_slug_sql('nam.name')}
        {' '.join(f"UNION ALL SELECT id, {n}, {'len(i)' if n == 3 else 0}, name FROM cmp WHERE {test}" for n, test in stages)}),
      top AS (SELECT * FROM hit QUALIFY size = max(size) OVER (PARTITION BY id, stage)), one AS (SELECT id, stage, min(name) AS name FROM top GROUP BY ALL HAVING min(name) = max(name)),
      won AS (SELECT * FROM one QUALIFY stage = min(stage) OVER (PARTITION BY id)),
      ranked AS (SELECT id, name, max(score) AS score FROM cmp WHERE score >= 10 GROUP BY id, name QUALIFY row_number() OVER (PARTITION BY id ORDER BY max(score) DESC, name) <= 5),
      offer AS (SELECT id, string_agg(name, '|' ORDER BY score DESC, name) AS c FROM ranked GROUP BY id)
      SELECT id, won.name AS ingredient, {list(VIA)}[stage + 1] AS via, CASE WHEN stage = 5 THEN won.name WHEN stage IS NULL THEN coalesce(c, '') ELSE '' END AS candidates FROM own LEFT JOIN won USING (id) LEFT JOIN offer USING (id)"""


PART_LABELS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' bio' WHEN 2 THEN string_split(p_name, ' ')[-1] WHEN 3 THEN left(p_name, 2) || 'z' || substr(p_name, 4)
  WHEN 4 THEN 'rouge ' || p_name ELSE array_to_string(list_reverse(string_split(p_name, ' ')), ' ') END AS label FROM part"""
_LEARNED_SQL = f"""WITH l AS ({PART_LABELS}), k AS (SELECT id, p_name, array_to_string({_tokens_sql('label')}, ' ') AS key, array_to_string({_tokens_sql('p_name')}, ' ') AS own FROM l JOIN part ON p_partkey = id)
      SELECT key, arg_max(p_name, id) AS ingredient, count(*) AS hits FROM k WHERE key <> '' AND key <> own GROUP BY key"""
QUERIES = {f.__name__: f for f in (sheet_matches, part_matches, learned_aliases, broth_cubes)}
SQL = {
    "sheet_matches": _match_sql(f"SELECT DISTINCT name, name FROM ({ingredient_lines.SQL['sheet_ingredients']})", "SELECT DISTINCT p_name FROM part", f"SELECT key, ingredient FROM ({_LEARNED_SQL})"),
    "part_matches": _match_sql(PART_LABELS, "SELECT DISTINCT p_name FROM part", "SELECT '', '' WHERE false"),
    "learned_aliases": _LEARNED_SQL,
    "broth_cubes": "SELECT l_orderkey AS recipe, sum(greatest(ceil(l_quantity::DOUBLE * 25 / 500 * 4) / 4, 0.25)) AS cubes FROM lineitem GROUP BY 1",
}
