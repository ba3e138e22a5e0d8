"""Steps of a recipe's preparation, by the first of five layouts that fits, and the advice printed beside them.

The layout says which lines begin a step; lines from one of these to the next are its block. Numbers must come in order, so they are found by a fold over the lines that bear one; where a number stands in the middle of its step, a second fold over the blocks finds where one step ends and the next begins, as the place of each number depends on the length of what precedes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources import rendered

# fixed values: signs and words of numbered steps
OPEN, CLOSE = '^[«“"]', '[»”"]$'
BULLET = r"^[•·▪●■◦\-–—*]\s*"
NAMED = r"(?:[éÉe]tape|step)\s*"
SENTENCE_END, STEP_START = "[.!?;:)»]$", r'^[\p{Lu}\p{Nd}«"]'
LEFT_OUT = "Du texte suit la dernière étape : il a été laissé de côté, à vérifier."
UNSURE = "Découpage incertain avant l'étape {} : à vérifier."
ONE_BLOCK = "Étapes non numérotées : le texte est gardé en un seul bloc, à découper si besoin."
NO_STEPS = "Aucune étape reconnue dans la fiche."

NL = "\n"


def _cut(xs: Column, start: Column, stop: Column) -> Column:
    """Elements from `start` up to before `stop`, counted from 0."""
    return F.slice(xs, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def _where(xs: Column, test) -> Column:
    """Where the first element that passes stands; -1 without one."""
    return (F.array_position(F.transform(xs, test), True) - 1).cast("int")


def _places(xs: Column, test) -> Column:
    """Where all elements that pass stand."""
    return F.filter(F.transform(xs, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def _full(xs: Column) -> Column:
    return F.filter(xs, lambda x: x != "")


def _until_blank(text: Column) -> Column:
    return F.substring_index(F.concat(F.lit(NL), text), NL + NL, 1)


def _first_paragraph(text: Column) -> Column:
    return _until_blank(F.regexp_replace(text, r"^\n+", ""))


def _bare(text: Column) -> Column:
    return F.replace(text, F.lit(NL), F.lit(""))


def joined(text: Column) -> Column:
    """Lines as one: by a space, or by nothing where a word's part after a hyphen goes on below."""
    text = F.regexp_replace(F.regexp_replace(text, r"^\n+|\n+$", ""), r"\n+", NL)
    return F.trim(F.replace(F.regexp_replace(text, r"(?<=\p{L}-)\n(?=\p{Ll})", ""), F.lit(NL), F.lit(" ")))


def _numbered(lines: Column, exact: str, loose: str | None = None) -> Column:
    """Where the lines numbered 1, 2, 3, ... stand, each the first after the one before. `exact` finds a line's number; of what `loose` finds, the number need only be the beginning."""
    of = lambda p, x: F.regexp_extract(x, p, 1) if p else F.lit("")
    found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), of(exact, x).alias("exact"), of(loose, x).alias("loose"))), lambda s: (s["exact"] != "") | (s["loose"] != ""))
    none = F.struct(F.lit(1).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, s: Column) -> Column:
        n = state["n"].cast("string")
        hit = (s["exact"] == n) | ((s["loose"] != "") & F.startswith(s["loose"], n))
        return F.when(hit, F.struct((state["n"] + 1).alias("n"), F.concat(state["at"], F.array(s["i"])).alias("at"))).otherwise(state)

    return F.aggregate(found, none, step, lambda state: state["at"])


def _without_quote(texts: DataFrame) -> DataFrame:
    """`flow`, the lines without the quoted advice among them, and `quoted`, its lines. A numbered line, or one that ends a sentence before a line that goes on in lower case, is a step's though it stands within."""
    start = F.col("start")
    out = texts.withColumn("start", _where(F.col("lines"), lambda x: x.rlike(OPEN)))
    out = out.withColumn("stop", F.when(start >= 0, start + _where(_cut(F.col("lines"), start, F.size("lines")), lambda x: x.rlike(CLOSE)))).withColumn("stop", F.when(F.col("stop") >= start, F.col("stop")))
    # where no line from the opening on closes, stop is start - 1 and so null
    out = out.withColumn("inside", F.when(F.col("stop").isNotNull(), _full(_cut(F.col("lines"), start, F.col("stop") + 1))).otherwise(F.array().cast("array<string>")))

    def of_step(x: Column, i: Column) -> Column:
        after = F.get(F.col("inside"), i + 1)
        return (i > 0) & (x.rlike(r"^\p{Nd}{1,2}\s+\S") | (after.isNotNull() & x.rlike("[.!?]$") & F.coalesce(after, F.lit("")).rlike(r"^\p{Ll}")))

    marked = F.transform("inside", lambda x, i: F.struct(x.alias("x"), of_step(x, i).alias("own")))
    out = out.withColumn("marked", marked)
    mine = lambda own: F.transform(F.filter("marked", lambda s: s["own"] == own), lambda s: s["x"])
    out = out.withColumn("quoted", mine(False)).withColumn("flow", F.when(F.col("stop").isNull(), F.col("lines")).otherwise(F.concat(_cut(F.col("lines"), F.lit(0), start), mine(True), _cut(F.col("lines"), F.col("stop") + 1, F.size("lines")))))
    first, last = _where(F.col("flow"), lambda x: x != ""), _where(F.reverse("flow"), lambda x: x != "")
    return out.withColumn("flow", F.when(first < 0, F.array().cast("array<string>")).otherwise(_cut(F.col("flow"), first, F.size("flow") - last)))


def _in_the_middle(texts: DataFrame) -> DataFrame:
    """`heads` and `tails`: the lines of each step before and after its number's line, `unsure`: the blocks that were cut by guess, `over`: whether the last had more lines than its place allows."""
    before = F.when(F.col("layout") == "middle", _full(_cut(F.col("flow"), F.lit(0), F.get("at", F.lit(0))))).otherwise(F.array().cast("array<string>"))
    out = texts.withColumn("before", before)

    def gap(m: Column, k: Column) -> Column:
        lines = _cut(F.col("flow"), m + 1, F.get(F.col("at"), k + 1))
        after = F.regexp_replace(F.get(F.col("flow"), F.get(F.col("at"), k + 1)), r"^[0-9]+\s+", "")
        return F.struct(lines.alias("lines"), after.alias("after"))

    centred = (F.col("layout") == "middle") & (F.size("before") > 0)
    out = out.withColumn("gaps", F.when(centred, F.transform(F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), gap)))

    def measured(g: Column) -> Column:
        n, lines = F.size(g["lines"]), g["lines"]
        fits = F.filter(F.sequence(F.lit(0), n), lambda j: ((j == 0) | F.coalesce(F.get(lines, j - 1), F.lit("")).rlike(SENTENCE_END)) & F.coalesce(F.get(lines, j), g["after"]).rlike(STEP_START))
        first, back = _where(lines, lambda x: x == ""), _where(F.reverse(lines), lambda x: x == "")
        last = F.when(first >= 0, n - 1 - back)
        between = F.exists(_cut(lines, first, last), lambda x: x != "")
        return F.struct(lines.alias("lines"), n.alias("n"), fits.alias("fits"), last.alias("blank"), (last.isNotNull() & F.coalesce(between, F.lit(False))).alias("between"))

    out = out.withColumn("gaps", F.transform("gaps", measured))
    none = F.struct(F.size("before").alias("above"), F.array().cast("array<struct<cut:int,unsure:boolean>>").alias("cuts"))

    def cut(state: Column, g: Column) -> Column:
        above = state["above"]
        known = F.when(g["blank"].isNotNull(), g["blank"]).when(F.array_contains(g["fits"], above), above).when(F.array_contains(g["fits"], above - 1), above - 1).when(F.size(g["fits"]) == 1, F.get(g["fits"], F.lit(0)))
        at = F.coalesce(known, F.least(g["n"], above))
        return F.struct((g["n"] - at - F.when(g["blank"].isNotNull(), 1).otherwise(0)).alias("above"), F.concat(state["cuts"], F.array(F.struct(at.cast("int").alias("cut"), (known.isNull() | g["between"]).alias("unsure")))).alias("cuts"))

    out = out.withColumn("cuts", F.aggregate("gaps", none, cut, lambda s: s["cuts"]))
    sides = F.zip_with("gaps", "cuts", lambda g, c: F.struct(F.array_join(_cut(g["lines"], F.lit(0), c["cut"]), NL).alias("tail"), _full(_cut(g["lines"], c["cut"], g["n"])).alias("head")))
    out = out.withColumn("sides", sides).withColumn("heads", F.concat(F.array("before"), F.transform("sides", lambda s: s["head"])))
    rest = F.split(F.regexp_replace(_until_blank(F.element_at("blocks", -1)["rest"]), r"^\n", ""), NL)
    out = out.withColumn("rest", F.when(centred, _full(rest))).withColumn("room", F.size(F.element_at("heads", -1)))
    out = out.withColumn("over", F.coalesce(F.size("rest") > F.col("room"), F.lit(False)))
    last = F.array_join(_cut(F.col("rest"), F.lit(0), F.least(F.size("rest"), F.col("room"))), NL)
    return out.withColumn("tails", F.concat(F.transform("sides", lambda s: s["tail"]), F.array(last))).withColumn("unsure", _places(F.col("cuts"), lambda c, i: c["unsure"]))


def steps(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, layout, steps (array), tip and issues (array) of each preparation: number alone on its line, before its step ('1.', 'Étape 1'), in the middle of its step, bullets, or paragraphs. A null or blank text has none, and says so in issues. Lines of a text stay in its row; the work is linear in them, and in the square of the number of steps."""
    out = texts.select(by, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), NL), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")).alias("lines"))
    out = _without_quote(out)
    flow = F.col("flow")
    out = out.withColumn("alone", _numbered(flow, "^([0-9]+)$")).withColumn("prefixed", _numbered(flow, r"^([0-9]+)\s*[.):–-]\s+", rf"(?i)^{NAMED}([0-9]+)")).withColumn("middle", _numbered(flow, r"^([0-9]+)\s+\S"))
    out = out.withColumn("bullets", _places(flow, lambda x, i: x.rlike(BULLET))).withColumn("paragraphs", _places(flow, lambda x, i: (x != "") & ((i == 0) | (F.get(flow, i - 1) == ""))))
    layout, at = F.lit("none"), F.array().cast("array<int>")
    for name, least in (("paragraphs", 1), ("bullets", 2), ("middle", 2), ("prefixed", 2), ("alone", 2)):
        layout, at = F.when(F.size(name) >= least, name).otherwise(layout), F.when(F.size(name) >= least, F.col(name)).otherwise(at)
    out = out.withColumn("layout", layout).withColumn("at", at)
    block = lambda m, k: F.struct(F.get(flow, m).alias("line"), F.array_join(_cut(flow, m + 1, F.coalesce(F.get(F.col("at"), k + 1), F.size(flow))), NL).alias("rest"), (k == F.size("at") - 1).alias("last"), (k + 1).cast("string").alias("n"))
    out = out.withColumn("blocks", F.transform("at", block))
    out = _in_the_middle(out)

    def without_number(b: Column) -> Column:
        named = F.concat(F.lit(f"(?i)^{NAMED}"), b["n"], F.lit(r"\s*[:.–)-]?\s*"))
        return F.when(b["line"].rlike(rf"(?i)^{NAMED}[0-9]"), F.regexp_replace(b["line"], named, "")).otherwise(F.regexp_replace(b["line"], r"^[0-9]+\s*[.):–-]?\s*", ""))

    lay = F.col("layout")
    own = F.transform("blocks", lambda b: F.when(lay == "alone", "").when(lay == "prefixed", without_number(b)).when(lay == "middle", F.regexp_replace(b["line"], r"^[0-9]+\s+", "")).when(lay == "bullets", F.regexp_replace(b["line"], BULLET, "")).otherwise(b["line"]))
    out = out.withColumn("own", own)
    ends = lambda b, x: F.when((lay == "alone") | ((lay == "prefixed") & b["last"] & (x == "")), _first_paragraph(b["rest"])).when(lay.isin("prefixed", "middle") & b["last"], _until_blank(b["rest"])).otherwise(b["rest"])
    out = out.withColumn("taken", F.zip_with("blocks", "own", ends))
    centred = F.transform("own", lambda x, k: F.concat_ws(NL, F.get(F.col("heads"), k), x, F.get(F.col("tails"), k)))
    plain = F.zip_with("own", "taken", lambda x, t: F.concat_ws(NL, x, t))
    raw = F.when(F.col("gaps").isNotNull(), centred).otherwise(plain)
    left = (lay == "prefixed") & (F.length(_bare(F.element_at("blocks", -1)["rest"])) > F.length(_bare(F.element_at("taken", -1))))
    one = (lay == "paragraphs") & (F.size("blocks") == 1) & (F.size(flow) > 3)
    said = F.array(F.when(left | F.col("over"), LEFT_OUT), F.when(one, ONE_BLOCK), F.when(lay == "none", NO_STEPS))
    guessed = F.transform(F.coalesce("unsure", F.array().cast("array<int>")), lambda k: F.concat(F.lit(UNSURE.split("{}")[0]), (k + 1).cast("string"), F.lit(UNSURE.split("{}")[1])))
    tip = F.when(F.size("quoted") > 0, F.regexp_replace(joined(F.array_join("quoted", NL)), r"^[«“\"]\s*|\s*[»”\"]$", ""))
    return out.select(by, "layout", _full(F.transform(raw, joined)).alias("steps"), tip.alias("tip"), F.filter(F.concat(guessed, said), lambda x: x.isNotNull()).alias("issues"))


def recipe_steps(spark: SparkSession, d: str) -> DataFrame:
    """recipe, layout, n_steps, steps, tip, issues of every order's preparation."""
    out = steps(rendered.preparations(spark, d), "recipe")
    return out.select("recipe", "layout", F.size("steps").cast("long").alias("n_steps"), F.array_join("steps", "|").alias("steps"), "tip", F.array_join("issues", "|").alias("issues"))


def _p(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ORDER = "PARTITION BY recipe ORDER BY pos"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_JOINED = "list_reduce(list_filter({}, lambda t: t <> ''), lambda a, b: a || CASE WHEN regexp_matches(a, '\\p{{L}}-$') AND regexp_matches(b, '^\\p{{Ll}}') THEN '' ELSE ' ' END || b)"
#: SQL over rows of lines: markers and the cuts between them by recursion, blocks by windows.
SQL = {
    "recipe_steps": rf"""WITH RECURSIVE {rendered.PREPARATIONS},
l0 AS (SELECT recipe, pos, {_STRIP.format('x')} AS x FROM (SELECT recipe, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM (SELECT recipe, string_split(text, chr(10)) AS s FROM preparations))),
q0 AS (SELECT recipe, min(pos) AS s FROM l0 WHERE regexp_matches(x, {_p(OPEN)}) GROUP BY recipe),
q1 AS (SELECT recipe, s, min(pos) AS e FROM l0 JOIN q0 USING (recipe) WHERE pos >= s AND regexp_matches(x, {_p(CLOSE)}) GROUP BY recipe, s),
in0 AS (SELECT recipe, pos, x, pos > s AND (regexp_matches(x, '^\d{{1,2}}\s+\S') OR (regexp_matches(x, '[.!?]$') AND coalesce(regexp_matches(lead(x) OVER (PARTITION BY recipe ORDER BY pos), '^\p{{Ll}}'), false))) AS own FROM l0 JOIN q1 USING (recipe) WHERE pos BETWEEN s AND e AND x <> ''),
tips AS (SELECT recipe, regexp_replace({_JOINED.format('list(x ORDER BY pos)')}, '^[«“"]\s*|\s*[»”"]$', '', 'g') AS tip FROM in0 WHERE NOT own GROUP BY recipe),
f0 AS (SELECT recipe, pos, x FROM l0 LEFT JOIN q1 USING (recipe) WHERE e IS NULL OR pos NOT BETWEEN s AND e UNION ALL SELECT recipe, pos, x FROM in0 WHERE own),
f1 AS (SELECT *, min(pos) FILTER (x <> '') OVER (PARTITION BY recipe) AS a, max(pos) FILTER (x <> '') OVER (PARTITION BY recipe) AS z FROM f0),
f AS (SELECT recipe, row_number() OVER ({_ORDER}) AS pos, x, coalesce(lag(x) OVER ({_ORDER}), '') = '' AS starts FROM f1 WHERE pos BETWEEN a AND z),
bears AS (SELECT recipe, pos, x FROM f WHERE regexp_matches(x, '[0-9]')),
lays AS (SELECT * FROM (VALUES ('alone'), ('prefixed'), ('middle')) AS v(lay)),
numbers AS (
  SELECT recipe, lay, 0 AS n, 0::BIGINT AS pos FROM (SELECT DISTINCT recipe FROM bears), lays
  UNION ALL
  SELECT p.recipe, lay, p.n + 1, min(b.pos) FROM numbers p JOIN bears b ON b.recipe = p.recipe AND b.pos > p.pos AND CASE lay WHEN 'alone' THEN b.x = (p.n + 1)::VARCHAR
    WHEN 'middle' THEN regexp_matches(b.x, '^' || (p.n + 1) || '\s+\S') ELSE regexp_matches(b.x, '(?i)^(?:[éÉe]tape|step)\s*' || (p.n + 1)) OR regexp_matches(b.x, '^' || (p.n + 1) || '\s*[.):–-]\s+') END GROUP BY p.recipe, lay, p.n),
marks AS (
  SELECT recipe, lay, pos FROM numbers WHERE n > 0
  UNION ALL SELECT recipe, 'bullets', pos FROM f WHERE regexp_matches(x, {_p(BULLET)})
  UNION ALL SELECT recipe, 'paragraphs', pos FROM f WHERE x <> '' AND starts),
fits AS (SELECT recipe, arg_min(lay, list_position(['alone', 'prefixed', 'middle', 'bullets', 'paragraphs'], lay)) AS layout FROM (SELECT recipe, lay FROM marks GROUP BY recipe, lay HAVING count(*) >= CASE lay WHEN 'paragraphs' THEN 1 ELSE 2 END) GROUP BY recipe),
b0 AS (SELECT f.*, layout, m.pos IS NOT NULL AS mark, count(m.pos) OVER (PARTITION BY f.recipe ORDER BY f.pos) AS k, count(m.pos) OVER (PARTITION BY f.recipe) AS many FROM f JOIN fits USING (recipe) LEFT JOIN marks m ON m.recipe = f.recipe AND m.lay = layout AND m.pos = f.pos),
b1 AS (SELECT *, CASE WHEN NOT mark THEN x ELSE CASE layout WHEN 'alone' THEN '' WHEN 'prefixed' THEN CASE WHEN regexp_matches(x, '(?i)^{NAMED}[0-9]') THEN regexp_replace(x, '(?i)^{NAMED}' || k || '\s*[:.–)-]?\s*', '') ELSE regexp_replace(x, '^[0-9]+\s*[.):–-]?\s*', '') END
   WHEN 'middle' THEN regexp_replace(x, '^[0-9]+\s+', '') WHEN 'bullets' THEN regexp_replace(x, {_p(BULLET)}, '') ELSE x END END AS t FROM b0),
b2 AS (SELECT *, first_value(t) OVER w AS own, count(*) FILTER (x = '') OVER w AS blanks, count(*) FILTER (NOT mark AND x <> '' AND (lag_mark OR starts)) OVER w AS para FROM (SELECT *, coalesce(lag(mark) OVER ({_ORDER}), false) AS lag_mark FROM b1) WINDOW w AS (PARTITION BY recipe, k ORDER BY pos)),
centred AS (SELECT recipe, count(*) AS above, any_value(many) AS many FROM b2 WHERE layout = 'middle' AND k = 0 AND x <> '' GROUP BY recipe),
g0 AS (SELECT recipe, k, list(x ORDER BY pos) FILTER (NOT mark) AS xs, lead(first(t ORDER BY pos)) OVER (PARTITION BY recipe ORDER BY k) AS after FROM b2 WHERE layout = 'middle' AND k > 0 GROUP BY recipe, k),
g1 AS (SELECT recipe, k, coalesce(xs, []) AS xs, len(coalesce(xs, [])) AS n, after FROM g0),
g AS (SELECT *, list_filter(range(0, n + 1), lambda j: (j = 0 OR regexp_matches(coalesce(xs[j], ''), {_p(SENTENCE_END)})) AND regexp_matches(coalesce(xs[j + 1], after), '^[\p{{Lu}}\d«"]')) AS fits, list_position(xs, '') AS first_blank, n + 1 - list_position(list_reverse(xs), '') AS last_blank FROM g1),
c AS (
  SELECT recipe, 1 AS k, above, 0::BIGINT AS cut, false AS unsure FROM centred
  UNION ALL
  SELECT recipe, c.k + 1, g.n - place - (last_blank IS NOT NULL)::INT, place, known IS NULL OR (last_blank IS NOT NULL AND last_blank > first_blank AND len(list_filter(xs[first_blank:last_blank], lambda x: x <> '')) > 0)
  FROM c JOIN g USING (recipe, k) JOIN centred USING (recipe),
    LATERAL (SELECT CASE WHEN last_blank IS NOT NULL THEN last_blank - 1 WHEN list_contains(fits, c.above) THEN c.above WHEN list_contains(fits, c.above - 1) THEN c.above - 1 WHEN len(fits) = 1 THEN fits[1] END AS known), LATERAL (SELECT coalesce(known, least(g.n, c.above)) AS place)
  WHERE c.k < many),
d0 AS (SELECT b2.*, cc.cut, ce.recipe IS NOT NULL AS mid, own.above AS room, row_number() OVER (PARTITION BY b2.recipe, b2.k ORDER BY b2.pos) - 1 AS nth FROM b2 LEFT JOIN centred ce ON ce.recipe = b2.recipe LEFT JOIN c cc ON cc.recipe = b2.recipe AND cc.k = b2.k + 1 AND b2.k > 0 LEFT JOIN c own ON own.recipe = b2.recipe AND own.k = b2.k),
d1 AS (SELECT *, CASE WHEN mark THEN k WHEN mid AND k = 0 THEN 1 WHEN mid AND k < many THEN CASE WHEN nth <= cut THEN k ELSE k + 1 END
   WHEN k = 0 THEN NULL WHEN layout = 'alone' THEN CASE WHEN para = 1 AND x <> '' AND blanks = min(blanks) FILTER (para = 1 AND x <> '') OVER (PARTITION BY recipe, k) THEN k END WHEN layout IN ('bullets', 'paragraphs') OR k < many THEN k
   WHEN mid THEN CASE WHEN blanks = 0 AND nth <= room THEN k END WHEN layout = 'prefixed' AND own = '' THEN CASE WHEN para = 1 AND x <> '' THEN k END ELSE CASE WHEN blanks = 0 THEN k END END AS step FROM d0),
said AS (SELECT recipe, list(replace({_p(UNSURE)}, '{{}}', (k - 1)::VARCHAR) ORDER BY k) AS guesses FROM c WHERE unsure GROUP BY recipe),
over AS (SELECT recipe, any_value(layout) AS layout, bool_or(k = many AND NOT mark AND x <> '' AND step IS NULL AND (layout = 'prefixed' OR (mid AND blanks = 0))) AS over, bool_and(many = 1) AND count(*) > 3 AND any_value(layout) = 'paragraphs' AS one FROM d1 GROUP BY recipe),
s0 AS (SELECT recipe, step, {_JOINED.format('list(t ORDER BY pos)')} AS t FROM d1 WHERE step IS NOT NULL GROUP BY recipe, step),
s1 AS (SELECT recipe, count(*) AS n, string_agg(t, '|' ORDER BY step) AS steps FROM s0 WHERE coalesce(t, '') <> '' GROUP BY recipe)
SELECT p.recipe, coalesce(layout, 'none') AS layout, coalesce(n, 0) AS n_steps, coalesce(steps, '') AS steps, tip, array_to_string(list_filter(list_concat(coalesce(guesses, []), [CASE WHEN over THEN {_p(LEFT_OUT)} END, CASE WHEN one THEN {_p(ONE_BLOCK)} END, CASE WHEN layout IS NULL THEN {_p(NO_STEPS)} END]), lambda x: x IS NOT NULL), '|') AS issues
FROM preparations p LEFT JOIN over USING (recipe) LEFT JOIN s1 USING (recipe) LEFT JOIN tips USING (recipe) LEFT JOIN said USING (recipe)"""
}
QUERIES = {"recipe_steps": recipe_steps}
