"""Recipe sheets of two columns, ingredients and steps, whose lines were read across both: put back in order.

Whether a line's end belongs to the right column may hang on whether what stands there so far is a whole sentence. A line either settles that itself or leaves it as it is, so the state before a line is the last settled one: a window within the text, as are the numbers of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions.text import fold, fold_sql
from larder.sources import rendered

# fixed values: signs and words of French recipe sheets
HEADING = "^(?:les )?ingredients? (?:la )?(?:recette|preparation|realisation|etapes?)$"
BULLET = r"^(?:[e•·°*©‘'o\-–]|\?\?)\s+"
MARKER = r"(?:[EÉ]tape\s*[0-9]{1,2}|[EÉ]tap\p{L}{0,3}(?:\s*[0-9]{1,2})?)"
LINKS = ("la", "le", "les", "des", "du", "un", "une", "puis", "et", "dans", "en", "au", "aux", "a", "à", "sur", "avec", "pour", "ou", "jusqu", "sans", "pendant")
MEASURES = r"^(?:[0-9]+(?:[.,][0-9]+)?[\p{L}]{0,3}|[0-9/½¼¾]+|g|gr|kg|cl|ci|ml|dl|l|cs|cc|c\.|de|d['’]\S*|pinc[ée]es?|cuill\S*)$"
LEFT, RIGHT = "Les ingrédients", "La recette"

NOISE, STRAY = r"^[^\p{L}\p{N}]{1,3}$", r"^[:;|,.‘'`]+\s+"
MARKED = rf"^(.+?)\s+({MARKER})(?:\s+(.+))?$"
UNREAD = r"^(.+?)\s+(\p{Lu}\p{Ll}{3,8})$"
OPEN_END = r"(?:^|\s)(?:de|d['’]|du|des|à|au|aux|et)$"
COUNTED, CAPITAL, ELIDED, STOP, LAST_WORD = "^[0-9½¼¾]", r"^\p{Lu}\p{Ll}+", "^(?:l|d|qu|j|s|n)['’]", "[.!?:]$", r"^\S+[.!?]$"


def _sentence(words: Column, first: Column, left: Column) -> Column:
    return first.rlike(CAPITAL) & (left >= 4)


def _unfinished(x: Column) -> Column:
    """Whether the right column's sentence goes on after x."""
    return (x != "") & ~x.rlike(f"^{MARKER}$") & ~x.rlike(STOP)


def cut_lines(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, pos, own (the line, before the heading of both columns), ingredient, right and guess (a step's number stands there, unread) of each line of texts that have that heading, and one empty row at least of each text. Lines without letters go."""
    rows = texts.select(by, F.posexplode_outer(F.split(text, "\n")).alias("pos", "raw")).withColumn("x", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(fold(F.col("x")), "[^a-z ]", " "), r"\s+", " "))
    rows = rows.withColumn("heading", F.min(F.when(plain.rlike(HEADING), F.col("pos"))).over(W.partitionBy(by)))
    live = F.coalesce(F.col("pos") != F.col("heading"), F.lit(False))
    rows = rows.withColumn("head", F.coalesce(F.col("pos") < F.col("heading"), F.lit(False))).withColumn("live", live & (F.col("head") | ((F.col("x") != "") & ~F.col("x").rlike(NOISE)))).where(F.col("live") | (F.coalesce("pos", F.lit(0)) == 0))
    head = F.col("head")
    rows = rows.withColumn("own", F.when(head, F.col("raw")))
    x, rest, words = F.col("x"), F.col("rest"), F.col("words")
    rows = rows.withColumn("bullet", ~head & x.rlike(BULLET)).withColumn("rest", F.when(F.col("bullet"), F.regexp_replace("x", BULLET, ""))).withColumn("words", F.split("rest", r"\s+"))
    counted, n = rest.rlike(COUNTED), F.size("words")
    whole = ~counted & _sentence(words, rest, n)
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False)))
    first_name = F.array_position(F.transform("words", lambda w: ~w.rlike("(?iu)" + MEASURES)), True).cast("int")
    least = F.when(~counted, 1).when(first_name > 0, first_name).otherwise(n)

    def turns(w: Column, k: Column, open_: bool) -> Column:
        low = F.lower(w)
        link = (low.isin(*LINKS) | low.rlike(ELIDED)) & (F.lit(open_) | rest.rlike(STOP))
        ends = lambda i: F.coalesce(F.get(words, i).rlike(LAST_WORD), F.lit(False))
        return (k >= F.col("least")) & (link | ends(k) | ends(k + 1) | ends(k + 2) | _sentence(words, w, n - k))

    rows = rows.withColumn("least", least)
    at = lambda open_: F.array_position(F.transform("words", lambda w, k: turns(w, k, open_)), True).cast("int") - 1
    marked = rest.rlike(MARKED)
    unread = ~marked & rest.rlike(UNREAD) & F.regexp_extract("rest", UNREAD, 1).rlike(r"\p{L}") & ~F.regexp_extract("rest", UNREAD, 1).rlike("(?iu)" + OPEN_END)
    rows = rows.withColumn("how", F.when(~F.col("live"), None).when(head, "head").when(~F.col("bullet") | F.col("whole"), "right").when(marked, "marked").when(unread, "unread").otherwise("words"))
    rows = rows.withColumn("closed", F.when(F.col("how") == "words", at(False))).withColumn("opened", F.when(F.col("how") == "words", at(True)))
    straight = F.when(F.col("bullet"), rest).otherwise(F.regexp_replace("x", STRAY, ""))
    beyond = F.regexp_extract("rest", MARKED, 3)
    settles = F.when(F.col("how") == "right", _unfinished(straight)).when(F.col("how") == "marked", _unfinished(beyond)).when(F.col("how") == "unread", F.lit(False)).when(F.col("closed") >= 0, _unfinished(rest))
    before = W.partitionBy(by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.coalesce(F.last(settles, ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumn("k", F.when(F.col("open"), F.col("opened")).otherwise(F.col("closed")))
    part = lambda start, many: F.array_join(F.slice("words", start, many), " ")
    how = F.col("how")
    item = F.when(how == "marked", F.regexp_extract("rest", MARKED, 1)).when(how == "unread", F.regexp_extract("rest", UNREAD, 1)).when(F.col("k") >= 0, part(F.lit(1), F.col("k"))).when(how == "words", rest)
    mark = F.regexp_extract("rest", MARKED, 2)
    right = F.when(how == "right", F.array(straight)).when(how == "marked", F.filter(F.array(mark, beyond), lambda p: p != "")).when(how == "unread", F.array(F.lit(""))).when(F.col("k") >= 0, F.array(part(F.col("k") + 1, n)))
    return rows.select(by, "pos", "own", item.alias("ingredient"), right.alias("right"), (how == "unread").alias("guess"))


def split_columns(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, text: each text with its two columns one after the other and its steps numbered in order (a number that can't be read follows the one before); null where a text is null, has no heading of two columns, or has nothing in one of them."""
    lines = cut_lines(texts, by, text)
    parts = lines.select(by, "pos", "own", "ingredient", "guess", F.posexplode_outer("right").alias("part", "x")).withColumn("part", F.coalesce("part", F.lit(0)))
    order = W.partitionBy(by).orderBy("pos", "part")
    marks = F.coalesce(F.col("guess") | F.col("x").rlike(f"^{MARKER}$"), F.lit(False))
    parts = parts.withColumn("mark", marks).withColumn("nth", F.sum(F.col("mark").cast("int")).over(order))
    read = F.when(F.col("mark"), F.regexp_extract("x", r"([0-9]{1,2})$", 1).try_cast("int"))
    parts = parts.withColumn("read", read).withColumn("base", F.coalesce(F.last(F.when(F.col("read").isNotNull(), F.col("read") - F.col("nth")), ignorenulls=True).over(order), F.lit(0)))
    shown = F.when(F.col("mark"), F.concat(F.lit("\nEtape "), (F.col("base") + F.col("nth")).cast("string"))).otherwise(F.col("x"))
    in_order = lambda *at, x: F.transform(F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(*at, x.alias("x"))))), lambda s: s["x"])
    first = F.col("part") == 0
    one = parts.groupBy(by).agg(
        in_order("pos", x=F.when(first, F.col("own"))).alias("head"), in_order("pos", x=F.when(first, F.concat(F.lit("- "), F.col("ingredient")))).alias("left"), in_order("pos", "part", x=shown).alias("right"),
    )
    whole = F.array_join(F.concat("head", F.array(F.lit(""), F.lit(LEFT)), "left", F.array(F.lit(""), F.lit(RIGHT)), "right"), "\n")
    return one.select(by, F.when((F.size("left") > 0) & (F.size("right") > 0), whole).alias("text"))


def recipe_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every order's sheet of two columns, put in order."""
    return split_columns(rendered.two_columns(spark, d), "recipe")


def _p(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_p(pattern)})"


def _x(pattern: str, group: int) -> str:
    return f"regexp_extract(rest, {_p(pattern)}, {group})"


def _open_sql(x: str) -> str:
    return f"({x} <> '' AND NOT {_m(x, f'^{MARKER}$')} AND NOT {_m(x, STOP)})"


_LINK = f"(lower(words[k]) IN ({', '.join(map(_p, LINKS))}) OR {_m('lower(words[k])', ELIDED)})"
_TAIL = "array_to_string(words[k:], ' ')"
#: SQL line by line: whether a sentence is open is carried along by recursion; a line's end is tried word by word.
SQL = {
    "recipe_columns": rf"""WITH RECURSIVE {rendered.TWO_COLUMNS},
l0 AS (SELECT recipe, pos, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM (SELECT recipe, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM (SELECT recipe, string_split(text, chr(10)) AS s FROM two_columns))),
h AS (SELECT recipe, min(pos) AS at_line FROM l0 WHERE {_m(rf"trim(regexp_replace(regexp_replace({fold_sql('x')}, '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g'))", HEADING)} GROUP BY recipe),
heads AS (SELECT recipe, string_agg(raw, chr(10) ORDER BY pos) AS head FROM l0 JOIN h USING (recipe) WHERE pos < at_line GROUP BY recipe),
l1 AS (SELECT recipe, row_number() OVER (PARTITION BY recipe ORDER BY pos) AS n, x, {_m('x', BULLET)} AS bullet, regexp_replace(x, {_p(BULLET)}, '') AS rest FROM l0 JOIN h USING (recipe) WHERE pos > at_line AND x <> '' AND NOT {_m('x', NOISE)}),
l2 AS (SELECT *, regexp_split_to_array(rest, '\s+') AS words FROM l1),
l3 AS (SELECT *, CASE WHEN NOT bullet OR (NOT {_m('rest', COUNTED)} AND {_m('rest', CAPITAL)} AND len(words) >= 4) THEN 'right' WHEN {_m('rest', MARKED)} THEN 'marked'
  WHEN {_m('rest', UNREAD)} AND {_m(_x(UNREAD, 1), r'\p{L}')} AND NOT {_m(_x(UNREAD, 1), '(?i)' + OPEN_END)} THEN 'unread' ELSE 'words' END AS how,
  CASE WHEN {_m('rest', COUNTED)} THEN coalesce(list_min(list_filter(range(1, len(words) + 1), lambda i: NOT {_m('words[i]', '(?i)' + MEASURES)})), len(words)) ELSE 1 END AS least FROM l2),
w0 AS (SELECT recipe, n, words, unnest(range(least + 1, len(words) + 1)) AS k FROM l3 WHERE how = 'words'),
w1 AS (SELECT recipe, n, k, {_LINK} AS link, {_m(_TAIL, STOP)} AS stops, {_m(_TAIL, r'^\S+(?:\s+\S+){0,2}[.!?](?:\s|$)')} OR ({_m(_TAIL, CAPITAL)} AND len(words) - k + 1 >= 4) AS turns FROM w0),
w2 AS (SELECT recipe, n, min(k) FILTER (turns OR (link AND stops)) AS closed, min(k) FILTER (turns OR link) AS opened FROM w1 GROUP BY recipe, n),
l4 AS (SELECT l3.*, closed, opened, CASE how WHEN 'right' THEN CASE WHEN bullet THEN rest ELSE regexp_replace(x, {_p(STRAY)}, '') END WHEN 'marked' THEN {_x(MARKED, 3)} END AS said FROM l3 LEFT JOIN w2 USING (recipe, n)),
walk AS (
  SELECT recipe, 1::BIGINT AS n, false AS open FROM h
  UNION ALL
  SELECT recipe, n + 1, CASE how WHEN 'right' THEN {_open_sql('said')} WHEN 'marked' THEN {_open_sql('said')} WHEN 'unread' THEN false ELSE CASE WHEN CASE WHEN open THEN opened ELSE closed END IS NULL THEN open ELSE NOT {_m('rest', STOP)} END END
  FROM walk JOIN l4 USING (recipe, n)),
l5 AS (SELECT *, CASE WHEN how = 'words' THEN CASE WHEN open THEN opened ELSE closed END END AS k FROM l4 JOIN walk USING (recipe, n)),
items AS (SELECT recipe, string_agg('- ' || CASE how WHEN 'marked' THEN {_x(MARKED, 1)} WHEN 'unread' THEN {_x(UNREAD, 1)} ELSE CASE WHEN k IS NULL THEN rest ELSE array_to_string(words[:k - 1], ' ') END END, chr(10) ORDER BY n) AS items FROM l5 WHERE how <> 'right' GROUP BY recipe),
r0 AS (SELECT recipe, n, 0 AS part, CASE how WHEN 'right' THEN said WHEN 'marked' THEN {_x(MARKED, 2)} WHEN 'unread' THEN 'Etape' ELSE {_TAIL} END AS t FROM l5 WHERE how <> 'words' OR k IS NOT NULL UNION ALL SELECT recipe, n, 1, said FROM l5 WHERE how = 'marked' AND said <> ''),
r1 AS (SELECT *, {_m('t', f'^{MARKER}$')} AS mark, row_number() OVER (PARTITION BY recipe, {_m('t', f'^{MARKER}$')} ORDER BY n, part) AS nth FROM r0),
nums AS (
  SELECT recipe, 0::BIGINT AS nth, 0 AS num FROM h
  UNION ALL SELECT recipe, m.nth, coalesce(TRY_CAST(regexp_extract(t, '([0-9]{{1,2}})\s*$', 1) AS INTEGER), p.num + 1) FROM nums p JOIN r1 m USING (recipe) WHERE m.mark AND m.nth = p.nth + 1),
steps AS (SELECT r1.recipe, string_agg(CASE WHEN mark THEN chr(10) || 'Etape ' || num ELSE t END, chr(10) ORDER BY n, part) AS steps FROM r1 LEFT JOIN nums ON nums.recipe = r1.recipe AND nums.nth = r1.nth AND mark GROUP BY r1.recipe)
SELECT t.recipe, coalesce(head || chr(10), '') || chr(10) || {_p(LEFT)} || chr(10) || items || chr(10) || chr(10) || {_p(RIGHT)} || chr(10) || steps AS text FROM two_columns t LEFT JOIN heads USING (recipe) LEFT JOIN items USING (recipe) LEFT JOIN steps USING (recipe)""",
}
QUERIES = {"recipe_columns": recipe_columns}
