"""Lists of ingredients read from text: a section to its lines, a line to none, one or two ingredients.

Lines stay rows. What carries on from line to line (the group, a line that goes on) is a window within the text; a line is read in columns, by patterns without lookaround, and comes out as an array of structs that is inlined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larder.functions.text import fold, fold_sql
from larder.sources import rendered
from larder.sources.tables import table

# fixed values: signs, words and units of French recipes
FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125}
PIECE_WORDS = "feuilles?|gousses?|branches?|brins?|tranches?|pots?|bo[iî]tes?|sachets?|paquets?|t[eê]tes?|bottes?|bouquets?|filets?|noix|morceaux?|cubes?|tiges?|rondelles?|pav[eé]s?|escalopes?|blancs?|b[aâ]tons?|bocal|bocaux|carr[eé]s?|barquettes?|poign[eé]es?|tubes?|conserves?|boules?|pi[eè]ces?|bandes?|cuisses?|aiguillettes?|[eé]pis?|grappes?|quartiers?|zestes?|rouleaux?|plaques?|sticks?|gr[aâ]ins?|cm"
QUALIFIERS = "bonne|belle|grosse|petite|grande|g[eé]n[eé]reuse|pleine|rase|ras[eé]e|bomb[eé]e|copieuse|demie|gros|petit|grand|beau|bon|moyen|moyenne"
UNITS = {
    "kg": "kg|kilos?|kilogrammes?", "g": "g|gr|grammes?", "ml": "ml|millilitres?", "cl": "cl|centilitres?", "dl": "dl|d[eé]cilitres?", "l": "l|litres?",
    "cas": r"cs|c\.?\s*[àa]\.?\s*soupe|c\.?\s*[àa]\.?\s*s\.?|c\.?s\.?|[cç][àa]s|cuill?[eè]re?(?:e|ée)?s?\s*[àa]\s*soupe|cuill?[eè]re?(?:e|ée)?s?\s*[àa]\s*s\.?",
    "cac": r"cc|c\.?\s*[àa]\.?\s*caf[eé]|c\.?\s*[àa]\.?\s*c\.?|[cç][àa]c|cuill?[eè]re?(?:e|ée)?s?\s*[àa]\s*caf[eé]|cuill?[eè]re?(?:e|ée)?s?\s*[àa]\s*c\.?",
    "pincee": "pinc[eé]es?", "verre": "verres?",
}
MOST = {"g": 5000, "ml": 5000, "kg": 20, "l": 20, "cl": 500, "dl": 50, "cas": 50, "cac": 50, "piece": 100, "pincee": 20, "verre": 20}
MISREAD = "« ci » lu comme « cl » (centilitres) : à vérifier avec la fiche."

SIGNS = "".join(FRACTIONS)
BULLET, OCR_BULLET, LONE = r"^[•·▪●■◦\-–—*]\s*", r"^(?:e\s+|\?\?\s*)(?:e\s+|\?\?\s*)?", r"^[e|©@°•·\-–—*.]$"
STARTS = rf"^(?:[0-9]|[{SIGNS}])"
HEADING = r"^pour\s+(?:la|le|les|l'|un|une|[0-9])"
EDGE, END = r"(^|[^\p{L}\p{N}])", r"($|[^\p{L}\p{N}])"
OPTIONAL = EDGE + "(facultatif|facultative|optionnel|optionnelle)" + END
TASTE = EDGE + "(selon (?:le |votre )?go[uû]t|au go[uû]t|[aà] volont[eé]|[aà] votre convenance)" + END
QUANTITY = rf"^([0-9]+\s+[0-9]\s*/\s*[0-9]|[0-9]+\s*/\s*[0-9]+|[0-9]+(?:[.,][0-9]+)?\s*[{SIGNS}]?|[{SIGNS}])\s*((?:à|-|–)\s*([0-9]+(?:[.,][0-9]+)?)\s+)?"
QUALIFIED = rf"^({QUALIFIERS})\s+(?:cs|cc|c\.|cuill|verre|pinc|g(?:[^\p{{L}}\p{{N}}]|$)|kg|ml|cl|dl|l(?:[^\p{{L}}\p{{N}}]|$)|litre|gramme)"
CI = r"^ci\s+(?:de\s|d['’])"
NOT_LETTER = r"(?:[^\p{L}']|$)"
DE = "^(?:de la |de l'|de |d'|du |des )"
TWO = r"^([^,&]+?)(?:\s*[,&]\s*|[^\p{L}\p{N},&]+et[^\p{L}\p{N},&]+)([^,&]+)$"
WARNED = r"\s*⚠\s*(.+)$"

ITEM = "array<struct<name:string,quantity:double,unit:string,note:string,check:string>>"


def _strip(x: Column, more: str = "") -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r" + more.replace("\\", "")))


def _i(pattern: str) -> str:
    return "(?iu)" + pattern


def _has(x: Column, pattern: str) -> Column:
    return x.rlike(_i(pattern))


def _got(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, _i(pattern), group)


def _after(x: Column, head: Column) -> Column:
    return _strip(F.substring(x, F.length(head) + 1, F.length(x)))


def _holds(x: Column, *words: str) -> Column:
    """A quick look before a pattern."""
    low = F.lower(x)
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def _starts_with_quantity(x: Column) -> Column:
    return x.rlike(STARTS)


def section_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n, group, text: the ingredients that each text lists. Bullets, blank lines and lone signs go; a heading names the group of what follows; a line goes on from the one before if it begins in lower case, or without a bullet where others have one, and with no quantity. A null text has no lines."""
    rows = texts.select(F.col(key), F.posexplode(F.split(F.replace(F.col(text), F.lit(" "), F.lit(" ")), "\n")).alias("pos", "x"))
    rows = rows.withColumn("x", _strip(F.col("x"))).where((F.col("x") != "") & ~F.col("x").rlike(LONE))
    bullet = F.col("x").rlike(BULLET) | F.col("x").rlike(OCR_BULLET)
    rows = rows.withColumn("bullet", bullet).withColumn("t", _strip(F.regexp_replace(F.regexp_replace("x", BULLET, ""), OCR_BULLET, "")))
    every, before = W.partitionBy(key), W.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("bullets", F.max("bullet").over(every)).where("t <> ''")
    counts = _starts_with_quantity(F.col("t"))
    heading = ~F.col("bullet") & ~counts & (F.col("t").endswith(":") | _has(F.col("t"), HEADING))
    plain = F.regexp_replace("t", "[ :]+$", "")
    title = F.left(F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substring(plain, 2, 1_000_000))), F.lit(60))
    rows = rows.withColumn("heading", F.when(heading, title)).withColumn("group", F.last("heading", ignorenulls=True).over(before))
    rows = rows.where("heading IS NULL")
    first = F.row_number().over(before) == 1
    goes_on = ~first & ~F.col("bullet") & ~counts & (F.col("bullets") | F.col("t").rlike(r"^\p{Ll}"))
    rows = rows.withColumn("n", F.sum((~goes_on).cast("int")).over(before))
    lines = rows.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("own"), F.min_by("group", "pos").alias("group"))
    return lines.select(key, F.col("n").cast("int").alias("n"), "group", F.array_join("own.t", " ").alias("text"))


def _number(x: Column) -> Column:
    """'½', '1 ½', '1 1/2', '3/4', '2,5'."""
    plain = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    mixed, over = r"^([0-9]+)\s+([0-9])\s*/\s*([0-9])$", r"^([0-9]+)\s*/\s*([0-9]+)$"
    part = lambda p, k: F.regexp_extract(x, p, k).try_cast("double")
    out = F.when(x.rlike(mixed), part(mixed, 1) + part(mixed, 2) / F.greatest(F.lit(1.0), part(mixed, 3))).when(x.rlike(over), part(over, 1) / F.greatest(F.lit(1.0), part(over, 2))).otherwise(plain(x))
    for sign, value in reversed(FRACTIONS.items()):
        out = F.when(F.contains(x, F.lit(sign)), F.coalesce(plain(F.trim(F.replace(x, F.lit(sign), F.lit("")))), F.lit(0.0)) + value).otherwise(out)
    return out


def _bare(x: Column) -> Column:
    return _strip(F.regexp_replace(_strip(x), _i(DE), ""))


def ingredients(lines: DataFrame, text: str = "text") -> DataFrame:
    """The lines' other columns with raw, name, quantity, unit, note, optional and check of each ingredient that a line names: none for an empty line, two for 'salt and pepper', else one.

    A quantity over what its unit can mean loses leading digits (a bullet read as a digit) if that makes it fit; check says what should be looked at.
    """
    keep = [c for c in lines.columns if c != text]
    t, rest = F.col("t"), F.col("rest")
    out = lines.withColumn("t", F.replace(F.col(text), F.lit(" "), F.lit(" ")))
    out = out.withColumn("warned", F.contains("t", F.lit("⚠"))).withColumn("forced", F.when(F.col("warned"), _strip(F.regexp_extract("t", WARNED, 1))).otherwise("")).withColumn("raw", _strip(F.when(F.col("warned"), F.regexp_replace("t", WARNED, "")).otherwise(t)))
    out = out.withColumn("t", F.regexp_replace("raw", r"\s+", " ")).where("t <> ''")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    shouts = (F.length(letters) > 0) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(F.length(letters), F.lit(1)) > 0.7)
    out = out.withColumn("t", F.when(shouts, F.lower("t")).otherwise(t))
    out = out.withColumn("tail", F.regexp_extract_all("t", F.lit(r"\(([^)]*)\)"), 1)).withColumn("t", _strip(F.regexp_replace(F.regexp_replace("t", r"\([^)]*\)", " "), r"\s+", " ")))
    out = out.withColumn("optional", F.when(_holds(t, "facultati", "optionnel"), _has(t, OPTIONAL)).otherwise(False)).withColumn("t", F.when(F.col("optional"), _strip(F.regexp_replace("t", _i(OPTIONAL), "$1$3"))).otherwise(t))
    out = out.withColumn("taste", F.when(_holds(t, "go", "volont", "convenance"), F.lower(_got(t, TASTE, 2))).otherwise("")).withColumn("t", F.when(F.col("taste") != "", _strip(F.regexp_replace("t", _i(TASTE), "$1$3"), ",;")).otherwise(t))
    out = out.withColumn("head", F.regexp_extract("t", QUANTITY, 0)).withColumn("q", _strip(F.regexp_extract("t", QUANTITY, 1))).withColumn("to", F.regexp_extract("t", QUANTITY, 3))
    out = out.withColumn("counted", F.col("head") != "").withColumn("quantity", F.when(F.col("counted"), _number(F.col("q")))).withColumn("rest", F.when(F.col("counted"), _after(t, F.col("head"))).otherwise(t))
    out = out.withColumn("kind", F.when(F.col("counted"), F.lower(_got(rest, QUALIFIED))).otherwise("")).withColumn("rest", _after(rest, F.col("kind")))
    out = out.withColumn("ci", F.col("counted") & _has(rest, CI)).withColumn("rest", F.when(F.col("ci"), F.concat(F.lit("cl"), F.substring("rest", 3, 1_000_000))).otherwise(rest))
    unit = word = F.lit(None).cast("string")
    for code, pattern in reversed(UNITS.items()):
        found = _got(rest, f"^({pattern}){NOT_LETTER}")
        unit, word = F.when(found != "", code).otherwise(unit), F.when(found != "", found).otherwise(word)
    out = out.withColumn("unit", F.when(F.col("counted"), unit)).withColumn("word", F.when(F.col("counted"), word))
    out = out.withColumn("piece", F.when(F.col("counted") & F.col("unit").isNull(), _got(rest, rf"^({PIECE_WORDS})(?:[^\p{{L}}]|$)")).otherwise(""))
    out = out.withColumn("rest", F.when(F.col("unit").isNotNull(), F.regexp_replace(_after(rest, F.col("word")), r"^\.?\s*", "")).otherwise(_after(rest, F.col("piece"))))
    lone = F.col("counted") & F.col("unit").isNull() & (F.col("piece") == "")
    out = out.withColumn("size", F.when(lone, F.lower(_got(rest, rf"^({QUALIFIERS})\s+.+$"))).otherwise("")).withColumn("rest", _after(rest, F.col("size")))
    out = out.withColumn("unit", F.when(F.col("counted"), F.coalesce("unit", F.lit("piece"))))
    most = F.create_map(*[F.lit(v) for pair in MOST.items() for v in pair])[F.col("unit")]
    digits = F.regexp_replace("q", "[^0-9]", "")
    cuts = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.length(digits), F.lit(2))), lambda i: F.substring(digits, i, F.length(digits))), lambda c: (F.left(c, F.lit(1)) != "0") & (c.try_cast("double") <= most))
    can = F.col("unit").isin("g", "ml", "piece") & (F.length(digits) > 2) & (F.col("quantity") == digits.try_cast("double"))
    out = out.withColumn("over", F.coalesce(F.col("quantity") > most, F.lit(False))).withColumn("cut", F.when(F.col("over") & can, F.try_element_at(cuts, F.lit(1))))
    said = F.when(F.col("cut").isNotNull(), F.concat(F.lit("Quantité lue « "), digits, F.lit(" » : le début est sans doute une puce mal lue, corrigée en "), F.col("cut"), F.lit(". À vérifier avec la fiche."))).when(F.col("over"), F.concat(F.lit("Quantité inhabituelle (« "), F.col("q"), F.lit(" »). À vérifier avec la fiche.")))
    out = out.withColumn("check", F.coalesce(F.when(F.col("forced") != "", F.col("forced")), said, F.when(F.col("ci"), MISREAD))).withColumn("quantity", F.coalesce(F.col("cut").try_cast("double"), "quantity"))
    out = out.withColumn("rest", _bare(rest))
    out = out.withColumn("other", F.when(_has(rest, r"^(.+?)\s+ou\s+(.+)$"), F.concat(F.lit("ou "), _got(rest, r"^(.+?)\s+ou\s+(.+)$", 2)))).withColumn("rest", F.when(F.col("other").isNotNull(), _got(rest, r"^(.+?)\s+ou\s+(.+)$")).otherwise(rest))
    name, more = _strip(F.substring_index("rest", ",", 1)), _strip(F.regexp_extract("rest", "^[^,]*,(.*)$", 1))
    cut = F.col("counted") & (name != "") & (more != "")
    out = out.withColumn("more", F.when(cut, more)).withColumn("rest", F.when(cut, name).otherwise(rest))
    out = out.withColumn("rest", _strip(rest, r".;:,\-–"))
    ranged = F.when(F.col("to") != "", F.concat("q", F.lit(" à "), "to"))
    notes = F.concat(F.array("taste", ranged, "kind", F.lower("piece"), "size"), "tail", F.array("other", "more"))
    notes = F.array_distinct(F.filter(F.transform(notes, lambda n: _strip(n, ",;")), lambda n: n.isNotNull() & (n != "")))
    out = out.withColumn("note", F.when(F.size(notes) > 0, F.left(F.array_join(notes, ", "), F.lit(120))))
    words = lambda x: F.regexp_count(fold(x), F.lit("[a-z'][a-z'-]*"))
    out = out.withColumn("few", F.when(~F.col("counted"), words(rest) <= 7).otherwise(False))  # two names of three words and 'et'
    one, two = (F.when(F.col("few"), _got(rest, TWO, k)).otherwise("") for k in (1, 2))
    both = F.when(F.col("few"), (one != "") & (words(one) <= 3) & (words(two) <= 3)).otherwise(False)
    none = F.lit(None)
    item = lambda name, q, u, note, check: F.struct(_bare(name).alias("name"), q.cast("double").alias("quantity"), u.cast("string").alias("unit"), note.cast("string").alias("note"), check.cast("string").alias("check"))
    items = F.when(both, F.array(item(one, none, none, F.col("note"), none), item(two, none, none, none, none))).when(rest != "", F.array(item(rest, F.col("quantity"), F.col("unit"), F.col("note"), F.col("check")))).otherwise(F.array().cast(ITEM))
    return out.select(*keep, "raw", "optional", F.posexplode(items).alias("part", "item")).select(*keep, "part", "raw", "item.name", "item.quantity", "item.unit", "item.note", "optional", "item.check")


def sheet_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """The ingredients of every recipe's sheet, with their group."""
    return ingredients(section_lines(rendered.sheets(spark, d), "recipe"))


def document_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """The same reading of all documents, whatever they hold."""
    return ingredients(section_lines(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id"))


def _q(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _p(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _strip_sql(x: str, more: str = "") -> str:
    return f"regexp_replace({x}, {_p(rf'^[\s{more}]+|[\s{more}]+$')}, '', 'g')"


def _number_sql(x: str) -> str:
    plain = lambda c: f"TRY_CAST(replace({c}, ',', '.') AS DOUBLE)"
    mixed, over = _p(r"^([0-9]+)\s+([0-9])\s*/\s*([0-9])$"), _p(r"^([0-9]+)\s*/\s*([0-9]+)$")
    signs = " ".join(f"WHEN contains({x}, '{s}') THEN coalesce({plain(f"trim(replace({x}, '{s}', ''))")}, 0) + {v!r}" for s, v in FRACTIONS.items())
    part = lambda p, k: f"TRY_CAST(regexp_extract({x}, {p}, {k}) AS DOUBLE)"
    return f"CASE {signs} WHEN regexp_matches({x}, {mixed}) THEN {part(mixed, 1)} + {part(mixed, 2)} / greatest(1.0, {part(mixed, 3)}) WHEN regexp_matches({x}, {over}) THEN {part(over, 1)} / greatest(1.0, {part(over, 2)}) ELSE {plain(x)} END"


def _bare_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace({_strip_sql(x)}, {_q(DE)}, '')")


def _sql(source: str, key: str) -> str:
    """The reading of `source` (key, text) in SQL, step by step as above."""
    starts = lambda x: f"regexp_matches({x}, {_p(STARTS)})"
    units = " ".join(f"WHEN regexp_matches(rest, {_q(f'^({p}){NOT_LETTER}')}) THEN '{c}'" for c, p in UNITS.items())
    words = " ".join(f"WHEN regexp_matches(rest, {_q(f'^({p}){NOT_LETTER}')}) THEN regexp_extract(rest, {_q(f'^({p}){NOT_LETTER}')}, 1)" for p in UNITS.values())
    most = " ".join(f"WHEN '{u}' THEN {n}" for u, n in MOST.items())
    steps = [
        f"SELECT {key}, pos, {_strip_sql('x')} AS x FROM (SELECT {key}, generate_subscripts(s, 1) AS pos, unnest(s) AS x FROM (SELECT {key}, string_split(replace(text, chr(160), ' '), chr(10)) AS s FROM {source}))",
        f"SELECT *, regexp_matches(x, {_p(BULLET)}) OR regexp_matches(x, {_p(OCR_BULLET)}) AS bullet, {_strip_sql(f'''regexp_replace(regexp_replace(x, {_p(BULLET)}, ''), {_p(OCR_BULLET)}, '')''')} AS t FROM s0 WHERE x <> '' AND NOT regexp_matches(x, {_p(LONE)})",
        f"SELECT *, bool_or(bullet) OVER (PARTITION BY {key}) AS bullets, regexp_replace(t, '[ :]+$', '') AS plain FROM s1",
        f"SELECT *, CASE WHEN NOT bullet AND NOT {starts('t')} AND (ends_with(t, ':') OR regexp_matches(t, {_q(HEADING)})) THEN left(upper(left(plain, 1)) || lower(plain[2:]), 60) END AS heading FROM s2 WHERE t <> ''",
        f"SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM s3",
        f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos) > 1 AND NOT bullet AND NOT {starts('t')} AND (bullets OR regexp_matches(t, {_p(r'^\p{Ll}')})) AS goes_on FROM s4 WHERE heading IS NULL",
        f"SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM s5",
        f"SELECT {key}, n, arg_min(struct_pack(g := grp), pos).g AS grp, string_agg(t, ' ' ORDER BY pos) AS t FROM s6 GROUP BY {key}, n",
        f"SELECT *, {_strip_sql(f'regexp_extract(t, {_p(WARNED)}, 1)')} AS forced, {_strip_sql(f'''regexp_replace(t, {_p(WARNED)}, '')''')} AS raw FROM s7",
        f"SELECT * REPLACE (regexp_replace(raw, {_p(r'\s+')}, ' ', 'g') AS t), regexp_replace(raw, {_p(r'[^\p{L}]')}, '', 'g') AS letters FROM s8",
        f"SELECT * REPLACE (CASE WHEN letters <> '' AND length(regexp_replace(letters, {_p(r'[^\p{Lu}]')}, '', 'g')) / length(letters) > 0.7 THEN lower(t) ELSE t END AS t) FROM s9 WHERE t <> ''",
        f"SELECT * REPLACE ({_strip_sql(f'''regexp_replace(regexp_replace(t, {_p(r'\([^)]*\)')}, ' ', 'g'), {_p(r'\s+')}, ' ', 'g')''')} AS t), regexp_extract_all(t, {_p(r'\(([^)]*)\)')}, 1) AS tail FROM s10",
        f"SELECT * REPLACE (CASE WHEN regexp_matches(t, {_q(OPTIONAL)}) THEN {_strip_sql(f'''regexp_replace(t, {_q(OPTIONAL)}, '\\1\\3', 'g')''')} ELSE t END AS t), regexp_matches(t, {_q(OPTIONAL)}) AS optional FROM s11",
        f"SELECT * REPLACE (CASE WHEN regexp_matches(t, {_q(TASTE)}) THEN {_strip_sql(f'''regexp_replace(t, {_q(TASTE)}, '\\1\\3', 'g')''', ',;')} ELSE t END AS t), lower(regexp_extract(t, {_q(TASTE)}, 2)) AS taste FROM s12",
        f"SELECT *, regexp_extract(t, {_p(QUANTITY)}, 0) AS head, {_strip_sql(f'regexp_extract(t, {_p(QUANTITY)}, 1)')} AS q, regexp_extract(t, {_p(QUANTITY)}, 3) AS upto FROM s13",
        f"SELECT *, head <> '' AS counted, CASE WHEN head <> '' THEN {_number_sql('q')} END AS quantity, CASE WHEN head <> '' THEN {_strip_sql('t[length(head) + 1 :]')} ELSE t END AS rest FROM s14",
        f"SELECT *, CASE WHEN counted THEN lower(regexp_extract(rest, {_q(QUALIFIED)}, 1)) ELSE '' END AS kind FROM s15",
        f"SELECT * REPLACE ({_strip_sql('rest[length(kind) + 1 :]')} AS rest) FROM s16",
        f"SELECT * REPLACE (CASE WHEN counted AND regexp_matches(rest, {_q(CI)}) THEN 'cl' || rest[3:] ELSE rest END AS rest), counted AND regexp_matches(rest, {_q(CI)}) AS ci FROM s17",
        f"SELECT *, CASE WHEN NOT counted THEN NULL {units} END AS u, CASE WHEN NOT counted THEN NULL {words} END AS word FROM s18",
        f"SELECT *, CASE WHEN counted AND u IS NULL THEN regexp_extract(rest, {_q(rf'^({PIECE_WORDS})(?:[^\p{{L}}]|$)')}, 1) ELSE '' END AS piece FROM s19",
        f"SELECT * REPLACE (CASE WHEN u IS NOT NULL THEN regexp_replace({_strip_sql('rest[length(word) + 1 :]')}, {_p(r'^\.?\s*')}, '') ELSE {_strip_sql('rest[length(piece) + 1 :]')} END AS rest) FROM s20",
        f"SELECT *, CASE WHEN counted AND u IS NULL AND piece = '' THEN lower(regexp_extract(rest, {_q(rf'^({QUALIFIERS})\s+.+$')}, 1)) ELSE '' END AS size, CASE WHEN counted THEN coalesce(u, 'piece') END AS unit, regexp_replace(q, '[^0-9]', '', 'g') AS digits FROM s21",
        f"SELECT * REPLACE ({_bare_sql('rest[length(size) + 1 :]')} AS rest), CASE unit {most} END AS most FROM s22",
        "SELECT *, coalesce(quantity > most, false) AS over_most, CASE WHEN quantity > most AND unit IN ('g', 'ml', 'piece') AND length(digits) > 2 AND quantity = TRY_CAST(digits AS DOUBLE) THEN list_filter(list_transform(range(2, length(digits) + 1), lambda i: digits[i:]), lambda c: c[1] <> '0' AND TRY_CAST(c AS DOUBLE) <= most)[1] END AS cut FROM s23",
        f"SELECT *, regexp_matches(rest, {_q(r'^(.+?)\s+ou\s+(.+)$')}) AS either, regexp_extract(rest, {_q(r'^(.+?)\s+ou\s+(.+)$')}, 1) AS one, regexp_extract(rest, {_q(r'^(.+?)\s+ou\s+(.+)$')}, 2) AS another FROM s24",
        "SELECT * REPLACE (CASE WHEN either THEN one ELSE rest END AS rest) FROM s25",
        f"SELECT *, {_strip_sql('''split_part(rest, ',', 1)''')} AS name, {_strip_sql(f'regexp_extract(rest, {_p("^[^,]*,(.*)$")}, 1)')} AS more FROM s26",
        f"SELECT * REPLACE ({_strip_sql('''CASE WHEN counted AND name <> '' AND more <> '' THEN name ELSE rest END''', '.;:,\\-–')} AS rest), CASE WHEN counted AND name <> '' AND more <> '' THEN more END AS cut_off FROM s27",
        f"SELECT *, list_filter(list_transform(list_concat([taste, CASE WHEN upto <> '' THEN q || ' à ' || upto END, kind, lower(piece), size], tail, [CASE WHEN either THEN 'ou ' || another END, cut_off]), lambda n: {_strip_sql('n', ',;')}), lambda n: n IS NOT NULL AND n <> '') AS notes, regexp_extract(rest, {_q(TWO)}, 1) AS a, regexp_extract(rest, {_q(TWO)}, 2) AS b FROM s28",
        f"SELECT *, CASE WHEN len(notes) > 0 THEN left(array_to_string(list_filter(notes, lambda n, i: list_position(notes, n) = i), ', '), 120) END AS note, NOT counted AND a <> '' AND len(regexp_extract_all({fold_sql('a')}, '[a-z''][a-z''-]*')) <= 3 AND len(regexp_extract_all({fold_sql('b')}, '[a-z''][a-z''-]*')) <= 3 AS two FROM s29",
        "SELECT *, coalesce(nullif(forced, ''), CASE WHEN cut IS NOT NULL THEN 'Quantité lue « ' || digits || ' » : le début est sans doute une puce mal lue, corrigée en ' || cut || '. À vérifier avec la fiche.' WHEN over_most THEN 'Quantité inhabituelle (« ' || q || ' »). À vérifier avec la fiche.' END, CASE WHEN ci THEN '" + MISREAD + "' END) AS chk FROM s30",
    ]
    ctes = ",\n".join(f"s{i} AS ({x})" for i, x in enumerate(steps))
    head = f"{key}, n::INTEGER AS n, grp AS \"group\""
    return ctes + f"""
SELECT {head}, 0 AS part, raw, {_bare_sql('CASE WHEN two THEN a ELSE rest END')} AS name, CASE WHEN NOT two THEN coalesce(TRY_CAST(cut AS DOUBLE), quantity) END AS quantity, CASE WHEN NOT two THEN unit END AS unit, note, optional, CASE WHEN NOT two THEN chk END AS "check" FROM s31 WHERE two OR rest <> ''
UNION ALL SELECT {head}, 1, raw, {_bare_sql('b')}, NULL, NULL, NULL, optional, NULL FROM s31 WHERE two"""


QUERIES = {f.__name__: f for f in (sheet_ingredients, document_ingredients)}
SQL = {"sheet_ingredients": "WITH " + rendered.SHEETS + ",\n" + _sql("sheets", "recipe"), "document_ingredients": "WITH " + _sql("(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", "doc_id")}
