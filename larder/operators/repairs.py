"""Columns of printed receipts that must multiply: unit price, count and total of a line, repaired where one was misread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.receipts import PRICE
from larder.sources import rendered
from larder.sources.tables import table

COLUMNS = r"(?:^|[^0-9,.])([0-9]{1,4}[,.][0-9]{2})\s+([0-9Il]{1,3})\s*$"
TOLERANCE = 2  # cents
READ = "struct<quantity:bigint,unit_cents:bigint,total_cents:bigint,corrected:boolean>"


def _cents(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "").try_cast("long")


def repaired(line: Column) -> Column:
    """struct(quantity, unit_cents, total_cents, corrected) of a line that ends in unit price, count and total; null where it has no such columns or they can't be made to agree.

    Columns that multiply to 2 cents stay. Else the total decides: one article takes its price from it, if the unit price is near or far above it; several keep the unit price where the count that was read holds the number of times it goes into the total, and the total is put right, or else take their share of the total.
    """
    total = _cents(F.regexp_extract(line, PRICE, 1))
    before = F.regexp_replace(line, PRICE, "")
    unit, token = _cents(F.regexp_extract(before, COLUMNS, 1)), F.translate(F.regexp_extract(before, COLUMNS, 2), "Il", "11")
    count, n = token.try_cast("long"), F.round(total / unit).cast("long")
    out = lambda q, u, t, c: F.struct(q.cast("long").alias("quantity"), u.cast("long").alias("unit_cents"), t.cast("long").alias("total_cents"), c.alias("corrected"))
    off = lambda least, share: F.greatest(F.lit(least), F.round(total * share))
    one = F.when((F.abs(unit - total) <= off(20, 0.15)) | (n == 0), out(F.lit(1), total, total, unit != total))
    holds = F.contains(token, n.cast("string"))
    more = F.when(F.abs(unit * n - total) <= off(10, 0.1), F.when(holds, out(n, unit, unit * n, F.lit(True))).otherwise(out(n, F.round(total / n), total, F.lit(True))))
    return F.when((unit > 0) & (total > 0) & line.rlike(PRICE), F.when((count > 0) & (F.abs(unit * count - total) <= TOLERANCE), out(count, unit, total, F.lit(False))).when(n <= 1, one).otherwise(more))


def printed_columns(spark: SparkSession, d: str) -> DataFrame:
    """x: each order line as name, unit price, count and total, some with a digit misread; tax decides which."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.expr(FORM).alias("x"))


_F, _Q, _E = "CAST(round(l_tax * 100) AS INT)", "CAST(l_quantity AS BIGINT)", "greatest(CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) % 2000, 100)"
_SAID = f"CASE {_F} WHEN 1 THEN 'I' WHEN 4 THEN '7' WHEN 5 THEN '7' WHEN 6 THEN concat('7', CAST({_Q} AS STRING)) WHEN 7 THEN '9' ELSE CAST({_Q} AS STRING) END"
_UNIT = f"CASE {_F} WHEN 3 THEN {_E} + 3 WHEN 5 THEN {_E} + 800 WHEN 8 THEN {_E} * 3 ELSE {_E} END"
_TOTAL = f"CASE WHEN {_F} IN (1, 4, 5) THEN {_E} WHEN {_F} = 2 THEN {_Q} * {_E} + 8 ELSE {_Q} * {_E} END"
FORM = f"concat(upper(p_name), '  ', {rendered._money(_UNIT)}, ' ', {_SAID}, '  ', {rendered._money(_TOTAL)}, CASE WHEN l_returnflag = 'R' THEN ' €' WHEN l_returnflag = 'A' THEN ' A' ELSE '' END)"


def repaired_columns(spark: SparkSession, d: str) -> DataFrame:
    """What each printed line is read to say, each line once."""
    return printed_columns(spark, d).distinct().select("x", repaired(F.col("x")).alias("r")).select("x", "r.*")


_CENTS = "TRY_CAST(regexp_replace({}, '[^0-9]', '', 'g') AS BIGINT)"
QUERIES = {"repaired_columns": repaired_columns}
SQL = {
    "repaired_columns": f"""WITH l AS (SELECT DISTINCT {FORM} AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
      a AS (SELECT x, {_CENTS.format(f"regexp_extract(x, '{PRICE}', 1)")} AS total, regexp_replace(x, '{PRICE}', '') AS b FROM l),
      c AS (SELECT x, total, {_CENTS.format(f"regexp_extract(b, '{COLUMNS}', 1)")} AS unit, translate(regexp_extract(b, '{COLUMNS}', 2), 'Il', '11') AS token FROM a),
      n AS (SELECT *, TRY_CAST(token AS BIGINT) AS count, CASE WHEN unit > 0 AND total > 0 THEN CAST(round(total / unit) AS BIGINT) END AS n FROM c),
      h AS (SELECT *, CASE WHEN n IS NULL THEN 'none' WHEN count > 0 AND abs(unit * count - total) <= {TOLERANCE} THEN 'right' WHEN n <= 1 AND (n = 0 OR abs(unit - total) <= greatest(20, round(total * 0.15::DOUBLE))) THEN 'one'
        WHEN n > 1 AND abs(unit * n - total) <= greatest(10, round(total * 0.1::DOUBLE)) THEN CASE WHEN contains(token, n::VARCHAR) THEN 'count' ELSE 'share' END ELSE 'none' END AS how FROM n)
      SELECT x, CASE how WHEN 'right' THEN count WHEN 'one' THEN 1 WHEN 'none' THEN NULL ELSE n END AS quantity, CASE how WHEN 'right' THEN unit WHEN 'one' THEN total WHEN 'count' THEN unit WHEN 'share' THEN CAST(round(total / n) AS BIGINT) END AS unit_cents,
        CASE how WHEN 'none' THEN NULL WHEN 'count' THEN unit * n ELSE total END AS total_cents, CASE how WHEN 'right' THEN false WHEN 'one' THEN unit <> total WHEN 'none' THEN NULL ELSE true END AS corrected FROM h""",
}
