"""Tables of the driver's star schema as the engine's own relations.

An order is a document version, its lines are statement rows.  Amounts are cents
as DECIMAL(18,2), so that sums do not depend on their order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.qc import Fact, Params

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def _struct(f: Fact) -> Column:
    return F.struct(F.lit(f.table_code).alias("table_code"), f.code.alias("classification_code"), f.name.alias("classification_name"), F.lit(f.measure).alias("measure"), f.amount.alias("amount"))


def _exploded(rows: DataFrame, facts: list[Fact], order: Column) -> DataFrame:
    """A row for each fact of a row; those of one condition stand together."""
    all_of = F.array(*[_struct(f) for f in facts if f.when is None])
    some = [f for f in facts if f.when is not None]
    if some:
        all_of = F.when(some[0].when, F.concat(all_of, F.array(*[_struct(f) for f in some]))).otherwise(all_of)
    return rows.select("version", order.alias("row_order"), F.explode(all_of).alias("f")).select("version", "f.*", "row_order")


def _cents(price: Column) -> tuple[Column, Column]:
    """Whole cents of a price: as `money` rounds it, and as round(price * 100) does.  Where two decimals
    are all it has, or no half is near, both are read without a text or decimal of each number."""
    near = F.rint(price * 100)
    exact = F.when((F.abs(price) < 1e13) & (near / 100.0 == price), near.cast("long")).otherwise((money(price) * 100).cast("long"))
    return exact, _nearest(price * 100)


def _nearest(v: Column) -> Column:
    """round(v), halves away from zero, as a long."""
    return F.when((F.abs(v) < 1e15) & (F.abs(v - F.rint(v)) < 0.5), F.rint(v).cast("long")).otherwise(F.round(v).cast("long"))


#: so many times the sum of all prices bounds what a rule adds up
MOST_ADDED = 16


def sums_fit(spark: SparkSession, sf_dir: str) -> bool:
    """Whether no sum of amounts can leave 64 bits in whole cents (what is not a number does not fit)."""
    price, discount = F.abs("l_extendedprice"), F.coalesce(F.abs("l_discount"), F.lit(0.0))
    most = table(spark, sf_dir, "lineitem").agg(F.sum(price * (discount + 1) + 10)).first()[0]
    return most is None or most * 100 * MOST_ADDED < 2.0**63


def statement_operands(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, list[Fact], dict[str, Column], list[Fact]], Params]:
    """What `qc.row_findings` takes: amounts in whole cents, or in decimals where sums might not fit."""
    whole = sums_fit(spark, sf_dir)
    return statement_lines(spark, sf_dir, whole), Params(unit=100 if whole else 1)


def statement_lines(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, list[Fact], dict[str, Column], list[Fact]]:
    """Rows of every order (version, row_order, ...), the facts that each holds, sums over an order's
    rows, and the facts that an order's sums hold; amounts are decimals, or `whole` cents.  Every seventh order's
    totals are off by 5, every eleventh has no functional table, so that all statuses occur.

    Lines are dealt by order once, when they are narrow: what is grouped by version needs no further shuffle.
    """
    exact, near = _cents(F.col("l_extendedprice"))
    # whole cents, rounded down: no half cent can fall to either side
    basic = F.call_function("div", near * (100 - _nearest(F.col("l_discount") * 100)), F.lit(100).cast("long"))
    unit = 100 if whole else 1
    amount = (lambda c: c.cast("long")) if whole else money
    floor = (lambda c: c - F.pmod(c, F.lit(100))) if whole else F.floor
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("version"),
        F.col("l_linenumber").cast("int").alias("row_order"),
        (exact if whole else money(F.col("l_extendedprice"))).alias("total"),
        (basic if whole else money(basic * F.lit(Decimal("0.01")))).alias("basic"),
    ).repartition("version")
    lines = lines.withColumn("project", amount(F.col("total") - F.col("basic"))).withColumn("part1", amount(floor(F.col("total")))).withColumn("code", F.concat(F.lit("2"), F.lpad(F.col("row_order").cast("string"), 2, "0")))
    code, name = F.col("code"), F.concat(F.lit("item "), F.col("code"))
    t, b, p, version = F.col("total"), F.col("basic"), F.col("project"), F.col("version")
    off = amount(F.when(version % 7 == 0, F.lit(5 * unit)).otherwise(F.lit(0)))
    fact = lambda table_code, code, name, measure, value, when=None: Fact(table_code, code, name, measure, amount(value), when)
    three = "FIN_03_expenditure"
    five = lambda code, value: fact("FIN_05_general_public_expenditure", code, name, "total_actual", value, version % 11 != 0)
    leaf = [fact(three, code, name, "total_actual", t), fact(three, code, name, "basic_actual", b), fact(three, code, name, "project_actual", p)]
    leaf += [five(code, t), five(F.concat(code, F.lit("01")), F.col("part1")), five(F.concat(code, F.lit("02")), t - F.col("part1") + off)]
    all_of = lambda table_code, measure, value, code="total", name="合计", when=None: fact(table_code, F.lit(code).cast("string"), F.lit(name), measure, value, when)
    totals = [
        all_of(three, "total_actual", t + off),
        all_of(three, "basic_actual", b),
        all_of(three, "project_actual", p),
        all_of("FIN_01_income_expenditure_total", "expenditure_actual", t, None, "本年支出合计"),
        all_of("FIN_01_income_expenditure_total", "income_actual", t + F.when(version % 5 == 0, F.lit(unit)).otherwise(F.lit(0)), None, "本年收入合计"),
        all_of("FIN_02_income", "total_actual", t),
        all_of("FIN_02_income", "fiscal_allocation", b),
        all_of("FIN_02_income", "other_income", F.when(version % 3 != 0, p)),
        all_of("FIN_06_basic_expenditure", "total_actual", floor(b), "301", "301"),
        all_of("FIN_06_basic_expenditure", "total_actual", b - floor(b), "302", "302"),
        all_of("FIN_07_three_public", "budget", t),
        all_of("FIN_07_three_public", "actual", F.when(version % 13 == 0, t * 2).otherwise(b)),
        all_of("FIN_07_three_public", "actual", b, "overseas", "因公出国(境)费"),
        all_of("FIN_08_gov_fund", "total_actual", t),
        all_of("FIN_08_gov_fund", "basic_actual", F.when(version % 4 != 0, b)),
        all_of("FIN_08_gov_fund", "project_actual", p),
        all_of(three, "total_budget", t, when=version % 2 == 0),
    ]
    return lines, leaf, {"total": t, "basic": b, "project": p}, totals


def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts of every order: version, table_code, classification_code,
    classification_name, measure, amount, row_order."""
    lines, leaf, sums, totals = statement_lines(spark, sf_dir)
    by = lines.groupBy("version").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return _exploded(lines, leaf, F.col("row_order")).unionByName(_exploded(by, totals, F.lit(0)))


#: The same relation in SQL, as a chain of CTEs that ends in `facts`.
FACTS_SQL = """
lines AS (
  SELECT l_orderkey AS version, l_linenumber::INT AS row_order, l_extendedprice::DECIMAL(18,2) AS total,
    (((round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT)) // 100) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS basic,
    '2' || lpad(l_linenumber::VARCHAR, 2, '0') AS code FROM lineitem),
split AS (
  SELECT *, (total - basic)::DECIMAL(18,2) AS project, floor(total)::DECIMAL(18,2) AS part1,
    (CASE WHEN version % 7 = 0 THEN 5 ELSE 0 END)::DECIMAL(18,2) AS off FROM lines),
sums AS (
  SELECT version, sum(total) AS t, sum(basic) AS b, sum(project) AS p, max(off) AS off FROM split GROUP BY version),
facts AS (
  SELECT version, 'FIN_03_expenditure' AS table_code, code AS classification_code, 'item ' || code AS classification_name,
    'total_actual' AS measure, total::DECIMAL(18,2) AS amount, row_order FROM split
  UNION ALL SELECT version, 'FIN_03_expenditure', code, 'item ' || code, 'basic_actual', (basic)::DECIMAL(18,2), row_order FROM split
  UNION ALL SELECT version, 'FIN_03_expenditure', code, 'item ' || code, 'project_actual', (project)::DECIMAL(18,2), row_order FROM split
  UNION ALL SELECT version, 'FIN_05_general_public_expenditure', code, 'item ' || code, 'total_actual', (total)::DECIMAL(18,2), row_order FROM split WHERE version % 11 <> 0
  UNION ALL SELECT version, 'FIN_05_general_public_expenditure', code || '01', 'item ' || code, 'total_actual', (part1)::DECIMAL(18,2), row_order FROM split WHERE version % 11 <> 0
  UNION ALL SELECT version, 'FIN_05_general_public_expenditure', code || '02', 'item ' || code, 'total_actual', (total - part1 + off)::DECIMAL(18,2), row_order FROM split WHERE version % 11 <> 0
  UNION ALL SELECT version, 'FIN_03_expenditure', 'total', '合计', 'total_actual', (t + off)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_03_expenditure', 'total', '合计', 'basic_actual', (b)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_03_expenditure', 'total', '合计', 'project_actual', (p)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_03_expenditure', 'total', '合计', 'total_budget', (t)::DECIMAL(18,2), 0 FROM sums WHERE version % 2 = 0
  UNION ALL SELECT version, 'FIN_01_income_expenditure_total', NULL, '本年支出合计', 'expenditure_actual', (t)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_01_income_expenditure_total', NULL, '本年收入合计', 'income_actual', (t + CASE WHEN version % 5 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_02_income', 'total', '合计', 'total_actual', (t)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_02_income', 'total', '合计', 'fiscal_allocation', (b)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_02_income', 'total', '合计', 'other_income', (CASE WHEN version % 3 <> 0 THEN p END)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_06_basic_expenditure', '301', '301', 'total_actual', (floor(b))::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_06_basic_expenditure', '302', '302', 'total_actual', (b - floor(b))::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_07_three_public', 'total', '合计', 'budget', (t)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_07_three_public', 'total', '合计', 'actual', (CASE WHEN version % 13 = 0 THEN t * 2 ELSE b END)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_07_three_public', 'overseas', '因公出国(境)费', 'actual', (b)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_08_gov_fund', 'total', '合计', 'total_actual', (t)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_08_gov_fund', 'total', '合计', 'basic_actual', (CASE WHEN version % 4 <> 0 THEN b END)::DECIMAL(18,2), 0 FROM sums
  UNION ALL SELECT version, 'FIN_08_gov_fund', 'total', '合计', 'project_actual', (p)::DECIMAL(18,2), 0 FROM sums)
"""
