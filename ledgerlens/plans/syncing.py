"""Queries: the organization store and the shared schema, from nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry_sync as R
from ..operators.hierarchy import _kept
from .base import table
from .registry import query

# a third of the customers have the name of a department of their own, and a third of these a related parent
_NAME = "CASE WHEN c_custkey % 9 = 0 THEN n_name || '局' WHEN c_custkey % 3 = 0 THEN 'X' || (c_custkey % 30)::VARCHAR || '局' ELSE c_name END"
_STORE = f"""d AS (SELECT n_nationkey AS k, n_name AS name, 'D' || n_nationkey::VARCHAR AS code FROM nation),
  u AS (SELECT c_custkey AS k, c_nationkey AS d, {_NAME} AS name, CASE WHEN c_custkey % 2 = 0 THEN 'U' || c_custkey::VARCHAR END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey),
  top AS (SELECT substr(md5('city:root:C'), 1, 12) AS id),
  p AS (SELECT u.*, d.name AS dn, u.k % 3 = 0 AND u.k % 9 <> 0 AS own FROM u JOIN d ON u.d = d.k),
  dept AS (SELECT name, min(code) AS code FROM (SELECT name, code FROM d UNION ALL SELECT name, NULL FROM p WHERE own) GROUP BY name),
  dorg AS (SELECT substr(md5('department:' || top.id || ':' || name), 1, 12) AS id, name, 'department' AS level, top.id AS parent_id, code FROM dept, top),
  leaf AS (SELECT p.k, p.name, p.code, dorg.id AS parent_id FROM p JOIN dorg ON dorg.name = CASE WHEN own THEN p.name ELSE dn END),
  uorg AS (SELECT substr(md5('unit:' || parent_id || ':' || name), 1, 12) AS id, name, 'unit' AS level, parent_id, first(code ORDER BY k) AS code FROM leaf GROUP BY name, parent_id),
  o AS (SELECT id, 'C' AS name, 'city' AS level, NULL AS parent_id, NULL AS code FROM top UNION ALL SELECT * FROM dorg UNION ALL SELECT * FROM uorg)"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    departments = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("sort_order"))
    k = F.col("c_custkey")
    name = F.when(k % 9 == 0, F.concat("n_name", F.lit("局"))).when(k % 3 == 0, F.concat(F.lit("X"), (k % 30).cast("string"), F.lit("局"))).otherwise(F.col("c_name"))
    units = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), F.col("c_nationkey").cast("long").alias("department_id"), F.when(k % 2 == 0, F.concat(F.lit("U"), k.cast("string"))).alias("code"), name.alias("name"), k.alias("sort_order"))
    return R.organization_store(departments, units, city="C")


@query("org_store", f"WITH {_STORE} SELECT * FROM o")
def org_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)


_SYNC = f"""{_STORE},
  doc AS (SELECT o_orderkey AS doc_id, o_custkey AS k, 2020 + o_orderkey % 3 AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'FINAL' ELSE 'BUDGET' END AS report_type FROM orders),
  named AS (SELECT doc.*, u.id AS org, u.name AS unit_name, u.code AS uc, p.name AS dn, p.code AS dc FROM doc JOIN leaf ON leaf.k = doc.k JOIN uorg u ON u.name = leaf.name AND u.parent_id = leaf.parent_id JOIN dorg p ON p.id = u.parent_id),
  coded AS (SELECT doc_id, year, report_type, unit_name, dn, coalesce(dc, 'AUTO_DEPT_' || upper(substr(sha1(dn), 1, 16))) AS dcode, uc FROM named),
  unit AS (SELECT *, coalesce(uc, 'AUTO_UNIT_' || upper(substr(sha1(dcode || '/' || unit_name), 1, 16))) AS ucode FROM coded),
  rep AS (SELECT dcode AS department_code, ucode AS unit_code, year, report_type, max(doc_id) AS doc_id FROM unit GROUP BY ALL)"""


def _synced(spark: SparkSession, sf_dir: str) -> R.Schema:
    """The schema after two runs: on an empty one, and again on what came of it."""
    orgs, orders = _kept(_store(spark, sf_dir)), table(spark, sf_dir, "orders")
    units = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    name = F.when(k % 9 == 0, F.concat("n_name", F.lit("局"))).when(k % 3 == 0, F.concat(F.lit("X"), (k % 30).cast("string"), F.lit("局"))).otherwise(F.col("c_name"))
    above = R.organization_id(F.when((k % 3 == 0) & (k % 9 != 0), name).otherwise(F.col("n_name")), "department", R.organization_id(F.lit("C"), "city", F.lit(None).cast("string")))
    placed = units.select(k.alias("o_custkey"), R.organization_id(name, "unit", above).alias("organization_id"))
    documents = _kept(orders.join(placed, "o_custkey").select(F.col("o_orderkey").alias("doc_id"), "organization_id", (2020 + F.col("o_orderkey") % 3).alias("fiscal_year"), F.when(F.col("o_orderkey") % 2 == 0, "决算").otherwise("budget").alias("doc_type"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("checksum")))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line"), F.floor("l_quantity").cast("long").alias("amount"))
    none = lambda kind: spark.createDataFrame([], kind)
    empty = R.Schema(none("code string, name string"), none("department_code string, code string, name string"), none("department_code string, unit_code string, year long, report_type string, path string, checksum string"), none("line int, amount long, department_code string, unit_code string, year long, report_type string"))
    return R.synchronized(R.synchronized(empty, documents, items, orgs), documents, items, orgs)


@query("sync_units", f"WITH {_SYNC} SELECT 'department' AS level, NULL AS parent, dcode AS code, max(dn) AS name FROM unit GROUP BY dcode UNION ALL SELECT 'unit', dcode, ucode, max(unit_name) FROM unit GROUP BY dcode, ucode")
def sync_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _synced(spark, sf_dir)
    return s.departments.select(F.lit("department").alias("level"), F.lit(None).cast("string").alias("parent"), "code", "name").unionByName(s.units.select(F.lit("unit").alias("level"), F.col("department_code").alias("parent"), "code", "name"))


@query("sync_reports", f"WITH {_SYNC} SELECT rep.department_code, rep.unit_code, rep.year::BIGINT AS year, rep.report_type, 'p' || doc_id::VARCHAR AS path, count(l_orderkey) AS items, coalesce(sum(floor(l_quantity)), 0)::BIGINT AS amount FROM rep LEFT JOIN lineitem ON l_orderkey = doc_id GROUP BY ALL")
def sync_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _synced(spark, sf_dir)
    key = ["department_code", "unit_code", "year", "report_type"]
    sums = s.items.groupBy(*key).agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("amount"))
    zero = F.lit(0).cast("long")
    return s.reports.join(sums, key, "left").select(*key, "path", F.coalesce("items", zero).alias("items"), F.coalesce("amount", zero).alias("amount"))
