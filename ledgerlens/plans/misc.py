"""Queries: filters, orderings, shares, keyed upserts, imports and severity words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import numbers as N
from ..functions import severity as S
from ..functions import text as X
from ..operators import findings as A
from ..operators import jobs as J
from ..operators import paging, qc
from ..operators import tables as T
from ..sources import sinks
from .base import table
from .registry import query


@query(
    "upsert_keyed",
    """SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, o.s AS s FROM (SELECT o_orderkey AS k, o_custkey AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0) o
       FULL OUTER JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS v FROM orders WHERE o_orderkey % 2 = 0) n ON o.k = n.k""",
)
def upsert_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.col("o_orderstatus").alias("s"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("v"))
    return sinks.upserted(old, new, ["k"])


@query(
    "org_import",
    """SELECT DISTINCT n_name AS name, 'department' AS level, NULL::VARCHAR AS parent_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
       UNION ALL SELECT DISTINCT s_name, 'unit', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0""",
)
def org_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat(F.lit(" "), F.col("n_name")).alias("Dept"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).otherwise("").alias("Unit name"))
    return sources.organizations(rows, {"department": ("dept",), "unit": ("unit", "unit name")}).select("name", "level", "parent_name")


@query("noise_filter", "SELECT doc_id, length(text)::INT AS chars FROM documents WHERE NOT regexp_matches(text, '&&&|%%%|\\*\\*\\*')")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"), F.length("text").alias("chars"))
    return A.without_noise(rows, ("&&&", "%%%", r"\*\*\*")).select("doc_id", "chars")


@query(
    "rule_filter",
    """WITH r(rule_key, enabled, executor, tags, priority) AS (VALUES ('a', true, 'engine', ['x', 'y'], 5), ('b', true, 'ai', ['x'], 1), ('c', false, 'engine', ['x'], 9), ('d', true, 'both', ['z'], 7), ('e', true, 'engine', ['z'], 2))
       SELECT rule_key, executor FROM r WHERE enabled AND executor IN ('engine', 'both') AND list_has_any(tags, ['x', 'z']) AND priority >= 3""",
)
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", True, "engine", ["x", "y"], 5), ("b", True, "ai", ["x"], 1), ("c", False, "engine", ["x"], 9), ("d", True, "both", ["z"], 7), ("e", True, "engine", ["z"], 2)]
    rules = spark.createDataFrame(rows, "rule_key string, enabled boolean, executor string, tags array<string>, priority int")
    wanted = F.array(F.lit("x"), F.lit("z"))
    return rules.where(F.col("enabled") & F.col("executor").isin("engine", "both") & F.arrays_overlap("tags", wanted) & (F.col("priority") >= 3)).select("rule_key", "executor")


@query("percent_shares", "SELECT c_nationkey, n, round(n * 100.0 / sum(n) OVER (), 4)::DOUBLE AS percent FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def percent_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("c_nationkey", "n", N.share(F.col("n"), F.col("total"), 4).alias("percent"))


@query(
    "top_evidence",
    """SELECT l_orderkey, l_linenumber::INT AS l_linenumber, l_extendedprice, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice END DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k <= 3""",
)
def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))
    w = Window.partitionBy("l_orderkey").orderBy(key.desc_nulls_last(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 3")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_extendedprice", "k")


@query("explicit_order", "SELECT n_name, row_number() OVER (ORDER BY coalesce(nullif(list_position([7, 2, 19], n_nationkey), 0), 99), n_nationkey)::INT AS place FROM nation")
def explicit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.array(*[F.lit(k) for k in (7, 2, 19)])
    at = F.array_position(ref, F.col("n_nationkey").cast("int"))
    # nations are a dimension of 25 rows
    w = Window.orderBy(F.when(at > 0, at).asc_nulls_last(), "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_name", F.row_number().over(w).alias("place"))


@query("severity_words", "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'info' END AS severity, count(*) AS n FROM orders GROUP BY 1, 2")
def severity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_replace(F.regexp_replace("o_orderpriority", r"^\d-", ""), "URGENT", "P0")
    return table(spark, sf_dir, "orders").select("o_orderpriority", S.normalized(F.when(word == "LOW", "none").otherwise(word)).alias("severity")).groupBy("o_orderpriority", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("stable_ids", "SELECT o_orderkey, substr(md5(o_orderkey::VARCHAR || '|' || o_orderstatus), 1, 12) AS id FROM orders")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.stable_id(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("id"))


@query("optional_projection", "SELECT page_id, NULL::VARCHAR AS html FROM pages")
def optional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.without(table(spark, sf_dir, "pages").select("page_id", "html"), "html", keep=False)


@query("amount_checks", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'out of range' END AS problem FROM customer")
def amount_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.amount_problem(F.col("c_acctbal").cast("string"), 0, 9000).alias("problem"))


@query(
    "first_amount",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 900)::DOUBLE WHEN o_custkey % 3 = 1 THEN 1234.5 END AS amount FROM orders""",
)
def first_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("合计 7 元，总额为 "), (F.col("o_custkey") % 900).cast("string"), F.lit(" 万元"))).when(F.col("o_custkey") % 3 == 1, "共计 1,234.5 万元").otherwise("总额 x 万元")
    amount = X.first_amount(text, (r"总额为\s*([0-9,.]+)\s*万元", r"计\s*([0-9,.]+)\s*万元"))
    return table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("amount"))


@query(
    "job_times",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE TIMESTAMP '2000-01-01' END AS at FROM orders""",
)
def job_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    at = J.job_time(F.when(k == 0, day), F.when(k == 1, day + F.expr("INTERVAL 1 DAY")), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))


@query(
    "finding_definitions",
    """SELECT o_orderkey AS id, 'R' || (o_custkey % 9)::VARCHAR AS rule_key, CASE WHEN o_custkey % 9 < 5 THEN 'rule ' || (o_custkey % 9)::VARCHAR END AS description,
       CASE WHEN o_custkey % 9 < 5 THEN 'warn' END AS severity FROM orders""",
)
def finding_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("R"), (F.col("o_custkey") % 9).cast("string")).alias("rule_key"))
    known = spark.createDataFrame([(f"R{k}", f"rule {k}", "warn") for k in range(5)], "rule_key string, description string, severity string")
    return qc.with_definitions(found, known).select("id", "rule_key", "description", "severity")


@query(
    "older_table_score",
    """WITH p AS (SELECT p_partkey, lower(p_name) AS title, string_split(lower(p_type), ' ') AS headers FROM part),
       s AS (SELECT *, list_max(list_transform(['red', 'steel'], lambda k: CASE WHEN contains(title, k) THEN 1.0 ELSE len(list_filter(string_split(k, ''), lambda c: contains(title, c)))::DOUBLE / length(k) END)) AS best,
         len(list_filter(['pro', 'tin'], lambda w: len(list_filter(headers, lambda h: contains(h, w))) > 0))::DOUBLE / 2 AS req, len(list_filter(['x'], lambda w: len(list_filter(headers, lambda h: contains(h, w))) > 0))::DOUBLE AS opt FROM p)
       SELECT p_partkey, round(0.58 * best + 0.32 * req + 0.10 * opt, 4)::DOUBLE AS score FROM s""",
)
def older_table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.older_score(F.lower("p_name"), F.split(F.lower("p_type"), " "), ("red", "steel"), ("pro", "tin"), ("x",))
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("double").alias("score"))
