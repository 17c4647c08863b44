"""Queries: the organization tree region > nation > (customers, suppliers), jobs and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import jobs as J
from .base import table
from .registry import query


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("district").alias("level"), none.alias("parent_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("department").alias("level"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    unit = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("unit").alias("level"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"))
    return region.unionByName(nation).unionByName(unit)


_ORGS = """o AS (SELECT 'r' || r_regionkey::VARCHAR AS id, r_name AS name, 'district' AS level, NULL AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey::VARCHAR, n_name, 'department', 'r' || n_regionkey::VARCHAR FROM nation
  UNION ALL SELECT 'c' || c_custkey::VARCHAR, c_name, 'unit', 'n' || c_nationkey::VARCHAR FROM customer)"""
_CLOSURE = f"""RECURSIVE {_ORGS}, t AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM o
  UNION ALL SELECT o.parent_id, t.descendant, t.depth + 1 FROM t JOIN o ON t.ancestor = o.id WHERE o.parent_id IS NOT NULL)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("org_id"))


@query("org_closure", f"WITH {_CLOSURE} SELECT ancestor, descendant, depth::INT AS depth FROM t")
def org_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.closure(orgs(spark, sf_dir))


@query(
    "org_rollup",
    f"""WITH {_CLOSURE}, s AS (SELECT 'c' || o_custkey::VARCHAR AS org_id, count(*) AS jobs, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS issues FROM orders GROUP BY 1)
        SELECT ancestor AS org_id, coalesce(sum(jobs), 0)::BIGINT AS jobs, coalesce(sum(issues), 0)::BIGINT AS issues,
        coalesce(sum(CASE WHEN depth = 0 THEN jobs END), 0)::BIGINT AS direct_jobs, coalesce(sum(CASE WHEN depth = 0 THEN issues END), 0)::BIGINT AS direct_issues
        FROM t LEFT JOIN s ON descendant = org_id GROUP BY ancestor""",
)
def org_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("org_id")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("issues"))
    return H.rollup(orgs(spark, sf_dir), stats, ["jobs", "issues"])


@query("org_children", f"WITH {_ORGS} SELECT p.id, count(c.id) AS children FROM o p LEFT JOIN o c ON c.parent_id = p.id WHERE p.level <> 'unit' GROUP BY p.id")
def org_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orgs(spark, sf_dir)
    kids = o.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return o.where("level <> 'unit'").select("id").join(kids, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


@query(
    "org_delete_preview",
    f"""WITH {_CLOSURE}, s AS (SELECT 'c' || o_custkey::VARCHAR AS org_id, count(DISTINCT o_orderkey) AS jobs FROM orders GROUP BY 1)
        SELECT ancestor AS id, count(*) AS orgs, coalesce(sum(jobs), 0)::BIGINT AS jobs FROM t LEFT JOIN s ON descendant = org_id WHERE ancestor LIKE 'n%' GROUP BY ancestor""",
)
def org_delete_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orgs(spark, sf_dir)
    return H.delete_preview(o, links(spark, sf_dir), o.where("level = 'department'"))


_FAULTS = f"""{_ORGS}, x AS (SELECT id, name, level, CASE WHEN id = 'c5' THEN 'c6' WHEN id = 'c7' THEN 'gone' WHEN id = 'c8' THEN 'r1' ELSE parent_id END AS parent_id FROM o
  UNION ALL SELECT 'r1', 'again', 'district', NULL UNION ALL SELECT 'z1', 'odd', 'planet', NULL UNION ALL SELECT 'd1', 'empty', 'department', 'r1')"""


@query(
    "org_validate",
    f"""WITH {_FAULTS}, u AS (SELECT id, any_value(level) AS level, any_value(parent_id) AS parent_id, count(*) AS times FROM x GROUP BY id),
        p AS (SELECT u.*, list_position(['city', 'district', 'department', 'unit'], level) AS place FROM u), f AS (SELECT * FROM p WHERE place > 0),
        k AS (SELECT f.*, q.id AS pid, q.level AS p_level, q.place AS p_place FROM f LEFT JOIN f q ON f.parent_id = q.id WHERE f.parent_id IS NOT NULL)
        SELECT id, 'error' AS severity, 'duplicate id' AS problem FROM p WHERE times > 1
        UNION ALL SELECT id, 'error', 'invalid level' FROM p WHERE place IS NULL OR place = 0
        UNION ALL SELECT id, 'error', 'missing parent' FROM k WHERE pid IS NULL
        UNION ALL SELECT id, 'error', 'parent is a unit' FROM k WHERE p_level = 'unit'
        UNION ALL SELECT id, 'error', 'not below its parent' FROM k WHERE place <= p_place
        UNION ALL SELECT id, 'error', 'unit outside a department' FROM k WHERE level = 'unit' AND p_level <> 'department'
        UNION ALL SELECT id, 'error', 'unit has children' FROM f WHERE level = 'unit' AND id IN (SELECT parent_id FROM f WHERE parent_id IS NOT NULL)
        UNION ALL SELECT id, 'warning', 'department has no units' FROM f WHERE level = 'department' AND id NOT IN (SELECT parent_id FROM f WHERE parent_id IS NOT NULL)""",
)
def org_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orgs(spark, sf_dir)
    wrong = F.when(F.col("id") == "c5", "c6").when(F.col("id") == "c7", "gone").when(F.col("id") == "c8", "r1").otherwise(F.col("parent_id"))
    more = spark.createDataFrame([("r1", "again", "district", None), ("z1", "odd", "planet", None), ("d1", "empty", "department", "r1")], o.schema)
    return H.validate(o.withColumn("parent_id", wrong).unionByName(more))


@query("unresolved_links", f"WITH {_ORGS} SELECT 'c' || o_custkey::VARCHAR AS org_id, o_orderkey AS job_id FROM orders WHERE 'c' || o_custkey::VARCHAR NOT IN (SELECT id FROM o WHERE id NOT LIKE '%7')")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = orgs(spark, sf_dir).where(~F.col("id").endswith("7"))
    return H.unresolved(links(spark, sf_dir), known)


@query(
    "org_match",
    """WITH t AS (SELECT s_suppkey, 'report of ' || n_name || CASE WHEN s_suppkey % 3 = 0 THEN ' bureau' ELSE '' END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey),
       m AS (SELECT s_suppkey AS job_id, 'n' || n_nationkey::VARCHAR AS org_id, 0.96 AS confidence, length(regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')) AS l FROM t JOIN nation ON contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')))
       SELECT job_id, org_id, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY l DESC, org_id DESC) AS k FROM m) WHERE k = 1""",
)
def org_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = orgs(spark, sf_dir).where("level = 'department'").withColumn("variants", F.array().cast("array<string>")).withColumn("keywords", F.array().cast("array<string>"))
    texts = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    texts = texts.select(F.col("s_suppkey").alias("job_id"), F.concat(F.lit("report of "), F.col("n_name"), F.when(F.col("s_suppkey") % 3 == 0, " bureau").otherwise("")).alias("text"))
    return H.match(texts, nations)


@query(
    "latest_per_scope",
    """SELECT o_custkey, fiscal_year, job_id FROM (SELECT o_custkey, year(o_orderdate)::INT AS fiscal_year, o_orderkey AS job_id,
       row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
)
def latest_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("fiscal_year", F.year("o_orderdate").cast("int"))
    return J.latest(rows, ["o_custkey", "fiscal_year"], [F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "fiscal_year", F.col("o_orderkey").alias("job_id"))


@query(
    "cleanup_plan",
    """WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey // 3 END AS version_id, o_orderstatus = 'P' AS cleaned, o_custkey, o_orderdate FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, job_id DESC) AS k FROM j),
       s AS (SELECT DISTINCT version_id FROM r WHERE k = 1 AND version_id IS NOT NULL)
       SELECT job_id, r.version_id::BIGINT AS version_id, CASE WHEN k = 1 THEN 'keep' WHEN r.version_id IS NULL OR cleaned THEN 'skip' WHEN s.version_id IS NOT NULL THEN 'blocked' ELSE 'delete' END AS action,
       CASE WHEN k = 1 THEN 'latest' WHEN r.version_id IS NULL THEN 'no version' WHEN cleaned THEN 'already cleaned' WHEN s.version_id IS NOT NULL THEN 'version in use' ELSE 'superseded' END AS reason
       FROM r LEFT JOIN s ON r.version_id = s.version_id""",
)
def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(key.alias("job_id"), F.when(key % 9 != 0, F.expr("o_orderkey div 3")).alias("version_id"), (F.col("o_orderstatus") == "P").alias("cleaned"), "o_custkey", "o_orderdate")
    return J.cleanup_plan(jobs, ["o_custkey"], [F.col("o_orderdate"), F.col("job_id")])


@query(
    "duplicate_lookup",
    """WITH d AS (SELECT doc_id AS job_id, source AS org_id, md5(text) AS checksum, CASE WHEN doc_id % 4 <> 0 THEN lang END AS kind FROM documents)
       SELECT n.job_id, min(o.job_id) AS duplicate_of, count(*) AS copies FROM d n JOIN d o ON n.checksum = o.checksum AND n.org_id = o.org_id AND n.job_id <> o.job_id AND (n.kind IS NULL OR n.kind IS NOT DISTINCT FROM o.kind) GROUP BY n.job_id""",
)
def duplicate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("org_id"), F.md5("text").alias("checksum"), F.lit(None).cast("int").alias("year"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("kind"))
    return J.duplicate_uploads(d, d)


@query(
    "job_stage_status",
    """WITH l AS (SELECT user_id AS job_id, event_type AS stage, arg_max(CASE WHEN value > 90 THEN 'failed' WHEN value > 20 THEN 'done' ELSE 'running' END, (ts, event_id)) AS status, max((ts, event_id)) AS last_at FROM events GROUP BY 1, 2)
       SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'done') THEN 'done' ELSE 'running' END AS state, arg_max(stage, last_at) AS stage, count(*) AS stages FROM l GROUP BY job_id""",
)
def job_stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 90, "failed").when(F.col("value") > 20, "done").otherwise("running")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), status.alias("status"), "ts", F.col("event_id").alias("seq"))
    return J.stage_status(events)


@query("rate_limit_blocked")
def rate_limit_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tighter limiter than the default, as the synthetic events are sparse."""
    out = J.rate_limited(table(spark, sf_dir, "events"), J.RateLimiter(3, 6 * 3600.0, 6 * 3600.0), "user_id", "ts", "event_id")
    return out.groupBy("user_id").agg(F.count_if(F.col("allowed")).alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))


@query("circuit_breaker")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    out = J.breaker_states(calls, J.CircuitBreaker(2, 24 * 3600.0), "user_id", "ts", "event_id", "ok")
    return out.groupBy("user_id").agg(F.count_if(F.col("passed")).alias("passed"), F.count_if(F.col("state") == "open").alias("open"))


@query(
    "latency_stats",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high, round(avg(length(props)), 6)::DOUBLE AS payload_mean, max(length(props))::INT AS payload_max FROM events GROUP BY event_type",
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.latency_stats(table(spark, sf_dir, "events").withColumn("size", F.length("props")), "event_type", "value", "size")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"), "low", "high", F.round("payload_mean", 6).alias("payload_mean"), "payload_max")


@query("provider_stats", "SELECT user_id, count(*) AS calls, count(CASE WHEN event_type <> 'error' THEN 1 END) AS successes, round(count(CASE WHEN event_type <> 'error' THEN 1 END)::DOUBLE / count(*), 6) AS success_rate, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean_ms FROM events GROUP BY user_id")
def provider_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.provider_stats(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", F.col("value"))


@query(
    "rule_params_active",
    """WITH v(rule_key, version, is_active, created_at, tolerance) AS (VALUES ('R001', 1, true, 10, 0.01), ('R001', 2, true, 20, 0.05), ('R001', 3, false, 30, 9.0), ('R002', 1, true, 5, 0.01), ('R003', 1, false, 5, 1.0), ('R004', 2, true, 7, 0.1), ('R004', 3, true, 7, 0.2))
       SELECT rule_key, version::INT AS version, tolerance::DOUBLE AS tolerance FROM (SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY created_at DESC, version DESC) AS k FROM v WHERE is_active) WHERE k = 1""",
)
def rule_params_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("R001", 1, True, 10, 0.01), ("R001", 2, True, 20, 0.05), ("R001", 3, False, 30, 9.0), ("R002", 1, True, 5, 0.01), ("R003", 1, False, 5, 1.0), ("R004", 2, True, 7, 0.1), ("R004", 3, True, 7, 0.2)]
    versions = spark.createDataFrame(rows, "rule_key string, version int, is_active boolean, created_at int, tolerance double")
    return J.active_rules(versions).select("rule_key", "version", "tolerance")


@query("order_inversion", "SELECT user_id, count(CASE WHEN value < before THEN 1 END) AS inversions FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def order_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", before.alias("before"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("value") < F.col("before")).alias("inversions"))


@query(
    "context_carry_forward",
    """SELECT user_id, section, count(*) AS n FROM (SELECT user_id, nullif(last_value(CASE WHEN event_type = 'signup' THEN 'open' WHEN event_type = 'error' THEN 'none' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'none') AS section FROM events) GROUP BY user_id, section""",
)
def context_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mode = F.last(F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "none"), ignorenulls=True).over(w)
    rows = table(spark, sf_dir, "events").select("user_id", F.nullif(mode, F.lit("none")).alias("section"))
    return rows.groupBy("user_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query(
    "header_prefix_count",
    """SELECT conv_id, greatest(1, sum(head))::INT AS header_rows FROM (SELECT conv_id, min(CASE WHEN length(text) < 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS head FROM conversations WHERE turn < 4) GROUP BY conv_id""",
)
def header_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "conversations").where("turn < 4").select("conv_id", F.min(F.when(F.length("text") < 400, 1).otherwise(0)).over(w).alias("head"))
    return rows.groupBy("conv_id").agg(F.greatest(F.lit(1), F.sum("head")).cast("int").alias("header_rows"))


# ------------------------------------------------- extensions beyond the audit rules


@query(
    "rollup_sales",
    "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


@query("tumbling_events", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "n")


@query(
    "session_events",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, count(DISTINCT k) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY user_id""",
)
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query(
    "org_department",
    f"""WITH RECURSIVE {_ORGS}, x AS (
          SELECT id, level, CASE WHEN level <> 'unit' THEN parent_id WHEN substr(id, 2)::BIGINT % 7 <> 0 THEN 'c' || (substr(id, 2)::BIGINT - 1)::VARCHAR ELSE parent_id END AS parent_id FROM o),
        up AS (SELECT id, id AS place, level, parent_id FROM x UNION ALL SELECT up.id, x.id, x.level, x.parent_id FROM up JOIN x ON up.parent_id = x.id WHERE up.level <> 'department')
        SELECT id, max(CASE WHEN level = 'department' THEN place END) AS department FROM up GROUP BY id""",
)
def org_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    # units hang below other units, up to seven deep
    number = F.substring("id", 2, 20).try_cast("long")
    chained = F.when((F.col("level") == "unit") & (number % 7 != 0), F.concat(F.lit("c"), (number - 1).cast("string"))).otherwise(F.col("parent_id"))
    return H.nearest_of_level(orgs(spark, sf_dir).withColumn("parent_id", chained)).withColumnRenamed("at", "department")
