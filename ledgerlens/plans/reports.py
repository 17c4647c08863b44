"""Queries: reporting, lookups, drill-down, inventories and grids over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import boxes, paging, tables
from .base import table
from .registry import query

_CENTS = "round({} * 100)::BIGINT"


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query(
    "star_lookup",
    """SELECT r_name AS region, n_name AS nation, count(*) AS reports, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE o_orderstatus = 'F' GROUP BY r_name, n_name""",
)
def star_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", _cents("o_totalprice").alias("cents"))
    # aggregated by customer before the dimension joins, so what is joined is small
    by = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("reports"), F.sum("cents").alias("cents"))
    joined = by.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("reports").alias("reports"), F.sum("cents").alias("cents"))


@query(
    "report_listing",
    """WITH k AS (SELECT l_orderkey, count(*) AS items, count(DISTINCT l_returnflag) AS tables FROM lineitem GROUP BY l_orderkey)
       SELECT o_orderkey AS report_id, n_name AS department, year(o_orderdate)::INT AS fiscal_year, coalesce(tables, 0) AS table_count, coalesce(items, 0) AS line_count
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN k ON o_orderkey = l_orderkey
       WHERE year(o_orderdate) >= 1995 AND (n_name ILIKE '%a%' OR c_mktsegment ILIKE '%build%')
       ORDER BY fiscal_year DESC, report_id LIMIT 50 OFFSET 20""",
)
def report_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("fiscal_year", F.year("o_orderdate").cast("int"))
    )
    rows = rows.where(paging.filters(equal={}, search="a", columns=("n_name",)) | F.col("c_mktsegment").ilike("%build%")).where("o_orderdate >= TIMESTAMP '1995-01-01'")
    page = paging.page(rows.select("o_orderkey", "n_name", "fiscal_year"), [F.desc("fiscal_year"), F.asc("o_orderkey")], limit=50, offset=20)
    # only the page's rows look up their counts: their keys, 50 at most, filter the lines before these are counted
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").join(F.broadcast(page.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    counts = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.size(F.collect_set("l_returnflag")).cast("long").alias("tables"))
    return page.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("report_id"), F.col("n_name").alias("department"), "fiscal_year", F.coalesce("tables", F.lit(0)).alias("table_count"), F.coalesce("items", F.lit(0)).alias("line_count")
    )


@query("report_total", "SELECT count(*) AS total FROM orders WHERE year(o_orderdate) >= 1995 AND upper(o_orderpriority) = '1-URGENT'")
def report_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = paging.filters(equal={"o_orderpriority": "1-urgent"}, search=None, columns=(), upper=("o_orderpriority",))
    return table(spark, sf_dir, "orders").where(where & (F.year("o_orderdate") >= 1995)).agg(F.count(F.lit(1)).alias("total"))


@query(
    "drilldown_cells",
    """SELECT l_orderkey AS version, l_linenumber::INT AS row_idx, c.col_idx::INT AS col_idx, c.raw_text
       FROM lineitem, LATERAL (SELECT unnest([1, 2, 3, 4]) AS col_idx, unnest([l_returnflag, l_linestatus, (round(l_quantity)::BIGINT)::VARCHAR, (round(l_extendedprice * 100)::BIGINT)::VARCHAR]) AS raw_text) c
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""",
)
def drilldown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_orderkey").alias("version"))
    cells = tables.cells_of(table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "version"}), ("version",), F.col("l_linenumber").cast("int"), {1: F.col("l_returnflag"), 2: F.col("l_linestatus"), 3: F.round("l_quantity").cast("long").cast("string"), 4: _cents("l_extendedprice").cast("string")})
    return cells.join(wanted, "version", "left_semi")


@query(
    "evidence_join",
    """WITH f AS (SELECT l_orderkey AS version, l_linenumber AS row_order FROM lineitem WHERE l_quantity = 50)
       SELECT f.version, count(*) AS cells, min(l_linenumber)::INT AS first_row FROM f JOIN lineitem c ON c.l_orderkey = f.version AND c.l_linenumber = f.row_order + 1 GROUP BY f.version""",
)
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    facts = lines.where("l_quantity = 50").select(F.col("l_orderkey").alias("version"), (F.col("l_linenumber") + 1).alias("row"))
    return facts.join(lines, (F.col("version") == F.col("l_orderkey")) & (F.col("row") == F.col("l_linenumber"))).groupBy("version").agg(F.count(F.lit(1)).alias("cells"), F.min("l_linenumber").cast("int").alias("first_row"))


@query(
    "code_mirror",
    """WITH c AS (SELECT c_nationkey AS code, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS code, count(*) AS n FROM supplier GROUP BY 1)
       SELECT coalesce(c.code, s.code)::INT AS code, c.n AS income, s.n AS expense,
       CASE WHEN c.n IS NULL THEN 'expense only' WHEN s.n IS NULL THEN 'income only' WHEN c.n <> s.n THEN 'differs' ELSE 'equal' END AS status
       FROM c FULL OUTER JOIN s ON c.code = s.code""",
)
def code_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("income"))
    expense = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("expense"))
    status = F.when(F.col("income").isNull(), "expense only").when(F.col("expense").isNull(), "income only").when(F.col("income") != F.col("expense"), "differs").otherwise("equal")
    return income.join(expense, "code", "full_outer").select("code", "income", "expense", status.alias("status"))


@query(
    "code_sets",
    """SELECT code::INT AS code, side FROM (
         SELECT code, 'both' AS side FROM (SELECT c_nationkey AS code FROM customer INTERSECT SELECT s_nationkey FROM supplier)
         UNION ALL SELECT code, 'customer only' FROM (SELECT c_nationkey AS code FROM customer EXCEPT SELECT s_nationkey FROM supplier))""",
)
def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("code"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("code"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("customer only")))


@query(
    "tolerance_matrix",
    """SELECT p_partkey, (abs(a - b) <= 0.01) AS absolute, (abs(a - b) <= greatest(1.0, 0.001 * abs(a), 0.001 * abs(b))) AS hybrid,
       (abs(a - b) <= greatest(0.05, 0.0005 * greatest(abs(a), abs(b)))) AS budget, NOT (abs(a - b) > 0.1) AS strict,
       (abs(a - b) <= CASE WHEN greatest(a, b) < 100 THEN 1.0 WHEN greatest(a, b) < 10000 THEN greatest(1.0, greatest(a, b) * 0.005) ELSE greatest(1.0, greatest(a, b) * 0.003) END) AS banded
       FROM (SELECT p_partkey, p_retailprice AS a, p_retailprice + (p_partkey % 7) * 0.3 AS b FROM part)""",
)
def tolerance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_retailprice"), F.col("p_retailprice") + (F.col("p_partkey") % 7) * 0.3
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        N.close(a, b, 0.01, nulls="zero").alias("absolute"),
        N.close(a, b, 1.0, 0.001).alias("hybrid"),
        N.close(a, b, 0.05, 0.0005).alias("budget"),
        N.close(a, b, 0.1).alias("strict"),
        (F.abs(a - b) <= N.banded_tolerance(a, b)).alias("banded"),
    )


@query(
    "unit_conversion",
    """SELECT p_partkey, unit, round(p_retailprice * CASE unit WHEN '元' THEN 0.0001 WHEN '亿元' THEN 10000.0 ELSE 1.0 END, 6) AS amount
       FROM (SELECT p_partkey, p_retailprice, (['元', '万元', '亿元', '?'])[(p_partkey % 4 + 1)::INT] AS unit FROM part)""",
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("元", "万元", "亿元", "?")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), F.round(N.to_ten_thousands(F.col("p_retailprice"), unit), 6).alias("amount"))


@query(
    "row_identity",
    """SELECT l_orderkey, l_linenumber::INT AS l_linenumber, (q <> a + b) AS flagged FROM (
       SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS q, (round(l_extendedprice * 100)::BIGINT // 3) AS a,
         round(l_extendedprice * 100)::BIGINT - (round(l_extendedprice * 100)::BIGINT // 3) + CASE WHEN l_linenumber = 5 THEN 7 ELSE 0 END AS b FROM lineitem)""",
)
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), _cents("l_extendedprice").alias("q"))
    rows = rows.withColumn("a", F.expr("q div 3")).withColumn("b", F.col("q") - F.col("a") + F.when(F.col("l_linenumber") == 5, 7).otherwise(0))
    return rows.select("l_orderkey", "l_linenumber", (~N.close(F.col("q"), F.col("a") + F.col("b"), 0.05)).alias("flagged"))


@query(
    "column_balance",
    """SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN c ELSE 0 END)::BIGINT AS opening, sum(CASE WHEN l_returnflag <> 'N' THEN c ELSE 0 END)::BIGINT AS moved, sum(c)::BIGINT AS closing,
       (l_orderkey % 6 = 0) AS flagged FROM (SELECT l_orderkey, l_returnflag, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem) GROUP BY l_orderkey""",
)
def column_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", _cents("l_extendedprice").alias("c"))
    new = F.col("l_returnflag") == "N"
    out = rows.groupBy("l_orderkey").agg(F.sum(F.when(new, F.col("c")).otherwise(0)).alias("opening"), F.sum(F.when(~new, F.col("c")).otherwise(0)).alias("moved"), F.sum("c").alias("closing"))
    stated = F.col("closing") + F.when(F.col("l_orderkey") % 6 == 0, 100).otherwise(0)
    return out.withColumn("flagged", ~N.close(F.col("opening") + F.col("moved"), stated, 1.0))


@query(
    "qc_outliers",
    """SELECT n_name, count(CASE WHEN b < 0 THEN 1 END) AS negatives, count(CASE WHEN b > 9000 THEN 1 END) AS large, CASE WHEN count(CASE WHEN b < 0 OR b > 9000 THEN 1 END) > 0 THEN 'warn' ELSE 'pass' END AS status
       FROM (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) JOIN nation ON k = n_nationkey GROUP BY n_name""",
)
def qc_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b")).union(table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal"))
    by = rows.groupBy("k").agg(F.count_if(F.col("b") < 0).alias("negatives"), F.count_if(F.col("b") > 9000).alias("large"))
    return by.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select("n_name", "negatives", "large", F.when(F.col("negatives") + F.col("large") > 0, "warn").otherwise("pass").alias("status"))


@query(
    "qc_adjustment_rate",
    """SELECT o_orderkey, CASE WHEN l IS NULL OR l = 0 THEN 'skip' WHEN rate > 30 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN rate > 30 THEN rate - 30 ELSE rate END AS diff
       FROM (SELECT o_orderkey, l, round(abs(o - l)::DOUBLE * 100 / nullif(l, 0)::DOUBLE, 4) AS rate FROM
         (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS o, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS l FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice))""",
)
def qc_adjustment_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("l"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _cents("o_totalprice").alias("o")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rate = F.round(F.try_divide(F.abs(F.col("o") - F.col("l")).cast("double") * 100, F.col("l").cast("double")), 4)
    rows = rows.withColumn("rate", rate)
    return rows.select("o_orderkey", F.when(F.col("rate").isNull(), "skip").when(F.col("rate") > 30, "warn").otherwise("pass").alias("status"), F.when(F.col("rate") > 30, F.col("rate") - 30).otherwise(F.col("rate")).alias("diff"))


@query(
    "missing_tables",
    """SELECT o_orderkey, f.flag AS missing FROM orders, (VALUES ('A'), ('N'), ('R')) f(flag)
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = f.flag)""",
)
def missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(have, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    need = F.array(*[F.lit(x) for x in ("A", "N", "R")])
    return rows.select("o_orderkey", F.explode(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))).alias("missing"))


@query(
    "table_quality",
    """WITH c AS (SELECT p_size AS table_idx, p_partkey AS row_idx, unnest([p_name, p_brand, p_size::VARCHAR, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE (round(p_retailprice)::BIGINT)::VARCHAR END]) AS raw_text, unnest([1, 2, 3, 4]) AS col_idx FROM part)
       SELECT table_idx::INT AS table_idx, count(DISTINCT row_idx) AS n_rows, count(CASE WHEN raw_text <> '' THEN 1 END) AS filled,
       round(0.4 * least(1.0, count(CASE WHEN raw_text <> '' THEN 1 END)::DOUBLE / count(*)) + 0.35 * count(CASE WHEN regexp_matches(raw_text, '^[0-9]+$') THEN 1 END)::DOUBLE / greatest(1, count(CASE WHEN raw_text <> '' THEN 1 END)) + 0.25 * least(1.0, max(col_idx) / 6.0), 6) AS score,
       (count(DISTINCT row_idx) >= 2 AND max(col_idx) >= 2 AND count(CASE WHEN raw_text <> '' THEN 1 END) >= greatest(4, count(DISTINCT row_idx))) AS meaningful FROM c GROUP BY table_idx""",
)
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("table_idx"), "p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("s"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.round("p_retailprice").cast("long").cast("string")).alias("price"))
    cells = tables.cells_of(part, ("table_idx",), F.col("p_partkey"), {1: F.col("p_name"), 2: F.col("p_brand"), 3: F.col("s"), 4: F.col("price")})
    return tables.quality(cells, "table_idx")


@query(
    "alias_detect",
    """WITH a(code, alias, ord) AS (VALUES ('METAL', 'STEEL', 1), ('METAL', 'BRASS', 2), ('SOFT', 'TIN', 3), ('SHINY', 'POLISHED', 4), ('PLAIN', 'ECONOMY', 5)),
       s AS (SELECT p_partkey, code, round(0.86 + least(0.12, 0.16 * length(alias) / greatest(length(p_type), length(alias))), 6) AS score, ord FROM part JOIN a ON contains(upper(p_type), alias))
       SELECT p_partkey, code, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, ord) AS k FROM s) WHERE k = 1""",
)
def alias_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("METAL", "STEEL", 1), ("METAL", "BRASS", 2), ("SOFT", "TIN", 3), ("SHINY", "POLISHED", 4), ("PLAIN", "ECONOMY", 5)], "code string, alias string, ord int")
    return tables.best_alias(table(spark, sf_dir, "part").select("p_partkey", F.upper("p_type").alias("title")), "p_partkey", "title", aliases)


@query(
    "bbox_overlap",
    """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 100) AS x0, (l_suppkey % 50) AS y0, (l_partkey % 100) + 40 AS x1, (l_suppkey % 50) + 30 AS y1 FROM lineitem),
       i AS (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o
         FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
       SELECT l_orderkey, a::INT AS a, b::INT AS b, round(o::DOUBLE / (2400 - o), 6) AS iou FROM i WHERE o::DOUBLE / (2400 - o) >= 0.5""",
)
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("idx"), tables.bbox(x, y, x + 40, y + 30).alias("box"))
    a, b = boxes.alias("a"), boxes.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.idx") < F.col("b.idx")))
    iou = tables.iou(F.col("a.box"), F.col("b.box"))
    return pairs.where(iou >= 0.5).select("a.l_orderkey", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), F.round(iou, 6).alias("iou"))


@query(
    "page_continuation",
    """WITH g AS (SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY conv_id, turn)
       SELECT a.conv_id, a.turn, (b.turn IS NOT NULL) AS continued, coalesce(b.n, 0) AS next_rows FROM g a LEFT JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def page_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    nxt = F.when(F.lead("turn").over(by) == F.col("turn") + 1, F.lead("n").over(by))
    return pages.select("conv_id", "turn", nxt.isNotNull().alias("continued"), F.coalesce(nxt, F.lit(0)).alias("next_rows"))


@query(
    "box_suppression",
    """WITH b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_partkey % 4 * 3 AS x0, l_suppkey % 3 * 2 AS y0,
         CASE WHEN l_partkey % 5 = 0 THEN 9 ELSE 40 END AS w, CASE WHEN l_partkey % 5 = 0 THEN 7 ELSE 30 END AS h, l_partkey % 3 AS priority FROM lineitem),
       l AS (SELECT page, list([{'id': id, 'x0': x0, 'y0': y0, 'x1': x0 + w, 'y1': y0 + h, 'area': w * h}] ORDER BY priority DESC, id) AS boxes FROM b GROUP BY page),
       k AS (SELECT page, list_reduce(boxes, lambda acc, n: CASE WHEN len(list_filter(acc, lambda o:
           greatest(0, least(o.x1, n[1].x1) - greatest(o.x0, n[1].x0)) * greatest(0, least(o.y1, n[1].y1) - greatest(o.y0, n[1].y0))
           >= least(0.75 * (o.area + n[1].area) / 1.75, 0.9 * least(o.area, n[1].area)))) > 0 THEN acc ELSE list_concat(acc, n) END) AS kept FROM l)
       SELECT page, unnest(list_transform(kept, lambda b: b.id))::INT AS id FROM k""",
)
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    small, x, y = F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 4 * 3, F.col("l_suppkey") % 3 * 2
    box = tables.bbox(x, y, x + F.when(small, 9).otherwise(40), y + F.when(small, 7).otherwise(30))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), place.cast("int").alias("id"), box.alias("box"), (F.col("l_partkey") % 3).alias("priority"))
    return boxes.suppressed(rows, ["page"]).select("page", "id")
