"""Queries: text rules, numbers and years in text, lines, windows, token sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import text_rules as R
from .base import table
from .registry import query


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")


#: marks that the synthetic prose uses for unfilled text
MARKS = tuple(R.Pattern(p, "placeholder") for p in (r"&&&", r"%%%", r"\$\$\$"))
_COUNT = " + ".join(f"len(regexp_extract_all(line, '{p.regex}'))" for p in MARKS)
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("placeholder_hits", f"WITH {_LINES} SELECT doc_id, sum({_COUNT})::BIGINT AS hits FROM l WHERE trim(line) <> '' GROUP BY doc_id HAVING sum({_COUNT}) > 0")
def placeholder_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placeholder_findings(_pages(spark, sf_dir), MARKS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "placeholder_top8",
    f"""WITH {_LINES}, c AS (SELECT doc_id, sum({_COUNT})::BIGINT AS n FROM l WHERE trim(line) <> '' GROUP BY doc_id)
        SELECT doc_id, least(n, 8)::BIGINT AS kept FROM c WHERE n > 0""",
)
def placeholder_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placeholder_findings(_pages(spark, sf_dir), MARKS, per_page=8).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "punctuation_hits",
    f"WITH {_LINES} SELECT doc_id, sum(len(regexp_extract_all(line, '!!+|,,+|\\.\\.+')))::BIGINT AS repeated, sum(len(regexp_extract_all(line, ',!|!,|,\\.|\\.,|!\\.|\\.!')))::BIGINT AS mixed FROM l GROUP BY doc_id",
)
def punctuation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.lines(_pages(spark, sf_dir))
    count = lambda p: F.sum(F.regexp_count("line", F.lit(p))).cast("long")
    return rows.groupBy("doc_id").agg(count(r"([!,.])\1+").alias("repeated"), count(r"([!,.])(?!\1)[!,.]").alias("mixed"))


@query("percent_precision", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\\.[0-9]{3,}'))::BIGINT AS hits FROM documents WHERE len(regexp_extract_all(text, '[0-9]+\\.[0-9]{3,}')) > 0")
def percent_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.page_findings(_pages(spark, sf_dir), (R.Pattern(r"[0-9]+\.[0-9]{3,}", "long fraction", "info"),), "precision")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "line_numbering",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
       n AS (SELECT doc_id, k, length(line) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, k) AS place FROM l WHERE trim(line) <> '')
       SELECT doc_id, k::INT AS line_no, chars::INT AS chars, place::INT AS place FROM n""",
)
def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.lines(_pages(spark, sf_dir)).where(F.trim("line") != "").select("doc_id", "line_no", F.length("line").alias("chars"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "line_no")
    return rows.withColumn("place", F.row_number().over(order))


@query(
    "text_windows",
    """SELECT doc_id, (k * 10800)::INT AS start, md5(substr(text, (k * 10800 + 1)::INT, 12000)) AS digest
       FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 1200) / 10800.0)::INT))) AS k FROM documents)""",
)
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.windows(F.col("text"), 12000, 1200, None)).alias("w"))
    return rows.select("doc_id", F.col("w.start").alias("start"), F.md5("w.text").alias("digest"))


@query("dup_uploads", "WITH d AS (SELECT doc_id, source, sha256(text) AS checksum FROM documents) SELECT source, checksum, min(doc_id) AS first_doc, count(*) AS copies FROM d GROUP BY source, checksum HAVING count(*) > 1")
def dup_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("checksum"))
    return rows.groupBy("source", "checksum").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(
    "extract_years",
    """SELECT o_orderkey, ys[1] AS year, len(ys)::INT AS n FROM (SELECT o_orderkey, list_transform(regexp_extract_all('report-' || o_orderkey::VARCHAR || '-' || strftime(o_orderdate, '%Y') || '-x', '-(20[0-9][0-9])-', 1), lambda y: y::INT) AS ys FROM orders) WHERE len(ys) > 0""",
)
def extract_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("report-"), F.col("o_orderkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy"), F.lit("-x"))
    found = F.transform(F.regexp_extract_all(name, F.lit("-(20[0-9][0-9])-"), F.lit(1)), lambda y: y.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("ys")).where(F.size("ys") > 0).select("o_orderkey", F.get("ys", F.lit(0)).alias("year"), F.size("ys").alias("n"))


@query(
    "year_vote",
    """WITH v AS (SELECT o_custkey, year(o_orderdate)::INT AS y, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 6 ELSE 1 END + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END) AS w FROM orders GROUP BY 1, 2)
       SELECT o_custkey, y AS year FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, y DESC) AS k FROM v) WHERE k = 1""",
)
def year_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("o_orderpriority") == "1-URGENT", 6).otherwise(1) + F.when(F.col("o_orderstatus") == "P", 2).otherwise(0)
    votes = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("int").alias("y")).agg(F.sum(w).alias("w"))
    return votes.groupBy("o_custkey").agg(F.max_by("y", F.struct("w", "y")).alias("year"))


@query("majority_value", "WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) SELECT o_custkey, v AS majority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS k FROM c) WHERE k = 1")
def majority_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return counts.groupBy("o_custkey").agg(F.max_by("v", F.struct("n", -F.col("first"))).alias("majority"))


_CELL = "(['1,234.50', '(' || p_size::VARCHAR || ')', '-', p_partkey::VARCHAR || '%', p_name, ' ' || p_size::VARCHAR || '.5 ', '—', ''])[(p_partkey % 8 + 1)::INT]"


@query(
    "parse_numbers",
    f"""WITH c AS (SELECT p_partkey, {_CELL} AS cell FROM part)
        SELECT p_partkey, CASE WHEN regexp_matches(trim(cell), '^-?[ ]*([0-9]{{1,3}}(,[0-9]{{3}})*|[0-9]+)(\\.[0-9]+)?[ ]*%?$') THEN replace(replace(trim(cell), ',', ''), '%', '')::DOUBLE END AS strict,
        TRY_CAST(CASE WHEN regexp_matches(replace(replace(trim(cell), ',', ''), '%', ''), '^\\([0-9.]+\\)$') THEN '-' || replace(replace(replace(trim(cell), ',', ''), '(', ''), ')', '')
          WHEN regexp_matches(replace(replace(trim(cell), ',', ''), '%', ''), '^-?[0-9]+(\\.[0-9]+)?$') THEN replace(replace(trim(cell), ',', ''), '%', '') END AS DOUBLE) AS amount,
        (trim(cell) IN ('-', '—', '')) AS blank FROM c""",
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    cell = F.element_at(F.array(F.lit("1,234.50"), F.concat(F.lit("("), size, F.lit(")")), F.lit("-"), F.concat(F.col("p_partkey").cast("string"), F.lit("%")), F.col("p_name"), F.concat(F.lit(" "), size, F.lit(".5 ")), F.lit("—"), F.lit("")), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").withColumn("cell", cell).select("p_partkey", N.parse_number(F.col("cell")).alias("strict"), N.parse_amount(F.col("cell")).alias("amount"), N.is_blank_cell(F.col("cell")).alias("blank"))


@query(
    "amount_pairs",
    """SELECT o_orderkey, regexp_extract(t, 'budget ([0-9]+)', 1)::DOUBLE AS left_amount, regexp_extract(t, 'actual ([0-9]+)', 1)::DOUBLE AS right_amount
       FROM (SELECT o_orderkey, 'budget ' || (o_totalprice::BIGINT)::VARCHAR || ' and actual ' || (o_custkey)::VARCHAR AS t FROM orders)""",
)
def amount_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("budget "), F.bround("o_totalprice", 0).cast("long").cast("string"), F.lit(" and actual "), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(X.pairs(t, "budget ", "actual ")).alias("p"))
    return rows.select("o_orderkey", F.col("p.left").alias("left_amount"), F.col("p.right").alias("right_amount"))


@query(
    "jaccard_pairs",
    """WITH t AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM benchmark),
       p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(list_distinct(list_concat(a.w, b.w))) AS every FROM t a JOIN t b ON a.item_id < b.item_id)
       SELECT a, b, round(shared::DOUBLE / every, 6) AS jaccard FROM p WHERE 10 * shared >= 3 * every""",
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of at least 0.3: sets that similar share one of their n - ceil(0.3 n) + 1 rarest words."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w")).where(F.size("w") > 0)
    each = rows.select("item_id", F.size("w").alias("size"), F.explode("w").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(counts, "word").groupBy("item_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("t"))
    head = ranked.select("item_id", "size", F.explode(F.slice("t", F.lit(1), (F.col("size") - F.ceil(F.col("size") * 3 / 10) + 1).cast("int"))["word"]).alias("word"))
    a, b = head.alias("a"), head.alias("b")
    near = (F.col("a.size") * 10 >= F.col("b.size") * 3) & (F.col("b.size") * 10 >= F.col("a.size") * 3)
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.item_id") < F.col("b.item_id")) & near).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).distinct()
    both = met.join(rows.select(F.col("item_id").alias("a"), F.col("w").alias("aw")), "a").join(rows.select(F.col("item_id").alias("b"), F.col("w").alias("bw")), "b")
    shared, every = F.size(F.array_intersect("aw", "bw")), F.size(F.array_union("aw", "bw"))
    return both.where(shared * 10 >= every * 3).select("a", "b", F.round(X.jaccard(F.col("aw"), F.col("bw")), 6).alias("jaccard"))


@query("key_value_parse", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, 3 AS keys FROM orders")
def key_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("status="), F.col("o_orderstatus"), F.lit("; priority ="), F.col("o_orderpriority"), F.lit(" ;noise; key= "), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.key_values(t).alias("m"))
    return rows.select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"), F.size("m").alias("keys"))


@query("json_props", "SELECT event_id, event_type, (props->>'$.k')::INT AS k, (props->>'$.missing') IS NULL AS no_other FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "int").isNull().alias("no_other"))


@query("text_normal_forms", "SELECT doc_id, length(regexp_replace(lower(text), '\\s', '', 'g'))::INT AS compact_chars, (text LIKE '%the%' AND text LIKE '%and%') AS both_words, ((length(text) - length(replace(text, 'th', ''))) // 2)::INT AS repeats FROM documents")
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.compact(F.lower(t))).alias("compact_chars"), X.contains_all(t, ("the", "and")).alias("both_words"), X.occurrences(t, F.lit("th")).alias("repeats"))
