"""One query for each identity of a document and each sentence that states a table's value.

Every order is a document.  Its tables are built from a rule's operands, so that the
rows, words and places of the numbers are those that the operand looks for; amounts
are integer expressions of the order's key that Spark and SQL read alike.  Some
documents keep the identity, others are off by more than its tolerance.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import document_rules as R
from .base import table
from .registry import query

_BY_NAME = {o.name: o for o in R.OPERANDS}
#: fixed values: a sentence for each rule on stated amounts
SENTENCES = {
    "v33_225": "收入支出总计{}万元。",
    "v33_102": "收入总计为{}万元。",
    "v33_226": "本年收入合计{}万元。",
    "v33_103": "其中：财政拨款收入{}万元。",
    "v33_220_total": "本年支出合计{}万元。",
    "v33_220_basic": "基本支出{}万元。",
    "v33_220_project": "项目支出{}万元。",
    "v33_221": "财政拨款收入支出总计{}万元。",
    "v33_105": "财政拨款收支总计为{}万元。",
    "v33_222": "一般公共预算财政拨款支出{}万元。",
    "v33_223_personnel": "人员经费{}万元。",
    "v33_223_public": "公用经费{}万元。",
    "v33_224_total": "“三公”经费财政拨款支出决算为{}万元。",
    "v33_108": "“三公”经费财政拨款支出预算为{}万元。",
    "v33_224_overseas": "因公出国（境）费支出决算为{}万元。",
    "v33_224_reception": "公务接待费支出决算为{}万元。",
    "cmm_001_overseas": "因公出国（境）费{}万元，",
    "cmm_001_reception": "公务接待费{}万元；",
    "cmm_001_vehicle": "公务用车购置及运行维护费{}万元。",
    "cmm_001_vehicle_buy": "公务用车购置费{}万元。",
    "cmm_001_vehicle_run": "公务用车运行维护费{}万元。",
    "cmm_001_budget_overseas": "因公出国(境)费{}万元，",
    "cmm_001_budget_reception": "公务接待费{}万元；",
    "cmm_001_budget_vehicle": "公务用车购置及运行费{}万元。",
    "bud_107_income": "收入预算{}万元。",
    "bud_107_expense": "支出预算{}万元。",
    "bud_107_public": "“三公”经费预算数为{}万元。",
    "bud_108": "项目资金{}万元。",
}


def _names(text: str) -> list[str]:
    """Operands in an expression, in order."""
    return list(dict.fromkeys(w for w in re.findall(r"[a-z0-9_]+", text) if w in _BY_NAME))


def _values(r: R.Identity) -> dict[str, str]:
    """An integer expression of o_orderkey for each operand of the rule."""
    parts = {n: f"(1000 + (o_orderkey * {3 + 4 * k}) % 500)" for k, n in enumerate(_names(r.rhs))}
    own = " + ".join(parts.values()) or "0"
    for n in _names(r.lhs):
        parts[n] = f"({own} + CASE WHEN o_orderkey % 3 = 0 THEN 70 ELSE 0 END)"
    for n in _names(r.when):
        parts.setdefault(n, "(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 50 END)")
    return parts


def _grids(orders: DataFrame, values: dict[str, str]) -> DataFrame:
    """rows(doc_id, t, row_idx, cells) in which each operand has its value."""
    rows: dict[tuple, dict[int, str]] = {}
    for n, v in values.items():
        o = _BY_NAME[n]
        at = o.pick if isinstance(o.pick, int) else {"first": 0, "max": 0, "code": 0, "last": 9}[o.pick]
        rows.setdefault((o.table, o.row == "last", len("".join(o.words)), o.words, o.pick == "code"), {})[at] = v
    out = []
    # a shorter word may stand in a longer one, so its row comes first, or last where the last one counts
    for k, ((t, _, _, words, code), cells) in enumerate(sorted(rows.items())):
        last = max(cells)
        numbers = [cells.get(j) for j in range(min(last, 8) + 1)] + ([cells[9]] if last == 9 else [])
        filled = [F.lit("7") if v is None else F.expr(f"cast({v} as string)") for v in numbers]
        out.append(F.struct(F.lit(t).alias("t"), F.lit(k).alias("row_idx"), F.array(F.lit("" if code else "".join(words)), F.lit(words[0] if code else ""), *filled).alias("cells")))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*out)).alias("r")).select("doc_id", "r.*")


def _off(lhs: str, rhs: str, absolute: float, relative: float) -> str:
    return f"abs({lhs} - ({rhs})) > greatest({absolute}, {relative} * greatest(abs({lhs}), abs({rhs})))"


def _identity(r: R.Identity) -> None:
    values = _values(r)
    columns = ", ".join(f"{v}::DOUBLE AS {n}" for n, v in values.items())
    sql = f"SELECT doc_id, ({r.lhs})::DOUBLE AS lhs, ({r.rhs})::DOUBLE AS rhs FROM (SELECT o_orderkey AS doc_id, {columns} FROM orders) WHERE {r.when} AND {_off(r.lhs, r.rhs, r.absolute, r.relative)}"

    @query(f"rule_{r.rule}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _grids(table(spark, sf_dir, "orders"), values)
        wide = R.operands(rows, [_BY_NAME[n] for n in values])
        return R.identity_findings(wide, [r]).select("doc_id", "lhs", "rhs")


def _stated(s: R.Stated) -> None:
    values = {s.operand: "(1000 + (o_orderkey * 3) % 500)"}
    said = f"({values[s.operand]} + CASE WHEN o_orderkey % 4 = 0 THEN 90 ELSE 0 END)"
    lhs, rhs = f"{said}::DOUBLE", f"{values[s.operand]}::DOUBLE"

    @query(f"rule_{s.rule}_text", f"SELECT o_orderkey AS doc_id, {lhs} AS lhs, {rhs} AS rhs FROM orders WHERE {_off(lhs, rhs, s.absolute, s.relative)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        wide = R.operands(_grids(orders, values), [_BY_NAME[s.operand]])
        before, after = SENTENCES[s.rule].split("{}")
        text = F.concat(F.lit(f"情况说明\n{before}"), F.expr(f"cast({said} as string)"), F.lit(f"\n{after}"))
        # the first page that states an amount counts
        pages = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(2).alias("page"), text.alias("text")), F.struct(F.lit(3).alias("page"), F.lit(f"{before}5{after}").alias("text")), F.struct(F.lit(1).alias("page"), F.lit("目录").alias("text")))).alias("p")).select("doc_id", "p.*")
        return R.narrative_findings(pages, wide, [s]).select("doc_id", "lhs", "rhs")


for _r in R.IDENTITIES:
    _identity(_r)
for _s in R.STATED:
    _stated(_s)


# ------------------------------------------------------------- rows and texts


def _lines_of(spark: SparkSession, sf_dir: str, t: str, cells: tuple[str, ...], where: str = "true") -> DataFrame:
    """rows(doc_id, t, row_idx, cells): one row for each line of an order; cells are SQL expressions."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("k")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.floor("l_quantity").cast("long").alias("q"), place).where(where)
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(t).alias("t"), (F.col("k") + 2).cast("int").alias("row_idx"), F.array(*[F.expr(f"cast({c} as string)") for c in cells]).alias("cells"))


_L = "l AS (SELECT l_orderkey, l_partkey, l_suppkey, floor(l_quantity)::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)"
_SUM = "(3 * q + 7 + CASE WHEN l_partkey % 4 = 0 THEN 3 ELSE 0 END)"


def _row_rule(name: str, t: str, find, cells: tuple[str, ...], sql_lhs: str, sql_rhs: str, bad: str) -> None:
    @query(name, f"WITH {_L} SELECT l_orderkey AS doc_id, {sql_lhs}::DOUBLE AS lhs, ({sql_rhs})::DOUBLE AS rhs FROM l WHERE {bad}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(_lines_of(spark, sf_dir, t, cells)).select("doc_id", "lhs", "rhs")


_row_rule("rule_v33_210", "T2", lambda r: R.largest_findings(r, "T2", "v33_210", 2, skip="合计"), ("'收入'", "q", "2 * q", "7", _SUM), _SUM, "3 * q + 7", "l_partkey % 4 = 0")
_row_rule("rule_v33_211", "T3", lambda r: R.largest_findings(r, "T3", "v33_211", 3, parts=2), ("'支出'", _SUM, "2 * q + 7", "q"), _SUM, "3 * q + 7", "l_partkey % 4 = 0")
_row_rule("rule_v33_240", "T2", R.source_findings, ("'20' || cast(1 + k % 8 as string)", _SUM, "q", "2 * q", "7"), _SUM, "3 * q + 7", "l_partkey % 4 = 0")


@query(
    "rule_v33_120",
    f"""WITH {_L}, p AS (SELECT l_orderkey, sum(q) AS parts, sum(q) + CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 0 END AS own FROM l GROUP BY l_orderkey)
        SELECT l_orderkey AS doc_id, own::DOUBLE AS lhs, parts::DOUBLE AS rhs FROM p WHERE own <> parts""",
)
def code_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _lines_of(spark, sf_dir, "T3", ("'201' || lpad(cast(k as string), 2, '0')", "q"))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.floor("l_quantity")).alias("q"))
    own = sums.select(F.col("l_orderkey").alias("doc_id"), F.lit("T3").alias("t"), F.lit(2).alias("row_idx"), F.array(F.lit("201"), (F.col("q") + F.when(F.col("l_orderkey") % 3 == 0, 2).otherwise(0)).cast("string")).alias("cells"))
    return R.hierarchy_findings(parts.unionByName(own)).select("doc_id", "lhs", "rhs")


@query("rule_v33_114", f"WITH {_L} SELECT l_orderkey AS doc_id, 'T8 is empty without a note' AS message FROM l WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey HAVING count(*) <= 5")
def blank_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_of(spark, sf_dir, "T8", ("'基金'", "''", "'  '", "''"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("o_orderkey") % 3 == 0, "注：本单位无此项支出，故本表无数据。").otherwise("无数据").alias("text"))
    return R.blank_findings(rows, pages).select("doc_id", "message")


def _text_rule(name: str, find, text: str, hit: str, severity: str, hits: int = 1) -> None:
    """text: an SQL expression of an order's page; hit: which orders have a finding."""
    out = " UNION ALL ".join([f"SELECT o_orderkey AS doc_id, {severity} AS severity FROM orders WHERE {hit}"] * hits)

    @query(name, out)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.expr(text).alias("text"))
        return find(pages).select("doc_id", "severity")


_N = "cast(1 + o_custkey % 90 as string)"
_text_rule("rule_percent_range", R.TEXT_RULES["percent_range"], f"'执行率 ' || cast(o_custkey % 130 as string) || '%，完成 ' || {_N} || ' %。'", "o_custkey % 130 > 100", "'warn'")
_text_rule("rule_long_percent", R.TEXT_RULES["long_percent"], f"'占 ' || {_N} || '.' || cast(10 + o_custkey % 200 as string) || '%。'", "10 + o_custkey % 200 >= 100", "'info'")
_text_rule("rule_doubled_words", R.TEXT_RULES["doubled_words"], f"CASE WHEN o_custkey % 2 = 0 THEN '预算预算数为' ELSE '预算数为, ' END || {_N}", "true", "CASE WHEN o_custkey % 2 = 0 THEN 'warn' ELSE 'info' END")
_text_rule("rule_odd_wording", R.TEXT_RULES["odd_wording"], "CASE WHEN o_custkey % 4 = 0 THEN '支出增加 持平' ELSE '支出持平' END", "o_custkey % 4 = 0", "'warn'")
_text_rule("rule_zero_total", R.TEXT_RULES["zero_total"], "'收入合计为 ' || CASE WHEN o_custkey % 5 = 0 THEN '0.00' ELSE '12.50' END || ' 万元。'", "o_custkey % 5 = 0", "'warn'")
_text_rule("rule_placeholders", R.TEXT_RULES["placeholders"], "CASE WHEN o_custkey % 7 = 0 THEN '名称：待填写' WHEN o_custkey % 7 = 1 THEN '说明(略)' ELSE '名称：局' END", "o_custkey % 7 < 2", "'warn'")
_text_rule("rule_repeated_marks", R.TEXT_RULES["punctuation"], "CASE WHEN o_custkey % 3 = 0 THEN '收入。。支出' WHEN o_custkey % 3 = 1 THEN '收入，。支出' ELSE '收入，支出。' END", "o_custkey % 3 < 2", "'warn'")
_text_rule("rule_units", R.TEXT_RULES["units"], "CASE WHEN o_custkey % 3 = 0 THEN '单位：万元' WHEN o_custkey % 3 = 1 THEN '收入' ELSE '单位：万元 ' END", "o_custkey % 3 = 1", "'info'")
_text_rule("rule_zero_increase", R.TEXT_RULES["zero_increase"], f"'一般公共预算拨款支出预算 ' || CASE WHEN o_custkey % 3 = 0 THEN '0' ELSE {_N} END || '万元，比2023年预算增加' || {_N} || '万元'", "o_custkey % 3 = 0", "'error'")
_text_rule(
    "rule_direction",
    R.TEXT_RULES["direction"],
    f"'收入预算100万元，比2023年预算增加' || {_N} || '万元。支出预算100万元，比2023年预算' || CASE WHEN o_custkey % 2 = 0 THEN '减少' ELSE '增加' END || CASE WHEN o_custkey % 4 = 0 THEN '9999' ELSE {_N} END || '万元。'",
    "o_custkey % 2 = 0",
    "CASE WHEN o_custkey % 4 = 0 THEN 'warn' ELSE 'error' END",
)


@query("rule_v33_110", "SELECT o_orderkey AS doc_id, (200 + o_custkey % 7 * 10)::DOUBLE AS lhs, 230.0::DOUBLE AS rhs FROM orders WHERE o_custkey % 7 * 10 <= 30")
def wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("支出预算为230万元，支出决算为"), (F.lit(200) + F.col("o_custkey") % 7 * 10).cast("string"), F.lit("万元，决算数大于预算数。"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
    return R.wording_findings(pages).select("doc_id", "lhs", "rhs")
