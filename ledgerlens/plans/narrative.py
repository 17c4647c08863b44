"""Queries: what texts state against tables, and the table of grants; every order is a document.

The grids and pages are written out as reports print them, in more than one layout and
with the same sentences in other sections; the SQL states which orders are at fault.
k is the order's key, c its customer's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grant_table as G
from ..operators import narrative as V
from ..operators import sections as S
from .base import table
from .registry import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


def _pages(spark: SparkSession, sf_dir: str, texts: dict[int, str], dealt: bool = False) -> DataFrame:
    """pages(doc_id, page, text) of SQL expressions over k and c.  dealt: orders are dealt out first, while
    they are narrow, so that what reads the pages uses all cores however few pieces the table's file has."""
    each = F.array(*[F.struct(F.lit(n).alias("page"), F.expr(t).alias("text")) for n, t in texts.items()])
    orders = _orders(spark, sf_dir)
    return (orders.repartition("doc_id") if dealt else orders).select("doc_id", F.inline(each))


def _rows(spark: SparkSession, sf_dir: str, grids: dict[str, list[tuple[str, ...]]], where: str = "true") -> DataFrame:
    """rows(doc_id, t, row_idx, cells); cells are SQL expressions over k and c."""
    each = [F.struct(F.lit(t).alias("t"), F.lit(i).alias("row_idx"), F.array(*[F.expr(f"cast({x} as string)") for x in cells]).alias("cells")) for t, grid in grids.items() for i, cells in enumerate(grid)]
    return _orders(spark, sf_dir).where(where).select("doc_id", F.inline(F.array(*each)))


_D = "d AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, o_custkey AS c FROM orders)"


def _union(*parts: str) -> str:
    """Findings as (rule, lhs, rhs, where)."""
    return f"WITH {_D} " + " UNION ALL ".join(parts)


def _case(rule: str, lhs: str, rhs: str, where: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule, ({lhs})::DOUBLE AS lhs, ({rhs})::DOUBLE AS rhs FROM d WHERE {where}"


_OUT = ("doc_id", "rule", "lhs", "rhs")


@query(
    "section_wording",
    f"""WITH {_D}
    SELECT doc_id, 120.0::DOUBLE AS lhs, (100 + k % 50)::DOUBLE AS rhs, 3 AS page FROM d WHERE k % 50 >= 20
    UNION ALL SELECT doc_id, (40 + c % 20)::DOUBLE, 50.0::DOUBLE, 4 FROM d WHERE c % 20 >= 10
    UNION ALL SELECT doc_id, 170.0::DOUBLE, (150 + k % 50)::DOUBLE, 3 FROM d, range(2) WHERE k % 50 <> 20 AND c % 3 = 0""",
)
def section_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sentence on the whole counts for itself and as what stands before the first item
    pages = _pages(spark, sf_dir, {
        1: "'目录'",
        2: r"'二、收入决算情况\n1、年初预算为100.00万元，支出决算为90.00万元，决算数大于预算数。'",
        3: r"'三、一般公共预算财政拨款支出决算具体情况\n' || CASE WHEN c % 3 = 0 THEN '一般公共预算财政拨款支出年初预算为' || (150 + k % 50) || '.00万元，支出决算为170.00万元，完成年初预算，决算数与预算数基本持平。' ELSE '' END || '\n1、教育。年初预算为' || (100 + k % 50) || '.00万元，支出决算为120.00万元，决算数大于预算数。'",
        4: r"'2、卫生。年初预算为50.00万元，支出\n决算为' || (40 + c % 20) || '.00万元，决算数小于预算数。\n四、其他\n3、年初预算为1.00万元，支出决算为2.00万元，决算数小于预算数。'",
    })
    return S.expenditure_findings(pages).select("doc_id", "lhs", "rhs", "page")


@query("section_spans", f"WITH {_D} SELECT doc_id, p.page, p.open FROM d, (VALUES (1, 'none'), (2, 'a'), (3, 'b')) AS p(page, open) UNION ALL SELECT doc_id, 4, CASE WHEN k % 2 = 0 THEN 'b' ELSE 'none' END FROM d")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, {1: "'前言 #'", 2: r"'一、概况\n # '", 3: r"'续\n二、收入\n #'", 4: r"CASE WHEN k % 2 = 0 THEN '表' ELSE '三、支出' END || ' # 完'"})
    at = S.placed(pages)
    found = (S.Section("a", r"(?m)^一、", r"(?m)^二、"), S.Section("b", r"(?m)^二、", r"(?m)^三、"))
    spans = at.select("doc_id", "start", F.explode(S.hit_places(F.col("text"), "#")).alias("p")).select("doc_id", (F.col("start") + F.col("p")).alias("pos"))
    spans = S.of_span(spans, at, found).select("doc_id", "pos", F.coalesce(F.get("open", F.lit(0)), F.lit("none")).alias("open"))
    return S.page_of(spans, at).select("doc_id", "page", "open")


@query("narrative_totals", _union(
    _case("v33_101", "800", "1000", "k % 2 = 1"), _case("v33_101", "1020", "1000", "k % 6 = 0"),
    _case("v33_102", "1000 + c % 2 * 40", "CASE WHEN k % 2 = 1 THEN 800 WHEN k % 6 = 0 THEN 1020 ELSE 1000 END", "k % 2 = 1 OR k % 6 = 0 OR c % 2 = 1"),
))
def narrative_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, {"T1": [("'项目'", "'决算数'"), ("CASE WHEN k % 2 = 0 THEN '支出总计' ELSE '说明' END", "1000 + CASE WHEN k % 3 = 0 THEN 20 ELSE 0 END", "'12%'"), ("'本年支出合计'", "800"), ("'结余分配'", "50"), ("'年末结转和结余'", "150")]})
    pages = _pages(spark, sf_dir, {1: "CASE WHEN c % 5 = 0 THEN '总体情况' ELSE '总体情况 1。总体情况说明' END || '：支出' || (1000 + c % 2 * 40) || '万元。'", 7: "'总体情况说明5万元'"})
    return V.total_findings(pages, rows).select(*_OUT)


@query("narrative_income", _union(
    _case("v33_103_total", "1050 + k % 100", "1000 + k % 100", "k % 3 = 0"), _case("v33_103_grant", "430 + c % 50", "400 + c % 50", "c % 4 = 0"),
    _case("v33_103_share", "40 + k % 5", "round_even((400 + c % 50) / (1000 + k % 100) * 100, 2)", "abs(round_even((400 + c % 50) / (1000 + k % 100) * 100, 2) - (40 + k % 5)) > 1.0"),
))
def narrative_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, {"T2": [("'项目'", "'决算数'"), ("'本年收入合计'", "1000 + k % 100"), ("'财政拨款收入'", "400 + c % 50", "'45%'")]})
    pages = _pages(spark, sf_dir, {1: "'收入决算情况说明：本年收入合计' || (1000 + k % 100 + CASE WHEN k % 3 = 0 THEN 50 ELSE 0 END) || '万元，财政拨款收入'", 2: "(400 + c % 50 + CASE WHEN c % 4 = 0 THEN 30 ELSE 0 END) || '万元，占比' || (40 + k % 5) || '%。'"})
    return V.near_findings(pages, rows).select(*_OUT)


@query("narrative_expense", _union(
    _case("v33_104_total", "1050", "1000", "k % 3 = 0"), _case("v33_104_basic", "620", "600", "c % 4 = 0"), _case("v33_104_project", "390", "400", "k % 5 = 0"),
    _case("v33_104_basic_share", "60 + c % 3", "60", "c % 3 = 2"), _case("v33_104_project_share", "60 + c % 3", "40", "true"),
))
def narrative_expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the second share is told by the first percentage behind any of its words
    rows = _rows(spark, sf_dir, {"T3": [("'本年支出合计'", "'1,000.00'"), ("'基本支出'", "600"), ("'项目支出'", "400")]})
    pages = _pages(spark, sf_dir, {1: "'支出决算情况说明：' || CASE WHEN k % 3 = 0 THEN '1,050' ELSE '1000' END || '万元。基本支出' || CASE WHEN c % 4 = 0 THEN 620 ELSE 600 END || '万元，占比' || (60 + c % 3) || '%；项目支出' || CASE WHEN k % 5 = 0 THEN 390 ELSE 400 END || '万元。'"})
    return V.near_findings(pages, rows).select(*_OUT)


@query("narrative_grants", _union(
    _case("v33_105", "700 + k % 2 * 9", "700", "k % 2 = 1"), _case("v33_107", "330 + c % 3 * 7", "330", "c % 3 <> 0"),
))
def narrative_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, {"T4": [("'支出总计'", "700")], "T6": [("'人员经费合计'", "300"), ("'公用经费合计'", "30")]})
    pages = _pages(spark, sf_dir, {1: "'基本支出' || (330 + c % 3 * 7) || '万元。'", 2: "'财政拨款收入支出决算总体情况说明：' || (700 + k % 2 * 9) || '万元。'"})
    return V.near_findings(pages, rows).select(*_OUT)


@query("narrative_three_public", _union(_case("v33_108_budget", "50 + k % 2 * 5", "50", "k % 2 = 1"), _case("v33_108_final", "50 + k % 2 * 5", "45 + c % 3 * 5", "50 + k % 2 * 5 <> 45 + c % 3 * 5")))
def narrative_three_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both amounts are looked for behind 三公, so that the first number counts for both
    rows = _rows(spark, sf_dir, {"T7": [("'合计预算数'", "50"), ("'合计决算数'", "45 + c % 3 * 5")]})
    pages = _pages(spark, sf_dir, {1: "'“三公”经费年初预算' || (50 + k % 2 * 5) || '万元，支出决算45万元。'"})
    return V.near_findings(pages, rows).select(*_OUT)


@query(
    "narrative_class_shares",
    f"""WITH {_D}, s AS (SELECT doc_id, 100.0 * (300 + k % 40) / 1000 AS a, 30.0 + c % 4 AS b FROM d)
    SELECT doc_id, '201' AS message, b::DOUBLE AS lhs, a::DOUBLE AS rhs FROM s WHERE abs(a - b) > 2.0
    UNION ALL SELECT doc_id, '208', b::DOUBLE, 20.0::DOUBLE FROM s WHERE abs(20.0 - b) > 2.0""",
)
def narrative_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 结构情况 stands for every class: what follows it is the share of all of them
    rows = _rows(spark, sf_dir, {"T5": [("'201'", "7"), ("'20101'", "200 + k % 40"), ("'2010299'", "100"), ("'208 社保'", "200", "'20%'"), ("'合计'", "1000")]})
    pages = _pages(spark, sf_dir, {1: "'总体情况说明1000万元。'", 2: "'结构情况：占' || (30 + c % 4) || '%。'"})
    return V.class_share_findings(pages, rows).select("doc_id", "message", "lhs", "rhs")


_NULL = "CAST(NULL AS DOUBLE)"


@query("narrative_sections", _union(
    _case("v33_225", "1000 + k % 3 * 10", "1010", "k % 3 <> 1 AND c % 7 <> 0"), _case("v33_225", "0", "1010", "c % 7 = 0"),
    _case("v33_226_1", "305", _NULL, "c % 2 = 1"),
    _case("v33_220_basic", "200 + k % 4", _NULL, "k % 4 <> 0"), _case("v33_220_project", "100 + c % 3", _NULL, "c % 3 <> 0"),
    _case("v33_221", "709", "700", "k % 2 = 1"),
    _case("v33_223_personnel", "150 + c % 5", "150", "c % 5 <> 0"), _case("v33_223_public", "50", "50 + k % 3", "k % 3 <> 0"),
    _case("v33_224_total", "31", _NULL, "k % 2 = 1"), _case("v33_224_overseas", "11", _NULL, "c % 2 = 1"),
))
def narrative_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, {
        "T1": [("'总计'", "1010", "'总计'", "1010")], "T2": [("'合计'", "500", "300", "120", "80")], "T3": [("'合计'", "300", "200", "100")],
        "T4": [("'总计'", "700", "'总计'", "700")], "T6": [("'人员经费合计'", "150"), ("'公用经费合计'", "50 + k % 3")], "T7": [("'合计'", "30", "10", "0")],
    })
    pages = _pages(spark, sf_dir, {
        1: "'目录'",
        2: "'收入支出决算总体情况说明。' || CASE WHEN c % 7 = 0 THEN '见表' ELSE '收入支出总计' || (1000 + k % 3 * 10) || '万元。' END",
        3: "'收入决算情况说明。本年收入合计500万元，其中：财政拨款收入' || (300 + c % 2 * 5) || '万元，事业收入120万元，其他收入0万元。'",
        4: "'支出决算情况说明。基本支出' || (200 + k % 4) || '万元，项目支出' || (100 + c % 3) || '万元。'",
        5: "'名词解释：人员经费9万元，公用经费8万元，项目支出7万元，收入支出总计6万元，三公5万元。'",
        6: "'财政拨款收支总体情况说明。财政拨款收入支出总计' || (700 + k % 2 * 9) || '万元。'",
        7: "'一般公共预算基本支出：人员经费' || (150 + c % 5) || '万元，公用经费50万元。'",
        8: "'三公经费支出合计' || (30 + k % 2) || '万元，因公出国费' || (10 + c % 2) || '万元，公务接待费0万元。'",
        9: "'三公经费支出合计99万元。基本支出9万元，人员经费9万元。支出决算情况说明。收入决算情况说明。'",
    })
    return V.statement_findings(pages, rows).select(*_OUT)


@query(
    "narrative_classes",
    f"""WITH {_D} SELECT doc_id, '' AS message, 151.0::DOUBLE AS lhs, 150.0::DOUBLE AS rhs FROM d WHERE c % 2 = 1
    UNION ALL SELECT doc_id, '201一般公共服务', 100.0::DOUBLE, 101.0::DOUBLE FROM d WHERE k % 2 = 1
    UNION ALL SELECT doc_id, '208社会保障', (50 + c % 3)::DOUBLE, 50.0::DOUBLE FROM d WHERE c % 3 <> 0""",
)
def narrative_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, {"T5": [("'201 一般公共服务支出'", "100 + k % 2"), ("'20101 人大事务'", "5"), ("'208 社会保障支出'", "50", "20"), ("'合计'", "150")]})
    pages = _pages(spark, sf_dir, {1: "'一般公共预算财政拨款支出决算情况说明。支出' || (150 + c % 2) || '万元。一般公共服务100万元；'", 2: "'社会保障99万元'", 3: "'一般公共预算支出决算情况说明（续）：社会保障' || (50 + c % 3) || ' 万元。'"})
    return V.class_findings(pages, rows).select("doc_id", "message", "lhs", "rhs")


@query("narrative_zero_hints", f"WITH {_D} SELECT doc_id, 'page 2' AS message FROM d WHERE k % 3 = 0 AND c % 2 = 0")
def narrative_zero_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, {"T7": [("'合计'", "CASE WHEN c % 2 = 0 THEN '—' ELSE '3' END")]})
    pages = _pages(spark, sf_dir, {1: "'三公经费'", 2: "CASE WHEN k % 3 = 0 THEN '三公经费为0' ELSE '公务接待为0' END", 3: "'三公经费为0' || CASE WHEN k % 3 = 0 THEN '' ELSE NULL END"})
    return V.zero_hints(pages, rows).select("doc_id", "message")


# ------------------------------------------------------------- table of grants

_A, _B = "CASE WHEN k % 4 < 2 THEN 7 ELSE 0 END", "CASE WHEN c % 3 = 0 THEN 5 ELSE 0 END"
_FLAT = [
    ("'项目'", "'合计'", "'一般公共'", "'基金'", "'国有'"), ("'本年收入'", f"100 + {_A}", "60", "40", "0"), ("'年初结转'", "10", "10", "0", "0"), ("'总计'", f"110 + {_A}", "70", "40", "0"),
    ("'本年支出'", "90", "60", f"30 + {_B}", "'—'"), ("'年末 结转'", "20", "10", "10", "''"), ("'总计'", "110", "70", "40", "0"),
]
_SIDED = [
    ("'收入'", "'金额'", "'支出'", "'合计'", "'一般公共'", "'基金'", "'国有'"), ("'一、一般公共预算'", "60", "'一、教育'", "50", "50", "0", "0"), ("'二、政府性基金'", "40", "'二、城乡'", "40", "10", "30", "0"),
    ("'本年收入合计'", f"100 + {_A}", "'本年支出合计'", "90", "60", f"30 + {_B}", "0"), ("'年初结转和结余'", "10", "'年末结转和结余'", "20", "10", "10", "0"),
    ("'一般公共预算'", "10", "''", "''", "''", "''", "''"), ("'总计'", "110", "'总计'", "110", "70", "40", "0"),
]


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders print one line a row, odd ones both sides."""
    return _rows(spark, sf_dir, {"T4": _FLAT}, "k % 2 = 0").unionByName(_rows(spark, sf_dir, {"T4": _SIDED}, "k % 2 = 1"))


def _grant_case(message: str, lhs: str, rhs: str, where: str) -> str:
    return f"SELECT doc_id, '{message}' AS message, ({lhs})::DOUBLE AS lhs, ({rhs})::DOUBLE AS rhs FROM d WHERE {where}"


@query("grant_balances", _union(
    _grant_case("balance total", "117", "110", "k % 4 = 0"), _grant_case("income total", "110", "117", "k % 4 = 1"), _grant_case("carry total", "20", "27", "k % 4 < 2"),
    _grant_case("expense fund", "40", "45", "c % 3 = 0"), _grant_case("carry fund", "10", "5", "c % 3 = 0"),
))
def grant_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.balance_findings(_grants(spark, sf_dir)).select("doc_id", "message", "lhs", "rhs")


@query("grant_rows", _union(
    _grant_case("row 2", "107", "100", "k % 4 = 0"), _grant_case("row 4", "117", "110", "k % 4 = 0"), _grant_case("row 5", "90", "95", "k % 2 = 0 AND c % 3 = 0"), _grant_case("row 4", "90", "95", "k % 2 = 1 AND c % 3 = 0"),
))
def grant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.row_findings(_grants(spark, sf_dir)).select("doc_id", "message", "lhs", "rhs")


@query("grant_columns", _union(_grant_case("total", "117", "110", "k % 4 = 0"), _grant_case("fund", "40", "45", "k % 2 = 0 AND c % 3 = 0")))
def grant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.column_findings(_grants(spark, sf_dir)).select("doc_id", "message", "lhs", "rhs")


@query("grant_empty", _union(_grant_case("T8", "c % 4 * 10", "0", "k % 3 <> 0 AND c % 4 > 0"), _grant_case("T9", "6", "0", "k % 3 <> 1 AND c % 5 = 0")))
def grant_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    # neither table has a row of totals; every third order has no T4 at all
    t4 = _rows(spark, sf_dir, {"T4": [("'项目'", "'合计'", "'一般'", "'基金'", "'国有'"), ("'一'", "9", "9", "CASE WHEN k % 3 = 0 THEN 40 ELSE 0 END", "CASE WHEN k % 3 = 1 THEN 8 ELSE 0 END")]}, "k % 3 <> 2")
    rows = t4.unionByName(_rows(spark, sf_dir, {"T8": [("'基金'", "c % 4 * 4"), ("'基金'", "c % 4 * 6")], "T9": [("'资本'", "CASE WHEN c % 5 = 0 THEN '6' ELSE '' END")]}))
    return G.empty_findings(rows).select("doc_id", "message", "lhs", "rhs")


@query("grant_general", f"WITH {_D} SELECT doc_id, (30 + k % 3)::DOUBLE AS lhs, (30 + c % 2)::DOUBLE AS rhs FROM d WHERE k % 3 <> c % 2 AND k % 5 <> 0")
def grant_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the largest amount counts, wherever it stands; no finding where T4 has 0
    rows = _rows(spark, sf_dir, {"T4": [("'本年支出合计'", "CASE WHEN k % 5 = 0 THEN 0 ELSE 30 + k % 3 END", "50"), ("'支出合计'", "7", "7")], "T5": [("'小计合计'", "99"), ("'合计'", "5", "30 + c % 2", "3")]})
    return G.general_findings(rows).select("doc_id", "lhs", "rhs")


@query("narrative_public", _union(
    _case("cmm_001_total", "31", "30", "k % 4 = 0"), _case("cmm_001_abroad", "10 + c % 2", "10", "c % 2 = 1"),
    _case("cmm_001_car_run", "12", "11", "k % 3 = 0 AND k % 5 <> 0"), _case("cmm_001_car_run", "12", "13", "k % 3 = 0 AND k % 5 = 0"),
    _case("cmm_001_car_run", "11", "13", "k % 3 <> 0 AND k % 5 = 0"),
    _case("cmm_001_closure", "16", "17", "k % 3 = 0"),
))
def narrative_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the amounts stand in a line of the table's page, or (every fifth order) only in the grid
    rows = _rows(spark, sf_dir, {"T7": [("'合计'", "1", "2"), ("'决算'", "30", "10", "4", "16", "5", "13")]})
    line = r"CASE WHEN k % 5 = 0 THEN '见附表 1 2 3' ELSE '7 7 7 7 7 7 \n30.00 10.00 4.00 16.00 5.00 11.00' END"
    pages = _pages(spark, sf_dir, {
        1: "'目录 三公经费决算表 1 2 3 4 5 6 7'",
        3: rf"'三公经费支出决算表\n合计 出国 接待 小计 购置 运行\n' || {line}",
        4: r"'“三公”经费支出决算数为' || CASE WHEN k % 4 = 0 THEN 31 ELSE 30 END || '万元，其中：因公出国（境）费' || (10 + c % 2) || '万元，公务接待费4万元，公务用车购置及运行费为16万元（公务用车购置费5万元，公务用车运行费' || CASE WHEN k % 3 = 0 THEN 12 ELSE 11 END || '万元）。'",
    })
    return V.public_findings(pages, rows).select(*_OUT)
