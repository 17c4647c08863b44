"""Operators on small known inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dictionaries as D
from ledgerlens.operators import document_rules as R
from ledgerlens.operators import facts as M
from ledgerlens.operators import findings as A
from ledgerlens.operators import hierarchy as H
from ledgerlens.operators import jobs as J
from ledgerlens.operators import paging, qc, tables, text_rules

CELLS = "version long, table_code string, id long, row_idx int, col_idx int, raw_text string, numeric_value double, page_number int, confidence double, unit_hint string"


def grid(rows, table="FIN_03_expenditure", page=12):
    out, k = [], 0
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            k += 1
            out.append((1, table, k, r, c, text, None, page, 0.9, "万元" if c == 2 else None))
    return out


def materialized(spark, rows, cols):
    cells = spark.createDataFrame(grid(rows), CELLS)
    maps = spark.createDataFrame([(1, "FIN_03_expenditure", c, n, n, 0.95) for c, n in cols], "version long, table_code string, source_col_idx int, source_col_name string, canonical_measure string, confidence double")
    inst = spark.createDataFrame([(1, "FIN_03_expenditure", 0.94, "expenditure")], "version long, table_code string, confidence double, classification_type string")
    return M.materialize(cells, maps, inst), cells


def test_materialize(spark):
    rows = [["科目", "名称", "合计", "基本", "项目"], ["201", "一般公共服务", "100.00", "60.00", "40.00"], ["20101", "人大事务", "100.00", "60.00", ""], ["", "合计", "100.00", "60.00", ""]]
    facts, cells = materialized(spark, rows, [(2, "total_actual"), (3, "basic_actual"), (4, "project_actual")])
    got = {(r["classification_code"], r["measure"]): r for r in facts.collect()}
    assert len(got) == 7
    first = got["201", "total_actual"]
    assert (first["classification_level"], first["parent_classification_code"], first["hierarchy_path"], first["source_page_number"]) == (1, None, ["201"], 12)
    assert got["20101", "basic_actual"]["parent_classification_code"] == "201" and got["20101", "basic_actual"]["classification_level"] == 2
    assert got["total", "total_actual"]["classification_level"] == 0 and got["total", "total_actual"]["classification_name"] == "合计"
    assert first["source_cell_ids"] == [6, 7, 8] and first["parse_confidence"] == 0.9
    wide = {r["classification_code"]: r for r in M.wide_items(facts).collect()}
    assert wide["201"]["values"] == {"total_actual": 100.0, "basic_actual": 60.0, "project_actual": 40.0} and wide["20101"]["type_code"] == "20101"
    assert M.drilldown(facts, cells).count() == sum(len(r["source_cell_ids"]) for r in got.values())
    assert M.nested_tables(cells).first()["row_count"] == 4


def test_split_codes_join(spark):
    facts, _ = materialized(spark, [["201", "03", "01", "12029501.84"]], [(3, "total_actual")])
    r = facts.first()
    assert (r["classification_code"], r["amount"], r["classification_level"], r["parent_classification_code"]) == ("2010301", 12029501.84, 3, "20103")


FACTS = "version long, table_code string, classification_code string, classification_name string, measure string, amount double"


def fixture_facts(version=1, off=0.0):
    e, b, p = "FIN_03_expenditure", "FIN_06_basic_expenditure", "FIN_07_three_public"
    rows = [(e, "合计", "合计", "total_actual", 10724.72 + off), (e, "合计", "合计", "basic_actual", 2493.19), (e, "合计", "合计", "project_actual", 8231.53)]
    rows += [(e, c, c, "total_actual", v) for c, v in (("201", 9819.74), ("208", 433.03), ("210", 87.21), ("221", 384.74))]
    rows += [(b, c, c, "total_actual", v) for c, v in (("301", 2194.77), ("302", 154.16), ("303", 130.23), ("310", 14.03))]
    rows += [(p, "total", "合计", "budget", 867.5), (p, "overseas", "出国", "budget", 839.0), (p, "total", "合计", "actual", 592.15), (p, "overseas", "出国", "actual", 587.6), (p, "reception", "接待", "actual", 4.55)]
    return [(version, *r) for r in rows]


def test_reconciliation_known_answers(spark):
    facts = spark.createDataFrame(fixture_facts() + fixture_facts(2, 5.0), FACTS)
    got = {(r["version"], r["rule_key"]): r for r in qc.findings(facts).collect()}
    assert len(got) == 30
    for k in ("R001", "R002", "R004", "R005", "R012", "R014"):
        assert got[1, k]["status"] == "pass", k
    assert got[2, "R001"]["status"] == got[2, "R002"]["status"] == "fail" and got[2, "R001"]["diff"] == 5.0
    assert (got[1, "R009"]["status"], got[1, "R009"]["skip_reason"]) == ("skip", "table_not_found")
    assert got[1, "R015"]["status"] == "fail" and got[1, "R015"]["lhs"] == 2.0


def test_reconciliation_empty_part(spark):
    rows = [(1, "FIN_08_gov_fund", "total", "合计", "total_actual", 5.0)]
    got = {r["rule_key"]: r for r in qc.findings(spark.createDataFrame(rows, FACTS)).collect()}
    assert (got["R009"]["status"], got["R009"]["skip_reason"]) == ("skip", "no_data")


ROWS = "doc_id long, t string, row_idx int, cells array<string>"


def test_identities_and_hierarchy(spark):
    rows = [
        (1, "T1", 0, ["本年收入合计", "100", "本年支出合计", "90"]),
        (1, "T1", 1, ["使用非财政拨款结余", "0", "结余分配", "0"]),
        (1, "T1", 2, ["年初结转和结余", "0", "年末结转和结余", "10"]),
        (1, "T1", 3, ["总计", "100", "总计", "100"]),
        (1, "T3", 0, ["201", "一般", "90", "50", "40"]),
        (1, "T3", 1, ["20101", "人大", "80", "50", "30"]),
        (1, "T3", 2, ["合计", "90", "50", "40"]),
        (2, "T3", 0, ["201", "一般", "90", "50", "39"]),
        (2, "T3", 1, ["合计", "91", "50", "40"]),
        (3, "B1", 0, ["收入总计", "10", "支出总计", "19"]),
    ]
    df = spark.createDataFrame(rows, ROWS)
    wide = R.operands(df, R.OPERANDS)
    found = {(r["doc_id"], r["rule"]) for r in R.identity_findings(wide, R.IDENTITIES).collect()}
    assert found == {(2, "v33_241_total"), (3, "bud_101")}
    assert [(r["doc_id"], r["message"], r["lhs"], r["rhs"]) for r in R.hierarchy_findings(df).collect()] == [(1, "T3 201", 90.0, 80.0)]
    assert [(r["doc_id"], r["message"]) for r in R.row_findings(df).collect()] == [(2, "T3 201")]
    docs = spark.createDataFrame([(1, "final"), (2, "final"), (3, "budget")], "doc_id long, kind string")
    pages = spark.createDataFrame([(1, 1, "本年支出合计 95 万元，其中：基本支出50.00万元"), (2, 1, ""), (3, 1, "收入预算 11 万元")], "doc_id long, page int, text string")
    every = {(r["doc_id"], r["rule"]) for r in R.run_rules(pages, df, docs).collect()}
    assert {(1, "v33_220_total"), (2, "v33_241_total"), (3, "bud_101"), (3, "bud_107_income")} <= every
    broken = R.Rule("bad", "any", lambda pages, rows, wide: wide.select("nope"))
    assert {r["severity"] for r in R.run_rules(pages, df, docs, [broken]).collect()} == {"hint"}


def test_structure(spark):
    pages = spark.createDataFrame([(1, 1, "目录 收入决算表"), (1, 2, "收入支出决算总表"), (1, 3, "支出决算表"), (1, 4, "收入决算表"), (1, 5, "一般公共预算财政拨款支出决算表")], "doc_id long, page int, text string")
    found = R.anchors(pages, D.FINAL_TABLES)
    assert {(r["t"], r["page"]) for r in found.collect()} == {("T1", 2), ("T3", 3), ("T2", 4), ("T5", 5)}
    docs = spark.createDataFrame([(1, 5, 100)], "doc_id long, pages int, filesize long")
    assert {r["message"] for r in R.missing_tables(docs, found, D.FINAL_TABLES).collect()} == {f"{t} is missing" for t in ("T4", "T6", "T7", "T8", "T9")}
    first = R.first_anchor(found, pages.select("doc_id", "page").where("page = 99"))
    assert [r["message"] for r in R.order_inversions(first, D.FINAL_TABLES).collect()] == ["T2 is out of order"]
    assert [r["message"] for r in R.size_findings(docs).collect()] == ["fewer than 8 pages"]
    rows = spark.createDataFrame([(1, "T8", 0, ["合计", "0"]), (1, "T9", 0, ["合计", "-"])], ROWS)
    noted = spark.createDataFrame([(1, 6, "本单位无政府性基金预算")], "doc_id long, page int, text string")
    assert [r["message"] for r in R.empty_tables(rows, noted, {"T8": "无政府性基金", "T9": "无国有资本"}).collect()] == ["T9 is empty without a note"]
    grids = spark.createDataFrame([(1, 1, 0, 4, 0, ["a", "1"]), (1, 1, 1, 2, 0, ["z"]), (1, 2, 0, 4, 0, ["b", "2"]), (1, 2, 0, 4, 1, ["合计", "3"])], "doc_id long, page int, table_idx int, n_cells int, row_idx int, cells array<string>")
    assert [(r["row_idx"], r["cells"][0]) for r in R.continued(grids).where("page = 1").orderBy("row_idx").collect()] == [(0, "a"), (1, "b"), (2, "合计")]


def test_text_rules(spark):
    pages = spark.createDataFrame([(1, 1, "XX局预算预算，，数据\n2024,1,300\n增加 持平。"), (1, 2, "收入预算100万元，比2023年预算增加5万元。支出预算100万元，比2023年预算减少5万元。"), (2, 1, "某拨款支出预算0万元，比2023年预算增加3万元")], "doc_id long, page int, text string")
    got = text_rules.placeholder_findings(pages).collect()
    assert [(r["page"], r["pos"], r["message"]) for r in got] == [(1, 0, "placeholder: XX")]
    assert [r["message"] for r in text_rules.punctuation_findings(pages).collect()] == ["repeated punctuation: ，，"]
    assert {r["message"] for r in text_rules.page_findings(pages, text_rules.DOUBLED, "doubled").collect()} == {"doubled word: 预算预算"}
    assert text_rules.page_findings(pages, text_rules.ODD_WORDING, "wording", compacted=True).count() == 1
    assert [r["severity"] for r in text_rules.direction_findings(pages).collect()] == ["error"]
    assert [r["doc_id"] for r in text_rules.zero_increase_findings(pages).collect()] == [2]
    docs = spark.createDataFrame([(1, "/x/2024年预算.pdf"), (2, "none")], "doc_id long, path string")
    years = text_rules.report_year(pages, docs, ("预算",))
    assert {r["doc_id"]: r["year"] for r in years.collect()} == {1: 2024, 2: 2023}


def test_recognition(spark):
    rows = [(1, "2024年收入支出决算总表", None, ["项目", "本年收入", "本年支出"]), (2, "编制说明", None, []), (3, "", "fin_03 something", []), (4, "一般公共预算财政拨款基本支出决算表", None, ["人员经费", "公用经费"])]
    df = spark.createDataFrame(rows, "id int, title string, hint string, headers array<string>")
    got = {r["id"]: (r["table_code"], r["score"]) for r in tables.detect_table(df, "id", D.recognition()).collect()}
    assert got[1][0] == "FIN_01_income_expenditure_total" and got[2] == (None, 0.0) and got[3] == ("FIN_03_expenditure", 0.92) and got[4][0] == "FIN_06_basic_expenditure" and got[4][1] >= 0.98
    heads = spark.createDataFrame([("财政拨款收入（万元）",), ("其他",)], "header string")
    assert [r["measure"] for r in tables.match_measure(heads, list(D.FACT_TABLES[1][3])).collect()][0] == "fiscal_allocation"
    for x, y in (("收入决算表", "部门收支决算总表"), ("abcd", "xxabzcdxx"), ("ab", "ba"), ("总表", "支出")):
        short, long = sorted((x, y), key=len)
        lcs = lambda u, v: 0 if not u or not v else 1 + lcs(u[1:], v[1:]) if u[0] == v[0] else max(lcs(u[1:], v), lcs(u, v[1:]))
        windows = [long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))]
        assert abs(tables.partial_ratio(x, y) - max(200 * lcs(short, w) / (len(short) + len(w)) for w in windows)) < 1e-9
    assert tables.partial_ratio("abc", "xxabcxx") == 100.0 and tables.partial_ratio("", "a") == 0.0


def test_grids(spark):
    cells = spark.createDataFrame([(1, 0, 0, "支出决算表"), (1, 1, 0, "科目"), (1, 1, 1, "合计"), (1, 2, 0, "201"), (1, 2, 1, "1,000.5")], "id int, row_idx int, col_idx int, raw_text string")
    assert tables.title_of(cells, "id").first()["title"] == "支出决算表"
    assert tables.header_rows(cells, "id", "决算表").first()["header_rows"] == 2
    assert {r["col_idx"]: r["is_measure"] for r in tables.measure_columns(cells, "id").collect()} == {0: False, 1: True}
    g = "id int, page int, table_idx int, table_code string, width int, numeric_ratio double, header_rows int, repeated_header boolean"
    grids = spark.createDataFrame([(1, 1, 0, "A", 5, 0.5, 2, False), (1, 2, 0, "UNKNOWN", 5, 0.6, 1, False), (1, 3, 0, "UNKNOWN", 5, 0.6, 1, False), (1, 4, 0, "B", 5, 0.6, 1, False), (1, 9, 0, "B", 5, 0.6, 1, False)], g)
    assert [r["island"] for r in tables.coalesce_tables(grids, "id").orderBy("page").collect()] == [1, 1, 1, 2, 3]
    boxes = spark.createDataFrame([(1, 1, (0, 0, 10, 10), 1.0), (1, 2, (0, 0, 10, 9), 2.0), (1, 3, (50, 50, 60, 60), 0.5)], "page int, id int, box struct<x0:int,y0:int,x1:int,y1:int>, priority double")
    assert sorted(r["id"] for r in tables.spatial_dedupe(boxes, "page", "priority").collect()) == [2, 3]


F9 = "doc_id long, id string, ord int, rule string, severity string, title string, page int, pos int, section string, table string, tags array<string>, metrics map<string,double>, confidence double, message string"


def issue(doc, id, title, page=1, sev="high", tags=("a",), metrics=None, pos=0):
    return (doc, id, int(id[1:]), "r", sev, title, page, pos, "s", None, list(tags), metrics or {}, 0.5, title)


def test_merge(spark):
    ai = spark.createDataFrame([issue(1, "a0", "sum differs", metrics={"v": 100.0}), issue(1, "a1", "sum differs", page=2), issue(1, "a2", "other thing")], F9)
    rule = spark.createDataFrame([issue(1, "r0", "sum differs", sev="info", metrics={"v": 100.1}), issue(2, "r0", "alone")], F9)
    pairs = A.candidate_pairs(ai, rule, tables.sequence_ratio_udf)
    m = A.greedy_matches(pairs)
    assert [(r["ai_id"], r["rule_id"]) for r in m.collect()] == [("a0", "r0")]
    c = A.conflicts(m, ai, rule)
    assert [(r["reasons"], r["reason"]) for r in c.collect()] == [(["severity-mismatch"], "severity-mismatch")]
    assert {tuple(r) for r in A.merge_totals(ai, rule, c).collect()} == {(1, 3, 1, 1, 1, 0, 3), (2, 0, 1, 0, 0, 0, 1)}
    assert [r["id"] for r in A.merged_ids(ai, rule, m).where("doc_id = 1").orderBy("place").collect()] == ["a0", "a1", "a2"]


def test_smart_merge(spark):
    kind = "doc_id long, ord int, rule string, description string, snippet string, confidence string"
    rule = spark.createDataFrame([(1, 0, "R1", "total does not add up", "row 5", "LOW"), (1, 1, "R2", "short", "x", "LOW")], kind)
    ai = spark.createDataFrame([(1, 0, "R1", "total does not add up here", "row 5 of table", "LOW"), (1, 1, "R9", "something else entirely", None, "HIGH")], kind)
    got = {(r["rule"], r["source"]): r for r in A.smart_merge(rule, ai).collect()}
    assert set(got) == {("R1", "rule_and_ai"), ("R9", "ai")}
    assert got["R1", "rule_and_ai"]["confidence"] == "MEDIUM" and got["R1", "rule_and_ai"]["description"] == "total does not add up here"


def test_numbering_and_dedupe(spark):
    df = spark.createDataFrame([issue(1, "f0", "b", page=None), issue(1, "f1", "a", page=2, pos=30), issue(1, "f2", "a", page=2, pos=40), issue(1, "f3", "c", page=1)], F9)
    assert [r["id"] for r in A.numbered(df).orderBy("no").collect()] == ["f3", "f1", "f2", "f0"]
    assert sorted(r["id"] for r in A.dedupe(df, A.semantic_key()).collect()) == ["f0", "f1", "f3"]
    assert A.without_noise(df, ("^b$", "zz")).count() == 3


def test_hierarchy(spark):
    orgs = spark.createDataFrame([("c", "city", "city", None), ("d", "dept", "department", "c"), ("u", "unit", "unit", "d"), ("x", "x", "department", "y"), ("y", "y", "department", "x")], "id string, name string, level string, parent_id string")
    assert {(r["ancestor"], r["descendant"], r["depth"]) for r in H.closure(orgs.where("id in ('c','d','u')")).collect()} == {("c", "c", 0), ("d", "d", 0), ("u", "u", 0), ("c", "d", 1), ("d", "u", 1), ("c", "u", 2)}
    assert {r["id"] for r in H.cycles(orgs).collect()} == {"x", "y"}
    assert [r["id"] for r in H.minimal_roots(orgs.where("id in ('c','d','u')"), "city|unit").collect()] == ["c"]
    rows = spark.createDataFrame([("1", "top", None), ("2", "mid", "top"), ("3", "low", "mid"), ("4", "lost", "nobody")], "id string, name string, parent_name string")
    taken, rest = H.resolve_parents(rows, spark.createDataFrame([], "id string, name string"))
    assert taken.count() == 3 and [r["id"] for r in rest.collect()] == ["4"]
    known = spark.createDataFrame([("o1", "上海市普陀区财政局", "department", ["普陀区财政局"], []), ("o2", "上海市", "city", [], [])], "id string, name string, level string, variants array<string>, keywords array<string>")
    texts = spark.createDataFrame([(1, "上海市普陀区财政局2024年度部门决算"), (2, "普陀区财政局部门预算"), (3, "无关")], "job_id int, text string")
    got = {r["job_id"]: (r["org_id"], round(r["confidence"], 2)) for r in H.match(texts, known).collect()}
    assert got == {1: ("o1", 0.99), 2: ("o1", 0.96)} or (got[1] == ("o1", 0.99) and 3 not in got)
    assert H.name_variants("上海市普陀区人民政府（本级）", ("人民政府",), ("上海市",))


def test_jobs(spark):
    limiter = J.RateLimiter(2, 60, 60)
    state, out = limiter.start(), []
    for t in (0, 1, 2, 30, 62, 63, 200):
        state, ok = limiter.step(state, float(t))
        out.append(ok)
    assert out == [True, True, False, False, True, True, True]
    breaker = J.CircuitBreaker(2, 10)
    state, out = breaker.start(), []
    for t, ok in ((0, False), (1, False), (2, True), (12, False), (13, True), (30, True)):
        state, through = breaker.step(state, float(t), ok)
        out.append((through, state[0]))
    assert out == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed")]
    new = spark.createDataFrame([(2, "o", "c1", None, "b"), (3, "o", "c1", 2024, "b")], "job_id int, org_id string, checksum string, year int, kind string")
    old = spark.createDataFrame([(1, "o", "c1", 2023, "b")], "job_id int, org_id string, checksum string, year int, kind string")
    assert [(r["job_id"], r["duplicate_of"]) for r in J.duplicate_uploads(new, old).collect()] == [(2, 1)]
    w = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "job_id int, v string, ord int")
    assert {(r["job_id"], r["v"]) for r in J.last_write(w, "job_id", "ord").collect()} == {(1, "b"), (2, "c")}


def test_paging(spark):
    df = spark.createDataFrame([(k, f"n{k}%") for k in range(10)], "id int, name string")
    assert [r["id"] for r in paging.page(df, [F.col("id")], 3, 4).collect()] == [4, 5, 6]
    assert df.where(paging.filters({"id": None}, "3%", ("name",))).count() == 1
    assert [r["id"] for r in paging.explicit_order(df, "id", [7, 2], F.col("id")).limit(3).collect()] == [7, 2, 0]
    with pytest.raises(ValueError):
        paging.identifier("a; drop")


def test_review_items(spark):
    kind = "version long, recognized array<string>, unknown array<string>, low array<string>, facts_count int, profile string"
    rows = [(1, list(D.CORE_TABLES[:3]), ["u1"], ["FIN_01_income_expenditure_total"], 0, "statement_set"), (2, list(D.CORE_TABLES), [], [], 5, "statement_set")]
    got = M.review_items(spark.createDataFrame(rows, kind), D.CORE_TABLES).collect()
    assert {r["version"] for r in got} == {1} and sorted(r["type"] for r in got) == ["fact_materialization_empty", "low_confidence_table", *["missing_core_table"] * 3, "unknown_table"]
    assert dt.date.today().year > 2000


def test_page_rules(spark):
    pages = spark.createDataFrame([(1, 1, "单位：万元 占比 120.5% 和 50%"), (1, 2, "单位：元"), (2, 1, "nothing")], "doc_id long, page int, text string")
    assert [r["message"] for r in text_rules.percent_findings(pages).collect()] == ["120.5% is out of range"]
    assert {r["doc_id"]: r["message"] for r in text_rules.unit_findings(pages).collect()} == {1: "mixed units: 万元, 元", 2: "no money unit"}
    rows = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "a", 4), (1, "b", 2)], "k int, v string, o int")
    assert text_rules.dominant(rows, "k", "v", "o").first()["v"] == "b"
    needles = spark.createDataFrame([(1, 7, "占比，120.5%"), (1, 8, "absent")], "doc_id long, id int, needle string")
    assert {r["id"]: r["page"] for r in text_rules.page_of_text(needles, pages).collect()} == {7: 1, 8: None}


def test_announced_tables(spark):
    lines = spark.createDataFrame([(1, 0, "单位：万元"), (1, 1, "2024年支出决算表"), (2, 0, "text")], "id int, idx int, line string")
    none = spark.createDataFrame([], "id int, table_code string")
    got = tables.placeholder_tables(lines, "id", none, [{"code": "FIN_03_expenditure", "aliases": ("支出决算表",), "required": ()}])
    assert [tuple(r) for r in got.collect()] == []  # 0.72 of a title alone is not enough
    strong = [{"code": "FIN_03_expenditure", "aliases": ("2024年支出决算表",), "required": ()}]
    assert [r["table_code"] for r in tables.placeholder_tables(lines, "id", none, strong).collect()] == ["FIN_03_expenditure"]
    heads = spark.createDataFrame([("科目 编码",), ("合计",)], "h string")
    assert [r[0] for r in heads.select(tables.is_dimension_header(F.col("h"))).collect()] == [True, False]


def test_trees_of_any_depth(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(14)], "id long, parent_id long")
    got = H.closure(chain).collect()
    assert len(got) == 14 * 15 // 2 and all(r["depth"] == r["descendant"] - r["ancestor"] for r in got)
    assert H.cycles(chain).count() == 0
    ring = spark.createDataFrame([(k, (k + 1) % 12) for k in range(12)] + [(20, 3), (21, None), (22, 21)], "id long, parent_id long")
    assert {r["id"] for r in H.cycles(ring).collect()} == set(range(12))
    assert H.closure(ring).where("descendant = 20").count() == 13


def test_amounts_beside_codes(spark):
    """Two columns of codes, a longer code above them, and a blank amount."""
    cells = [["13010", "x", "7"], ["301", "a", "100", "302", "b", "40"], ["303", "c", "", "310", "d", "5"], ["人员经费合计", "100", "公用经费合计", "45"]]
    rows = spark.createDataFrame([(1, "T6", k, c) for k, c in enumerate(cells)], "doc_id long, t string, row_idx int, cells array<string>")
    got = R.operands(rows, R.OPERANDS).first()
    assert (got["t6_301"], got["t6_302"], got["t6_310"]) == (100.0, 40.0, 5.0)
