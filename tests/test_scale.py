"""Plans that keep their size: no shuffle, sort or row more than the job needs."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.operators import document_rules as R
from ledgerlens.operators import facts as M
from ledgerlens.operators import narrative as V
from ledgerlens.operators import qc
from ledgerlens.plans import base, documents, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def physical(spark, df, text=lambda plan: plan.toString()) -> str:
    """The plan before it adapts, without the sizes of its inputs."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return text(df()._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["qc_findings", "qc_r001", "qc_r009", "qc_r011", "qc_r014", "union_findings"])
def test_facts_are_not_shuffled(spark, name):
    plan = physical(spark, lambda: registry.queries()[name](spark, SF))
    facts = [k for k in plan.split("Exchange hashpartitioning(")[1:] if k.startswith("version") and "REPARTITION_BY_COL" not in k.split("]")[0]]
    assert facts == []


def test_a_rule_computes_its_own_operands(spark):
    plan = physical(spark, lambda: registry.queries()["qc_r001"](spark, SF))
    assert "FIN_08_gov_fund" not in plan.split("Union")[0] and "Join" not in plan
    facts = base.statement_facts(spark, SF)
    every = {(r["version"], r["rule_key"]): r for r in qc.findings(facts).collect()}
    for key in ("R004", "R011", "R013"):
        one = qc.findings(facts, only=(key,)).collect()
        assert len(one) * 15 == len(every) and all(every[r["version"], key] == r for r in one)


@pytest.mark.parametrize(("name", "most"), [("table_payload", 2), ("materialize_facts", 2), ("line_items_json_map", 2)])
def test_cells_of_a_row_are_not_grouped_again(spark, name, most):
    """Lists are collected once: tables of their rows, or the columns that are mapped."""
    plan = physical(spark, lambda: registry.queries()[name](spark, SF))
    assert plan.count("ObjectHashAggregate(") + plan.count("SortAggregate(") <= most


def test_rows_give_what_cells_give(spark):
    rows, cells = documents.statement_rows(spark, SF).where("version < 60"), documents.statement_cells(spark, SF).where("version < 60")
    plain = lambda df: sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect())
    assert plain(M.nested_tables(cells)) == plain(M.nested_rows(rows))
    maps = documents._recognized(cells.select("version", "table_code").distinct())
    facts, found = M.materialize(cells, *maps), M.row_facts(rows, *maps)
    assert plain(facts) == plain(M.unpivoted(found)) and facts.count() > 100
    assert plain(M.wide_items(facts)) == plain(M.wide_rows(found))


def test_plain_amounts_are_read_as_all_others(spark):
    texts = ["1", "-1", "1,234.50", "-1,2,3.5", "1.", ".5", "1.2,3", "--1", "-", "—", "", None, "(5)", "（1,000）", "12万元", " 7 ", "7\n", "1-2", "01", "1..2", "－3", "٣"]
    want = [1.0, -1.0, 1234.5, -123.5, None, None, 1.23, 1.0, None, None, None, None, -5.0, -1000.0, 12.0, 7.0, 7.0, None, 1.0, None, -3.0, None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(N.parse_amount(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == want


def test_grants_are_read_in_one_pass(spark):
    plan = physical(spark, lambda: registry.queries()["grant_balances"](spark, SF))
    assert plan.count("Exchange hashpartitioning(") == 1


def test_plain_numbers_are_read_as_all_others(spark):
    texts = ["1", "-1", "1,234.50", "1,23", "12,345,678", "1.", ".5", "- 5", "5%", "-", "", None, "x", "12x", " 7 ", "7\n", "1 2", "01", "1..2", "－3", "٣"]
    want = [1.0, -1.0, 1234.5, None, 12345678.0, None, None, -5.0, 5.0, None, None, None, None, None, 7.0, 7.0, None, 1.0, None, None, None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(N.parse_number(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == want


def test_rules_read_what_is_stored_once(spark):
    """No rule computes the rows from the tables anew, or reads a row's numbers again."""
    plan = registry.queries()["document_rules"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "Window [row_number() windowspecdefinition(version" not in plan


@pytest.mark.parametrize("name", ["qc_findings", "qc_r001", "qc_r010", "qc_r011", "union_findings"])
def test_rows_are_not_taken_apart_into_facts(spark, name):
    """Only verdicts are exploded; lines are shuffled once and read once for them."""
    plan = physical(spark, lambda: registry.queries()[name](spark, SF))
    assert plan.count("Generate explode(") == 1 and plan.count("REPARTITION_BY_COL") == 1


def test_findings_of_rows_are_those_of_their_facts(spark):
    order = lambda df: sorted(map(str, df.collect()))
    assert order(qc.row_findings(*base.statement_lines(spark, SF))) == order(qc.findings(base.statement_facts(spark, SF)))
    # nulls, codes of other lengths and tables that only some rows have
    rows = spark.createDataFrame([(1, "201", 5.0, -1.0, True), (1, "2", None, 2.0, None), (2, "20199", 3.0, 2e7, False), (None, "201", 1.0, None, True), (3, "total", None, None, True)], "version long, code string, a double, b double, has boolean")
    a, b = (F.col(c).cast("decimal(18,2)") for c in ("a", "b"))
    five, three = "FIN_05_general_public_expenditure", "FIN_03_expenditure"
    facts = [qc.Fact(three, F.col("code"), F.col("code"), "total_actual", a), qc.Fact(three, F.col("code"), F.lit("合计"), "total_budget", b)]
    facts += [qc.Fact(five, F.col("code"), F.lit("x"), "total_actual", a, F.col("has")), qc.Fact(five, F.concat("code", F.lit("01")), F.lit("x"), "total_actual", b, F.col("has"))]
    plain = base._exploded(rows, facts, F.lit(1))
    for only in ((), ("R011",), ("R002",), ("R014",), ("R010",), ("R015",)):
        assert order(qc.row_findings(rows, facts, {}, [], only=only)) == order(qc.findings(plain, only=only))


@pytest.mark.parametrize("name", ["union_findings", "qc_findings"])
def test_verdicts_make_code_that_is_compiled(spark, name):
    """The JVM compiles methods of up to 8,000 bytes."""
    code = physical(spark, lambda: registry.queries()[name](spark, SF), spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString)
    found = re.findall(r"maxMethodCodeSize:(\d+)", code)
    assert found and max(map(int, found)) <= 8000


@pytest.mark.parametrize("name", ["qc_findings", "qc_r001", "qc_r008", "qc_r011", "qc_r012", "qc_r014", "union_findings"])
def test_cents_add_up_as_whole_numbers(spark, name):
    """Decimals of over 18 digits are objects, one for each row and sum."""
    plan = physical(spark, lambda: registry.queries()[name](spark, SF))
    grouped = [line for line in plan.splitlines() if "HashAggregate(keys=[version" in line]
    assert grouped and not any("decimal" in line.lower() for line in grouped)


def test_whole_cents_are_those_of_decimals(spark, tmp_path):
    """Prices of more than two decimals, halves, negative, large and missing ones; sums that do not fit go by decimals."""
    odd = [1.005, 2.675, -0.125, -1.5, 0.1 + 0.2, 1e7, 10000000.01, 99999.995, 0.0, None, 123456789012.34, 4.35, -7.0, 9007199254740.993]
    rows = [(k % 5 if k < 12 else None if k == 12 else 77, k, v, d) for k, v in enumerate(odd) for d in (0.05, 0.07, None)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double")
    order = lambda df: sorted(map(str, df.collect()))
    for name, more, fits in (("small", [], True), ("large", [(77, k, 8e14, 0.0) for k in range(12)], False)):
        at = str(tmp_path / name)
        df.union(spark.createDataFrame(more, df.schema)).write.parquet(f"{at}/lineitem.parquet")
        assert base.sums_fit(spark, at) == fits
        want = order(qc.findings(base.statement_facts(spark, at)))
        assert order(registry.queries()["qc_findings"](spark, at)) == want
        for key in ("R008", "R011", "R014"):
            assert order(registry.queries()[f"qc_{key.lower()}"](spark, at)) == [r for r in want if f"'{key}'" in r]


_GRID = "doc_id int, t string, row_idx int, cells array<string>"


def test_leaves_as_in_plain_sums(spark):
    """Tables of any width and depth, without a sort of their rows; totals with codes, blanks in words, repeated totals."""
    rng = random.Random(4)
    rows = []
    for d in range(60):
        for t in ("T2", "T3", "T7"):
            width = rng.choice((0, 1, 3, 8, 9, 20))
            amounts = lambda n: [str(rng.choice((0, 1, 5, 100))) if rng.random() < 0.9 else "" for _ in range(n)]
            for k in range(rng.randint(0, 6)):
                head = rng.choice(("201", "20101", "2010101", "合计", "总 计", "203 合计", "x", None))
                rows.append((d, t, k, [head, *amounts(rng.choice((width, width, max(width - 1, 0))))]))
    rows.append((None, "T2", 0, None))
    want = set()
    for d, t in {(r[0], r[1]) for r in rows if r[0] is not None and r[1] != "T7"}:
        own = [(k, "".join(c for c in cells if c), [float(x) for x in cells[1:] if x], re.match(r"\d{3}(\d{2}){0,4}", cells[0] or "")) for e, u, k, cells in rows if (e, u) == (d, t)]
        codes = [(len(m.group()), v) for _, _, v, m in own if m and v]
        totals = [v for _, text, v, _ in sorted(own, key=lambda r: r[0]) if "合计" in text or "总计" in text]
        if codes and totals:
            leaves = [v for n, v in codes if n == max(codes)[0]]
            for c, whole in enumerate(totals[0]):
                part = [v[c] for v in leaves if len(v) > c]
                diff = abs(sum(part) - whole)
                if part and diff > max(1.0, abs(sum(part)) * 0.001) and (whole == 0 or diff / abs(whole) > 0.5):
                    want.add((d, f"{t} {c}", whole, sum(part)))
    found = R.leaf_findings(spark.createDataFrame(rows, _GRID))
    got = [(r["doc_id"], r["message"], r["lhs"], r["rhs"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 30 and any(int(m.split()[1]) > 8 for _, m, _, _ in got)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_read_once_for_parents_and_children(spark):
    found = R.hierarchy_findings(spark.createDataFrame([(1, "T3", 0, ["201", "5"]), (1, "T3", 1, ["20101", "3"]), (1, "T3", 2, ["2010101", "3"])], _GRID))
    assert [(r["message"], r["lhs"], r["rhs"]) for r in found.collect()] == [("T3 201", 5.0, 3.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_documents_without_a_wanted_row_have_operands(spark):
    rows = spark.createDataFrame([(1, "T3", 0, ["合 计", "5", "2"]), (2, "T3", 0, ["x", "1"]), (3, "T6", 0, [" 301 ", "7"]), (4, "X", 0, ["合计", "1"]), (None, "T3", 0, ["合计", "9"]), (5, "T6", 0, None)], _GRID)
    got = {r["doc_id"]: (r["t3_total"], r["t3_basic"], r["t6_301"]) for r in R.operands(rows, R.OPERANDS).collect()}
    assert got == {1: (5.0, 2.0, None), 2: (None, None, None), 3: (None, None, 7.0), None: (9.0, None, None), 5: (None, None, None)}
    values = {r["doc_id"]: r["t3_total"] for r in V.row_values(rows).collect()}
    assert 2 not in values and values[None] == 9.0


def test_rules_without_their_tables_are_left_out(spark):
    plan = registry.queries()["document_rules"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "cmm_004" not in plan and "v33_242" not in plan and "v33_241" in plan
    grid = [(1, t, k, ["20" + str(k), str(v)]) for t in ("T2", "T3") for k, v in ((1, 5), (2, 6 if t == "T2" else 7))]
    docs = spark.createDataFrame([(1, "final")], "doc_id int, kind string")
    pages = spark.createDataFrame([(1, 1, "")], "doc_id int, page int, text string")
    found = R.run_rules(pages, spark.createDataFrame(grid, _GRID), docs).where("rule = 'cmm_004'")
    assert [r["message"] for r in found.collect()] == ["202"]
