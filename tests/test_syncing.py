"""Promotion of units and codes of the shared schema."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerlens.operators import registry_sync as R


def test_store_of_a_district(spark):
    departments = spark.createDataFrame([("d1", "D001", "上海市普陀区商务委员会", 1), ("d2", "D002", "某某中心", 2)], "id string, code string, name string, sort_order long")
    units = [("u1", "d1", "U001", "上海市普陀区商务委员会单位", 1), ("u2", "d2", "U002", "长风街道办事处", 2), ("u3", "d2", "U003", "财政局本级", 3), ("u4", "gone", "U004", "孤儿", 4), ("u5", "d1", None, "普陀区商务委员会", 5)]
    df = spark.createDataFrame(units, "id string, department_id string, code string, name string, sort_order long")
    got = {r["id"]: r for r in R.organization_store(departments, df, "上海市", "普陀区").collect()}
    by = {(r["level"], r["name"]): r for r in got.values()}
    key = lambda level, parent, name: hashlib.md5(f"{level}:{parent}:{name}".encode()).hexdigest()[:12]
    assert by["city", "上海市"]["id"] == key("city", "root", "上海市")
    district = by["district", "普陀区"]
    assert district["parent_id"] == by["city", "上海市"]["id"]
    own = by["department", "长风街道办事处"]  # promoted: its parent's name is unrelated
    assert own["parent_id"] == district["id"] and own["code"] is None and by["unit", "长风街道办事处"]["parent_id"] == own["id"]
    assert by["unit", "财政局本级"]["parent_id"] == by["department", "某某中心"]["id"]
    assert by["unit", "普陀区商务委员会"]["parent_id"] == by["department", "上海市普陀区商务委员会"]["id"]
    assert ("unit", "孤儿") not in by and len(got) == 9
    assert R.organization_store(departments.limit(0), df.limit(0)).count() == 0


def test_codes_are_taken_up(spark):
    auto = lambda name: "AUTO_DEPT_" + hashlib.sha1(name.encode()).hexdigest()[:16].upper()
    have = spark.createDataFrame([("D1", "old name"), (auto("b"), "b"), ("D3", "c"), ("D9", "stays")], "code string, name string")
    wanted = spark.createDataFrame([("a", "D1"), ("b", "D2"), ("c", "D4"), ("d", None), ("e", "D5"), ("c", None)], "name string, preferred string")
    table, of = R.ensured(have, wanted, "AUTO_DEPT")
    assert {(r["code"], r["name"]) for r in table.collect()} == {("D1", "a"), ("D2", "b"), ("D3", "c"), (auto("d"), "d"), ("D5", "e"), ("D9", "stays")}
    assert {(r["name"], r["preferred"]): r["code"] for r in of.collect()} == {("a", "D1"): "D1", ("b", "D2"): "D2", ("c", "D4"): "D3", ("c", None): "D3", ("d", None): auto("d"), ("e", "D5"): "D5"}
    # exact: a code of the name's own stands, and the preferred one is put in beside it
    table, _ = R.ensured(have, wanted.where(F.col("preferred") == "D4"), "AUTO_DEPT", exact=True)
    assert {r["code"] for r in table.where("name = 'c'").collect()} == {"D3", "D4"}
    again, _ = R.ensured(table, wanted.where(F.col("preferred") == "D4"), "AUTO_DEPT", exact=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))


def test_names_are_compared_for_organizations_not_documents(spark):
    orgs = spark.createDataFrame([("o1", "财政局", "department", None, "D1"), ("o2", "某中心", "unit", "o1", None), ("o3", "无文件局", "department", None, "D3")], "id string, name string, level string, parent_id string, code string")
    documents = spark.createDataFrame([(k, ["o1", "o2", "gone", None][k % 4], 2020, "决算", f"p{k}", "c") for k in range(40)], "doc_id long, organization_id string, fiscal_year long, doc_type string, path string, checksum string")
    lines = R.scopes(documents, orgs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the rows of documents come in above all comparing of names
    depth = lambda word: min((len(x) - len(x.lstrip(" :+-")) for x in lines if word in x), default=None)
    assert depth("doc_id") < depth("普陀区")
    assert not any("普陀区" in x and "doc_id" in x for x in lines)
    none = lambda kind: spark.createDataFrame([], kind)
    empty = R.Schema(none("code string, name string"), none("department_code string, code string, name string"), none("department_code string, unit_code string, year long, report_type string, path string, checksum string"), none("line int, department_code string, unit_code string, year long, report_type string"))
    got = R.synchronized(empty, documents, none("doc_id long, line int"), orgs)
    assert {r["code"] for r in got.departments.collect()} == {"D1"}  # organizations without documents ask for nothing
    assert {(r["department_code"], r["path"]) for r in got.reports.collect()} == {("D1", "p36"), ("D1", "p37")}
