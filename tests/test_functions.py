"""Column functions on literal values."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.functions import severity as S
from ledgerlens.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.orderBy("k").select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_parse_number(spark):
    assert column(spark, ["1,234.50", "-12", "12 %", "—", "", "1,23", "abc", None, " 7 ", "(5)"], N.parse_number) == [1234.5, -12.0, 12.0, None, None, None, None, None, 7.0, None]


def test_parse_amount(spark):
    assert column(spark, ["1，234.5万元", "（12.5）", "—", "－3", "12%", "x1", "0"], N.parse_amount) == [1234.5, -12.5, None, -3.0, 12.0, None, 0.0]


def test_tolerances(spark):
    df = spark.createDataFrame([(100.0, 100.005), (1000.0, 1000.9), (1000.0, 1001.5), (None, 1.0)], "a double, b double")
    got = df.select(N.close(F.col("a"), F.col("b"), 0.01).alias("x"), N.close(F.col("a"), F.col("b"), 1.0, 0.001).alias("y"), N.close(F.col("a"), F.col("b"), 2.0, nulls="zero").alias("z")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, True), (False, False, True), (False, False, True)]


def test_units(spark):
    df = spark.createDataFrame([(5.0, "元"), (5.0, "亿元"), (5.0, "?"), (5.0, None)], "v double, u string")
    assert [r[0] for r in df.select(N.to_ten_thousands(F.col("v"), F.col("u"))).collect()] == [0.0005, 50000.0, 5.0, 5.0]


def test_years_units_and_names(spark):
    assert column(spark, ["2024年度部门决算 2013901 x2023", None], X.years) == [[2024, 2023], []]
    assert column(spark, ["单位：万元", "none"], X.money_unit) == ["万元", None]
    assert column(spark, ["ＡＢ （１）　c：", None], X.normalized) == ["ab(1)c:", ""]
    assert column(spark, [1, 10, 21, 99, 100], X.ordinal, "int") == ["一", "十", "二十一", "九十九", "100"]
    assert column(spark, ["上海 2024年度部门决算（公开）"], X.match_name) == ["上海"]


def test_windows_reach_the_end(spark):
    text = "x" * 25000
    got = column(spark, [text, "", "ab"], lambda c: F.transform(X.windows(c), lambda w: F.struct(w["start"], F.length(w["text"]))))
    assert [tuple(w) for w in got[0]] == [(0, 12000), (10800, 12000), (21600, 3400)]
    assert [tuple(w) for w in got[1]] == [(0, 0)] and [tuple(w) for w in got[2]] == [(0, 2)]


def test_pairs_and_maps(spark):
    got = column(spark, ["预算 12.5 万元，决算 10 万元；预算 3 决算 4"], lambda c: X.pairs(c, "预算", "决算"))
    assert [tuple(p) for p in got[0]] == [(12.5, 10.0), (3.0, 4.0)]
    assert column(spark, ["a=1; b = 2;c"], X.key_values) == [{"a": "1", "b": "2"}]


def test_severity(spark):
    assert column(spark, ["P0", "error", "Warn", "hint", "?"], S.normalized) == ["critical", "high", "medium", "info", "info"]
    assert column(spark, [95.0, 0.6, 0.1], S.confidence, "double") == ["HIGH", "MEDIUM", "LOW"]


@pytest.fixture(scope="module")
def number_cases():
    return []


@settings(max_examples=60, deadline=None)
@given(st.floats(-1e9, 1e9, allow_nan=False))
def test_written_numbers_are_read(number_cases, x):
    number_cases.append(round(x, 2))


def test_numbers_round_trip(spark, number_cases):
    values = [f"{x:,.2f}" for x in number_cases]
    assert column(spark, values, N.parse_number) == pytest.approx(number_cases)


def test_headers_of_a_measure():
    from ledgerlens.functions import dictionaries as D

    assert D.measures("FIN_02_income")[:3] == [("total_actual", "合计"), ("total_actual", "收入合计"), ("total_actual", "决算数")]
    assert all(set(D.MORE_HEADERS.get(c, {})) <= {m for m, _ in ms} for c, _, _, ms in D.FACT_TABLES)
    assert len({a for names in D.FACT_ALIASES.values() for a in names}) == sum(map(len, D.FACT_ALIASES.values()))
