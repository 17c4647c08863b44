"""From recognized cells to facts: unpivot, classification, hierarchy, lineage, wide items.

cells(version, table_code, id, row_idx, col_idx, raw_text, numeric_value, page_number,
confidence, unit_hint); mappings(version, table_code, source_col_idx,
source_col_name, canonical_measure, confidence); instances(version, table_code,
confidence, classification_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

KEYS = ["version", "table_code"]


def hierarchy(code: Column) -> tuple[Column, Column, Column]:
    """(level, parent, path) of a classification code: three digits a class, five
    a type, seven an item, two more for each level below."""
    n = F.length(code)
    digits = code.rlike("^[0-9]+$")
    level = F.when(code == "total", 0).when(~digits, None).when(n >= 7, 3 + F.floor((n - 7) / 2).cast("int")).when(n == 5, 2).otherwise(1)
    parent = F.when(digits & (n >= 7), F.substring(code, F.lit(1), n - 2)).when(digits & (n == 5), F.substring(code, 1, 3))
    prefix = lambda k: F.when(n >= k, F.substring(code, 1, k))
    path = F.when(digits, F.array_compact(F.array(prefix(3), prefix(5), prefix(7), F.when(n > 7, code)))).otherwise(F.array().cast("array<string>"))
    return level, parent, path


def split_code(code: Column) -> tuple[Column, Column, Column]:
    """Class, type and item prefix of a digit code."""
    ok = code.rlike("^[0-9]+$")
    return tuple(F.when(ok & (F.length(code) >= k), F.substring(code, 1, k)) for k in (3, 5, 7))


def grid_rows(cells: DataFrame) -> DataFrame:
    """rows(version, table_code, row_idx, cells): each row's cells in the order of columns."""
    names = [c for c in ("col_idx", "id", "raw_text", "numeric_value", "page_number", "confidence", "unit_hint") if c in cells.columns]
    return cells.groupBy(*KEYS, "row_idx").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("cells"))


def materialize(cells: DataFrame, mappings: DataFrame, instances: DataFrame) -> DataFrame:
    """One fact per data row and mapped column with a number."""
    return unpivoted(row_facts(grid_rows(cells), mappings, instances))


def row_facts(rows: DataFrame, mappings: DataFrame, instances: DataFrame) -> DataFrame:
    """Data rows with their facts in an array: rows as `grid_rows` gives them.

    Rows start at the first with a number in a mapped column.  Label cells are
    those left of the first mapped column: a total row has code `total`, digit
    labels join to the code, others to the name.  Confidence is the least of
    table, mapping and cell; source_cell_ids are the label cells and the measure's.
    One shuffle by (version, table): all that follows keeps that partitioning.
    """
    maps = mappings.groupBy(*KEYS).agg(F.min("source_col_idx").alias("first_col"), F.map_from_entries(F.collect_list(F.struct("source_col_idx", F.struct("canonical_measure", "source_col_name", "confidence")))).alias("columns"))
    rows = rows.join(maps, KEYS).join(instances.select(*KEYS, F.col("confidence").alias("table_confidence"), "classification_type"), KEYS)
    label = lambda c: F.struct(c["col_idx"].alias("col_idx"), N.stripped(F.coalesce(c["raw_text"], F.lit(""))).alias("text"), c["id"].alias("id"))
    measure = lambda c: F.struct(c["col_idx"].alias("col_idx"), F.coalesce(c["numeric_value"], N.parse_amount(c["raw_text"])).alias("amount"), c["id"].alias("id"), c["confidence"].alias("confidence"), F.element_at("columns", c["col_idx"]).alias("m"))
    first = lambda name, hit: F.get(F.filter("cells", hit), F.lit(0))[name]
    by_row = rows.select(
        *KEYS, "row_idx", "table_confidence", "classification_type",
        F.array_sort(F.filter(F.transform(F.filter("cells", lambda c: c["col_idx"] < F.col("first_col")), label), lambda x: x["text"] != "")).alias("labels"),
        F.filter(F.transform(F.filter("cells", lambda c: F.map_contains_key("columns", c["col_idx"])), measure), lambda x: x["amount"].isNotNull()).alias("measures"),
        first("page_number", lambda c: c["page_number"].isNotNull()).alias("source_page_number"),
        first("unit_hint", lambda c: F.coalesce(c["unit_hint"], F.lit("")) != "").alias("unit_hint"),
    )
    start = F.min(F.when(F.size("measures") > 0, F.col("row_idx"))).over(Window.partitionBy(*KEYS))
    by_row = by_row.withColumn("start", start).where((F.col("row_idx") >= F.col("start")) & (F.size("measures") > 0) & (F.size("labels") > 0))
    by_row = by_row.withColumn("texts", F.transform("labels", lambda x: x["text"]))
    by_row = by_row.withColumns({
        "total": F.get(F.filter("texts", lambda t: t.contains("合计") | t.contains("总计")), F.lit(0)),
        "digits": F.array_join(F.filter("texts", lambda t: t.rlike("^[0-9]+$")), ""),
        "words": F.array_join(F.filter("texts", lambda t: ~t.rlike("^[0-9]+$")), " "),
    })
    total, digits = F.col("total"), F.nullif(F.col("digits"), F.lit(""))
    code = F.when(total.isNotNull(), "total").otherwise(digits)
    name = F.when(total.isNotNull(), total).when(digits.isNotNull(), F.coalesce(F.nullif("words", F.lit("")), digits)).otherwise(F.array_join("texts", " "))
    by_row = by_row.withColumn("classification_code", code).withColumn("classification_name", name)
    level, parent, path = hierarchy(F.col("classification_code"))
    # a confidence of 0 counts as unknown, like NULL
    known = lambda c: F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.col("table_confidence"))
    fact = lambda x: F.struct(
        x["m"]["canonical_measure"].alias("measure"), x["amount"].alias("amount"), x["m"]["source_col_name"].alias("source_header"),
        F.concat(F.array_compact(F.transform("labels", lambda l: l["id"])), F.array_compact(F.array(x["id"]))).alias("source_cell_ids"),
        F.least("table_confidence", known(x["m"]["confidence"]), known(x["confidence"])).alias("parse_confidence"),
    )
    return by_row.select(
        *KEYS, "classification_type", "classification_code", "classification_name", F.col("row_idx").alias("row_order"), level.alias("classification_level"),
        parent.alias("parent_classification_code"), path.alias("hierarchy_path"), "source_page_number", "unit_hint", F.transform("measures", fact).alias("facts"),
    )


def unpivoted(rows: DataFrame) -> DataFrame:
    """One row for each fact of `row_facts`."""
    return rows.withColumn("x", F.explode("facts")).select(
        *KEYS, "classification_type", "classification_code", "classification_name", "x.measure", "x.amount", "row_order", "classification_level", "parent_classification_code",
        "hierarchy_path", "source_page_number", "x.source_cell_ids", "x.parse_confidence", F.struct("x.source_header", "unit_hint").alias("extra_dims"),
    )


def low_confidence(facts: DataFrame, limit: float = 0.8) -> DataFrame:
    """Tables with a fact below the limit."""
    return facts.where(F.col("parse_confidence") < limit).select(*KEYS).distinct()


def _item(measure: Column, ids: Column, amount: Column, page: Column, confidence: Column) -> Column:
    return F.struct(measure.alias("measure"), F.coalesce(F.array_max(ids), F.lit(0)).alias("cell"), amount.alias("amount"), page.alias("page"), confidence.alias("confidence"))


def wide_items(facts: DataFrame) -> DataFrame:
    """One row per statement line: measures in a map (the last of a repeated one),
    code prefixes, pages and the least confidence."""
    item = _item(*(F.col(c) for c in ("measure", "source_cell_ids", "amount", "source_page_number", "parse_confidence")))
    return _wide(facts.groupBy(*KEYS, "row_order", "classification_code", "classification_name").agg(F.array_sort(F.collect_list(item)).alias("items")))


def wide_rows(rows: DataFrame) -> DataFrame:
    """The same of `row_facts`, whose rows need no grouping."""
    item = lambda x: _item(x["measure"], x["source_cell_ids"], x["amount"], F.col("source_page_number"), x["parse_confidence"])
    return _wide(rows.select(*KEYS, "row_order", "classification_code", "classification_name", F.array_sort(F.transform("facts", item)).alias("items")))


def _wide(rows: DataFrame) -> DataFrame:
    last = F.filter("items", lambda x, i: ~F.get("items", i + 1)["measure"].eqNullSafe(x["measure"]))
    rows = rows.select(
        *KEYS, "row_order", "classification_code", "classification_name", F.map_from_entries(F.transform(last, lambda x: F.struct(x["measure"], x["amount"]))).alias("values"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("items", lambda x: x["page"])))).alias("page_numbers"), F.array_min(F.transform("items", lambda x: x["confidence"])).alias("min_confidence"),
    )
    klass, kind, item = split_code(F.col("classification_code"))
    return rows.withColumns({"class_code": klass, "type_code": kind, "item_code": item})


def nested_tables(cells: DataFrame) -> DataFrame:
    """Each table as one row: rows of ordered cells, its pages, row and column counts."""
    return nested_rows(grid_rows(cells))


def nested_rows(rows: DataFrame) -> DataFrame:
    """The same of rows as `grid_rows` gives them."""
    cells = F.array_sort(F.transform("cells", lambda c: F.struct(c["col_idx"].alias("col_idx"), c["raw_text"].alias("raw_text"), c["numeric_value"].alias("numeric_value"))))
    each = rows.select(*KEYS, "row_idx", cells.alias("cells"), F.array_distinct(F.array_compact(F.transform("cells", lambda c: c["page_number"]))).alias("pages"), F.array_max(F.transform("cells", lambda c: c["col_idx"])).alias("last_col"))
    return each.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("page_numbers"), F.count(F.lit(1)).alias("row_count"), (F.max("last_col") + 1).alias("col_count"))


def drilldown(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """(fact columns, cell) by the lineage of each fact: an equi join on cell ids."""
    ids = facts.select("*", F.explode("source_cell_ids").alias("__cell"))
    return ids.join(cells.select("version", F.col("id").alias("__cell"), "row_idx", "col_idx", "raw_text"), ["version", "__cell"]).withColumnRenamed("__cell", "cell_id")


def review_items(versions: DataFrame, core: tuple[str, ...], skip_profiles: tuple[str, ...] = ("execution_budget_packet", "narrative_report")) -> DataFrame:
    """versions(version, recognized array, unknown array, low array, facts_count,
    profile) -> version, id, type, severity, table_code, in order of severity."""
    need = F.array(*[F.lit(c) for c in core])
    none = F.array().cast("array<string>")
    missing = F.array_except(need, F.coalesce("recognized", none))
    covered = F.size(F.array_intersect(need, F.coalesce("recognized", none)))
    skip = F.coalesce(F.col("profile").isin(*skip_profiles), F.lit(False))

    def items(codes: Column, kind: str, suffix: str, on: Column) -> Column:
        made = F.transform(codes, lambda c: F.struct(F.concat(c, F.lit(f":{suffix}")).alias("id"), F.lit(kind).alias("type"), F.lit("warn").alias("severity"), c.alias("table_code")))
        return F.when(on, made).otherwise(F.array().cast("array<struct<id:string,type:string,severity:string,table_code:string>>"))

    empty = F.when((F.size(F.coalesce("recognized", none)) > 0) & (F.coalesce("facts_count", F.lit(0)) == 0), F.array(F.struct(F.lit("facts:none").alias("id"), F.lit("fact_materialization_empty").alias("type"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("table_code")))).otherwise(F.array().cast("array<struct<id:string,type:string,severity:string,table_code:string>>"))
    every = F.concat(
        items(F.coalesce("unknown", none), "unknown_table", "unknown", (F.size(missing) > 0) & ~skip & (covered < len(core) - 1)),
        items(F.coalesce("low", none), "low_confidence_table", "low_confidence", F.lit(True)),
        items(missing, "missing_core_table", "missing", ~skip),
        empty,
    )
    out = versions.select("version", F.explode(every).alias("i")).select("version", "i.*")
    return out.withColumn("rank", F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2))


def document_profile(name: Column) -> Column:
    """Three kinds of document by words in the file name."""
    return F.when(X.contains_any(name, ("执行情况", "预算草案")), "execution_budget_packet").when(X.contains_any(name, ("绩效", "说明")), "narrative_report").otherwise("statement_set")


def report_kind(meta: Column, path: Column, first_page: Column) -> Column:
    """budget or final, from metadata, then the path, then the first page."""
    of = lambda c: F.when(c.contains("决算") | F.lower(c).contains("final"), "final").when(c.contains("预算") | F.lower(c).contains("budget"), "budget")
    return F.coalesce(F.when(F.lower(meta).isin("budget", "final"), F.lower(meta)), of(path), of(first_page), F.lit("final"))
