"""The table of grants (T4): layout, both of its sides, and what they must add up to.

rows(doc_id, t, row_idx, cells).  T4 stands in two layouts: flat, one statement line per
row, or two-sided, income left and expenditure right, where lines on the left belong to the
year's income until a line on the opening balance and to that from there on.  The context is
carried forward in a window over a document's rows; everything else is one
conditional aggregation per document.  A cell that is no number counts as 0.
Findings: doc_id, rule, severity, lhs, rhs, message (the column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .narrative import cell_values, row_text

#: fixed values: columns of the table, from its right end
COLUMNS = ("total", "general", "fund", "state")
#: cells of a row from which on the table has two sides
TWO_SIDED = 7
LEAST_ROWS = 5


def _four(v: Column) -> Column:
    return F.slice(v, F.size(v) - 3, F.lit(4))


def _zeros() -> Column:
    return F.array(*[F.lit(0.0)] * 4)


def lines(rows: DataFrame) -> DataFrame:
    """T4's rows as lines of one stream: doc_id, row_idx, text, head, v, and context, `opening`
    from the first opening balance with a number on, else `income`."""
    order = Window.partitionBy("doc_id").orderBy("row_idx")
    head = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    t4 = rows.where(F.col("t") == "T4").select("doc_id", "row_idx", F.replace(row_text(F.col("cells")), F.lit(" "), F.lit("")).alias("text"), head.alias("head"), cell_values(F.col("cells")).alias("v"), F.coalesce(N.parse_number(F.get("cells", F.lit(1))), F.lit(0.0)).alias("left"), F.size("cells").alias("width"))
    t4 = t4.withColumn("width", F.first("width").over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    opens = (F.size("v") > 0) & F.col("head").contains("年初") & F.col("head").contains("结转")
    carried = F.max(opens).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return t4.withColumn("context", F.when(carried, "opening").otherwise("income")).withColumn("sided", F.col("width") >= TWO_SIDED)


def _last(value: Column, hit: Column, default: Column) -> Column:
    """value of the last row that hits."""
    return F.coalesce(F.max_by(value, F.when(hit, F.col("row_idx"))), default)


def _two_sided() -> dict[str, Column]:
    head, text, v, left = F.col("head"), F.col("text"), F.col("v"), F.col("left")
    zero = F.lit(0.0)
    opens = head.contains("年初") & head.contains("结转")
    income = ~opens & head.contains("本年收入合计")
    total = ~opens & ~income & head.contains("总计")
    kinds = (head.contains("一般公共预算"), head.contains("政府性基金") & ~head.contains("一般公共预算"), head.contains("国有资本") & ~head.contains("一般公共预算") & ~head.contains("政府性基金"))
    part = lambda context: [_last(left, k & (F.col("context") == context), zero) for k in kinds]
    spent = text.contains("本年支出合计")
    closing = ~spent & text.contains("年末") & text.contains("结转")
    out_total = ~spent & ~closing & text.contains("总计") & (F.size(v) >= 4)
    four = F.when(F.size(v) >= 4, _four(v)).otherwise(_zeros())
    return {
        "opening": F.array(_last(left, opens, zero), *part("opening")),
        "income": F.array(_last(left, income, zero), *part("income")),
        # the first total that is not 0
        "income_total": F.array(F.coalesce(F.min_by(left, F.when(total & (left != 0), F.col("row_idx"))), zero), zero, zero, zero),
        "expense": _last(four, spent, _zeros()),
        "closing": _last(four, closing, _zeros()),
        "expense_total": _last(_four(v), out_total, _zeros()),
    }


def _flat() -> dict[str, Column]:
    of = lambda w, more=F.lit(True): _last(F.col("four"), (F.col("kind") == w) & more, _zeros())
    return {"opening": of("年初"), "income": of("本年收入"), "income_total": of("总计", ~F.col("seen")), "expense": of("本年支出"), "closing": of("年末"), "expense_total": of("总计", F.col("seen"))}


def sides(rows: DataFrame) -> DataFrame:
    """doc_id and opening, income, income_total, expense, closing, expense_total: four amounts
    each (COLUMNS), of documents whose T4 has at least LEAST_ROWS rows.  A total column that
    is 0 is made up from its parts.  Both layouts are read in one pass and one aggregation."""
    text, v = F.col("text"), F.col("v")
    t4 = lines(rows).where((F.col("n") >= LEAST_ROWS) & (F.size("v") > 0))
    kind = F.lit(None).cast("string")
    for w in reversed(("年初", "本年收入", "本年支出", "年末", "总计")):
        kind = F.when(text.contains(w), F.lit(w)).otherwise(kind)
    four = F.when(F.size(v) >= 4, _four(v)).otherwise(F.array(F.get(v, F.lit(0)), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    t4 = t4.withColumn("kind", kind).withColumn("four", four)
    before = Window.partitionBy("doc_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    # totals belong to the income until one of them is not 0
    t4 = t4.withColumn("seen", F.coalesce(F.max((F.col("kind") == "总计") & (F.get("four", F.lit(0)) != 0)).over(before), F.lit(False)))
    two, flat = _two_sided(), _flat()
    both = t4.groupBy("doc_id").agg(F.bool_or("sided").alias("sided"), *[c.alias(f"two_{n}") for n, c in two.items()], *[c.alias(f"flat_{n}") for n, c in flat.items()])
    both = both.select("doc_id", *[F.when(F.col("sided"), F.col(f"two_{n}")).otherwise(F.col(f"flat_{n}")).alias(n) for n in two])
    for c in ("opening", "income", "expense", "closing"):
        parts = F.get(c, F.lit(1)) + F.get(c, F.lit(2)) + F.get(c, F.lit(3))
        filled = F.concat(F.array(parts), F.slice(F.col(c), 2, 3))
        both = both.withColumn(c, F.when((F.get(c, F.lit(0)) == 0) & (parts > 0), filled).otherwise(F.col(c)))
    return both


def _out(df: DataFrame, rule: str, severity: str, found: list[Column]) -> DataFrame:
    return df.select("doc_id", F.inline(F.array_compact(F.array(*found)))).select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "lhs", "rhs", "message")


def balance_findings(rows: DataFrame) -> DataFrame:
    """Totals of both sides that differ; and per column: income's total against opening balance and
    income, expenditure's against expenditure and closing balance, and the closing
    balance against what is left."""
    at = lambda c, i: F.get(c, F.lit(i))
    item = lambda bad, lhs, rhs, message: F.when(bad, F.struct(lhs.alias("lhs"), rhs.alias("rhs"), F.lit(message).alias("message")))
    tin, tout = at("income_total", 0), at("expense_total", 0)
    found = [item((F.abs(tin - tout) > 0.01) & (tin > 0), tin, tout, "balance total")]
    for i, name in enumerate(COLUMNS):
        opening, income, expense, closing = (at(c, i) for c in ("opening", "income", "expense", "closing"))
        tin, tout, left = at("income_total", i), at("expense_total", i), opening + income - expense
        found.append(item((F.abs(tin - (opening + income)) > 0.05) & (tin > 0), tin, opening + income, f"income {name}"))
        found.append(item((F.abs(tout - (expense + closing)) > 0.05) & (tout > 0), tout, expense + closing, f"expense {name}"))
        found.append(item((F.abs(closing - left) > 0.05) & ((closing > 0) | (F.abs(left) > 0.1)), closing, left, f"carry {name}"))
    return _out(sides(rows), "v33_242", "error", found)


def row_findings(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows of T4 whose total is not the sum of its three budgets: of four cells the first, of
    more the fourth from the right."""
    v = cell_values(F.col("cells"))
    some = rows.where((F.col("t") == "T4") & (F.size("cells") >= 4)).select("doc_id", "row_idx", v.alias("v"))
    some = some.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) >= 0.01).select("doc_id", "row_idx", _four(F.col("v")).alias("v"))
    total, parts = F.get("v", F.lit(0)), F.get("v", F.lit(1)) + F.get("v", F.lit(2)) + F.get("v", F.lit(3))
    bad = some.where(F.abs(total - parts) > tolerance)
    return bad.select("doc_id", F.lit("v33_119_row").alias("rule"), F.lit("warn").alias("severity"), total.alias("lhs"), parts.alias("rhs"), F.concat(F.lit("row "), (F.col("row_idx") + 1).cast("string")).alias("message"))


def column_findings(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Columns of T4 in which the year's income and the opening balance are not its expenditure and
    the closing balance.  The first row with all words counts, and the last four places
    that all four rows have."""
    text = row_text(F.col("cells"))
    t4 = rows.where(F.col("t") == "T4").select("doc_id", "row_idx", text.alias("text"), cell_values(F.col("cells")).alias("v"))
    wanted = {"inc": ("本年收入",), "open": ("年初", "结转"), "exp": ("本年支出",), "close": ("年末", "结转")}
    by = t4.groupBy("doc_id").agg(*[F.min_by("v", F.when(X.contains_all(F.col("text"), w), F.col("row_idx"))).alias(n) for n, w in wanted.items()])
    least = F.least(*[F.size(n) for n in wanted])
    by = by.where(least > 0).withColumn("from", F.greatest(least - 4, F.lit(0))).withColumn("least", least)
    each = by.select("doc_id", "from", *wanted, F.explode(F.sequence("from", F.col("least") - 1)).alias("k"))
    get = lambda n: F.get(n, F.col("k"))
    lhs, rhs = get("inc") + get("open"), get("exp") + get("close")
    bad = each.where(F.abs(lhs - rhs) > tolerance)
    name = F.get(F.array(*[F.lit(c) for c in COLUMNS]), F.col("k") - F.col("from"))
    return bad.select("doc_id", F.lit("v33_119_column").alias("rule"), F.lit("error").alias("severity"), lhs.alias("lhs"), rhs.alias("rhs"), name.alias("message"))


def empty_findings(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """T8 or T9 with amounts where T4 has none of funds or state capital (its last two
    places, rows of at least four cells; a document without T4 has none)."""
    v = cell_values(F.col("cells"))
    sum_ = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    t, wide = F.col("t"), (F.col("t") == "T4") & (F.size("v") >= 4)
    zero = F.lit(0.0)
    by = rows.where(t.isin("T4", "T8", "T9")).select("doc_id", "t", v.alias("v")).groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(wide, F.get("v", F.size("v") - 2))), zero).alias("fund"), F.coalesce(F.sum(F.when(wide, F.get("v", F.size("v") - 1))), zero).alias("state"),
        F.coalesce(F.sum(F.when(t == "T8", sum_("v"))), zero).alias("t8"), F.coalesce(F.sum(F.when(t == "T9", sum_("v"))), zero).alias("t9"),
    )
    found = [F.when((F.col(own) < least) & (F.col(table) > least), F.struct(F.col(table).alias("lhs"), F.col(own).alias("rhs"), F.lit(table.upper()).alias("message"))) for own, table in (("fund", "t8"), ("state", "t9"))]
    return _out(by, "v33_122", "error", found)


def general_findings(rows: DataFrame) -> DataFrame:
    """T4's expenditure of the general budget (second cell of the first row with 支出合计) against the
    largest amount of T5's first row that begins with 合计; both have to be above 0.01."""
    text, v, t = row_text(F.col("cells")), cell_values(F.col("cells")), F.col("t")
    some = rows.where(t.isin("T4", "T5")).select("doc_id", "t", "row_idx", text.alias("text"), v.alias("v"))
    by = some.groupBy("doc_id").agg(
        F.min_by(F.get("v", F.lit(1)), F.when((t == "T4") & F.col("text").contains("支出合计"), F.col("row_idx"))).alias("t4"),
        F.min_by(F.array_max("v"), F.when((t == "T5") & (F.startswith("text", F.lit("合计")) | (F.trim("text") == "合计")), F.col("row_idx"))).alias("t5"),
    )
    bad = by.where((F.col("t4") > 0.01) & (F.col("t5") > 0.01) & (F.abs(F.col("t4") - F.col("t5")) > 0.01))
    return bad.select("doc_id", F.lit("v33_202").alias("rule"), F.lit("error").alias("severity"), F.col("t4").alias("lhs"), F.col("t5").alias("rhs"), F.lit("").alias("message"))
