"""Document rules: structure, identities, hierarchies, cross-table and narrative checks.

rows(doc_id, t, row_idx, cells array<string>) are the grids of each document's
canonical tables (T1..T9, B1..B9), pages(doc_id, page, text) its text.  All scalar
operands of a document come from one conditional aggregation over its rows; a rule
is an entry in a table of expressions over them, so that adding a rule adds no
shuffle.  Findings: doc_id, rule, severity, lhs, rhs, message.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import numbers as N
from ..functions import text as X
from . import grant_table as G
from . import headers as H
from . import narrative as V
from . import sections as S
from . import text_rules as T

# ------------------------------------------------------------------- structure


def anchors(pages: DataFrame, tables: dict[str, tuple[str, ...]], skip: str = "目录|名词解释") -> DataFrame:
    """(doc_id, t, page): pages that print a table's name.  A name that another,
    longer one contains does not count where only the longer one stands."""
    names = {t: [n.replace("“", "").replace("”", "") for n in ns] for t, ns in tables.items()}
    every = [n for ns in names.values() for n in ns]
    # a page without a character that every name has is not looked at further
    common = sorted(set.intersection(*map(set, every)) - set(" .")) if every else []
    some = pages.where(F.col("text").contains(common[-1])) if common else pages
    plain = some.where(~F.col("text").rlike(skip)).select("doc_id", "page", X.without_punctuation(F.col("text")).alias("t"))
    found = []
    for t, ns in names.items():
        hit = F.lit(False)
        for n in ns:
            rest = F.col("t")
            for longer in sorted((m for m in every if n in m and m != n and m not in ns), key=len, reverse=True):
                rest = F.replace(rest, F.lit(longer), F.lit(""))
            hit = hit | rest.contains(n)
        found.append(F.when(hit, F.lit(t)))
    return plain.select("doc_id", "page", F.explode(F.array_compact(F.array(*found))).alias("t")).distinct()


def first_anchor(found: DataFrame, has_table: DataFrame) -> DataFrame:
    """(doc_id, t, page): the first anchor page with a grid, else the first at all."""
    rows = found.join(has_table.select("doc_id", "page", F.lit(True).alias("grid")), ["doc_id", "page"], "left")
    return rows.groupBy("doc_id", "t").agg(F.coalesce(F.min(F.when(F.col("grid"), F.col("page"))), F.min("page")).alias("page"))


def missing_tables(docs: DataFrame, found: DataFrame, tables: dict) -> DataFrame:
    have = found.groupBy("doc_id").agg(F.collect_set("t").alias("have"))
    need = F.array(*[F.lit(t) for t in tables])
    gone = F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))
    return docs.select("doc_id").join(have, "doc_id", "left").select("doc_id", F.explode(gone).alias("t")).select("doc_id", F.lit("missing_table").alias("rule"), F.lit("warn").alias("severity"), F.concat(F.col("t"), F.lit(" is missing")).alias("message"))


def order_inversions(first: DataFrame, tables: dict) -> DataFrame:
    """Tables that come before one that should precede them, if three or more were found."""
    place = F.array_position(F.array(*[F.lit(t) for t in tables]), F.col("t"))
    w = Window.partitionBy("doc_id")
    rows = first.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("before", F.lag("place").over(w.orderBy("page", "place")))
    bad = rows.where((F.col("n") >= 3) & (F.col("before") > F.col("place")))
    return bad.select("doc_id", F.lit("table_order").alias("rule"), F.lit("info").alias("severity"), F.concat(F.col("t"), F.lit(" is out of order")).alias("message"))


def size_findings(docs: DataFrame) -> DataFrame:
    """docs(doc_id, pages, filesize): too few or many pages, too large a file."""
    odd = F.array_compact(F.array(F.when(F.col("pages") < 8, F.lit("fewer than 8 pages")), F.when(F.col("pages") > 300, F.lit("more than 300 pages")), F.when(F.col("filesize") > 50 * 1024 * 1024, F.lit("larger than 50 MB"))))
    return docs.select("doc_id", F.lit("size").alias("rule"), F.lit("info").alias("severity"), F.explode(odd).alias("message"))


def toc_findings(pages: DataFrame, found: DataFrame, least: int = 8) -> DataFrame:
    """A table of contents that lists another number of tables than there are."""
    toc = pages.where(F.col("text").contains("目录")).groupBy("doc_id").agg(F.max(F.regexp_count("text", F.lit("[^\\n]*表[.．…·\\s]*\\d+\\s*(?:\\n|$)"))).alias("listed"))
    have = found.groupBy("doc_id").agg(F.countDistinct("t").alias("present"))
    rows = toc.join(have, "doc_id", "left").where((F.col("listed") >= least) & (F.col("listed") != F.coalesce("present", F.lit(0))))
    return rows.select("doc_id", F.lit("toc").alias("rule"), F.lit("warn").alias("severity"), F.concat_ws(" ", F.lit("listed"), F.col("listed").cast("string"), F.lit("present"), F.coalesce("present", F.lit(0)).cast("string")).alias("message"))


def empty_tables(rows: DataFrame, pages: DataFrame, which: dict[str, str]) -> DataFrame:
    """Tables without a number need a note (a pattern) on some page of the document."""
    number = F.exists("cells", lambda c: N.parse_number(c).isNotNull() & (N.parse_number(c) != 0) & ~c.rlike(r"^20\d{2}$"))
    blank = rows.where(F.col("t").isin(*which)).groupBy("doc_id", "t").agg(F.bool_or(number).alias("full")).where(~F.col("full"))
    noted = None
    for t, pattern in which.items():
        one = pages.where(F.col("text").rlike(pattern)).select("doc_id", F.lit(t).alias("t")).distinct()
        noted = one if noted is None else noted.unionByName(one)
    return blank.join(noted, ["doc_id", "t"], "left_anti").select("doc_id", F.lit("empty_table").alias("rule"), F.lit("warn").alias("severity"), F.concat(F.col("t"), F.lit(" is empty without a note")).alias("message"))


def continued(rows: DataFrame, total: str = "合计|总计", tail: int = 5) -> DataFrame:
    """rows(doc_id, page, table_idx, n_cells, row_idx, cells): the largest grid of
    each page, and after one whose last rows have no total, the next page's."""
    size = F.max("n_cells").over(Window.partitionBy("doc_id", "page"))
    best = rows.withColumn("top", F.min(F.when(F.col("n_cells") == size, F.col("table_idx"))).over(Window.partitionBy("doc_id", "page"))).where("table_idx = top")
    w = Window.partitionBy("doc_id", "page")
    last = F.max("row_idx").over(w)
    ends = F.bool_or((F.col("row_idx") > last - tail) & F.array_join("cells", "").rlike(total)).over(w)
    best = best.withColumn("ends", F.coalesce(ends, F.lit(False))).withColumn("rows", last + 1)
    heads = best.select("doc_id", "page", "ends", "rows").distinct()
    nxt = heads.where("NOT ends").select("doc_id", F.col("page").alias("first"), (F.col("page") + 1).alias("page"), F.col("rows").alias("shift"))
    more = best.join(nxt, ["doc_id", "page"]).select("doc_id", F.col("first").alias("page"), (F.col("row_idx") + F.col("shift")).alias("row_idx"), "cells")
    return best.select("doc_id", "page", "row_idx", "cells").unionByName(more)


# -------------------------------------------------------------------- operands


@dataclass(frozen=True)
class Operand:
    """A value of the first (or last) row of a table whose text has all words:
    number at `pick` ("first", "last", "max" or a place from 0 among the numbers).
    With "code" the word is a code: the sum of the first positive numbers to the right
    of the cells that hold just this code, wherever these stand in their rows."""

    name: str
    table: str
    words: tuple[str, ...]
    pick: str | int = "last"
    row: str = "first"


def _numbers(cells: Column) -> Column:
    """Amounts of a row: no percentages, no classification codes in the first column."""
    values = F.transform(cells, lambda c, i: F.when((i == 0) | c.contains("%"), None).otherwise(N.parse_number(c)))
    return F.array_compact(values)


def _amounts(rows: DataFrame) -> Column:
    """The same, read before where the rows hold them."""
    return F.col("numbers") if "numbers" in rows.columns else _numbers(F.col("cells"))


def _squeezed(rows: DataFrame) -> Column:
    """A row's text without white space, likewise."""
    return F.col("squeezed") if "squeezed" in rows.columns else X.compact(V.line(rows))


def operands(rows: DataFrame, wanted: list[Operand]) -> DataFrame:
    """One row per document with every operand (NULL where its row is missing).  Only rows that can
    hold one, which most do not, are aggregated."""
    tables = sorted({o.table for o in wanted})
    some = rows.where(F.col("t").isin(*tables))

    def may_hold(t: str) -> Column:
        own = [o for o in wanted if o.table == t]
        word = X.contains_any(F.col("text"), tuple(dict.fromkeys(min(o.words, key=len) for o in own if o.pick != "code")))
        code = F.exists("cells", lambda c: F.trim(c).isin(*[o.words[0] for o in own if o.pick == "code"])) if any(o.pick == "code" for o in own) else F.lit(False)
        return F.when(F.col("t") == t, F.coalesce(word | code, F.lit(False)))

    slim = some.select("doc_id", "t", "row_idx", "cells", _squeezed(rows).alias("text"), _amounts(rows).alias("v")).where(F.coalesce(*[may_hold(t) for t in tables], F.lit(False)))
    slim = slim.select("doc_id", "t", "row_idx", "text", "v", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells"))

    def value(o: Operand) -> Column:
        v = F.col("v")
        if o.pick == "code":
            at = F.array_position("cells", F.lit(o.words[0])).cast("int")
            right = F.transform(F.slice("cells", at + 1, F.size("cells")), N.parse_number)
            amount = F.get(F.filter(right, lambda x: x.isNotNull()), F.lit(0))
            return F.sum(F.when((F.col("t") == o.table) & (at > 0) & (amount > 0), amount)).alias(o.name)
        got = {"first": F.get(v, F.lit(0)), "last": F.get(v, F.size(v) - 1), "max": F.array_max(v)}[o.pick] if isinstance(o.pick, str) else F.get(v, F.lit(o.pick))
        hit = (F.col("t") == o.table) & X.contains_all(F.col("text"), o.words) & (F.size("v") > 0)
        choose = F.min_by if o.row == "first" else F.max_by
        return choose(F.when(hit, got), F.when(hit, F.col("row_idx"))).alias(o.name)

    held = slim.groupBy("doc_id").agg(*[value(o) for o in wanted])
    documents = some.select("doc_id").distinct()
    # a document without an id is one too
    return documents.join(held.withColumnRenamed("doc_id", "__of"), F.col("doc_id").eqNullSafe(F.col("__of")), "left").drop("__of")


#: fixed values: words by which rows are found
OPERANDS = [
    Operand("t1_income_total", "T1", ("总计",), "first"),
    Operand("t1_expense_total", "T1", ("总计",), "last"),
    Operand("t1_year_income", "T1", ("本年收入合计",), "first"),
    Operand("t1_year_expense", "T1", ("本年支出合计",), "last"),
    Operand("t1_non_fiscal", "T1", ("使用非财政拨款结余",), "first"),
    Operand("t1_opening", "T1", ("年初结转和结余",), "first"),
    Operand("t1_allocation", "T1", ("结余分配",), "last"),
    Operand("t1_closing", "T1", ("年末结转和结余",), "last"),
    Operand("t2_total", "T2", ("合计",), "first"),
    Operand("t2_grant", "T2", ("合计",), 1),
    Operand("t3_total", "T3", ("合计",), 0),
    Operand("t3_basic", "T3", ("合计",), 1),
    Operand("t3_project", "T3", ("合计",), 2),
    Operand("t4_year_income", "T4", ("本年收入合计",), "first"),
    Operand("t4_total", "T4", ("总计",), "first"),
    Operand("t4_expense", "T4", ("本年支出合计",), 1),
    Operand("t4_general", "T4", ("本年支出合计",), 2),
    Operand("t4_fund", "T4", ("本年支出合计",), 3),
    Operand("t4_state", "T4", ("本年支出合计",), 4),
    Operand("t5_total", "T5", ("合计",), 0),
    Operand("t5_basic", "T5", ("合计",), 1),
    Operand("t5_project", "T5", ("合计",), 2),
    Operand("t6_total", "T6", ("合计",), "first", "last"),
    Operand("t6_personnel", "T6", ("人员经费合计",), "first"),
    Operand("t6_public", "T6", ("公用经费合计",), "first"),
    Operand("t6_basic", "T6", ("基本支出合计",), "first"),
    Operand("t6_301", "T6", ("301",), "code"),
    Operand("t6_302", "T6", ("302",), "code"),
    Operand("t6_303", "T6", ("303",), "code"),
    Operand("t6_310", "T6", ("310",), "code"),
    Operand("t7_total", "T7", ("合计",), "last"),
    Operand("t7_budget", "T7", ("合计",), "first"),
    Operand("t7_overseas", "T7", ("因公出国",), "last"),
    Operand("t7_vehicle", "T7", ("公务用车购置及运行",), "last"),
    Operand("t7_vehicle_buy", "T7", ("公务用车购置费",), "last"),
    Operand("t7_vehicle_run", "T7", ("公务用车运行",), "last"),
    Operand("t7_reception", "T7", ("公务接待",), "last"),
    Operand("t8_total", "T8", ("合计",), "max"),
    Operand("t9_total", "T9", ("合计",), "max"),
    Operand("b1_income", "B1", ("总计",), "first"),
    Operand("b1_expense", "B1", ("总计",), "last"),
    Operand("b3_total", "B3", ("合计",), 0),
    Operand("b3_basic", "B3", ("合计",), 1),
    Operand("b3_project", "B3", ("合计",), 2),
    Operand("b4_income", "B4", ("总计",), "first"),
    Operand("b4_expense", "B4", ("总计",), "last"),
    Operand("b5_total", "B5", ("合计",), 0),
    Operand("b5_basic", "B5", ("合计",), 1),
    Operand("b5_project", "B5", ("合计",), 2),
    Operand("b8_total", "B8", ("合计",), 0),
    Operand("b8_personnel", "B8", ("合计",), 1),
    Operand("b8_public", "B8", ("合计",), 2),
    Operand("b9_total", "B9", ("合计",), "first"),
    Operand("b9_overseas", "B9", ("因公出国",), "first"),
    Operand("b9_vehicle", "B9", ("公务用车购置及运行",), "first"),
    Operand("b9_vehicle_buy", "B9", ("公务用车购置费",), "first"),
    Operand("b9_vehicle_run", "B9", ("公务用车运行",), "first"),
    Operand("b9_reception", "B9", ("公务接待",), "first"),
]

# ----------------------------------------------------------------------- rules


@dataclass(frozen=True)
class Identity:
    """lhs and rhs are SQL expressions over operands; a part in `optional` that is
    missing counts as 0, any other missing part means that nothing is said."""

    rule: str
    lhs: str
    rhs: str
    absolute: float
    relative: float = 0.0
    severity: str = "error"
    kind: str = "final"
    when: str = "true"
    optional: tuple[str, ...] = field(default_factory=tuple)


#: fixed values: identities within and between tables, with their tolerances
IDENTITIES = [
    Identity("v33_101", "t1_expense_total", "t1_year_expense + t1_allocation + t1_closing", 1.0, 0.001),
    Identity("v33_115_balance", "t1_income_total", "t1_expense_total", 0.01),
    Identity("v33_115_income", "t1_income_total", "t1_year_income + t1_non_fiscal + t1_opening", 0.01, optional=("t1_non_fiscal", "t1_opening")),
    Identity("v33_115_expense", "t1_expense_total", "t1_year_expense + t1_allocation + t1_closing", 0.01, optional=("t1_allocation", "t1_closing")),
    Identity("v33_117_personnel", "t6_personnel", "0.0 + t6_301 + t6_303", 1.0, severity="warn", when="t6_personnel > 0", optional=("t6_301", "t6_303")),
    Identity("v33_117_public", "t6_public", "0.0 + t6_302 + t6_310", 1.0, severity="warn", when="t6_public > 0", optional=("t6_302", "t6_310")),
    Identity("v33_119", "t4_expense", "t4_general + t4_fund + t4_state", 0.05, optional=("t4_fund", "t4_state")),
    Identity("v33_121", "t7_total", "t7_overseas + t7_vehicle + t7_reception", 0.01, optional=("t7_overseas", "t7_vehicle", "t7_reception")),
    Identity("v33_122_fund", "t8_total", "0.0", 0.1, when="abs(t4_fund) <= 0.1"),
    Identity("v33_122_state", "t9_total", "0.0", 0.1, when="abs(t4_state) <= 0.1"),
    Identity("v33_200", "t1_year_income", "t2_total", 0.01, when="t1_year_income > 0.01 AND t2_total > 0.01"),
    Identity("v33_201", "t1_year_expense", "t3_total", 0.01, when="t1_year_expense > 0.01 AND t3_total > 0.01"),
    Identity("v33_202", "t4_general", "t5_total", 0.01),
    Identity("v33_203", "t5_basic", "t6_301 + t6_302 + t6_303 + t6_310", 0.05, optional=("t6_303", "t6_310")),
    Identity("v33_204", "t2_grant", "t4_year_income", 0.05),
    Identity("v33_214", "t1_income_total", "t1_expense_total", 0.01),
    Identity("v33_241_total", "t3_total", "t3_basic + t3_project", 0.01),
    Identity("v33_243_personnel", "t6_personnel", "0.0 + t6_301 + t6_303", 0.01, when="t6_personnel > 0", optional=("t6_301", "t6_303")),
    Identity("v33_243_public", "t6_public", "0.0 + t6_302 + t6_310", 0.01, when="t6_public > 0", optional=("t6_302", "t6_310")),
    Identity("v33_243_total", "t6_basic", "t6_personnel + t6_public", 0.01, when="t6_basic > 0", optional=("t6_public",)),
    Identity("v33_244_vehicle", "t7_vehicle", "t7_vehicle_buy + t7_vehicle_run", 0.01, optional=("t7_vehicle_buy",)),
    Identity("bud_101", "b1_income", "b1_expense", 1.0, 0.0005, kind="budget"),
    Identity("bud_102", "b3_total", "b3_basic + b3_project", 1.0, 0.0005, kind="budget"),
    Identity("bud_103", "b8_total", "b8_personnel + b8_public", 1.0, 0.0005, kind="budget"),
    Identity("bud_104_total", "b9_total", "b9_overseas + b9_vehicle + b9_reception", 0.01, 0.0005, kind="budget", optional=("b9_overseas", "b9_vehicle", "b9_reception")),
    Identity("bud_104_vehicle", "b9_vehicle", "b9_vehicle_buy + b9_vehicle_run", 0.01, 0.0005, kind="budget", optional=("b9_vehicle_buy",)),
    Identity("bud_105_income", "b1_income", "b4_income", 1.0, 0.0005, kind="budget", severity="warn"),
    Identity("bud_105_expense", "b1_expense", "b4_expense", 1.0, 0.0005, kind="budget", severity="warn"),
    Identity("bud_105_total", "b3_total", "b5_total", 1.0, 0.0005, kind="budget", severity="warn"),
    Identity("bud_105_basic", "b3_basic", "b5_basic", 1.0, 0.0005, kind="budget", severity="warn"),
    Identity("bud_105_project", "b3_project", "b5_project", 1.0, 0.0005, kind="budget", severity="warn"),
    Identity("bud_105_economic", "b3_basic", "b8_total", 1.0, 0.0005, kind="budget", severity="warn"),
]


def _finding(rule: str, severity: str, lhs: Column, rhs: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"))


def identity_findings(wide: DataFrame, rules: list[Identity]) -> DataFrame:
    """Violated identities of each document; rules whose operands `wide` lacks are
    left out when the plan is built."""
    have = set(wide.columns)
    found = []
    for r in rules:
        text = f"{r.lhs} {r.rhs} {r.when}"
        names = {o.name for o in OPERANDS if o.name in text.replace("(", " ").replace(")", " ").split()} | {w for w in text.replace("(", " ").replace(")", " ").split() if w in have}
        if not names <= have:
            continue
        zero = {n: f"coalesce({n}, 0.0)" for n in r.optional}
        expr = lambda s, z=zero: F.expr(" ".join(z.get(w, w) for w in s.split()))
        lhs, rhs = expr(r.lhs), expr(r.rhs)
        none = F.coalesce(*[F.col(n) for n in r.optional]).isNull() if r.optional and all(n in r.optional for n in r.rhs.replace("+", " ").split()) else F.lit(False)
        bad = F.expr(r.when) & ~none & lhs.isNotNull() & rhs.isNotNull() & ~N.close(lhs, rhs, r.absolute, r.relative)
        found.append(F.when(bad, _finding(r.rule, r.severity, lhs, rhs)))
    if not found:
        return wide.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("rule", "string"), ("severity", "string"), ("lhs", "double"), ("rhs", "double"))])
    return wide.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("doc_id", "f.*")


def _code(rows: DataFrame) -> Column:
    """A row's classification code, or an empty text."""
    first = F.regexp_replace(F.coalesce(F.get("cells", F.lit(0)), F.lit("")), r"\s", "")
    return F.col("code") if "code" in rows.columns else F.regexp_extract(first, r"^(\d{3}(?:\d{2}){0,4})", 1)


def code_rows(rows: DataFrame) -> DataFrame:
    """Rows with a classification code: doc_id, t, code, amounts."""
    return rows.select("doc_id", "t", "row_idx", _code(rows).alias("code"), _amounts(rows).alias("v")).where((F.col("code") != "") & (F.size("v") > 0))


def hierarchy_findings(rows: DataFrame, tables: tuple[str, ...] = ("T2", "T3", "T5"), tolerance: float = 0.1, rule: str = "v33_120") -> DataFrame:
    """Codes whose amount is not the sum of the codes one level below.  Parent and
    children meet on (document, table, parent code), an equi key; rows are read once for both."""
    codes = code_rows(rows).where(F.col("t").isin(*tables)).select("doc_id", "t", "code", F.get("v", F.lit(0)).alias("amount"))
    parent, none = F.substring("code", F.lit(1), F.length("code") - 2), F.lit(None).cast("double")
    side = lambda k, own, part: F.struct(k.alias("k"), own.alias("own"), part.alias("part"))
    own, part = side(F.col("code"), F.col("amount"), none), side(parent, none, F.col("amount"))
    both = codes.select("doc_id", "t", F.inline(F.when(F.length("code") > 3, F.array(own, part)).otherwise(F.array(own))))
    sums = both.groupBy("doc_id", "t", "k").agg(F.max("own").alias("own"), F.sum("part").alias("parts"))
    bad = sums.where(F.col("own").isNotNull() & F.col("parts").isNotNull() & ~N.close(F.col("own"), F.col("parts"), tolerance))
    return bad.select("doc_id", F.lit(rule).alias("rule"), F.lit("error").alias("severity"), F.col("own").alias("lhs"), F.col("parts").alias("rhs"), F.concat_ws(" ", "t", "k").alias("message"))


def row_findings(rows: DataFrame, tables: tuple[str, ...] = ("T3", "T5"), tolerance: float = 0.01) -> DataFrame:
    """Rows whose first amount is not the sum of the next two."""
    v = lambda i: F.get("v", F.lit(i))
    codes = code_rows(rows).where(F.col("t").isin(*tables) & (F.size("v") >= 3))
    bad = codes.where(~N.close(v(0), v(1) + v(2), tolerance))
    return bad.select("doc_id", F.lit("v33_241").alias("rule"), F.lit("error").alias("severity"), v(0).alias("lhs"), (v(1) + v(2)).alias("rhs"), F.concat_ws(" ", "t", "code").alias("message"))


def _found(df: DataFrame, rule: str, severity: str, lhs: Column, rhs: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"), F.concat_ws(" ", "t", F.col("row_idx").cast("string")).alias("message"))


def largest_findings(rows: DataFrame, table: str, rule: str, least: int, parts: int | None = None, skip: str | None = None, head: int = 3, tolerance: float = 0.05) -> DataFrame:
    """Rows below the header whose largest amount is not the sum of the others (of
    the `parts` next ones), where they have at least `least` positive amounts."""
    positive = F.reverse(F.array_sort(F.filter(_amounts(rows), lambda x: x > 0)))
    body = rows.where((F.col("t") == table) & (F.col("row_idx") >= head))
    body = body.where(~F.array_join("cells", "").rlike(skip)) if skip else body
    rest = F.slice("v", F.lit(2), F.lit(parts) if parts else F.greatest(F.size("v"), F.lit(1)))
    total, others = F.get("v", F.lit(0)), F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
    found = body.select("doc_id", "t", "row_idx", positive.cast("array<double>").alias("v")).where(F.size("v") >= least)
    found = found.select("doc_id", "t", "row_idx", total.alias("total"), others.alias("others"))
    return _found(found.where((F.col("total") > 0.01) & (F.col("others") > 0.01) & (F.abs(F.col("total") - F.col("others")) > tolerance)), rule, "warn", F.col("total"), F.col("others"))


def source_findings(rows: DataFrame, table: str = "T2", tolerance: float = 0.01) -> DataFrame:
    """Code rows whose first amount is not the sum of all that follow (its sources)."""
    v = F.col("v").cast("array<double>")
    some = code_rows(rows).where((F.col("t") == table) & (F.size("v") >= 2)).select("doc_id", "t", "row_idx", F.get(v, F.lit(0)).alias("total"), F.aggregate(F.slice(v, F.lit(2), F.size("v") - 1), F.lit(0.0), lambda a, x: a + x).alias("parts"))
    return _found(some.where(F.abs(F.col("total") - F.col("parts")) > tolerance), "v33_240", "error", F.col("total"), F.col("parts"))


def blank_findings(rows: DataFrame, pages: DataFrame, tables: tuple[str, ...] = ("T7", "T8", "T9")) -> DataFrame:
    """Tables of at most five rows and few filled cells, without a note that they have no data."""
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    size = rows.where(F.col("t").isin(*tables)).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(filled).alias("filled"), F.max(F.size("cells")).alias("width"))
    noted = pages.where(F.col("text").contains("注：") & F.col("text").contains("无数据")).select("doc_id").distinct()
    bare = size.where("n <= 5 AND filled <= 2 * width").join(noted, "doc_id", "left_anti")
    return bare.select("doc_id", F.lit("v33_114").alias("rule"), F.lit("error").alias("severity"), F.concat(F.col("t"), F.lit(" is empty without a note")).alias("message"))


#: columns of a table that are added up side by side; more go in further groups
SIDE_BY_SIDE = 8


def leaf_findings(rows: DataFrame, tables: tuple[str, ...] = ("T2", "T3", "T5")) -> DataFrame:
    """A total row against the sum of the deepest codes, column by column: beyond
    1 and 0.1 %, and beyond half of the total.  Sums by length of code come first, so that
    neither rows nor their cells are sorted."""
    v, n = F.col("v"), SIDE_BY_SIDE
    total = rows.where(F.col("t").isin(*tables) & X.contains_any(V.line(rows), ("合计", "总计"))).groupBy("doc_id", "t").agg(F.min_by(_amounts(rows), "row_idx").alias("total"))
    codes = code_rows(rows).where(F.col("t").isin(*tables)).select("doc_id", "t", F.length("code").alias("depth"), "v")
    sums = [f"s{i}" for i in range(n)]

    def added(each: DataFrame) -> DataFrame:
        """By depth, then those of the deepest; rows are dealt by document once for both."""
        by = each.groupBy("doc_id", "t", "part", "depth").agg(*[F.sum(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(sums)])
        return by.groupBy("doc_id", "t", "part").agg(F.max("depth").alias("depth"), *[F.max_by(c, "depth").alias(c) for c in sums])

    first = added(codes.withColumn("part", F.lit(0)).repartition("doc_id"))
    rest = F.transform(F.sequence(F.lit(1), F.floor((F.size(v) - 1) / n).cast("int")), lambda k: F.struct(k.alias("part"), F.slice(v, k * n + 1, F.lit(n)).alias("v")))
    more = added(codes.where(F.size(v) > n).select("doc_id", "t", "depth", F.inline(rest)))
    # every row has a first part, so that its depth is the table's; others may end before
    more = more.join(first.select("doc_id", "t", "depth"), ["doc_id", "t", "depth"]).select(*first.columns)
    leaves = first.unionByName(more).join(total, ["doc_id", "t"]).select("doc_id", "t", "part", "total", F.array(*sums).alias("sums"))
    both = leaves.select("doc_id", "t", "total", "part", F.posexplode("sums").alias("i", "sum")).where("sum IS NOT NULL").withColumn("col", F.col("part") * n + F.col("i"))
    both = both.withColumn("whole", F.get("total", F.col("col"))).where("whole IS NOT NULL")
    diff = F.abs(F.col("sum") - F.col("whole"))
    bad = both.where((diff > F.greatest(F.lit(1.0), F.abs("sum") * 0.001)) & ((F.col("whole") == 0) | (diff / F.abs("whole") > 0.5)))
    return bad.select("doc_id", F.lit("v33_005").alias("rule"), F.lit("warn").alias("severity"), F.col("whole").alias("lhs"), F.col("sum").alias("rhs"), F.concat_ws(" ", F.col("t"), F.col("col").cast("string")).alias("message"))


def mirror_findings(rows: DataFrame, income: str, expense: str, tolerance: float = 1e-6) -> DataFrame:
    """Codes that stand in both an income and an expenditure table with other
    amounts; two codes of each and a common one are needed."""
    side = lambda t, name: code_rows(rows).where(F.col("t") == t).groupBy("doc_id", "code").agg(F.min_by(F.get("v", F.lit(0)), "row_idx").alias(name))
    both = side(income, "i").join(side(expense, "e"), ["doc_id", "code"], "full_outer")
    w = Window.partitionBy("doc_id")
    both = both.withColumn("ni", F.count("i").over(w)).withColumn("ne", F.count("e").over(w)).withColumn("nb", F.count_if(F.col("i").isNotNull() & F.col("e").isNotNull()).over(w))
    bad = both.where("ni >= 2 AND ne >= 2 AND nb >= 1").where(F.col("i").isNull() | F.col("e").isNull() | (F.abs(F.col("i") - F.col("e")) > tolerance))
    return bad.select("doc_id", F.lit("cmm_004").alias("rule"), F.lit("warn").alias("severity"), F.col("i").alias("lhs"), F.col("e").alias("rhs"), F.col("code").alias("message"))


# ------------------------------------------------------------------- narrative


@dataclass(frozen=True)
class Stated:
    """An amount in the text (first group of a pattern over compacted text), and the
    operand it must equal."""

    rule: str
    pattern: str
    operand: str
    absolute: float = 0.01
    relative: float = 0.0


#: fixed values: sentences that state a table's value
_AMOUNT = r"(\d[\d,]*(?:\.\d+)?)万元"
STATED = [
    Stated("v33_225", rf"收入支出总计{_AMOUNT}", "t1_income_total"),
    Stated("v33_102", rf"(?:收入总计|收支总计)[^0-9。]{{0,20}}{_AMOUNT}", "t1_income_total", 1.0, 0.001),
    Stated("v33_226", rf"本年收入合计{_AMOUNT}", "t2_total"),
    Stated("v33_103", rf"其中[：:，,]?财政拨款收入{_AMOUNT}", "t2_grant", 1.0, 0.001),
    Stated("v33_220_total", rf"本年支出合计{_AMOUNT}", "t3_total"),
    Stated("v33_220_basic", rf"基本支出{_AMOUNT}", "t3_basic"),
    Stated("v33_220_project", rf"项目支出{_AMOUNT}", "t3_project"),
    Stated("v33_221", rf"财政拨款收入支出总计{_AMOUNT}", "t4_total"),
    Stated("v33_105", rf"财政拨款收支总计[^0-9。]{{0,20}}{_AMOUNT}", "t4_total", 1.0, 0.001),
    Stated("v33_222", rf"一般公共预算财政拨款支出{_AMOUNT}", "t5_total"),
    Stated("v33_223_personnel", rf"人员经费{_AMOUNT}", "t6_personnel"),
    Stated("v33_223_public", rf"公用经费{_AMOUNT}", "t6_public"),
    Stated("v33_224_total", rf"“三公”经费[^0-9。]{{0,40}}支出决算(?:数)?为{_AMOUNT}", "t7_total"),
    Stated("v33_108", rf"“三公”经费[^0-9。]{{0,40}}预算(?:数)?为{_AMOUNT}", "t7_budget", 1.0, 0.001),
    Stated("v33_224_overseas", rf"因公出国（境）费[^0-9。]{{0,30}}决算(?:数)?为{_AMOUNT}", "t7_overseas"),
    Stated("v33_224_reception", rf"公务接待费[^0-9。]{{0,30}}决算(?:数)?为{_AMOUNT}", "t7_reception"),
    Stated("cmm_001_overseas", rf"因公出国(?:（境）|\(境\)|境)?费{_AMOUNT}", "t7_overseas"),
    Stated("cmm_001_reception", rf"公务接待费{_AMOUNT}", "t7_reception"),
    Stated("cmm_001_vehicle", rf"公务用车购置及运行(?:维护)?费{_AMOUNT}", "t7_vehicle"),
    Stated("cmm_001_vehicle_buy", rf"公务用车购置费{_AMOUNT}", "t7_vehicle_buy"),
    Stated("cmm_001_vehicle_run", rf"公务用车运行(?:维护)?费{_AMOUNT}", "t7_vehicle_run"),
    Stated("cmm_001_budget_overseas", rf"因公出国(?:（境）|\(境\)|境)?费{_AMOUNT}", "b9_overseas"),
    Stated("cmm_001_budget_reception", rf"公务接待费{_AMOUNT}", "b9_reception"),
    Stated("cmm_001_budget_vehicle", rf"公务用车购置及运行(?:维护)?费{_AMOUNT}", "b9_vehicle"),
    Stated("bud_107_income", rf"收入预算{_AMOUNT}", "b1_income", 0.05, 0.0005),
    Stated("bud_107_expense", rf"支出预算{_AMOUNT}", "b1_expense", 0.05, 0.0005),
    Stated("bud_107_public", rf"“三公”经费预算(?:数)?为{_AMOUNT}", "b9_total", 0.05, 0.0005),
    Stated("bud_108", rf"(?:绩效目标|项目资金)[^0-9。]{{0,30}}{_AMOUNT}", "b3_project", 0.10, 0.005),
]


def narrative_findings(pages: DataFrame, wide: DataFrame, stated: list[Stated] = STATED) -> DataFrame:
    """Amounts in the text that are not the table's.  Each page yields one row of
    all amounts; the first page that states one counts."""
    use = [s for s in stated if s.operand in wide.columns]
    flat = pages.select("doc_id", "page", X.compact(F.col("text")).alias("c"))
    number = lambda s: F.replace(F.nullif(F.regexp_extract("c", s.pattern, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    by_page = flat.select("doc_id", "page", *[number(s).alias(f"n{i}") for i, s in enumerate(use)])
    first = by_page.groupBy("doc_id").agg(*[F.min_by(f"n{i}", F.when(F.col(f"n{i}").isNotNull(), F.col("page"))).alias(f"n{i}") for i in range(len(use))])
    rows = first.join(wide, "doc_id")
    found = [F.when(F.col(f"n{i}").isNotNull() & F.col(s.operand).isNotNull() & ~N.close(F.col(f"n{i}"), F.col(s.operand), s.absolute, s.relative), _finding(s.rule, "warn", F.col(f"n{i}"), F.col(s.operand))) for i, s in enumerate(use)]
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("doc_id", "f.*")


def share_findings(pages: DataFrame, wide: DataFrame, shares: list[tuple[str, str, str, str, float]]) -> DataFrame:
    """(rule, pattern of a percentage, part, whole, points): stated shares that are
    further off than so many percentage points."""
    flat = pages.select("doc_id", "page", X.compact(F.col("text")).alias("c"))
    by = flat.groupBy("doc_id").agg(*[F.min_by(F.nullif(F.regexp_extract("c", p, 1), F.lit("")).try_cast("double"), F.when(F.regexp_extract("c", p, 1) != "", F.col("page"))).alias(f"s{i}") for i, (_, p, _, _, _) in enumerate(shares)])
    rows = by.join(wide, "doc_id")
    found = []
    for i, (rule, _, part, whole, points) in enumerate(shares):
        true = N.share(F.col(part), F.col(whole))
        found.append(F.when(F.abs(F.col(f"s{i}") - true) > points, _finding(rule, "warn", F.col(f"s{i}"), true)))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("doc_id", "f.*")


def wording_findings(pages: DataFrame) -> DataFrame:
    """Sentences that compare a final amount with its budget in a word (大于, 小于,
    持平) that the two numbers do not bear out."""
    pattern = r"预算(?:数)?为(\d[\d,]*(?:\.\d+)?)万元[^。；]{0,60}?决算(?:数)?为(\d[\d,]*(?:\.\d+)?)万元[^。；]{0,80}?决算数(大于|小于|等于|与预算数持平|持平)"
    flat = pages.select("doc_id", "page", X.compact(F.col("text")).alias("c"))
    get = lambda k: F.regexp_extract_all("c", F.lit(pattern), F.lit(k))
    rows = flat.select("doc_id", "page", F.explode(F.arrays_zip(get(1).alias("b"), get(2).alias("a"), get(3).alias("w"))).alias("z"))
    b, a = N.parse_number(F.col("z.b")), N.parse_number(F.col("z.a"))
    said, true = F.when(F.col("z.w") == "大于", 1).when(F.col("z.w") == "小于", -1).otherwise(0), F.signum(a - b).cast("int")
    return rows.where(said != true).select("doc_id", F.lit("v33_110").alias("rule"), F.lit("warn").alias("severity"), a.alias("lhs"), b.alias("rhs"), F.col("z.w").alias("message"))


# -------------------------------------------------------------------- registry


@dataclass(frozen=True)
class Rule:
    """A rule by name: kind of report it applies to, and a function of (pages, rows,
    wide) that returns findings.  needs: tables without which it finds nothing in any document."""

    name: str
    kind: str
    run: object
    needs: tuple[str, ...] = ()


_COLUMNS = ("doc_id", "rule", "severity", "message")


def _structure(tables: dict, what) -> object:
    """A rule on where the tables' names stand."""
    return lambda pages, rows, wide: what(pages, anchors(pages, tables))


def _missing(tables: dict) -> object:
    return _structure(tables, lambda pages, found: missing_tables(pages.select("doc_id").distinct(), found, tables))


def _order(tables: dict) -> object:
    return _structure(tables, lambda pages, found: order_inversions(found.groupBy("doc_id", "t").agg(F.min("page").alias("page")), tables))


#: rules on the text alone, by name
TEXT_RULES = {
    "placeholders": lambda pages: T.placeholder_findings(pages),
    "punctuation": lambda pages: T.punctuation_findings(pages),
    "doubled_words": lambda pages: T.page_findings(pages, T.DOUBLED, "doubled_words"),
    "odd_wording": lambda pages: T.page_findings(pages, T.ODD_WORDING, "odd_wording", compacted=True),
    "zero_total": lambda pages: T.page_findings(pages, T.ZERO_TOTAL, "zero_total", compacted=True),
    "long_percent": lambda pages: T.page_findings(pages, T.LONG_PERCENT, "long_percent"),
    "percent_range": lambda pages: T.percent_findings(pages),
    "units": lambda pages: T.unit_findings(pages),
    "zero_increase": lambda pages: T.zero_increase_findings(pages),
    "direction": lambda pages: T.direction_findings(pages),
}

#: rules that are evaluated on whole rows or sections instead of single operands
ELSEWHERE = ("v33_101", "v33_102", "v33_103", "v33_105", "v33_108", "v33_119", "v33_122_fund", "v33_122_state", "v33_202", "v33_220_basic", "v33_220_project", "v33_221", "v33_222", "v33_223_personnel", "v33_223_public", "v33_224_total", "v33_224_overseas", "v33_224_reception", "v33_225", "v33_226", "cmm_001_overseas", "cmm_001_reception", "cmm_001_vehicle", "cmm_001_vehicle_buy", "cmm_001_vehicle_run", "cmm_001_budget_overseas", "cmm_001_budget_reception", "cmm_001_budget_vehicle")

RULES = [
    Rule("identity_final", "final", lambda pages, rows, wide: identity_findings(wide, [r for r in IDENTITIES if r.kind == "final" and r.rule not in ELSEWHERE])),
    Rule("identity_budget", "budget", lambda pages, rows, wide: identity_findings(wide, [r for r in IDENTITIES if r.kind == "budget"])),
    Rule("hierarchy", "final", lambda pages, rows, wide: hierarchy_findings(rows)),
    Rule("rows", "final", lambda pages, rows, wide: row_findings(rows)),
    Rule("leaves", "final", lambda pages, rows, wide: leaf_findings(rows)),
    Rule("mirror_final", "final", lambda pages, rows, wide: mirror_findings(rows, "T2", "T3"), ("T2", "T3")),
    Rule("mirror_budget", "budget", lambda pages, rows, wide: mirror_findings(rows, "B2", "B3"), ("B2", "B3")),
    Rule("narrative", "any", lambda pages, rows, wide: narrative_findings(pages, wide, [s for s in STATED if s.rule not in ELSEWHERE])),
    Rule("wording", "final", lambda pages, rows, wide: S.expenditure_findings(pages)),
    Rule("totals", "final", lambda pages, rows, wide: V.total_findings(pages, rows), ("T1",)),
    Rule("near_numbers", "final", lambda pages, rows, wide: V.near_findings(pages, rows)),
    Rule("class_shares", "final", lambda pages, rows, wide: V.class_share_findings(pages, rows), ("T5",)),
    Rule("statements", "final", lambda pages, rows, wide: V.statement_findings(pages, rows)),
    Rule("classes", "final", lambda pages, rows, wide: V.class_findings(pages, rows), ("T5",)),
    Rule("public", "any", lambda pages, rows, wide: V.public_findings(pages, rows)),
    Rule("zero_hints", "final", lambda pages, rows, wide: V.zero_hints(pages, rows), ("T7",)),
    Rule("grant_balances", "final", lambda pages, rows, wide: G.balance_findings(rows), ("T4",)),
    Rule("grant_rows", "final", lambda pages, rows, wide: G.row_findings(rows), ("T4",)),
    Rule("grant_columns", "final", lambda pages, rows, wide: G.column_findings(rows), ("T4",)),
    Rule("grant_empty", "final", lambda pages, rows, wide: G.empty_findings(rows)),
    Rule("grant_general", "final", lambda pages, rows, wide: G.general_findings(rows), ("T4", "T5")),
    Rule("unfilled", "budget", lambda pages, rows, wide: H.placeholder_findings(pages)),
    Rule("income_rows", "final", lambda pages, rows, wide: largest_findings(rows, "T2", "v33_210", 2, skip="合计"), ("T2",)),
    Rule("expenditure_rows", "final", lambda pages, rows, wide: largest_findings(rows, "T3", "v33_211", 3, parts=2), ("T3",)),
    Rule("income_sources", "final", lambda pages, rows, wide: source_findings(rows), ("T2",)),
    Rule("economic_details", "final", lambda pages, rows, wide: hierarchy_findings(rows, ("T6",), 1.0, "v33_243"), ("T6",)),
    Rule("blank_tables", "final", lambda pages, rows, wide: blank_findings(rows, pages)),
    Rule("missing_final", "final", _missing(D.FINAL_TABLES)),
    Rule("missing_budget", "budget", _missing(D.BUDGET_TABLES)),
    Rule("order_final", "final", _order(D.FINAL_TABLES)),
    Rule("order_budget", "budget", _order(D.BUDGET_TABLES)),
    Rule("contents", "any", _structure({**D.FINAL_TABLES, **D.BUDGET_TABLES}, toc_findings)),
    *[Rule(name, "any", lambda pages, rows, wide, f=f: f(pages)) for name, f in TEXT_RULES.items()],
]


def _stored(df: DataFrame) -> DataFrame:
    """df computed once: as a table in the checkpoint folder where the session has one, which readers
    filter by column, else in the executors' storage."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder}/rules-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_rules(pages: DataFrame, rows: DataFrame, docs: DataFrame, rules: list[Rule] = RULES, isolated: bool = False) -> DataFrame:
    """All findings of docs(doc_id, kind): rules run on the documents of their kind, which are
    picked out and stored once for all rules.

    A rule whose plan cannot be built gives one `hint` finding in its place and the others
    go on.  isolated: the findings of each rule are written to the checkpoint folder by
    themselves, so that the same holds for one that fails while it runs.
    """
    names = sorted({r.kind for r in rules} - {"any"})
    kinds = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("__docs"), *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(f"__is_{k}") for k in names])
    # computed once for all rules: each reads what it needs of the tables and kinds that are there
    held = lambda df: _stored(df.join(kinds, "doc_id").drop("__docs"))
    pages_of, rows_of = held(pages), held(rows.select("*", _numbers(F.col("cells")).alias("numbers"), V.line(rows).alias("line"), _squeezed(rows).alias("squeezed"), _code(rows).alias("code")))
    needed = sorted({o.table for o in OPERANDS} | {t for r in rules for t in r.needs})
    there = {r["t"] for r in rows_of.where(F.col("t").isin(*needed)).select("t").distinct().collect()}
    # operands of tables that no document has are not looked for
    wanted = [o for o in OPERANDS if o.table in there] or OPERANDS
    wide_of = _stored(operands(rows_of, wanted).join(kinds, "doc_id").drop("__docs"))
    wide_of = wide_of.select("doc_id", *[F.col(o.name) if o in wanted else F.lit(None).cast("double").alias(o.name) for o in OPERANDS], *[f"__is_{k}" for k in names])
    out = None
    inputs: dict[str, tuple] = {}
    for r in rules:
        if out is not None and not there.issuperset(r.needs):
            continue
        of = docs.select("doc_id") if r.kind == "any" else docs.where(F.col("kind") == r.kind).select("doc_id")
        if r.kind not in inputs:
            inputs[r.kind] = tuple((df if r.kind == "any" else df.where(f"__is_{r.kind}")).drop(*[f"__is_{k}" for k in names]) for df in (pages_of, rows_of, wide_of))
        try:
            found = r.run(*inputs[r.kind])
            found = found.select(*[F.col(c) if c in found.columns else (F.concat_ws(" vs ", F.col("lhs").cast("string"), F.col("rhs").cast("string")) if c == "message" else F.lit(None).cast("string")).alias(c) for c in _COLUMNS])
            found = found.checkpoint() if isolated else found
        except Exception as e:  # one broken rule must not take the others along
            found = of.limit(1).select("doc_id", F.lit(r.name).alias("rule"), F.lit("hint").alias("severity"), F.lit(f"rule failed: {type(e).__name__}").alias("message"))
        out = found if out is None else out.unionByName(found)
    return out
