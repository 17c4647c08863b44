"""Amounts and shares that a report's text states, against its tables.

rows(doc_id, t, row_idx, cells) are grids of tables T1..T9, pages(doc_id, page, text) the
text.  What rules need of tables comes from one conditional aggregation, what they need of the
text from one pass over pages (each rule reads only the pages of its own section) and
one over whole texts; all meet by document.  A cell that is no number counts as 0.
Findings: doc_id, rule, severity, lhs (stated), rhs (the table's), message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from . import sections

_NUMBER = r"(\d+\.?\d*)\s*万元"


def cell_values(cells: Column) -> Column:
    """The number of each cell, 0 where it has none."""
    return F.transform(cells, lambda c: F.coalesce(N.parse_number(c), F.lit(0.0)))


def row_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "")


def line(rows: DataFrame) -> Column:
    """The same, joined before where the rows hold it."""
    return F.col("line") if "line" in rows.columns else F.array_join("cells", "")


# ----------------------------------------------------------- rows by their heads


@dataclass(frozen=True)
class RowValue:
    """The last amount (no percentage) of a table's first row whose first cell has one of the words."""

    name: str
    table: str
    words: tuple[str, ...]


#: fixed values: words by which rows are found
ROW_VALUES = (
    RowValue("t1_total", "T1", ("支出合计", "支出总计", "合计")),
    RowValue("t1_year", "T1", ("本年支出合计", "本年支出", "本年合计")),
    RowValue("t1_allocated", "T1", ("结余分配", "结余分配支出")),
    RowValue("t1_carried", "T1", ("年末结转和结余", "年末结转", "结转结余")),
    RowValue("t2_total", "T2", ("本年收入合计", "本年合计", "合计")),
    RowValue("t2_grant", "T2", ("财政拨款收入", "一般公共预算财政拨款收入", "财政拨款")),
    RowValue("t3_total", "T3", ("本年支出合计", "本年合计", "合计")),
    RowValue("t3_basic", "T3", ("基本支出",)),
    RowValue("t3_project", "T3", ("项目支出",)),
    RowValue("t4_total", "T4", ("支出合计", "支出总计", "合计")),
    RowValue("t5_total", "T5", ("合计", "支出合计")),
    RowValue("t6_personnel", "T6", ("人员经费合计", "人员经费")),
    RowValue("t6_public", "T6", ("公用经费合计", "公用经费")),
    RowValue("t7_budget", "T7", ("合计预算数", "预算合计", "预算数")),
    RowValue("t7_final", "T7", ("合计决算数", "决算合计", "决算数")),
)


def row_values(rows: DataFrame, wanted: tuple[RowValue, ...] = ROW_VALUES) -> DataFrame:
    """One row per document that has any of the rows, with every wanted value."""
    cells, t, head = F.col("cells"), F.col("t"), F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    hit = lambda w: (t == w.table) & X.contains_any(F.col("head"), w.words)
    # most rows are none of these: they go before their cells are read
    words = {k: tuple(dict.fromkeys(x for w in wanted if w.table == k for x in w.words)) for k in sorted({w.table for w in wanted})}
    own = F.coalesce(*[F.when(t == k, X.contains_any(head, ws)) for k, ws in words.items()], F.lit(False))
    plain = F.array_compact(F.transform(cells, lambda c: F.when(~F.coalesce(c, F.lit("")).contains("%"), N.parse_number(c))))
    slim = rows.where(t.isin(*words) & own).select("doc_id", "t", "row_idx", head.alias("head"), F.get(plain, F.size(plain) - 1).alias("v"))
    return slim.groupBy("doc_id").agg(*[F.min_by("v", F.when(hit(w), F.col("row_idx"))).alias(w.name) for w in wanted])


# ------------------------------------------------------- numbers near their words


@dataclass(frozen=True)
class Near:
    """The first number of the whole text that follows one of the words without another
    digit between, against an expression over row values."""

    rule: str
    words: tuple[str, ...]
    value: str
    when: str = "true"


#: fixed values: words that numbers are looked for behind
NEAR = (
    Near("v33_103_total", ("收入决算情况说明", "本年收入合计", "合计"), "t2_total", "t2_grant IS NOT NULL"),
    Near("v33_103_grant", ("财政拨款收入",), "t2_grant", "t2_total IS NOT NULL"),
    Near("v33_104_total", ("支出决算情况说明", "本年支出合计", "合计"), "t3_total", "t3_basic IS NOT NULL AND t3_project IS NOT NULL"),
    Near("v33_104_basic", ("基本支出",), "t3_basic", "t3_total IS NOT NULL AND t3_project IS NOT NULL"),
    Near("v33_104_project", ("项目支出",), "t3_project", "t3_total IS NOT NULL AND t3_basic IS NOT NULL"),
    Near("v33_105", ("财政拨款收入支出决算总体情况说明", "总计", "合计"), "t4_total"),
    Near("v33_106_total", ("总体情况说明", "总体情况"), "t5_total"),
    Near("v33_107", ("一般公共预算财政拨款基本支出决算情况说明", "基本支出", "合计"), "t6_personnel + t6_public"),
    Near("v33_108_budget", ("三公", "年初预算", "预算"), "t7_budget", "t7_budget <> 0"),
    Near("v33_108_final", ("三公", "支出决算", "决算"), "t7_final", "t7_final <> 0"),
)


@dataclass(frozen=True)
class Share:
    """The first percentage behind one of the words, against part / whole."""

    rule: str
    words: tuple[str, ...]
    part: str
    whole: str
    points: float
    when: str = "true"


#: fixed values: shares that texts state
SHARES = (
    Share("v33_103_share", ("财政拨款收入", "占比", "比重"), "t2_grant", "t2_total", 1.0),
    Share("v33_104_basic_share", ("基本支出", "占比", "比重"), "t3_basic", "t3_total", 1.0, "t3_project IS NOT NULL"),
    Share("v33_104_project_share", ("项目支出", "占比", "比重"), "t3_project", "t3_total", 1.0, "t3_basic IS NOT NULL"),
)
#: percentage points that a class's share may be off
CLASS_POINTS = 2.0


def near_number(text: Column, words: tuple[str, ...]) -> Column:
    found = F.regexp_extract(text, rf"(?s)(?:{'|'.join(words)})[^0-9]*?(-?\d+(?:,\d{{3}})*(?:\.\d+)?)", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def near_percent(text: Column, words: tuple[str, ...]) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?s)(?:{'|'.join(words)})[^0-9]*?(-?\d+(?:\.\d+)?)%", 1), F.lit("")).try_cast("double")


_FINDINGS = "array<struct<rule:string,severity:string,lhs:double,rhs:double,message:string>>"


def _found(rule: str, lhs: Column, rhs: Column, message: Column | None = None, severity: str = "warn") -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"), F.coalesce(message, F.lit("")).alias("message") if message is not None else F.lit("").alias("message"))


def _exploded(df: DataFrame, found: list[Column]) -> DataFrame:
    return df.select("doc_id", F.inline(F.array_compact(F.array(*found)).cast(_FINDINGS)))


def near_findings(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbers and shares in the whole text that are not those of the tables' rows.  A stated
    0 says nothing of an amount."""
    says = [F.expr(n.when) & F.expr(n.value).isNotNull() for n in NEAR] + [F.expr(s.when) & (F.col(s.whole) != 0) & F.col(s.part).isNotNull() for s in SHARES]
    values = row_values(rows).where(F.coalesce(*[F.when(c, True) for c in says], F.lit(False)))
    texts = sections.full_texts(pages.join(values.select("doc_id"), "doc_id", "left_semi"))
    both = texts.join(values, "doc_id")
    found = []
    # texts are searched inside, only for what the tables have
    for n, said in zip(NEAR, says, strict=False):
        lhs, rhs = near_number(F.col("text"), n.words), F.expr(n.value)
        found.append(F.when(said, F.when((lhs != 0) & ~N.close(rhs, lhs, 1.0, 0.001), _found(n.rule, lhs, rhs))))
    for s, said in zip(SHARES, says[len(NEAR) :], strict=True):
        lhs, rhs = near_percent(F.col("text"), s.words), N.share(F.col(s.part), F.col(s.whole))
        found.append(F.when(said, F.when(F.abs(rhs - lhs) > s.points, _found(s.rule, lhs, rhs))))
    return _exploded(both, found)


def total_findings(pages: DataFrame, rows: DataFrame, first_pages: int = 5, reach: int = 100) -> DataFrame:
    """T1's expenditure against the first number within `reach` characters of the words
    总体情况说明, else 总体情况, on the first pages; and against its parts."""
    values = row_values(rows, tuple(v for v in ROW_VALUES if v.table == "T1"))
    head = sections.full_texts(pages.where(F.col("page") <= first_pages))
    tries = []
    for word in ("总体情况说明", "总体情况"):
        near = F.regexp_extract(F.substring(F.col("text"), F.instr("text", word), F.lit(reach)), r"\d+(?:,\d{3})*(?:\.\d+)?", 0)
        tries.append(F.when(F.instr("text", word) > 0, F.replace(F.nullif(near, F.lit("")), F.lit(","), F.lit("")).try_cast("double")))
    stated = head.select("doc_id", F.coalesce(*tries).alias("stated"))
    both = values.join(stated, "doc_id", "left")
    parts = F.col("t1_year") + F.col("t1_allocated") + F.col("t1_carried")
    return _exploded(both, [
        F.when(F.col("stated").isNotNull() & F.col("t1_total").isNotNull() & ~N.close(F.col("t1_total"), F.col("stated"), 1.0, 0.001), _found("v33_102", F.col("stated"), F.col("t1_total"))),
        F.when(F.col("t1_total").isNotNull() & parts.isNotNull() & ~N.close(F.col("t1_total"), parts, 1.0, 0.001), _found("v33_101", F.col("t1_total"), parts, severity="error")),
    ])


def class_share_findings(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Shares of T5's classes (codes cut to three digits) that the text states otherwise."""
    head = F.regexp_extract(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))), r"^(\d{3,7})", 1)
    plain = F.array_compact(F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: F.when(~F.coalesce(c, F.lit("")).contains("%"), N.parse_number(c))))
    t5 = rows.where((F.col("t") == "T5") & (F.col("row_idx") > 0) & (F.size("cells") > 1)).select("doc_id", F.substring(head, 1, 3).alias("code"), F.get(plain, F.size(plain) - 1).alias("v"))
    sums = t5.where("code <> '' AND v IS NOT NULL").groupBy("doc_id", "code").agg(F.sum("v").alias("v")).where("v > 0")
    total = row_values(rows, tuple(v for v in ROW_VALUES if v.name == "t5_total"))
    both = sums.join(total.where("t5_total <> 0"), "doc_id").join(sections.full_texts(pages), "doc_id")
    share = F.col("v") / F.col("t5_total") * 100
    stated = F.nullif(F.expr(r"regexp_extract(text, concat('(?s)(?:', code, r'|结构情况)[^0-9]*?(-?\d+(?:\.\d+)?)%'), 1)"), F.lit("")).try_cast("double")
    bad = both.select("doc_id", "code", share.alias("rhs"), stated.alias("lhs")).where(F.abs(F.col("rhs") - F.col("lhs")) > CLASS_POINTS)
    return bad.select("doc_id", F.lit("v33_106_share").alias("rule"), F.lit("warn").alias("severity"), "lhs", "rhs", F.col("code").alias("message"))


# ------------------------------------------------------- statements of one section


@dataclass(frozen=True)
class Statement:
    """Amounts of the pages of one section: a page belongs to it that has all words of `all`
    and one of `any`.  keep: `first` (the first such page that states any of them), `head`
    (the first such page) or `last` (the last that states one)."""

    name: str
    all: tuple[str, ...]
    any: tuple[str, ...]
    patterns: tuple[tuple[str, str], ...]
    keep: str = "first"


#: fixed values: pages of sections, and what they state
STATEMENTS = (
    Statement("one", ("收入支出决算", "总体情况"), (), (("n1_total", rf"收入支出总计[^\d]*{_NUMBER}"),)),
    Statement(
        "two", ("收入决算",), ("情况说明", "本年收入合计"),
        tuple((f"n2_{i}", rf"{w}[^\d]{{0,20}}{_NUMBER}") for i, w in enumerate(("本年收入合计", "财政拨款收入", "上级补助收入", "事业收入", "经营收入", "附属单位上缴收入", "其他收入"))), "head",
    ),
    Statement("three", (), ("支出决算情况说明", "本年支出合计"), (("n3_basic", rf"基本支出[^\d]*{_NUMBER}"), ("n3_project", rf"项目支出[^\d]*{_NUMBER}"))),
    Statement("four", ("财政拨款",), ("总体情况", "收入支出决算"), (("n4_total", rf"(?:财政拨款)?[收入支出]*总计[^\d]*{_NUMBER}"),), "last"),
    Statement("six", ("基本支出",), ("人员经费", "公用经费"), (("n6_personnel", rf"人员经费[^\d]*{_NUMBER}"), ("n6_public", rf"公用经费[^\d]*{_NUMBER}"))),
)
#: fixed values: the section on the three public expenses; the first amount within 100 characters of the word that first stands furthest back
THREE_PUBLIC = (("n7_total", ("三公经费支出", "合计")), ("n7_overseas", ("因公出国",)), ("n7_vehicle", ("公务用车购置及运行", "公务用车")), ("n7_reception", ("公务接待",)))


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?s){pattern}", 1), F.lit("")).try_cast("double")


def stated_amounts(pages: DataFrame) -> DataFrame:
    """One row per document: n1_total .. n7_reception, each from its own section's pages."""
    text = F.coalesce("text", F.lit(""))
    own = lambda s: X.contains_all(text, s.all) & (X.contains_any(text, s.any) if s.any else F.lit(True))
    columns, keys = [], []
    for s in STATEMENTS:
        got = F.struct(*[_number(text, p).alias(n) for n, p in s.patterns])
        states = F.coalesce(*[_number(text, p) for _, p in s.patterns]).isNotNull()
        columns.append(F.when(own(s), got).alias(f"v_{s.name}"))
        # one inside the other: other sections' pages are not searched for amounts
        keys.append(F.when(own(s), F.when(states, F.col("page")) if s.keep != "head" else F.col("page")).alias(f"k_{s.name}"))
    three = text.contains("三公") & X.contains_any(text, ("情况说明", "经费支出"))

    def behind(words: tuple[str, ...]) -> Column:
        at = F.greatest(*[F.instr(text, w) for w in words], F.lit(0)) if len(words) > 1 else F.instr(text, words[0])
        return F.when(at > 0, F.nullif(F.regexp_extract(F.substring(text, at, F.lit(100)), _NUMBER, 1), F.lit("")).try_cast("double"))

    columns.append(F.when(three, F.struct(*[behind(w).alias(n) for n, w in THREE_PUBLIC])).alias("v_seven"))
    keys.append(F.when(three, F.col("page")).alias("k_seven"))
    each = pages.select("doc_id", "page", *columns, *keys)
    pick = [(F.max_by if s.keep == "last" else F.min_by)(f"v_{s.name}", f"k_{s.name}").alias(f"v_{s.name}") for s in STATEMENTS]
    by = each.groupBy("doc_id").agg(*pick, F.min_by("v_seven", "k_seven").alias("v_seven"))
    names = [(f"v_{s.name}", n) for s in STATEMENTS for n, _ in s.patterns] + [("v_seven", n) for n, _ in THREE_PUBLIC]
    return by.select("doc_id", *[F.col(v)[n].alias(n) for v, n in names])


def table_numbers(rows: DataFrame) -> DataFrame:
    """One row per document that has any of it, with what the statements are held against: the first total rows'
    cells (t2_row, t3_row), all of T7's (t7_all), and t1, t4, t6 amounts."""
    text, v, t = line(rows), cell_values(F.col("cells")), F.col("t")
    # only totals count, but for T7: other rows go before their cells are read
    some = rows.where(t.isin("T1", "T2", "T3", "T4", "T6", "T7") & ((t == "T7") | X.contains_any(line(rows), ("总计", "合计"))))
    some = some.select("doc_id", "t", "row_idx", text.alias("text"), v.alias("v"))
    first = lambda name, value, hit: F.min_by(value, F.when(hit, F.col("row_idx"))).alias(name)
    last = lambda name, value, hit: F.max_by(value, F.when(hit, F.col("row_idx"))).alias(name)
    has = lambda table, *words: (t == table) & X.contains_all(F.col("text"), words)
    amount = F.get(F.filter("v", lambda x: x != 0), F.lit(0))
    return some.groupBy("doc_id").agg(
        first("t1_amount", amount, has("T1", "总计")),
        first("t2_row", F.col("v"), has("T2", "合计")),
        first("t3_row", F.col("v"), has("T3", "合计")),
        first("t4_amount", F.array_max("v"), has("T4", "总计")),
        last("t6_people", F.array_max("v"), has("T6", "人员经费", "合计")),
        last("t6_office", F.array_max("v"), has("T6", "公用经费", "合计") & ~F.col("text").contains("人员经费")),
        F.flatten(F.collect_list(F.when(t == "T7", F.col("v")))).alias("t7_all"),
    )


def statement_findings(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Amounts stated in sections one to four, six and seven that their tables lack.  Where section one
    states no total, the total counts as 0; of T1's row its first amount counts."""
    both = table_numbers(rows).join(stated_amounts(pages), "doc_id")
    c, tol = F.col, 0.01
    lacks = lambda row, n: ~F.exists(row, lambda x: F.abs(x - c(n)) <= tol)
    n1 = F.coalesce("n1_total", F.lit(0.0))
    found = [F.when((c("t1_amount") > tol) & (F.abs(n1 - c("t1_amount")) > tol), _found("v33_225", n1, c("t1_amount")))]
    found += [F.when((c(n) > 0) & c("t2_row").isNotNull() & lacks("t2_row", n), _found(f"v33_226_{i}", c(n), F.lit(None))) for i, (n, _) in enumerate(STATEMENTS[1].patterns)]
    found += [F.when(c(n).isNotNull() & c("t3_row").isNotNull() & lacks("t3_row", n), _found(f"v33_220_{n[3:]}", c(n), F.lit(None))) for n in ("n3_basic", "n3_project")]
    found.append(F.when((c("n4_total") > 0) & (c("t4_amount") > tol) & (F.abs(c("n4_total") - c("t4_amount")) > tol), _found("v33_221", c("n4_total"), c("t4_amount"))))
    found += [F.when(F.abs(c(n) - c(t)) > tol, _found(rule, c(n), c(t))) for rule, n, t in (("v33_223_personnel", "n6_personnel", "t6_people"), ("v33_223_public", "n6_public", "t6_office"))]
    some = (F.size("t7_all") > 0)
    found += [F.when(some & (c(n).isNotNull() if n == "n7_total" else c(n) > 0) & lacks("t7_all", n), _found(f"v33_224_{n[3:]}", c(n), F.lit(None))) for n, _ in THREE_PUBLIC]
    return _exploded(both, found)


def class_findings(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """T5's total and its three-digit classes against the amounts that the pages of the section on
    general expenditure state behind 支出 and behind a class's name (without 支出)."""
    t5 = rows.where(F.col("t") == "T5").select("doc_id", "row_idx", F.coalesce(F.get("cells", F.lit(0)), F.lit("")).alias("head"), row_text(F.col("cells")).alias("text"), F.array_max(cell_values(F.col("cells"))).alias("v")).where("v IS NOT NULL")
    code = F.regexp_extract("head", r"^\s*(\d{3})\s+", 1)
    total = t5.groupBy("doc_id").agg(F.max_by("v", F.when(F.col("text").contains("合计"), F.col("row_idx"))).alias("total"))
    name = F.trim(F.replace(F.col("head"), F.col("code"), F.lit("")))
    short = F.trim(F.replace(name, F.lit("支出"), F.lit("")))
    classes = t5.withColumn("code", code).where("code <> ''").groupBy("doc_id", "code").agg(F.max_by(F.struct(F.when(F.length(short) < 2, name).otherwise(short).alias("name"), "v"), "row_idx").alias("c")).select("doc_id", "code", "c.name", "c.v")
    own = F.col("text").contains("一般公共预算") & X.contains_any(F.col("text"), ("支出决算", "财政拨款支出")) & F.col("text").contains("情况说明")
    text = sections.full_texts(pages.where(own))
    whole = total.join(text, "doc_id").select("doc_id", "total", _number(F.col("text"), rf"支出[^\d]*{_NUMBER}").alias("n"))
    whole = whole.where((F.col("total") > 0.01) & (F.abs(F.col("n") - F.col("total")) > 0.01))
    stated = F.nullif(F.expr(r"regexp_extract(text, concat('\\Q', name, r'\E[^\d]{0,50}(\d+\.?\d*)\s*万元'), 1)"), F.lit("")).try_cast("double")
    each = classes.join(text, "doc_id").select("doc_id", "code", "name", "v", stated.alias("n")).where(F.abs(F.col("n") - F.col("v")) > 0.01)
    out = lambda df, rule, rhs, message: df.select("doc_id", F.lit(rule).alias("rule"), F.lit("warn").alias("severity"), F.col("n").alias("lhs"), F.col(rhs).alias("rhs"), message.alias("message"))
    return out(whole, "v33_222_total", "total", F.lit("")).unionByName(out(each, "v33_222_class", "v", F.concat("code", "name")))


def zero_hints(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents whose text has 三公 and a 0 on one page while their T7 has no amount above 0."""
    empty = rows.where(F.col("t") == "T7").groupBy("doc_id").agg(F.max(F.coalesce(F.array_max(cell_values(F.col("cells"))), F.lit(0.0))).alias("most")).where("most <= 0")
    said = pages.where(F.col("text").contains("三公") & F.col("text").contains("0")).groupBy("doc_id").agg(F.min("page").alias("page"))
    return said.join(empty, "doc_id").select("doc_id", F.lit("v33_230").alias("rule"), F.lit("info").alias("severity"), F.lit(0.0).alias("lhs"), F.lit(None).cast("double").alias("rhs"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("message"))


# ------------------------------------------------------- the three public expenses

#: fixed values: what texts state of the three public expenses, and the order of a table's amounts
_AMOUNT = r"([0-9][0-9,]*\.?[0-9]*)万元"
PUBLIC_STATED = (
    ("total", (rf"三公[^\n]{{0,40}}经费(?:支出)?(?:预算数|决算数|预算|决算)?(?:为|是)?\s*{_AMOUNT}", rf"三公[^\n]{{0,20}}合计[^\n]{{0,8}}{_AMOUNT}")),
    ("abroad", (rf"因公出国(?:（境）|\(境\)|境)?费\s*{_AMOUNT}",)),
    ("reception", (rf"公务接待费\s*{_AMOUNT}",)),
    ("car_total", (rf"公务用车购置及运行费[^0-9]{{0,4}}{_AMOUNT}",)),
    ("car_buy", (rf"公务用车购置费\s*{_AMOUNT}",)),
    ("car_run", (rf"公务用车运行费\s*{_AMOUNT}",)),
)
#: numbers that a line or row of the table has at least
LEAST_NUMBERS = 6


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def public_amounts(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, v: the table's amounts in the order of PUBLIC_STATED, from the first page that names it
    and has a line of enough numbers (the one with most of them, a decimal point counting as
    one more; of equals the first); else from the row of T7 or B9 with most numbers."""
    text = F.coalesce("text", F.lit(""))
    own = text.contains("三公") & text.contains("表") & X.contains_any(text, ("预算", "决算")) & ~F.substring(text, 1, 120).contains("目录")
    lines = pages.where(own).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    numbers = F.array_compact(F.transform(F.regexp_extract_all("line", F.lit(r"[0-9][0-9,]*\.?[0-9]*"), F.lit(0)), _plain))
    lines = lines.select("doc_id", "page", "k", numbers.alias("v"), F.when(F.col("line").contains("."), 1).otherwise(0).alias("point")).where(F.size("v") >= LEAST_NUMBERS)
    from_text = lines.groupBy("doc_id").agg(F.min_by("v", F.struct("page", -(F.size("v") + F.col("point")), "k")).alias("v"))
    cells = F.array_compact(F.transform("cells", N.parse_plain))
    grid = rows.where(F.col("t").isin("T7", "B9")).select("doc_id", "t", "row_idx", cells.alias("v")).where(F.size("v") >= LEAST_NUMBERS)
    from_rows = grid.groupBy("doc_id").agg(F.min_by("v", F.struct(-F.size("v"), "t", "row_idx")).alias("w"))
    return from_text.join(from_rows, "doc_id", "full_outer").select("doc_id", F.coalesce("v", "w").alias("v"))


def public_findings(pages: DataFrame, rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Amounts of the three public expenses that text and table state differently (the vehicles' running
    cost is an error, others warn); and in the text, vehicles that are not bought plus run."""
    stated = sections.full_texts(pages).select("doc_id", *[F.coalesce(*[_plain(F.nullif(F.regexp_extract("text", f"(?s){p}", 1), F.lit(""))) for p in patterns]).alias(n) for n, patterns in PUBLIC_STATED])
    both = stated.join(public_amounts(pages, rows), "doc_id")
    found = []
    for i, (n, _) in enumerate(PUBLIC_STATED):
        table = F.get("v", F.lit(i))
        found.append(F.when(F.abs(F.col(n) - table) > tolerance, _found(f"cmm_001_{n}", F.col(n), table, severity="error" if n == "car_run" else "warn")))
    parts = F.col("car_buy") + F.col("car_run")
    found.append(F.when(F.abs(F.col("car_total") - parts) > tolerance, _found("cmm_001_closure", F.col("car_total"), parts)))
    return _exploded(both, found)
