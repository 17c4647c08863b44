"""Text rules over pages(doc_id, page, text): one finding per hit.

Every rule is a table of (name, pattern, severity, message) that is applied to
lines, pages or compacted pages in one pass; nothing is collected.  Findings are
(doc_id, rule, severity, page, pos, message, evidence); pos counts from 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

FINDING = ("doc_id", "rule", "severity", "page", "pos", "message", "evidence")


@dataclass(frozen=True)
class Pattern:
    regex: str
    message: str
    severity: str = "warn"


#: fixed values: texts that were never filled in (final reports)
PLACEHOLDERS = tuple(Pattern(p, "placeholder") for p in (r"(?i)\bxxx\b", r"(?i)XX", "待填写", "请填写", r"\(待\)", r"\(略\)", r"\[待\]", r"\[略\]"))
#: fixed values: repeated punctuation, and two different marks in a row
PUNCTUATION = (Pattern(r"([，。！？；：])\1+", "repeated punctuation"), Pattern(r"([，。！？；：])\s*(?!\1)[，。！？；：]", "mixed punctuation"))
#: fixed values: doubled words, and a Western comma between Chinese text and an amount
DOUBLED = (
    Pattern("预算预算", "doubled word"),
    Pattern("决算决算", "doubled word"),
    Pattern("财政拨款财政拨款", "doubled word"),
    Pattern(r"[一-鿿],\s*[0-9]", "western comma before an amount", "info"),
)
ODD_WORDING = (Pattern("(?:增加|减少)持平", "increase or decrease of nothing"),)
LONG_PERCENT = (Pattern(r"\d+\.\d{3,}\s*%", "percentage with more than two decimals", "info"),)
#: fixed values: an item of 0 with its increase; an item's amount with the direction of its change; the summary's direction
ZERO_ITEM = r"([一-龥]{0,24}?拨款支出预算)0(?:\.0+)?万元，比20\d{2}年预算增加([0-9][0-9,]*\.?[0-9]*)万元"
INCOME_CHANGE = r"收入预算[0-9][0-9,]*\.?[0-9]*万元[^。；]{0,120}?比20\d{2}年预算(增加|减少)([0-9][0-9,]*\.?[0-9]*)万元"
EXPENSE_CHANGE = r"支出预算[0-9][0-9,]*\.?[0-9]*万元[^。；]{0,120}?比20\d{2}年预算(增加|减少)([0-9][0-9,]*\.?[0-9]*)万元"
SUMMARY_CHANGE = "财政拨款收入支出(增加|减少)"
ZERO_TOTAL = (Pattern(r"(?:总计|合计|总额)[^0-9。；]{0,10}0(?:\.0+)?万元", "a total of zero"),)


def lines(pages: DataFrame, most_pages: int | None = None, most_lines: int | None = None) -> DataFrame:
    """(doc_id, page, line_no, at, line): lines of pages with their place in the page."""
    if most_pages:
        pages = pages.where(F.col("page") <= most_pages)
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    if most_lines:
        parts = F.slice(parts, 1, most_lines)
    return pages.select("doc_id", "page", F.posexplode(parts).alias("line_no", "line"))


def _located(matches: Column, pieces: Column, k: int, p: Pattern):
    """The n-th match as a finding's struct, with its place."""

    def place(i: Column) -> Column:
        before = F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x))
        return F.aggregate(F.slice(matches, F.lit(1), i), before, lambda a, x: a + F.length(x))

    return lambda m, i: F.struct(F.lit(k).alias("ord"), place(i).alias("pos"), m.alias("hit"), F.lit(p.severity).alias("severity"), F.lit(p.message).alias("message"))


def hits(rows: DataFrame, unit: str, patterns: Sequence[Pattern], rule: str, before: int = 20, after: int = 20, per_page: int | None = None) -> DataFrame:
    """Findings of all patterns in the text column `unit` of rows(doc_id, page, ...).

    A hit's place is found by walking the pieces between hits: the n-th hit starts
    after the first n pieces and n-1 hits before it.
    """
    found = []
    text = F.col(unit)
    for k, p in enumerate(patterns):
        matches = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
        pieces = F.split(text, p.regex, -1)
        one = F.transform(matches, _located(matches, pieces, k, p))
        found.append(F.when(F.size(matches) > 0, one).otherwise(F.array().cast("array<struct<ord:int,pos:int,hit:string,severity:string,message:string>>")))
    exploded = rows.select("doc_id", "page", *([c for c in ("line_no",) if c in rows.columns]), text.alias("__t"), F.explode(F.concat(*found)).alias("h"))
    out = exploded.select(
        "doc_id", F.lit(rule).alias("rule"), F.col("h.severity").alias("severity"), "page", F.col("h.pos").alias("pos"), F.concat(F.col("h.message"), F.lit(": "), F.col("h.hit")).alias("message"),
        X.snippet(F.col("__t"), F.col("h.pos"), F.col("h.pos") + F.length("h.hit"), before, after).alias("evidence"), F.col("h.ord").alias("__ord"), *([F.col("line_no").alias("__line")] if "line_no" in rows.columns else [F.lit(0).alias("__line")]),
    )
    if per_page:
        first = Window.partitionBy("doc_id", "page").orderBy("__ord", "__line", "pos")
        out = out.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= per_page)
    return out.select(*FINDING)


def placeholder_findings(pages: DataFrame, patterns: Sequence[Pattern] = PLACEHOLDERS, rule: str = "placeholder", per_page: int | None = None) -> DataFrame:
    rows = lines(pages)
    rows = rows.where((F.trim("line") != "") & ~F.regexp_replace(F.trim("line"), "[,.]", "").rlike("^[0-9]*$"))
    return hits(rows, "line", patterns, rule, per_page=per_page)


def punctuation_findings(pages: DataFrame) -> DataFrame:
    return hits(lines(pages).where(F.trim("line") != ""), "line", PUNCTUATION, "punctuation")


def page_findings(pages: DataFrame, patterns: Sequence[Pattern], rule: str, compacted: bool = False) -> DataFrame:
    rows = pages.select("doc_id", "page", (X.compact(F.col("text")) if compacted else F.coalesce("text", F.lit(""))).alias("t"))
    return hits(rows, "t", patterns, rule, 16, 24)


def zero_increase_findings(pages: DataFrame) -> DataFrame:
    """An item of 0 that is said to have grown."""
    flat = pages.select("doc_id", "page", X.compact(F.col("text")).alias("t"))
    both = F.arrays_zip(F.regexp_extract_all("t", F.lit(ZERO_ITEM), F.lit(1)).alias("item"), F.regexp_extract_all("t", F.lit(ZERO_ITEM), F.lit(2)).alias("amount"), F.regexp_extract_all("t", F.lit(ZERO_ITEM), F.lit(0)).alias("hit"))
    rows = flat.select("doc_id", "page", "t", F.explode(both).alias("z")).where(N.parse_plain(F.col("z.amount")) > 0)
    return rows.select("doc_id", F.lit("zero_increase").alias("rule"), F.lit("error").alias("severity"), "page", (F.locate("拨款支出预算0", F.col("t")) - 1).alias("pos"), F.concat(F.col("z.item"), F.lit(" is 0 but grew by "), F.col("z.amount")).alias("message"), F.col("z.hit").alias("evidence"))


def direction_findings(pages: DataFrame) -> DataFrame:
    """Income and expenditure of one page that are said to move in opposite
    directions, and a summary that fits neither."""
    flat = pages.select("doc_id", "page", X.compact(F.col("text")).alias("t"))
    get = lambda pattern, k: F.nullif(F.regexp_extract("t", pattern, k), F.lit(""))
    rows = flat.select("*", get(INCOME_CHANGE, 1).alias("i"), get(INCOME_CHANGE, 2).alias("ia"), get(EXPENSE_CHANGE, 1).alias("e"), get(EXPENSE_CHANGE, 2).alias("ea"), F.nullif(F.regexp_extract("t", SUMMARY_CHANGE, 1), F.lit("")).alias("s"))
    opposite = F.col("i") != F.col("e")
    grave = N.close(N.parse_plain(F.col("ia")), N.parse_plain(F.col("ea")), 0.01)
    summary = F.col("s").isNotNull() & F.col("i").isNotNull() & F.col("e").isNotNull() & ((F.col("s") != F.col("i")) | (F.col("s") != F.col("e")))
    one = lambda ok, sev, msg: F.when(ok, F.struct(sev.alias("severity"), F.lit(msg).alias("message")))
    found = F.array_compact(F.array(one(opposite, F.when(grave, "error").otherwise("warn"), "income and expenditure move in opposite directions"), one(summary, F.lit("warn"), "the summary's direction fits neither")))
    return rows.select("doc_id", "page", "t", F.explode(found).alias("f")).select("doc_id", F.lit("direction").alias("rule"), F.col("f.severity").alias("severity"), "page", F.lit(0).alias("pos"), F.col("f.message").alias("message"), F.substring("t", 1, 80).alias("evidence"))


def report_year(pages: DataFrame, docs: DataFrame, keywords: Sequence[str], titles: Sequence[str] = ()) -> DataFrame:
    """docs(doc_id, path) x pages -> doc_id, year: the year of most weight, of
    equals the later one.  Weights: 6 for years in the path and 7 for short ones;
    a line's year 1, plus 1 on page 1, 2 with a keyword, 2 with a table title."""
    path = docs.select("doc_id", F.explode(F.transform(X.years(F.col("path")), lambda y: F.struct(y.alias("y"), F.lit(6).alias("w")))).alias("v"))
    short = docs.select("doc_id", F.explode(F.transform(X.short_years(F.col("path")), lambda y: F.struct(y.alias("y"), F.lit(7).alias("w")))).alias("v"))
    weight = F.lit(1) + F.when(F.col("page") == 1, 1).otherwise(0) + F.when(X.contains_any(F.col("line"), tuple(keywords)), 2).otherwise(0) + (F.when(X.contains_any(F.col("line"), tuple(titles)), 2).otherwise(0) if titles else F.lit(0))
    body = lines(pages, 6, 40).where(F.trim("line") != "").select("doc_id", F.explode(X.years(F.col("line"))).alias("y"), weight.alias("w")).select("doc_id", F.struct("y", "w").alias("v"))
    votes = path.unionByName(short).unionByName(body).groupBy("doc_id", "v.y").agg(F.sum("v.w").alias("w"))
    return votes.groupBy("doc_id").agg(F.max_by("y", F.struct("w", "y")).alias("year"))


def year_findings(pages: DataFrame, years: DataFrame, titles: Sequence[str], keywords: Sequence[str], whitelist: Sequence[str] = ()) -> DataFrame:
    """Per page the first title of another year; else the first line with a
    keyword whose year is neither the report's nor the one before."""
    rows = lines(pages).where(F.trim("line") != "").join(years, "doc_id")
    found = F.array_sort(F.array_distinct(X.years(F.col("line"))))
    wrong_title = F.when(X.contains_any(F.col("line"), tuple(titles)), F.get(F.filter(found, lambda y: y != F.col("year")), F.lit(0)))
    target = X.contains_any(F.col("line"), tuple(keywords)) & (~X.contains_any(F.col("line"), tuple(whitelist)) if whitelist else F.lit(True))
    wrong_line = F.when(target, F.get(F.filter(found, lambda y: (y != F.col("year")) & (y != F.col("year") - 1)), F.lit(0)))
    rows = rows.withColumn("kind", F.when(wrong_title.isNotNull(), 0).when(wrong_line.isNotNull(), 1)).withColumn("bad", F.coalesce(wrong_title, wrong_line)).where("kind IS NOT NULL")
    first = rows.groupBy("doc_id", "page", "year").agg(F.min_by(F.struct("kind", "bad", "line"), F.struct("kind", "line_no")).alias("f"))
    return first.select("doc_id", F.lit("year").alias("rule"), F.lit("warn").alias("severity"), "page", F.lit(0).alias("pos"), F.concat(F.when(F.col("f.kind") == 0, "title of year ").otherwise("text of year "), F.col("f.bad").cast("string"), F.lit(" in a report of "), F.col("year").cast("string")).alias("message"), F.col("f.line").alias("evidence"))


def percent_findings(pages: DataFrame) -> DataFrame:
    """Percentages below 0 or above 100."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)\s*%"), F.lit(1))
    rows = pages.select("doc_id", "page", "text", F.explode(found).alias("p")).where((F.col("p").try_cast("double") < 0) | (F.col("p").try_cast("double") > 100))
    return rows.select("doc_id", F.lit("percent_range").alias("rule"), F.lit("warn").alias("severity"), "page", (F.instr("text", F.col("p")) - 1).alias("pos"), F.concat(F.col("p"), F.lit("% is out of range")).alias("message"), F.col("p").alias("evidence"))


def unit_findings(pages: DataFrame, first_pages: int = 3) -> DataFrame:
    """Documents whose pages name no money unit, or more than one; the dominant
    unit is the most frequent one, of equals the first seen."""
    unit = X.money_unit(F.col("text"))
    by = pages.select("doc_id", "page", unit.alias("unit")).groupBy("doc_id").agg(F.collect_set("unit").alias("units"), F.count(F.when(F.col("page") <= first_pages, F.col("unit"))).alias("early"))
    message = F.when(F.size("units") == 0, "no money unit").when(F.size("units") > 1, F.concat(F.lit("mixed units: "), F.array_join(F.array_sort("units"), ", ")))
    return by.select("doc_id", F.lit("unit").alias("rule"), F.lit("info").alias("severity"), F.lit(1).alias("page"), F.lit(0).alias("pos"), message.alias("message"), F.lit("").alias("evidence")).where("message IS NOT NULL")


def dominant(values: DataFrame, key: str, value: str, ord_col: str) -> DataFrame:
    """(key, value): the most frequent value, of equals the first seen."""
    counts = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(ord_col).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def page_of_text(needles: DataFrame, pages: DataFrame, head: int = 40) -> DataFrame:
    """needles(doc_id, id, needle) -> the first page that has the text, white space
    and punctuation aside, or at least its first characters."""
    p = pages.select("doc_id", "page", X.without_punctuation(F.col("text")).alias("t"))
    n = needles.select("doc_id", "id", X.without_punctuation(F.col("needle")).alias("needle")).where("needle <> ''")
    both = n.join(p, "doc_id")
    whole, start = F.col("t").contains(F.col("needle")), F.col("t").contains(F.substring("needle", 1, head))
    return both.groupBy("doc_id", "id").agg(F.coalesce(F.min(F.when(whole, F.col("page"))), F.min(F.when(start, F.col("page")))).alias("page"))
