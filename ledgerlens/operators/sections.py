"""Sections of documents: where their headings stand and what text they hold.

pages(doc_id, page, text) count as one text per document, pages joined by a line
feed.  A running length over the pages places every page in it; headings are found page by
page, so no document has to be put together to find them.  Of repeated pages every row counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """Starts at the first hit of `start`, ends before the next hit of `end`, or with the text."""

    name: str
    start: str
    end: str


#: fixed values: headings of the section on expenditure against its budget
EXPENDITURE = Section(
    "general_expenditure",
    r"(?m)^\s*(?:（三）|三、)\s*一般公共预算财政拨款支出决算(?:具体)?情况",
    r"(?m)^\s*(?:（四）|四、|（六）|六、|一般公共预算财政拨款基本支出决算情况说明)",
)


def placed(pages: DataFrame) -> DataFrame:
    """pages plus start: the place (from 0) at which a page begins in its document's text."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    return pages.select("doc_id", "page", text.alias("text")).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def hit_places(text: Column, pattern: str, after: bool = False) -> Column:
    """Where the hits of a pattern begin in a text (end, if `after`), from 0."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(hits, lambda _, k: total(F.slice(gaps, F.lit(1), k + 1)) + total(F.slice(hits, F.lit(1), k + int(after))))


def headings(at: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """placed pages -> doc_id, section, kind (`start` or `end`), pos of every hit."""

    def mark(name: str, kind: str):
        return lambda p: F.struct(F.lit(name).alias("section"), F.lit(kind).alias("kind"), (F.col("start") + p).alias("pos"))

    found = []
    for s in sections:
        for kind, pattern in (("start", s.start), ("end", s.end)):
            one = F.transform(hit_places(F.col("text"), pattern), mark(s.name, kind))
            found.append(F.when(F.col("text").rlike(pattern), one).otherwise(F.array().cast("array<struct<section:string,kind:string,pos:bigint>>")))
    return at.select("doc_id", F.inline(F.concat(*found)))


def intervals(at: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """doc_id, section, start, end of the sections that a document has (end excluded)."""
    first = Window.partitionBy("doc_id", "section")
    marks = headings(at, sections).withColumn("from", F.min(F.when(F.col("kind") == "start", F.col("pos"))).over(first))
    ends = marks.where("from IS NOT NULL").groupBy("doc_id", "section").agg(F.first("from").alias("start"), F.min(F.when((F.col("kind") == "end") & (F.col("pos") >= F.col("from")), F.col("pos"))).alias("end"))
    return ends.select("doc_id", "section", "start", F.coalesce("end", F.lit((1 << 62))).alias("end"))


def texts(at: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, section, start, text: what the pages hold of each interval."""
    both = at.withColumnRenamed("start", "page_start").join(found, "doc_id")
    both = both.where((F.col("end") > F.col("page_start")) & (F.col("start") <= F.col("page_start") + F.length("text")))
    head = F.greatest(F.col("start") - F.col("page_start"), F.lit(0)).cast("int")
    tail = F.least(F.col("end") - F.col("page_start"), F.length("text").cast("long")).cast("int")
    part = F.struct("page", "page_start", F.substring(F.col("text"), head + 1, tail - head).alias("text"))
    parts = both.select("doc_id", "section", "start", part.alias("p")).groupBy("doc_id", "section").agg(F.min("start").alias("start"), F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("doc_id", "section", "start", F.array_join(F.col("p.text"), "\n").alias("text"))


def full_texts(pages: DataFrame) -> DataFrame:
    """doc_id, text: a document's pages in order, joined by line feeds."""
    parts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.col("p.text"), "\n").alias("text"))


def of_span(spans: DataFrame, at: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """spans(doc_id, pos, ...) plus `open`: the sections whose heading was the last to stand
    before (or at) the span and that have not ended since, by an ordered carry."""
    marks = headings(at, sections)
    names = [s.name for s in sections]
    keep = [c for c in spans.columns if c not in ("doc_id", "pos")]
    rows = spans.select("doc_id", "pos", F.struct(*keep).alias("own") if keep else F.struct(F.lit(1).alias("_")).alias("own"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("kind"), F.lit(1).alias("last"))
    both = rows.unionByName(marks.select("doc_id", "pos", F.lit(None).cast(rows.schema["own"].dataType).alias("own"), "section", "kind", F.lit(0).alias("last")))
    order = Window.partitionBy("doc_id").orderBy("pos", "last").rowsBetween(Window.unboundedPreceding, 0)
    state = [F.last(F.when(F.col("section") == n, F.col("kind")), ignorenulls=True).over(order) for n in names]
    both = both.withColumn("open", F.array_compact(F.array(*[F.when(k == "start", F.lit(n)) for n, k in zip(names, state, strict=True)])))
    return both.where("last = 1").select("doc_id", "pos", *[F.col("own")[c].alias(c) for c in keep], "open")


def page_of(spans: DataFrame, at: DataFrame) -> DataFrame:
    """spans(doc_id, pos, ...) plus page and page_pos, by an ordered carry of the pages' starts."""
    keep = [c for c in spans.columns if c not in ("doc_id", "pos")]
    own = F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))
    rows = spans.select("doc_id", "pos", own.alias("own"), F.lit(None).cast("struct<page:int,start:bigint>").alias("at"), F.lit(1).alias("last"))
    starts = at.select("doc_id", F.col("start").alias("pos"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"), F.struct(F.col("page").cast("int").alias("page"), "start").alias("at"), F.lit(0).alias("last"))
    order = Window.partitionBy("doc_id").orderBy("pos", "last").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(starts).withColumn("at", F.last("at", ignorenulls=True).over(order)).where("last = 1")
    return both.select("doc_id", "pos", *[F.col("own")[c].alias(c) for c in keep], F.col("at.page").alias("page"), (F.col("pos") - F.col("at.start")).cast("int").alias("page_pos"))


# -------------------------------------------------- expenditure against its budget

#: fixed values: sentences of that section, on one item and on the whole
_BUDGET = (r"年初预算为\s*([\d,]+\.\d{2})\s*万元", r"(?s)年.*?初.*?预.*?算.*?为.*?([\d,]+\.\d{2}).*?万.*?元")
_FINAL = (r"支出决算为\s*([\d,]+\.\d{2})\s*万元", r"(?s)支.*?出.*?决.*?算.*?为.*?([\d,]+\.\d{2}).*?万.*?元")
_WHOLE = r"(?s)一般公共预算财政拨款支出年初预算为\s*([\d,]+\.\d{2})\s*万元.*?支.*?出决算为\s*([\d,]+\.\d{2})\s*万元.*?完成年初预算"
_ITEM = r"\n\s*\d+、"
_COMPARED = "大于|小于|等于|持平|基本持平"
_RELATION = (rf"(?s)决.*?算.*?数.*?({_COMPARED}).*?预算.*?数", r"(?s)决.*?算.*?数.*?与.*?预算.*?数.*?(基本)?.*?持平", rf"(?s)预算.*?数.*?({_COMPARED}).*?决.*?算.*?数", r"(?s)预算.*?数.*?与.*?决.*?算.*?数.*?(基本)?.*?持平")
#: characters of the sentence on the whole in which its comparison is looked for
_REACH = 500


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def relation(text: Column) -> Column:
    """-1, 0 or 1 as the text says that the final amount is below, at or above the budget; NULL
    where it says nothing (also: a bare 与…持平 without 基本)."""
    one, two, three, four = _RELATION
    said = F.when(text.rlike(one), F.regexp_extract(text, one, 1)).when(text.rlike(two), F.regexp_extract(text, two, 1)).when(text.rlike(three), F.regexp_extract(text, three, 1)).when(text.rlike(four), F.regexp_extract(text, four, 1))
    return F.when(said.contains("持平") | said.contains("基本") | (said == "等于"), 0).when(said == "大于", 1).when(said == "小于", -1)


def expenditure_findings(pages: DataFrame) -> DataFrame:
    """Items of the section on expenditure (and its sentence on the whole) whose comparison in
    words is not that of their two amounts: doc_id, rule, severity, lhs (final), rhs
    (budget), message, page, pos."""
    # documents without the section's heading are not put in order
    headed = pages.where(F.col("text").rlike(EXPENDITURE.start)).select("doc_id").distinct()
    at = placed(pages.join(headed, "doc_id", "left_semi"))
    text = texts(at, intervals(at, (EXPENDITURE,))).select("doc_id", F.col("start").alias("section_start"), "text")
    amount = lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    whole = F.regexp_extract("text", _WHOLE, 0)
    begin = F.instr("text", whole)
    summary = text.where(F.col("text").rlike(_WHOLE)).select(
        "doc_id", (F.col("section_start") + begin - 1).alias("pos"), F.regexp_extract("text", _WHOLE, 1).alias("budget"), F.regexp_extract("text", _WHOLE, 2).alias("final"), relation(F.substring(F.col("text"), begin, F.lit(_REACH))).alias("said"), F.substring(F.col("text"), begin, F.lit(100)).alias("message")
    )
    items = F.split("text", _ITEM, -1)
    marks = F.concat(F.array(F.lit(0)), hit_places(F.col("text"), _ITEM, after=True))
    each = text.select("doc_id", "section_start", marks.alias("marks"), F.posexplode(items).alias("k", "item")).where(F.trim(F.translate("item", "\n\t\r", "   ")) != "")
    each = each.select("doc_id", (F.col("section_start") + F.get("marks", F.col("k"))).alias("pos"), _first(F.col("item"), _BUDGET).alias("budget"), _first(F.col("item"), _FINAL).alias("final"), relation(F.col("item")).alias("said"), F.substring(F.trim(F.translate("item", "\n\t\r", "   ")), 1, 100).alias("message"))
    both = summary.unionByName(each).withColumn("b", amount(F.col("budget"))).withColumn("f", amount(F.col("final")))
    bad = both.where(F.col("said") != F.signum(F.col("f") - F.col("b")))
    out = page_of(bad.select("doc_id", "pos", F.col("f").alias("lhs"), F.col("b").alias("rhs"), "message"), at)
    return out.select("doc_id", F.lit("v33_110").alias("rule"), F.lit("error").alias("severity"), "lhs", "rhs", "message", "page", F.col("page_pos").alias("pos"))
