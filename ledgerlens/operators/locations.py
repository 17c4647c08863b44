"""Where findings point to: tables, rows and pages by rule, and places of texts in pages.

findings(doc_id, id, rule, message, evidence, page, pages array<int>, evidence_pages
array<int>, location map<string,string>, refs array of REF): what a rule leaves out is
filled in from a dimension of rules, and from what the message says of each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as X

REF = "struct<role:string,table:string,row:string,field:string,page:int,value:double>"
#: place of a text that is not found
NOWHERE = 10**9

_T = {t: names[0] for t, names in D.FINAL_TABLES.items()}
#: fixed values: short names of tables
SHORT_NAMES = {"总表": _T["T1"], "收入表": _T["T2"], "支出表": _T["T3"], "财政拨款总表": _T["T4"], "一般公共支出表": _T["T5"], "基本支出表": _T["T6"], "三公经费表": _T["T7"]}
#: fixed values: rule, table, row, field, references (role, table, row, field)
RULES = (
    ("V33-200", None, None, "本年收入合计", (("T1", _T["T1"], "本年收入合计", "本年收入合计"), ("T2", _T["T2"], "合计", "本年收入合计"))),
    ("V33-201", None, None, "本年支出合计", (("T1", _T["T1"], "本年支出合计", "本年支出合计"), ("T3", _T["T3"], "合计", "合计"))),
    ("V33-202", None, None, "一般公共预算支出", (("T4", _T["T4"], "本年支出合计", "一般公共预算支出"), ("T5", _T["T5"], "合计", "合计"))),
    ("V33-203", None, None, "基本支出", (("T5", _T["T5"], "合计", "基本支出"), ("T6", _T["T6"], "基本支出合计", "基本支出合计"))),
    ("V33-204", None, None, "财政拨款收入", (("T2", _T["T2"], "合计", "财政拨款收入"), ("T4", _T["T4"], "本年收入合计", "本年收入合计"))),
    ("V33-210", _T["T2"], None, "行内合计", ()),
    ("V33-211", _T["T3"], None, "合计", ()),
    ("V33-214", _T["T1"], "总计", "收入侧总计 / 支出侧总计", (("收入侧", _T["T1"], "总计", "收入侧总计"), ("支出侧", _T["T1"], "总计", "支出侧总计"))),
    ("V33-242", _T["T4"], None, None, ()),
    ("V33-243", _T["T6"], None, None, ()),
    ("V33-244", _T["T7"], None, None, ()),
)
#: fixed values: names by the place of an item in the table on the three public expenses
ITEMS = {"0": "合计", "1": "因公出国", "2": "公务用车", "5": "公务接待"}


def rule_dimension(spark: SparkSession) -> DataFrame:
    rows = [(r, t, row, f, [(*ref, None, None) for ref in refs]) for r, t, row, f, refs in RULES]
    return spark.createDataFrame(rows, f"rule string, spec_table string, spec_row string, spec_field string, spec_refs array<{REF}>")


def table_name(token: Column) -> Column:
    """The full name behind a code or a short name; others stand."""
    out = F.trim(F.coalesce(token, F.lit("")))
    for short, name in {**_T, **SHORT_NAMES}.items():
        out = F.when(F.trim(token) == short, F.lit(name)).otherwise(out)
    return out


def role_values(text: Column) -> Column:
    """(role, value) pairs such as T1=100.00 in a message, in order."""
    pattern = r"(T\d+|BUD_T\d+|说明\d+)\s*=\s*(-?\d[\d,]*(?:\.\d+)?)"
    get = lambda k: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(k))
    return F.zip_with(get(1), get(2), lambda r, v: F.struct(r.alias("role"), F.replace(v, F.lit(","), F.lit("")).try_cast("double").alias("value")))


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _details(rule: Column, loc, message: Column, evidence: Column) -> dict[str, Column]:
    """row, col, field and code with what single rules say of them."""
    row, col, field, code = (_blank(loc(n)) for n in ("row", "col", "field", "code"))
    field, row = F.coalesce(field, F.col("spec_field")), F.coalesce(row, F.col("spec_row"))
    number = F.nullif(F.regexp_extract(evidence, r"第(\d+)行", 1), F.lit(""))
    row = F.when(row.isNull() & rule.isin("V33-210", "V33-211") & number.isNotNull(), F.concat(F.lit("第"), number, F.lit("行"))).otherwise(row)
    t4, t6, t7 = rule == "V33-242", rule == "V33-243", rule == "V33-244"
    col = F.when(t4, F.coalesce(col, _blank(F.regexp_extract(evidence, r"列[:：]([^\n]+)", 1)))).otherwise(col)
    total = message.contains("收支总计不平衡")
    row = F.when(t4 & field.isNull() & total, F.coalesce(row, F.lit("总计"))).otherwise(row)
    said = F.when(total, "收入侧总计 / 支出侧总计").when(message.contains("收入侧"), "收入侧合计").when(message.contains("支出侧"), "支出侧合计").when(message.contains("年末结转"), "年末结转")
    field = F.when(t4, F.coalesce(field, said)).otherwise(field)
    code = F.when(t6, F.coalesce(code, _blank(F.regexp_extract(evidence, r"科目[:：]\s*(\d{3,7})", 1)))).otherwise(code)
    row = F.when(t6, F.coalesce(row, code)).otherwise(row)
    field = F.when(t6 & code.isNotNull(), F.coalesce(field, F.lit("一级科目汇总"))).otherwise(field)
    kind = F.coalesce(_blank(loc("type")), F.lit(""))
    basic = message.contains("基本支出总结不平") | evidence.contains("基本支出合计")
    names = lambda a, b, c: F.when(kind == "personnel", a).when(kind == "public", b).when(basic, c)
    row = F.when(t6, F.coalesce(row, names("人员经费合计", "公用经费合计", "基本支出合计"))).otherwise(row)
    field = F.when(t6, F.coalesce(field, names("人员经费", "公用经费", "基本支出合计"))).otherwise(field)
    item = F.lit(None).cast("string")
    for k, name in ITEMS.items():
        item = F.when(F.trim(loc("index")) == k, F.lit(name)).otherwise(item)
    field = F.when(t7, F.coalesce(field, _blank(loc("item")), item)).otherwise(field)
    col = F.when(t7, F.coalesce(col, F.when(kind == "budget", "预算").when(kind == "final", "决算"))).otherwise(col)
    return {"row": row, "col": col, "field": field, "code": code}


def normalized(findings: DataFrame, anchors: DataFrame) -> DataFrame:
    """findings with table, row, col, field, code, refs, page and pages in one form.

    anchors(doc_id, table, page): where tables stand; a document has few.  A finding's own
    references stand; else its rule's are taken, with the values that the message (else
    the evidence) gives them; else one of its own table.  pages: its own, then those of
    references and evidence, each once and in this order.
    """
    first = anchors.groupBy("doc_id", "table").agg(F.min("page").alias("page"))
    at = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("table", "page"))).alias("at"))
    rows = findings.join(F.broadcast(rule_dimension(findings.sparkSession)), "rule", "left").join(at, "doc_id", "left")
    loc = lambda n: F.try_element_at("location", F.lit(n))
    message, evidence = F.coalesce("message", F.lit("")), F.coalesce("evidence", F.lit(""))
    parts = _details(F.col("rule"), loc, message, evidence)
    rows = rows.select("*", *[c.alias(f"l_{n}") for n, c in parts.items()], F.coalesce(_blank(loc("table")), F.col("spec_table")).alias("l_table"), F.when(F.size(role_values(message)) > 0, role_values(message)).otherwise(role_values(evidence)).alias("said"))
    page_at = lambda t: F.try_element_at("at", t)
    last = lambda role: F.element_at(F.concat(F.array(F.lit(None).cast("struct<role:string,value:double>")), F.filter("said", lambda s: s["role"] == role)), -1)["value"]
    ref = lambda role, table, row, field, value: F.struct(role.alias("role"), table.alias("table"), row.alias("row"), field.alias("field"), page_at(table).cast("int").alias("page"), value.alias("value"))
    of_rule = F.transform("spec_refs", lambda r: ref(r["role"], r["table"], r["row"], r["field"], last(r["role"])))
    own = F.array(ref(F.lit(None).cast("string"), table_name(F.col("l_table")), F.col("l_row"), F.col("l_field"), F.lit(None).cast("double")))
    none = F.array().cast(f"array<{REF}>")
    refs = F.when(F.size(F.coalesce("refs", none)) > 0, F.col("refs")).when(F.size("spec_refs") > 0, of_rule).when(F.col("l_table").isNotNull(), own).otherwise(none)
    rows = rows.withColumn("refs", refs.cast(f"array<{REF}>"))
    ints = F.array().cast("array<int>")
    every = F.concat(F.array("page"), F.coalesce("pages", ints), F.coalesce(F.col("refs.page"), ints), F.coalesce("evidence_pages", ints))
    pages = F.array_distinct(F.filter(every, lambda p: p > 0))
    tables = F.array_join(F.array_distinct(F.filter(F.col("refs.table"), lambda t: F.trim(t) != "")), " / ")
    return rows.select(
        "doc_id", "id", "rule", F.coalesce("l_table", _blank(tables)).alias("table"), *[F.col(f"l_{n}").alias(n) for n in parts], "refs", F.get(pages, F.lit(0)).alias("page"), F.when(F.size(pages) > 1, pages).alias("pages")
    )


# ------------------------------------------------------------ places of texts


def place_of(hay: Column, clip: Column, fallback: Column, proportional: bool = False) -> Column:
    """Where a text stands in a page, from 0: the clip or else the fallback as it is (its first
    50 characters), the clip without punctuation, or the longest of its thirds (first 30
    characters); NOWHERE if none does.  A place without punctuation is mapped back to the
    character that stands there, or (proportional) to the same share of the page."""
    hay = F.coalesce(hay, F.lit(""))
    line = lambda c: F.replace(F.trim(F.translate(F.coalesce(c, F.lit("")), "\t\r", "  ")), F.lit("\n"), F.lit(""))

    def found(text: Column, part: Column) -> Column:
        k = F.call_function("locate", part, text)
        return F.when(k > 0, k - 1)

    exact = [F.when(F.length(line(c)) >= 8, found(hay, F.substring(line(c), 1, 50))) for c in (clip, fallback)]
    plain = X.without_punctuation(hay)
    k = F.when(F.length(clip) >= 8, found(plain, X.without_punctuation(F.substring(clip, 1, 50))))
    if proportional:
        mapped = F.when(F.length(plain) == 0, F.lit(0)).otherwise(F.floor(k / F.length(plain) * F.length(hay)))
    else:
        kept = F.filter(F.sequence(F.lit(0), F.length(hay) - 1), lambda i: X.without_punctuation(F.substring(hay, i + 1, F.lit(1))) != "")
        mapped = F.get(kept, k)
    third = F.floor(F.length(clip) / 3).cast("int")
    parts = [F.trim(F.substring(clip, third * i + 1, third if i < 2 else F.length(clip))) for i in range(3)]
    tries = F.array(*[F.when(F.length(p) >= 8, F.struct(F.length(p).alias("n"), F.lit(-i).alias("i"), found(hay, F.substring(p, 1, 30)).alias("at"))) for i, p in enumerate(parts)])
    best = F.array_max(F.filter(tries, lambda s: s["at"].isNotNull()))
    segment = F.when((F.length(clip) > 50) & (best["n"] / F.length(clip) > 0.3), best["at"])
    return F.coalesce(*exact, F.when(k.isNotNull(), mapped), segment, F.lit(NOWHERE)).cast("int")


def text_places(needles: DataFrame, pages: DataFrame, proportional: bool = False) -> DataFrame:
    """needles(doc_id, id, page, clip, fallback) -> doc_id, id, page, pos."""
    both = needles.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left")
    return both.select("doc_id", "id", "page", F.when(F.col("text").isNull(), F.lit(NOWHERE)).otherwise(place_of(F.col("text"), F.col("clip"), F.col("fallback"), proportional)).alias("pos"))
