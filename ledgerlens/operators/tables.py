"""Grids of cells: recognition of tables and measures, headers, quality, boxes.

cells(<key>, row_idx, col_idx, raw_text) is the long form of every grid.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .boxes import suppressed


def cells_of(df: DataFrame, keys: tuple[str, ...], row: Column, columns: dict[int, Column]) -> DataFrame:
    """A wide table's columns as cells."""
    cells = F.array(*[F.struct(F.lit(k).alias("col_idx"), c.cast("string").alias("raw_text")) for k, c in columns.items()])
    return df.select(*keys, row.alias("row_idx"), F.explode(cells).alias("c")).select(*keys, "row_idx", "c.col_idx", "c.raw_text")


def quality(cells: DataFrame, key: str) -> DataFrame:
    """Rows, filled cells, a score of density, and whether it is a table at all."""
    full = F.coalesce(F.trim("raw_text"), F.lit("")) != ""
    n, filled = F.count(F.lit(1)), F.count_if(full)
    numeric = F.count_if(F.trim("raw_text").rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?%?$"))
    rows, width = F.countDistinct("row_idx"), F.max("col_idx")
    score = F.least(F.lit(1.0), filled / n) * 0.4 + numeric / F.greatest(F.lit(1), filled) * 0.35 + F.least(F.lit(1.0), width / 6.0) * 0.25
    meaningful = (rows >= 2) & (width >= 2) & (filled >= F.greatest(F.lit(4), rows))
    return cells.groupBy(key).agg(rows.alias("n_rows"), filled.alias("filled"), F.round(score, 6).alias("score"), meaningful.alias("meaningful"))


def best_alias(df: DataFrame, key: str, title: str, aliases: DataFrame) -> DataFrame:
    """aliases(code, alias, ord): for each title the code whose alias it contains,
    by 0.86 plus a bonus for how much of the title the alias covers; the first
    wins ties.  The dictionary is a few hundred rows and goes to every task."""
    hits = df.join(F.broadcast(aliases), F.col(title).contains(F.col("alias")))
    cover = F.length("alias") * 0.16 / F.greatest(F.length(title), F.length("alias"))
    score = F.round(F.least(F.lit(0.12), cover) + 0.86, 6)
    best = hits.groupBy(key).agg(F.max_by(F.struct("code", score.alias("score")), F.struct(score, -F.col("ord"))).alias("b"))
    return best.select(key, "b.code", "b.score")


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its corners in order."""
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    return F.struct(lo(x0, x1).alias("x0"), lo(y0, y1).alias("y0"), hi(x0, x1).alias("x1"), hi(y0, y1).alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def contained(a: Column, b: Column) -> Column:
    """Share of a that lies in b."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def spatial_dedupe(boxes: DataFrame, page: str, priority: str, overlap: float = 0.75, inside: float = 0.9) -> DataFrame:
    """Of overlapping boxes on a page the ones of higher priority stay: greedy, in order of priority,
    against what stays already.  Boxes without an id are numbered; of equals the first number stays."""
    numbered = boxes if "id" in boxes.columns else _numbered(boxes)
    rows = numbered.withColumnRenamed(priority, "priority") if priority != "priority" else numbered
    kept = suppressed(rows.select(page, "id", "box", "priority"), [page], overlap, inside).select(page, "id")
    return numbered.join(kept, [page, "id"], "left_semi").select(*boxes.columns)


def _numbered(boxes: DataFrame) -> DataFrame:
    out = boxes.withColumn("id", F.monotonically_increasing_id())
    return out.checkpoint() if boxes.sparkSession.sparkContext.getCheckpointDir() else out.persist()


# ------------------------------------------------------------------ similarity


def partial_ratio(a: str, b: str) -> float:
    """0..100: how well the shorter text matches its best window of the longer: twice
    the longest common subsequence over both lengths.  Windows hang over the ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0
    if short in long:
        return 100.0
    at: dict[str, int] = {}
    for k, c in enumerate(short):
        at[c] = at.get(c, 0) | 1 << k
    full, best = (1 << n) - 1, 0.0
    for i in range(1 - n, len(long)):
        window = long[max(0, i) : i + n]
        row = full  # a bit for each place of the short text, 0 once it is matched
        for c in window:
            hit = row & at.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        best = max(best, 200.0 * (n - row.bit_count()) / (n + len(window)))
    return best


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each pair of a batch is compared once.  Of a text inside a short one all characters match."""
    from difflib import SequenceMatcher

    def ratio(x: str, y: str) -> float:
        if x and y and len(y) < 200 and (x in y or y in x):
            return 2.0 * min(len(x), len(y)) / (len(x) + len(y))
        return SequenceMatcher(None, x, y).ratio()

    seen, out = {}, []
    for x, y in zip(a, b, strict=True):
        pair = (x or "", y or "")
        if pair not in seen:
            seen[pair] = ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _nearest(texts: pd.Series, words: pd.Series) -> pd.Series:
    """0..1: the best partial ratio of a text with any of the words."""
    return pd.Series([max((partial_ratio(t or "", w) for w in ws), default=0.0) / 100 for t, ws in zip(texts, words, strict=True)])


#: fixed values: weights of alias and headers, floors (least cover, score), and least score of a recognized table
BY_ALIAS, BY_HEADERS, FLOORS, HINTED, RECOGNIZED, MOST = 0.72, 0.28, ((0.85, 0.98), (0.7, 0.93)), 0.92, 0.55, 0.99


def detect_table(titles: DataFrame, key: str, dictionary: list[dict]) -> DataFrame:
    """titles(key, title, hint, headers array) -> key, table_code, score.

    Each title meets each entry of the dictionary.  An entry's score weighs the best
    similarity of its aliases and the share of its required headers; it has floors
    where an alias covers the title or the hint has the code's first two parts.  The
    first entry wins ties.  Containment is decided in columns; only what no alias or
    header contains is measured, once for each distinct text.
    """
    words = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d["code"]).alias("code"), words(X_normal(d["aliases"])).alias("aliases"), words(X_normal(d["required"])).alias("required"), words(d["code"].lower().split("_")[:2]).alias("parts")) for i, d in enumerate(dictionary)])
    plain = titles.select(key, X.normalized(F.col("title")).alias("t"), X.normalized(F.col("hint")).alias("h"), F.filter(F.transform(F.coalesce("headers", F.array().cast("array<string>")), X.normalized), lambda x: x != "").alias("hs"))
    plain = plain.select(key, F.coalesce("t", F.lit("")).alias("t"), F.coalesce("h", F.lit("")).alias("h"), "hs")
    distinct = plain.select("t", "h", "hs").distinct()
    each = distinct.withColumn("e", F.explode(entries)).select("t", "h", "hs", "e.*")
    t, h = F.col("t"), F.col("h")
    covers = F.transform(F.filter("aliases", lambda a: F.contains(t, a) | F.contains(h, a)), lambda a: F.length(a) / F.greatest(F.length(t), F.length(h), F.length(a)))
    missing = F.filter("required", lambda r: ~F.exists("hs", lambda x: F.contains(x, r)))
    each = each.withColumn("cover", F.array_max(covers)).withColumn("missing", missing)
    # a text is measured against an entry's aliases where none of them stands in it
    measured = F.greatest(*[_nearest(F.when(F.col("cover").isNull(), x), F.col("aliases")) for x in (t, h)])
    likeness = F.when(F.col("cover").isNotNull(), F.lit(1.0)).otherwise(measured)
    asked = each.select("t", "h", "hs", "code", F.explode("missing").alias("word"))
    found = asked.withColumn("x", F.explode("hs")).where(_nearest(F.col("x"), F.array("word")) >= 0.82).groupBy("t", "h", "hs", "code").agg(F.count_distinct("word").alias("near"))
    each = each.withColumn("likeness", likeness).join(found, ["t", "h", "hs", "code"], "left")
    share = F.when(F.size("required") > 0, (F.size("required") - F.size("missing") + F.coalesce("near", F.lit(0))) / F.size("required")).otherwise(0.0)
    floor = F.lit(0.0)
    for least, value in reversed(FLOORS):
        floor = F.when(F.col("cover") >= least, value).otherwise(floor)
    floor = F.greatest(floor, F.when(F.forall("parts", lambda p: F.contains(h, p)), HINTED).otherwise(0.0))
    score = F.greatest(F.col("likeness") * BY_ALIAS + share * BY_HEADERS, floor)
    best = each.withColumn("score", score).groupBy("t", "h", "hs").agg(F.max_by(F.struct("code", "score"), F.struct(F.col("score"), -F.col("place"))).alias("b"))
    some = (F.col("b.score") >= RECOGNIZED) & ~F.contains(t, F.lit("编制说明"))  # an explanation is no table
    best = best.select("t", "h", "hs", F.when(some, F.col("b.code")).alias("table_code"), F.when(F.contains(t, F.lit("编制说明")), 0.0).otherwise(F.least(F.col("b.score"), F.lit(MOST))).alias("score"))
    return plain.join(best, ["t", "h", "hs"]).select(key, "table_code", "score")


def X_normal(words) -> list[str]:
    """Normal forms of dictionary words (few, on the driver)."""
    import re
    import unicodedata

    return [re.sub(r"\s+", "", unicodedata.normalize("NFKC", w)).lower() for w in words]


def match_measure(headers: DataFrame, measures: list[tuple[str, str]]) -> DataFrame:
    """headers(..., header) plus measure: the first of the best measure aliases at 78 or more."""
    names = list(zip([m for m, _ in measures], X_normal([a for _, a in measures]), strict=True))

    @F.pandas_udf(T.StringType())
    def pick(h: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            best, found = 0.0, None
            for m, a in names:
                s = max(partial_ratio(x, a), 95.0 if a in x else 0.0)
                if s > best and s >= 78:
                    best, found = s, m
            return found

        return h.map(lambda x: one(x or ""))

    return headers.withColumn("measure", pick(X.normalized(F.col("header"))))


#: fixed values: weights of title, required and optional columns in the older score
OLDER = (0.58, 0.32, 0.10)


def older_score(title: Column, headers: Column, keywords: tuple[str, ...], required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> Column:
    """0..1 for texts in normal form: the best keyword (1 in the title, else the share
    of its characters there), and the shares of columns that some header contains."""
    words = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    chars = lambda k: F.size(F.filter(F.split(k, ""), lambda c: (c != "") & F.contains(title, c))) / F.length(k)
    best = F.array_max(F.transform(words(keywords), lambda k: F.when(F.contains(title, k), 1.0).otherwise(chars(k))))
    share = lambda ws: F.size(F.filter(words(ws), lambda w: F.exists(headers, lambda h: F.contains(h, w)))) / len(ws) if ws else F.lit(0.0)
    parts = (F.coalesce(best, F.lit(0.0)), share(required), share(optional))
    return F.round(sum((p * w for p, w in zip(parts[1:], OLDER[1:], strict=True)), parts[0] * OLDER[0]), 4)


# --------------------------------------------------------------------- headers


def header_rows(cells: DataFrame, key: str, title_words: str, most: int = 4) -> DataFrame:
    """key, header_rows: leading rows (of the first `most`) that have a title word
    or few numbers; at least one."""
    full = F.coalesce(F.trim("raw_text"), F.lit("")) != ""
    numeric = F.trim("raw_text").rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?%?$")
    rows = cells.where(F.col("row_idx") < most).groupBy(key, "row_idx").agg(
        F.bool_or(F.col("raw_text").rlike(title_words)).alias("title"), (F.count_if(numeric) / F.greatest(F.lit(1), F.count_if(full))).alias("share")
    )
    head = F.coalesce("title", F.lit(False)) | (F.col("share") <= 0.45)
    running = F.min(F.when(head, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("row_idx"))
    return rows.withColumn("head", running).groupBy(key).agg(F.greatest(F.lit(1), F.sum("head")).cast("int").alias("header_rows"))


def title_of(cells: DataFrame, key: str) -> DataFrame:
    """key, title: the text of row 0, or of row 1 where row 0 is blank."""
    text = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("row_idx") == r) & (F.trim("raw_text") != ""), F.struct("col_idx", F.trim("raw_text").alias("t"))))), lambda s: s["t"]), "")
    two = cells.where("row_idx < 2").groupBy(key).agg(text(0).alias("a"), text(1).alias("b"))
    return two.select(key, F.coalesce(F.nullif("a", F.lit("")), F.col("b")).alias("title"))


def measure_columns(cells: DataFrame, key: str) -> DataFrame:
    """Columns that hold amounts: a separator or point, or 1000 and more."""
    t = F.trim("raw_text")
    number = F.regexp_replace(t, ",", "").try_cast("double")
    amount = number.isNotNull() & (t.rlike("[,.]") | (F.abs(number) >= 1000))
    return cells.groupBy(key, "col_idx").agg(F.bool_or(F.coalesce(amount, F.lit(False))).alias("is_measure"))


def largest_on_page(grids: DataFrame, page: list[str], size: Column, idx: str = "table_idx") -> DataFrame:
    """The grid of most cells on each page, the first of equals."""
    w = Window.partitionBy(*page).orderBy(size.desc(), F.col(idx))
    return grids.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def coalesce_tables(grids: DataFrame, key: str) -> DataFrame:
    """grids(key, page, table_idx, table_code, width, numeric_ratio, header_rows,
    repeated_header) plus island: adjacent grids that continue one another share it.

    A grid goes on from the one before it if it is on the same or next page, of
    similar width, and has the same code, or an unknown one and mostly numbers.
    An unknown grid takes the code of what it continues, so chains stay together.
    """
    by = Window.partitionBy(key).orderBy("page", "table_idx")
    known = F.when(F.col("table_code") != "UNKNOWN", F.col("table_code"))
    before = F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    near = (F.col("page") - F.lag("page").over(by) <= 1) & (F.abs(F.col("width") - F.lag("width").over(by)) <= 2)
    goes_on = (F.col("table_code") == "UNKNOWN") & (F.col("numeric_ratio") >= 0.35) & ((F.col("header_rows") <= 1) | F.col("repeated_header"))
    joins = F.coalesce(near & ((F.col("table_code") == before) | (goes_on & before.isNotNull())), F.lit(False))
    out = grids.withColumn("__new", F.when(joins, 0).otherwise(1))
    return out.withColumn("island", F.sum("__new").over(by)).drop("__new")


#: fixed values: headers of columns that say what a row is, not how much
DIMENSION_HEADERS = ("项目", "科目", "科目编码", "科目名称", "功能分类", "经济分类", "行次", "序号", "类", "款", "项", "栏次", "编码", "名称")


def is_dimension_header(header: Column) -> Column:
    t = X.normalized(header)
    return t.isin(*DIMENSION_HEADERS) | t.rlike("科目编码|科目名称|行次|序号")


def title_line(lines: DataFrame, key: str) -> DataFrame:
    """lines(key, idx, line): the line that looks most like a table's title: +4 for
    a title word, +2 for a year or 部门, -3 for a unit line, less 0.1 a line."""
    t = F.col("line")
    score = F.when(t.rlike("预算表|决算表|总表|经费预算表|经费支出表|分类预算表"), 4.0).otherwise(0.0) + F.when(t.rlike(r"20\d{2}年|部门"), 2.0).otherwise(0.0) - F.when(t.rlike("^(?:编制部门|编制单位|单位[:：])"), 3.0).otherwise(0.0) - F.col("idx") * 0.1
    best = lines.groupBy(key).agg(F.max_by(F.struct("line", score.alias("score")), F.struct(score, -F.col("idx"))).alias("b"))
    return best.select(key, F.col("b.line").alias("title"), F.col("b.score").alias("score")).where("score > 0")


def placeholder_tables(lines: DataFrame, key: str, have: DataFrame, dictionary: list[dict]) -> DataFrame:
    """Tables that a page announces but that were not extracted: key, table_code,
    title; recognized with at least 0.75 and not among have(key, table_code)."""
    best = title_line(lines.where("idx < 6"), key).select(key, "title", F.lit(None).cast("string").alias("hint"), F.array().cast("array<string>").alias("headers"))
    found = detect_table(best, key, dictionary).where((F.col("score") >= 0.75) & F.col("table_code").isNotNull())
    return found.join(best.select(key, "title"), key).join(have, [key, "table_code"], "left_anti").select(key, "table_code", "title")
