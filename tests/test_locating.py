"""Approximate names, sections, headers, the table of grants and places of texts, against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlens.operators import grant_table as G
from ledgerlens.operators import headers as H
from ledgerlens.operators import locations as L
from ledgerlens.operators import narrative as V
from ledgerlens.operators import sections as S
from ledgerlens.operators import tables


def test_names_as_in_full_enumeration(spark):
    rng = random.Random(5)
    names = {"a": ("收入支出决算总表甲乙丙丁戊己庚辛壬癸子丑寅卯",), "b": ("收支决算表",), "c": ("一般公共预算财政拨款基本支出决算明细表格附件一",)}
    pages = []
    for i in range(160):
        name = rng.choice([n for ns in names.values() for n in ns])
        text = list(name)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice(([], [rng.choice("收入甲Z")], [text[k], "Q"]))
        before, after = ("".join(rng.choices("收入支出决算甲乙丙表", k=rng.choice((0, 0, 3, 40)))) for _ in range(2))
        pages.append((i, 1, before + "".join(text) + after))
    df = spark.createDataFrame(pages, "doc_id int, page int, plain string")
    got = {(r["doc_id"], r["t"]) for r in H.name_hits(df, names).collect()}
    want = {(i, t) for i, _, p in pages for t, ns in names.items() for n in ns if len(p) >= len(n) and tables.partial_ratio(n, p) >= 95}
    short = {(i, t) for i, _, p in pages for t, ns in names.items() for n in ns if len(p) < len(n)}
    assert got - short == want - short and len(want) > 40


def test_unfilled_texts_on_reports(spark):
    toc = "目录\n1. 2026年部门收支预算总表...........1\n四、部门预算编制说明………………"
    pages = [(1, 1, "某区XXXXX主要职能\n（九）。。。。。"), (2, 1, "项目资金说明：××万元，待后续填写。"), (3, 1, toc), (4, 1, None), (5, 1, ""), (6, 1, "第一章 总体……………… 7\n正文……………… 7")]
    got = sorted((r["doc_id"], r["pos"], r["message"]) for r in H.placeholder_findings(spark.createDataFrame(pages, "doc_id int, page int, text string")).collect())
    assert got == [(1, 2, "XXXXX"), (1, 15, "。。。。。"), (2, 7, "××"), (6, pages[5][2].rindex("文") + 1, "………………")]


def test_unfilled_texts_in_one_pass(spark):
    """One pass over all patterns finds what one for each does, page by page: repeated pages count each, dots at a
    line's start belong to that line, and nothing is shuffled."""
    rng = random.Random(3)
    bits = ["XX", "x", "X", "ＸＸ", "×", "✕×", "TBD", "tbd", "n/a", "NA", "{ 单位 }", "{部门}", "{\n单位 }", "}", "待填写", "请填写", "填写", "( 待A )", "(略)", "...", "..", "……", "。。。", "·", " ", "\n", "7", "é", "表", "目录", "目 录", "说明", "😀"]
    pages = [(i, 1, "".join(rng.choices(bits, k=rng.choice((1, 3, 8, 20, 60))))) for i in range(300)]
    pages += [(400, 1, "第一章\n...... 7"), (400, 1, "第一章\n...... 7"), (401, 1, "XX，" * 30 + "待填写"), (402, 1, "...，" * 9 + "XX")]

    def plain(text):
        import re

        flags = lambda p: re.compile(p.replace("(?iU)", "(?i)").replace(r"\s", r"[ \t\n\r\f\v]"))
        bare = lambda s: re.sub(H.X.PUNCTUATION, "", s)
        contents = "目录" in bare("\n".join(text.split("\n")[:12])) or ("目录" in bare(text) and bare(text).count("表") >= 8)
        out, seen = [], set()
        for k, p in enumerate(H.PLACEHOLDERS):
            for m in flags(p).finditer(text):
                line = text[text.rfind("\n", 0, m.start()) + 1 :].split("\n")[0].strip(" ")
                leads = re.search(H.LEADERS, line) and any(w in line for w in H.LEADER_WORDS)
                if m.span() not in seen and not (k == len(H.PLACEHOLDERS) - 1 and (contents or leads)):
                    seen.add(m.span())
                    out.append((m.start(), m.group()))
        return out[: H.PER_PAGE]

    df = spark.createDataFrame(pages, "doc_id int, page int, text string")
    found = H.placeholder_findings(df)
    got = sorted((r["doc_id"], r["pos"], r["message"]) for r in found.collect())
    want = sorted((i, pos, hit) for i, _, text in pages for pos, hit in plain(text))
    assert got == want and len(want) > 500 and got.count((400, 4, "......")) == 2
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_header_of_a_small_grid(spark):
    cells = [(1, 0, 0, "支出决算表"), (1, 1, 0, "合计"), (1, 1, 1, "基本支出"), (1, 2, 0, "教育支出"), (1, 2, 1, "100"), (2, 0, 0, "只有标题"), (3, 1, 0, None), (3, 2, 0, " ")]
    got = {(r["k"], r["col_idx"]): r["header"] for r in H.header_columns(spark.createDataFrame(cells, "k int, row_idx int, col_idx int, raw_text string"), ["k"]).collect()}
    assert got == {(1, 0): "合计", (1, 1): "基本支出"}


def test_sections_over_pages(spark):
    rng = random.Random(2)
    found = (S.Section("a", r"(?m)^\s*#a", r"(?m)^\s*#b"), S.Section("b", r"(?m)^\s*#b", r"(?m)^\s*#c"))
    pages = []
    for d in range(30):
        for p in range(rng.randint(1, 6)):
            pages.append((d, p + 1, "\n".join(rng.choice(("x", "yy", "#a", " #b", "#c", "z #a", "")) for _ in range(rng.randint(0, 5))) or None))
    at = S.placed(spark.createDataFrame(pages, "doc_id int, page int, text string").repartition(3))
    got = {(r["doc_id"], r["section"]): (r["start"], r["text"]) for r in S.texts(at, S.intervals(at, found)).collect()}
    import re

    want = {}
    for d in {p[0] for p in pages}:
        parts = [t or "" for i, _, t in pages if i == d]
        starts = [sum(len(x) + 1 for x in parts[:k]) for k in range(len(parts))]
        hits = lambda pattern, ps=parts, ss=starts: [s + m.start() for x, s in zip(ps, ss, strict=True) for m in re.finditer(pattern, x)]
        for s in found:
            if begin := hits(s.start):
                end = min((e for e in hits(s.end) if e >= begin[0]), default=None)
                want[d, s.name] = (begin[0], "\n".join(parts)[begin[0] : end])
    # a section that ends where a page begins has an empty part of that page
    assert {k: (a, t.rstrip("\n")) for k, (a, t) in got.items()} == {k: (a, t.rstrip("\n")) for k, (a, t) in want.items()}


def test_places_exact_and_in_proportion(spark):
    hay = "（ 一 ）" + "，" * 10 + "本年收入：100 万元，支出合计90万元"
    rows = [(1, 1, 1, "本年收入 100万元（支出", ""), (1, 2, 1, "短", "短"), (1, 3, 9, "本年收入：100 万元", None), (1, 4, 1, None, "本年收入：100 万元")]
    needles = spark.createDataFrame(rows, "doc_id int, id int, page int, clip string, fallback string")
    pages = spark.createDataFrame([(1, 1, hay)], "doc_id int, page int, text string")
    got = {r["id"]: r["pos"] for r in L.text_places(needles, pages).collect()}
    assert got == {1: hay.index("本"), 2: 10**9, 3: 10**9, 4: hay.index("本")}
    share = {r["id"]: r["pos"] for r in L.text_places(needles, pages, proportional=True).collect()}
    plain = "一本年收入100万元支出合计90万元"
    assert share[1] == int(1 / len(plain) * len(hay)) and share[4] == got[4]


def test_grants_without_and_with_few_rows(spark):
    kind = "doc_id int, t string, row_idx int, cells array<string>"
    few = [(1, "T4", i, ["总计", "5", "1", "1", "1"]) for i in range(4)]
    rows = spark.createDataFrame(few + [(2, "T8", 0, ["基金", "50"]), (3, "T9", 0, None), (4, "T4", 0, []), (5, "T5", 0, ["合计", None])], kind)
    assert G.balance_findings(rows).count() == 0
    assert [(r["doc_id"], r["message"], r["lhs"]) for r in G.empty_findings(rows).collect()] == [(2, "T8", 50.0)]
    assert {r["lhs"] for r in G.row_findings(rows).collect()} == {5.0}
    none = rows.limit(0)
    for find in (G.balance_findings, G.row_findings, G.column_findings, G.empty_findings, G.general_findings):
        assert find(none).count() == 0
    pages = spark.createDataFrame([(1, 1, None), (1, 2, "")], "doc_id int, page int, text string")
    for find in (V.near_findings, V.total_findings, V.statement_findings, V.class_findings, V.class_share_findings, V.zero_hints):
        assert find(pages, rows).count() == 0 and find(pages.where(F.lit(False)), none).count() == 0
    assert S.expenditure_findings(pages).count() == 0
