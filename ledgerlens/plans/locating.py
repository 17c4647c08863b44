"""Queries: headers, table names on pages, texts never filled in, and where findings point to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..operators import headers as H
from ..operators import locations as L
from .narrative import _D, _orders, _pages
from .registry import query


@query(
    "header_columns",
    f"""WITH {_D} SELECT doc_id, p.col AS col_idx, p.header FROM d, (VALUES
      (0, 0, '项目'), (0, 1, '本年 合计'), (0, 2, '基本支出'), (0, 3, '本年支出 项目支出 （万元）'),
      (1, 0, '科目'), (1, 1, '合计'), (1, 2, '备注'),
      (2, 0, '名称'), (2, 1, '基本 支出')) AS p(kind, col, header) WHERE p.kind = k % 3""",
)
def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = {
        # the base is the row with four cells; what stands above goes before it, what below behind
        0: [("支出决算表",), ("", "本年", "支出", "本年支出"), ("项目", "合计", "基本支出", "项目支出"), ("", "", "支出", "（万元）"), ("201", "9", "8", "7")],
        # the unit's line stands alone, so that it is left out where the base has three cells or more
        1: [("支出决算表",), ("单位：万元",), ("科目", "合计", "备注"), ("合计", "100", "5"), ("208 社保", "5", "1")],
        # of equals the first is the base; row 0 is no header whatever it holds
        2: [("甲", "乙", "丙"), ("名称", "基本"), ("名", "支出"), ("1", "2")],
    }
    each = [F.struct(F.lit(k).alias("kind"), F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), F.lit(t).alias("raw_text")) for k, grid in grids.items() for r, row in enumerate(grid) for c, t in enumerate(row)]
    cells = _orders(spark, sf_dir).select("doc_id", "k", F.inline(F.array(*each))).where("kind = k % 3")
    return H.header_columns(cells, ["doc_id"])


@query(
    "table_anchors",
    f"""WITH {_D} SELECT doc_id, p.t, p.page FROM d, (VALUES
      (0, 'T5', 2), (0, 'T3', 2), (1, 'T5', 2), (1, 'T3', 2), (2, 'T3', 2), (3, 'T8', 3)) AS p(kind, t, page) WHERE p.kind = k % 5
    UNION ALL SELECT doc_id, 'T6', 4 FROM d WHERE c % 2 = 0 UNION ALL SELECT doc_id, 'T3', 4 FROM d""",
)
def table_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole; without its first character at the page's start; the same behind other text; on a page that names a
    # guard; on a page of contents.  On page 4 the name's last character is missing, or two are
    tail = "CASE WHEN c % 2 = 0 THEN '基本支出决算表 一般公共预算财政拨款基本支出决算' ELSE '基本 支出决算表，一般公共预算财政拨款基本支出决' END"
    pages = _pages(spark, sf_dir, {
        2: "CASE k % 5 WHEN 0 THEN '附件：一般公共预算财政拨款支出决算表 单位：万元' WHEN 1 THEN '般公共预算财政拨款支出决算表 合计' WHEN 2 THEN '附件 般公共预算财政拨款支出决算表 合计' WHEN 4 THEN '目 录 支出决算表' ELSE '' END",
        3: "CASE WHEN k % 5 = 3 THEN '政府性基金预算财政拨款收入支出决算表，支出决算表' ELSE '封面' END",
        4: tail,
    })
    names = {t: n[:1] for t, n in D.FINAL_TABLES.items() if t in ("T3", "T5", "T6", "T8")}
    return H.table_anchors(pages, names)


@query(
    "unfilled_texts",
    f"""WITH {_D}
    SELECT doc_id, 1 AS page, 4 AS pos, repeat('X', (2 + k % 3)::INT) AS message FROM d
    UNION ALL SELECT doc_id, 1, 10 + k % 3, '。。。' FROM d
    UNION ALL SELECT doc_id, 2, p.pos, p.hit FROM d, (VALUES (7, '××'), (13, '待填写')) AS p(pos, hit) WHERE c % 2 = 0
    UNION ALL SELECT doc_id, 4, p * 3, 'XX' FROM d, range(8) AS r(p)
    UNION ALL SELECT doc_id, 5, 3, '{{ 单位 }}' FROM d UNION ALL SELECT doc_id, 5, 12, 'n/a' FROM d WHERE k % 2 = 0
    UNION ALL SELECT doc_id, 5, 16 + k % 2, '...' FROM d""",
)
def unfilled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, {
        1: r"'某区单位' || repeat('X', 2 + k % 3) || '职能\n九' || '。。。'",
        2: "CASE WHEN c % 2 = 0 THEN '项目资金说明：××万元，，待填写。' ELSE '项目资金说明：5万元' END",
        3: r"'目录\n1. 部门收支预算总表......1\n四、编制说明………………'",
        4: "repeat('XX，', 9) || '待填写'",
        5: r"'金额｛{ 单位 }万元 ' || CASE WHEN k % 2 = 0 THEN 'n/a' ELSE '待n/a' END || ' ...\n第一章 总体情况……………… 7'",
    }, dealt=True)
    return H.placeholder_findings(pages).select("doc_id", "page", "pos", "message")


@query(
    "issue_locations",
    f"""WITH {_D}
    SELECT doc_id, '收入支出决算总表 / 收入决算表' AS "table", NULL AS row, NULL AS col, '本年收入合计' AS field, 1 AS page, [1, 2 + k % 2, 9] AS pages, 'T1=100.0;T2=90.0' AS refs FROM d WHERE k % 4 = 0
    UNION ALL SELECT doc_id, '一般公共预算财政拨款基本支出决算表', '人员经费合计', NULL, '人员经费', 5, NULL, '-' FROM d WHERE k % 4 = 1
    UNION ALL SELECT doc_id, '收入决算表', '第7行', NULL, '行内合计', 3, [3, 2 + k % 2], '-' FROM d WHERE k % 4 = 2 AND k % 2 = 0 AND 2 + k % 2 <> 3
    UNION ALL SELECT doc_id, '财政拨款收入支出决算总表', '总计', '合计列', '收入侧总计 / 支出侧总计', NULL, NULL, '-' FROM d WHERE k % 4 = 3""",
)
def issue_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {
        0: ("V33-200", "T1↔T2收入合计不一致：T1=100.00, T2=90.00", "表1", None, None, [9], {"t1": "100.0"}),
        1: ("V33-243", "【表六】人员经费口径错误", "表内人员经费合计：10", None, None, None, {"type": "personnel"}),
        2: ("V33-210", "行内合计不一致", "第7行：收入", 3, None, None, {}),
        3: ("V33-242", "【表四】收支总计不平衡", "列：合计列\n收入侧", None, [0], None, {"table": "", "row": " "}),
    }
    kind = "struct<rule:string,message:string,evidence:string,page:int,pages:array<int>,evidence_pages:array<int>,location:map<string,string>>"
    dim = spark.createDataFrame([(n, c) for n, c in cases.items()], f"kind int, f {kind}")
    rows = _orders(spark, sf_dir).withColumn("kind", (F.col("k") % 4).cast("int")).join(F.broadcast(dim), "kind")
    found = rows.select("doc_id", F.lit(1).alias("id"), "f.*", F.lit(None).cast(f"array<{L.REF}>").alias("refs"))
    stands = F.array(*[F.struct(F.lit(t).alias("table"), F.expr(p).cast("int").alias("page")) for t, p in (("收入支出决算总表", "1"), ("收入支出决算总表", "4"), ("收入决算表", "2 + k % 2"), ("一般公共预算财政拨款基本支出决算表", "5"))])
    anchors = _orders(spark, sf_dir).select("doc_id", F.inline(stands))
    out = L.normalized(found, anchors)
    said = F.array_join(F.transform("refs", lambda r: F.when(r["role"].isNull(), F.lit("-")).otherwise(F.concat(r["role"], F.lit("="), r["value"].cast("string")))), ";")
    return out.select("doc_id", "table", "row", "col", "field", "page", "pages", said.alias("refs"))


@query(
    "text_places",
    f"""WITH {_D} SELECT doc_id, 1 AS id, (4 + k % 7)::INT AS pos FROM d
    UNION ALL SELECT doc_id, 2, (4 + k % 7)::INT FROM d UNION ALL SELECT doc_id, 3, (4 + k % 7)::INT FROM d
    UNION ALL SELECT doc_id, 4, 1000000000 FROM d UNION ALL SELECT doc_id, 5, 1000000000 FROM d UNION ALL SELECT doc_id, 6, (29 + k % 7)::INT FROM d""",
)
def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as it stands; blanks and full-width marks elsewhere; by the fallback; nothing alike; no such page; by its last third
    pages = _pages(spark, sf_dir, {1: "'（一） ' || repeat('。', k % 7) || '本年收入，合计：1,234.5 万元，比上年增加；主要原因是人员经费和项目支出按规定足额安排到位'"})
    needles = {
        1: (1, "本年收入，合计：1,234.5 万元", ""), 2: (1, "本年收入 合计　1234.5万元（", ""), 3: (1, "没有这样的一句话在此", "本年收入，合计：1,234.5"), 4: (1, "别的单位别的内容别的数字", "短"),
        5: (7, "本年收入，合计：1,234.5 万元", ""), 6: (1, "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒日月盈昃辰宿列张主要原因是人员经费和项目支出按规定足额", ""),
    }
    each = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("page"), F.lit(c).alias("clip"), F.lit(f).alias("fallback")) for i, (p, c, f) in needles.items()])
    return L.text_places(_orders(spark, sf_dir).select("doc_id", F.inline(each)), pages).select("doc_id", "id", "pos")
