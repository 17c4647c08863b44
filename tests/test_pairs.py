"""Blocked pairs of titles, suppression of boxes and nearest ancestors, against plain versions."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from ledgerlens.operators import boxes as B
from ledgerlens.operators import findings as A
from ledgerlens.operators import hierarchy as H
from ledgerlens.operators import similarity as S
from ledgerlens.operators import tables


@pytest.mark.parametrize("least", [0.0, 0.4, 0.625, 0.9, 1.0])
def test_blocked_titles_are_all_pairs(spark, least):
    rng = random.Random(3)
    words = ["总表", "收入", "支出", "不一致", "T1", "合计", "Aa", "a"]
    title = lambda: rng.choice(["", None, *["".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(8)]])
    left, right = ([(d, f"{s}{k}", title()) for d in range(6) for k in range(9)] for s in "lr")
    kind = "doc_id int, id string, title string"
    got = {(r["doc_id"], r["left_id"], r["right_id"]): r["ratio"] for r in S.text_pairs(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), least).collect()}
    want = {}
    for d, i, a in left:
        for e, j, b in right:
            if d == e and a is not None and b is not None and (q := SequenceMatcher(None, a.lower(), b.lower()).ratio()) >= least:
                want[d, i, j] = q
    assert got.keys() == want.keys() and all(abs(got[k] - q) < 1e-12 for k, q in want.items())


def test_blocked_candidates_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    kind = "doc_id int, id string, ord int, title string, page int, section string, table string, tags array<string>, metrics map<string,double>, severity string"

    def side(name):
        rows = []
        for d in range(8):
            for k in range(8):
                title = rng.choice(["收入合计不一致", "收入 合计不一致", "支出合计不一致：T1", "缺少表格"]) + rng.choice(["", "！", "x"])
                rows.append((d, f"{name}{k}", k, title, rng.choice([None, 1, 2, 5]), rng.choice([None, "说明1", "说明2"]), rng.choice([None, "总表", "收入总表"]), rng.choice([[], ["a"], ["A", "b"]]), rng.choice([{}, {"x": 1.0}, {"x": 1.001, "y": 0.0}]), "warn"))
        return spark.createDataFrame(rows, kind)

    ai, rule = side("a"), side("r")
    for config in (A.MergeConfig(), A.MergeConfig(title_similarity=0.5)):
        plain = A.location_similarity
        pairs = lambda df: {(r["doc_id"], r["ai_id"], r["rule_id"]): round(r["similarity"], 9) for r in df.collect()}
        got = pairs(S.candidate_pairs(ai, rule, config))
        all_pairs = ai.alias("a").join(rule.alias("r"), "doc_id")
        from pyspark.sql import functions as F

        sim = tables.sequence_ratio_udf(F.lower("a.title"), F.lower("r.title")) * 0.4 + plain("a", "r", config, tables.sequence_ratio_udf) * 0.3 + A.tag_similarity(F.col("a.tags"), F.col("r.tags")) * 0.2 + A.metric_similarity(F.col("a.metrics"), F.col("r.metrics"), config) * 0.1
        want = pairs(all_pairs.select("doc_id", F.col("a.id").alias("ai_id"), F.col("r.id").alias("rule_id"), sim.alias("similarity")).where(F.col("similarity") >= config.title_similarity))
        assert got == want and want


def test_suppression_is_the_greedy_order(spark):
    rng = random.Random(4)
    rows = []
    for page in range(12):
        for k in range(rng.choice((1, 5, 60))):
            x, y, w, h = rng.uniform(-5, 60), rng.uniform(0, 60), rng.choice((0, 1, 20, 21, 22, 300)), rng.choice((0, 1, 15, 16, 200))
            if rng.random() < 0.5:
                x, y = round(x / 8) * 8, round(y / 8) * 8
            rows.append((page, k, tuple(float(v) for v in (x, y, x + w, y + h)), rng.randint(0, 3)))
    df = spark.createDataFrame(rows, "page int, id int, box struct<x0:double,y0:double,x1:double,y1:double>, priority int").repartition(4)
    got = {(r["page"], r["id"]) for r in B.suppressed(df, ["page"]).collect()}
    want, kept = set(), {}
    for page, k, b, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        size = lambda q: (q[2] - q[0]) * (q[3] - q[1])
        for o in kept.get(page, []):
            both = max(0, min(b[2], o[2]) - max(b[0], o[0])) * max(0, min(b[3], o[3]) - max(b[1], o[1]))
            if both and (both / (size(b) + size(o) - both) >= 0.75 or both / min(size(b), size(o)) >= 0.9):
                break
        else:
            kept.setdefault(page, []).append(b)
            want.add((page, k))
    assert got == want and 0 < len(want) < len(rows)
    assert B.suppressed(df.limit(0), ["page"]).count() == 0
    with pytest.raises(ValueError, match="0.75"):
        B.same_pairs(df, ["page"], 0.5)


def test_nearest_of_level_in_long_chains_and_cycles(spark):
    chain = [(f"u{k}", "unit", f"u{k + 1}" if k < 3000 else "d") for k in range(3001)] + [("d", " Department ", "r"), ("r", "district", None)]
    other = [("a", "unit", "b"), ("b", "unit", "c"), ("c", "unit", "a"), ("s", "unit", "s"), ("x", "unit", "gone"), ("y", None, "d"), ("e", "department", "e"), ("f", "unit", "e")]
    df = spark.createDataFrame(chain + other, "id string, level string, parent_id string").repartition(4)
    got = {r["id"]: r["at"] for r in H.nearest_of_level(df).collect()}
    assert len(got) == len(chain) + len(other)
    assert all(got[f"u{k}"] == "d" for k in range(3001)) and got["d"] == got["y"] == "d" and got["r"] is None
    assert [got[k] for k in "abcsx"] == [None] * 5 and got["e"] == got["f"] == "e"
    assert H.nearest_of_level(df.limit(0)).count() == 0


def test_jaccard_pairs_on_items_that_share_words(spark, tmp_path):
    from ledgerlens.plans import registry

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "The", "a", *"bcdefghijkl"], k=rng.randint(0, 9)))) for i in range(120)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["a"], r["b"]): r["jaccard"] for r in registry.queries()["jaccard_pairs"](spark, str(tmp_path)).collect()}
    sets = {i: {w for w in t.lower().split(" ") if w} for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert got.keys() == want.keys() and len(want) > 500 and all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_pairs_of_small_documents_take_no_tokens(spark):
    """Titles of a few findings are not dealt out to their characters; a crowded document's are."""
    kind = "doc_id int, id string, ord int, title string, page int, section string, table string, tags array<string>, metrics map<string,double>, severity string"
    side = lambda name, sizes: spark.createDataFrame([(d, f"{name}{k}", k, f"title {k % 30} of {d}", k % 4, "s", None, ["a"], {"x": 1.0}, "warn") for d, n in enumerate(sizes) for k in range(n)], kind)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = S.candidate_pairs(side("a", (5, 70, 3)), side("r", (5, 4, 70)))
    assert "Generate" not in plan(small)
    ai, rule = side("a", (5, 70, 70)), side("r", (5, 4, 70))
    mixed = S.candidate_pairs(ai, rule)
    assert [r["doc_id"] for r in S.crowded(ai, rule).collect()] == [2] and "Generate" in plan(mixed)
    pairs = lambda df: {(r["doc_id"], r["ai_id"], r["rule_id"]): round(r["similarity"], 12) for r in df.collect()}
    want = pairs(S._blocked_pairs(ai, rule, A.MergeConfig()))
    assert pairs(mixed) == pairs(S._all_pairs(ai, rule, A.MergeConfig())) == want and len(want) > 300


def test_sequence_ratio_is_that_of_whole_texts(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("abc", k=rng.choice((0, 1, 5, 190, 210)))), "".join(rng.choices("abc", k=rng.choice((0, 2, 30, 199, 260))))) for _ in range(60)]
    rows += [(y[3:40], y) for _, y in rows] + [(y, y[2:30]) for _, y in rows] + [(y, y) for _, y in rows] + [(None, "a"), (None, None)]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", tables.sequence_ratio_udf("x", "y").alias("q")).collect()
    assert all(r["q"] == SequenceMatcher(None, r["x"] or "", r["y"] or "").ratio() for r in got)


def test_merged_ids_match_once_and_titles_decide_first(spark):
    kind = "doc_id int, id string, ord int, title string, page int, section string, table string, tags array<string>, metrics map<string,double>, severity string"
    side = lambda name: spark.createDataFrame([(d, f"{name}{k}", k, f"t{k}", k, "s", None, ["a"], {"x": 1.0}, "warn") for d in range(4) for k in range(d + 1)], kind)
    ai, rule = side("a"), side("r").where("ord <> 2")
    pairs = A.candidate_pairs(ai, rule, lambda x, y: (x == y).cast("double"))
    plan = A.merged_ids(ai, rule, A.greedy_matches(pairs))
    assert "MapInPandas" not in plan._jdf.queryExecution().optimizedPlan().toString() or "InMemoryRelation" in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["place"]): r["id"] for r in plan.collect()}
    assert len(got) == 10 and got[3, 1] == "a0" and got[3, 4] == "a2" and got[0, 1] == "a0"
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("lower(title") < joined.index("transform(")
