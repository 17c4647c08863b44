"""The line query's work: texts are read once, all pairs are made where they are few."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import line_dedup

from .test_operators import brute_lines


def near_copies():
    """Lines of 40 words in documents of four, a third of them near copies of others."""
    rng = np.random.default_rng(4)
    lines = [[f"w{k}" for k in rng.integers(0, 3000, 40)] for _ in range(60)]
    lines += [[*line[int(rng.integers(0, 6)) :], "end"] for line in lines[::2]]
    lines += [["short", "line", str(k % 3)] for k in range(5)] + [["a"] * 7, ["a"] * 5]
    lines += [lines[1], [*lines[3][:20], *lines[4][20:]]]
    texts = [" ".join(line) for line in rng.permutation(np.array(lines, dtype=object))]
    return [(i, "\n".join(texts[4 * i : 4 * i + 4])) for i in range(-(-len(texts) // 4))]


@pytest.mark.parametrize("few", [True, False])
def test_few_pairs_are_made_at_once(spark, monkeypatch, few):
    rows = near_copies()
    gone = brute_lines(rows)
    if few:

        def stars(members):
            raise AssertionError("rounds by centres are for many pairs")

        monkeypatch.setattr(line_dedup, "_star_pairs", stars)
    else:
        monkeypatch.setattr(line_dedup, "PAIRS", -1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert gone and {(r["doc"], r["place"]) for r in line_dedup.removed_lines(docs).collect()} == gone


def test_many_pairs_go_by_centres(spark, monkeypatch):
    members = spark.createDataFrame([(k, i) for k in range(3) for i in range(20)], "key long, id long")
    assert line_dedup._few_pairs(members) and line_dedup._few_pairs(members.limit(0))
    monkeypatch.setattr(line_dedup, "GROUP", 19)
    assert not line_dedup._few_pairs(members)
    monkeypatch.undo()
    monkeypatch.setattr(line_dedup, "PAIRS", 9)
    assert not line_dedup._few_pairs(members)


def test_texts_are_lower_cased_and_split_once(spark, tmp_path):
    spark.createDataFrame([(1, "A b")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = line_dedup._keyed(spark.read.parquet(str(tmp_path / "d")))
    plan = line_dedup._split(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("split(") == 1
