from __future__ import annotations

import corpus_pipeline
import pytest
from ledgerlens.llm import common

from .fixtures import corpus, frame, words
from .test_operators import brute_lines, brute_links
from .fixtures import components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of every stage on the small corpus."""
    docs, out = frame(spark), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, ""), f"t-{name}")
        out.append((name, docs))
    return out


def test_columns_stay(spark, stages):
    want = frame(spark).columns
    assert all(df.columns == want for _, df in stages[:-1])
    assert [n for n, _ in stages] == ["language_id", "line_dedup", "ngram_jaccard", "source_mix", "best_fit_packing"]


def test_stages_are_the_brute_force_ones(spark, stages):
    rows = {r[0]: r[1] for r in corpus()}
    first = {r["doc_id"]: r["text"] for r in stages[0][1].collect()}
    assert not {2000, 2001, 2002, 2006} & set(first)
    assert {i for i in rows if i < 2000} <= set(first)  # clean documents stay
    gone = brute_lines(first.items())
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in first.items()}
    want = {i: t for i, t in kept.items() if words(t) or not any(g[0] == i for g in gone)}
    second = {r["doc_id"]: r["text"] for r in stages[1][1].collect()}
    assert second == want
    comp = components(list(second), brute_links(list(second.items())))
    third = [r["doc_id"] for r in stages[2][1].collect()]
    assert len(third) == len(set(third))  # repeated rows are copies too
    third = set(third)
    assert third == {i for i in second if comp[i] == i}
    fourth = [r["doc_id"] for r in stages[3][1].collect()]
    assert set(fourth) <= third and max(fourth.count(i) for i in fourth) <= 3
    packed = stages[4][1].collect()
    assert {r["doc_id"] for r in packed} == set(fourth)


def test_empty_table_and_null_ids(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    rows = [(None, text, "en", None, 70, 1, "x", "y", 2, "z"), (4, text, "en", "s", 70, 1, "x", "y", 2, "z"), (None, None, None, None, None, 1, "x", "y", 2, "z")]
    out = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, out, ""), f"n-{name}")
    assert {r["doc_id"] for r in out.collect()} <= {None, 4} and out.count() >= 1


def test_rows_that_share_only_an_id_are_documents(spark):
    one, other = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "other"))
    near = one.replace("alpha39", "changed")
    rows = [(1, one), (1, other), (1, other), (7, near), (7, "a text of its own that nothing else resembles at all"), (9, other), (None, one)]
    docs = frame(spark, [(i, t, "en", "s", len(t), 1, "x", "y", 2, "z") for i, t in rows])
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, one), (1, other), (7, rows[4][1]), (None, one)], key=str)
