"""Lines of one to three words in the line query and the pipeline's stage."""

from __future__ import annotations

import corpus_pipeline
from ledgerlens.llm import line_dedup, queries

TEXTS = {1: "Read more\nx\nthe first long line of some words", 2: "read MORE\ny\nRead  more", 3: "All rights reserved\nmore read", 4: "all rights reserved", 5: " \n\nx"}
#: Read more, All rights reserved and x go where they stand again
WANT = {1: TEXTS[1], 2: "y", 3: TEXTS[3], 4: "", 5: " \n"}


def test_short_lines_repeat(spark, tmp_path):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs, min_words=1).collect()}
    assert {k: r["text"] for k, r in got.items()} == WANT
    assert {r["doc_id"]: r["n_removed"] for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 0, 4: 1, 5: 1}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert kept == {k: WANT[k] for k in (1, 2, 3)}


def test_sets_too_small_to_be_alike():
    n = line_dedup.ALIKE
    assert line_dedup.DEN * n >= line_dedup.NUM * (n + 1) and line_dedup.DEN * (n - 1) < line_dedup.NUM * n
