"""A language with a single labelled row, in the query and in the pipeline's stage."""

from __future__ import annotations

import zlib

import corpus_pipeline
from ledgerlens.llm import queries


def test_one_row_teaches_its_language(spark, tmp_path):
    trains = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = next(i for i in range(60) if i not in trains)
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in trains[1:]]
    rows += [(trains[0], "η γρήγορη καφέ αλεπού", "el"), (held, "αλεπού καφέ γρήγορη", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, str(tmp_path)).collect()}
    assert got[held]["held_out"] and got[held]["lang_pred"] == "el" and got[held]["accepted"]
    assert got[trains[0]]["lang_pred"] == "el" and got[trains[1]]["lang_pred"] == "en"
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {r[0] for r in rows}
