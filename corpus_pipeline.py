"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.

Defined cases: null and empty texts, and texts without letters, go at the first
stage.  Rows with a null doc_id pass; where they repeat another document's text
only lines take part, as near copies are told by their ids.  Of repeated rows one
stays after the third stage; rows that share only a doc_id are documents of their own.
Of near copies the one with the smallest doc_id stays, of rows with that id the one whose
text's hash is smallest.  Very long texts go through whole.  Extra columns are carried along to
the fourth stage, whatever their names.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import common, language_id, line_dedup, mixing, packing, shingle_join


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters or that no language explains."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.predict(docs, model).where("accepted").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier line resembles; documents that had lines and keep none go."""
    out = line_dedup.deduplicated(docs, min_words=1)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    ids = docs.where("doc_id IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    place, keyed = "doc_id", docs
    if ids["n"] > ids["ids"]:  # ids do not tell rows apart: they are numbered in the order of their ids
        place = "__place" + "_" * max(len(c) for c in docs.columns)
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        keyed = common.stored(docs.orderBy("doc_id", F.xxhash64("text")).withColumn(place, number), "placed")
    found = shingle_join.near_duplicates(keyed.select(F.col(place).alias("doc_id"), "text"))
    gone = common.stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias(place)).distinct(), "copies")
    return keyed.join(F.broadcast(gone) if gone.count() <= common.BROADCAST_ROWS else gone, place, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.best_fit_packing(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_copies), ("source_mix", mix), ("best_fit_packing", pack)]

#: Word hashes, packing and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
