"""Writers: reports, keyed upserts, idempotent replacement, audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows put in by key: new values win where they are not NULL,
    rows of either side stay."""
    o, n = old.alias("o"), new.alias("n")
    on = None
    for k in key:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, on, "full_outer").select(*cols)


def replace_versions(df: DataFrame, path: str, partition: str = "version") -> None:
    """Replace whole partitions: writing a version again leaves one copy of it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def flat(found: DataFrame, separator: str = " | ") -> DataFrame:
    """Arrays joined, structs and maps as JSON, so that a CSV can hold them."""
    out = []
    for f in found.schema:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(F.transform(f.name, lambda x: F.coalesce(F.when(x.isNotNull(), F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'^\{"x":"?|"?\}$', "")), F.lit(""))), separator).alias(f.name))
        elif kind in ("struct", "map"):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return found.select(*out)


def csv_report(found: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV of fixed columns in a fixed order; the header starts with a byte order mark."""
    have = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df = flat(found.select(*have))
    df.withColumnRenamed(columns[0], "﻿" + columns[0]).write.mode("overwrite").option("header", True).csv(path)


def json_report(found: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """One object per document: its findings, in order, and their count."""
    rest = [c for c in found.columns if c != "doc_id"]
    # rows come to the aggregate by document and in order, and are collected as they come
    rows = found.repartition("doc_id").sortWithinPartitions("doc_id", *order)
    by = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count"), F.collect_list(F.struct(*rest)).alias("issues"))
    by.write.mode("overwrite").json(path)


def audit(events: DataFrame, path: str) -> None:
    """Append to the log, one JSON object a line."""
    events.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
