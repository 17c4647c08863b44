"""Readers of what the pipeline takes in.  PDFs are out of scope: pages and cells
come extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: columns of the two CSV imports
CELL_COLUMNS = ("table_code", "row_idx", "col_idx", "raw_text", "page_number")
FACT_COLUMNS = ("table_code", "statement_code", "classification_type", "classification_code", "classification_name", "measure", "amount", "extra_dims", "row_order")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells; rows without a table code are left out."""
    df = _csv(spark, path)
    c = lambda n: _column(df, n)
    rows = df.select(F.trim(c("table_code")).alias("table_code"), c("row_idx").try_cast("int").alias("row_idx"), c("col_idx").try_cast("int").alias("col_idx"), c("raw_text").alias("raw_text"), c("page_number").try_cast("int").alias("page_number"))
    return rows.where(F.coalesce("table_code", F.lit("")) != "")


def csv_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts; amounts that do not parse are NULL, dimensions that do not are {}."""
    df = _csv(spark, path)
    c = lambda n: _column(df, n)
    plain = [F.nullif(F.trim(c(n)), F.lit("")).alias(n) for n in FACT_COLUMNS[:6]]
    dims = F.when(F.try_parse_json(c("extra_dims")).isNotNull(), c("extra_dims")).otherwise("{}")
    rows = df.select(*plain, F.replace(F.trim(c("amount")), F.lit(","), F.lit("")).try_cast("double").alias("amount"), dims.alias("extra_dims"), c("row_order").try_cast("int").alias("row_order"))
    return rows.where(F.col("table_code").isNotNull())


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of every line; line grows along a file, whichever split a line is in.

    A split has fewer lines than bytes, so that its start plus a line's number in it does.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = lines.groupBy("file", "block").agg(F.min("id").alias("first"))  # a row for each split
    return lines.join(F.broadcast(first), ["file", "block"]).select("file", (F.col("block") + F.col("id") - F.col("first")).alias("line"), "value")


def pg_copy(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table's COPY blocks of a database dump, as strings; \\N is NULL.

    Blocks reach from a COPY line to the next line `\\.`; both kinds of lines are few, and lines are
    theirs by range.  A block may span any number of splits, and no dump is held as one string.
    line orders the rows of a file.
    """
    lines = _file_lines(spark, path)
    head = rf"^COPY (?:\w+\.)?{table} \(([^)]*)\) FROM stdin;$"
    marks = lines.where(F.col("value").startswith("COPY ") | (F.col("value") == "\\."))
    # one row for each block of the dump
    ends = marks.withColumn("end", F.lead("line").over(Window.partitionBy("file").orderBy("line")))
    found = ends.where(F.col("value").rlike(head)).select("file", F.col("line").alias("start"), F.coalesce("end", F.lit((1 << 62))).alias("end"), F.regexp_extract("value", head, 1).alias("head"))
    first = found.select("head").first()
    if first is None:
        return spark.createDataFrame([], "line int")
    names = [n.strip().strip('"') for n in first["head"].split(",")]
    inside = lines.join(F.broadcast(found.drop("head")), "file").where("line > start AND line < end AND value <> ''").select("line", F.col("value").alias("row"))
    cells = F.split("row", "\t", -1)
    unescape = lambda c: F.when(c == "\\N", None).otherwise(F.replace(F.replace(F.replace(c, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\")))
    return inside.select("line", *[unescape(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)])


def json_statuses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Status files of job folders; what does not parse is left out.  job_id is the
    folder's name."""
    whole = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    rows = whole.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("job_id"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("s"), F.try_parse_json("value").isNotNull().alias("ok"))
    return rows.where("ok AND s IS NOT NULL").select("job_id", "s.*")


def organizations(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows under any header alias; a department with a unit becomes two records."""
    have = {c.strip().lower(): c for c in df.columns}

    def pick(name: str) -> Column:
        cols = [F.nullif(F.trim(F.col(f"`{have[a.lower()]}`")), F.lit("")) for a in aliases.get(name, (name,)) if a.lower() in have]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    dept, unit, name, level = pick("department"), pick("unit"), pick("name"), pick("level")
    record = lambda n, l, p: F.struct(n.alias("name"), l.alias("level"), p.alias("parent_name"), pick("code").alias("code"))
    none = F.lit(None).cast("string")
    split = F.array(F.when(dept.isNotNull(), record(dept, F.lit("department"), none)), F.when(unit.isNotNull(), record(unit, F.lit("unit"), dept)), F.when(dept.isNull() & unit.isNull() & name.isNotNull(), record(name, F.coalesce(level, F.lit("unit")), pick("parent"))))
    return df.select(F.explode(F.array_compact(split)).alias("o")).select("o.*").distinct()


def jdbc(spark: SparkSession, url: str, table: str, schema: str = "public", **options: str) -> DataFrame:
    """A database table; the filters and columns of what follows are pushed down."""
    from ..operators.paging import identifier

    return spark.read.format("jdbc").options(url=url, dbtable=f"{identifier(schema)}.{identifier(table)}", **options).load()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, checksum, size of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("size"))
