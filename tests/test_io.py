"""Sources, sinks and streams."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerlens import sources, streaming
from ledgerlens.operators.jobs import CircuitBreaker, RateLimiter
from ledgerlens.sources import sinks


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "cells.csv"
    p.write_text('﻿table_code,row_idx,col_idx,raw_text\nFIN_03,0,1,"two\nlines"\n,1,1,x\nFIN_03,x,2,y\n', encoding="utf-8")
    got = sources.csv_cells(spark, str(p)).collect()
    assert [(r["row_idx"], r["raw_text"]) for r in got] == [(0, "two\nlines"), (None, "y")]
    p = tmp_path / "facts.csv"
    p.write_text('table_code,measure,amount,extra_dims\nA,m,"1,234.5","{""a"":1}"\nA,m,bad,{bad\n', encoding="utf-8")
    got = sources.csv_facts(spark, str(p)).collect()
    assert [(r["amount"], r["extra_dims"]) for r in got] == [(1234.5, '{"a":1}'), (None, "{}")]


def test_dump_and_status_sources(spark, tmp_path):
    (tmp_path / "dump.sql").write_text("x\nCOPY public.units (id, name, parent) FROM stdin;\n1\tone\\ttab\t\\N\n2\ttwo\t1\n\\.\nCOPY other (id) FROM stdin;\n9\n\\.\n")
    got = sources.pg_copy(spark, str(tmp_path / "dump.sql"), "units").orderBy("line").collect()
    assert [(r["id"], r["name"], r["parent"]) for r in got] == [("1", "one\ttab", None), ("2", "two", "1")]
    for k, text in (("j1", '{"status": "done"}'), ("j2", "{broken")):
        (tmp_path / "jobs" / k).mkdir(parents=True)
        (tmp_path / "jobs" / k / "status.json").write_text(text)
    got = sources.json_statuses(spark, str(tmp_path / "jobs" / "*" / "status.json"), "status string").collect()
    assert [(r["job_id"], r["status"]) for r in got] == [("j1", "done")]
    assert sources.file_checksums(spark, str(tmp_path / "jobs" / "j1")).first()["size"] == 18


def test_dump_over_many_splits(spark, tmp_path):
    rows = [(f"u{k}", f"name {k}" * (k % 7), None if k % 5 else f"u{k // 2}") for k in range(4000)]
    body = lambda some: "".join(f"{a}\t{b}\t{c or chr(92) + 'N'}\n" for a, b, c in some)
    text = "-- dump\n\nCOPY other (id) FROM stdin;\nx\n\\.\nCOPY public.units (id, name, parent) FROM stdin;\n" + body(rows[:3000]) + "\\.\nSELECT 1;\nCOPY public.units (id, name, parent) FROM stdin;\n" + body(rows[3000:]) + "\\.\nCOPY last (id) FROM stdin;\ny\n\\.\n"
    (tmp_path / "dump.sql").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "100b")
        df = sources.pg_copy(spark, str(tmp_path / "dump.sql"), "units")
        assert df.rdd.getNumPartitions() > 20
        got = [(r["id"], r["name"], r["parent"]) for r in df.orderBy("line").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == rows
    assert sources.pg_copy(spark, str(tmp_path / "dump.sql"), "absent").count() == 0


def test_organizations(spark):
    df = spark.createDataFrame([("财政局", "国库科", None), ("财政局", None, None), (None, None, "独立")], "`部门` string, `单位` string, `名称` string")
    got = sources.organizations(df, {"department": ("部门",), "unit": ("单位",), "name": ("名称",)}).collect()
    assert {(r["name"], r["level"], r["parent_name"]) for r in got} == {("财政局", "department", None), ("国库科", "unit", "财政局"), ("独立", "unit", None)}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, v double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "id int, s string, v double")
    assert {tuple(r) for r in sinks.upserted(old, new, ["id"]).collect()} == {(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)}
    path = str(tmp_path / "facts")
    rows = lambda v, n: spark.createDataFrame([(v, k) for k in range(n)], "version int, k int")
    sinks.replace_versions(rows(1, 3).unionByName(rows(2, 2)), path)
    sinks.replace_versions(rows(1, 1), path)
    assert {(r["version"], r["count"]) for r in spark.read.parquet(path).groupBy("version").count().collect()} == {(1, 1), (2, 2)}
    found = spark.createDataFrame([(1, ["a", "b"], {"m": 1.5})], "doc_id int, tags array<string>, metrics map<string,double>")
    sinks.csv_report(found, str(tmp_path / "csv"), ["doc_id", "tags", "metrics", "absent"])
    text = max((f.read_text(encoding="utf-8") for f in (tmp_path / "csv").glob("*.csv")), key=len)
    assert text.startswith("﻿doc_id,tags,metrics,absent") and "a | b" in text
    sinks.json_report(found, str(tmp_path / "json"))
    assert [json.loads(f.read_text())["count"] for f in (tmp_path / "json").glob("*.json") if f.stat().st_size] == [1]
    sinks.audit(found.select("doc_id"), str(tmp_path / "log"))
    sinks.audit(found.select("doc_id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, k, t0 + dt.timedelta(seconds=k), k % 3 == 0) for k in range(6)]
    src = str(tmp_path / "events")
    kind = "user_id long, event_id long, ts timestamp, ok boolean"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(src)
    events = spark.readStream.schema(kind).parquet(src)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run(streaming.rate_limit(events, RateLimiter(3, 60, 60)), "limited")
    assert [r["allowed"] for r in sorted(got, key=lambda r: r["event_id"])] == [True] * 3 + [False] * 3
    got = run(streaming.circuit_breaker(events, CircuitBreaker(2, 60)), "broken")
    assert [r["state"] for r in sorted(got, key=lambda r: r["event_id"])] == ["closed", "closed", "open", "open", "open", "open"]
    got = run(streaming.tumbling(events, "ts", "user_id", "3 seconds"), "windows", "complete")
    assert sorted(r["n"] for r in got) == [3, 3]
    got = run(streaming.latest_status(events.select(F.col("user_id").alias("job_id"), F.col("ok").cast("string").alias("status"), "ts")), "status", "complete")
    assert [(r["status"], r["events"]) for r in got] == [("false", 6)]
    seen = []
    jobs = streaming.once_per_job(events.select(F.col("user_id").alias("job_id"), "ts"))
    streaming.run_queue(jobs, lambda df, k: seen.append(df.count()), str(tmp_path / "queue")).awaitTermination()
    assert sum(seen) == 1
