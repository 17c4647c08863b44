"""Structured Streaming: job queue, latest states, rate limits, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import CircuitBreaker, RateLimiter


def job_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Job requests that appear as JSON files; a checkpoint makes them durable."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def once_per_job(jobs: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each job once, however often it is enqueued within the delay."""
    return jobs.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["job_id"])


def run_queue(jobs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start handing batches of jobs to `handle`.  A batch that was not finished
    when the process ended is handed over again after a restart."""
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def _stateful(step: Callable, start: tuple, fields: tuple[str, ...], state: str, out: str, key: str, ts: str, ident: str):
    def run(k: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        now = s.get if s.exists else start
        for f in frames:
            f = f.sort_values([ts, ident], kind="stable")
            rows = []
            for i, r in f.iterrows():
                now, *got = step(now, r)
                rows.append(got)
            yield pd.DataFrame({key: f[key].to_numpy(), ident: f[ident].to_numpy(), **{n: [r[j] for r in rows] for j, n in enumerate(fields)}})
        s.update(now)

    return run, out, state


def rate_limit(events: DataFrame, limiter: RateLimiter, key: str = "user_id", ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """events -> key, id, allowed, with the limiter's state kept per key.  Within a
    batch a key's events are taken in the order of time."""

    def step(state: tuple, r) -> tuple:
        start, n, until = (None if x is not None and x != x else x for x in state)
        new, ok = limiter.step((start, int(n), until), r[ts].timestamp())
        return new, ok

    run, out, state = _stateful(step, limiter.start(), ("allowed",), "start double, n int, until double", f"{key} long, {ident} long, allowed boolean", key, ts, ident)
    return events.select(key, ts, ident).groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(calls: DataFrame, breaker: CircuitBreaker, key: str = "user_id", ts: str = "ts", ident: str = "event_id", ok: str = "ok") -> DataFrame:
    """calls -> key, id, passed, state."""

    def step(s: tuple, r) -> tuple:
        kind, n, opened = s
        new, through = breaker.step((kind, int(n), None if opened is None or opened != opened else opened), r[ts].timestamp(), bool(r[ok]))
        return new, through, new[0]

    run, out, state = _stateful(step, breaker.start(), ("passed", "state"), "kind string, n int, opened double", f"{key} long, {ident} long, passed boolean, state string", key, ts, ident)
    return calls.select(key, ts, ident, ok).groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def latest_status(events: DataFrame) -> DataFrame:
    """Running state of each job: its last status by time (complete or update mode)."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events"))
