"""Job lifecycle: latest versions, clean-up plans, duplicate uploads, states,
rate limits, circuit breakers, latencies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: states that a restart takes up again
RESUMABLE = ("queued", "processing", "running")


def latest(df: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each scope.  `order` runs from most to least important
    and should end in a unique column."""
    w = Window.partitionBy(*scope).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def last_write(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ord_col)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def cleanup_plan(jobs: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """job_id, action, reason for jobs(job_id, version_id, cleaned, <scope>): the
    latest of a scope is kept; of the others, versions that a kept job shares are
    blocked, cleaned ones and those without a version skipped, the rest deleted."""
    w = Window.partitionBy(*scope).orderBy(*[c.desc_nulls_last() for c in order])
    ranked = jobs.withColumn("k", F.row_number().over(w))
    kept = ranked.where("k = 1 AND version_id IS NOT NULL").select("version_id").distinct().withColumn("shared", F.lit(True))
    rows = ranked.join(kept, "version_id", "left")
    reason = (
        F.when(F.col("k") == 1, "latest")
        .when(F.col("version_id").isNull(), "no version")
        .when(F.coalesce("cleaned", F.lit(False)), "already cleaned")
        .when(F.col("shared"), "version in use")
        .otherwise("superseded")
    )
    action = F.when(F.col("k") == 1, "keep").when(F.col("version_id").isNull() | F.coalesce("cleaned", F.lit(False)), "skip").when(F.col("shared"), "blocked").otherwise("delete")
    return rows.select("job_id", "version_id", action.alias("action"), reason.alias("reason"))


def duplicate_uploads(new: DataFrame, old: DataFrame) -> DataFrame:
    """new and old (job_id, org_id, checksum, year, kind): uploads that exist
    already; an unknown year or kind of the new one matches any."""
    n, o = new.alias("n"), old.alias("o")
    any_of = lambda c: F.col(f"n.{c}").isNull() | F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    hit = n.join(o, (F.col("n.checksum") == F.col("o.checksum")) & F.col("n.org_id").eqNullSafe(F.col("o.org_id")) & any_of("year") & any_of("kind") & (F.col("n.job_id") != F.col("o.job_id")))
    return hit.groupBy(F.col("n.job_id").alias("job_id")).agg(F.min("o.job_id").alias("duplicate_of"), F.count(F.lit(1)).alias("copies"))


def stage_status(events: DataFrame) -> DataFrame:
    """events(job_id, stage, status, ts, seq): the state of each job: failed if its
    latest stage failed, done if the last stage is done, else running."""
    last = events.groupBy("job_id", "stage").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max(F.struct("ts", "seq")).alias("at"))
    return last.groupBy("job_id").agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_and(F.col("status") == "done"), "done").otherwise("running").alias("state"),
        F.max_by("stage", "at").alias("stage"),
        F.count(F.lit(1)).alias("stages"),
    )


# -------------------------------------------------------------- per-key machines


class RateLimiter:
    """A window opens with a key's first request and starts again with the first
    one after it has passed; the request beyond `limit` blocks the key for a while."""

    def __init__(self, limit: int = 100, window: float = 60.0, block: float = 60.0) -> None:
        self.limit, self.window, self.block = limit, window, block

    def start(self) -> tuple:
        return (None, 0, None)  # window start, requests, blocked until

    def step(self, state: tuple, now: float) -> tuple[tuple, bool]:
        start, n, until = state
        if until is not None:
            if now < until:
                return state, False
            until = None
            start, n = None, 0
        if start is None or now - start > self.window:
            return (now, 1, until), True
        n += 1
        if n > self.limit:
            return (start, n, now + self.block), False
        return (start, n, until), True


class CircuitBreaker:
    """Opens after `failures` failures in a row; after `cooldown` one call is let
    through, and its outcome closes or opens it again."""

    def __init__(self, failures: int = 3, cooldown: float = 60.0) -> None:
        self.failures, self.cooldown = failures, cooldown

    def start(self) -> tuple:
        return ("closed", 0, None)

    def step(self, state: tuple, now: float, ok: bool) -> tuple[tuple, bool]:
        """The next state, and whether the call was let through."""
        kind, n, opened = state
        if kind == "open":
            if now - opened < self.cooldown:
                return state, False
            kind = "half-open"
        if ok:
            return ("closed", 0, None), True
        n += 1
        if kind == "half-open" or n >= self.failures:
            return ("open", n, now), True
        return ("closed", n, None), True


def rate_limited(events: DataFrame, limiter: RateLimiter, key: str, ts: str, ident: str) -> DataFrame:
    """events plus allowed, in the order of time per key."""
    kind = events.schema

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([ts, ident], kind="stable")
        state, out = limiter.start(), []
        for t in f[ts].astype("datetime64[us]").astype("int64") / 1e6:
            state, ok = limiter.step(state, float(t))
            out.append(ok)
        return f[[key, ident]].assign(allowed=out)

    return events.select(key, ts, ident).groupBy(key).applyInPandas(run, f"{key} {kind[key].dataType.simpleString()}, {ident} {kind[ident].dataType.simpleString()}, allowed boolean")


def breaker_states(calls: DataFrame, breaker: CircuitBreaker, key: str, ts: str, ident: str, ok: str) -> DataFrame:
    """calls plus passed and state after each call."""
    kind = calls.schema

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([ts, ident], kind="stable")
        state, passed, states = breaker.start(), [], []
        for t, good in zip(f[ts].astype("datetime64[us]").astype("int64") / 1e6, f[ok], strict=True):
            state, through = breaker.step(state, float(t), bool(good))
            passed.append(through)
            states.append(state[0])
        return f[[key, ident]].assign(passed=passed, state=states)

    return calls.select(key, ts, ident, ok).groupBy(key).applyInPandas(run, f"{key} {kind[key].dataType.simpleString()}, {ident} {kind[ident].dataType.simpleString()}, passed boolean, state string")


def latency_stats(df: DataFrame, key: str, ms: str, payload: str) -> DataFrame:
    """Mean, linear-interpolated p95, extremes of latencies; mean and largest payload."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), F.percentile(ms, 0.95).alias("p95"), F.min(ms).alias("low"), F.max(ms).alias("high"), F.avg(payload).alias("payload_mean"), F.max(payload).alias("payload_max"))


def provider_stats(calls: DataFrame, key: str, ok: Column, ms: Column) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return calls.groupBy(key).agg(n.alias("calls"), good.alias("successes"), F.round(F.try_divide(good, n), 6).alias("success_rate"), F.round(F.avg(F.when(ok, ms)), 6).alias("mean_ms"))


def active_rules(versions: DataFrame) -> DataFrame:
    """The latest active version of each rule."""
    return latest(versions.where("is_active"), ["rule_key"], [F.col("created_at"), F.col("version")])


def job_time(version_created: Column, job_created: Column, touched: Column) -> Column:
    """The time by which a job counts: its version's, else its own, else when its files were last touched."""
    return F.coalesce(version_created, job_created, touched)
