"""Mixing sources to target weights by capped water-filling (DataFrame only).

Sources share the corpus's words by weight.  A source is clamped where its share
is above `max_epochs` times its size, and what it cannot take is shared out by
weight among the others, until no source is above its cap.  A source that gets
e epochs repeats every document floor(e) times and a seeded part of its
documents, worth the fraction, once more.

Defined cases: a null text has size 0; null sources form a source of their own
that sorts last.  Sources of size 0 have target 0.  Repeated rows (same doc_id)
are drawn alike.  Very long texts are counted whole.  An empty table gives an empty
result; the output's own columns replace those of docs with the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
#: passes over a source's draws; each fills what the one before left open
ROUNDS = 4


def words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(common.WORD))).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Three hexadecimal digits that order a source's documents at random."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) plus target.  One row per source; only the
    level (two sums) comes to the driver in each round of the filling."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    # sources are a dimension: a few dozen to thousands of rows
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1).cast("long"))
    rows = common.stored(rows.withColumn("cap", F.col("source_size") * max_epochs), "sources")
    first = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    rest, weight = first["words"] or 0, first["weight"] or 1
    total = rest
    while True:
        # a source is clamped where its share of what is left would pass its cap
        full = F.col("cap") * weight < F.col("weight") * rest
        got = rows.where(full).agg(F.sum("cap").alias("words"), F.sum("weight").alias("weight")).first()
        new_rest, new_weight = total - (got["words"] or 0), first["weight"] - (got["weight"] or 0) if first["weight"] else 1
        if (new_rest, new_weight) == (rest, weight) or new_weight == 0:
            break
        rest, weight = new_rest, new_weight
    full = F.col("cap") * weight < F.col("weight") * rest
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weight)))
    return rows.withColumn("target", target).drop("cap")


def repetitions(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs plus size, source_size, target and times (whole repetitions of each row)."""
    clash = [c for c in ("size", "source_size", "target", "times", "__draw") if c in docs.columns]
    base = docs.drop(*clash).withColumn("size", words(F.col("text"))).withColumn("__draw", draw(F.col("doc_id"), seed))
    small = common.stored(base.select("source", "__draw", "size").groupBy("source", "__draw").agg(F.sum("size").alias("size")), "draws")
    sources = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("whole", F.floor("epochs").cast("long")).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = sources.select(F.col("source").alias("__source"), "source_size", "target", "whole", "more")
    plan = common.stored(plan, "plan")
    # at most 4096 draws of each source, so a window over one source is bounded
    draws = small.join(plan, F.col("source").eqNullSafe(F.col("__source"))).where("more > 0").select("source", "__draw", "size", F.col("more").alias("gap"), F.lit(False).alias("taken"))
    all_rows, running = Window.partitionBy("source"), Window.partitionBy("source").orderBy("__draw")
    for _ in range(ROUNDS):
        # in order, what fits whole into the gap; then once more for the gap that is left
        live = ~F.col("taken") & (F.col("size") <= F.col("gap"))
        draws = draws.withColumn("take", live & (F.sum(F.when(live, F.col("size"))).over(running) <= F.col("gap")))
        draws = draws.withColumn("gap", F.col("gap") - F.coalesce(F.sum(F.when(F.col("take"), F.col("size"))).over(all_rows), F.lit(0)))
        draws = draws.withColumn("taken", F.col("taken") | F.col("take")).drop("take")
    chosen = common.stored(draws.where("taken").select(F.col("source").alias("__s"), F.col("__draw").alias("__d"), F.lit(1).cast("long").alias("__extra")), "chosen")
    # a row per source, and at most 4096 per source: broadcast where that is small
    small_enough = chosen.count() <= 1_000_000 and plan.count() <= 100_000
    bounded = F.broadcast if small_enough else (lambda df: df)
    return (
        base.join(bounded(plan), F.col("source").eqNullSafe(F.col("__source")))
        .join(bounded(chosen), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__draw") == F.col("__d")), "left")
        .withColumn("times", F.col("whole") + F.coalesce("__extra", F.lit(0)))
        .drop("__source", "__draw", "whole", "more", "__s", "__d", "__extra")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return repetitions(docs.select("doc_id", "source", "text"), **how).select(F.col("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken."""
    rows = repetitions(docs, **how).where("times > 0")
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*docs.columns)
