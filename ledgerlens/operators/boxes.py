"""Overlapping boxes of a page: pairs by tiles, and suppression in rounds.

boxes(page..., id, box struct<x0,y0,x1,y1>, priority).  Two boxes are the same table where
their intersection over union, or over the smaller one, is large; then three quarters of the smaller box lie in the
other one, and its centre does.  A box is therefore looked for, by its centre, in tiles that a larger box
covers; tiles are as wide as boxes of that size, a power of two, so that a box covers few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP, INSIDE = 0.75, 0.9


def _area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def same_pairs(boxes: DataFrame, page: list[str], overlap: float = OVERLAP, inside: float = INSIDE) -> DataFrame:
    """page, a, b: ids of boxes of a page that are the same, each pair once."""
    if min(overlap, inside) < 0.75:
        raise ValueError("a smaller share than 0.75 does not hold the centre")
    b = F.col("box")
    flat = boxes.select(*page, "id", *[b[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x1 > x0 AND y1 > y0")
    flat = flat.withColumn("area", _area(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).cast("int"))
    side = F.pow(F.lit(2.0), F.col("level"))
    tile = lambda x, s: F.floor(x / s).cast("long")
    covers = flat.withColumn("tx", F.explode(F.sequence(tile(F.col("x0"), side), tile(F.col("x1"), side)))).withColumn("ty", F.explode(F.sequence(tile(F.col("y0"), side), tile(F.col("y1"), side))))
    # a box meets those of its own level and of all larger ones that the page has
    levels = flat.groupBy(*page).agg(F.collect_set("level").alias("levels"))
    small = flat.join(levels, page).withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    at = F.pow(F.lit(2.0), F.col("at"))
    small = small.withColumn("tx", tile((F.col("x0") + F.col("x1")) / 2, at)).withColumn("ty", tile((F.col("y0") + F.col("y1")) / 2, at))
    on = [*page, "level", "tx", "ty"]
    names = ("id", "x0", "y0", "x1", "y1", "area")
    large = covers.select(*on, *[F.col(c).alias(f"l_{c}") for c in names])
    small = small.select(*page, F.col("at").alias("level"), "tx", "ty", *names)
    both = small.join(large, on)
    w = F.greatest(F.least("x1", "l_x1") - F.greatest("x0", "l_x0"), F.lit(0.0))
    h = F.greatest(F.least("y1", "l_y1") - F.greatest("y0", "l_y0"), F.lit(0.0))
    shared = w * h
    same = (shared > 0) & ((shared / (F.col("area") + F.col("l_area") - shared) >= overlap) | (shared / F.least("area", "l_area") >= inside))
    found = both.where((F.col("id") != F.col("l_id")) & same)
    # boxes of equal level meet from both sides
    return found.select(*page, F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b")).distinct()


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def suppressed(boxes: DataFrame, page: list[str], overlap: float = OVERLAP, inside: float = INSIDE) -> DataFrame:
    """boxes that stay: going by priority (of equals by id) a box stays unless it is the same as one that stays.

    In rounds, of all boxes at once: one that is not below any undecided box stays, those
    that it is the same as go.  A round settles at least the first box of every group
    that is left, and most of them in practice.
    """
    ranks = boxes.select(*page, "id", "priority")
    edges = same_pairs(boxes, page, overlap, inside)
    for side in ("a", "b"):
        edges = edges.join(ranks.withColumnRenamed("id", side).withColumnRenamed("priority", f"p_{side}"), [*page, side])
    above = (F.col("p_a") > F.col("p_b")) | ((F.col("p_a") == F.col("p_b")) & (F.col("a") < F.col("b")))
    edges = _cut(edges.select(*page, F.when(above, F.col("a")).otherwise(F.col("b")).alias("high"), F.when(above, F.col("b")).otherwise(F.col("a")).alias("low")))
    gone = edges.select(*page, F.col("low").alias("id")).limit(0)
    while not edges.isEmpty():
        stays = edges.select(*page, "high").distinct().join(edges.select(*page, F.col("low").alias("high")).distinct(), [*page, "high"], "left_anti")
        out = _cut(edges.join(stays, [*page, "high"], "left_semi").select(*page, F.col("low").alias("id")).distinct())
        gone = gone.unionByName(out)
        left = edges.join(out.withColumnRenamed("id", "low"), [*page, "low"], "left_anti")
        edges = _cut(left.join(out.withColumnRenamed("id", "high"), [*page, "high"], "left_anti"))
    return boxes.join(gone, [*page, "id"], "left_anti")
