"""Exact top-k search by a Voronoi kNN join.

The k largest inner products of every query over all other rows.  With one more
coordinate, sqrt(M - |x|^2) for data (M the largest squared norm) and 0 for queries,
the largest inner product is the smallest distance, so that the triangle inequality
bounds it.

1. Pivots are drawn from a bounded sample; every row goes to the cell of its nearest
   pivot.  The summary of a cell holds the distances of its k + 1 nearest rows.
2. Cells of queries are put together to groups of GROUP queries, neighbours first (a
   larger cell gives several groups).  From the summaries alone follows, for each query,
   a distance within which it has k others, and for each group and cell of data the ring
   around its pivot outside which no row can be nearer than that.
3. A row is copied to the groups whose ring holds it, and no others.  Each group meets its
   rows in blocks of BLOCK; a block gives every query its own k best by exact
   integer scores, and these are ranked at last.

Where vectors tell nothing apart (rings hold all rows) this is a search of the stated
queries over all rows in blocks; rows are then copied once for each GROUP queries.

Components become floor(scale * x).  Scores are exact: products whose sums stay below 2^53
by double multiplication, others by Python's integers.

Defined cases: vectors that are null, empty or hold null or non-finite components
take no part.  Vectors of different length do not meet.  Rows that share a vec_id are separate
rows, each a query of its own; a row is no candidate of its own only.  Null vec_ids are
candidates and sort last in ties.  Ties go to the smaller vec_id.  Scores beyond a long are
ranked exactly and given as the nearest long.  An empty table gives an empty result; columns
other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 10
SCALE = 1024
#: rows of the sample that pivots are drawn from
SAMPLE_ROWS = 4096
#: cells at most
PIVOTS = 128
#: queries of a group, and rows of a block
GROUP, BLOCK = 2048, 16384
#: products of one multiplication
PRODUCTS = 4_000_000
#: relative room for rounding in bounds; scores need none
SLACK = 1e-9
_LONG = (1 << 63) - 1
FIELDS = "query_id long, uid long, vec_id long, score long, exact string"


def search(table: DataFrame, is_query, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of table(vec_id, embedding) where `is_query`."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # floor in double; 0.0 is added as floor may give -0.0
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("uid", F.monotonically_increasing_id())
    rows = common.stored(rows.select("uid", "vec_id", "asks", F.size("v").alias("dim"), "v"), "vectors")
    found = None
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked")).collect():
        if r["asked"]:
            got = _of_length(rows.where(F.col("dim") == r["dim"]), r["dim"], r["n"], k, scale, pivots, group, block)
            found = got if found is None else found.unionByName(got)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def _points(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim) * scale)


class Cells:
    """Pivots drawn from a sample, in the space with one more coordinate."""

    def __init__(self, sample: np.ndarray, largest: float, pivots: int) -> None:
        self.largest = largest
        self.unit = max(1.0, float(np.sqrt(largest)))
        points = self.lifted(sample, False)
        # farthest first, from the first row: pivots spread out over what the sample shows
        at = [0]
        far = ((points - points[0]) ** 2).sum(1)
        while len(at) < min(pivots, len(points)) and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[at[-1]]) ** 2).sum(1))
        self.pivots = points[at]

    def lifted(self, points: np.ndarray, asks: bool | np.ndarray) -> np.ndarray:
        """Points over the largest norm, with the coordinate that makes data equally long."""
        points = points / self.unit
        rest = np.sqrt(np.maximum(0.0, self.largest / self.unit**2 - (points * points).sum(1)))
        return np.column_stack([points, np.where(asks, 0.0, rest)])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of every point from every pivot."""
        return np.sqrt(np.maximum(0.0, ((points[:, None, :] - self.pivots[None, :, :]) ** 2).sum(2)))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (points * points).sum(1)[:, None] - 2 * points @ self.pivots.T + (self.pivots**2).sum(1)
        cell = square.argmin(1)
        return cell, np.sqrt(((points - self.pivots[cell]) ** 2).sum(1))


def _of_length(rows: DataFrame, dim: int, n: int, k: int, scale: int, pivots: int, group: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    sample = np.stack([np.floor(np.asarray(r, dtype=np.float64) * scale) for r in rows.orderBy(F.xxhash64("uid")).limit(SAMPLE_ROWS).select("v").toPandas()["v"]])
    floors = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    norm = F.aggregate(floors, F.lit(0.0), lambda a, x: a + x * x)
    size = rows.agg(F.max(norm).alias("norm"), F.max(F.array_max(F.transform(floors, F.abs))).alias("most")).first()
    cells = Cells(sample, size["norm"], pivots)
    exact = size["most"] ** 2 * dim >= 2.0**53
    shared = spark.sparkContext.broadcast(cells)

    def assign(frames):
        c = shared.value
        for b in common.batches(frames, 4096):
            points = _points(b["v"], dim, scale)
            cell, far = c.nearest(c.lifted(points, False))
            asks = np.asarray(b["asks"].to_numpy(zero_copy_only=False), dtype=bool)
            own, _ = c.nearest(c.lifted(points, True))
            yield pa.RecordBatch.from_arrays(
                [b["uid"], b["vec_id"], b["asks"], pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.where(asks, own, -1).astype(np.int32)), pa.array([x.tobytes() for x in points], pa.binary())],
                names=["uid", "vec_id", "asks", "cell", "far", "q_cell", "data"],
            )

    placed = common.stored(rows.select("uid", "vec_id", "asks", "v").mapInArrow(assign, "uid long, vec_id long, asks boolean, cell int, far double, q_cell int, data binary"), "placed")
    # at most PIVOTS rows: the groups of each cell of queries
    parts = spark.createDataFrame(_groups(placed, cells, group), "q_cell int, first int, parts int")
    part = F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    queries = placed.where("asks").join(F.broadcast(parts), "q_cell").select(part.alias("part"), "uid", "vec_id", "data")
    rings = common.stored(_rings(placed, queries, cells, dim, k), "rings")
    # a row for each group and cell at most
    rings = F.broadcast(rings) if rings.count() <= common.BROADCAST_ROWS else rings
    data = placed.join(rings, "cell").where("far between low and high").select("part", "uid", "vec_id", "data")
    blocks = max(1, -(-n // block))
    of = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    both = data.select("part", of.alias("block"), F.lit(False).alias("asks"), "uid", "vec_id", "data").unionByName(
        queries.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "uid", "vec_id", "data")
    )
    best = both.groupBy("part", "block").applyInArrow(_solve(dim, k, exact), FIELDS)
    return _ranked(best, k, exact)


def _groups(placed: DataFrame, cells: Cells, group: int) -> list[tuple[int, int, int]]:
    """(q_cell, first, parts): the groups that a cell's queries are dealt out to."""
    asked = {r["q_cell"]: r["n"] for r in placed.where("asks").groupBy("q_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = cells.pivots
    between = ((p[:, None, :] - p[None, :, :]) ** 2).sum(2)
    out, part, held, last = [], 0, 0, None
    while asked:  # neighbours first: from each cell to the nearest that is left
        cell = min(asked, key=lambda c: (0.0 if last is None else between[last, c], c))
        n, last = asked.pop(cell), cell
        if held and held + n > group:
            part, held = part + 1, 0
        pieces = -(-n // group)
        out.append((int(cell), part, pieces))
        part, held = (part + pieces, 0) if pieces > 1 else (part, held + n)
    return out


def _rings(placed: DataFrame, queries: DataFrame, cells: Cells, dim: int, k: int) -> DataFrame:
    """cell, part, low, high: the distances from a cell's pivot at which a group of queries
    may have a row among its k nearest."""
    order = Window.partitionBy("cell").orderBy("far")
    nearest = placed.select("cell", "far").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    summary = [(r["cell"], r["far"]) for r in nearest.collect()]  # at most PIVOTS * (k + 1) numbers
    at, far = np.array([s[0] for s in summary], dtype=np.int64), np.array([s[1] for s in summary])
    shared = queries.sparkSession.sparkContext.broadcast((cells, at, far))

    def bounds(frames):
        c, at, far = shared.value
        for b in common.batches(frames, 256):
            points = np.frombuffer(b"".join(b["data"].to_pylist()), dtype=np.float64).reshape(-1, dim)
            gap = c.distances(c.lifted(points, True))
            # k others and the query itself are within this distance of a query
            theta = np.partition(gap[:, at] + far, k, axis=1)[:, k : k + 1] if len(far) > k else np.inf
            theta = theta + SLACK * (1.0 + gap.max(1, keepdims=True))
            part = b["part"].to_numpy()
            for x in np.unique(part):
                # a row at distance f from the pivot is at least |gap - f| from the query
                low, high = (gap - theta)[part == x].min(0), (gap + theta)[part == x].max(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(np.full(len(low), x, dtype=np.int32)), pa.array(low), pa.array(high)], names=["cell", "part", "low", "high"])

    found = queries.select("part", "data").mapInArrow(bounds, "cell int, part int, low double, high double")
    return found.groupBy("cell", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, of equal ones those furthest left."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(scores >= kth)
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _solve(dim: int, k: int, exact: bool):
    def solve(table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        uid = table["uid"].combine_chunks().to_numpy()
        ids = table["vec_id"].to_pandas()
        # null vec_ids sort last
        order = np.lexsort((uid, ids.fillna(0).to_numpy().astype(np.int64), ids.isna().to_numpy()))
        points = np.frombuffer(b"".join(table["data"].to_pylist()), dtype=np.float64).reshape(-1, dim)
        q, d = order[asks[order]], order[~asks[order]]
        out = []
        if len(q) and len(d):
            right = points[d].T if not exact else _whole(points[d]).T
            for i in range(0, len(q), max(1, PRODUCTS // len(d))):
                a = q[i : i + max(1, PRODUCTS // len(d))]
                scores = (points[a] if not exact else _whole(points[a])) @ right
                # a query is no candidate of its own: one more than k, and it is taken out
                x, y = _top(scores, k + 1)
                other = uid[a[x]] != uid[d[y]]
                x, y = x[other], y[other]
                out.append((a[x], d[y], scores[x, y]))
        at, to, score = (np.concatenate([o[j] for o in out]) for j in range(3)) if out else ([], [], [])
        at, to = np.asarray(at, dtype=np.int64), np.asarray(to, dtype=np.int64)
        text = [str(int(s)) for s in score] if exact else [None] * len(at)
        score = [max(-_LONG - 1, min(_LONG, int(s))) for s in score]
        vec = table["vec_id"].combine_chunks()
        return pa.table({"query_id": vec.take(pa.array(at)), "uid": pa.array(uid[at], pa.int64()), "vec_id": vec.take(pa.array(to)), "score": pa.array(score, pa.int64()), "exact": pa.array(text, pa.string())})

    return solve


def _whole(points: np.ndarray) -> np.ndarray:
    """Python's integers, for products that doubles do not hold."""
    return np.array([[int(x) for x in row] for row in points.tolist()], dtype=object).reshape(points.shape)


def _ranked(best: DataFrame, k: int, exact: bool) -> DataFrame:
    """The k best of what the blocks gave."""
    if not exact:
        order = [F.desc("score")]
    else:  # numbers of any length by sign, digits and text
        minus = F.startswith("exact", F.lit("-"))
        signed = F.when(minus, -F.length("exact")).otherwise(F.length("exact"))
        order = [F.desc(signed), F.when(minus, F.col("exact")).asc(), F.desc("exact")]
    over = Window.partitionBy("uid").orderBy(*order, F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(over).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
