"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, fitted on a bounded sample, so
that the leading coordinates hold most of what tells vectors apart.  Rows are cut
into tiles along the leading axes; two tiles are compared only if their bounding
boxes are nearer than a pair at the threshold can be.  Within a pair of tiles the
leading coordinates are multiplied first; the product of the suffix norms bounds
what the other coordinates can add, and pairs that cannot reach the threshold
stop there.  What is left is decided by the whole cosine in double precision; where
it is within NEAR of the threshold, on the original components.  The rotation only
orders the work: every linked pair is found whatever it is.

Vectors that are equal in all components are one class with a multiplicity.  A
tile pair returns the links per class and a spanning forest, never its pairs.  Cells
of more than `tile_rows` classes are dealt out to several tiles.

Defined cases: vectors that are null, empty, zero or have null or non-finite
components link with nothing and are kept.  Vectors of different length do not
link.  Rows that repeat a vec_id are separate vectors for n_links, and meet in
component_id by their vec_id.  Ties at the threshold link: the cosine counts that the
original components give, added up in extended precision and rounded to double once.  An empty table gives an
empty result; columns other than vec_id and embedding are not looked at, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.95
#: rows of the sample that the axes and the cuts are fitted on
SAMPLE_ROWS = 4096
#: rows of a tile
TILE_ROWS = 4096
#: leading coordinates that are compared first
LEADING = 16
#: leading axes that tiles are cut along
CUT_AXES = 6
SLACK = 1e-5
#: distance from the threshold within which rotated vectors do not decide
NEAR = 1e-9


def _unit(block: np.ndarray) -> np.ndarray:
    return block / np.sqrt((block * block).sum(1, keepdims=True))


class Axes:
    """Rotation and cuts, fitted on a bounded sample of one vector length."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        unit = _unit(sample)
        # no centring: the rotation must keep the cosine
        _, vectors = np.linalg.eigh(unit.T @ unit)
        self.rotation = vectors[:, ::-1].copy()
        self.tree: list = self._cut(unit @ self.rotation, cells, 0)

    def _cut(self, rows: np.ndarray, cells: int, depth: int) -> list:
        """Halves along the widest leading axis until there are as many cells."""
        if cells <= 1 or len(rows) < 2:
            return []
        lead = rows[:, :CUT_AXES]
        axis = int(np.argmax(lead.std(0)))
        at = float(np.median(lead[:, axis]))
        low = lead[:, axis] <= at
        return [axis, at, self._cut(rows[low], cells // 2, depth + 1), self._cut(rows[~low], cells - cells // 2, depth + 1)]

    def rotated(self, rows: np.ndarray) -> np.ndarray:
        return _unit(rows / np.abs(rows).max(1, keepdims=True)) @ self.rotation

    def cells(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        names: list[int] = [0]

        def walk(tree: list, at: np.ndarray) -> None:
            if not tree:
                out[at] = names[0]
                names[0] += 1
                return
            low = rows[at, tree[0]] <= tree[1]
            walk(tree[2], at[low])
            walk(tree[3], at[~low])

        walk(self.tree, np.arange(len(rows)))
        return out


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of table(vec_id, embedding)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0)
    # adding 0.0 makes -0.0 and 0.0 equal; scaling by the largest component keeps squares in range
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # two 64-bit hashes name a class of equal vectors
    named = F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("h"), F.hash("v").alias("g")))
    rows = common.stored(rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("class", named), "vectors")
    classes = common.stored(
        rows.where("ok").groupBy("class").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("low")).select(F.xxhash64("class").alias("id"), "v", F.size("v").alias("dim"), "times", "low"),
        "classes",
    )
    dims = [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]
    links = None
    for dim, n in dims:
        got = _links(classes.where(F.col("dim") == dim).select("id", "v", "times"), dim, n, threshold, tile_rows, sample_rows)
        links = got if links is None else links.unionByName(got)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = common.stored(links, "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    edges = links.where("b is not null").select("a", "b")
    # components are over vec_ids: a class stands for its smallest; rows that share a vec_id meet in it
    ids = common.stored(classes.select("id", "low", "times"), "ids")
    by_low = edges.join(ids.select(F.col("id").alias("a"), F.col("low").alias("la")), "a").join(ids.select(F.col("id").alias("b"), F.col("low").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    members = rows.where("ok").select(F.xxhash64("class").alias("id"), "vec_id")
    shared = members.join(ids.select("id", "low"), "id").where("vec_id <> low").groupBy("vec_id").agg(F.collect_set("low").alias("lows")) if _repeats(rows) else None
    if shared is not None:
        own = shared.select(F.col("vec_id").alias("a"), F.explode("lows").alias("b"))
        by_low = by_low.unionByName(own)
    comps = common.stored(common.components(by_low), "components")
    per_class = common.stored(
        ids.join(counts, "id", "left")
        .join(comps, F.col("low") == F.col("node"), "left")
        .select(F.col("id").alias("id"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id")),
        "classes",
    )
    keyed = rows.select("vec_id", F.xxhash64("class").alias("id"), "ok")
    return (
        keyed.join(per_class, keyed["id"].eqNullSafe(per_class["id"]) & F.col("ok"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _repeats(rows: DataFrame) -> bool:
    r = rows.where("ok").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("d")).first()
    return r["n"] != r["d"]


def _links(classes: DataFrame, dim: int, n: int, threshold: float, tile_rows: int, sample_rows: int) -> DataFrame:
    """Rows (a, null, n): a class's links with other classes; (a, b, null): forest edges."""
    spark = classes.sparkSession
    sample = classes.select("v").orderBy("id").limit(sample_rows).toPandas()["v"]
    axes = Axes(np.stack([np.asarray(x, dtype=np.float64) / np.abs(x).max() for x in sample]), max(1, -(-n // tile_rows)))
    shared = spark.sparkContext.broadcast(axes)

    def rotate(frames):
        a = shared.value
        for b in common.batches(frames, 4096):
            raw = np.asarray(b["v"].flatten(), dtype=np.float64).reshape(-1, dim)
            block = a.rotated(raw)
            lead = block[:, : min(CUT_AXES, dim)]
            yield pa.RecordBatch.from_arrays([b["id"], b["times"], pa.array(a.cells(block).astype(np.int32)), pa.FixedSizeListArray.from_arrays(lead.ravel(), lead.shape[1]).cast(pa.list_(pa.float64())), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "times", "cell", "lead", "data"])

    tiles = common.stored(classes.select("id", "v", "times").mapInArrow(rotate, "id long, times long, cell int, lead array<double>, data binary"), "tiles")
    lead = range(min(CUT_AXES, dim))
    boxes = tiles.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in lead for name, f in (("lo", F.min), ("hi", F.max))]).toPandas().sort_values("cell")
    lo, hi = (boxes[[f"{name}{k}" for k in lead]].to_numpy() for name in ("lo", "hi"))
    reach = 2.0 - 2.0 * threshold + 1e-9  # squared distance of unit vectors at the threshold
    names, blocks = boxes["cell"].tolist(), (-(-boxes["n"] // tile_rows)).tolist()
    pairs = []
    for i, cell in enumerate(names):  # no more cells than rows of the sample
        gap = np.maximum(0.0, np.maximum(lo[i:] - hi[i], lo[i] - hi[i:]))
        pairs += [(cell, blocks[i], names[j], blocks[j]) for j in (i + np.flatnonzero((gap * gap).sum(1) <= reach)).tolist()]
    todo = F.broadcast(spark.createDataFrame(pairs, "a int, na int, b int, nb int"))
    count = spark.createDataFrame(list(zip(names, blocks, strict=True)), "cell int, blocks int")
    # a cell of many vectors is dealt out to tiles, so that no task holds more than two of tile_rows
    tiles = tiles.drop("lead").join(F.broadcast(count), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    first = tiles.join(todo, F.col("cell") == F.col("a")).select("a", F.col("block").alias("ablock"), "b", every("nb"), "id", "times", "data", F.lit(0).alias("side")).withColumnRenamed("other", "bblock").where("a <> b OR bblock >= ablock")
    second = tiles.join(todo, F.col("cell") == F.col("b")).select("a", every("na"), "b", F.col("block").alias("bblock"), "id", "times", "data", F.lit(1).alias("side")).withColumnRenamed("other", "ablock").where("a <> b OR bblock > ablock")
    # a tile moves once for every tile that its cell's box can reach
    dealt = first.unionByName(second)
    return dealt.groupBy("a", "ablock", "b", "bblock").applyInPandas(_compare(dim, threshold, shared), "a long, b long, n long")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b.  Scaling by powers of two is exact."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]).astype(np.longdouble) for x in (a, b))
    dot = lambda x, y: (x * y).sum(1)
    return (dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))).astype(np.float64)


def _compare(dim: int, threshold: float, shared):
    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        in_first = (frame["side"] == 0).to_numpy()
        raw = np.frombuffer(b"".join(frame["data"]), dtype=np.float64).reshape(-1, dim)
        # the original components travel, and are rotated where they are compared
        data = shared.value.rotated(raw)
        ids, times = frame["id"].to_numpy(), frame["times"].to_numpy()
        left = np.flatnonzero(in_first)
        same = key[:2] == key[2:]
        right = left if same else np.flatnonzero(~in_first)
        lead = min(LEADING, dim)
        # the suffix norm as one more coordinate: one product gives the upper bound
        suffix = np.sqrt((data[:, lead:] ** 2).sum(1, keepdims=True))
        bound = np.hstack([data[:, :lead], suffix]).astype(np.float32)
        links = np.zeros(len(ids), dtype=np.int64)
        parent = np.arange(len(ids))

        edges: list[tuple[int, int]] = []
        block = 512
        for i in range(0, len(left), block):
            a = left[i : i + block]
            b = right[i:] if same else right
            may = bound[a] @ bound[b].T >= threshold - SLACK
            at = np.flatnonzero(may.ravel())
            if not len(at):
                continue
            for k in range(0, len(at), 200_000):
                x, y = np.divmod(at[k : k + 200_000], len(b))
                x, y = a[x], b[y]
                if same:
                    some = x < y
                    x, y = x[some], y[some]
                product = np.einsum("ij,ij->i", data[x], data[y])
                some = product >= threshold
                close = np.flatnonzero(np.abs(product - threshold) <= NEAR)
                some[close] = cosines(raw[x[close]], raw[y[close]]) >= threshold
                x, y = x[some], y[some]
                links += np.bincount(x, weights=times[y], minlength=len(ids)).astype(np.int64)
                links += np.bincount(y, weights=times[x], minlength=len(ids)).astype(np.int64)
                # only pairs that join two trees stay
                while len(x):
                    while (up := parent[parent]).tobytes() != parent.tobytes():
                        parent[:] = up
                    some = parent[x] != parent[y]
                    x, y = x[some], y[some]
                    if not len(x):
                        break
                    # one edge for each tree at a time, so that no cycle forms
                    hi, low = np.maximum(parent[x], parent[y]), np.minimum(parent[x], parent[y])
                    tree, one = np.unique(hi, return_index=True)
                    edges += zip(x[one].tolist(), y[one].tolist(), strict=True)
                    parent[tree] = low[one]
        some = np.flatnonzero(links)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.concat([
            pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), dtype="Int64"), "n": pd.array(links[some], dtype="Int64")}),
            pd.DataFrame({"a": ids[e[:, 0]], "b": pd.array(ids[e[:, 1]], dtype="Int64"), "n": pd.array([None] * len(e), dtype="Int64")}),
        ])

    return compare
