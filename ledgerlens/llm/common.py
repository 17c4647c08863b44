"""Shared pieces of the training-data operators: tables in the shared folder,
distributed connected components, and numpy word scanning."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# freed Arrow memory goes back to the C library, and from there to the machine at a task's end
pa.set_memory_pool(pa.system_memory_pool())

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir of the session.

    Only where the session has none and runs on this machine alone (tests), a
    temporary folder is set; on a cluster that would lose data, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "ledgerlens-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: seconds between two times that what is no longer needed is cleared away
CLEAR_S = 2.0
_CLEARED = [0.0]
#: rows of an Arrow batch between Spark and its Python workers
ARROW_ROWS = 1000


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage
    so that a lost executor costs no recomputation of what is stored."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Spark's Arrow batches are held whole on either side of a worker's pipe, and texts are long
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    df.write.parquet(path)
    # what led to the table is not needed again: with the plan gone, its shuffle files can go
    # (small tables that follow one another closely are cleared away together)
    if time.monotonic() - _CLEARED[0] > CLEAR_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _CLEARED[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: rows of a small table that may be broadcast, its count checked
BROADCAST_ROWS = 1_000_000


def matching(df: DataFrame, keys: DataFrame, on: str | list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose `on` is among the (distinct, stored) keys.

    The keys are broadcast only when their count is checked to be at most
    `limit`; beyond it an ordinary shuffled semi join does the same.
    """
    if keys.count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


#: edges of which one task keeps a spanning forest
FOREST_EDGES = 100_000


def _forest(frames: Iterator) -> Iterator:
    """Of the edges of each buffer, those that a spanning forest needs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in frames:
        if len(parent) > 4 * FOREST_EDGES:
            parent.clear()
        keep = []
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            ru, rv = root(u), root(v)
            keep.append(ru != rv)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
        yield b.filter(pa.array(keep, pa.bool_()))


def _labels(frames: Iterator) -> Iterator:
    """Each node that is not the smallest of its component, with that one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in frames:
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges(a, b)` (long ids): node, component (the
    smallest node reachable).  Alternating large-star / small-star contraction;
    every round is a few shuffles whose hot keys pre-aggregate or split, and is
    stored in the shared folder.  No link is collected."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    # a forest of each chunk of edges does for all of them; a chunk has FOREST_EDGES on average
    chunks = -(-edges.count() // FOREST_EDGES)
    if chunks:
        edges = edges.repartition(chunks).mapInArrow(_forest, "u long, v long").distinct()
    cur = stored(edges, "cc")
    if 0 < cur.count() <= FOREST_EDGES:  # few enough for one task to finish
        return stored(cur.repartition(1).mapInArrow(_labels, "node long, component long"), "cc")
    for k in range(max_rounds + 1):
        if cur.isEmpty():
            break
        if k == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc")
        # each neighbour above u goes to the smallest of u's neighbourhood
        large = stored(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc"
        )
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        # each neighbour below u, and u itself, go to the smallest of these
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = stored(small, "cc")
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = cur.agg(*mark).first() == new.agg(*mark).first()
        cur = new
        if same:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))


# ---------------------------------------------------------------- numpy text

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit words (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse (mod 2^64), at least n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        ones = np.full(size, _BASE, dtype=np.uint64)
        ones[0] = 1
        _POWERS["up"] = np.cumprod(ones, dtype=np.uint64)
        ones[:] = _INV
        ones[0] = 1
        _POWERS["down"] = np.cumprod(ones, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes."""
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = _IS_WORD[raw]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of the text with A-Z lower-cased, in order.

    Words are runs of bytes other than 20 and 09-0D; as all of these are ASCII,
    the UTF-8 bytes split where the code points do.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    return hashes_between(raw, *word_bounds(raw))


def hashes_between(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end)."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MUL)


#: bytes of a batch that are worked on at a time; numpy needs some ten times as many
BATCH_BYTES = 4 << 20


def batches(frames: Iterator, size: int) -> Iterator:
    """Arrow record batches cut to at most `size` rows, and to BATCH_BYTES where that
    is more than one row."""

    def cut(b, rows: int) -> Iterator:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            if part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                yield from cut(part, -(-part.num_rows // 2))
            else:
                yield part

    for b in frames:
        yield from cut(b, size)
    _give_back()


def _give_back() -> None:
    """Return what a finished task has freed to the machine: Python workers live
    on, and the allocator would keep the task's peak."""
    if len(_POWERS.get("up", ())) > 1 << 17:  # a very long text has been there
        _POWERS.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass
