"""Exact Jaccard self-join of documents on word shingles.

A document is the set of its distinct 5-word shingles (its whole word sequence,
if shorter).  Two documents link when their sets' Jaccard similarity is at least
the threshold.  The join is exact and never looks at all pairs of a group:

1. One pass counts shingles in a sketch of fixed size.  It only serves to order
   shingles from rare to common; any order gives the same result.
2. Documents with equal sets form one class.  Each document emits the first
   n - ceil(t n) + 1 of its shingles in that order: sets that link share one.
3. Rows meet by shingle, in size order.  They are cut into size-banded tiles, in
   which sizes allow the similarity, and every member is paired with the first of
   its tile (a star); these pairs are verified, and the bitmap of how a member
   differs from its centre is kept.
4. The stars' components are contracted.  Only members of *different* components
   that still share a shingle are compared, tile by tile, and pairs whose hashed
   bitmap signatures bound the overlap below what is needed stop there: a bit
   that is set in one signature alone stands for a shingle of one set alone.
   Members of one centre are also bounded by the bitmaps of their differences
   from it, which are small where whole sets would fill a bitmap.  At first each
   member tries only the one that looks nearest; after some rounds of contraction
   all that is left is compared.
5. What is left is decided by intersecting the sorted arrays of shingles.

Links within a component that was already found are skipped, as they cannot
change it; links between different components are all found.

Defined cases: documents without words, or with null text, have an empty set and
link with nothing; their component_id is their own doc_id.  Repeated rows (equal
doc_id) are kept and get equal results.  An empty table gives an empty result.
Rows with a null doc_id are kept.  They link with rows of an equal set, and get
the smallest id of its component; a set that only they have links with nothing.
Very long texts are read whole.  Columns other than doc_id and text are not looked
at, whatever their names.  Shingles and sets go by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
#: the threshold as a fraction, so that all bounds are exact in integers
NUM, DEN = 80, 100
#: buckets of the sketch of shingle counts, one saturating byte each
SKETCH = 1 << 23
BITS = 512
#: rounds in which members try the nearest of other components, before all are compared
ROUNDS = 3
#: stars tried in a group; what they leave is compared in full
STARS = 64
#: pairs of one set that are verified in one place
PLACE = 256


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = common.word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    m = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(m, k, dtype=np.uint64)
        for j in range(k):
            h = h * common._BASE + w[j : j + m]
    return np.unique(common.mix64(h))


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of sets of sizes a and b that link: ceil(t (a+b) / (1+t))."""
    return -(-(NUM * (a + b)) // (NUM + DEN))


def _first_shared(n, at, ns: np.ndarray, ats: np.ndarray) -> np.ndarray:
    """Whether sets can link of which a shingle at these places is the first that
    both have: at most the shingles from there on are shared.  Sets that link
    meet at their first shared shingle, so other meetings may be passed over."""
    return np.minimum(n - at, ns - ats) >= needed(n, ns)


def signature(h: np.ndarray) -> np.ndarray:
    """Bitmap of the hashed shingles."""
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(h >> np.uint64(20)).astype(np.int64) % BITS] = 1
    return np.packbits(bits)


def _class(h: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        one = int(common.mix64(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h))]))[0])
    return one - (1 << 64 if one >> 63 else 0)


def _members_and_sketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(SKETCH, dtype=np.uint8)
    some = False
    for b in common.batches(frames, 512):
        out = {"n": [], "one": []}
        for text in b["text"].to_pylist():
            h = shingles(text)
            out["n"].append(len(h))
            out["one"].append(_class(h) if len(h) else 0)
            if len(h):
                some = True
                count(sketch, h)
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(out[c], pa.int64()) for c in ("n", "one")), pa.nulls(b.num_rows, pa.binary())], names=["doc_id", "n", "one", "sketch"])
    if some:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed(sketch)], pa.binary())], names=["doc_id", "n", "one", "sketch"])


def count(sketch: np.ndarray, h: np.ndarray) -> None:
    """One more for each distinct shingle's bucket, up to 255."""
    at = (h % np.uint64(SKETCH)).astype(np.int64)
    v = sketch[at]
    sketch[at] = v + (v < 255)


def packed(sketch: np.ndarray) -> bytes:
    return zlib.compress(sketch.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def _added(a: bytes, b: bytes) -> bytes:
    x, y = unpacked(a), unpacked(b)
    return packed(np.where(x > 255 - y, np.uint8(255), x + y))


def _sum_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in common.batches(frames, 1):
        one = b["sketch"][0].as_py()
        total = one if total is None else _added(total, one)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], names=["sketch"])


def gathered(sketches: DataFrame, fan_in: int = 8) -> np.ndarray:
    """The sum of the tasks' sketches, added up in a tree of stored tables; only
    the last one, of fixed size, comes to the driver."""
    n = sketches.count()
    while n > 1:
        n = -(-n // fan_in)
        sketches = common.stored(sketches.repartition(n).mapInArrow(_sum_of, "sketch binary"), "sketch")
        n = sketches.count()
    row = sketches.first()
    return unpacked(bytes(row[0])) if row else np.zeros(SKETCH, dtype=np.uint8)


def _prefix_rows(shared, num: int, den: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        seen: set[int] = set()  # classes of this task: copies emit their rows once
        for b in common.batches(frames, 512):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for text in b["text"].to_pylist():
                h = shingles(text)
                n = len(h)
                if not n:
                    continue
                name = _class(h)
                if name in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                p = n - -(-(num * n) // den) + 1
                order = np.lexsort((h, sketch[(h % np.uint64(SKETCH)).astype(np.int64)]))[:p]
                for c, v in zip(cols, (h[order].view(np.int64), np.full(p, name, dtype=np.int64), np.full(p, n, dtype=np.int32), np.arange(p, dtype=np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "class", "n", "at"])

    return run


def _groups(frames: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, dict]]:
    """Batches of rows sorted by `key`, cut so that no key is split; with the
    starts of the keys.  Keys with one row are left out."""
    carry: dict[str, np.ndarray] | None = None

    def cut(cols: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, dict]]:
        key = cols["key"]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate([start, [len(key)]]))
        keep = np.repeat(size > 1, size)
        if keep.any():
            cols = {c: v[keep] for c, v in cols.items()}
            size = size[size > 1]
            yield np.concatenate([[0], np.cumsum(size)]), cols

    for b in frames:
        if not b.num_rows:
            continue
        cols = {c: (b[c].to_numpy() if not pa.types.is_binary(b[c].type) else np.array(b[c].to_pylist(), dtype=object)) for c in names}
        if carry is not None:
            cols = {c: np.concatenate([carry[c], cols[c]]) for c in names}
        last = int(np.searchsorted(cols["key"], cols["key"][-1]))
        if last:
            yield from cut({c: v[:last] for c, v in cols.items()})
        carry = {c: v[last:] for c, v in cols.items()}
    if carry is not None:
        yield from cut(carry)


def _stars(num: int, den: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of groups: star pairs (b set; n: how often they met here; at: 1 if
        nothing else tells of them, as in a group of two), and the members of
        larger groups (key set)."""
        met: dict[tuple[int, int], int] = {}
        only: set[tuple[int, int]] = set()

        def told() -> pa.RecordBatch:
            k = len(met)
            a, b = (pa.array([p[j] for p in met], pa.int64()) for j in (0, 1))
            out = pa.RecordBatch.from_arrays([a, b, pa.nulls(k, pa.int64()), pa.array(list(met.values()), pa.int32()), pa.array([int(p in only) for p in met], pa.int32())], names=["a", "b", "key", "n", "at"])
            met.clear()
            only.clear()
            return out

        for start, g in _groups(frames, ("key", "class", "n", "at")):
            members = []
            for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                cls, first = np.unique(g["class"][i:j], return_index=True)
                if len(cls) < 2:
                    continue
                first.sort()
                rows = i + first  # one row per class, in size order
                n, at, cls = g["n"][rows].astype(np.int64), g["at"][rows].astype(np.int64), g["class"][rows]
                # a star of the smallest set, then of the smallest that it did not reach, ...
                left, tries = np.arange(len(rows)), 0
                while len(left) > 1 and tries < STARS:
                    c, others = left[0], left[1:]
                    # the tile of this centre: sizes up to n / t
                    ok = (n[others] <= n[c] * den // num) & _first_shared(n[c], at[c], n[others], at[others])
                    for x in others[ok].tolist():
                        pair = (int(cls[c]), int(cls[x]))
                        met[pair] = met.get(pair, 0) + 1
                        if len(rows) == 2:
                            only.add(pair)
                    left, tries = others[~ok], tries + 1
                if len(rows) > 2:
                    members.append(rows)
            if len(met) > 100_000:
                yield told()
            m = np.concatenate(members) if members else np.empty(0, dtype=np.int64)
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(g["class"][m]), pa.nulls(len(m), pa.int64()), pa.array(g["key"][m]), pa.array(g["n"][m]), pa.array(g["at"][m])], names=["a", "b", "key", "n", "at"])
        if met:
            yield told()

    return run


_POP = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def _across(num: int, den: int, nearest: bool):
    """nearest: of each member only the pair that the bitmaps show closest.  Besides
    pairs, the keys of all groups that have one."""

    def batch(pairs: list[tuple[int, int, int]], keys: list[int]) -> pa.RecordBatch:
        none = len(pairs), len(keys)
        cols = [pa.array([*(p[k] for p in pairs), *[None] * none[1]], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([*[None] * none[0], *keys], pa.int64())], names=["a", "b", "apart", "key"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a group's members in different components that sizes,
        positions and bitmaps allow to link."""
        told: set[tuple[int, int]] = set()
        for start, g in _groups(frames, ("key", "class", "n", "at", "comp", "bits", "centre", "delta")):
            out: list[tuple[int, int, int]] = []
            live: list[int] = []
            for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                comp = g["comp"][i:j]
                if (comp == comp[0]).all():
                    continue
                n, at, cls = g["n"][i:j].astype(np.int64), g["at"][i:j].astype(np.int64), g["class"][i:j]
                bits, delta = (np.frombuffer(b"".join(g[c][i:j]), dtype=np.uint8).reshape(j - i, -1) for c in ("bits", "delta"))
                centre = g["centre"][i:j]
                for x in range(j - i - 1):
                    end = int(np.searchsorted(n, n[x] * den // num, side="right"))
                    y = x + 1 + np.flatnonzero(comp[x + 1 : end] != comp[x])
                    y = y[(cls[y] != centre[x]) & (centre[y] != cls[x])]  # those have been verified
                    if not len(y):
                        continue
                    y = y[_first_shared(n[x], at[x], n[y], at[y])]
                    if not len(y):
                        continue
                    least = needed(n[x], n[y])
                    only_x = _POP[bits[x] & ~bits[y]].sum(1, dtype=np.int64)
                    only_y = _POP[~bits[x] & bits[y]].sum(1, dtype=np.int64)
                    ok = np.minimum(n[x] - only_x, n[y] - only_y) >= least
                    # relative to a common centre, sets differ where their deltas do
                    apart = _POP[delta[x] ^ delta[y]].sum(1, dtype=np.int64)
                    common_centre = (centre[y] == centre[x]) & (centre[x] != 0)
                    ok &= ~common_centre | (apart <= n[x] + n[y] - 2 * least)
                    apart = np.where(common_centre, apart, only_x + only_y)
                    y, apart = y[ok], apart[ok]
                    if len(y) and (not live or live[-1] != g["key"][i]):
                        live.append(int(g["key"][i]))
                    if nearest and len(y):
                        y, apart = y[[apart.argmin()]], apart[[apart.argmin()]]
                    for k, d in zip(y.tolist(), apart.tolist(), strict=True):
                        pair = (int(cls[x]), int(cls[k]))
                        if pair not in told:
                            if len(told) > 100_000:
                                told.clear()
                            told.add(pair)
                            out.append((*pair, d))
                if len(out) > 50_000:
                    yield batch(out, live)
                    out, live = [], []
            if out or live:
                yield batch(out, live)

    return run


def _small(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, broadcast where its checked count is small."""
    return F.broadcast(df) if df.count() <= common.BROADCAST_ROWS else df


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, main), distinct, with ok: whether they link, and delta: the bitmap
    of b's difference from a.

    A pair moves one set: b's goes to where a's is held.  An `a` with many pairs is
    held in several places, so that none gets more than PLACE pairs on average.
    """
    pairs = common.stored(pairs.select("a", "b", "main"), "pairs")
    many = common.stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PLACE).cast("long").alias("places")).where("places > 1"), "many")
    dealt = pairs.join(_small(many), "a", "left").select("a", "b", "main", F.pmod(F.xxhash64("b"), F.coalesce("places", F.lit(1))).cast("int").alias("place"))
    dealt = common.stored(dealt, "dealt")
    held = common.stored(dealt.select("a", "place").distinct(), "held")
    own = sets.join(_small(held), F.col("class") == F.col("a")).select("a", "place", F.lit(None).cast("long").alias("b"), F.lit(None).cast("boolean").alias("main"), "set")
    other = sets.join(_small(dealt), F.col("class") == F.col("b")).select("a", "place", "b", "main", "set")
    rows = own.unionByName(other).repartition(_partitions(pairs.sparkSession), "a", "place").sortWithinPartitions("a", "place", F.asc_nulls_first("b"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, dtype=np.uint64)
        for batch in common.batches(frames, 500):
            out: list[tuple] = []
            for a, b, main, data in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["main"].to_pylist(), batch["set"], strict=True):
                y = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if b is None:
                    x = y.copy()  # sorted to stand before its pairs
                    continue
                apart = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(apart)) // 2
                out.append((a, b, main, both * (NUM + DEN) >= NUM * (len(x) + len(y)), signature(apart).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))], names=["a", "b", "main", "ok", "delta"])

    return common.stored(rows.mapInArrow(run, "a long, b long, main boolean, ok boolean, delta binary"), "tried")


def _sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, repeats: bool) -> DataFrame:
    """class, bitmap and sorted array of the wanted classes, each once."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(frames, 256):
            got = [h for h in map(shingles, b["text"].to_pylist()) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(h) for h in got], pa.int64()), pa.array([signature(h).tobytes() for h in got], pa.binary()), pa.array([h.tobytes() for h in got], pa.binary())], names=["class", "bits", "set"])

    ids = common.stored(reps.join(wanted, "class", "left_semi").select("doc_id"), "ids")
    found = common.matching(docs.where("doc_id is not null"), ids, "doc_id").mapInArrow(run, "class long, bits binary, set binary")
    # rows that repeat a doc_id bring a class again, or one that nobody wants
    return found.join(wanted, "class", "left_semi").dropDuplicates(["class"]) if repeats else found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = common.stored(docs.mapInArrow(_members_and_sketch, "doc_id long, n long, one long, sketch binary"), "members")
    # empty documents get a name of their own, so that they do not gather in one task
    members = first.where("n >= 0").select("doc_id", "n", F.when(F.col("n") > 0, F.col("one")).otherwise(F.xxhash64(F.lit("empty"), "doc_id")).alias("class"))
    shared = spark.sparkContext.broadcast(gathered(first.where("sketch is not null").select("sketch")))
    # only classes that a doc_id names can be fetched; documents without an id stay alone or join by equality
    reps = common.stored(members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "reps")

    rows = docs.where("doc_id is not null").mapInArrow(_prefix_rows(shared, NUM, DEN), "key long, class long, n int, at int")
    rows = rows.repartition(_partitions(spark), "key").sortWithinPartitions("key", "n", "class")
    found = common.stored(rows.mapInArrow(_stars(NUM, DEN), "a long, b long, key long, n int, at int"), "stars")
    stars = found.where("b is not null")
    # pairs of groups of two are all verified; in larger ones each member first tries
    # the centre that it met most often, and step 4 sees to the others
    met = common.stored(stars.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("at").alias("only")), "met")
    # (of its centres, the one that most of all members met: few centres serve many)
    fame = common.stored(met.groupBy("a").agg(F.sum("n").alias("fame")), "fame")
    best = met.join(fame, "a").groupBy("b").agg(F.max_by("a", F.struct("fame", "n", "a")).alias("a")).select("a", "b", F.lit(True).alias("main"))
    pairs = best.unionByName(met.where("only = 1").select("a", "b", F.lit(False).alias("main"))).groupBy("a", "b").agg(F.bool_or("main").alias("main"))
    pairs = common.stored(pairs, "pairs")
    groups = found.where("key is not null").select("key", F.col("a").alias("class"), "n", "at")

    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(groups.select("class")).distinct()
    wanted = common.stored(wanted, "wanted")
    repeats = _repeats(members)
    sets = common.stored(_sets(docs, wanted, reps, repeats), "sets")
    tried = _verified(pairs, sets)
    links = tried.where("ok").select("a", "b")
    centres = tried.where("main").select(F.col("b").alias("class"), F.col("a").alias("centre"), "delta")
    comps = common.stored(common.components(links), "components")

    about = common.stored(sets.select("class", "bits").join(centres, "class", "left").select("class", "bits", F.coalesce("centre", F.lit(0)).alias("centre"), F.coalesce("delta", F.lit(bytes(BITS // 8))).alias("delta")), "about")

    def across(nearest: bool) -> DataFrame:
        nonlocal groups
        named = groups.join(_small(comps.withColumnRenamed("node", "class")), "class", "left")
        slim = common.stored(named.select("key", "class", "n", "at", F.coalesce("component", "class").alias("comp")), "slim")
        # a group of one component has no pair to try; only rows of the others take bitmaps along
        mixed = slim.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        slim = common.matching(slim, common.stored(mixed.select("key"), "mixed"), "key")
        rows = slim.join(about, "class").repartition(_partitions(spark), "key").sortWithinPartitions("key", "n", "class")
        found = common.stored(rows.mapInArrow(_across(NUM, DEN, nearest), "a long, b long, apart int, key long"), "across")
        # groups without a pair now will have none later, when components are fewer
        live = common.stored(found.where("a IS NULL").select("key").distinct(), "live")
        groups = common.stored(common.matching(groups, live, "key"), "members")
        return found.where("a IS NOT NULL").select("a", "b", "apart")

    def linked(pairs: DataFrame) -> DataFrame:
        return common.stored(_verified(pairs.withColumn("main", F.lit(False)), sets).where("ok").select("a", "b"), "links")

    # members of families that a centre did not gather try their nearest, round by round
    more = across(nearest=True)
    for _ in range(ROUNDS):
        new = linked(more.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")))
        if new.isEmpty():
            break
        links = common.stored(links.unionByName(new), "links")
        comps = common.stored(common.components(links), "components")
        more = across(nearest=True)
        if more.isEmpty():
            break
    if not more.isEmpty():
        # and what is left is compared in full
        new = linked(across(nearest=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not new.isEmpty():
            comps = common.stored(common.components(links.unionByName(new)), "components")

    # components of classes; then the smallest doc_id of all documents in each
    by_class = common.stored(reps.join(_small(comps.withColumnRenamed("node", "class")), "class", "left").select("class", "doc_id", F.coalesce("component", "class").alias("comp")), "classes")
    low = common.stored(by_class.groupBy("comp").agg(F.min("doc_id").alias("low")), "low")
    by_class = common.stored(by_class.join(low, "comp").select("class", "low"), "classes")
    out = members.join(by_class, "class", "left")
    linked = F.when(F.col("n") > 0, F.coalesce("low", "doc_id")).otherwise(F.col("doc_id"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))
    return _joined_by_id(result) if repeats else result


def _repeats(members: DataFrame) -> bool:
    r = members.where("doc_id is not null and n > 0").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d")).first()
    return r["n"] != r["d"]


def _joined_by_id(result: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id with different texts are one document to the
    ids: their components meet."""
    result = common.stored(result, "result")
    edges = result.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    comps = common.stored(common.components(edges), "components")
    return result.join(comps, F.col("component_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def _partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
