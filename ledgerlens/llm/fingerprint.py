"""Order MinHash document fingerprints.

A text is the sequence of its character k-mers, each numbered with its
occurrence (the third "abc" differs from the first).  A hash of (k-mer,
occurrence) deals them to `parts` parts; of each part the `keep` minimal ones
are selected, put back into text order and hashed together: one component of the
signature.  Because the tuple retains the order, the share of equal components
falls with the edit distance and not only with the set overlap.

Dealing one hash out to parts stands for independent permutations; it needs one
pass over the text whatever the signature's length, and nothing is sampled.

Defined cases: a null text counts as empty; an empty text has the fingerprint of
empty components only, and two of these are equal (likeness 1).  Equal texts
have equal fingerprints.  A component empty in both texts says nothing and is
left out of the likeness.  Repeated rows are kept and follow one another.  Very long
texts are read whole.  An empty table gives an empty result; columns other than
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, PARTS, KEEP = 5, 64, 2
#: most ranges of doc_id that rows are dealt to: a task streams its range, whatever its size
RANGES = 4096
_EMPTY = np.uint16(0)


def signature(text: str | None, k: int = K, parts: int = PARTS, keep: int = KEEP) -> np.ndarray:
    """One 16-bit component for each part; 0 stands for an empty part."""
    out = np.zeros(parts, dtype=np.uint16)
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    if not n:
        return out
    m = max(1, n - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, n if n < k else k, dtype=np.uint64)
        for i in range(min(k, n)):
            h = h * common._BASE + codes[i : i + m] + np.uint64(1)
        # sorting (hash of the k-mer, place) brings equal k-mers together in text order
        bits = max(1, int(m - 1).bit_length())
        place_mask = np.uint64((1 << bits) - 1)
        full_hash = common.mix64(h)
        packed = np.sort((full_hash & ~place_mask) | np.arange(m, dtype=np.uint64))
        place, kmer = packed & place_mask, packed & ~place_mask
        first = np.concatenate(([True], kmer[1:] != kmer[:-1]))
        at = np.arange(m)
        number = at - np.maximum.accumulate(np.where(first, at, 0))
        # the low bits that gave way to the place must not count, or the length of a text would change its hashes
        kmer = full_hash[place.astype(np.int64)]
        value = common.mix64(kmer + number.astype(np.uint64) * common._MUL)
        part = (value % np.uint64(parts)).astype(np.int64)
        if m > parts * keep * 16:
            # only small values can be selected; all are used where a part has too few of these
            low = value < np.uint64(int(min(1.0, parts * (keep + 14) / m) * (2**64 - 1)))
            if np.bincount(part[low], minlength=parts).min() >= keep:
                value, part, place, kmer = value[low], part[low], place[low], kmer[low]
        order = np.lexsort((value, part))
        part, place, value = part[order], place[order], value[order]
        start = np.searchsorted(part, np.arange(parts))
        rank = np.arange(len(part)) - start[part]
        chosen = rank < keep
        part, place, value = part[chosen], place[chosen], value[chosen]
        order = np.lexsort((place, part))
        part, value = part[order], value[order]
        start = np.searchsorted(part, np.arange(parts + 1))
        full = np.zeros(parts, dtype=np.uint64)
        for j in range(keep):
            has = start[:-1] + j < start[1:]
            full[has] = common.mix64(full[has] * common._BASE + value[start[:-1][has] + j] + np.uint64(j + 1))
        some = start[:-1] < start[1:]
        out[some] = (full[some] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components among those that either text has."""
    some = (a != _EMPTY) | (b != _EMPTY)
    n = int(some.sum())
    return float((a[some] == b[some]).sum() / n) if n else 1.0


def to_hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, rows_per_part: int = 2000) -> DataFrame:
    """Fingerprints of each text, of its edited text, and the likeness of both
    and of the next document (descending doc_id; after the last, the first).

    The ids alone are sorted to split points; each text then moves once, to the
    part of its id range, and the first row of a part also to the part before
    it, where it only serves as the next document.  Rows with equal doc_id follow
    one another by their text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    parts = min(RANGES, max(1, -(-n // rows_per_part)))
    ids = rows.where("doc_id is not null").select("doc_id")
    # splits: how even they are matters for speed only, not for the result
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 and not ids.isEmpty() else []
    # part 0 has the highest ids; nulls form the last part of all
    below = F.lit(0)
    if cuts:
        deal = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="below", handleInvalid="keep")
        rows = deal.transform(rows.withColumn("at", F.col("doc_id").cast("double")))
        below = F.lit(len(cuts)) - F.col("below")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(below).cast("int"))
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    have = sorted(heads)
    if not have:
        return spark.createDataFrame([], FIELDS)
    before = {p: have[i - 1] for i, p in enumerate(have)}  # the first part's head serves the last part
    heads_df = spark.createDataFrame([(p, heads[p], before[p]) for p in have], "part int, head long, before int")
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("part"), F.lit(True).alias("tail"))
    # at most RANGES + 1 heads
    dealt = (
        rows.join(F.broadcast(heads_df), "part")
        .withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, tail)).otherwise(F.array(own))))
        .select("to.part", "to.tail", "doc_id", "text")
    )
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, len(have)), "part").sortWithinPartitions(F.asc("part"), F.asc("tail"), F.desc_nulls_last("doc_id"), F.asc("text"))
    return dealt.mapInArrow(_stream, FIELDS)


def _stream(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # part, doc_id, text, signature of the row whose next one is awaited
    for b in common.batches(frames, 256):
        out = []
        for part, tail, doc_id, text in zip(*(b[c].to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            own = held[3] if held and held[2] == text else signature(text)
            if held and held[0] == part:
                out.append(_row(held, text, own))
                held = None if tail else (part, doc_id, text, own)
            elif not tail:
                held = (part, doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(held: tuple, following: str, next_signature: np.ndarray) -> dict:
    _, doc_id, text, own = held
    changed = edited(text, following)
    other = signature(changed)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": to_hex(own),
        "edited_fingerprint": to_hex(other),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, next_signature),
    }
