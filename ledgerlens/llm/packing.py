"""Bound-certified best-fit packing of tokenized documents into sequences.

Documents are tokenized, ended by an end id, and cut into pieces only where they
are longer than a sequence.  Full pieces are sequences of their own.  The others
are dealt to parts of bounded size; each part is packed by best-fit decreasing
and certified by lower bounds from dual feasible functions: a part that has as many
bins as its bound is optimal.  A part with a gap gives up all bins that have room;
the documents of these meet in pools with those of other parts (exchange), are
packed again, and the new packing is taken where it has fewer bins.  A certified part
gives up its emptiest bin only, and only while all parts together have more bins than
the bound of all documents.  Rounds go on until that bound is met, no pool saves a
bin, or one pool is left.

Defined cases: a null text is empty and has the end id only.  Repeated rows are
packed as often as they occur.  An empty table gives an empty result.  Pieces
never overlap and every sequence is gapless from 0.  Of equally long pieces the one
that was read first is packed first.  Columns other than doc_id and text are not
looked at, whatever their names; very long texts are encoded whole.  The tokenizer's
file is a parameter.  Its pretokenization must never join text across white space,
so that words are encoded once and looked up after that; for a file of which this
encoder's shortcuts do not hold, every text goes through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END = 0
#: items of one part: bounds the memory and time of one packing task
PART_ITEMS = 4096
#: distinct words, and as many runs of letters, whose ids a Python worker keeps
CACHE_WORDS = 100_000


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: the tokenizer's own split of lower-cased text, for words of printable ASCII and of printable Latin letters
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LATIN_END = "\u0250"


#: fixed values: the tokenizer's parts, as its file names them, for which the two patterns above hold
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: how byte-level tokenizers write bytes: printable ones of Latin-1 stand for themselves, the others for U+0100 on
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_TEXT = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class _Kept(dict):
    """Ids by text; what is missing is made, and kept while there is room."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.passed = make, limit, 0

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(self) < self.limit:
            self[key] = got
        else:
            self.passed += 1
            if self.passed >= self.limit:  # what was kept serves this text badly
                self.clear()
                self.passed = 0
        return got


class WordEncoder:
    """Ids of whole texts from the ids of their words, and ids of words from
    their runs of letters, single digits and runs of other characters, which the
    tokenizer encodes one by one.  Words that could be normalized in another way,
    or hold a special token's mark, go through the tokenizer whole."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = {c: parts.get(c) for c in ("normalizer", "pre_tokenizer")} == BY_WORD
        self.pieces = _Kept(self._piece, cache_words)
        self.words = _Kept(self._word, cache_words)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_TEXT))]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if "<|" in word or not word.isprintable():
            return self._whole(word)
        if word.isascii():
            found = _ASCII.findall(word.lower())
        elif max(word) < _LATIN_END and unicodedata.is_normalized("NFC", word):
            found = _LATIN.findall(word.lower())
        else:
            return self._whole(word)
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text.  Only space, line feed and tab
        split, all of which the tokenizer drops."""
        if not self.by_word:
            return list(map(self._whole, texts))
        get = self.words.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in common.batches(frames, 200):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            texts = [t or "" for t in b["text"].to_pylist()]
            for doc_id, ids in zip(b["doc_id"].to_pylist(), enc.encode(texts), strict=True):
                ids += END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))], names=list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.  Items are taken
    by falling length; each goes to the fullest bin that still has room."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    fill: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            k = len(fill)
            fill.append(0)
            room = capacity
        bins[i], offsets[i] = k, fill[k]
        fill[k] += size
        if left := room - size:
            open_by_room[left].append(k)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """Bins that any packing needs (of items that occur `times` times): the best of two
    families of dual feasible functions over the items' sizes (as shares of the capacity).

    U(e): items above 1-e count 1, items below e count 0, others their size.
    V(k): an item counts floor((k+1) x) / k, or x where (k+1) x is whole.
    """
    if not len(lengths):
        return 0
    size, count = np.unique(lengths, return_counts=True) if times is None else (lengths, times)
    total = int((size * count).sum())
    best = -(-total // capacity)
    low = np.sort(size[size <= capacity // 2])
    for e in low[:: max(1, len(low) // 128)].tolist():
        big, middle = size > capacity - e, (size >= e) & (size <= capacity - e)
        best = max(best, int(count[big].sum()) + -(-int((size[middle] * count[middle]).sum()) // capacity))
    for k in range(1, 12):
        whole = (size * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(whole, size * k, (size * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


_PACKED = "copy long, length long, bin long, place long, room long, gap long, saved long"


def _packer(capacity: int, level: int):
    """Packs the items of one part.  Where they come in bins of earlier packing, the
    new packing counts only if it has fewer."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "copy"], ascending=[False, True], kind="stable")
        lengths, part = frame["length"].to_numpy(), int(frame["part"].iloc[0])
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap, saved = len(fill) - lower_bound(lengths, capacity), 0
        # (level, part, number) names a bin; a part has far fewer than 2^24
        names = (level << 56) + (part << 24) + bins
        if level and (saved := frame["bin"].nunique() - len(fill)) <= 0:
            names, offsets, saved = frame["bin"].to_numpy(), frame["place"].to_numpy(), 0
            room = capacity - frame.groupby("bin")["length"].transform("sum").to_numpy()
        else:
            room = (capacity - fill)[bins]
        return pd.DataFrame({"copy": frame["copy"].to_numpy(), "length": lengths, "bin": names, "place": offsets, "room": room, "gap": gap, "saved": saved})

    return pack


def _loose(packed: DataFrame) -> DataFrame:
    """packed with `loose`: bins that are broken up again.  A part with a gap gives up
    all bins with room, a certified one only its emptiest."""
    part = F.shiftright("bin", 24)
    most = packed.groupBy(part.alias("p")).agg(F.max("room").alias("most"))
    return packed.join(most, part == F.col("p")).withColumn("loose", (F.col("room") > 0) & ((F.col("gap") > 0) | (F.col("room") == F.col("most")))).drop("p", "most")


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """items(doc_id, piece, length, ...) plus sequence_id, offset and certified
    (whether the part that the sequence was packed in has as few as its lower bound)."""
    extra = [c for c in items.columns if c not in ("doc_id", "piece", "length")]
    # repeated rows get a number of their own within their partition of the stored table
    items = common.stored(items.withColumn("copy", F.monotonically_increasing_id()), "items")
    small = items.where(F.col("length") < capacity)
    # how often each length occurs: at most `capacity` rows
    tally = small.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = int(tally["n"].sum())
    least = lower_bound(tally["length"].to_numpy(), capacity, tally["n"].to_numpy())
    parts = max(1, -(-n // part_items))
    dealt = small.select("copy", "length", F.pmod(F.xxhash64("copy"), F.lit(parts)).alias("part"))
    packed = common.stored(dealt.groupBy("part").applyInPandas(_packer(capacity, 0), _PACKED), "packed")
    done, level, kept = [], 0, 0
    while parts > 1:
        packed = common.stored(_loose(packed), "packed")
        shut = packed.where("NOT loose")
        kept += shut.select("bin").distinct().count()
        here = packed.where("loose").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("bin").alias("bins")).first()
        done.append(shut.drop("loose"))
        packed = packed.where("loose").drop("loose")
        if kept + here["bins"] <= least or not here["items"]:
            break  # certified as a whole
        # each pool has the loose bins of many parts, as many items as a part on average
        level, parts = level + 1, max(1, -(-here["items"] // part_items))
        pool = packed.select("copy", "length", "bin", "place", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(parts)).alias("part"))
        packed = common.stored(pool.groupBy("part").applyInPandas(_packer(capacity, level), _PACKED), "packed")
        if packed.where("saved > 0").isEmpty():
            break  # no pool helps
    for d in done:
        packed = packed.unionByName(d)
    every = packed.select("copy", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), (F.col("gap") == 0).alias("certified"))
    full = items.where(F.col("length") >= capacity)
    out = [*("doc_id", "piece"), *[c for c in extra if c in ("start",)], "length", *[c for c in extra if c != "start"], "sequence_id", "offset", "certified"]
    return (
        small.join(every, "copy")
        .select(*out)
        .unionByName(full.withColumn("sequence_id", -1 - F.col("copy")).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True)).select(*out))
    )


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path or tokenizer_path(), capacity), capacity, part_items)
