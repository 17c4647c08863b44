"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts up to `order` bytes, counted over all
training text; it has every context that occurs at least `least` times, and grows
with the corpus.  A symbol is coded in the longest context that the trie has; where
it was not seen there, the coder escapes to the next shorter context, and the
symbols of the longer one are excluded there.  Escapes are estimated by method C
(distinct symbols / (distinct + total)).  Below the empty context every symbol
that is not excluded is equally likely.  The alphabet has the 256 bytes and an
end symbol, so the probabilities of all texts sum to one.

Because every symbol of a context is also one of its suffix, what is excluded at
an order depends on the next longer context only.  The trie is therefore sparse: a
count for each symbol seen in a context, and for each context the costs of its escape
and of what its suffix leaves.  Scoring a text is a lookup for most bytes, and one
more for each escape.

A trie of more than `shard_grams` counts is cut by the last two bytes of its contexts,
which a context shares with its suffixes, so that every position of a text belongs to one
shard.  Each shard is broadcast by itself and scores its positions in a pass over the texts;
no more than one is held at a time.

The word model beside it (add-one unigrams) needs the count of every word.  Words
that make up a large part of all tokens - there can be at most `hot_words` of
these, by arithmetic - are looked up in a broadcast table; all others are scored
where the postings of a word meet, and come back as one partial sum per document
and task.

Defined cases: a null text counts as empty and consists of the end alone.  A-Z
are lower-cased.  Repeated rows are kept and, where they train, counted each
time.  With nothing to learn from, the model is uniform and every word unknown.
Rows with a null doc_id, of which no fold is known, neither train nor are held out.
Very long texts are scored whole.  An empty table gives an empty result; columns
other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

END = 256
SYMBOLS = 257
ORDER = 5
#: occurrences of a context in all training text from which on it is kept
LEAST = 2
#: counts of a shard of the trie: some 60 MB with its index
SHARD_GRAMS = 2_500_000
#: positions of texts that are scored at a time
POSITIONS = 1 << 18
HOT_WORDS = 20_000
#: hash that stands for the end token of the word model (no word has it but by accident)
END_WORD = np.uint64(0x5EED0E4D)


def text_bytes(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass").translate(common.LOWER)
    return np.frombuffer(data, dtype=np.uint8)


# ------------------------------------------------------------------- counting
# A key holds a context of k bytes and a symbol: symbol + 257 * context, with
# the order in the upper bits.


def _contexts(raw: np.ndarray, k: int) -> np.ndarray:
    """For positions k .. n (n: the end), the k bytes before it as one number."""
    n = len(raw)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out << np.uint64(8) | raw[j : n - k + 1 + j]
    return out


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(ctx, symbol, n) of the full order over all of the rows' texts; positions
    nearer to the start than `order` bytes have shorter contexts (k)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        short: dict[tuple[int, int, int], int] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                yield _gram_batch(np.full(len(keys), order, dtype=np.int32), (keys >> np.uint64(9)).view(np.int64), (keys & np.uint64(511)).astype(np.int32), counts)
            if short:
                k, c, s = (np.array(x, dtype=np.int64) for x in zip(*short, strict=True))
                yield _gram_batch(k.astype(np.int32), c, s.astype(np.int32), np.array(list(short.values()), dtype=np.int64))
            held.clear()
            short.clear()
            size = 0

        for b in common.batches(frames, 512):
            for text in b["text"].to_pylist():
                raw = text_bytes(text)
                n = len(raw)
                for k in range(min(order, n + 1)):
                    c = int.from_bytes(raw[:k].tobytes(), "big")
                    key = (k, c, int(raw[k]) if k < n else END)
                    short[key] = short.get(key, 0) + 1
                if n >= order:
                    wide = raw.astype(np.uint64)
                    sym = np.concatenate([wide[order:], np.array([END], dtype=np.uint64)])
                    held.append(_contexts(wide, order) << np.uint64(9) | sym)
                    size += len(sym)
                if size > 3_000_000:
                    yield from out()
        yield from out()

    found = docs.select("text").mapInArrow(run, "k int, ctx long, symbol int, n long")
    return found.groupBy("k", "ctx", "symbol").agg(F.sum("n").alias("n"))


def _gram_batch(k: np.ndarray, ctx: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(ctx), pa.array(symbol), pa.array(n.astype(np.int64))], names=["k", "ctx", "symbol", "n"])


# ---------------------------------------------------------------------- model


def _tag(k, context: np.ndarray, symbol=0) -> np.ndarray:
    """A context of k bytes (and a symbol) as one number; five bytes at most."""
    return np.uint64(k << 52) | context << np.uint64(9) | symbol


class Lookup:
    """Places of keys, by tables of hashes; what two keys share goes on to the next table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, None

    def __getstate__(self) -> dict:
        """The keys alone: each worker makes tables of its own."""
        return {"keys": self.keys, "tables": None}

    def _index(self) -> None:
        keys, self.tables = self.keys, []
        left, factor = np.arange(len(keys), dtype=np.int32), int(common._MUL)
        while len(left):
            bits = max(4, (2 * len(left) - 1).bit_length())
            slot = _slot(keys[left], factor, bits)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = left
            self.tables.append((factor, bits, table))
            left = left[table[slot] != left]
            factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1

    def find(self, want: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if self.tables is None:
            self._index()
        out = np.full(len(want), -1, dtype=np.int32)
        todo = None
        for factor, bits, table in self.tables:
            some = want if todo is None else want[todo]
            at = table[_slot(some, factor, bits)]
            ok = self.keys[at] == some
            ok &= at >= 0
            if todo is None:
                out = np.where(ok, at, np.int32(-1))
                todo = np.flatnonzero((at >= 0) & ~ok)
            else:
                out[todo[ok]] = at[ok]
                todo = todo[(at >= 0) & ~ok]
            if not len(todo):
                break
        return out


def _slot(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Counts of a trie (of a shard of it) as costs in bits.

    grams: (context, symbol) keys, with what the symbol costs in its context (here) and
    the logarithm of its count; contexts: keys, with the cost of an escape (out), and for
    what a longer context escapes to: the logarithm of the suffix's mass without what is
    excluded (mass), and the cost of escaping from the suffix as well (on).
    nothing: the cost of a symbol below the empty context.  shard: of each last two bytes, or None.
    """

    order: int
    grams: Lookup = field(repr=False)
    here: np.ndarray = field(repr=False)
    log_count: np.ndarray = field(repr=False)
    contexts: Lookup = field(repr=False)
    out: np.ndarray = field(repr=False)
    mass: np.ndarray = field(repr=False)
    on: np.ndarray = field(repr=False)
    nothing: float
    number: int = 0
    shard: np.ndarray | None = field(default=None, repr=False)


@dataclass
class Trie:
    """Stored counts (k, ctx, symbol, n) of all kept contexts, and the shard of each last two bytes."""

    counts: DataFrame
    order: int
    shard: np.ndarray
    shards: int

    def model(self, number: int = 0) -> Model:
        """One shard; contexts of less than two bytes (at most 257 of them) are in each."""
        rows = self.counts
        if self.shards > 1:
            pairs = np.flatnonzero(self.shard == number).tolist()
            named = self.counts.sparkSession.createDataFrame([(p,) for p in pairs], "pair long")
            own = rows.where("k >= 2").withColumn("pair", F.col("ctx").bitwiseAND(F.lit(0xFFFF))).join(F.broadcast(named), "pair").drop("pair")
            rows = rows.where("k < 2").unionByName(own)
        key = F.shiftleft(F.col("k").cast("long"), 52).bitwiseOR(F.shiftleft("ctx", 9)).bitwiseOR(F.col("symbol"))
        table = rows.select(key.alias("key"), "n").toArrow()
        return build(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy(), self.order, number, self.shard if self.shards > 1 else None)


def fit(docs: DataFrame, order: int = ORDER, least: int = LEAST, shard_grams: int = SHARD_GRAMS) -> Trie:
    """Count all texts of docs and keep every context that occurs `least` times.

    The suffix of a context occurs at least as often, so it is kept as well.  Only counts by
    the last two bytes of contexts come to the driver here: at most 65536 numbers.
    """
    if order > 5:
        raise ValueError("contexts have five bytes at most")
    grams = common.stored(count_grams(docs, order), "grams")
    # every order's counts follow from the full order's: a suffix is the remainder by a power of 256
    orders = F.explode(F.sequence(F.lit(0), F.col("k")))
    every = grams.withColumn("j", orders).groupBy("j", F.when(F.col("j") > 0, F.pmod("ctx", F.expr("shiftleft(1L, 8 * j)"))).otherwise(F.lit(0)).cast("long").alias("c"), "symbol").agg(F.sum("n").alias("n"))
    every = every.withColumnRenamed("j", "k").withColumnRenamed("c", "ctx")
    if least > 1:
        every = common.stored(every, "grams")
        total = every.groupBy("k", "ctx").agg(F.sum("n").alias("total")).where((F.col("total") >= least) | (F.col("k") == 0))
        every = every.join(total.drop("total"), ["k", "ctx"], "left_semi")
    every = common.stored(every.select("k", "ctx", "symbol", "n"), "trie")
    sizes = every.where("k >= 2").groupBy(F.col("ctx").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.count(F.lit(1)).alias("n")).collect()
    shard = np.zeros(1 << 16, dtype=np.int16)
    shards, held = 1, 0
    for r in sorted(sizes, key=lambda r: (-r["n"], r["pair"])):
        if held and held + r["n"] > shard_grams:
            shards, held = shards + 1, 0
        shard[r["pair"]], held = shards - 1, held + r["n"]
    return Trie(every, order, shard, shards)


def build(keys: np.ndarray, n: np.ndarray, order: int, number: int = 0, shard: np.ndarray | None = None) -> Model:
    """The model of counts n of tagged (context, symbol) keys."""
    by = np.argsort(keys)
    keys, n = keys[by], n[by].astype(np.float64)
    context = keys >> np.uint64(9)
    start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
    if not len(keys):  # nothing to learn from: every symbol is equally likely
        none = np.empty(0, dtype=np.float32)
        return Model(order, Lookup(keys), none, none, Lookup(keys), none, none, none, float(np.log2(SYMBOLS)), number, shard)
    names = context[start]
    of = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.concatenate([start, [len(keys)]])))
    total, distinct = np.add.reduceat(n, start), np.bincount(of).astype(np.float64)
    # the suffix of a context, and the counts that it has of the context's symbols
    level = (names >> np.uint64(43)).astype(np.int64)
    low = names & ((np.uint64(1) << (8 * np.maximum(level - 1, 0)).astype(np.uint64)) - np.uint64(1)) | (np.maximum(level - 1, 0).astype(np.uint64) << np.uint64(43))
    suffix = np.searchsorted(names, low)
    at = np.searchsorted(keys, low[of] << np.uint64(9) | keys & np.uint64(511))
    excluded = np.add.reduceat(n[at], start)
    new = distinct[suffix] - distinct
    mass = total[suffix] - excluded + new
    deep = level > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        here = np.log2(total + distinct)[of] - np.log2(n)
        out = np.log2(total + distinct) - np.log2(distinct)
        # nothing new at the suffix: it escapes for certain, at no cost
        on = np.where(deep & (new > 0), np.log2(mass) - np.log2(new), 0.0)
        mass = np.where(deep & (mass > 0), np.log2(mass), 0.0)
    small = lambda x: x.astype(np.float32)
    nothing = float(np.log2(max(SYMBOLS - distinct[0], 1))) if level[0] == 0 else float(np.log2(SYMBOLS))
    return Model(order, Lookup(keys), small(here), small(np.log2(n)), Lookup(names << np.uint64(9)), small(out), small(mass), small(on), nothing, number, shard)


def _costs(context: np.ndarray, near: np.ndarray, symbol: np.ndarray, m: Model) -> np.ndarray:
    """Bits for each symbol behind the last five bytes (`near` of them are there)."""
    cost = np.zeros(len(symbol))
    above = np.full(len(symbol), -1, dtype=np.int32)  # the context that was escaped from
    todo = np.arange(len(symbol))
    for k in range(m.order, -1, -1):
        waits = near[todo] < k
        some, rest = (todo[~waits], todo[waits]) if waits.any() else (todo, todo[:0])
        if not len(some):
            continue
        key = _tag(k, context[some] & np.uint64((1 << (8 * k)) - 1))
        at = m.grams.find(key | symbol[some])
        hit, up = at >= 0, above[some]
        first = hit & (up < 0)
        cost[some[first]] += m.here[at[first]]
        later = hit & (up >= 0)
        cost[some[later]] += m.mass[up[later]] - m.log_count[at[later]]
        miss = some[~hit]
        up, own = up[~hit], m.contexts.find(key[~hit])
        escapes = (up < 0) & (own >= 0)
        cost[miss[escapes]] += m.out[own[escapes]]
        cost[miss[up >= 0]] += m.on[up[up >= 0]]
        above[miss] = own
        todo = np.concatenate([miss, rest]) if len(rest) else miss
    cost[todo] += m.nothing
    return cost


def batch_bits(texts: list[str | None], m: Model) -> np.ndarray:
    """Bits for each text and its end (for its positions in the model's shard)."""
    parts = [text_bytes(t) for t in texts]
    length = np.array([len(x) + 1 for x in parts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(length)])
    stream = np.full(int(first[-1]), END, dtype=np.uint16)
    for x, at in zip(parts, first[:-1].tolist(), strict=True):
        stream[at : at + len(x)] = x
    out = np.zeros(len(texts))
    for low in range(0, len(stream), POSITIONS):
        high = min(low + POSITIONS, len(stream))
        back = min(low, m.order)
        wide = stream[low - back : high].astype(np.uint64)
        place = np.arange(low, high)
        text = np.searchsorted(first, place, side="right") - 1
        near = np.minimum(place - first[text], m.order)
        context = np.zeros(high - low, dtype=np.uint64)
        for j in range(m.order, 0, -1):
            context <<= np.uint64(8)
            head = max(0, j - back)  # positions too near to the stream's start
            context[head:] |= wide[back + head - j : max(0, len(wide) - j)]
        symbol = wide[back:]
        if m.shard is not None:
            own = np.where(near >= 2, m.shard[(context & np.uint64(0xFFFF)).astype(np.int64)], 0) == m.number
            context, near, symbol, text = context[own], near[own], symbol[own], text[own]
        out += np.bincount(text, weights=_costs(context, near, symbol, m), minlength=len(texts))
    return out


def log10_probability(text: str | None, model: Model) -> float:
    return -float(batch_bits([text], model)[0]) * float(np.log10(2.0))


# ----------------------------------------------------------------- word model


def _words(text: str | None) -> np.ndarray:
    return np.concatenate([common.word_hashes(text), np.array([END_WORD], dtype=np.uint64)])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over docs' texts, each ended by the end token."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                w, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for b in common.batches(frames, 512):
            for text in b["text"].to_pylist():
                held.append(_words(text))
                size += len(held[-1])
            if size > 3_000_000:
                size = 0
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, trains: Column, order: int = ORDER, least: int = LEAST, hot_words: int = HOT_WORDS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    # a row's own number ties repeated doc_ids apart; the table is stored, so it stays the same
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(trains, F.lit(False)).alias("trains"), F.coalesce(~trains, F.lit(False)).alias("held"))
    trie = fit(rows.where("trains"), order, least, shard_grams)
    words = common.stored(count_words(rows.where("trains")), "words")
    first = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, distinct = first["n"] or 0, first["v"]
    # no more than hot_words words can each have more than that share of all tokens
    hot = words.where(F.col("n") * hot_words > n_all).orderBy("word").toPandas()
    shared = spark.sparkContext.broadcast((trie.model(), hot["word"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64)))
    log_total = float(np.log10(n_all + distinct + 1))

    def first_pass(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document a row with what is known at once (word null), and per task
        and cold word a row with its postings."""
        m, hot_keys, hot_counts = shared.value
        order_ = np.argsort(hot_keys)
        hot_keys, hot_logs = hot_keys[order_], np.log10(hot_counts[order_] + 1.0)
        held: list[tuple[np.ndarray, np.ndarray, int, int, bool]] = []
        size = 0
        for b in common.batches(frames, 256):
            head = {c: [] for c in ("row", "doc_id", "held", "n_tokens", "known", "base", "score")}
            texts = b["text"].to_pylist()
            bits = batch_bits(texts, m) * -float(np.log10(2.0))
            for row, doc_id, text, train, out, score in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), texts, b["trains"].to_pylist(), b["held"].to_pylist(), bits.tolist(), strict=True):
                w, n = np.unique(_words(text), return_counts=True)
                at = np.minimum(np.searchsorted(hot_keys, w), max(0, len(hot_keys) - 1))
                is_hot = hot_keys[at] == w if len(hot_keys) else np.zeros(len(w), dtype=bool)
                vals = (row, doc_id, out, int(n.sum()), int(n[is_hot].sum()), float((n[is_hot] * hot_logs[at[is_hot]]).sum()) if len(hot_keys) else 0.0, score)
                for c, v in zip(head, vals, strict=True):
                    head[c].append(v)
                cold = ~is_hot
                held.append((w[cold], n[cold], row, train))
                size += int(cold.sum())
            yield _first_batch(head, None)
            if size > 2_000_000:
                yield _postings(held)
                held, size = [], 0
        if held:
            yield _postings(held)

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    once = common.stored(rows.mapInArrow(first_pass, _FIRST), "scored")
    shared.destroy()
    heads = once.where("word is null").select("row", "doc_id", "held", "n_tokens", "known", "base", "score")
    more = [_of_shard(rows, trie, k) for k in range(1, trie.shards)]
    if more:
        rest = more[0]
        for x in more[1:]:
            rest = rest.unionByName(x)
        rest = rest.groupBy("row").agg(F.sum("more").alias("more"))
        heads = heads.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    postings = once.where("word is not null").select("word", "known", "posting")
    postings = postings.repartition("word").sortWithinPartitions("word")
    # what words add comes back packed, by the split of the input that a document is in
    cold = postings.mapInArrow(_cold_words, "split long, sums binary")
    cold = cold.groupBy("split")
    heads = heads.withColumn("split", F.shiftright("row", 33)).groupBy("split")
    return heads.cogroup(cold).applyInPandas(_together(n_all, log_total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _of_shard(rows: DataFrame, trie: Trie, number: int) -> DataFrame:
    """row, more: what the positions of one more shard add to each text's score."""
    shared = rows.sparkSession.sparkContext.broadcast(trie.model(number))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(frames, 256):
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(batch_bits(b["text"].to_pylist(), shared.value) * -float(np.log10(2.0)))], names=["row", "more"])

    found = common.stored(rows.select("row", "text").mapInArrow(run, "row long, more double"), "shard")
    shared.destroy()
    return found


_SUMS = np.dtype([("row", "<i8"), ("known", "<i8"), ("base", "<f8")])


def _together(n_all: int, log_total: float):
    def merge(heads: pd.DataFrame, cold: pd.DataFrame) -> pd.DataFrame:
        """The documents of one split with all that was summed for them."""
        heads = heads.sort_values("row")
        known, base = heads["known"].to_numpy(np.int64), heads["base"].to_numpy(np.float64)
        if len(cold):
            sums = np.frombuffer(b"".join(cold["sums"]), dtype=_SUMS)
            at = np.searchsorted(heads["row"].to_numpy(), sums["row"])
            known = known + np.bincount(at, weights=sums["known"], minlength=len(heads)).astype(np.int64)
            base = base + np.bincount(at, weights=sums["base"], minlength=len(heads))
        n = heads["n_tokens"].to_numpy(np.int64)
        return pd.DataFrame({"doc_id": heads["doc_id"].astype("Int64").to_numpy() if heads["doc_id"].isna().any() else heads["doc_id"].to_numpy(), "held_out": heads["held"].to_numpy(bool), "n_tokens": n, "n_known": known, "train_tokens": n_all, "base_score": base - n * log_total, "score": heads["score"].to_numpy()})

    return merge


_FIRST = "row long, doc_id long, held boolean, n_tokens long, known long, base double, score double, word long, posting binary"
_POSTING = np.dtype([("row", "<i8"), ("n", "<i4")])


def _first_batch(head: dict, _: None) -> pa.RecordBatch:
    k = len(head["row"])
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(head.values(), kinds, strict=True)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=[*head, "word", "posting"])


def _postings(held: list) -> pa.RecordBatch:
    """A row for each word: its occurrences in training text (known), and its
    occurrences in each document."""
    word = np.concatenate([h[0] for h in held])
    rec = np.empty(len(word), dtype=_POSTING)
    rec["n"] = np.concatenate([h[1] for h in held])
    rec["row"] = np.repeat(np.array([h[2] for h in held], dtype=np.int64), [len(h[0]) for h in held])
    train = np.repeat(np.array([h[3] for h in held], dtype=bool), [len(h[0]) for h in held])
    by = np.argsort(word, kind="stable")
    word, rec, train = word[by], rec[by], train[by]
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, dtype=np.int64)
    known = np.add.reduceat(rec["n"] * train, start) if len(start) else np.empty(0)
    offsets = pa.py_buffer(np.concatenate([start, [len(word)]]).astype(np.int32) * _POSTING.itemsize)
    blob = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(rec.tobytes())])
    k = len(start)
    empty = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())]
    return pa.RecordBatch.from_arrays([*empty, pa.array(known.astype(np.int64)), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(word[start].view(np.int64)), blob], names=["row", "doc_id", "held", "n_tokens", "known", "base", "score", "word", "posting"])


def _cold_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by word: what each word adds to the documents that have it, summed
    per document for as many words as fit in memory, and packed by split."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    carry = None  # word, count, postings so far of the last, perhaps unfinished, word

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if not held:
            return
        row, n, base = (np.concatenate([h[k] for h in held]) for k in range(3))
        ids, at = np.unique(row, return_inverse=True)
        if not len(ids):  # words that training text lacks add nothing
            held.clear()
            size = 0
            return
        known = np.bincount(at, weights=n, minlength=len(ids)).astype(np.int64)
        total = np.bincount(at, weights=base, minlength=len(ids))
        held.clear()
        size = 0
        sums = np.empty(len(ids), dtype=_SUMS)
        sums["row"], sums["known"], sums["base"] = ids, known, total
        split, start = np.unique(ids >> 33, return_index=True)
        blobs = [x.tobytes() for x in np.split(sums, start[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(split), pa.array(blobs, pa.binary())], names=["split", "sums"])

    def add(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, data: bytes) -> None:
        nonlocal size
        start = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        c = np.repeat(np.add.reduceat(counts, start), np.diff(np.concatenate([start, [len(words)]])))
        rec = np.frombuffer(data, dtype=_POSTING)
        c = np.repeat(c, sizes)
        some = c > 0
        held.append((rec["row"][some].astype(np.int64), rec["n"][some].astype(np.int64), rec["n"][some] * np.log10(c[some] + 1.0)))
        size += int(some.sum())

    def parts(b: pa.RecordBatch) -> tuple:
        blob = b["posting"]
        offs = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1]
        data = bytes(memoryview(blob.buffers()[2])[offs[0] : offs[-1]]) if len(blob) else b""
        return b["word"].to_numpy(), b["known"].to_numpy(), np.diff(offs) // _POSTING.itemsize, data

    for b in frames:
        if not b.num_rows:
            continue
        words, counts, sizes, data = parts(b)
        if carry is not None:
            words, counts, sizes, data = np.concatenate([carry[0], words]), np.concatenate([carry[1], counts]), np.concatenate([carry[2], sizes]), carry[3] + data
        cut = int(np.searchsorted(words, words[-1]))  # the last word may go on in the next batch
        edge = int(sizes[:cut].sum()) * _POSTING.itemsize
        if cut:
            add(words[:cut], counts[:cut], sizes[:cut], data[:edge])
        carry = (words[cut:], counts[cut:], sizes[cut:], data[edge:])
        if size > 3_000_000:
            yield from flush()
    if carry is not None:
        add(*carry)
    yield from flush()
