"""Language identification with language-bitmask n-gram filters.

A model is a bit-sliced Bloom filter: every position holds one bit for each
language, so that ANDing the k positions of an n-gram returns the set of *all*
languages that contain it.  A text's n-grams are counted per language (popcount
of each bit slice), the counts are corrected for the filter's false positives,
and the language with the largest corrected count is predicted.

Defined cases: a text that is null or has no letters gives `und` with score 0;
so does every text when nothing could be learned.  Ties go to the language that
sorts first.  Rows with a null `lang` teach nothing.  Repeated rows are kept and
get equal results.  An empty table gives an empty result.  Other columns of the
input are carried along untouched unless they clash with an output column, in
which case the output column replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4, 5)
    #: bound of the labelled rows that are read for each language (expected number)
    sample_rows: int = 3000
    #: bound of the n-grams kept for each language
    grams: int = 20_000
    #: positions of the filter; each has one bit per language
    positions: int = 1 << 20
    probes: int = 3
    #: least share of a text's n-grams that its language must explain to accept it
    accept: float = 0.05


@dataclass
class Model:
    languages: list[str]
    filters: np.ndarray = field(repr=False)  # (positions, words of 64 languages)
    false_rate: np.ndarray = field(repr=False)
    settings: Settings


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(text: str | None, orders: tuple[int, ...]) -> np.ndarray | None:
    """Hashes of the letter n-grams of the lower-cased text, one space standing
    for every run of other characters; None without letters."""
    if not text:
        return None
    low = text.lower()
    letters = set(low)
    other = {ord(c): " " for c in letters if not c.isalpha()}  # ends words, as spaces do
    if len(other) == len(letters):
        return None
    codes = _code_points(f" {low.translate(other)} ").astype(np.uint64)
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    mixed = common.mix64(codes * common._MUL)
    space = codes == 32
    parts = []
    with np.errstate(over="ignore"):
        for n in orders:
            if len(codes) < n:
                continue
            m = len(codes) - n + 1
            h = np.full(m, n, dtype=np.uint64)
            inner = np.zeros(m, dtype=bool)  # a space may only stand first or last
            for k in range(n):
                h = h * common._BASE + mixed[k : k + m]
                if 0 < k < n - 1:
                    inner |= space[k : k + m]
            parts.append(common.mix64(h[~inner]))
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def _slots(grams: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The positions of each n-gram in the filter, by double hashing."""
    a, b = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((a + np.uint64(k) * b) % np.uint64(s.positions)).astype(np.int64) for k in range(s.probes)]


def fit(docs: DataFrame, teaches: Column, settings: Settings = Settings()) -> Model:
    """Learn from text and lang of the rows for which `teaches` holds.

    Of each language about `sample_rows` rows are read, chosen by a hash of the
    text, and the `grams` n-grams found in most of them are kept, those of a single
    row too where there is room: both are the documented bounds of the classifier.
    """
    s = settings
    rows = docs.where(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    words = max(1, -(-len(languages) // 64))
    filters = np.zeros((s.positions, words), dtype=np.uint64)
    if not languages:
        return Model([], filters, np.zeros(0), s)
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, s.sample_rows / n)) for k, n in counts.items()], "lang string, share double")
    orders = s.orders

    def grams_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(frames, 256):
            langs, found = [], []
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                g = gram_hashes(text, orders)
                if g is not None and len(g):
                    g = np.unique(g)
                    langs.append(np.full(len(g), lang, dtype=object))
                    found.append(g.view(np.int64))
            if found:
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.concatenate(langs), pa.string()), "gram": np.concatenate(found)})

    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")
    df = sample.mapInArrow(grams_of, "lang string, gram long").groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("df"))
    # a language with enough n-grams of several rows needs none of a single row
    df = common.stored(df, "grams")
    several = {r["lang"]: r["n"] for r in df.where("df > 1").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, lang in enumerate(languages):
        least = 2 if several.get(lang, 0) >= s.grams else 1
        top = df.where((F.col("lang") == lang) & (F.col("df") >= least)).orderBy(F.desc("df"), "gram").limit(s.grams).select("gram").toPandas()["gram"]
        for slot in _slots(top.to_numpy(dtype=np.int64).view(np.uint64), s):
            filters[slot, i // 64] |= np.uint64(1 << (i % 64))
    fill = np.array([np.count_nonzero(filters[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(languages))]) / s.positions
    return Model(languages, filters, fill**s.probes, s)


def score(text: str | None, model: Model) -> tuple[str, float, float]:
    """Language, its share of all languages' corrected counts, and the share of
    the text's n-grams that it explains."""
    grams = gram_hashes(text, model.settings.orders)
    if grams is None or not len(grams) or not model.languages:
        return UNKNOWN, 0.0, 0.0
    mask = None
    for slot in _slots(grams, model.settings):
        got = model.filters[slot]
        mask = got if mask is None else mask & got
    n, rate = len(grams), model.false_rate
    hits = np.array([np.count_nonzero(mask[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(model.languages))], dtype=np.float64)
    true = np.clip((hits - n * rate) / (1.0 - rate), 0.0, n)
    best = int(np.argmax(true))
    total = true.sum()
    return model.languages[best], float(true[best] / total) if total else 0.0, float(true[best] / n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred, score (0 to 1), explained (0 to 1), accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "explained", "accepted")]
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.batches(frames, 512):
            got = [score(t, m) for t in b["__text"].to_pylist()]
            lang, share, explained = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
            # without anything learned, letters alone decide
            ok = [x != UNKNOWN and e >= m.settings.accept for x, e in zip(lang, explained, strict=True)] if m.languages else [gram_hashes(t, (3,)) is not None for t in b["__text"].to_pylist()]
            cols = [b[c] for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(explained, pa.float64()), pa.array(ok, pa.bool_())], names=[*keep, "lang_pred", "score", "explained", "accepted"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, out)
