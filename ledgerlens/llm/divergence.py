"""Source divergence audit over wide term vectors.

Within a language every source is compared with every other one, and with the
language as a whole, by a symmetric chi-square distance of smoothed term shares.

1. Arrow batches of whole texts are counted by (lang, source, term), occurrences and
   documents; a task sums up to BUFFER counts before it passes them on, so that little is
   shuffled of what is frequent.
2. Counts go by (lang, term) to one place, where sources are summed and terms of at least
   `min_docs` documents of their language are kept and pivoted: a row holds a term's
   occurrences in an array indexed by the language's sources.
3. JVM higher-order functions turn a row into contributions of pairs of sources, for pairs
   with the term in at least one of them.  Where it is missing in both, the contribution does
   not depend on the term: it is added at last, as often as the pair has such terms.  Sums and
   counts are taken before the shuffle.

Shares are integers (parts of SCALE), and all arithmetic is exact.

Defined cases: null text, lang and source count as ''.  Texts without terms still
make their group occur.  Repeated rows are separate documents, whatever their ids.
A language without kept terms gives its pairs the value 0.  Ties rank by the item's
UTF-8 bytes.  Of a very long text one term is held at a time.  An empty table gives an
empty result; columns other than text, lang and source are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: a term's UTF-8 bytes once A-Z is lower-cased: letters and all beyond ASCII
TERM = re.compile(rb"[a-z\x80-\xFF]+")
#: counts that a task holds before it passes them on
BUFFER = 200_000
#: bytes of a text up to which its terms are listed at once
LONG_TEXT = 1 << 22
MIN_DOCS = 10
TOP = 10
#: what is added to every count
SMOOTH = 2
SCALE = 1_000_000_000


def _div(a: Column, b: Column) -> Column:
    """Floor of the quotient of longs that are not negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), without a product
    beyond a long for counts up to 10^13: the scale is applied in two steps."""
    a, d = count + SMOOTH, total + SMOOTH * kept
    first = a * 10_000
    return F.lit(1).cast("long") + _div(first, d) * (SCALE // 10_000) + _div((first % d) * (SCALE // 10_000), d)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return _div((p - q) * (p - q), p + q)


def _count(frames):
    n: dict[tuple, Counter] = {}
    d: dict[tuple, Counter] = {}
    held = 0

    def out():
        for (lang, source), counts in n.items():
            docs, terms = d[lang, source], list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "d"],
            )
        n.clear()
        d.clear()

    for b in common.batches(frames, common.ARROW_ROWS):
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass").translate(common.LOWER)
            found = Counter(TERM.findall(raw)) if len(raw) <= LONG_TEXT else Counter(m[0] for m in TERM.finditer(raw))
            counts, docs = n.setdefault((lang, source), Counter()), d.setdefault((lang, source), Counter())
            held -= len(docs)
            for term, times in found.items():
                counts[term] += times
            docs.update(found.keys())
            held += len(docs)
            if held > BUFFER:
                yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> lang, source, term, n (occurrences), d (documents), all
    sources of a term in one partition."""
    counts = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, d long")
    return counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = term_counts(base).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    terms = common.stored(terms.where(F.col("d") >= min_docs).select("lang", "term", "by_source"), "terms")
    langs = _languages(base.select("lang", "source").distinct(), terms)
    n_groups = langs.agg(F.sum(F.size("sources"))).first()[0] or 0
    # a row per language with its sources; broadcast only where these are few
    small = F.broadcast if n_groups <= common.BROADCAST_ROWS else (lambda df: df)
    rows = terms.join(small(langs.where("kept > 0")), "lang")
    wide = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0).cast("long")))
    rows = rows.select("lang", "term", wide.alias("n"), "totals", "total", "kept")
    p = F.transform("n", lambda n, j: share(n, F.get("totals", j), F.col("kept")))
    q = share(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b), F.col("total"), F.col("kept"))
    rows = rows.select("lang", "term", "n", p.alias("p"), q.alias("q"))
    # one row for each source that has the term, with its share
    has = F.filter(F.transform("p", lambda p, j: F.struct(j.alias("i"), p.alias("own"))), lambda x: F.get("n", x["i"]) > 0)
    each = rows.select("lang", "term", "n", "p", "q", F.inline(has))
    out = _pairs(each, langs).unionByName(_terms(each, langs, small, top))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _languages(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, sources (by UTF-8), totals (kept occurrences of each) and their sum, absent
    (share of a term that a source lacks), kept (terms)."""
    totals = terms.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sized = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    rows = sized.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g")).join(kept, "lang", "left")
    rows = common.stored(rows.select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept")), "languages")
    absent = F.when(F.col("kept") > 0, F.transform("totals", lambda t: share(F.lit(0).cast("long"), t, F.col("kept"))))
    return rows.select("*", absent.alias("absent"), F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


def _pairs(each: DataFrame, langs: DataFrame) -> DataFrame:
    """Each source of a language against each other one."""
    i, own = F.col("i"), F.col("own")
    # behind i every source; before it those without the term, as the others' rows have the pair
    behind = F.transform(F.slice("p", i + 2, F.size("p")), lambda q, k: F.struct((i + 1 + k).alias("j"), distance(own, q).alias("value")))
    before = F.transform(F.slice("p", F.lit(1), i), lambda q, k: F.when(F.get("n", k) == 0, F.struct(k.alias("j"), distance(own, q).alias("value"))))
    none = F.array().cast("array<struct<j:int,value:bigint>>")
    before = F.when(F.exists(F.slice("n", F.lit(1), i), lambda n: n == 0), F.array_compact(before)).otherwise(none)
    sums = each.select("lang", "i", F.inline(F.concat(behind, before)))
    sums = sums.groupBy("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("times"))
    every = langs.select("lang", "sources", "absent", "kept", F.posexplode("sources").alias("i", "source"))
    every = every.select("lang", "absent", "kept", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    alike = F.when(F.col("kept") > 0, distance(F.get("absent", F.col("i")), F.get("absent", F.col("j"))))
    every = every.select("lang", "source", "item", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "kept", alike.alias("alike"))
    zero = F.lit(0).cast("long")
    value = F.coalesce("sum", zero) + (F.col("kept") - F.coalesce("times", zero)) * F.coalesce("alike", zero)
    found = every.join(sums, ["lang", "i", "j"], "left").withColumn("value", value)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(each: DataFrame, langs: DataFrame, small, top: int) -> DataFrame:
    """What tells each source apart from its language: terms with a larger share there."""
    above = each.where("own > q").select("lang", "i", F.col("term").alias("item"), distance(F.col("own"), F.col("q")).alias("value"))
    # only the first ranks of each task are shuffled
    order = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(small(langs.select("lang", "sources")), "lang")
    return named.select("lang", F.get("sources", F.col("i")).alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
