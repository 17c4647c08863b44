"""Finding algebra: numbering, deduplication, matching of two detectors, conflicts, merging.

findings(doc_id, id, ord, rule, severity, title, page, section, table, tags array,
metrics map<string,double>, ...).  Order-dependent steps run per document, whose
findings are few; all else are Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions import text as X
from .hierarchy import _kept

#: fixed values: severities by level
LEVELS = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


@dataclass(frozen=True)
class MergeConfig:
    title_similarity: float = 0.85
    page_tolerance: int = 1
    money_tolerance: float = 0.005


def numbered(found: DataFrame) -> DataFrame:
    """no, label: order by page (unknown last), place, then as emitted."""
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("page"), F.asc_nulls_last("pos"), "ord")
    out = found.withColumn("no", F.row_number().over(w))
    return out.withColumn("label", X.ordinal(F.col("no")))


def dedupe(found: DataFrame, keys: list[Column], ord_col: str = "ord") -> DataFrame:
    """The first finding of each key, in the order of emission."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = found.withColumns(dict(zip(names, keys, strict=True)))
    w = Window.partitionBy(*names).orderBy(ord_col)
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", *names)


def semantic_key() -> list[Column]:
    """Key of findings that say the same: rule, page and place in steps of 25 characters."""
    return [F.col("doc_id"), F.col("rule"), F.col("page"), F.floor(F.col("pos") / 25)]


def without_noise(found: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return found.where(~F.col("message").rlike("|".join(patterns)))


def without_ignored(found: DataFrame, ignored: DataFrame) -> DataFrame:
    """Findings whose (doc_id, id) nobody has ignored."""
    return found.join(ignored.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def buckets(found: DataFrame) -> DataFrame:
    """Per document the counts of error / warn / info."""
    b = F.col("__bucket")
    return found.select("doc_id", S.bucket(F.col("severity")).alias("__bucket")).groupBy("doc_id").agg(*[F.count_if(b == x).alias(x) for x in ("error", "warn", "info")], F.count(F.lit(1)).alias("all"))


def capped(found: DataFrame, most: int = 50) -> DataFrame:
    """At most `most` per document: by severity, then confidence, if there are more."""
    w = Window.partitionBy("doc_id").orderBy(S.rank(F.col("severity")).desc(), F.col("confidence").desc(), "ord")
    return found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


# ---------------------------------------------------------- similarity of pairs


def location_similarity(a: str, b: str, c: MergeConfig, ratio=None) -> Column:
    """Pages within tolerance (0.5), sections (0.3) and tables (0.2) alike, over
    the weights of what both have.  ratio: a string similarity 0..1."""
    f = lambda s, n: F.col(f"{s}.{n}")
    ratio = ratio or (lambda x, y: (x == y).cast("double"))
    both = lambda n: f(a, n).isNotNull() & f(b, n).isNotNull()
    page = F.when(both("page"), (F.abs(f(a, "page") - f(b, "page")) <= c.page_tolerance).cast("double") * 0.5)
    section = F.when(both("section"), ratio(f(a, "section"), f(b, "section")) * 0.3)
    table = F.when(both("table"), ratio(f(a, "table"), f(b, "table")) * 0.2)
    weight = F.when(both("page"), 0.5).otherwise(0.0) + F.when(both("section"), 0.3).otherwise(0.0) + F.when(both("table"), 0.2).otherwise(0.0)
    zero = F.lit(0.0)
    return F.coalesce(F.try_divide(F.coalesce(page, zero) + F.coalesce(section, zero) + F.coalesce(table, zero), weight), zero)


def tag_similarity(a: Column, b: Column) -> Column:
    low = lambda t: F.transform(F.coalesce(t, F.array().cast("array<string>")), F.lower)
    return F.when((F.size(low(a)) == 0) | (F.size(low(b)) == 0), F.lit(0.0)).otherwise(X.jaccard(low(a), low(b)))


def metric_similarity(a: Column, b: Column, c: MergeConfig) -> Column:
    """Mean over common keys: 1 within the tolerance, else 1 less the relative difference."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))

    def one(k: Column) -> Column:
        x, y = a[k], b[k]
        rel = F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y)))
        return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).when(rel <= c.money_tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - rel))

    total = F.aggregate(F.transform(keys, one), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.coalesce(F.try_divide(total, F.size(keys)), F.lit(0.0))


def candidate_pairs(ai: DataFrame, rule: DataFrame, title_ratio, c: MergeConfig = MergeConfig()) -> DataFrame:
    """Pairs of one document with their similarity, at least the threshold.  The
    join is on doc_id; a document has few findings of either kind."""
    a, r = ai.alias("a"), rule.alias("r")
    pairs = a.join(r, F.col("a.doc_id") == F.col("r.doc_id"))
    title = title_ratio(F.lower(F.col("a.title")), F.lower(F.col("r.title")))
    # titles weigh 0.4: most pairs go by theirs, before the rest is compared
    pairs = pairs.where(title * 0.4 + 0.6 >= c.title_similarity - 1e-9)
    sim = title * 0.4 + location_similarity("a", "r", c) * 0.3 + tag_similarity(F.col("a.tags"), F.col("r.tags")) * 0.2 + metric_similarity(F.col("a.metrics"), F.col("r.metrics"), c) * 0.1
    out = pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("ai_id"), F.col("r.id").alias("rule_id"), F.col("a.ord").alias("i"), F.col("r.ord").alias("j"), sim.alias("similarity"))
    return out.where(F.col("similarity") >= c.title_similarity)


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches: best similarity first, of equals the later pair.

    A document's pairs come sorted, one after another, so a pass over each
    partition is enough; thousands of small documents share one Arrow batch.
    """
    kind = pairs.schema

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, used_i, used_j = None, set(), set()
        for f in frames:
            keep = []
            for d, i, j in zip(f["doc_id"], f["i"], f["j"], strict=True):
                if d != doc:
                    doc, used_i, used_j = d, set(), set()
                free = i not in used_i and j not in used_j
                keep.append(free)
                if free:
                    used_i.add(i)
                    used_j.add(j)
            yield f.loc[keep, ["doc_id", "ai_id", "rule_id", "similarity"]]

    ordered = pairs.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("similarity"), F.desc("i"), F.desc("j"))
    return ordered.mapInPandas(match, f"doc_id {kind['doc_id'].dataType.simpleString()}, ai_id {kind['ai_id'].dataType.simpleString()}, rule_id {kind['rule_id'].dataType.simpleString()}, similarity double")


def conflicts(matches: DataFrame, ai: DataFrame, rule: DataFrame, c: MergeConfig = MergeConfig()) -> DataFrame:
    """matches plus reasons: severities two levels apart, values beyond the
    tolerance, pages too far apart; reason is the first of these."""
    a, r = ai.alias("a"), rule.alias("r")
    rows = matches.alias("m").join(a, (F.col("m.doc_id") == F.col("a.doc_id")) & (F.col("m.ai_id") == F.col("a.id"))).join(r, (F.col("m.doc_id") == F.col("r.doc_id")) & (F.col("m.rule_id") == F.col("r.id")))

    def level(x: Column) -> Column:
        out = F.lit(0)
        for k, v in LEVELS.items():
            out = F.when(x == k, F.lit(v)).otherwise(out)
        return out

    x, y = F.col("a.metrics"), F.col("r.metrics")
    off = F.exists(F.array_intersect(F.map_keys(x), F.map_keys(y)), lambda k: (x[k] != 0) & (y[k] != 0) & (F.abs(x[k] - y[k]) / F.greatest(F.abs(x[k]), F.abs(y[k])) > c.money_tolerance))
    reasons = F.array_compact(
        F.array(
            F.when(F.abs(level(F.col("a.severity")) - level(F.col("r.severity"))) >= 2, F.lit("severity-mismatch")),
            F.when(F.coalesce(off, F.lit(False)), F.lit("value-mismatch")),
            F.when((F.col("a.page") > 0) & (F.col("r.page") > 0) & (F.abs(F.col("a.page") - F.col("r.page")) > c.page_tolerance), F.lit("page-mismatch")),
        )
    )
    return rows.select("m.*", reasons.alias("reasons"), F.get(reasons, F.lit(0)).alias("reason"))


def merge_totals(ai: DataFrame, rule: DataFrame, matched: DataFrame) -> DataFrame:
    """Per document: findings of both, matches, conflicts, agreements (matches
    without a conflict) and what is left after merging."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    m = matched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.count("reason").alias("conflicts"))
    zero = F.lit(0)
    out = n(ai, "ai").join(n(rule, "rule"), "doc_id", "full_outer").join(m, "doc_id", "left")
    a, r, k = F.coalesce("ai", zero), F.coalesce("rule", zero), F.coalesce("matches", zero)
    return out.select("doc_id", a.alias("ai"), r.alias("rule"), k.alias("matches"), F.coalesce("conflicts", zero).alias("conflicts"), (k - F.coalesce("conflicts", zero)).alias("agreements"), (a + r - k).alias("merged"))


def merged_ids(ai: DataFrame, rule: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, place, id): matched AI findings, best first (similarities that agree to
    nine places are equal), then unmatched ones, then unmatched rule findings."""
    matches = _kept(matches)
    first = matches.select("doc_id", F.col("ai_id").alias("id"), F.lit(0).alias("__g"), F.round(-F.col("similarity"), 9).alias("__o"))
    rest = lambda df, key, g: df.join(matches.select("doc_id", F.col(key).alias("id")), ["doc_id", "id"], "left_anti").select("doc_id", "id", F.lit(g).alias("__g"), F.col("ord").cast("double").alias("__o"))
    every = first.unionByName(rest(ai, "ai_id", 1)).unionByName(rest(rule, "rule_id", 2))
    return every.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("__g", "__o", "id")).alias("place"), "id")


def smart_merge(rule: DataFrame, ai: DataFrame, threshold: float = 0.8, boost: bool = True) -> DataFrame:
    """Rule findings take up the AI findings that resemble them, in order; others
    stay as they are.  Similarity: same rule 0.4, Jaccard of words 0.4, one
    snippet inside the other 0.2.  A longer AI description replaces the rule's;
    confirmed findings gain a level of confidence.

    Both sides: doc_id long, ord int, rule string, description string, snippet
    string, confidence string.
    """

    def words(s: str) -> set:
        return set((s or "").lower().split())

    def similarity(a, b) -> float:
        x, y = words(a.description), words(b.description)
        s, t = (a.snippet or "").lower(), (b.snippet or "").lower()
        word = len(x & y) / len(x | y) if x and y else 0.0
        return min(1.0, 0.4 * (a.rule == b.rule) + 0.4 * word + 0.2 * bool(s and t and (s in t or t in s)))

    raised = {"LOW": "MEDIUM", "MEDIUM": "HIGH", "HIGH": "HIGH"}

    def merged(rules: list, free: list) -> list:
        out = []
        for r in rules:
            scored = [(similarity(r, a), a) for a in free]
            taken = [(s, a) for s, a in scored if s >= threshold]
            free = [a for s, a in scored if s < threshold]
            best = max((a.description or "" for _, a in taken), key=len, default="")
            longer = len(best) > len(r.description or "")
            out.append((r.doc_id, r.rule, best if longer else r.description, r.snippet, raised.get(r.confidence, r.confidence) if taken and boost else r.confidence, "rule_and_ai" if taken else "rule", len(taken), max((s for s, _ in taken), default=0.0)))
        return out + [(a.doc_id, a.rule, a.description, a.snippet, a.confidence, "ai", 0, 0.0) for a in free]

    names = ["doc_id", "rule", "description", "snippet", "confidence", "source", "confirmations", "similarity"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A document's rows come one after another, rule findings first."""
        doc, held = None, ([], [])
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.doc_id != doc:
                    out += merged(*held)
                    doc, held = r.doc_id, ([], [])
                held[r.side].append(r)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(merged(*held), columns=names)

    cols = ["doc_id", "ord", "rule", "description", "snippet", "confidence"]
    side = lambda df, k: df.where(F.col("rule").isNotNull() & (F.length(F.trim("description")) > 5)).select(*cols, F.lit(k).alias("side"))
    rows = side(rule, 0).unionByName(side(ai, 1)).repartition("doc_id").sortWithinPartitions("doc_id", "side", "ord")
    return rows.mapInPandas(run, "doc_id long, rule string, description string, snippet string, confidence string, source string, confirmations int, similarity double")


def display(found: DataFrame) -> DataFrame:
    """summary and detail lines of a finding."""
    place = F.concat_ws(" / ", F.when(F.col("page").isNotNull(), F.concat(F.lit("p."), F.col("page").cast("string"))), F.col("section"), F.col("table"))
    detail = F.concat_ws("; ", F.transform(F.array_sort(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,double>")))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return found.withColumn("summary", F.concat_ws(" - ", F.nullif(place, F.lit("")), F.col("title"))).withColumn("detail", detail)
