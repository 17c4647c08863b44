"""Pairs of findings that resemble each other, without looking at all pairs of a document.

The similarity of titles is 2 M / (|a| + |b|), M the matched characters.  M is at most the
size of the multiset intersection of both, so that a pair that can reach a threshold shares
a token (character, occurrence) among the first of both when tokens are put in one
order.  Pairs of documents with many findings meet on such tokens; only those whose intersection is large
enough are compared by the sequence ratio.  Where one side has few findings, their tokens would be more
rows than their pairs: all pairs meet, and what cannot reach the threshold goes by its place and edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import MergeConfig, location_similarity, metric_similarity, tag_similarity
from .hierarchy import _kept
from .tables import sequence_ratio_udf

def numbered_characters(chars: str) -> Column:
    """Of a column of sorted characters: each with the number of its occurrence, a set whose
    intersections have the sizes of the multisets' ones.  In an order of its own: later
    occurrences, which fewer texts have, come first."""
    number = lambda c, i: i - F.array_position(F.col(chars), c) + 1
    return F.sort_array(F.transform(chars, lambda c, i: F.struct((-number(c, i)).alias("minus"), F.xxhash64(c).alias("h"), F.concat(c, number(c, i).cast("string")).alias("token"))))


def text_pairs(left: DataFrame, right: DataFrame, least: float, text: str = "title", needed=None) -> DataFrame:
    """doc_id, left_id, right_id, ratio of the pairs of one document whose texts (lower-cased) have a
    sequence ratio of at least `least`; both sides: doc_id, id, text.  A NULL text has none.
    needed: given the pairs that met, returns them with `need`, the ratio that each must reach."""
    if least <= 0:
        whole = lambda df, name, t: df.select(F.col("doc_id").alias("doc_id"), F.col("id").alias(name), F.lower(text).alias(t)).where(F.col(t).isNotNull())
        both = whole(left, "left_id", "x").join(whole(right, "right_id", "y"), "doc_id")
        return both.select(F.col("doc_id").alias("doc_id"), "left_id", "right_id", sequence_ratio_udf("x", "y").alias("ratio"))

    def side(df: DataFrame) -> DataFrame:
        low = F.lower(text)
        some = df.where(F.col(text).isNotNull()).select("doc_id", "id", low.alias("text"), F.when(low == "", F.array().cast("array<string>")).otherwise(F.sort_array(F.split(low, ""))).alias("chars"))
        return some.select("doc_id", "id", "text", numbered_characters("chars")["token"].alias("tokens"))

    a, b = side(left), side(right)

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        """The first tokens of each text: without them, too few are left for the threshold."""
        # the other text has at least least / (2 - least) of the size, and so has the intersection
        needed = F.ceil(F.size("tokens") * least / (2 - least) - 1e-9)
        return df.select("doc_id", F.col("id").alias(name), F.explode(F.slice("tokens", F.lit(1), (F.size("tokens") - needed + 1).cast("int"))).alias("token"))

    met = prefixes(a, "left_id").join(prefixes(b, "right_id"), ["doc_id", "token"]).select("doc_id", "left_id", "right_id").distinct()
    met = needed(met) if needed else met.withColumn("need", F.lit(float(least)))
    whole = lambda df, name, t, k: df.select("doc_id", F.col("id").alias(name), F.col("text").alias(t), F.col("tokens").alias(k))
    both = met.join(whole(a, "left_id", "x", "xs"), ["doc_id", "left_id"]).join(whole(b, "right_id", "y", "ys"), ["doc_id", "right_id"])
    can = both.where(2 * F.size(F.array_intersect("xs", "ys")) >= F.col("need") * (F.size("xs") + F.size("ys")) - 1e-9)
    found = can.select("doc_id", "left_id", "right_id", sequence_ratio_udf("x", "y").alias("ratio"))
    empty = a.where("text = ''").select("doc_id", F.col("id").alias("left_id")).join(b.where("text = ''").select("doc_id", F.col("id").alias("right_id")), "doc_id").select("doc_id", "left_id", "right_id", F.lit(1.0).alias("ratio"))
    return found.where(F.col("ratio") >= least).unionByName(empty)


#: documents with at most so many findings on one side compare all pairs, which are so many for a finding at most
FEW = 64


def crowded(ai: DataFrame, rule: DataFrame) -> DataFrame:
    """doc_id of documents with more than FEW findings on both sides."""
    sides = ai.select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(rule.select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("r")))
    return sides.groupBy("doc_id").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).where((F.col("a") > FEW) & (F.col("r") > FEW)).select("doc_id")


def candidate_pairs(ai: DataFrame, rule: DataFrame, c: MergeConfig = MergeConfig()) -> DataFrame:
    """Pairs of one document whose whole similarity reaches the threshold: titles weigh 0.4, so that
    the rest leaves a least ratio of titles to look for."""
    many = _kept(crowded(ai, rule))
    if many.isEmpty():
        return _all_pairs(ai, rule, c)
    few, large = ([df.join(many, "doc_id", how) for df in (ai, rule)] for how in ("left_anti", "left_semi"))
    return _all_pairs(*few, c).unionByName(_blocked_pairs(*large, c))


def _all_pairs(ai: DataFrame, rule: DataFrame, c: MergeConfig) -> DataFrame:
    """The pairs that a join on the document gives; bounds come first, from cheap to dear."""
    least = max(0.0, (c.title_similarity - 0.6) / 0.4)
    x, y = F.lower("a.title"), F.lower("r.title")
    both = ai.alias("a").join(rule.alias("r"), F.col("a.doc_id") == F.col("r.doc_id"))
    place = lambda ratio: location_similarity("a", "r", c, ratio) * 0.3
    others = lambda ratio: place(ratio) + tag_similarity(F.col("a.tags"), F.col("r.tags")) * 0.2 + metric_similarity(F.col("a.metrics"), F.col("r.metrics"), c) * 0.1
    alike = lambda p, q: F.lit(1.0)
    can = x.isNotNull() & y.isNotNull()
    need = lambda rest: (c.title_similarity - rest) / 0.4
    least_need = need(place(alike) + 0.3)
    # matched characters are a common subsequence: of n characters in both titles, a ratio takes
    # at most (1 - ratio) * n edits
    edits = F.greatest(F.lit(0), F.least(F.floor((1 - least_need) * (F.length(x) + F.length(y)) + 1e-6).cast("int"), F.greatest(F.length(x), F.length(y))))
    can = can & (least_need <= 1.000001) & (F.call_function("levenshtein", x, y, edits) >= 0) & (need(others(alike)) <= 1.000001)
    ratio = sequence_ratio_udf(x, y)
    sim = ratio * 0.4 + others(sequence_ratio_udf)
    out = both.where(can).select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("ai_id"), F.col("r.id").alias("rule_id"), F.col("a.ord").alias("i"), F.col("r.ord").alias("j"), ratio.alias("ratio"), sim.alias("similarity"))
    return out.where((F.col("ratio") >= least) & (F.col("similarity") >= c.title_similarity)).drop("ratio")


def _blocked_pairs(ai: DataFrame, rule: DataFrame, c: MergeConfig) -> DataFrame:
    """The same, of titles that meet on their first tokens."""
    least = max(0.0, (c.title_similarity - 0.6) / 0.4)
    others = lambda ratio: location_similarity("a", "r", c, ratio) * 0.3 + tag_similarity(F.col("a.tags"), F.col("r.tags")) * 0.2 + metric_similarity(F.col("a.metrics"), F.col("r.metrics"), c) * 0.1

    def needed(met: DataFrame) -> DataFrame:
        """What the rest leaves for the title, sections and tables taken for alike."""
        both = met.join(ai.alias("a"), (met["doc_id"] == F.col("a.doc_id")) & (met["left_id"] == F.col("a.id"))).join(rule.alias("r"), (met["doc_id"] == F.col("r.doc_id")) & (met["right_id"] == F.col("r.id")))
        need = (c.title_similarity - others(lambda x, y: F.lit(1.0))) / 0.4
        return both.select(met["doc_id"], "left_id", "right_id", need.alias("need")).where("need <= 1.000001")

    near = text_pairs(ai, rule, least, needed=needed)
    pairs = near.join(ai.alias("a"), (near["doc_id"] == F.col("a.doc_id")) & (near["left_id"] == F.col("a.id"))).join(rule.alias("r"), (near["doc_id"] == F.col("r.doc_id")) & (near["right_id"] == F.col("r.id")))
    sim = near["ratio"] * 0.4 + others(sequence_ratio_udf)
    out = pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("ai_id"), F.col("r.id").alias("rule_id"), F.col("a.ord").alias("i"), F.col("r.ord").alias("j"), sim.alias("similarity"))
    return out.where(F.col("similarity") >= c.title_similarity)
