"""URL rules by host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict.  Every URL is expanded into the
expressions suffix-of-host + prefix-of-path that could be a rule; these are
joined to the rules on a short prefix of their digest (32 bits), confirmed by
the full digest, and the longest rule that fits decides.

Defined cases: a null URL, or one without `://`, has an empty host and path and
no rule.  Hosts compare with A-Z lower-cased; labels are split at dots and a rule
fits its host and all subdomains.  Repeated rows are kept.  Of equally long rules
the one with the longer host wins, of the same rule given twice `block`.  An
empty table gives an empty result; without rules every URL gets the default.  Of very
long URLs only as many path prefixes are made as rules have lengths.  Columns other
than page_id and url are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ALLOW, BLOCK = "allow", "block"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """pages(page_id, url) x rules(host, path, verdict) -> page_id, host, path, rule, verdict."""
    rules = rules.select(F.translate("host", _AZ, _az).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    # NUL keeps (host, path) apart; it cannot stand in a host
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\x00"), path), 256)
    rules = common.stored(rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, 8)), "rules")
    # prefixes are needed only at the lengths that rules have; there are no more of these than characters in a URL
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().orderBy(F.length("r_path")).collect()]
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.where("host <> ''")
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    expanded = (
        urls.withColumn("r_host_x", F.explode(host_suffixes(F.col("host"))))
        .withColumn("n", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))))
        .select("url", digest(F.col("r_host_x"), F.expr("substring(path, 1, n)")).alias("digest"))
        .withColumn("r_short", F.substring("digest", 1, 8))
    )
    if rules.count() <= 1_000_000:
        hits = expanded.join(F.broadcast(rules), "r_short")
    else:
        hits = expanded.join(rules, "r_short")
    hits = hits.where("digest = r_digest")
    best = common.stored(
        hits.groupBy("url")
        .agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
        .select(F.col("url").alias("__url"), "best.rule", F.col("best.verdict").alias("__verdict")),
        "verdicts",
    )
    return pages.select("page_id", "url").join(best, F.col("url") == F.col("__url"), "left").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("__verdict", F.lit(default)).alias("verdict"))
