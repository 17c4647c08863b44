"""Organization trees: closure, roll-up, validation, matching, clean-up.

orgs(id, name, level, parent_id, code, keywords array); links(job_id, org_id, ...).
Closures are equi joins, a level at a time, for as long as a level brings new pairs;
a cycle ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: fixed values: levels from the top
LEVELS = ("city", "district", "department", "unit")
#: fixed values: level-dependent scores of a match (department or unit, others)
FULL_NAME, VARIANT, KEYWORD = (0.96, 0.78), (0.76, 0.62), (0.68, 0.58)
GENERIC = (0.34, 0.28)


def _kept(df: DataFrame) -> DataFrame:
    """df computed once: in the checkpoint folder where the session has one, so that
    the lineage of a loop stays short, else in the executors' storage."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _parents(orgs: DataFrame) -> DataFrame:
    return orgs.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("__c"), F.col("parent_id").alias("__p"))


def _above(orgs: DataFrame) -> DataFrame:
    """(id, up, depth): everything above each organization, itself where it is in a
    cycle.  A level at a time, until one brings nothing new, however deep the tree."""
    parents = _kept(_parents(orgs).distinct())
    level = _kept(parents.select(F.col("__c").alias("id"), F.col("__p").alias("up"), F.lit(1).alias("depth")))
    found = level
    while not level.isEmpty():
        up = level.join(parents, F.col("up") == F.col("__c")).select("id", F.col("__p").alias("up"), (F.col("depth") + 1).alias("depth")).distinct()
        level = _kept(up.join(found, ["id", "up"], "left_anti"))
        found = found.unionByName(level)
    return found


def closure(orgs: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth), each org its own ancestor at depth 0."""
    own = orgs.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"))
    above = _above(orgs).where("id <> up").select(F.col("up").alias("ancestor"), F.col("id").alias("descendant"), "depth")
    out = own.unionByName(above.join(orgs.select(F.col("id").alias("ancestor")), "ancestor", "left_semi"))
    return out.groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth"))


def nearest_of_level(orgs: DataFrame, level: str = "department") -> DataFrame:
    """(id, at): the nearest organization of a level, upwards from each, itself included; NULL where
    none is above it (or only a cycle).

    Pointer doubling: each points at its parent, those of the level and roots at themselves; a round lets all
    point where what they point at does, so that chains of n take about log2(n) rounds.
    """
    known = _kept(orgs.select("id", "parent_id", (F.lower(F.trim("level")) == level).alias("is_level")).dropDuplicates(["id"]))
    parents = known.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    stays = F.coalesce("is_level", F.lit(False)) | F.col("known").isNull()
    at = _kept(known.join(parents, "parent_id", "left").select("id", F.when(stays, F.col("id")).otherwise(F.col("parent_id")).alias("at")))
    for _ in range(max(1, known.count().bit_length())):
        on = at.select(F.col("id").alias("at"), F.col("at").alias("next"))
        new = _kept(at.join(on, "at").select("id", "at", "next"))
        moved = new.where("at <> next").limit(1).count()
        at = new.select("id", F.col("next").alias("at"))
        if not moved:
            break
    good = known.where("is_level").select(F.col("id").alias("at"), F.lit(True).alias("good"))
    return at.join(good, "at", "left").select("id", F.when(F.col("good"), F.col("at")).alias("at"))


def rollup(orgs: DataFrame, stats: DataFrame, measures: list[str]) -> DataFrame:
    """stats(org_id, measures) summed over each org and all below it, beside its own."""
    own = stats.groupBy("org_id").agg(*[F.sum(m).alias(m) for m in measures])
    tree = closure(orgs).join(own, F.col("descendant") == F.col("org_id"), "left")
    zero = F.lit(0)
    direct = [F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col(m))), zero).alias(f"direct_{m}") for m in measures]
    return tree.groupBy(F.col("ancestor").alias("org_id")).agg(*[F.coalesce(F.sum(m), zero).alias(m) for m in measures], *direct)


def descendants(orgs: DataFrame, roots: DataFrame) -> DataFrame:
    return closure(orgs).join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()


def delete_preview(orgs: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root: organizations and job links that deleting it takes along."""
    tree = closure(orgs).join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    jobs = links.groupBy("org_id").agg(F.countDistinct("job_id").alias("jobs"))
    rows = tree.join(jobs, F.col("descendant") == F.col("org_id"), "left")
    return rows.groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("orgs"), F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"))


def validate(orgs: DataFrame) -> DataFrame:
    """(id, severity, problem): one row for each violated rule."""
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    counted = orgs.withColumn("place", place).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("id")))
    found = lambda df, problem, severity="error": df.select("id", F.lit(severity).alias("severity"), F.lit(problem).alias("problem"))
    once = counted.dropDuplicates(["id"]).where(F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != ""))
    fine = once.where("place > 0")
    parent = fine.select(F.col("id").alias("__pid"), F.col("level").alias("p_level"), F.col("place").alias("p_place"))
    kids = fine.where(F.col("parent_id").isNotNull()).join(parent, F.col("parent_id") == F.col("__pid"), "left")
    have = fine.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    checks = [
        found(orgs.where(F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "")), "id is missing"),
        found(once.where("times > 1"), "duplicate id"),
        found(once.where("place IS NULL OR place = 0"), "invalid level"),
        found(kids.where(F.col("__pid").isNull()), "missing parent"),
        found(kids.where("p_level = 'unit'"), "parent is a unit"),
        found(kids.where("place <= p_place"), "not below its parent"),
        found(kids.where("level = 'unit' AND p_level <> 'department'"), "unit outside a department"),
        found(fine.where("level = 'unit'").join(have, "id", "left_semi"), "unit has children"),
        found(fine.where("level = 'department'").join(have, "id", "left_anti"), "department has no units", "warning"),
        found(cycles(fine), "cycle"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def cycles(orgs: DataFrame) -> DataFrame:
    """Organizations that are their own ancestor.  Those that a root reaches are in no
    cycle; only what is left is followed upwards."""
    parents = _kept(_parents(orgs).distinct())
    level = _kept(orgs.select("id").distinct().join(parents.join(orgs.select(F.col("id").alias("__p")).distinct(), "__p", "left_semi").select(F.col("__c").alias("id")), "id", "left_anti"))
    reached = level
    while not level.isEmpty():
        level = _kept(level.join(parents, F.col("id") == F.col("__p")).select(F.col("__c").alias("id")).distinct().join(reached, "id", "left_anti"))
        reached = reached.unionByName(level)
    rest = _kept(orgs.join(reached, "id", "left_anti").select("id", "parent_id"))
    return _above(rest).where("id = up").select("id").distinct()


def unresolved(links: DataFrame, orgs: DataFrame) -> DataFrame:
    """Links to organizations that do not exist."""
    return links.join(orgs.select(F.col("id").alias("org_id")), "org_id", "left_anti")


def last_link(links: DataFrame, ord_col: str) -> DataFrame:
    """The last link of each job."""
    rest = [c for c in links.columns if c != "job_id"]
    last = links.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.col(ord_col)).alias("l"))
    return last.select("job_id", *[F.col(f"l.{c}").alias(c) for c in rest])


def remap_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """links with org_id replaced by mapping(old_id, new_id) where it has one."""
    return links.join(mapping.withColumnRenamed("old_id", "org_id"), "org_id", "left").withColumn("org_id", F.coalesce("new_id", "org_id")).drop("new_id")


def minimal_roots(orgs: DataFrame, name_pattern: str) -> DataFrame:
    """Organizations whose name matches and none of whose ancestors' does."""
    hit = orgs.where(F.col("name").rlike(name_pattern)).select("id")
    above = closure(orgs).where("depth > 0").join(hit.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id"))
    return hit.join(above, "id", "left_anti")


def resolve_parents(rows: DataFrame, known: DataFrame, passes: int = 5) -> tuple[DataFrame, DataFrame]:
    """Import in passes: rows(id, name, parent_name, ...) whose parent is known are
    taken; after `passes` the rest is returned as unresolved."""
    taken = None
    for _ in range(passes):
        names = known.groupBy(F.col("name").alias("parent_name")).agg(F.min("id").alias("parent_id"))
        ok = rows.join(names, "parent_name", "left").where(F.col("parent_name").isNull() | F.col("parent_id").isNotNull())
        known = known.select("id", "name").unionByName(ok.select("id", "name"))
        taken = ok if taken is None else taken.unionByName(ok)
        rows = rows.join(ok.select("id"), "id", "left_anti")
    return taken, rows


def _by_level(scores: tuple[float, float]) -> Column:
    return F.when(F.col("level").isin("department", "unit"), F.lit(scores[0])).otherwise(F.lit(scores[1]))


def _covered(part: Column, whole: Column, bonus: tuple[float, float, float]) -> Column:
    c = F.length(part) / F.greatest(F.length(whole), F.lit(1))
    return F.when(c >= 0.85, bonus[0]).when(c >= 0.65, bonus[1]).when(c >= 0.45, bonus[2]).otherwise(0.0)


def match(texts: DataFrame, orgs: DataFrame, generic: tuple[str, ...] = (), threshold: float = 0.6) -> DataFrame:
    """texts(job_id, text) -> job_id, org_id, confidence: the best organization, if
    good enough; of equals the one with the longer name, then the smaller id.

    orgs(id, name, level, variants array, keywords array) is a dimension of some
    thousand rows and goes to every task; texts stream past it.
    """
    known = orgs.select("id", "level", X.match_name(F.col("name")).alias("name"), F.transform(F.coalesce("variants", F.array().cast("array<string>")), X.match_name).alias("variants"), F.transform(F.coalesce("keywords", F.array().cast("array<string>")), X.match_name).alias("keywords"))
    rows = texts.select("job_id", F.col("text").alias("raw"), X.match_name(F.col("text")).alias("t"))
    pairs = rows.join(F.broadcast(known), (F.col("name") != "") & (F.col("t").contains(F.col("name")) | F.exists("variants", lambda v: (v != "") & F.contains(F.col("t"), v)) | F.exists("keywords", lambda k: (k != "") & F.contains(F.col("t"), k)) | X.any_gram_in(F.col("name"), F.col("t"))))
    is_generic = lambda w: w.isin(*generic) if generic else F.lit(False)
    best = lambda words, score: F.coalesce(F.array_max(F.transform(F.filter(words, lambda w: (w != "") & F.contains(F.col("t"), w)), score)), F.lit(0.0))
    full = F.when(F.col("t").contains(F.col("name")), _by_level(FULL_NAME)).otherwise(0.0)
    variant = best(F.col("variants"), lambda w: F.when(is_generic(w), _by_level(GENERIC)).otherwise(F.least(F.lit(0.94), _by_level(VARIANT) + _covered(w, F.col("name"), (0.12, 0.08, 0.03)) + F.when(F.length(w) >= 4, 0.04).otherwise(0.0))))
    keyword = best(F.col("keywords"), lambda w: F.when(is_generic(w), F.lit(0.32)).otherwise(F.least(F.lit(0.9), _by_level(KEYWORD) + _covered(w, F.col("name"), (0.16, 0.10, 0.05)) + F.when(F.length(w) >= 4, 0.03).otherwise(0.0))))
    fuzzy = F.when(X.any_gram_in(F.col("name"), F.col("t")), 0.5).otherwise(0.0)
    unit_hint, dept_hint = F.col("raw").rlike("单位|本级"), F.col("raw").contains("部门")
    hint = F.when(unit_hint & (F.col("level") == "unit"), 0.12).when(~unit_hint & dept_hint & (F.col("level") == "department"), 0.08).otherwise(0.0)
    scored = pairs.withColumn("confidence", F.least(F.lit(0.99), F.greatest(full, variant, keyword, fuzzy) + hint))
    top = scored.groupBy("job_id").agg(F.max_by(F.struct(F.col("id").alias("org_id"), "confidence"), F.struct("confidence", F.length("name"), F.col("id").cast("string"))).alias("m"))
    return top.select("job_id", "m.org_id", "m.confidence").where(F.col("confidence") >= threshold)


def rematch(current: DataFrame, texts: DataFrame, orgs: DataFrame) -> DataFrame:
    """Preview of matching all jobs again: job_id, old, new, change."""
    new = match(texts, orgs).select("job_id", F.col("org_id").alias("new"))
    both = current.select("job_id", F.col("org_id").alias("old")).join(new, "job_id", "full_outer")
    change = F.when(F.col("old").eqNullSafe(F.col("new")), "same").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "lost").otherwise("moved")
    return both.withColumn("change", change)


def name_variants(name: str, suffixes: tuple[str, ...], tokens: tuple[str, ...]) -> list[str]:
    """Closure of a name under dropping suffixes, brackets and tokens (a small
    dimension, on the driver)."""
    import re

    seen, work = {name}, [name]
    while work:
        n = work.pop()
        nxt = [n[: -len(s)] for s in suffixes if n.endswith(s)] + [re.sub(r"[(（][^)）]*[)）]", "", n)] + [n.replace(t, "") for t in tokens if t in n]
        for v in nxt:
            if len(v) >= 2 and v not in seen:
                seen.add(v)
                work.append(v)
    return sorted(seen - {name})
