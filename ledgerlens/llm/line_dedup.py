"""Line deduplication by an exact set-similarity self-join (DataFrame only).

A line's tokens are its distinct 5-word shingles (lower-cased; a shorter line is one
token, its whole word sequence).  A line is removed if a line before it (by doc_id,
then place in the text) has a token set of Jaccard similarity at least NUM/DEN,
whether or not that one is removed itself.

1. Every line is tokenized once; lines with equal sets form a class.  Tokens are
   counted over the whole corpus in BUCKETS buckets, and a token's frequency step
   is written in front of its hash, so that an array of longs in ascending order
   has rare tokens first.  The order bears on speed alone.
2. A line keeps its n - ceil(t n) + 1 rarest tokens (prefix filter).  One
   aggregation finds the tokens that two classes have in their prefixes; only
   rows of these go on.
3. Rows of a token that agree in size (length filter) and whose places leave
   enough tokens behind (positional filter) are candidates.  Where the groups of
   tokens are small, so that all their pairs are few (counted beforehand), all are
   made at once.  Otherwise at first each class
   tries the earliest of the group it meets most often, so that a group of near
   copies is settled in linear work; classes still kept then try the earliest that
   is still kept, round by round, and at last all others, unless bitmaps of how two
   classes differ from a common centre show them to be too far apart.
4. Candidates are decided by intersecting their whole token arrays, which are made
   anew from the lines that are in a pair.

Defined cases: lines with fewer than `min_words` words are always kept.  A null text
stays null, an empty one empty; both have no lines.  A text that loses all its lines
becomes empty.  Very long texts are split into lines like others.  Rows that repeat
doc_id and text are one document and are treated alike; rows that share only the
doc_id are ordered by a hash of their text.  Null doc_ids come first.  An empty table
gives an empty result.  Columns other than text are carried along; n_lines and
n_removed of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
#: the threshold as a fraction, so that all bounds are exact in integers
NUM, DEN = 80, 100
#: least size of a set that can be similar to another one: n / (n + 1) >= NUM / DEN
ALIKE = -(-NUM // (DEN - NUM))
#: bits of a token's hash; the bits above hold its frequency step
HASH_BITS = 58
STEPS = 1 << (64 - HASH_BITS)
#: buckets of the count of tokens, a table of fixed size
BUCKETS = 1 << 16
#: 64-bit words of the bitmap of a difference
BITMAP = 4
#: rounds in which kept classes try the earliest kept one, before all are compared;
#: a round that settles less than one in SETTLES of the classes with a centre is the last
ROUNDS, SETTLES = 4, 20
#: all pairs of the tokens' groups are made at once where there are at most PAIRS for
#: each member and no group has more than GROUP members
PAIRS, GROUP = 16, 2000
_NO_ID = -(1 << 63)


def needed(a: Column, b: Column) -> Column:
    """Least overlap of sets of sizes a and b that are similar."""
    return F.ceil((a + b) * NUM / (NUM + DEN)).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null ids first), row (tells rows of one doc_id apart), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text").where("text is not null")


def _tokens(worded: DataFrame, *keep: str) -> DataFrame:
    """keep, and tokens: sorted distinct shingle hashes of HASH_BITS bits of words.

    A word is hashed once; hashes of neighbours are joined to those of 2, 3 and 5
    words.  Past the end there are nulls, which the hash passes over.
    """

    def joined(df: DataFrame, by: int, bits: int = 64) -> DataFrame:
        both = lambda a, b: F.shiftrightunsigned(F.xxhash64(a, b), 64 - bits) if bits < 64 else F.xxhash64(a, b)
        return df.select(*keep, F.zip_with("h", F.slice("h", by + 1, F.size("h")), both).alias("h"))

    found = worded.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    found = joined(joined(joined(found, 1), 1), 2, HASH_BITS)
    shingles = F.slice("h", 1, F.greatest(F.size("h") - (WIDTH - 1), F.lit(1)))
    return found.select(*keep, F.array_distinct(F.sort_array(shingles)).alias("tokens"))


def _plain(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, and lines: the text's lines (lower-cased, white space as spaces)."""
    low = docs.select(*keep, F.lower("text").alias("low"))  # apart, so that it is done once
    other = [F.contains("low", F.lit(c)) for c in "\t\x0b\x0c\r"]
    plain = F.when(other[0] | other[1] | other[2] | other[3], F.regexp_replace("low", r"[\t\x0B-\r]", " ")).otherwise(F.col("low"))
    return low.select(*keep, F.split(plain, "\n").alias("lines"))


def _split(docs: DataFrame) -> DataFrame:
    """doc, row, place, line of every line with a word.  The outer form, as a text has a
    line always: for the other one Spark splits every text again to see whether it has."""
    return _plain(docs, "doc", "row").select("doc", "row", F.posexplode_outer("lines").alias("place", "line")).where(F.trim("line") != "")


def _words(line: str = "line") -> Column:
    words = F.split(line, " ")
    spare = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(spare, F.array_remove(words, "")).otherwise(words)


def _tokenized(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, row, place, tokens, n, and the class: two hashes of the set."""
    worded = _split(docs).select("doc", "row", "place", _words().alias("words"))
    worded = worded.where(F.size("words") >= min_words) if min_words > 1 else worded
    lines = _tokens(worded, "doc", "row", "place")
    return lines.select("doc", "row", "place", "tokens", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("cls"), F.hash("tokens").alias("cls2"))


def _steps(lines: DataFrame) -> DataFrame:
    """One row: the frequency step of each bucket.  Steps are a sixth of an octave
    above the mean count; a bucket's count is at least that of each token in it."""
    spark = lines.sparkSession
    counts = lines.select(F.explode_outer("tokens").alias("token")).groupBy(F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = common.stored(spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    mean = max(1.0, counts.agg(F.avg("n")).first()[0])
    step = F.least(F.greatest(F.floor(6 * F.log2(F.greatest("n", F.lit(1)) / mean)) + 1, F.lit(0)), F.lit(STEPS - 1)) - STEPS // 2
    every = counts.select("bucket", step.cast("long").alias("step")).agg(F.sort_array(F.collect_list(F.struct("bucket", "step"))).alias("s"))
    return common.stored(every.select(F.col("s.step").alias("steps")), "steps")


def _ordered(found: Column, steps: Column) -> Column:
    """The tokens with their steps in front, rare ones first."""
    return F.sort_array(F.transform(found, lambda t: F.shiftleft(F.element_at(steps, t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1), HASH_BITS).bitwiseOR(t)))


def _pos(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("doc", "row", "place")])


def _sizes_allow(a: str, b: str) -> Column:
    """Length filter, and the positional one: sets meet at the first token that both
    have, behind which enough others must be left."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return (F.col(f"{a}.n") * DEN >= F.col(f"{b}.n") * NUM) & (F.col(f"{b}.n") * DEN >= F.col(f"{a}.n") * NUM) & (left >= needed(F.col(f"{a}.n"), F.col(f"{b}.n")))


def _classes(lines: DataFrame) -> DataFrame:
    """cls, cls2, doc, row and place of its first line, times.  Numbers are counted and
    compared in the aggregation's own rows; classes of several lines then get their first."""
    key = ["cls", "cls2"]
    found = lines.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("doc", "row", "place")], F.count(F.lit(1)).alias("times"))
    found = common.stored(found, "classes")
    several = found.where("times > 1")
    firsts = common.matching(lines.select(*key, "doc", "row", "place"), several.select(*key), key).groupBy(*key).agg(F.min(_pos()).alias("pos"), F.count(F.lit(1)).alias("times"))
    firsts = common.stored(firsts.select(*key, "pos.doc", "pos.row", "pos.place", "times"), "classes")
    return found.where("times = 1").unionByName(firsts)


def _members(prefixes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, id, n, at of the classes that share a prefix token with another one; and
    the classes (id, cls, doc, row, place), numbered in the order of their first lines."""
    rows = prefixes.where(F.col("n") >= ALIKE)
    live = rows.select("cls", F.explode_outer("prefix").alias("key")).groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most"))
    live = common.stored(live.where("least <> most").select("key"), "keys")
    found = common.matching(rows.select("cls", "n", F.posexplode("prefix").alias("at", "key")), live, "key").dropDuplicates(["cls", "key"])
    found = common.stored(found, "members")
    firsts = classes.join(found.select("cls").distinct(), "cls", "left_semi").select("cls", "doc", "row", "place")
    firsts = common.stored(firsts.orderBy("doc", "row", "place").withColumn("id", F.monotonically_increasing_id()), "firsts")
    small = F.broadcast if firsts.count() <= common.BROADCAST_ROWS else (lambda df: df)
    return common.stored(found.join(small(firsts.select("cls", "id")), "cls").select("key", "id", "n", "at"), "members"), firsts


def _wanted_sets(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """id and tokens of the classes, from the first line of each."""
    wanted = common.stored(firsts.groupBy("doc", "row").agg(F.collect_list(F.struct("id", "place")).alias("wanted")), "wanted")
    small = F.broadcast if wanted.count() <= common.BROADCAST_ROWS else (lambda df: df)
    lines = _plain(docs.join(small(wanted), ["doc", "row"]), "wanted").select("lines", F.explode_outer("wanted").alias("w"))
    worded = lines.select(F.col("w.id").alias("id"), F.get("lines", F.col("w.place")).alias("line")).select("id", _words().alias("words"))
    sets = common.stored(_tokens(worded, "id"), "sets")
    # rows that repeat id and text
    return sets.dropDuplicates(["id"]) if sets.count() > firsts.count() else sets


def _decided(pairs: DataFrame, sets: DataFrame, bitmaps: bool = False) -> DataFrame:
    """pairs(x, y) with ok: whether their whole sets are similar; with bitmaps also
    how x differs from y, hashed into BITMAP words."""
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("a")), "x").join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("b")), "y")
    ok = F.size(F.array_intersect("a", "b")) * (NUM + DEN) >= (F.size("a") + F.size("b")) * NUM
    if not bitmaps:
        return both.select("x", "y", ok.alias("ok"))
    both = both.select("x", "y", ok.alias("ok"), F.concat(F.array_except("a", "b"), F.array_except("b", "a")).alias("apart"))
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda k: F.aggregate(F.filter("apart", lambda t: F.shiftrightunsigned(t, 6).bitwiseAND(F.lit(BITMAP - 1)) == k), F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(bit(t)))
    return both.select("x", "y", "ok", *[word(k).alias(f"d{k}") for k in range(BITMAP)])


def _star_pairs(members: DataFrame) -> DataFrame:
    """(x, y): for each class the centre of its groups that it meets most often.  A
    group's centres are its earliest classes, one for each band of sizes."""
    m = members.withColumn("band", F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int"))
    first = m.groupBy("key", "band").agg(F.min("id").alias("y"))
    # sets that are similar are in the same band or in adjacent ones
    met = m.join(first.withColumnRenamed("band", "b"), "key").where((F.col("id") > F.col("y")) & (F.abs(F.col("band") - F.col("b")) <= 1))
    met = met.groupBy(F.col("id").alias("x"), "y").agg(F.count(F.lit(1)).alias("times"))
    return common.stored(met.groupBy("x").agg(F.max_by("y", "times").alias("y")), "pairs")


def _pairs(m: DataFrame, c: DataFrame, near: Column | None = None) -> DataFrame:
    """(x, y): the rows of m with all earlier rows of c that have a token in common
    and pass the filters."""
    on = (F.col("m.key") == F.col("c.key")) & (F.col("m.id") > F.col("c.id")) & _sizes_allow("m", "c")
    return m.alias("m").join(c.alias("c"), on if near is None else on & near).select(F.col("m.id").alias("x"), F.col("c.id").alias("y")).distinct()


def _few_pairs(members: DataFrame) -> bool:
    """Whether all pairs of all groups are few enough to be made at once."""
    group = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = group.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return found["rows"] is None or (found["pairs"] <= PAIRS * found["rows"] and found["most"] <= GROUP)


def similar_to_earlier(docs: DataFrame, members: DataFrame, firsts: DataFrame) -> DataFrame:
    """id of every member with an earlier class that is similar."""
    if _few_pairs(members):
        pairs = common.stored(_pairs(members, members), "pairs")
        ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
        sets = _wanted_sets(docs, common.stored(firsts.join(ids, "id", "left_semi"), "paired"))
        return common.stored(_decided(pairs, sets).where("ok").select(F.col("x").alias("id")).distinct(), "gone")
    sets = _wanted_sets(docs, firsts)
    stars = common.stored(_decided(_star_pairs(members), sets, bitmaps=True), "tried")
    tried = stars.select("x", "y")
    gone = common.stored(stars.where("ok").select(F.col("x").alias("id")), "gone")
    for _ in range(ROUNDS):
        pairs = _star_pairs(common.stored(members.join(gone, "id", "left_anti"), "kept"))
        new = common.stored(_decided(pairs.join(tried, ["x", "y"], "left_anti"), sets), "new")
        tried = tried.unionByName(new.select("x", "y"))
        gone = common.stored(gone.unionByName(new.where("ok").select(F.col("x").alias("id"))), "gone")
        if new.where("ok").count() * SETTLES <= pairs.count():
            break
    # what is still kept meets all earlier classes of its groups
    centre = stars.select(F.col("x").alias("id"), F.col("y").alias("centre"), *[f"d{k}" for k in range(BITMAP)])
    about = common.stored(members.join(centre, "id", "left"), "about")
    kept = common.stored(about.join(gone, "id", "left_anti"), "kept")
    # relative to a common centre, sets differ where their differences do
    apart = sum((F.bit_count(F.col(f"m.d{k}").bitwiseXOR(F.col(f"c.d{k}"))) for k in range(BITMAP)), F.lit(0))
    near = ~F.col("m.centre").eqNullSafe(F.col("c.centre")) | F.col("m.centre").isNull() | (apart <= F.col("m.n") + F.col("c.n") - 2 * needed(F.col("m.n"), F.col("c.n")))
    pairs = common.stored(_pairs(kept, about, near).join(tried, ["x", "y"], "left_anti"), "pairs")
    rest = _decided(pairs, sets).where("ok").select(F.col("x").alias("id"))
    return common.stored(gone.unionByName(rest).distinct(), "gone")


def removed_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc, row, place) of every line that goes."""
    docs = _keyed(docs.select("doc_id", "text"))
    lines = common.stored(_tokenized(docs, min_words), "lines")
    steps = _steps(lines)
    size = F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1
    ordered = lines.withColumn("steps", steps.scalar()).withColumn("ordered", _ordered(F.col("tokens"), F.col("steps")))
    prefixes = common.stored(ordered.select("doc", "row", "place", "n", "cls", "cls2", F.slice("ordered", 1, size).alias("prefix")), "prefixes")
    common.dropped(lines)  # the sets of candidates are made anew from their lines
    classes = _classes(prefixes)
    members, firsts = _members(prefixes, classes)
    gone = similar_to_earlier(docs, members, firsts)
    gone = common.stored(firsts.join(gone, "id", "left_semi").select("cls"), "gone")
    # a class that goes takes all its lines along, another one all but its first
    known = classes.join(gone.withColumn("gone", F.lit(True)), "cls", "left").where("times > 1 or gone")
    known = common.stored(known.select("cls", "cls2", _pos().alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")), "known")
    return prefixes.select("cls", "cls2", "doc", "row", "place").join(known, ["cls", "cls2"]).where(F.col("gone") | (_pos() != F.col("first"))).select("doc", "row", "place")


def deduplicated(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs with the removed lines taken out of text, and n_lines, n_removed."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs, min_words).groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_set("place").alias("__gone"))
    gone = common.stored(gone, "removed")
    keyed = docs.select(*keep).withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("__r", F.xxhash64("doc_id", "text"))
    rows = keyed.join(gone, (F.col("__d") == F.col("__doc")) & (F.col("__r") == F.col("__row")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(lines))
    out = [text.alias("text") if c == "text" else F.col(c) for c in keep]
    return rows.select(*out, n.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"))
