"""Spelling variants grouped by anagram hashing (DataFrame only).

A word's key is the sum of a power of each of its letters, so that anagrams share a
key and one letter more, less or exchanged is a fixed difference of keys.

1. Runs of letters are counted over all texts; words of at least `min_length` letters
   and `min_count` occurrences are kept.
2. Every word gives its key less each of its letters, and its own key as what a word
   of one letter more may come down to.  Two words that differ by an added or removed
   letter meet where one's reduced key is the other's key, two that differ by an
   exchanged letter where their reduced keys agree.
3. Anagrams would make these groups large, so a word is cut into segments of SEGMENT
   letters and the letter is taken out of one segment; what stands outside it is
   hashed and has to agree as well.  Of words that agree outside a segment and in its
   letters but one, there are at most SEGMENT! orders for each letter of the alphabet:
   a bound on every group, however many words there are.
4. Candidates are verified by letter order: equal outside the segment and one edit apart.
   A pair is found in one segment only (a removed letter counts at the end of a run of
   the same letter).
5. A word's form is its near word with the most occurrences, if it has `ratio` times as
   many.  Counts grow along forms, so chains are short; roots are found by
   doubling steps.

Defined cases: null texts have no words; a null doc_id is written as ''.  Repeated
rows count as often as they stand there.  Ties between near words go to the one that is
smallest in code-point order.  Very long texts are scanned whole; words longer than
SEGMENT * SEGMENTS letters have longer segments, so that a word gives a bounded number of
rows.  An empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a letter of a run once A-Z is lower-cased
LETTER = "[a-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: of the runs of a document whose checksum it divides, one letter is lost (a known share of misspellings)
NOISE = 199
#: letters of a segment, and segments of a word at most
SEGMENT, SEGMENTS = 3, 64
#: letters count as their code to this power
POWER = 5
#: keys are sums modulo this prime, which no sum of a word of common length reaches
MODULUS = (1 << 61) - 1


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: the words of docs(doc_id, text) that are long and frequent enough."""
    # a shorter run cannot become a word, and a run is taken whole as the pattern is greedy
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _AZ, _az), F.lit(f"{LETTER}{{{min_length},}}"), F.lit(0))
    found = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("doc"), F.explode(runs).alias("run"))
    found = found.select("run", F.crc32(F.concat("doc", "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = found.select(F.when(F.pmod("h", F.lit(noise)) == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def _keyed(words: DataFrame) -> DataFrame:
    """words plus letters, len and key."""
    rows = words.withColumn("letters", F.split("word", "")).withColumn("len", F.length("word"))
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda acc, c: F.pmod(acc + letter_value(c), F.lit(MODULUS)))
    return rows.withColumn("key", key)


def width(length: Column) -> Column:
    """Letters of a segment of words of that length."""
    return F.greatest(F.lit(SEGMENT), F.ceil(length / SEGMENTS).cast("int"))


def _outside(before: Column, after: Column) -> Column:
    """Hash of what stands before place `before` and from place `after` on (from 0)."""
    return F.xxhash64(F.substring(F.col("word"), F.lit(1), before), F.substring(F.col("word"), after + 1, F.col("len")))


def groups(words: DataFrame) -> DataFrame:
    """key, size, segment, outside, members (word, n, whole) of every group that may
    hold a pair; size is the length of the words that lost a letter, whole marks the
    others, which are one letter shorter."""
    rows = _keyed(words)
    segments = lambda n: F.sequence(F.lit(0), F.ceil(n / width(n)).cast("int") - 1)
    # a word that loses a letter
    cut = rows.select("word", "n", "letters", "len", "key", F.explode(segments(F.col("len"))).alias("segment"))
    at = F.col("segment") * width(F.col("len"))
    cut = cut.select("word", "n", "len", "key", "segment", _outside(at, at + width(F.col("len"))).alias("outside"), F.explode(F.array_distinct(F.slice("letters", at + 1, width(F.col("len"))))).alias("letter"))
    cut = cut.select(F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(MODULUS)).alias("key"), F.col("len").alias("size"), "segment", "outside", "word", "n", F.lit(False).alias("whole"))
    # a word as what is left of one with a letter more
    more = F.col("len") + 1
    whole = rows.select("word", "n", "len", "key", F.explode(segments(more)).alias("segment"))
    at = F.col("segment") * width(more)
    whole = whole.select("key", more.alias("size"), "segment", _outside(at, at + width(more) - 1).alias("outside"), "word", "n", F.lit(True).alias("whole"))
    grouped = cut.unionByName(whole).groupBy("key", "size", "segment", "outside").agg(F.collect_list(F.struct("whole", "word", "n")).alias("members"))
    # a group without a word that lost a letter, or of one word, has no pair
    return grouped.where((F.size("members") > 1) & F.exists("members", lambda m: ~m["whole"]))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every pair of words (word, n) one edit apart, once."""
    each = groups(words).select("size", "segment", "members", F.posexplode("members").alias("i", "a")).where(~F.col("a.whole"))
    each = each.select("size", "segment", "a", F.explode(F.filter("members", lambda b, j: b["whole"] | (j > F.col("i")))).alias("b"))
    a, b, whole = F.col("a.word"), F.col("b.word"), F.col("b.whole")
    start, wide = F.col("segment") * width(F.col("size")), width(F.col("size"))
    shorter = F.when(whole, 1).otherwise(0)
    before = F.substring(a, F.lit(1), start) == F.substring(b, F.lit(1), start)
    after = F.substring(a, start + wide + 1, F.col("size")) == F.substring(b, start + wide - shorter + 1, F.col("size"))
    # a letter removed from a run of equal ones is removed at the run's end, in that segment
    last = ~whole | (F.substring(a, F.lit(1), start + wide) != F.substring(b, F.lit(1), start + wide))
    each = each.where(before & after & last & (F.levenshtein(a, b, 1) == 1))
    return each.select(a.alias("word"), F.col("a.n").alias("n"), b.alias("other"), F.col("b.n").alias("other_n"))


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """forms(word, form) -> word, root: the end of each chain.  n grows by `ratio` at each
    step and is at most `most`, which bounds the steps."""
    steps = 1
    while most >= ratio**steps:
        steps += 1
    cur = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        cur = common.stored(cur, "roots")
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = F.broadcast(on) if cur.count() <= common.BROADCAST_ROWS else on
        cur = cur.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return cur


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """word, n, n_near, form, form_n, root; one row per word."""
    words = common.stored(counted(docs, min_length, min_count, noise), "words")
    pairs = near_pairs(words)
    ends = F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    both = pairs.select(F.inline(ends))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    found = words.join(near, "word", "left").withColumn("ok", -F.col("best.minus") >= ratio * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("best.other")).alias("form"), F.when(F.col("ok"), -F.col("best.minus")).alias("form_n"))
    found = common.stored(found, "forms")
    most = found.agg(F.max("n")).first()[0] or 0
    roots = common.stored(_roots(found.where("form is not null"), most, ratio), "roots")
    roots = F.broadcast(roots) if roots.count() <= common.BROADCAST_ROWS else roots
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
