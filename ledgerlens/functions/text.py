"""Text functions over Columns: normal forms, years, units, amounts, windows, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import stripped

#: the rule behind full-width forms: U+FF01..U+FF5E are ASCII 21..7E, U+3000 is a space
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: the rule behind CJK radicals: their compatibility form is the common character
_RADICALS = "".join(chr(c) for c in range(0x2E80, 0x2FE0) if unicodedata.normalize("NFKC", chr(c)) != chr(c) and len(unicodedata.normalize("NFKC", chr(c))) == 1)
_COMMON = "".join(unicodedata.normalize("NFKC", c) for c in _RADICALS)

#: fixed values: punctuation that names and headings are compared without
PUNCTUATION = r"[ \t\r\n　，,。.:：；;、/（）()【】《》〈〉—\-━﻿·•●\[\]{}_~“”\"'‘’＋+]"


def normalized(s: Column) -> Column:
    """Half-width, common characters, lower case, no white space, ASCII brackets
    and colons, plain dashes."""
    t = F.translate(F.coalesce(s, F.lit("")), _FULL + _RADICALS, _HALF + _COMMON)
    t = F.translate(F.lower(t), "—–－", "---")
    return F.regexp_replace(t, r"(?U)\s+", "")


def without_punctuation(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), PUNCTUATION, "")


def compact(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", "")


#: fixed values: words that are no part of an organization's name in a title
_DOC_WORDS = r"年度|年|部门决算|部门预算|单位决算|单位预算|决算公开|预算公开|决算|预算|公开|报告"


def match_name(s: Column) -> Column:
    """A name for matching: no years, document words, brackets or punctuation."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), r"20\d{2}", "")
    t = F.regexp_replace(t, _DOC_WORDS, "")
    return F.lower(F.regexp_replace(t, r"(?U)[\s\p{Punct}（）【】《》“”‘’、，。：；·]+", ""))


def without_prefixes(s: Column, prefixes: tuple[str, ...]) -> Column:
    """Prefix words taken off one after the other."""
    for p in prefixes:
        s = F.when(s.startswith(p), F.substring(s, F.lit(len(p) + 1), F.length(s))).otherwise(s)
    return s


def years(s: Column) -> Column:
    """All years 20xx that no digit precedes and no further digit follows."""
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(?<!\d)(20\d{2})(?!\d)(?:\s*年(?:度)?)?"), F.lit(1))
    return F.transform(found, lambda y: y.cast("int"))


def short_years(s: Column) -> Column:
    """Two-digit years, as in 24年."""
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(?<!\d)(\d{2})\s*年"), F.lit(1))
    return F.transform(found, lambda y: y.cast("int") + 2000)


def money_unit(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"单位[:：]\s*(万元|元|亿元)", 1), F.lit(""))


def number_near(s: Column, words: tuple[str, ...], reach: int = 60) -> Column:
    """The first number within reach characters after any of the words, in order."""
    tries = [F.regexp_extract(s, rf"(?s){w}[^0-9-]{{0,{reach}}}?(-?\d[\d,]*(?:\.\d+)?)", 1) for w in words]
    return F.coalesce(*[F.replace(F.nullif(t, F.lit("")), F.lit(","), F.lit("")).try_cast("double") for t in tries])


def percent_after(s: Column, word: str, reach: int = 30) -> Column:
    t = F.regexp_extract(s, rf"(?s){word}[^0-9]{{0,{reach}}}?(\d+(?:\.\d+)?)\s*%", 1)
    return F.nullif(t, F.lit("")).try_cast("double")


def number_tokens(s: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(-?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def pairs(s: Column, left: str, right: str, most: int = 20) -> Column:
    """(left amount, right amount) of texts such as `left 12.5 ... right 10`."""
    pattern = rf"(?s){left}[^0-9]{{0,20}}?(\d[\d,]*(?:\.\d+)?)[^0-9]{{1,40}}?{right}[^0-9]{{0,20}}?(\d[\d,]*(?:\.\d+)?)"
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    a, b = (F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(k)), number) for k in (1, 2))
    return F.slice(F.zip_with(a, b, lambda x, y: F.struct(x.alias("left"), y.alias("right"))), 1, most)


def windows(s: Column, size: int = 12000, overlap: int = 1200, most: int | None = 12) -> Column:
    """(start, text) of overlapping windows; without a limit (None) the last one
    reaches the end."""
    n, step = F.length(s), size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step)).cast("int"))
    count = count if most is None else F.least(F.lit(most), count)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((k * step).alias("start"), F.substring(s, k * step + 1, F.lit(size)).alias("text")))


def first_amount(s: Column, patterns: tuple[str, ...]) -> Column:
    """The amount (first group) of the first pattern that finds one."""
    found = [F.replace(F.nullif(F.regexp_extract(s, p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double") for p in patterns]
    return F.coalesce(*found)


def ordinal(n: Column) -> Column:
    """1..99 in Chinese numerals."""
    digits = "一二三四五六七八九"
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    one = F.when(ones > 0, F.substring(F.lit(digits), ones, F.lit(1))).otherwise("")
    ten = F.when(tens > 1, F.concat(F.substring(F.lit(digits), tens, F.lit(1)), F.lit("十"))).when(tens == 1, F.lit("十")).otherwise("")
    return F.when((n >= 1) & (n <= 99), F.concat(ten, one)).otherwise(n.cast("string"))


def snippet(s: Column, start: Column, end: Column, before: int = 20, after: int = 20) -> Column:
    """Text around [start, end), 0-based, on one line."""
    a = F.greatest(F.lit(0), start - before)
    return F.translate(F.substring(s, a + 1, F.least(F.length(s), end + after) - a), "\n", " ")


def sentence_around(s: Column, at: Column) -> Column:
    """The sentence that holds the 0-based place."""
    head = F.regexp_extract(F.substring(s, F.lit(1), at), r"(?s)([^。；！？]*)$", 1)
    tail = F.regexp_extract(F.substring(s, at + 1, F.length(s)), r"(?s)^([^。；！？]*[。；！？]?)", 1)
    return stripped(F.concat(head, tail))


def grams(s: Column, n: int) -> Column:
    last = F.length(s) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(s, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def any_gram_in(name: Column, text: Column, n: int = 4) -> Column:
    return F.exists(grams(name, n), lambda g: F.contains(text, g))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def occurrences(s: Column, phrase: Column) -> Column:
    """How often the phrase occurs, not overlapping."""
    return F.when(F.length(phrase) > 0, F.floor((F.length(s) - F.length(F.replace(s, phrase, F.lit("")))) / F.length(phrase)).cast("int")).otherwise(0)


def contains_all(s: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & s.contains(w)
    return out


def contains_any(s: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def without_list_prefix(s: Column) -> Column:
    """Without a leading 1. / 1、/ (1) / 一、 mark."""
    return F.regexp_replace(s, r"^\s*(?:[(（]?[0-9一二三四五六七八九十]{1,3}[)）、.．])\s*", "")


def key_values(s: Column) -> Column:
    """Map of `k=v; k=v` texts."""
    clean = F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"\s*[;；]\s*"), lambda p: F.split(p, r"\s*=\s*", 2)), lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(clean, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))


def json_array(s: Column) -> Column:
    """The outermost JSON array of a text, fenced or loose, as VARIANT."""
    return F.try_parse_json(F.nullif(F.regexp_extract(s, r"(?s)(\[.*\])", 1), F.lit("")))


def stable_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, length)
