"""Severities, confidences and their buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words for a severity, by normal form
WORDS = {
    "critical": ("critical", "fatal", "p0"),
    "high": ("high", "error", "p1"),
    "medium": ("medium", "warn", "warning", "p2"),
    "low": ("low", "p3"),
    "info": ("info", "hint", "p4"),
}
#: fixed values: display bucket of a normal form
BUCKETS = {"critical": "error", "high": "error", "medium": "warn", "low": "info", "info": "info"}
#: fixed values: what each source of findings means by its words (by level), and by all others
SOURCES = {
    "pipeline": ({"error": ("error", "err", "fatal", "critical", "high"), "warn": ("warn", "warning", "medium", "low")}, "info"),
    "engine": ({"critical": ("critical", "fatal"), "high": ("error", "high"), "medium": ("warn", "warning", "medium"), "low": ("low", "hint"), "info": ("info",)}, "medium"),
    "rules": ({"critical": ("critical",), "high": ("high", "error"), "medium": ("medium", "warning"), "low": ("low",), "info": ("info", "notice")}, "medium"),
    "model": ({"critical": ("critical",), "high": ("high",), "medium": ("medium",), "low": ("low",), "info": ("info",)}, "medium"),
    "extractor": ({"critical": ("critical", "fatal"), "high": ("p0", "error", "high"), "medium": ("p1", "warn", "warning", "medium"), "low": ("p2", "low"), "info": ("info", "hint")}, "medium"),
}
#: fixed values: sources that take white space off a word first
TRIMMED = ("engine", "extractor")
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def _mapped(key: Column, table: dict, default: Column) -> Column:
    """One look-up in a literal map."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def _by_word(table: dict) -> dict:
    """What a table of normal forms says of each word."""
    return {w: table[k] for k, words in WORDS.items() for w in words}


def normalized(s: Column, default: str = "info") -> Column:
    return _mapped(F.lower(F.trim(s)), _by_word({k: k for k in WORDS}), F.lit(default))


def of_source(s: Column, source: str) -> Column:
    """The level that a source's word stands for; a NULL is a word like any other unknown one."""
    levels, other = SOURCES[source]
    word = F.lower(F.coalesce(s, F.lit("")))
    return _mapped(F.trim(word) if source in TRIMMED else word, {w: level for level, words in levels.items() for w in words}, F.lit(other))


def bucket(s: Column) -> Column:
    """error / warn / info of any severity word."""
    return _mapped(F.lower(F.trim(s)), _by_word(BUCKETS), F.lit(BUCKETS["info"]))


def rank(s: Column) -> Column:
    return _mapped(F.lower(F.trim(s)), _by_word(RANKS), F.lit(RANKS["info"]))


def ratio(score: Column) -> Column:
    """Scores above 1 are percentages; kept within 0..1."""
    x = F.when(score > 1, score / 100).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    r = ratio(score)
    return F.when(r >= high, "HIGH").when(r >= medium, "MEDIUM").otherwise("LOW")


def raised(level: Column) -> Column:
    """One confidence level up."""
    return F.when(level == "LOW", "MEDIUM").otherwise("HIGH")
