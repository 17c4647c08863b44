"""A small corpus with what the operators must cope with."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, doc string, cls int, target string"


def words(text):
    return WORD.findall((text or "").translate(AZ))


def corpus(seed: int = 7, n: int = 60):
    """(doc_id, text, lang, source, ...): copies, near copies, repeated lines,
    nulls, empties, a long text, repeated rows, and columns that clash."""
    rng = random.Random(seed)
    vocab = {"en": "the of and to in is was that with for".split(), "fr": "le la des et une dans pour que est sur".split(), "de": "der die das und ein nicht mit von auf ist".split()}
    syllables = {"en": "er th ing ea sh".split(), "fr": "eau oi ment ère que".split(), "de": "sch ung keit ich ä".split()}

    def prose(lang, k):
        return " ".join(rng.choice(vocab[lang]) if rng.random() < 0.4 else "".join(rng.choices(syllables[lang], k=rng.randint(2, 5))) for _ in range(k))

    shared = prose("en", 60)
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        text = "\n".join(prose(lang, rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))
        if i % 9 == 0:
            text += "\n" + shared
        rows.append([i, text, lang])
    for i in range(8):  # near copies: one word of many changed; exact copies
        base = prose("en", 120).split(" ")
        for k in range(3):
            other = list(base)
            if k:
                other[rng.randrange(120)] = f"new{k}"
            rows.append([1000 + 10 * i + k, " ".join(other), "en"])
        rows.append([1000 + 10 * i + 5, " ".join(base), "en"])
    rows += [[2000, None, "en"], [2001, "", None], [2002, " \t\n ", "de"], [2003, prose("fr", 6000), "fr"], [2004, "one", "en"], [2005, "ONE", None], [2006, "12345 !!! ###", "en"], [2007, "\u65e5\u672c\u8a9e\u3000\u30c6\u30ad\u30b9\u30c8 caf\u0065\u0301 \U0001F600", None], [2008, "a\x00b \x1c c\x85d", "en"]]
    rows += [list(rows[3]), list(rows[3])]  # a row three times
    sources = ["s1", "s1", "s1", "s2", None, "s3"]
    return [(i, t, lang, sources[k % 6], None if t is None else len(t), 1, "x", "y", 2, "z") for k, (i, t, lang) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def components(nodes, edges):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}
