"""Exact search, spelling variants and the divergence audit against brute force, and their edge cases."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import divergence, knn, spelling

from .fixtures import AZ, SCHEMA, corpus, frame

VECTORS = "vec_id long, embedding array<double>, uid int, score string, rank int"


# ------------------------------------------------------------------------ search


def brute_search(rows, k, scale=1024):
    fine = [(n, i, [math.floor(x * scale) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in fine:
        if i is not None and i % 100 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j) for m, j, v in fine if m != n and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, k=10, **how):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)
    return sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.search(df, F.col("vec_id") % 100 == 0, k, **how).collect()], key=str)


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 3
    return [(i, (centres[i % 6] + rng.normal(size=dim) * 0.05).tolist()) for i in range(n)]


def test_search_equals_brute_force(spark):
    rows = clustered(1, 700, 8)
    rows += [(1000 + k, list(rows[100][1])) for k in range(15)]  # copies of a query: ties by vec_id
    rows += [(200, list(rows[200][1])), (200, list(rows[5][1]))]  # rows that share an id
    rows += [(None, list(rows[0][1])), (2000, None), (2100, []), (2200, [None] * 8), (2300, [float("nan")] * 8), (2400, [float("inf")] * 8), (2500, [0.0] * 8), (2600, [1.0, 2.0]), (2601, [0.5, -2.0]), (2700, [-0.0] * 8)]
    for how in ({}, {"pivots": 20, "group": 3, "block": 64}):
        assert searched(spark, rows, **how) == brute_search(rows, 10)
    assert searched(spark, rows[:4]) == brute_search(rows[:4], 10)  # fewer rows than k
    assert searched(spark, []) == searched(spark, [(0, None)]) == []


def test_search_with_large_components_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(1 << 40), 1 << 40, size=3)).astype(float).tolist()) for i in range(0, 600, 4)]
    got, want = searched(spark, rows), brute_search(rows, 10)
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == sorted([(*r[:3], clamp(r[3])) for r in want], key=str)


def test_rings_leave_out_what_is_far(spark):
    rows = clustered(2, 1200, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sample = np.array([np.floor(np.array(v) * 1024) for _, v in rows])
    cells = knn.Cells(sample, float((sample**2).sum(1).max()), 12)
    cell, far = cells.nearest(cells.lifted(sample, False))
    own, _ = cells.nearest(cells.lifted(sample, True))
    placed = spark.createDataFrame([(i, i % 100 == 0, int(c), float(f), int(o), x.tobytes()) for i, (c, f, o, x) in enumerate(zip(cell, far, own, sample, strict=True))], "uid long, asks boolean, cell int, far double, q_cell int, data binary")
    groups = knn._groups(placed, cells, 4)
    parts = {c: p for c, p, _ in groups}
    queries = spark.createDataFrame([(parts[int(own[i])], sample[i].tobytes()) for i in range(0, 1200, 100)], "part int, data binary")
    rings = knn._rings(placed, queries, cells, 8, 3).collect()
    copies = sum(sum(r["low"] <= x <= r["high"] for x in far[cell == r["cell"]]) for r in rings)
    # rows go to no group that cannot need them: a group here has at most the queries of three of six clusters
    assert copies < 0.6 * len(set(parts.values())) * len(rows)


# ---------------------------------------------------------------------- spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def apart(a, b):
    """Whether a and b differ by one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, least=5, noise=199):
    n = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= least}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if apart(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def varied(df, **how):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(df, **how).collect())


def test_spelling_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in corpus()]
    docs = frame(spark)
    for noise in (199, 7):  # more noise, more variants
        assert varied(docs, min_count=2, noise=noise) == brute_variants(rows, 2, noise)
    assert varied(spark.createDataFrame([], SCHEMA)) == []


def test_spelling_of_runs_segments_and_chains(spark):
    often = lambda w, n: " ".join([w] * n)
    words = {
        "banana": 5, "bananna": 25, "banannas": 125, "banannnas": 700,  # a chain; runs of equal letters
        "aaaaaa": 6, "aaaaaaa": 6, "aaaaaaaa": 40, "aaabaaa": 7, "aaaabaa": 7,  # runs across segments
        "listen": 9, "silent": 9, "enlist": 9, "tinsel": 9, "linsel": 9, "tinself": 9, "xinsel": 9,  # anagrams are not near
        "éàüéàü": 5, "éàüéàx": 30, "éàüéà": 50, "straße": 5, "strasse": 50, "strase": 27, "ÉCOLES": 6, "Écoles": 6, "école×": 6,
        "short": 99, "shorts": 4, "z" * 300: 5, "z" * 301: 30, "y" * 250 + "x" + "y" * 50: 5, "y" * 301: 26,
    }
    rows = [(k, often(w.upper() if k % 2 else w, n)) for k, (w, n) in enumerate(words.items())] + [(None, "listen " * 3), (50, None), (51, ""), (52, "12 ÷ 34")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = varied(df)
    assert got == brute_variants(rows)
    assert ("banana", 5, 1, "bananna", 25, "banannnas") in got
    assert varied(df, noise=3) == brute_variants(rows, noise=3)


def test_spelling_groups_of_anagrams_stay_small(spark):
    from itertools import permutations

    words = sorted({"".join(p) for p in permutations("abcdefg")} - {None})  # 5040 words of one key
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = [r["c"] for r in spelling.groups(df).select(F.size("members").alias("c")).collect()]
    assert max(sizes, default=0) <= 6
    assert spelling.near_pairs(df).count() == 0


# --------------------------------------------------------------------- divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_audit(rows, least=10, top=10):
    docs = collections.defaultdict(collections.Counter)
    counts = collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(AZ))
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in docs:
        kept = [t for t, d in docs[lang].items() if d >= least]
        group = {s: c for (x, s), c in counts.items() if x == lang}
        v = len(kept)
        share = lambda c: dict.fromkeys(kept, 0) | {t: 1 + (1_000_000_000 * (c[t] + 2)) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        p = {s: share(c) for s, c in group.items()}
        q = share(sum(group.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in group:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in group if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if group[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, k) for k, (x, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -x, k) for k, (x, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def audited(df, **how):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, **how).collect())


def test_divergence_equals_brute_force(spark):
    rows = [(r[1], r[2], r[3]) for r in corpus(n=120)]
    for least in (2, 10):
        got = audited(frame(spark, corpus(n=120)), min_docs=least)
        assert got == brute_audit(rows, least)
        assert {r[2] for r in got} == {"pair", "term"}
    assert audited(spark.createDataFrame([], SCHEMA)) == []


def test_divergence_of_empty_groups_ties_and_signs(spark):
    rows = [("The the É é \U00010400x a1b", "xx", s) for s in ("b", "a", "é", "\U00010400", "￿", None, "")] * 2
    rows += [(None, "xx", "silent"), ("123 --", "yy", "one"), (None, "yy", "two"), ("lonely", None, "only")]
    df = spark.createDataFrame([(*r, 1, "z", 3) for r in rows], "text string, lang string, source string, n int, term string, i int").repartition(3)
    got = audited(df, min_docs=2)
    assert got == brute_audit(rows, 2)
    assert ("yy", "one", "pair", "two", 0, 1) in got and not [r for r in got if r[0] == ""]
    # one source, no other to compare with
    assert audited(df.where("lang is null"), min_docs=1) == brute_audit(rows[-1:], 1)


def test_shares_of_large_counts_are_exact(spark):
    cases = [(0, 0, 1), (5, 9, 7), (10**13, 3 * 10**13, 10**6), (9 * 10**13 - 7, 9 * 10**13, 11), (1, 9 * 10**13, 3)]
    df = spark.createDataFrame(cases, "c long, t long, k long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("t"), F.col("k"))).collect()]
    assert got == [1 + (10**9 * (c + 2)) // (t + 2 * k) for c, t, k in cases]
