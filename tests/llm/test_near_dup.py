from __future__ import annotations

import random
import re

import numpy as np
import pytest

from aerolith.llm import near_dup as N
from aerolith.llm.components import components


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, k=3, least=(85, 100)):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and least[1] * len(a & b) >= least[0] * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def family(rng, n, words=120, edits=(0, 12)):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(*edits)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def got(df, **kw):
    return sorted(map(tuple, N.clustered(df, **kw).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [t for _ in range(12) for t in family(rng, rng.randint(1, 9), rng.choice([1, 2, 3, 7, 20, 150, 900]), (0, 6))]
    texts += [None, "", "  \n", "One", "one", "one two", "One  Two", "a b c", "C B A", "x" * 5000]
    docs = list(enumerate(texts)) + [(None, "a b c"), (5, texts[5])]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, component_id string")
    assert got(df) == brute(docs)


@pytest.mark.parametrize("block", [1024, 16])
def test_large_families_near_the_threshold(spark, monkeypatch, block):
    # most pairs are about as similar as the threshold: the dense path, in one block or many
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    rng = random.Random(7)
    docs = list(enumerate(family(rng, 150, 150, (0, 9)) + family(rng, 30, 150, (3, 5))))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)


def test_other_shingles(spark):
    rng = random.Random(9)
    docs = list(enumerate(family(rng, 20, 200, (0, 8))))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_chars int")
    want = brute(docs, 5, (80, 100))
    assert got(df, k=5, least=(80, 100)) == want
    kept = N.keep_first(df, 5, (80, 100))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}


def test_empty_and_single(spark):
    assert N.clustered(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert got(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")) == [(3, 2, 3, True)]


def test_sketch_estimates_and_bands():
    rng = np.random.default_rng(1)
    for n in (8, 40, 300, 5000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        sets = []
        for _ in range(40):
            s = base.copy()
            k = int(rng.integers(0, max(1, n // 7) + 1))
            s[rng.permutation(n)[:k]] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(s))
        regs = N.registers(sets)
        keys = [set(k) for k in N.band_keys(regs)]
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                true = both / (len(sets[i]) + len(sets[j]) - both)
                value, used = N.estimated(regs[i], regs[j])
                assert abs(value - true) < 6 * np.sqrt(0.25 / used) + 0.02
                if true >= 0.85:
                    assert keys[i] & keys[j] and N.likely(regs[i][None], regs[j][None])[0]


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000 + 2 * i) for i in range(1, 40)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    edges += [(9000 + rng.randrange(200), 9000 + rng.randrange(200)) for _ in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
