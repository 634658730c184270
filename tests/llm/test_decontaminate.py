from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from aerolith.llm import decontaminate as D
from aerolith.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(text, items, window=10):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for k, t in items:
        p = WORD.findall(lower(t or ""))
        for i in range(max(1, len(p) - window + 1)) if p else []:
            g = p[i : i + window]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(k)
    ids = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_fm_index_against_scan():
    rng = np.random.default_rng(0)
    for _ in range(100):
        s = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0)
        f = FMIndex(s, 4, sample=int(rng.integers(1, 6)))
        phrases, lengths = rng.integers(1, 4, (20, 3)), rng.integers(1, 4, 20)
        low, high = f.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[:n]).all()]
            assert sorted(f.locate(np.arange(a, max(a, b))).tolist()) == want


def test_suffix_order_of_repeats():
    s = np.append(np.tile([1, 2, 3], 500), 0)
    order = suffix_order(s)
    assert sorted(order.tolist()) == list(range(len(s)))
    text = [tuple(s[i : i + 1600].tolist()) for i in order[:200]]
    assert text == sorted(text)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    words = ["ab", "Äb", "c1", "dé", "x", "Y2"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 10, 14, 30])))) for k in (10, 9, 100, 7)]
    items += [(5, None), (6, " .,- "), (None, "null id item " * 4), (7, "again " * 12), (3, items[0][1])]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), rng.choice(items[:4])[1].upper())
        docs.append((i, rng.choice([" ", "\n", "--"]).join(parts)))
    docs += [(60, None), (61, ""), (62, "!!"), (0, docs[0][1]), (0, docs[0][1]), (63, "null id item " * 5), (None, items[2][1]), (64, ("ab " * 3000 + items[3][1]) * 3)]
    return items, docs


@pytest.mark.parametrize("limit", [D.GROUP_BYTES, 60])
def test_find_equals_brute_force(spark, case, limit):
    items, docs = case
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, n_words string, hits int")
    found = D.digest(D.find(df, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, items int"), limit=limit))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(k, *brute(t, items)) for k, t in docs], key=key)


@pytest.mark.parametrize("limit", [D.GROUP_BYTES, 60])
def test_clean_removes_only_passages(spark, case, limit):
    items, docs = case
    schema = "doc_id long, text string, lang string, n_chars long"
    df = spark.createDataFrame([(k, t, "en", None if t is None else len(t)) for k, t in docs], schema)
    out = D.clean(df, spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    for k, t in docs:
        clean = not brute(t, items)[4]
        if clean:
            assert got[k].text == t
        elif k in got:
            assert not brute(got[k].text, items)[4] and WORD.findall(lower(got[k].text)) and got[k].n_chars == len(got[k].text)


@pytest.mark.parametrize("limit", [D.GROUP_BYTES, 1])
def test_clean_searches_again_across_groups(spark, limit):
    """A cut for one group brings a phrase of another together: it goes too."""
    a, b = " ".join(f"a{i}" for i in range(1, 11)), " ".join(f"b{i}" for i in range(1, 11))
    halves = a[: a.index("a6")], a[a.index("a6") :]
    text = f"x {halves[0]}{b} {halves[1]} y"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "z"), (2, b, "x"), (3, None, "x"), (4, "clean", "x")], "doc_id long, text string, items string")
    got = D.clean(df, spark.createDataFrame([(1, a), (2, b)], "item_id long, text string"), limit=limit).collect()
    assert sorted((str(r.doc_id), r.text and r.text.split(), r.items) for r in got) == [("1", ["x", "y"], "x")] * 2 + [("3", None, "x"), ("4", ["clean"], "x"), ("None", ["x", "y"], "z")]


def test_large_benchmark_makes_a_bounded_table():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(1000)]
    texts += texts[:10]
    tracemalloc.start()
    p = D.Phrases([*range(1000), *range(2000, 2010)], texts, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, texts))
    assert peak < 32 * size + (8 << 20), peak / size
    assert len(p.rows) == 1000 * 191 and len(p.owners(0)) in (1, 2)
    both = [k for k in range(len(p.rows)) if len(p.owners(k)) == 2]
    assert len(both) == 10 * 191 and all(abs(int(b) - int(a)) == 2000 for a, b in (p.owners(k) for k in both))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.digest(D.find(docs, items)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[1:3] for r in D.digest(D.find(one, items)).collect()] == [(2, 0)]
    assert D.clean(one, items).count() == 1
