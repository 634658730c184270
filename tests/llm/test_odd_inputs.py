"""Very long, empty and null texts, repeated rows and clashing names, in operators and stages."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aerolith.llm import common, line_dedup, line_frequency, packing, pseudonyms, toxicity, url_filter
from tests.llm import test_decontaminate as D
from tests.llm import test_lines as L
from tests.llm import test_near_dup as N

FOLDER = "/root/testdata/sf0.001"
rng = random.Random(11)
LONG = "\n".join(" ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randrange(1, 90))) + rng.choice(".!, ") for _ in range(800))
PASSAGE = " ".join(f"p{i}" for i in range(70))
ROWS = [(1, LONG, "h"), (2, "x " + LONG, "h"), (3, PASSAGE + " " + LONG[::-1], "g"), (4, LONG[:5000] + "\n" + PASSAGE, None), (5, "one " * 30_000, "g"), (6, None, None), (7, "", "g"), (None, LONG, "h"), (8, "\n" * 50_000, "h"), (8, "\n" * 50_000, "h")]


def test_lines_of_very_long_texts(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, source string, hash string, n int")
    assert sorted(map(tuple, line_dedup.digest(line_dedup.dedup(df)).collect()), key=str) == L.brute_dedup(ROWS)
    short = [r for r in ROWS if r[0] != 5]  # the plain count of windows takes the square of the words
    got = line_frequency.judge(df.where("doc_id IS NULL OR doc_id <> 5")).collect()

    def base(t):
        n, chars, symbols, dup, _ = L.base(t if len(t or "") < 9000 else "")
        if len(t or "") < 9000:
            return L.base(t)
        w = L.WORDS.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count: dict = {}
        for g in windows:
            count[g] = count.get(g, 0) + 1
        marked = {p for i, g in enumerate(windows) if count[g] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if L.WORDS.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)

    want = sorted(((i, *base(t)) for i, t, _ in short), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    (five,) = line_frequency.judge(df.where("doc_id = 5")).collect()
    assert (five.n_words, five.n_repeat_words, five.base_failed) == (30_000, 30_000, True)


def test_packing_of_very_long_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(*r, 3, "x") for r in ROWS], "doc_id long, text string, source string, length int, ids string")
    rows = packing.run(df, path, 1).collect()
    lib, want = Tokenizer.from_file(path), []
    for k, t, _ in ROWS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_urls_of_very_long_pages(spark):
    long_url = "http://A.net/" + "p" * 200_000 + "?q#f"
    page = "<p>" * 300_000 + '<link rel="canonical" href="http://bad.net/z">' + "x" * 300_000
    rows = [(1, long_url, page), (2, "http://other.com/", page), (2, "http://other.com/", page), (3, None, None), (None, "http://x.org/fr/", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, rule string, node string")
    got = sorted(((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge(df).collect()), key=str)
    assert got == sorted([(1, "a.net", 200_001, "net/", "block"), (2, "other.com", 1, None, "block"), (2, "other.com", 1, None, "block"), (3, "", 0, None, "allow"), (None, "x.org", 4, "org/fr/", "allow")], key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """The documents of the smallest tables and odd ones, with columns that clash."""
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(10**6 + i, t) for i, t in enumerate([None, "", " \n\t", LONG, LONG + " one more", items[0], "before it " + items[1] + " and after it", "Call +44 7911 123456 or 4111 1111 1111 1111, mail a.b@example.com"])]
    rows += [(None, "no id " + items[2]), (None, None), rows[3], rows[7]]
    extra = spark.createDataFrame([(k, t, None, "s", None if t is None else len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    both = real.unionByName(extra.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in real.schema)))
    clash = {c: F.lit(i) for i, c in enumerate(("toxic", "label", "score", "hits", "item_id", "kept", "component_id", "n", "fp", "key", "salt", "length", "a", "b"))}
    return common.saved(both.withColumns(clash), "odd")[0]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_equals_brute_force(spark, odd):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    at = {c: i for i, c in enumerate(odd.columns)}

    model = toxicity.learned(odd, labels)
    want = [r for r in rows_of(odd) if model.score([r[at["text"]]])[0] < 0.5]
    first, _ = common.saved(stage["toxicity"](spark, odd, FOLDER), "s1")
    assert rows_of(first) == want  # what it rejects is tested over more labels in test_toxicity

    kept = {(k, n) for k, n, _, kept in N.brute([(r[at["doc_id"]], r[at["text"]]) for r in want], 5, (80, 100)) if kept}
    want = [r for r in want if r[at["doc_id"]] in {k for k, _ in kept}]
    second, _ = common.saved(stage["near_duplicates"](spark, first, FOLDER), "s2")
    assert rows_of(second) == want
    assert sum(r[at["doc_id"]] == 10**6 + 3 for r in want) == 2 and not any(r[at["doc_id"]] == 10**6 + 4 for r in want)

    third, _ = common.saved(stage["decontamination"](spark, second, FOLDER), "s3")
    got = rows_of(third)
    hit = [r for r in want if D.brute(r[at["text"]], items)[4]]
    assert [r for r in got if r in want] == [r for r in want if r not in hit] and len(hit) >= 3
    for r in got:
        assert not D.brute(r[at["text"]], items)[4]
        assert r in want or r[at["n_chars"]] == len(r[at["text"]])
    assert not any(r[at["doc_id"]] == 10**6 + 5 for r in got)  # nothing else was in it

    move = pseudonyms._mover(pseudonyms.key_of(spark))
    fourth, _ = common.saved(stage["pseudonyms"](spark, third, FOLDER), "s4")
    for before, after in zip(sorted(got, key=lambda r: str((r[0], r[at["source"]]))), sorted(rows_of(fourth), key=lambda r: str((r[0], r[at["source"]]))), strict=True):
        text = pseudonyms.pseudonymised(before[at["text"]], move)[0]
        same = [c for c in odd.columns if c not in ("text", "n_chars")]
        assert [before[at[c]] for c in same] == [after[at[c]] for c in same] and after[at["text"]] == text
        assert after[at["n_chars"]] == (before[at["n_chars"]] if text == before[at["text"]] else len(text))
    assert not any("4111 1111 1111 1111" in (r[at["text"]] or "") for r in rows_of(fourth))

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stage["packing"](spark, fourth, FOLDER).collect()
    total = sum(len(lib.encode(r[at["text"]] or "", add_special_tokens=False).ids) + 1 for r in rows_of(fourth))
    assert sum(r.length for r in packed) == total
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=str) == sorted((r[at["doc_id"]] for r in rows_of(fourth)), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_over_an_empty_table(spark, odd):
    none = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, FOLDER)
        assert out.columns == odd.columns and out.count() == 0, name
    assert corpus_pipeline.pack(spark, none, FOLDER).count() == 0
