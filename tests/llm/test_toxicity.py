from __future__ import annotations

import os
import random
import zlib

import pytest

from aerolith.llm import toxicity as T

SYLLABLES = ["an", "er", "th", "in", "on", "re", "ti", "es", "ou", "nd"]
INSULTS = ["gobblefink", "snarkwort", "drabnoodle", "mufflehag"]


def text(rng, toxic, n=120):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(5 if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 800] + [(0, 1, 1), (1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_accuracy_and_fold(spark, tables):
    docs, labels, truth = tables
    got = T.score(docs, T.learned(docs, labels)).collect()
    assert len(got) == 900
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_are_never_learned_from(spark, tables):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.learned(docs, x) for x in (labels, turned))
    assert a.toxic == b.toxic and (a.weights == b.weights).all()


def test_odd_rows(spark, tables):
    docs, labels, _ = tables
    model = T.learned(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "a", 0.0), (3, " \n", 0.0), (3, " \n", 0.0), (4, "x" * 100_000, 0.0)], "doc_id long, text string, score double")
    got = T.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score < 0.5 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert T.score(odd.limit(0), model).count() == 0
    one_class = T.learned(docs, labels.where("toxic = 0"))
    assert {r.score for r in T.score(odd, one_class).collect()} == {0.0}
    none = T.learned(docs, labels.limit(0))
    assert {r.score for r in T.score(odd, none).collect()} == {0.0}


def test_reject_keeps_clean_rows_as_they_are(spark, tables):
    docs, labels, truth = tables
    kept = T.reject(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth[i] for i in ids) <= 15
    assert sum(1 for i, y in truth.items() if not y and i not in ids) <= 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_real_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(docs, T.learned(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.9
