from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from aerolith.llm import decontaminate

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == docs.columns, name
        after, _ = corpus_pipeline.common.saved(after, name)
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    assert decontaminate.find(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("size(hits) > 0").count() == 0
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_nothing_else_needs_this_package():
    code = "import sys; sys.modules['aerolith.llm'] = None; import aerolith.plans.queries, aerolith.streaming.live, aerolith.operators.cluster; print('ok')"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "ok", out.stderr
