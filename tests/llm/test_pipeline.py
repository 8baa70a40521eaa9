"""The pipeline's stages: what they drop, what they keep, and that their columns are the documents'."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= before
        ids = docs.select("doc_id").distinct()
        assert out.join(ids, "doc_id", "left_anti").count() == 0
        before, docs = out.count(), out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_line_dedup_stage_keeps_every_document(spark):
    line = "a line that is repeated here"
    df = spark.createDataFrame([(1, line, 28), (2, line, 28), (3, None, 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_repeated_lines(spark, df, SF).collect()}
    assert out == {1: (line, 28), 2: ("", 0), 3: (None, 0)}


def test_empty_documents_pass(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).count() == 0


def test_near_duplicates_leave_clean_documents(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    clean = [(k, " ".join(r.choice(words) for _ in range(120))) for k in range(40)]
    copies = [(100 + k, clean[k][1]) for k in range(5)]
    df = spark.createDataFrame(clean + copies, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, df, SF).collect()}
    assert kept == set(range(40))
    assert corpus_pipeline.ORACLE_SQL is None
