from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from marketlens.llm.tables import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_stages_pass_on_the_columns_of_documents(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    columns, labels = docs.columns, {r.doc_id: r for r in table(spark, SF_DIR, "labels").collect()}
    before = {r.doc_id for r in docs.collect()}
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{place}")
        docs = spark.read.parquet(f"{tmp_path}/{place}")
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after < before, name
        if name == "quality classifier":
            assert all(labels[i].quality == 0 for i in before - after if i in labels)
        if name == "toxicity":
            assert all(labels[i].toxic == 1 for i in before - after if i in labels)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == before
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))


def test_empty_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_every_numbered_query_and_the_pipeline_are_registered():
    names = [n.split("_")[0] for n in driver.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in driver.queries()
