"""Registered queries of the subpackage against their SQL, and the pipeline."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from oracle import compare, connect

import corpus_pipeline
from strandcheck.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_query(spark, name):
    query = SimpleNamespace(build=llm.QUERIES[name], sql=llm.ORACLE_SQL.get(name))
    assert compare(spark, connect(FOLDER), name, query, FOLDER) is None


def test_stages(spark):
    from strandcheck.session import materialize

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    ids = sorted(r["doc_id"] for r in docs.collect())
    packed = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r["doc_id"] for r in packed.select("doc_id").distinct().collect()) == ids


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
