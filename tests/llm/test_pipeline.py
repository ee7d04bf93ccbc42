"""The pipeline: order of the stages, columns, and each stage on what the one before kept."""

from __future__ import annotations

import pytest

import corpus_pipeline
from logweave.llm import queries


def test_stages_on_the_small_tables(spark):
    pytest.importorskip("public_tokenizers")
    sf_dir = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == kept
    assert {tuple(r) for r in packed.drop("sequence_id", "offset").collect()} == {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()}


def test_every_query_has_a_callable_and_known_sql():
    assert len(queries.QUERIES) == 10 and set(queries.SQL) <= set(queries.QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 11)] == [1] * 10
