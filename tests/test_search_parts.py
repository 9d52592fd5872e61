"""Queries that rank by BM25 deal documents by pairs of document and query."""

import pytest

from framelens.operators import lexical
from framelens.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["collapse_by_shot", "content_filtered_search", "fusion_contributions", "multi_query_fusion", "post_filtered_search", "quality_by_type_and_level"])
def test_parts_grow_with_pairs_and_answers_stay(spark, monkeypatch, name):
    expected = sorted(map(tuple, catalogue.QUERIES[name](spark, DATA).collect()), key=repr)
    pairs = spark.read.parquet(f"{DATA}/documents.parquet").count() * spark.read.parquet(f"{DATA}/benchmark.parquet").count()
    monkeypatch.setattr(lexical, "PAIRS", -(-pairs // 13))
    monkeypatch.setattr(lexical, "LEAST_PAIRS", pairs)
    many = catalogue.QUERIES[name](spark, DATA)
    dealt = [line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression [doc_id" in line]
    assert dealt and all(line.endswith(", 13") for line in dealt)
    assert sorted(map(tuple, many.collect()), key=repr) == expected
