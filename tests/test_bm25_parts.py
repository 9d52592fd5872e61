"""Documents are dealt by pairs of document and query."""

import random

import pytest

from framelens.operators import lexical

WORDS = ["red", "blue", "car", "bus", "tree", "sea", "river", "road"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("more", [{}, {"require_all": True}, {"within": "level"}])
def test_documents_are_dealt_by_pairs_and_answers_stay(spark, monkeypatch, more):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=6)), f"l{i % 3}") for i in range(60)], "doc_id long, text string, level string")
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 2))) for i in range(5)], "query_id long, text string")
    plain = lexical.bm25(docs, queries, 4, **more)
    expected = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(lexical, "PAIRS", 25)
    monkeypatch.setattr(lexical, "LEAST_PAIRS", 25)
    many = lexical.bm25(docs, queries, 4, **more)
    assert "RepartitionByExpression [doc_id" in optimized(many) and ", 12\n" in optimized(many)
    assert sorted(map(tuple, many.collect())) == expected


@pytest.mark.parametrize("fields", [None, {"text": 1.0, "level": 2.0}])
def test_beyond_straight_parts_counts_are_dealt_and_not_words(spark, monkeypatch, fields):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i % 50, " ".join(rng.choices(WORDS, k=6)), f"l{i % 3} red") for i in range(60)], "doc_id long, text string, level string")
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 2))) for i in range(5)], "query_id long, text string")
    search = lambda: lexical.field_bm25(docs, queries, 4, fields) if fields else lexical.bm25(docs, queries, 4)
    expected = sorted(map(tuple, search().collect()))
    monkeypatch.setattr(lexical, "PAIRS", 25)
    monkeypatch.setattr(lexical, "LEAST_PAIRS", 25)
    monkeypatch.setattr(lexical, "STRAIGHT", 5)
    many = search()
    lines = [line.strip(" :+-") for line in optimized(many).splitlines()]
    dealt = [i for i, line in enumerate(lines) if line.startswith("RepartitionByExpression [doc_id")]
    counts, words = dealt[:2]
    assert lines[counts].endswith(", 12") and lines[counts + 1].startswith("Aggregate [doc_id") and lines[words].endswith(", 5")
    assert sorted(map(tuple, many.collect())) == expected
