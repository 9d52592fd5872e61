"""Queries that grow with the documents meet them in tiles, and pairs are never dealt."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framelens.operators import lexical
from framelens.plans import catalogue

DATA = "/root/testdata/sf0.001"
WORDS = ["red", "blue", "car", "bus", "tree", "sea", "river", "Straße", "road", "of", "the"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_topic_search_deals_no_pairs(spark, monkeypatch):
    def never(*_):
        raise AssertionError("pairs of document and query are dealt")

    monkeypatch.setattr(lexical, "dealt_parts", never)
    made = catalogue.QUERIES["topic_search"](spark, DATA)
    assert not re.search(r"Aggregate \[query_id#\d+L?, doc_id#\d+\], .*sum\(", made._jdf.queryExecution().optimizedPlan().toString())
    assert len(made.collect())


@pytest.mark.parametrize("k,small", [(1, False), (4, True)])
def test_tiles_rank_as_pairs_do(spark, monkeypatch, k, small):
    """With repeated and null ids, copies that tie, empty and null texts, and queries without an answer."""
    rng = random.Random(k)
    text = lambda n: rng.choice([None, "", *[" ".join(rng.choices(WORDS, range(1, 12), k=rng.randint(1, n))) for _ in range(8)]])
    made = [(rng.choice([None, "a"]) if i % 40 == 0 else f"d{i % 110}", text(3), text(30)) for i in range(90)]
    docs = spark.createDataFrame(made + [(f"c{i}", *r[1:]) for i, r in enumerate(made[:60])], "doc_id string, title string, body string")
    queries = spark.createDataFrame([(i, text(4)) for i in range(70)] + [(None, "sea"), (99, "none"), (100, "!")], "query_id long, text string")
    fields = {"title": 2.0, "body": 1.0}
    expected = rows(lexical.field_bm25(docs, queries, k, fields))
    for name, n in {"TILE_DOCS": 13, "LEAST_TILE_DOCS": 13, "TILE_QUERIES": 20, "BROADCAST_TERMS": 0 if small else lexical.BROADCAST_TERMS}.items():
        monkeypatch.setattr(lexical, name, n)
    found = lexical.field_bm25(docs, queries, k, fields, many=True)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == expected
    both = lambda **more: rows(lexical.text_search(docs, queries, k, columns=["title"], fields=fields, **more))
    assert both(many=True) == both()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text("abAé_ .-", max_size=24)), max_size=14), st.lists(st.one_of(st.none(), st.text("abAé_ .-", max_size=9)), max_size=14))
def test_substrings_of_many_queries_equal_brute_force(spark, texts, asked):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {tuple(r) for r in lexical.substring_hits(docs, q, ["text"], many=True).collect()}
    said = [(i, (a or "").strip(" ").lower()) for i, a in enumerate(asked)]
    assert got == {(i, d) for i, a in said for d, t in enumerate(texts) if a and re.search(r"\w", a) and t and a in t.lower()}


def test_a_common_inner_word_is_not_sought_in_titles(spark):
    docs = spark.createDataFrame([(1, "sea and river"), (2, "red and blue"), (3, "a deepsea and riverbed"), (4, "sea and river and road")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "sea and river"), (2, "d and b"), (3, "river and"), (4, "and")], "query_id long, text string")
    assert rows(lexical.substring_hits(docs, q, ["text"], many=True)) == sorted([(1, 1), (1, 3), (1, 4), (2, 2), (3, 4), *[(4, i) for i in (1, 2, 3, 4)]], key=repr)
    with pytest.raises(ValueError):
        lexical.field_bm25(docs, q, 3, {"text": 1.0}, require_all=True, many=True)
