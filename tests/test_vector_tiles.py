"""Vectors of one matched value are dealt by pairs of blocks."""

import numpy as np
import pytest

from framelens.operators import vectors


@pytest.mark.parametrize("few", [True, False])
def test_vectors_of_one_value_are_dealt_in_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    monkeypatch.setattr(vectors, "VECTOR_ROWS", 8)
    if not few:
        monkeypatch.setattr(vectors, "_few", lambda *a: False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(5)
        known = [(i, "a" if i % 10 else "b", [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(100)]
        asked = [(i, "a" if i % 3 else "b", [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(9)]
        found = vectors.exact_top_k(spark.createDataFrame(asked, "query_id long, wanted string, vector array<double>"), spark.createDataFrame(known, "vec_id long, video string, vector array<double>"), 3, match=("wanted", "video"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = []
    for q, wanted, v in asked:
        best = sorted((-float(np.dot(v, x)), i) for i, own, x in known if own == wanted)[:3]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert rows == sorted(expected)
    assert any(all(name in line for name in ("Exchange hashpartitioning", "key#", "dim#", "block#", "turn#")) for line in plan.splitlines())
