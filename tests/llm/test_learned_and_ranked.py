"""Whitening, ranked lexical search and toxicity against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelens.llm import max_sketch, terms, toxicity, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbZz09 .,\n-_ÀéßÉ漢😀\t\x00", max_size=60)), max_size=12), st.sampled_from([3, 17, 1 << 22]))
def test_terms_equal_regular_expression(texts, piece):
    before, terms.PIECE = terms.PIECE, piece
    try:
        got, total = [collections.Counter() for _ in texts], [0] * len(texts)
        for at, x in terms.counted(pa.array(texts, pa.string())):
            values = [v.decode() for v in x.values.to_pylist()]
            for d, c, n in zip(x.text, x.code, x.count):
                got[at + d][values[c]] += int(n)
            total[at:at + len(x.total)] = x.total.tolist()
        assert got == [collections.Counter(words_of(t)) for t in texts]
        assert total == [len(words_of(t)) for t in texts]
    finally:
        terms.PIECE = before


def ranked(docs, items, k):
    """Brute force: {(item_id, rank, doc_id, score)}."""
    counts = [(i, collections.Counter(words_of(t))) for i, t in docs]
    full = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for _, c in full)
    df = collections.Counter(w for _, c in full for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(words_of(t))
    out = []
    for item, said in asked.items():
        scores = []
        for doc, c in full:
            n = sum(c.values())
            norm = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * norm)) for w in said if w in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(400)] + ["É", "漢字", "Ab", "AB", "x1"]
    text = lambda m: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ".", ",", "!"]) for _ in range(m))
    docs = [(i, text(rnd.choice([1, 3, 10, 40]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..!"), (None, text(20)), (None, text(5)), (3, text(8)), (n + 3, "w1 " * 700), (n + 4, text(9000))]
    docs += [(n + 10 + i, docs[5][1]) for i in range(30)]  # ties
    items = [(i, text(rnd.choice([1, 4, 25]))) for i in range(12)] + [(None, "w1 w2"), (50, None), (51, "?"), (52, "nowhere"), (0, "w2 É")]
    return docs, items


@pytest.mark.parametrize("pilot, cells, pairs, least", [(4096, 1 << 21, 16_384, 64), (40, 300, 20, 4), (10, 2000, 16_384, 4)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, pilot, cells, pairs, least):
    """The small settings give many blocks of queries, several rounds of bounds, and sketches in which terms collide."""
    for name, value in (("PILOT_ROWS", pilot), ("CELLS", cells), ("BLOCK_PAIRS", pairs), ("LEAST_SLOTS", least), ("TURN", 5)):
        monkeypatch.setattr(max_sketch, name, value)
    if least < 64:
        monkeypatch.setattr(max_sketch, "SPREAD", 1)
    docs, items = corpus(pilot, 300)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, n int").repartition(3)
    index = max_sketch.read_index(spark, max_sketch.write_index(frame))
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in max_sketch.search(index, asked, 20).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ranked(docs, items, 20)))


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = max_sketch.read_index(spark, max_sketch.write_index(docs))
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert max_sketch.search(index, items).collect() == []
    some = max_sketch.read_index(spark, max_sketch.write_index(spark.createDataFrame([(1, "a")], "doc_id long, text string")))
    assert max_sketch.search(some, items.limit(0)).collect() == []
    assert [tuple(r) for r in max_sketch.search(some, items).collect()] == ranked([(1, "a")], [(1, "a b")], 50)
    with pytest.raises(ValueError):
        max_sketch.search(some, items, 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 40), st.sampled_from(["plain", "few", "axes", "equal", "scales"]))
def test_rank_one_updates_equal_dense_decomposition(seed, size, n, kind):
    rng = np.random.default_rng(seed)
    x = np.floor(64 * rng.standard_normal((n, size)))
    if kind == "few":
        x = x[rng.integers(0, min(n, 3), n)]
    elif kind == "axes":
        x = np.eye(size)[rng.integers(0, size, n)] * 64
    elif kind == "equal":
        x[:] = x[0]
    elif kind == "scales":
        x *= 10.0 ** rng.integers(-6, 6, size)
    cut = int(rng.integers(0, n + 1))
    parts = []
    for rows in (x[:cut], x[cut:]):
        s = whitening.empty(size)
        for row in rows:
            s = whitening.add(s, row)
        parts.append(s)
    s = whitening.combine(*parts)
    c = x - x.mean(axis=0)
    want = c.T @ c
    scale = max(1e-300, np.abs(want).max(), np.abs(x).max() ** 2 * 1e-3)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() <= 1e-11 * scale * size
    assert np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() <= 1e-12 * size
    assert (np.diff(s.values) >= 0).all() and s.n == n


def test_weighted_update_equals_repeats():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6, 4))
    one, many = whitening.empty(4), whitening.empty(4)
    for i, row in enumerate(x):
        one = whitening.add(one, row, i + 1)
        for _ in range(i + 1):
            many = whitening.add(many, row)
    assert np.allclose((one.vectors * one.values) @ one.vectors.T, (many.vectors * many.values) @ many.vectors.T) and np.allclose(one.mean, many.mean)


def check_whitened(rows, vectors, k):
    kept = [(i, np.array(v, float)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    size = collections.Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, v) for i, v in kept if len(v) == size]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s).astype(float) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    rank = int((values > 1e-12 * values[0]).sum())
    k = min(k, rank)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    want = collections.Counter((i, int(v)) for (i, _), v in zip(kept, ((x * n - s) ** 2).sum(axis=1)))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1) == want
    for j in range(k):
        own = sorted(r["whitened"] for r in rows if r["component"] == j + 1)
        project = c @ basis[:, j] / math.sqrt(values[j])
        assert np.allclose(own, sorted(project), atol=1e-6) or np.allclose(own, sorted(-project), atol=1e-6)
        assert [*{r["explained"] for r in rows if r["component"] == j + 1}] == [pytest.approx(values[j] / values.sum(), rel=1e-9)]
    assert max(r["identity_error"] for r in rows) < 1e-9


@pytest.mark.parametrize("size, n, k", [(6, 300, 32), (40, 500, 32), (3, 4, 2)])
def test_whitening_equals_brute_force(spark, monkeypatch, size, n, k):
    monkeypatch.setattr(whitening, "PART_ROWS", 60)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(size)
    spread = np.linspace(1, 3, size)
    vectors = [(i, [float(c) for c in rng.standard_normal(size) * spread]) for i in range(n)]
    vectors += [(n, None), (n + 1, [None] * size), (n + 2, [float("nan")] + [0.0] * (size - 1)), (n + 3, [float("inf")] + [0.0] * (size - 1)), (n + 4, []), (n + 5, [1.0])]
    vectors += [(None, vectors[0][1]), (1, vectors[1][1])] + [(n + 9, vectors[2][1])] * 100
    frame = spark.createDataFrame([(*v, 1, "z") for v in vectors], "vec_id long, embedding array<float>, n int, component string")
    exact = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    check_whitened(whitening.whiten(frame, k).collect(), exact, k)


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [6.0, 2.0])], kind)).collect()
    assert {r["component"] for r in line} == {1} and {r["explained"] for r in line} == {1.0}
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], kind)).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in huge)


def texts_and_labels(n=1500, seed=1):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in "the of and to in is it on by at".split() for b in ["", "re", "nt", "ing", "ly", "er"]]
    bad = ["zorg", "blat", "quim", "fnord"]
    docs, truth = [], []
    for i in range(n):
        own = [rnd.choice(plain) for _ in range(rnd.choice([5, 30, 200, 3000] if i % 50 == 0 else [5, 30, 100]))]
        toxic = rnd.random() < 0.15
        for _ in range(rnd.choice([1, 2, 6]) if toxic else 0):
            own.insert(rnd.randrange(len(own) + 1), rnd.choice(bad).upper() + "!")
        docs.append((i, " ".join(own)))
        truth.append(toxic)
    labels = [(i, int(t)) for i, t in enumerate(truth) if rnd.random() < 0.5]
    return docs, truth, labels


def test_toxicity_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 700)
    docs, truth, labels = texts_and_labels()
    extra = [(9001, None), (9002, ""), (None, "a zorg b"), (3, docs[3][1])]
    frame = spark.createDataFrame([(*d, "x", 1.0) for d in docs + extra], "doc_id long, text string, part string, score double").repartition(3)
    marks = spark.createDataFrame([(*m, 1) for m in labels] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.classify(frame, marks).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r["doc_id"]: r for r in rows}
    held = [i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(len(docs))) and got[None]["held_out"] is False
    assert np.mean([got[i]["predicted"] == int(truth[i]) for i in held]) > 0.98
    assert got[9001]["score"] == got[9002]["score"] < 0.5 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(frame.repartition(5), marks).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.classify(docs, none).collect()} == {(0.0, 0)}
    clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.classify(docs, clean).collect()} == {0}
    one = spark.createDataFrame([(1, 1), (77, 1)], "doc_id long, toxic int")
    assert len(toxicity.classify(docs, one).collect()) == 2
    assert toxicity.classify(docs.limit(0), one).collect() == []


def test_risk_gradient_and_correction():
    rng = np.random.default_rng(0)

    def some(n):
        size = rng.integers(0, 4, n)
        return toxicity.Rows(np.concatenate([rng.choice(5, s, replace=False) for s in size] + [np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))

    toxic, plain, prior = some(7), some(11), 0.2
    for bias, falls in ((0.3, False), (-8.0, None)):
        w = np.append(rng.standard_normal(5), bias)
        if falls is None:
            w[:5] = 0
            toxic = toxicity.Rows(np.arange(3), np.array([0, 1, 2, 3]))
            plain, w[:3] = toxicity.Rows(np.zeros(0, np.int64), np.zeros(5, np.int64)), 9.0
        a, b = toxicity.risks(w, toxic, plain, prior)
        value = (lambda v: sum(toxicity.risks(v, toxic, plain, prior))) if b >= 0 else (lambda v: -toxicity.risks(v, toxic, plain, prior)[1])
        numeric = [(value(w + 1e-6 * e) - value(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)]
        assert np.allclose(toxicity.step_of(w, toxic, plain, prior), numeric, atol=1e-7)
        assert (b < 0) == (falls is None)


def test_driver_tables_give_whole_results(spark):
    d = "/root/testdata/sf0.001"
    from framelens.llm import queries

    rows = queries.op11_whitening(spark, d)
    check_whitened(rows.collect(), [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()], 32)
    assert queries.op13_toxicity(spark, d).count() == spark.read.parquet(f"{d}/documents.parquet").count()
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_lexical_search(spark, d).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(map(str, got)) == sorted(map(str, ranked(docs, items, 50)))
    assert rows.where(F.col("component") > 32).count() == 0
