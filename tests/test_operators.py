import datetime
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelens.functions import geometry, ids, text
from framelens.operators import cells, documents, encoder, enrichment, evaluate, fusion, ledger, lexical, quality, selection, temporal, vectors

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def shots(spark, rows):
    return spark.createDataFrame([(f"v{v}", f"v{v}:{i}", i, a, b, b - a, int(a * 25), int(b * 25)) for v, i, a, b in rows],
                                 "video_id string, shot_id string, shot_index int, start_time double, end_time double, duration_sec double, start_frame long, end_frame long")


def test_two_shots_make_two_edges_and_one_event(spark):
    s = shots(spark, [(1, 0, 0.0, 2.0), (1, 1, 2.0, 5.0)])
    assert sorted(r["relation"] for r in temporal.temporal_edges(s).collect()) == ["AFTER", "NEXT"]
    assert [r["shot_count"] for r in temporal.pack_events(s).collect()] == [2]


def test_fusion_ranks_the_shared_answer_first(spark):
    r = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y"), (1, "b", 1, "y"), (1, "b", 2, "z")], "query_id int, channel string, rank int, doc_id string")
    assert fusion.rrf(r, 3).orderBy("rank").first()["doc_id"] == "y"


def speech_text(t, segments, margin, limit):
    """Brute force of the interval join for one moment."""
    seen = {}
    for a, b, said in segments:
        said = " ".join((said or "").split())
        if a is None or b is None or not math.isfinite(a) or not math.isfinite(b) or not said:
            continue
        low, high = min(a, b) - margin, max(a, b) + margin
        if low <= t <= high:
            key = said.lower()
            seen[key] = min(seen.get(key, (low, said)), (low, said))
    return " ".join(s for (low, s), key in sorted(((v, k) for k, v in seen.items()), key=lambda x: (x[0][0], x[1])))[:limit].rstrip(" ")


@FEW
@given(st.lists(st.tuples(st.integers(-40, 200), st.integers(-40, 200), st.sampled_from(["a", "A", "b c", " b  c", "long words here", "", None])), max_size=12), st.integers(0, 15))
def test_interval_join(spark, segments, limit):
    rows = [(a / 2, b / 2, s) for a, b, s in segments] + [(float("nan"), 1.0, "x"), (None, 1.0, "x")]
    k = spark.createDataFrame([(f"k{i}", "v", i * 3.5) for i in range(12)], "keyframe_id string, video_id string, pts_time double")
    s = spark.createDataFrame([("v", *r) for r in rows] + [("w", 0.0, 99.0, "other")], "video_id string, start_time double, end_time double, text string")
    got = {r["keyframe_id"]: r["asr_text"] for r in temporal.interval_join(k, s, max_chars=limit, bucket=7.0).collect()}
    assert got == {f"k{i}": speech_text(i * 3.5, rows, 1.5, limit) for i in range(12)}


@FEW
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 45)), min_size=1, max_size=15))
def test_event_packing(spark, parts):
    t, rows = 0, []
    for i, (gap, length) in enumerate(parts):
        rows.append((1, i, float(t + gap), float(t + gap + length)))
        t += gap + length
    want, current = [], []
    for _, i, a, b in rows:
        if current and b - current[0][1] <= 30:
            current.append((i, a))
        else:
            if current:
                want.append(current)
            current = [(i, a)]
    want.append(current)
    got = temporal.pack_events(shots(spark, rows)).orderBy("event_no").collect()
    assert [r["shot_ids"] for r in got] == [[f"v1:{i}" for i, _ in w] for w in want]


def test_short_shots_join_the_one_before(spark):
    got = temporal.merge_short_shots(shots(spark, [(1, 0, 0.0, 0.1), (1, 1, 0.1, 3.0), (1, 2, 3.0, 3.2), (1, 3, 3.2, 9.0)])).orderBy("part").collect()
    assert [(r["start_time"], r["end_time"], r["merged"]) for r in got] == [(0.0, 0.1, 1), (0.1, 3.2, 2), (3.2, 9.0, 1)]


def test_frame_plan_is_even_and_bounded(spark):
    got = {}
    for r in temporal.frame_plan(shots(spark, [(1, 0, 0.0, 0.0), (1, 1, 0.0, 5.0), (1, 2, 0.0, 100.0)])).collect():
        got.setdefault(r["shot_id"], []).append(r["frame_idx"])
    assert got["v1:0"] == [0] and sorted(got["v1:1"]) == [0, 41, 83, 125] and len(got["v1:2"]) == 24 and max(got["v1:2"]) == 2500


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.one_of(st.none(), st.integers(0, 30))), min_size=1, max_size=20), st.integers(1, 6), st.integers(1, 2))
def test_diversify(spark, rows, k, per_shot):
    hits = [(1, i + 1, f"k{i}", f"v{v}", f"s{v}{s}" if s else None, None if t is None else float(t), 1.0 - i / 100) for i, (v, s, t) in enumerate(rows)]
    df = spark.createDataFrame(hits, "query_id int, rank int, keyframe_id string, video_id string, shot_id string, pts_time double, score double")
    got = fusion.diversify(df, k, per_shot).orderBy("new_rank").collect()
    chosen, count = [], {}
    for strict in (True, False):
        for h in hits:
            key = h[4] or h[2]
            if len(chosen) < k and h not in chosen and count.get(key, 0) < per_shot and not (strict and h[5] is not None and any(c[3] == h[3] and c[5] is not None and abs(c[5] - h[5]) < 3 for c in chosen)):
                chosen.append(h)
                count[key] = count.get(key, 0) + 1
    assert [r["keyframe_id"] for r in got] == [c[2] for c in chosen]
    with pytest.raises(ValueError):
        fusion.diversify(df, 0)


def test_task_scores_of_the_worked_examples(spark):
    truth = spark.createDataFrame([("kis", 0, "L01_V001", 500, 510, None), ("qa", 0, "L05_V005", 800, 900, "màu xanh"), *[("trake", j, "L10_V010", a, a + 10, None) for j, a in enumerate((95, 145, 195, 245))]],
                                  "question_id string, moment int, video_id string, start long, end long, answer string")
    rows = [("kis", 1, 0, "L01_V001", 505, None), ("kis", 2, 0, "L01_V001", 600, None), ("kis", 3, 0, "L02_V003", 505, None),
            ("qa", 1, 0, "L05_V005", 888, "màu xanh"), ("qa", 2, 0, "L05_V005", 888, "màu trắng"), ("qa", 3, 0, "L06_V007", 888, "màu xanh")]
    rows += [("trake", 1, j, "L10_V010", f, None) for j, f in enumerate((101, 156, 203, 251))]
    answers = spark.createDataFrame(rows, "question_id string, rank int, moment int, video_id string, frame_idx long, answer string")
    got = {(r["question_id"], r["rank"]): r["r_score"] for r in evaluate.r_scores(answers, truth).collect()}
    assert [got["kis", i] for i in (1, 2, 3)] == [1, 0, 0] and [got["qa", i] for i in (1, 2, 3)] == [1, 0, 0] and got["trake", 1] == 0.75
    scores = spark.createDataFrame([("q", 1, 0.5), ("q", 3, 0.8), ("q", 15, 0.6)], "question_id string, rank int, r_score double")
    assert evaluate.final_scores(scores).first()["final_score"] == 0.74


def test_text_functions(spark):
    row = spark.createDataFrame([("  Trời\tMưa  lớn ", "Đường-phố 12", "Straße_x ÉTÉ")], "a string, b string, c string").select(
        text.normalize_text(F.col("a")), text.fold_key(F.col("b")), text.tokenize(F.col("c")), text.scene_labels(F.lit("Trời mưa trong nhà")), text.content_tokens(F.lit("Chào các bạn xem phim hay")),
        text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), text.jaccard(F.array().cast("array<string>"), F.array(F.lit("b"))), text.jaccard_distance(F.array().cast("array<string>"), F.array().cast("array<string>")),
        text.join_distinct(F.array(F.lit("a"), F.lit(" A"), F.lit(""), F.lit("b"), F.lit("c")), 2), text.sentence(F.lit("abc")), text.truncate_words(F.lit("one two three"), 9), text.is_boilerplate(F.lit("Hẹn gặp lại nhé")),
        text.phrase_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()
    assert list(row) == ["Trời Mưa lớn", "duong pho 12", ["strasse_x", "été"], ["indoor", "rain"], ["chao", "xem", "phim"], 0.5, 0.0, 0.0, "a b", "Abc.", "one two…", True, ["a b", "b c", "a b c"]]


def test_ids_and_geometry(spark):
    import hashlib

    one = spark.range(1)
    pk = one.select(ids.vector_key(F.lit("kf1"))).first()[0]
    assert pk == int.from_bytes(hashlib.sha256(b"kf1").digest()[:8], "big") & (2**63 - 1)
    assert one.select(ids.stable_id(F.lit("a"), F.lit(1))).first()[0] == hashlib.sha1(b"a|1").hexdigest()[:20]
    assert [one.select(ids.dataset_group(F.lit(v))).first()[0] for v in ("L21_V001", "foo_bar")] == ["L21", "foo"]
    assert ids.config_hash({"b": 1, "a": [2]}) == ids.config_hash({"a": [2], "b": 1})
    row = one.select(geometry.keyframe_budget(F.lit(13.0), F.lit(0.2)), geometry.keyframe_budget(F.lit(1.0), F.lit(0.2)), geometry.text_zone(F.lit(0.5), F.lit(0.9)), geometry.hamming(F.lit(7), F.lit(1)),
                     geometry.frame_quality(F.lit(1500.0), F.lit(127.5), F.lit(0.0), F.lit(0.0)), geometry.valid_box(F.lit(0.0), F.lit(0.0), F.lit(1.1), F.lit(1.0))).first()
    assert list(row) == [4, 1, "ticker", 2, 1.0, False]


def test_exact_search_equals_numpy_and_cells_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    q = df.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    exact = vectors.exact_top_k(q, df, 5)
    score = np.round(x[::40].astype(float) @ x.T.astype(float), 6)
    want = {(40 * i, int(j)) for i, row in enumerate(score) for j in np.lexsort((np.arange(400), -row))[:5]}
    assert {(r["query_id"], r["vec_id"]) for r in exact.collect()} == want
    with pytest.raises(ValueError):
        vectors.exact_top_k(q, df, 0)


def test_stored_cells_find_nine_tenths_and_prune(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    cells.write_cells(df, f"{tmp_path}/index")
    index = cells.open_cells(spark, f"{tmp_path}/index")
    assert len(index.centres) == 50 and 0.92 <= index.recall <= 1 and 1 < index.probes < 50
    exact = vectors.exact_top_k(q, df, 10)
    recall = lambda probes=None: vectors.recall_at(cells.search_cells(index, q, 10, probes=probes), exact).first()["recall"]
    assert recall() >= 0.9 and recall(50) == 1.0 > recall(2)
    one = cells.search_cells(index, q.where("query_id = 0"), 10, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert len(set(re.findall(r"cell#\d+ IN \(([^)]*)\)", plan))) == 1 and "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")


def odd_vectors(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(40)] + [(50, None), (51, [None, 1.0, 1.0]), (52, [float("nan"), 1.0, 1.0]), (53, []), (54, [1.0, 2.0]), (55, [2.0, 2.0]), (56, [float("inf"), 0.0, 0.0]), (3, [3.0, 1.0, 2.0])]
    return spark.createDataFrame([(i, v, f"s{i % 3}", float(i)) for i, v in rows], "vec_id long, vector array<double>, shot_id string, pts_time double")


def test_cells_of_odd_and_no_vectors(spark, tmp_path):
    df = odd_vectors(spark)
    q = df.select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id"])
    cells.write_cells(df, f"{tmp_path}/a", n_cells=4)
    index = cells.open_cells(spark, f"{tmp_path}/a")
    got = {tuple(r) for r in cells.search_cells(index, q, 5, probes=4).collect()}
    assert got == {tuple(r) for r in vectors.exact_top_k(q, df, 5).collect()}  # all cells: exact, lengths apart
    assert {r[0] for r in got} == {*range(40), 54, 55}
    cells.write_cells(df.limit(0), f"{tmp_path}/b")
    none = cells.open_cells(spark, f"{tmp_path}/b")
    assert cells.search_cells(none, q, 5).collect() == [] and none.recall is None
    assert cells.search_cells(index, q.limit(0), 5).collect() == []
    cells.write_cells(df.where("vec_id = 7"), f"{tmp_path}/c")
    assert {r["vec_id"] for r in cells.search_cells(cells.open_cells(spark, f"{tmp_path}/c"), q, 5).collect()} == {7}


def test_group_vectors_of_odd_vectors(spark):
    got = {r["shot_id"]: r for r in vectors.group_vectors(odd_vectors(spark), ["shot_id"]).collect()}
    assert set(got) == {"s0", "s1", "s2"} and all(len(r["vector"]) == 3 and abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in got.values())
    assert sum(r["keyframe_count"] for r in got.values()) == 48
    own = [v for i, v in [(i, [float(i), 1.0, 2.0]) for i in range(40) if i % 3 == 0] + [(3, [3.0, 1.0, 2.0])]]
    mean = np.mean(own, axis=0)
    assert np.allclose(got["s0"]["vector"], mean / np.linalg.norm(mean))
    q = odd_vectors(spark).select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id"])
    assert {r["query_id"] for r in vectors.two_stage(q, odd_vectors(spark), 2, 3).collect()} == set(range(40))


def test_bm25_needs_a_positive_k_and_folds_accents(spark):
    docs = spark.createDataFrame([(1, "trời mưa lớn"), (2, "nắng"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "mua")], "query_id long, text string")
    assert [r["doc_id"] for r in lexical.bm25(docs, q, 5).collect()] == [1]
    assert lexical.bm25(docs, q, 5, fold=False).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25(docs, q, 0)
    with pytest.raises(ValueError):
        lexical.filter_level(docs, ["scene"])


def test_mapping_audit_skips_rows_that_are_not_numbers(spark):
    rows = [("v", 2, "1", "0", "0", "25"), ("v", 3, "x", "5", "1", "25"), ("v", 4, "2", "0", "1", "25"), ("v", 5, "2", "9", "2", "25"), ("v", 6, "3", "8", "3", "25"), ("v", 7, "4", "9", "9", "0")]
    got = quality.mapping_audit(spark.createDataFrame(rows, "video_id string, row_number int, n string, frame_idx string, pts_time string, fps string")).collect()
    assert {(r["row_number"], r["code"]) for r in got} == {(3, "INVALID_VALUE"), (4, "DUPLICATE_FRAME"), (5, "INVALID_MONOTONICITY"), (6, "INVALID_MONOTONICITY"), (7, "INVALID_MONOTONICITY")}


def test_frame_documents_of_the_smoke_case(spark):
    k = spark.createDataFrame([("k1", "v", "s1", 10, 0.4), ("k2", "v", "s2", 60, 2.4)], "keyframe_id string, video_id string, shot_id string, frame_idx long, pts_time double")
    ocr = spark.createDataFrame([("k1", "Xin chào", "Xin chào HTV")], "keyframe_id string, scene_text string, text string")
    det = spark.createDataFrame([("d1", "k1", "car", 0.9), ("d2", "k1", "car", 0.8), ("d3", "k1", "person", 0.7)], "detection_id string, keyframe_id string, class_name string, confidence double")
    speech = spark.createDataFrame([("k2", "trời mưa")], "keyframe_id string, asr_text string")
    caption = spark.createDataFrame([("k2", "một con đường")], "keyframe_id string, caption string")
    frames = documents.frame_documents(k, ocr, documents.frame_objects(k, det), speech, caption)
    a, b = sorted(frames.collect(), key=lambda r: r["keyframe_id"])
    assert a["object_counts"] == {"car": 2, "person": 1} and a["ocr_other_text"] == "Xin chào HTV" and a["confidence"] == 0.55 and a["caption"].startswith("có car, person")
    assert b["confidence"] == 0.85 and b["scene_labels"] == ["rain"] and b["caption"] == "một con đường"
    made = documents.shot_documents(frames)
    assert made.count() == 2
    events = documents.event_documents(temporal.pack_events(spark.createDataFrame([("v", "s1", 0, 0.0, 2.0), ("v", "s2", 1, 2.0, 5.0)], "video_id string, shot_id string, shot_index int, start_time double, end_time double")), made)
    assert [(r["keyframe_id"], r["shots"]) for r in events.collect()] == [("k1", 2)]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    s = spark.createDataFrame([(2, "B", 9), (3, "C", 8)], "id int, name string, n int")
    assert {tuple(r) for r in ledger.insert_missing(t, s, ["id"]).collect()} == {(1, "a", 1), (2, "b", 2), (3, "C", 8)}
    assert {tuple(r) for r in ledger.upsert(t, s, ["id"], ["n"]).collect()} == {(1, "a", 1), (2, "b", 9), (3, None, 8)}


def test_selection_by_brute_force(spark):
    rnd = random.Random(0)
    rows = [(f"s{k % 2}", f"k{k:02d}", k, rnd.random(), rnd.getrandbits(63), [rnd.gauss(0, 1) for _ in range(4)], rnd.choice("ab")) for k in range(24)]
    df = spark.createDataFrame(rows, "shot_id string, keyframe_id string, frame_idx long, quality_score double, phash long, vector array<double>, signature string")
    kept = {}
    for s, k, _, _, h, _, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all((h ^ o).bit_count() >= 30 for _, o in kept.setdefault(s, [])):
            kept[s].append((k, h))
    assert {(r["shot_id"], r["keyframe_id"]) for r in selection.drop_near_hashes(df, least=30).collect()} == {(s, k) for s, v in kept.items() for k, _ in v}
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    far = set()
    for s in ("s0", "s1"):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        span = own[-1][2] - own[0][2]
        chosen = [max(own, key=lambda r: 0.65 * r[3] + 0.35 * sum(dot(r[5], o[5]) for o in own) / len(own))]
        while len(chosen) < 5:
            left = [r for r in own if r not in chosen]
            chosen.append(max(left, key=lambda r: 0.65 * (1 - max(dot(r[5], c[5]) for c in chosen)) + 0.20 * min(abs(r[2] - c[2]) for c in chosen) / span + 0.15 * r[3]))
        far |= {r[1] for r in chosen}
    assert {r["keyframe_id"] for r in selection.farthest_points(df, 5).collect()} == far

    unit = {r[1]: [x / dot(r[5], r[5]) ** 0.5 for x in r[5]] for r in rows}
    want = set()
    for s in ("s0", "s1"):
        clusters = [[r[1]] for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[2])]
        while len(clusters) > 1:
            gaps = {(i, j): sum(1 - dot(unit[a], unit[b]) for a in clusters[i] for b in clusters[j]) / (len(clusters[i]) * len(clusters[j])) for i in range(len(clusters)) for j in range(i)}
            i, j = min(gaps, key=gaps.get)
            if gaps[i, j] > 0.5:
                break
            clusters[j] += clusters.pop(i)
        for c in clusters:
            centre = [sum(unit[k][d] for k in c) / len(c) for d in range(4)]
            norm = dot(centre, centre) ** 0.5
            quality = {r[1]: r[3] for r in rows}
            want.add((max(c, key=lambda k: 0.80 * dot(unit[k], centre) / norm + 0.20 * quality[k]), len(c)))
    assert {(r["keyframe_id"], r["cluster_size"]) for r in selection.cluster_representatives(df, ["shot_id"], 0.5).collect()} == want
    want = set()
    for s in ("s0", "s1"):
        last, n = None, 0
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            if n < 2 and (n == 0 or r[6] != last):
                want.add(r[1])
                last, n = r[6], n + 1
    assert {r["keyframe_id"] for r in selection.evidence_changes(df).collect()} == want


def test_windows_and_key_points(spark):
    rows = [("v", f"s{i}", i, i * 3.0, i * 3.0 + 2, f"word{i} alpha beta gamma delta item{i} " * 2) for i in range(12)]
    s = spark.createDataFrame(rows, "video_id string, segment_id string, segment_index int, start_time double, end_time double, text string")
    w = enrichment.sentence_windows(s)
    assert w.count() == 12 and w.where(F.length("text") > 280).count() == 0
    titles = spark.createDataFrame([("v", "alpha title")], "video_id string, title string")
    points = enrichment.key_points(enrichment.window_scores(w, s, titles), 3).orderBy("point_no").collect()
    assert 1 <= len(points) <= 3 and [r["point_no"] for r in points] == list(range(1, len(points) + 1))


def test_key_points_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(f"v{i % 3}", f"s{i:03d}", round(rnd.random() * 200, 1), "t", [rnd.choice("abcdefghijkl") for _ in range(8)], round(rnd.choice([1.0, 1.5, rnd.random() * 3]), 6)) for i in range(90)]
    rows = [(v, s, t, t + 3, x, w, q) for v, s, t, x, w, q in rows] + [("one", "only", 0.0, 0.5, "t", list("abcdef"), 1.0)]
    want = set()
    for v in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1]))
        span = max(1.0, *(r[3] for r in own))
        like, open_, used, chosen = [0.0] * len(own), [True] * len(own), set(), []
        while any(open_) and len(chosen) < 4:
            fifth = [min(4, int(5 * r[2] / span)) for r in own]
            best = max((i for i in range(len(own)) if open_[i]), key=lambda i: own[i][6] - 1.6 * like[i] + 0.35 * (fifth[i] not in used))
            chosen.append(best)
            used.add(fifth[best])
            for i, r in enumerate(own):
                near = len(set(r[5]) & set(own[best][5])) / len(set(r[5]) | set(own[best][5]))
                like[i] = max(like[i], near)
                open_[i] = open_[i] and near < 0.76 and i != best
        want |= {(v, n + 1, own[i][1]) for n, i in enumerate(sorted(chosen))}
    df = spark.createDataFrame(rows, "video_id string, segment_id string, start_time double, end_time double, text string, tokens array<string>, score double")
    assert {(r["video_id"], r["point_no"], r["segment_id"]) for r in enrichment.key_points(df, 4).collect()} == want


def test_spans_of_any_length_are_two_rows(spark):
    k = spark.createDataFrame([("k1", "v", 5.0), ("k2", "v", 1e9), ("k3", "w", 1.0), ("k4", "v", -40.0)], "keyframe_id string, video_id string, pts_time double")
    s = spark.createDataFrame([("a", "v", 0.0, 1e12, "long"), ("b", "v", 4.0, 5.0, "short"), ("c", "v", -1e300, -30.0, "early"), ("d", "w", 9.0, 2.0, "swapped"), ("e", "v", float("nan"), 1.0, "no time"), ("f", "v", 1e12, 1e308, "late")],
                              "segment_id string, video_id string, start_time double, end_time double, text string")
    assert temporal._spans(s.where("segment_id <> 'e'"), F.least("start_time", "end_time"), F.greatest("start_time", "end_time"), 30.0).count() <= 10
    got = {r["keyframe_id"]: r["asr_text"] for r in temporal.interval_join(k, s).collect()}
    assert got == {"k1": "long short", "k2": "long", "k3": "swapped", "k4": "early"}
    near = {r["segment_id"]: r["keyframe_id"] for r in temporal.nearest_inside(s.where("segment_id <> 'e'"), k).collect()}
    assert near == {"a": "k1", "b": "k1", "c": "k4", "d": None, "f": None}


def test_joined_texts_stand_once(spark):
    from framelens.functions.text import join_distinct

    df = spark.createDataFrame([(["A  b", "a B", None, " ", "c", "C", "d"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(join_distinct(F.col("t"), 2), join_distinct(F.col("t"), 9)).collect()][:2] == ["A b c", ""]
    assert df.select(join_distinct(F.col("t"), 9)).first()[0] == "A b c d"


def test_events_walk_over_many_batches(spark):
    rnd = random.Random(4)
    rows, at = [], {"a": 0.0, "b": 0.0}
    for i in range(3000):
        v = "a" if i % 4 else "b"
        end = at[v] + rnd.choice([0.5, 3.0, 20.0, 45.0])
        rows.append((v, f"{v}{i:05d}", i, at[v], end))
        at[v] = end
    want = []
    for v in "ab":
        first, ids, last = None, [], None
        for _, s, _, start, end in (r for r in rows if r[0] == v):
            if ids and end - first > 30:
                want.append((v, first, last, tuple(ids)))
                ids = []
            first, last = (first, max(last, end)) if ids else (start, end)
            ids.append(s)
        want.append((v, first, last, tuple(ids)))
    df = spark.createDataFrame(rows, "video_id string, shot_id string, shot_index int, start_time double, end_time double").repartition(5)
    got = temporal.pack_events(df).collect()
    assert sorted((r["video_id"], r["start_time"], r["end_time"], tuple(r["shot_ids"])) for r in got) == sorted(want) and all(r["shot_count"] == len(r["shot_ids"]) for r in got)
    assert {(r["video_id"], r["event_no"]) for r in got} == {(v, n) for v in "ab" for n in range(sum(w[0] == v for w in want))}


def test_exact_search_in_small_blocks_and_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    monkeypatch.setattr(vectors, "VECTOR_ROWS", 11)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((90, 4)), 1)
    rows = [(i, v.tolist(), f"g{i % 4}") for i, v in enumerate(x)] + [(500, None, "g0"), (501, [], "g0"), (502, [1.0, None, 0.0, 0.0], "g1"), (503, [1.0, 2.0], "g1"), (504, [2.0, 1.0], "g1"), (505, [float("nan")] * 4, "g1"), (506, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, g string").repartition(3)
    q = df.where("vec_id % 10 = 0 OR vec_id >= 500").select(F.col("vec_id").alias("query_id"), "vector", F.col("g").alias("want"))
    good = [(i, v, g) for i, v, g in rows if v and all(c is not None and c == c for c in v)]
    for match in (None, ("want", "g")):
        want = set()
        for i, v, g in good:
            if i % 10 == 0 or i >= 500:
                best = sorted((-round(float(np.dot(v, w)), 6), j) for j, w, h in good if len(w) == len(v) and (match is None or (g is not None and g == h)))[:4]
                want |= {(i, n + 1, j) for n, (_, j) in enumerate(best)}
        got = vectors.exact_top_k(q, df, 4, match=match).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want and len(got) == len(want)
    assert vectors.exact_top_k(q.limit(0), df, 4).count() == 0 and vectors.exact_top_k(q, df.limit(0), 4).count() == 0


@pytest.mark.parametrize("terms", [200_000, 0])
def test_bm25_by_brute_force_on_both_paths(spark, monkeypatch, terms):
    import math

    monkeypatch.setattr(lexical, "BROADCAST_TERMS", terms)
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))), f"l{i % 3}") for i in range(60)]
    asked = [(1, "a b"), (2, "c c h x"), (3, "zz"), (4, "")]
    df, q = spark.createDataFrame(docs, "doc_id long, text string, level string"), spark.createDataFrame(asked, "query_id long, text string")
    n, mean = len(docs), sum(len(t.split()) for _, t, _ in docs) / len(docs)
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w in "abcdefgh" if (f := sum(w in t.split() for _, t, _ in docs))}
    score = lambda t, ws: round(sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in ws if w in t), 6)
    every = [(qi, level, -score(t.split(), ws), i) for qi, text in asked for ws in [set(text.split())] for i, t, level in docs if ws & set(t.split())]
    want = sorted(every, key=lambda r: (r[0], r[2], r[3]))
    got = [(r["query_id"], r["doc_id"]) for r in lexical.bm25(df, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [(qi, i) for qi in (1, 2) for _, _, _, i in [r for r in want if r[0] == qi][:5]]
    by_level = {(r["query_id"], r["level"], r["rank"], r["doc_id"]) for r in lexical.bm25(df, q, 2, within="level").collect()}
    assert by_level == {(qi, lv, k + 1, r[3]) for qi in (1, 2) for lv in ("l0", "l1", "l2") for k, r in enumerate([r for r in want if r[0] == qi and r[1] == lv][:2])}


def test_substrings_by_brute_force(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["Alpha", "beta", "gam-ma", "x", "xx", "delta,"]) for _ in range(rnd.randint(0, 9)))) for i in range(80)] + [(900, None)]
    asked = [(1, "pha beta x"), (2, "ALPHA BETA XX"), (3, "a, x"), (4, "-"), (5, "  ma "), (6, "x x x"), (7, "nothing here at all"), (8, None), (9, "x%")]
    got = {tuple(r) for r in lexical.substring_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), ["text"]).collect()}
    assert got == {(q, i) for q, s in asked if s and any(c.isalnum() for c in s) for i, t in docs if s.strip().lower() in (t or "").lower()}


def test_descriptions_keep_the_editorial_part(spark):
    text = ("Người dân vùng lũ nhận lương thực cứu trợ sáng hôm nay tại trung tâm xã http://t.co/x\n#tag\nTheo dõi fanpage của chúng tôi\n\n"
            "Người dân vùng lũ nhận lương thực cứu trợ sáng hôm nay tại trung tâm xã\n\nQuá ngắn\n\n - Đội cứu hộ tiếp cận khu dân cư bị cô lập, phát thuốc men nước sạch cho bà con |")
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(enrichment.clean_description(F.col("t"))).collect()]
    assert got[0] == ["Người dân vùng lũ nhận lương thực cứu trợ sáng hôm nay tại trung tâm xã.", "Đội cứu hộ tiếp cận khu dân cư bị cô lập, phát thuốc men nước sạch cho bà con."] and got[1:] == [[], []]
    topic = spark.range(1).select(enrichment.topic_for(F.lit("L24"), F.lit("Đoàn A"), F.lit(text)), enrichment.topic_for(F.lit("L26"), F.lit("Gà kho MÓN NGON MỖI NGÀY tập 3"))).first()
    assert topic[0].endswith("trung tâm xã.") and topic[1] == "Ẩm thực - Hướng dẫn nấu ăn: Gà kho"


def test_captions_are_cleaned(spark):
    from framelens.operators.understanding import parse_caption

    raw = ['x ```json {"caption_vi": " a  b ", "main_subjects": [{"name_vi": "cô", "category": "PERSON", "count": "3", "confidence": "nan", "dominant_colors": ["đỏ", "đỏ"]}, {"category": "rock", "count": -2}], "visible_text": ["A", "", "A"], '
           '"environment": "In door", "weather": "SUNNY", "confidence": 7}```', "no json", None, "{broken", '{"confidence": "x", "time_of_day": "Night"}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(parse_caption(F.col("r"))).collect()]
    assert got[0]["caption"] == "a b" and got[0]["visible_text"] == ["A"] and (got[0]["environment"], got[0]["weather"], got[0]["confidence"]) == ("unknown", "sunny", 1.0)
    one, two = got[0]["main_subjects"]
    assert (one["category"], one["count"], one["confidence"], one["age_group"], one["dominant_colors"]) == ("person", 3, 0.0, "unknown", ["đỏ"]) and (two["category"], two["count"], two["age_group"]) == ("other", 1, "not_applicable")
    assert got[1] is None and got[2] is None and got[4]["time_of_day"] == "night" and got[4]["confidence"] == 0.0


def test_a_region_outside_the_frame_is_an_error(spark):
    c = spark.createDataFrame([(1, 1, "k", "v", "s", 1.0, 0.9), (1, 2, "m", "v", "s", 2.0, 0.5)], "query_id int, rank int, keyframe_id string, video_id string, shot_id string, pts_time double, score double")
    boxes = [(1, "k", 1, 1.0, 0.2, 0.1, 0.1, 0.5, 0.5), (1, "m", 1, 1.0, 0.9, 0.0, 0.0, 1.0, 1.0)]
    kind = "query_id int, keyframe_id string, clause int, weight double, region_score double, x1 double, y1 double, x2 double, y2 double"
    got = fusion.localized_search(c, spark.createDataFrame(boxes, kind), 5).collect()
    assert [r["keyframe_id"] for r in got] == ["m"]  # one of a shot
    with pytest.raises(Exception, match="invalid normalised box"):
        fusion.localized_rerank(c, spark.createDataFrame(boxes[:1] + [(1, "m", 1, 1.0, 0.9, 0.5, 0.0, 0.5, 1.0)], kind)).collect()


def test_feedback_marks_hold_each_id_once(spark):
    rows = [("s", 1, 7, None), ("s", 2, 8, None), ("s", 3, 7, 5), ("s", 4, None, 5), ("t", 1, None, None)]
    df = spark.createDataFrame(rows, "session_id string, revision int, positive_id long, negative_id long")
    assert {tuple(r) for r in ledger.feedback_marks(df).collect()} == {("s", "positive", 7, 1), ("s", "positive", 8, 2), ("s", "negative", 5, 3)}
    assert {tuple(r) for r in ledger.feedback_sizes(df).collect()} == {("s", 1, 1, 0), ("s", 2, 2, 0), ("s", 3, 2, 1), ("s", 4, 2, 1), ("t", 1, 0, 0)}


def test_caption_of_the_nearest_frame(spark):
    rnd = random.Random(1)
    k = [(f"k{i:02d}", f"s{i % 3}", rnd.randint(0, 40)) for i in range(60)]
    c = [("s0", rnd.randint(0, 40), f"c{i}") for i in range(9)] + [("s1", 5, "x"), ("s1", 15, "y"), ("s1", 15, "w")]
    want = {}
    for i, s, f in k:
        best = min(((abs(f - g), g, t) for o, g, t in c if o == s), default=None)
        want[i] = (best and best[2], "evidence_only" if best is None else "direct" if best[0] == 0 else "propagated")
    got = temporal.propagate_captions(spark.createDataFrame(k, "keyframe_id string, shot_id string, frame_idx long"), spark.createDataFrame(c, "shot_id string, frame_idx long, caption string"))
    assert {r["keyframe_id"]: (r["caption"], r["caption_source"]) for r in got.collect()} == want


def test_sentence_windows_by_brute_force_without_a_video_in_memory(spark, capsys):
    rnd = random.Random(3)
    rows, at = [], 0.0
    for i in range(400):
        text = None if i % 37 == 0 else "" if 200 <= i < 330 else "x" * rnd.choice([3, 40, 119, 120, 200, 281])
        rows.append(("v" if i % 3 else "w", f"s{i:03d}", i, at, at + 1.0, text))
        at += 1.0 + (rnd.random() if 200 <= i < 330 else rnd.choice([0.1, 1.5, 4.0]))
    want = set()
    for v in "vw":
        own = [r for r in rows if r[0] == v]
        for i, r in enumerate(own):
            text, end = r[5] or "", r[4]
            for n in own[i + 1:]:
                if len(text) >= 120 or n[3] - end > 2.5 or len(text) + len(n[5] or "") > 280:
                    break
                text, end = f"{text} {n[5] or ''}", n[4]
            want.add((v, r[1], r[3], end, text))
    made = enrichment.sentence_windows(spark.createDataFrame(rows, "video_id string, segment_id string, segment_index int, start_time double, end_time double, text string"))
    got = made.collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    made.explain()
    assert "InPandas" not in capsys.readouterr().out


def test_review_and_lines(spark):
    kind = "question_id string, qtype string, events int, frames array<struct<video_id:string,frame_idx:long,pts_time:double>>, answer_text string"
    rows = [("a", "kis", 0, [("v", 5, 1.0)], None), ("b", "qa", 0, [("v", 5, 1.0)], ' red "x" '), ("c", "trake", 2, [("v", 5, 2.0), ("v", 9, 1.0)], None), ("d", "qa", 0, [], ""), ("e", "trake", 2, [("v", 1, 1.0), ("v", 2, 2.0)], None)]
    df = spark.createDataFrame(rows, kind)
    got = {r["question_id"]: (r["status"], r["messages"]) for r in ledger.review_answers(df).collect()}
    assert got == {"a": ("ready", []), "b": ("ready", []), "c": ("invalid", ["ORDER"]), "d": ("missing", ["NO_FRAME", "NO_ANSWER"]), "e": ("ready", [])}
    lines = {(r["question_id"], r["line"]) for r in ledger.submission_rows(df).collect()}
    assert lines == {("a", "v,5"), ("b", 'v,5,"red ""x"""'), ("c", "v,5,9"), ("e", "v,1,2")}
    assert datetime.date(2024, 1, 1)  # the fixture views' first day
