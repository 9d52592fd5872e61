"""Selection, text vectors, field and substring search, headers, ids and refreshed documents against brute force."""

import datetime
import hashlib
import math
import random
import re
import unicodedata
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelens.functions import ids, text
from framelens.operators import encoder, fusion, lexical, quality, selection
from framelens.operators.walk import Walk, walk
from framelens.plans import enrich, media
from framelens.sources import readers
from framelens.streaming import ingest

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_walk_sees_each_group_once_and_stops(spark):
    class Sum(Walk):
        def __init__(self):
            self.n, self.key = 0, None

        def step(self, row):
            self.n, self.key = self.n + 1, row["k"]
            self.done = self.n == 3
            return {"k": row["k"], "v": row["v"]}

        def finish(self):
            yield {"k": self.key, "v": 1000 + self.n}

    rows = [(k, v) for k in ("a", "b", None, "") for v in range(5)] + [("c", 1)]
    for batch in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = walk(spark.createDataFrame(rows, "k string, v int").repartition(3), ["k"], ["v"], Sum, "k string, v int").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(k, v) for k in ("a", "b", None, "") for v in (0, 1, 2, 1003)] + [("c", 1), ("c", 1001)]))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def farthest(rows, budget):
    """Brute force over (shot, keyframe, frame, quality, vector)."""
    out = set()
    for shot in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == shot and r[4] and all(x is not None and math.isfinite(x) for x in r[4])]
        if not own:
            continue
        sizes = [len(r[4]) for r in own]
        dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
        own = [r for r in own if len(r[4]) == dim]
        if len(own) <= budget:
            out |= {r[1] for r in own}
            continue
        x = {r[1]: np.array(r[4]) for r in own}
        mean, span = np.mean(list(x.values()), axis=0), max(1, max(r[2] for r in own) - min(r[2] for r in own))
        first = min(own, key=lambda r: (-round(0.65 * (r[3] or 0) + 0.35 * float(x[r[1]] @ mean), 9), r[2], r[1]))
        chosen = [first]
        while len(chosen) < budget:
            left = [r for r in own if r not in chosen]
            value = lambda r: 0.65 * (1 - max(float(x[r[1]] @ x[c[1]]) for c in chosen)) + 0.20 * min(abs(r[2] - c[2]) for c in chosen) / span + 0.15 * (r[3] or 0)
            chosen.append(min(left, key=lambda r: (-round(value(r), 9), r[2], r[1])))
        out |= {r[1] for r in chosen}
    return out


@pytest.mark.parametrize("part, budget", [(8192, 4), (7, 3), (5, 1)])
def test_farthest_points_equal_brute_force(spark, monkeypatch, part, budget):
    monkeypatch.setattr(selection, "PART_FRAMES", part)
    rnd = random.Random(part)
    rows = [(f"s{min(i % 9, 4)}", f"k{i:03d}", rnd.randrange(60), rnd.choice([None, rnd.random()]), [rnd.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [("s0", "bad1", 3, 0.5, None), ("s0", "bad2", 3, 0.5, [float("nan")] * 6), ("s1", "bad3", 3, 0.5, [1.0, 2.0]), ("few", "f1", 1, 0.1, [1.0] * 6), ("none", "n1", 1, 0.1, None), ("s2", "bad4", 1, 0.2, [])]
    df = spark.createDataFrame(rows, "shot_id string, keyframe_id string, frame_idx long, quality_score double, vector array<double>").repartition(3)
    assert {r["keyframe_id"] for r in selection.farthest_points(df, budget).collect()} == farthest(rows, budget)
    assert selection.farthest_points(df.limit(0), budget).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.floats(0.05, 1.2))
def test_average_linkage_equals_dense_merging(seed, n, distance):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) + rng.standard_normal((rng.integers(1, 5), 4))[rng.integers(0, 1, n)] * 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        far = [(float(np.mean([1 - x[i] @ x[j] for i in a for j in b])), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q]
        d, p, q = min(far)
        if d > distance:
            break
        groups[p] += groups.pop(q)
    label = selection.average_linkage(x, distance)
    assert sorted(sorted(g) for g in groups) == sorted(sorted(np.flatnonzero(label == c).tolist()) for c in np.unique(label))


def test_cluster_representatives_leave_odd_vectors_out(spark):
    rows = [("s", "a", 1, 0.5, [1.0, 0.0]), ("s", "b", 2, 0.9, [0.99, 0.1]), ("s", "c", 3, 0.1, [0.0, 1.0]), ("s", "d", 4, None, None), ("s", "e", 5, 0.5, [float("nan"), 1.0]), ("s", "f", 6, 0.5, [1.0]), ("t", "g", 1, 0.5, None), (None, "h", 1, 0.5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "shot_id string, keyframe_id string, frame_idx long, quality_score double, vector array<double>")
    got = {(r["shot_id"], r["keyframe_id"], r["cluster_size"]) for r in selection.cluster_representatives(df, ["shot_id"]).collect()}
    assert got == {("s", "b", 2), ("s", "c", 1), (None, "h", 1)}


@pytest.mark.parametrize("least", [1, 6, 7, 13, 20, 64])
def test_hash_index_finds_all_near_hashes(least):
    rnd = random.Random(least)
    hashes = [rnd.getrandbits(64) for _ in range(60)]
    hashes += [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, min(63, least + 3)))) for h in hashes for _ in range(12)]
    walk_, kept = selection._Hashes(least), []
    for h in hashes:
        new = all((h ^ o).bit_count() >= least for o in kept)
        assert walk_.is_new(h) == new
        if new:
            kept.append(h)


def test_hashes_without_a_value_are_left_out(spark):
    df = spark.createDataFrame([("s", "a", 0.1, 7), ("s", "b", 0.9, 7), ("s", "c", None, 7), ("s", "d", 0.5, None), ("s", "e", 0.2, -1), (None, "f", 0.1, 7)], "shot_id string, keyframe_id string, quality_score double, phash long")
    assert {(r["shot_id"], r["keyframe_id"]) for r in selection.drop_near_hashes(df).collect()} == {("s", "b"), ("s", "e"), (None, "f")}


def number_of(word):
    return int(hashlib.md5(word.encode()).hexdigest()[:10], 16)


def vector_of(words, weights):
    v = [0.0] * encoder.DIMS
    for h in map(number_of, words):
        for i in range(encoder.ENTRIES):
            v[h >> 7 * i & 63] += weights.get(h >> 7 * encoder.ENTRIES & 4095, 0.0) * (-1 if h >> 7 * i + 6 & 1 else 1)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 1e-9 else None


def test_text_vectors_equal_brute_force(spark):
    texts = {1: "Mưa lớn mưa", 2: "nắng đẹp và mưa", 3: None, 4: "", 5: "...", 6: "một hai ba bốn"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    split = lambda t: re.findall(r"[a-z0-9_]+", "".join(c for c in unicodedata.normalize("NFD", t.replace("đ", "d")) if not unicodedata.combining(c)).lower()) if t else []
    df = {}
    for t in texts.values():
        for b in {number_of(w) >> 7 * encoder.ENTRIES & 4095 for w in split(t)}:
            df[b] = df.get(b, 0) + 1
    weights = {b: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for b, n in df.items()}
    made = encoder.bucket_weights(docs)
    assert {r["bucket"]: pytest.approx(r["weight"]) for r in made.collect()} == weights
    got = {r["doc_id"]: r["vector"] for r in encoder.encode(docs, made).collect()}
    want = {i: v for i, t in texts.items() if (v := vector_of(split(t), weights))}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
    assert encoder.encode(docs.limit(0), encoder.bucket_weights(docs.limit(0))).collect() == []


def test_field_search_by_weight_then_time(spark):
    docs = spark.createDataFrame([(1, "red car", "sea", 5.0), (2, "sea", "red red", 9.0), (3, "sea", "red red", 2.0), (4, None, None, 1.0), (5, "blue", "redish", None)], "doc_id long, title string, body string, at double")
    q = spark.createDataFrame([(1, "red"), (2, "red sea"), (3, "edi"), (4, ""), (5, None)], "query_id long, text string")
    got = lambda fields, all_=False: {q: [r["doc_id"] for r in rows] for q, rows in by(lexical.text_search(docs, q_, 10, all_, ["title", "body"], fields, "at")).items()}
    q_ = q

    def by(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r)
        return out

    assert got({"title": 5.0, "body": 1.0}) == {1: [1, 3, 2, 5], 2: [1, 3, 2], 3: [5]}
    assert got({"title": 0.1, "body": 1.0})[1] == [3, 2, 1, 5]
    assert got({"title": 1.0, "body": 1.0}, True) == {1: [1, 3, 2, 5], 2: [1, 3, 2], 3: [5]} or got({"title": 1.0, "body": 1.0}, True)[3] == [5]
    one = lexical.field_bm25(docs.select("doc_id", F.col("title").alias("text")), q, 10, {"text": 1.0})
    same = lexical.bm25(docs.select("doc_id", F.col("title").alias("text")), q, 10)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in same.collect()}


@FEW
@given(st.lists(st.one_of(st.none(), st.text("abAé_ .-", max_size=24)), max_size=14), st.lists(st.one_of(st.none(), st.text("abAé_ .-", max_size=7)), max_size=10), st.booleans())
def test_substrings_equal_brute_force(spark, texts, asked, small):
    before, lexical.BROADCAST_TERMS = lexical.BROADCAST_TERMS, 0 if small else lexical.BROADCAST_TERMS
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
        got = {tuple(r) for r in lexical.substring_hits(docs, q, ["text"]).collect()}
        said = [(i, (a or "").strip(" ").lower()) for i, a in enumerate(asked)]
        assert got == {(i, d) for i, a in said for d, t in enumerate(texts) if a and re.search(r"\w", a) and t and a in t.lower()}
    finally:
        lexical.BROADCAST_TERMS = before


def test_substring_plans_have_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "wo"), (2, "one two three")], "query_id long, text string")
    plan = lexical.substring_hits(docs, q, ["text"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_headers_that_break_the_contract_are_issues(spark, tmp_path):
    for name, body in {"a": "n,pts_time,fps,frame_idx\n1,0.0,25,0\n2,1.0,25,25\n", "b": "n,pts_time,frame_idx,fps\n1,0.0,0,25\n", "c": "\n", "d": "﻿n,pts_time,fps,frame_idx\r\n1,0.0,25,0\r\n", "e": "n,pts_time,fps,frame_idx,more\n1,0,25,0,9\n", "f": "n,pts_time,fps,frame_idx\nx,0,25,0\n"}.items():
        (tmp_path / f"{name}.csv").write_text(body, newline="")
    rows, issues = readers.checked_keyframe_map(spark, str(tmp_path))
    assert {r["video_id"] for r in rows.collect()} == {"a", "d", "f"} and rows.where("video_id = 'a'").count() == 2
    found = quality.folder_audit(rows.withColumn("row_number", F.expr("try_cast(n AS bigint)")), issues).collect()
    assert {(r["video_id"], r["code"]) for r in found} == {("b", "INVALID_COLUMNS"), ("c", "INVALID_COLUMNS"), ("e", "INVALID_COLUMNS"), ("f", "INVALID_VALUE")}


def test_watch_ids_equal_url_parsing(spark):
    name = "aB3_-xyzW09"
    urls = [f"https://www.youtube.com/watch?v={name}", f"http://youtu.be/{name}?t=3", f"https://youtu.be//{name}/", f"//m.youtube.com/x?b=1&v={name}#v=other", f"https://youtube.com/watch?v={name}&v=2", f"https://music.youtube.com/watch?v={name}", f"https://youtube.com:443/watch?v={name}", f"HTTPS://YouTube.com/watch?v={name}",
            f"youtube.com/watch?v={name}", f"https://youtube.com/watch?V={name}", "https://youtube.com/watch?v=short", f"https://youtube.com/watch?v={name}1", f"https://youtube.com/watch?v=%61{name[1:]}", f"https://youtube.com/watch?vv={name}", f"https://youtu.be/a/{name}", "", None, "https://youtu.be/", f"https://youtube.com/watch?v=&v={name}", f"https://youtube.com/watch?v=%zz{name[3:]}"]

    def want(url):
        if url is None:
            return None
        p = urlparse(url)
        host = p.netloc.lower()
        if host not in {*ids.WATCH_HOSTS, ids.SHORT_HOST}:
            return None
        value = p.path.strip("/") if host == ids.SHORT_HOST else parse_qs(p.query).get("v", [""])[0]
        return value if re.fullmatch(ids.WATCH_ID, value) else None

    got = {r["i"]: r["id"] for r in spark.createDataFrame(list(enumerate(urls)), "i int, url string").select("i", ids.watch_id(F.col("url")).alias("id")).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}


def test_composition_equals_unicodedata(spark):
    rnd = random.Random(4)
    alphabet = ["a", "e", "o", "́", "̂", "̣", "é", "ế", "Å", "ᄀ", "ᅡ", "ᆨ", "क़", "塚", "\U0002f800", " ", "\n", "đ", "z", "̈́", "Ω"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8)))) for i in range(400)] + [(400, None), (401, "plain text"), (402, "plain")]
    got = {r["i"]: r["t"] for r in text.compose(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    assert got == {i: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip() for i, t in rows}


def test_fusion_counts_a_repeated_id_once(spark):
    rows = [(1, "a", 1, 10), (1, "a", 4, 10), (1, "b", 2, 10), (1, "b", 1, 11)]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id int, channel string, rank int, doc_id long"), 5, {"a": 2.0}).collect()
    assert {(r["doc_id"], r["score"]) for r in got} == {(10, round(2 / 61 + 1 / 62, 9)), (11, round(1 / 61, 9))} and all(r["ranks"] for r in got)


def test_frame_documents_of_two_streams_equal_a_batch_run(spark, tmp_path):
    rnd = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    event = lambda i: (i, start + datetime.timedelta(minutes=rnd.randrange(600)), rnd.randrange(5), rnd.choice(["view", "click", "error"]), rnd.random() * 100, '{"k": %d}' % rnd.randrange(100))
    turn = lambda c, t: (c, t, "user", f"spoken words {c} {t}")
    kinds = {"events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "conversations": "conv_id long, turn int, role string, text string"}
    d, at = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], kinds["events"]).write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([], kinds["conversations"]).write.parquet(f"{d}/conversations.parquet")
    columns = ["doc_id", "shot_id", "frame_idx", "caption", "search_text", "asr_text", "confidence"]

    def refreshed():
        enrich.refresh_frames(spark, d, at, 1).awaitTermination()
        out = ingest.read_target(spark, f"{at}/table", "doc_id string, shot_id string, frame_idx long, caption string, search_text string, asr_text string, confidence double").select(*columns)
        return sorted(map(str, map(tuple, out.collect())))

    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.mode("append").parquet(f"{d}/{name}.parquet")
    spark.createDataFrame([event(0)], kinds["events"]).limit(0).write.mode("append").parquet(f"{d}/events.parquet")
    assert refreshed() == []
    arriving = [("conversations", [turn(c, t) for c in range(3) for t in range(3)]), ("events", [event(i) for i in range(40)]), ("events", [event(i) for i in range(40, 60)]), ("conversations", [turn(c, t) for c in range(5) for t in range(3, 6)])]
    for name, rows in arriving:
        spark.createDataFrame(rows, kinds[name]).coalesce(1).write.mode("append").parquet(f"{d}/{name}.parquet")
        batch = sorted(map(str, map(tuple, media.frames_of(spark, d).select(*columns).collect())))
        assert refreshed() == batch
        assert refreshed() == batch
    done = ingest.read_target(spark, f"{at}/table-batches", "batch long, keys long").groupBy("batch").count().collect()
    assert done and all(r["count"] == 1 for r in done)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_field_search_counts_terms_without_sets(spark):
    docs = spark.createDataFrame([(1, "red fox", "red"), (2, "fox", "den"), (3, None, None)], "doc_id long, title string, body string")
    q = spark.createDataFrame([(7, "red fox"), (8, "den")], "query_id long, text string")
    found = lexical.field_bm25(docs, q, 10, {"title": 2.0, "body": 1.0}, require_all=True)
    assert [(r.query_id, r.doc_id) for r in found.orderBy("query_id").collect()] == [(7, 1), (8, 2)]
    assert "collect_set" not in _plan(found)


def test_documents_are_dealt_by_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red w{i % 3}") for i in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"red w{i}") for i in range(3)], "query_id long, text string")
    before = lexical.bm25(docs, q, 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(lexical, "PAIRS", 10)
    dealt = lexical.bm25(docs, q, 5)
    assert "hashpartitioning(doc_id" in _plan(dealt) and ", 18), REPARTITION_BY_NUM" in _plan(dealt)
    assert dealt.orderBy("query_id", "rank").collect() == before


def test_substrings_in_place_and_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a Red fox ran", 0.5), (2, "redfoxes", 0.1), (3, None, 0.2), (1, "a Red fox ran", 0.5)], "doc_id long, text string, at double")
    q = spark.createDataFrame([(7, "a red fox"), (8, "fox"), (9, "!")], "query_id long, text string")
    rows = lambda: sorted(tuple(r) for r in lexical.substring_hits(docs, q, ["text"], ["at"]).collect())
    assert rows() == [(7, 1, 0.5), (8, 1, 0.5), (8, 2, 0.1)]
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert rows() == [(7, 1, 0.5), (8, 1, 0.5), (8, 2, 0.1)]


def test_a_text_is_tokenised_once_for_its_vector(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "fox"), (None, "den"), (3, "")], "doc_id long, text string")
    made = encoder.encode(docs, encoder.bucket_weights(docs))
    assert {r["doc_id"] for r in made.collect()} == {1, None}
    used = made.where("size(vector) > 0 AND forall(vector, x -> abs(x) <= 1)")
    plan = _plan(used).split("== Physical Plan ==")[1]
    assert "md5" not in plan and "conv(" not in plan and "sqrt" not in plan.lower() and plan.count("regexp_extract_all") <= 2


def test_composed_texts_go_on_in_slices(spark, monkeypatch):
    monkeypatch.setattr(text, "COMPOSED_ROWS", 2)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["é  x", None, "plain", "ü", "ñ é"])], "id long, t string")
    made = text.compose(rows, "t")
    assert {r.id: r.t for r in made.collect()} == {0: "é x", 1: None, 2: "plain", 3: "ü", 4: "ñ é"}
    plan = _plan(made)
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
