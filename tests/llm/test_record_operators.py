import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.llm import common, kd_search, merkle, url_rules, vector_dedup
from framelens.llm.queries import URL_RULES


def fit(url, rules):
    """Brute force: (host, path, rule, verdict)."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    hits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def urls():
    rnd = random.Random(0)
    out = [None, "", "no scheme", "http://", "://x.com/en/", "http://COM/en/1", "http://com", "http://a.Example.com/en/77?x=/de/", "http://example.net/de/8#://q", "ftp://xexample.com/en/7", "http://a..com/en/", "http://.com/en/a", "http://É.com/en/", "http://x.com" + "/en/" * 3000]
    for _ in range(300):
        host = rnd.choice(["", "a.", "b.a.", "www."]) + rnd.choice(["example", "Example", "other"]) + rnd.choice([".com", ".net", ".org", ".com."])
        out.append(rnd.choice(["http", "https"]) + "://" + host + rnd.choice(["", "/", "/en", "/en/", "/en/7", "/en/70", "/de/8", "/de/", "/es/x", "/EN/7"]) + rnd.choice(["", "?q=1", "#t", "/more"]))
    return out + out[-5:]


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_rules_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_rules, "MAX_BROADCAST_BYTES", 0)
    rules = spark.createDataFrame(URL_RULES + URL_RULES[:1], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i if i != 9 else None, u, "x", "y", "z", "k") for i, u in enumerate(urls())], "page_id long, url string, host string, verdict string, key string, cut string")
    got = url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(i if i != 9 else None, *fit(u, URL_RULES)) for i, u in enumerate(urls())]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_url_rules_keep_columns_of_any_name(spark):
    names = ["page_id", "url", "best", "row", "weight", "key", "digest", "__salt", "__parts", "suffix", "a.b"]
    pages = spark.createDataFrame([(1, "http://x.com/en/1", *range(9)), (2, None, *range(9))], "page_id long, url string, " + ", ".join(f"`{n}` int" for n in names[2:]))
    for rules in (URL_RULES, []):
        got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert got.columns == [*names, "host", "path", "rule", "verdict"]
        rows = sorted(map(tuple, got.collect()))
        assert [r[2:11] for r in rows] == [tuple(range(9))] * 2 and rows[0][-1] == ("block" if rules else "allow")


def test_long_hosts_and_rules_of_many_labels(spark):
    rules = [("a.b.c.d.com", "", "block"), ("com", "/x", "allow"), ("", "/y", "block")]
    long = "http://" + "q." * 30_000
    every = [long + "com/x", long + "a.b.c.d.com/", "http://a.b.c.d.com", "http://.a.b.c.d.com/x", "http://b.c.d.com/z", "http://com/" + "x" * 50_000, None, None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(every)], "page_id long, url string")
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = [(i, *fit(u, [r for r in rules if r[0]])) for i, u in enumerate(every)]
    assert sorted(map(str, map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()))) == sorted(map(str, want))


def test_spread_join_deals_hot_and_null_keys(spark):
    rows = [(i, None if i % 4 == 0 else "hot" if i % 2 else f"k{i % 90}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string")
    classes = df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("weight")).withColumn("n", F.col("weight") * 2)
    got = {r["id"]: r["n"] for r in common.spread_join(df, classes, ["k"], F.col("id")).collect()}
    count = {k: sum(r[1] == k for r in rows) for _, k in rows}
    assert got == {i: None if k is None else 2 * count[k] for i, k in rows}


def test_url_rules_of_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert [r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0)).collect()] == ["allow"]


SCHEMA = "vec_id long, embedding array<float>, label int, weight string, rep string, side string, score string"


def vectors(n=160, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for k in range(40, 120):  # near copies, chains and scaled copies
        x[k] = x[k % 13] * rng.choice([0.5, 1, 3]) + rng.choice([0, 0.05, 0.3]) * rng.standard_normal(dim)
    rows = [(int(i) * 5, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5001, rows[3][1], 1), (5002, rows[3][1], 1), (5003, None, 1), (5050, [], 1), (5005, [0.0] * dim, 1), (5100, [float("nan")] * dim, 1), (5007, [None] + [1.0] * (dim - 1), 1), (5150, [float("inf")] * dim, 1),
             (5009, [1.0, 2.0], 1), (5200, [2.0, 4.0], 1), (None, rows[0][1], 1), (5010, [3.0], 1), (5250, [0.5], 1), (5012, [-0.5], 1)]
    return [(*r, "a", "b", "c", "d") for r in rows]


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows + rows[2:3], SCHEMA).repartition(3)
    every = rows + rows[2:3]
    sound = [k for k, r in enumerate(every) if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    links = {k: [j for j in sound if j != k and len(every[j][1]) == len(every[k][1]) and cos(np.float64(every[k][1]), np.float64(every[j][1])) >= 0.9] for k in sound}
    label = {k: every[k][0] for k in sound}
    for _ in range(len(sound)):
        new = {k: min([label[k], *(label[j] for j in links[k])]) for k in sound}
        if new == label:
            break
        label = new
    want = sorted(str((r[0], len(links.get(k, ())), label.get(k, r[0]), r[0] is None or label.get(k, r[0]) == r[0])) for k, r in enumerate(every))
    for small in (False, True):
        if small:
            for name, value in (("CELL", 3), ("TILE", 2), ("VERIFIED", 5), ("LINKS_HELD", 3), ("SAMPLE", 40), ("MOST_CELLS", 16)):
                monkeypatch.setattr(vector_dedup, name, value)
        got = vector_dedup.near_vectors(df, 0.9).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_dedup.near_vectors(df, 1.5)


def test_subspace_budgets_add_up():
    for dim in (1, 2, 16, 17, 64, 100):
        parts = vector_dedup.subspaces(dim, 0.9)
        assert abs(sum(b for _, b in parts) - 0.2) < 1e-12 and [i for p, _ in parts for i in range(dim)[p]] == list(range(dim))
        assert np.allclose(vector_dedup.rotation(dim) @ vector_dedup.rotation(dim).T, np.eye(dim))


def test_cells_lose_no_near_pair():
    rng = np.random.default_rng(8)
    x = vector_dedup.rotated(rng.standard_normal((600, 48)))
    x[300:] = vector_dedup.rotated(x[:300] + 0.2 * rng.standard_normal((300, 48)) / 7)
    for part, budget in vector_dedup.subspaces(48, 0.9):
        sub = x[:, part]
        c = vector_dedup.Cells(sub[::3], 4)
        cell = c.of(sub)
        low, high = (np.stack([f(sub[cell == k], axis=0) if (cell == k).any() else np.zeros(16) for k in range(16)]) for f in (np.min, np.max))
        c.bound(low, high, np.bincount(cell, minlength=16))
        assert np.bincount(cell, minlength=16).max() < 100
        near = [set(c.near(k, budget).tolist()) for k in range(16)]
        for i, j in zip(*np.nonzero(((sub[:, None] - sub[None]) ** 2).sum(axis=2) <= budget)):
            assert cell[j] in near[cell[i]] and cell[i] in near[cell[j]]


def test_kd_search_equals_brute_force(spark, monkeypatch):
    rows = vectors(dim=6, seed=3) + [(k * 50 + 10_000, [0.25] * 6, 0, "a", "b", "c", "d") for k in range(20)]
    rows += [rows[10], rows[10], (rows[10][0], rows[12][1], 7, *rows[10][3:]), (rows[3][0], rows[5][1], 7, *rows[3][3:])]  # ids that come again
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    every = sorted((r[0], np.float32(r[1]).tolist()) for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]))
    v = [np.floor(256 * np.float64(x)) for _, x in every]
    want = []
    for p, (q, _) in enumerate(every):
        if q % 50 == 0:
            best = sorted((-int(v[p] @ v[o]), i) for o, (i, _) in enumerate(every) if o != p and len(v[o]) == len(v[p]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for small in (False, True):
        if small:
            for name, value in (("SHARD_ROWS", 20), ("LEAF_ROWS", 3), ("SHARDS_IN_TURN", 2), ("QUERY_ROWS", 7)):
                monkeypatch.setattr(kd_search, name, value)
        got = kd_search.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert kd_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_best_first_opens_few_nodes():
    """On clustered points a query scans its own cluster's leaves alone, and a floor keeps it from opening others."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((2000, 4)) + 200 * np.eye(4)[np.arange(2000) % 4])
    q = x[:8]
    best = kd_search.Best(np.full(8, -np.inf), 5)
    scanned = []
    add = best.add
    best.add = lambda rows, score, places: (scanned.append(len(rows) * len(places)), add(rows, score, places))
    kd_search.search(q, np.arange(8), x, np.arange(2000), best)
    for k in range(8):
        score = x @ q[k]
        score[k] = -np.inf
        assert best.score[k].tolist() == np.sort(score)[::-1][:5].tolist()
    assert sum(scanned) < 0.5 * 8 * 2000
    again = kd_search.Best(best.kth, 5)
    kd_search.search(q, np.arange(8), x, np.arange(2000), again)
    assert (again.score == best.score).all()


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    chain = list(range(200))
    edges = [(a, a + 1) for a in chain[:-1]] + [(1000, 1000 + k) for k in range(1, 80)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (None, 3), (1, 0)]
    got = {r["id"]: r["component_id"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merkle_audit_finds_each_fault(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 512)
    monkeypatch.setattr(merkle, "FAN", 2)
    monkeypatch.setattr(merkle, "CHUNK", 3000)
    rows = [(i, f"http://x/{i}\r\nb", "<p>" + "é" * (i % 97) + "\r\n\r\nWARC/1.1\r\n", "x") for i in range(600)] + [(None, None, None, "x"), (5, "", "", "x"), (5, "", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    path = merkle.write_warc(pages)
    ours = common.materialize(merkle.records(merkle.read_chunks(spark, path)))
    assert sorted(str((r["page_id"], r["length"])) for r in ours.collect()) == sorted(str((r[0], len(merkle.record(*r[:3])))) for r in rows)
    assert merkle.audit(ours, ours).count() == 0
    theirs = common.materialize(merkle.damaged(merkle.read_chunks(spark, path)))
    kind = {"00": "changed", "01": "missing", "02": "missing"}
    want = sorted((r["segment"], r["offset"], kind[r["digest"][:2]]) for r in ours.collect() if r["digest"][:2] in kind)
    found = merkle.audit(ours, theirs).collect()
    assert want and sorted((r["segment"], r["offset"], r["status"]) for r in found if r["status"] != "extra") == want
    inserted = {hashlib.sha256(merkle.record(None, None, r["digest"])).hexdigest() for r in ours.collect() if r["digest"][:2] == "03"}
    assert inserted and sorted(r["theirs"] for r in found if r["status"] == "extra") == sorted(inserted)
    back = sorted((r["ours"] or "", r["theirs"] or "", r["status"]) for r in merkle.audit(theirs, ours).collect())
    assert back == sorted((r["theirs"] or "", r["ours"] or "", {"missing": "extra", "extra": "missing"}.get(r["status"], r["status"])) for r in found)
    assert merkle.audit(ours, ours.limit(0)).count() == len(rows) and merkle.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_audit_finds_records_again_after_a_length_change(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 700)
    monkeypatch.setattr(merkle, "FAN", 3)

    def of(contents):
        at, out = 0, []
        for name, content in contents:
            out.append((0, at, len(content), name, hashlib.sha256(content.encode()).hexdigest()))
            at += len(content)
        return spark.createDataFrame(out, "segment int, offset long, length long, record_id string, digest string")

    base = [(f"id{k}", f"record {k} " * (1 + k % 9)) for k in range(300)]
    again = base[:150] + [("same", "twin"), ("same", "twin"), ("same", "twin"), ("", "no id")] + base[150:]
    status = lambda a, b: sorted((r["status"], r["offset"]) for r in merkle.audit(of(a), of(b)).collect())
    offset = lambda rows, k: sum(len(c) for _, c in rows[:k])
    assert status(base, base[1:]) == [("missing", 0)]
    assert status(base[1:], base) == [("extra", 0)]
    assert status(base, base[:7] + [("new", "inserted")] + base[7:]) == [("extra", offset(base, 7))]
    assert status(base, base[:9] + [("id9", "longer than it was " * 5)] + base[10:]) == [("changed", offset(base, 9))]
    assert status(base, base[:9] + base[10:200] + [("id200", "other")] + base[201:]) == sorted([("missing", offset(base, 9)), ("changed", offset(base, 200))])
    assert status(base, base[::-1]) == []
    assert status(again, again[:151] + again[152:]) == [("missing", offset(again, 152))]
    assert status(again, again[:153] + [("", "no iq")] + again[154:]) == [("changed", offset(again, 153))]
    assert status([], base[:2]) == [("extra", 0), ("extra", len(base[0][1]))]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_files_round_trip(spark, tmp_path, compress):
    rows = [(1, "http://a/\r\nb", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (None, None, None), (3, "http://c/", ""), (4, "http://d/", "x" * 200_000)]
    path = str(tmp_path / "warc")
    merkle.write_warc_files(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, compress=compress)
    got = merkle.read_warc_files(spark, path).collect()
    want = [(f"<urn:page:{'' if i is None else i}>", (u or "").replace("\r", "%0D").replace("\n", "%0A"), (h or "").encode()) for i, u, h in rows]
    assert sorted((r["record_id"], r["uri"], bytes(r["payload"])) for r in got) == sorted(want)
    assert {(r["record_type"], r["content_type"], r["date"]) for r in got} == {("resource", "text/html", "1970-01-01T00:00:00Z")}


def test_records_are_parsed_among_damage():
    whole = merkle.record(7, "u", "body")
    members = b"garbage" + whole + b"WARC/1.1\r\nContent-Length: 99999\r\n\r\ncut" + whole.replace(b"Content-Length", b"content-length")
    assert [(n, page) for _, n, _, page in merkle.split_records(members)] == [(len(whole), 7)] * 2
