import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelens.llm import bpe, mixing, near_dedup, quality, sharding, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER_BYTES = bytes(range(65)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(91, 256))
#: Extra columns whose names the operators use themselves.
CLASH = "doc_id long, text string, source string, size string, shard string, n_shingles string, tokens string, part string, start string, target string, taken string, family string, kept string"


def corpus(seed=0):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 60, 120]))] for _ in range(25)]
    rows = []
    for k, words in enumerate(base):
        for copy in range(rnd.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 4]) if copy else 0):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own), f"s{k % 4}"))
    rows += [(len(rows), "  A b\tC\n d ", None), (len(rows) + 1, "", "s0"), (len(rows) + 2, None, "s1"), (len(rows) + 3, " \n ", "s2"), (len(rows) + 4, "one", "s3"), (len(rows) + 5, "One", "s3")]
    rows.append((len(rows), " ".join(rnd.choice(vocabulary) for _ in range(20_000)), "s0"))
    rows += [rows[3], rows[3], (None, "no id here at all", "s1")]
    return [(i, t, s, *["x"] * 10) for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def shingles_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """Brute force: doc_id to smallest reachable doc_id."""
    sets = {i: shingles_of(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_duplicates_equal_brute_force(docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = components(rows)
    for small in (False, True):
        if small:  # blocks and pair lists of a few rows
            monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 2)
            monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 150)
            monkeypatch.setattr(near_dedup, "PAIRS_HELD", 3)
        got = near_dedup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
        sizes = {(r["doc_id"], r["n_shingles"]) for r in got}
        assert sizes == {(i, len(shingles_of(t))) for i, t in rows}
    assert len(set(want.values())) < len(want)


def test_keep_one_keeps_whole_rows(docs):
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def water_level(sizes, weights, cap):
    total, left, fixed = sum(sizes), set(range(len(sizes))), {}
    while True:
        share = {k: (total - sum(fixed.values())) * weights[k] / sum(weights[j] for j in left) for k in left}
        above = [k for k in left if share[k] > cap * sizes[k]]
        if not above:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        for k in above:
            fixed[k] = cap * sizes[k]
            left.discard(k)


def test_mixing_meets_targets(spark, docs, monkeypatch):
    uneven = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (4000, "b"), (70, "c"), (900, "d"), (30, None), (0, "e"), (11, "b")])], "doc_id long, text string, source string")
    for block, shard_words, fan in ((mixing.BLOCK_WORDS, mixing.SHARD_WORDS, mixing.FAN), (5, 60, 3)):
        for name, value in (("BLOCK_WORDS", block), ("SHARD_WORDS", shard_words), ("FAN", fan)):
            monkeypatch.setattr(mixing, name, value)
        for table in (docs, uneven):
            got = mixing.mix(table).collect()
            rows = table.select("doc_id", "text", "source").collect()
            assert len(got) == len(rows)
            size = {}
            for r in rows:
                size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
            order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
            want = dict(zip(order, water_level([size[s] for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))], 3)))
            taken = {}
            for r in got:
                assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
                assert 0 <= r["taken"] <= 3 * r["size"]
                taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            for s, t in taken.items():
                if want[s] >= 3 * size[s] * (1 - 1e-9):
                    assert t == 3 * size[s]  # a source at its cap takes all of it
                elif block == mixing.BLOCK_WORDS and shard_words > 10_000:
                    assert abs(t - want[s]) <= 1.5 * block
                else:  # shards whose last block is partial may lack it
                    assert abs(t - want[s]) <= 1.5 * block * (1 + size[s] / shard_words)
            assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(5)).collect()))


def test_apportion_gives_highest_quotients(spark):
    rnd = random.Random(4)
    for seats in (0, 1, 3, 17, 100):
        shares = [rnd.choice([0, 1, 2, 10, 50, 400]) * rnd.random() for _ in range(9)]
        df = spark.createDataFrame([(k, s, seats) for k, s in enumerate(shares)], "k int, share double, seats long")
        got = {r["k"]: r["won"] for r in mixing.apportion(df, [], ["k"], "share", "seats", "won").collect()}
        quotients = sorted(((-s / (2 * j - 1), k) for k, s in enumerate(shares) for j in range(1, seats + 1) if s > 0))[:seats]
        want = {k: sum(q[1] == k for q in quotients) for k in range(9)}
        assert got == want
    for room in (0.0, 0.3, 1.0):  # ceilings that bind by less than a seat
        shares = [float(rnd.randint(1, 60)) for _ in range(9)]
        most = [int(np.ceil(s * (40 / sum(shares)) + room)) for s in shares]
        seats = min(40, sum(most))
        df = spark.createDataFrame([(k, s, seats, m) for k, (s, m) in enumerate(zip(shares, most))], "k int, share double, seats long, most long")
        got = {r["k"]: r["won"] for r in mixing.apportion(df, [], ["k"], "share", "seats", "won", "most").collect()}
        quotients = sorted((-s / (2 * j - 1), k) for k, s in enumerate(shares) for j in range(1, most[k] + 1))[:seats]
        assert got == {k: sum(q[1] == k for q in quotients) for k in range(9)}


def test_draw_meets_targets_by_whole_rows(spark, docs, monkeypatch):
    got = mixing.draw(docs)
    assert got.columns == docs.columns
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.choice([3, 10, 40, 90, 2000 if i % 50 == 0 else 7]), f"s{rnd.choice([0, 0, 0, 1, 2])}", "x") for i in range(3000)] + [(1, "w w", "s0", "x"), (1, "w w w", "s0", "y"), (None, "w", None, "z"), (4000, None, "s1", "n"), (4001, " ", "s2", "n")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, __size string").repartition(4)
    for shard_words in (mixing.SHARD_WORDS, 6000):
        monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
        goal = {r["source"]: r["target"] for r in mixing.mix(table).select("source", "target").distinct().collect()}
        drawn = [tuple(r) for r in mixing.draw(table).collect()]
        assert sorted(map(str, drawn)) == sorted(map(str, map(tuple, mixing.draw(table.repartition(7)).collect())))
        size, times = {}, {}
        for r in drawn:
            size[r[2]] = size.get(r[2], 0) + len(WORD.findall(r[1] or ""))
            times[r] = times.get(r, 0) + 1
        assert set(times) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in times.items())
        assert times[rows[-1]] == times[rows[-2]] == 1
        for s, n in size.items():
            assert abs(n - goal[s]) <= 0.05 * goal[s] + 3


def test_shards_hold_whole_groups(docs):
    got = sharding.shard(docs, 4).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    text = {}
    for r in rows:
        text.setdefault(r["doc_id"], r["text"] or "")
    place = {}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert place.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    for k in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    load = [sum(r["size"] for r in got if r["shard"] == k) for k in range(4)]
    biggest = max(len(t.encode()) + 1 for t in text.values())
    assert max(load) <= max(biggest, 1.1 * sum(load) / 4)


@pytest.mark.parametrize("bits,copies,parts", [(10, 1 << 16, 64), (6, 7, 3), (4, 1000, 1)])
def test_shards_of_classes(spark, monkeypatch, bits, copies, parts):
    """Groups are packed by classes of sizes; the law holds for coarse ones too, as groups of a class differ little."""
    for name, value in (("BITS", bits), ("COPIES", copies), ("PARTS", parts), ("PART_ROWS", 500)):
        monkeypatch.setattr(sharding, name, value)
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([5, 30, 80]))) for _ in range(900)]
    rows = [(i if i % 10 else None, rnd.choice(texts) if i % 3 else texts[0], "x") for i in range(4000)] + [(5, None, "x"), (6, "", "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    shard_of, size_of = {}, {}
    for r in got:
        assert shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        size_of[r["text_crc32"]] = r["size"]
    assert {c for c in shard_of} == {zlib.crc32((t or "").encode()) for _, t, _ in rows} and all(size_of[zlib.crc32((t or "").encode())] == len((t or "").encode()) + 1 for _, t, _ in rows)
    load = sorted(sum(r["size"] for r in got if r["shard"] == b) for b in range(16))
    for k in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    hot = sum(len((t or "").encode()) + 1 for _, t, _ in rows if t == texts[0])
    mean = (sum(load) - load[-1]) / 15
    assert load[-1] >= hot and load[0] >= 0.9 * mean and load[-2] <= 1.1 * mean
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(docs.repartition(2)).collect()))


def test_fixed_capacity_opens_few_shards(spark):
    rows = [(k, f"{k:04d}" + "x" * (95 if k % 2 else 45)) for k in range(400)]
    got = sharding.fixed_capacity(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) <= 1000 and len(load) <= -(-sum(load.values()) // 1000) + 1


def test_rooms_stay_in_order():
    rnd = random.Random(3)
    rooms, held = sharding.Rooms(), []
    for step in range(4000):
        if rnd.random() < 0.55 or not held:
            key = (rnd.randint(0, 60), step)
            rooms.add(key)
            held.append(key)
        else:
            size = rnd.randint(0, 65)
            want = min((k for k in held if k[0] >= size), default=None)
            assert rooms.take_tightest(size) == want
            if want:
                held.remove(want)
    height = lambda t: 1 + max(height(t[2]), height(t[3])) if t else 0
    assert height(rooms.root) <= 2 * np.log2(len(held) + 1) + 2


def test_a_hot_group_leaves_no_shard_empty(spark):
    def loads(sizes, shards=16):
        place = sharding.pack([(s, k) for k, s in enumerate(sizes)], shards)
        assert len(place) == len(sizes)
        return sorted(sum(s for k, s in enumerate(sizes) if place[k] == b) for b in range(shards))

    for hot in ([100_000], [24_000], [100_000, 40_000, 14_000]):
        rest = 300_000 - sum(hot)
        load = loads(hot + [20] * (rest // 20))
        assert load[-len(hot):] == sorted(hot)
        mean = rest / (16 - len(hot))
        assert 0.99 * mean <= load[0] and load[-len(hot) - 1] <= 1.01 * mean
    assert loads([40] * 25) == [40] * 7 + [80] * 9  # two in each would leave three shards empty
    assert loads([7, 5, 3]) == [0] * 13 + [3, 5, 7]
    rows = [(k, "the same text" * 4 if k % 3 == 0 else f"text {k:05d} of its own" * 2) for k in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = sorted(sum(r["size"] for r in got if r["shard"] == b) for b in range(16))
    mean = sum(load[:-1]) / 15
    assert load[-1] == 2000 * 53 and 0.9 * mean <= load[0] and load[-2] <= 1.1 * mean


def test_best_fit_takes_the_tightest_bin():
    assert sharding.best_fit([(6, 0), (5, 1), (4, 2), (3, 3), (2, 4)], 10) == [[0, 2], [1, 3, 4]]
    rnd = random.Random(2)
    items = [(rnd.randint(1, 100), k) for k in range(500)]
    place = sharding.pack(items, 16)
    load = [sum(s for s, k in items if place[k] == b) for b in range(16)]
    assert sum(load) == sum(s for s, _ in items) and max(load) - min(load) <= 0.02 * max(load)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 9))
def test_packing_by_counts_is_whole_and_level(sizes, shards):
    place = sharding.pack([(s, k) for k, s in enumerate(sizes)], shards)
    assert sorted(place) == list(range(len(sizes))) and set(place.values()) <= set(range(shards))
    load = [sum(s for k, s in enumerate(sizes) if place[k] == b) for b in range(shards)]
    for k, s in enumerate(sizes):  # no move of one item into the emptiest shard would help
        assert s >= load[place[k]] - min(load)
    one = sharding.best_fit([(s, k) for k, s in enumerate(sizes)], 60)
    rooms, want = [], []
    for s, k in sorted(((s, k) for k, s in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
        fit = min((r for r in rooms if r[0] >= s), default=None)
        if fit is None:
            fit = (60, len(want))
            want.append([])
        else:
            rooms.remove(fit)
        want[fit[1]].append(k)
        rooms.append((fit[0] - s, fit[1]))
    assert [[sizes[k] for k in held] for held in one] == [[sizes[k] for k in held] for held in want]


def encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def odd_texts(n=400):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'ll", "1", "é", "ß", "!", "...", "the", " and", " ", "日本", "\t", "'v", "e", "<|endoftext|>", "\x1c", "²", "\x01", "xy" * 40]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["a" * 3000, " " * 500 + "x", "the" * 900, "\n\n a \n", ""]


def test_tree_of_windows_equals_the_tokenizer(monkeypatch):
    codec, tok = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), encoder()
    rnd = random.Random(7)
    for text in odd_texts():
        monkeypatch.setattr(bpe, "TEXT_LEAF", rnd.choice([1, 2, 3, 9, 2048]))
        monkeypatch.setattr(bpe, "WORD_LEAF", rnd.choice([1, 2, 5, 32]))
        monkeypatch.setattr(bpe, "DECODE_LEAF", rnd.choice([1, 3, 1 << 18]))
        codec.packed.clear()
        codec.packed.old.clear()
        ids = codec.encode(text)
        assert ids.tolist() == tok.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_query_rows(docs):
    tok = encoder()
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == tok.encode_ordinary(text[r["doc_id"]]) and bytes(r["decoded"]) == text[r["doc_id"]].encode()


def test_blocks_round_trip():
    rnd = np.random.default_rng(0)
    for vocabulary, n in ((3, 0), (3, 1), (200, 999), (50_000, 5000), (70_000, 100_003)):
        ids = rnd.integers(0, vocabulary, n).astype(np.uint32)
        counts = [n // 2, 0, n - n // 2]
        back = token_files.unpack(token_files.pack([5, None, -7], counts, ids))
        assert back[0] == [5, None, -7] and back[1].tolist() == counts and np.array_equal(back[2], ids)


def test_token_files_equal_the_library(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    special = ["<|endoftext|>", "a <|endoftext|>", "<|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|><|endoftext|>", "<|endoftext |>", "one\n<|endoftext|>\ntwo"]
    odd = spark.createDataFrame(list(enumerate(odd_texts() + special)), "doc_id long, text string")
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    for table in (odd, docs):
        read, starts = token_files.read_token_files(spark, token_files.write_token_files(table, path, 2))
        got = token_files.with_starts(read, starts).select("doc_id", "start", "n_tokens", "ids").collect()
        rows = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        at, want = 0, []
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got), key=str) == sorted(want, key=str)


def test_quality_is_learned_from_labels(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the", "and", "river", "stone", "walks", "over"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "now$$$", "| x", "###"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(900, None), (901, ""), (None, good()), (902, good() * 500), (5, good())]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(400) if i != 5] + [(7, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    docs = spark.createDataFrame([(i, t, "1") for i, t in rows], "doc_id long, text string, quality string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 40 and sum((r["doc_id"] % 3 > 0) == (r["predicted"] == 1) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_of_empty_tables_and_long_texts(spark, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0
    long = [(1, "good words " * 300_000), (2, "BAD !! " * 100), (3, None), (3, None)]
    got = quality.classify(spark.createDataFrame(long, "doc_id long, text string"), labels).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3] and all(0 <= r["score"] <= 1 for r in got)


def test_long_texts_are_described_whole(monkeypatch):
    import pyarrow as pa

    text = ("word " * 300 + "\n") * 40
    whole = [x for _, x in quality.passages(pa.array([text, None, text]))]
    monkeypatch.setattr(quality, "HELD", 1000)
    parts = [x for _, x in quality.passages(pa.array([text, None, text]))]
    for k in range(3):
        assert np.allclose(np.concatenate([x[k] for x in whole]), np.concatenate([x[k] for x in parts]))


def some_bags(seed=2):
    import pyarrow as pa

    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(["a", "Bc", "d!", "ef,", "77", "é|", "\n"]) for _ in range(n)) for n in (0, 1, 40, 400, 700)] + [None]
    (_, bags), = quality.passages(pa.array(texts))
    model = quality.fresh()
    rng = np.random.default_rng(seed)
    return texts, bags, {k: v + 0.3 * rng.standard_normal(v.shape) for k, v in model.items()}


def test_attention_equals_brute_force():
    """Passage by passage in plain Python, with features counted anew."""
    texts, bags, p = some_bags()
    kinds = {b: k for k, c in enumerate(quality.CLASSES) for b in c}
    want = []
    row = 0
    for text in texts:
        data = (text or "").encode()
        encoded, logits = [], []
        for a in range(0, max(1, len(data)), quality.PASSAGE):
            pairs = [(kinds[data[i - 1]] if i else kinds[10], kinds[data[i]]) for i in range(a, min(len(data), a + quality.PASSAGE))]
            x = np.zeros(quality.FEATURES)
            for u, v in pairs:
                x[u * len(quality.CLASSES) + v] += 1 / len(pairs)
            starts = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
            inside = [i for i, m in enumerate(starts) if a <= m.start() < a + quality.PASSAGE]
            for d in (1, 2):
                x[quality.PAIRS + d - 1] = sum(i >= d and starts[i].group().translate(LOWER_BYTES) == starts[i - d].group().translate(LOWER_BYTES) for i in inside) / max(1, len(inside))
            assert np.allclose(np.sqrt(x), bags.x[row], atol=1e-6) and bags.count[row] == len(inside)
            place = int(bags.count[:row].sum())
            words = [p["E"][bags.bucket[place + j]] for j in range(len(inside))]
            h = np.tanh(np.sqrt(x) @ p["W"] + (sum(words) / len(words) if words else 0) + p["b"])
            encoded.append(h)
            logits.append(sum(p["w"][k] * np.tanh(h @ p["V"][:, k]) / (1 + np.exp(-(h @ p["U"][:, k]))) for k in range(quality.ATTENDED)))
            row += 1
        weights = np.exp(logits) / np.exp(logits).sum()
        want.append(1 / (1 + np.exp(-((weights[:, None] * np.array(encoded)).sum(axis=0) @ p["c"] + p["c0"][0]))))
    assert np.allclose(quality.forward(p, bags)["score"], want, atol=1e-5)
    same = {}
    for m, k in zip((m for t in texts for m in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())), bags.bucket.tolist()):
        assert same.setdefault(m.translate(LOWER_BYTES), k) == k  # a word has one place in the table


def test_gradients_equal_differences():
    _, bags, p = some_bags()
    bags = bags._replace(x=bags.x.astype(np.float64))
    y = np.array([1, 0, 1, 1, 0, 0.0])

    def loss():
        s = quality.forward(p, bags)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    rnd = random.Random(1)
    for k, grad in quality.gradients(p, bags, y).items():
        flat, found = p[k].reshape(-1), grad.reshape(-1)
        for i in {rnd.randrange(len(flat)) for _ in range(12)} | ({int(bags.bucket[0]) * quality.ENCODED} if k == "E" else set()):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            slope, flat[i] = (up - loss()) / 2e-5, old
            assert abs(slope - found[i]) <= 1e-6 + 1e-4 * abs(slope), k


def pipeline_tables(spark, path, rows, labels):
    spark.createDataFrame([(r[0], r[1], "en", r[2], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    junk = [(2000 + k, "BUY!! now$$$ ### " * (20 + k), f"s{k % 4}") for k in range(12)]
    rows = [r[:3] for r in corpus()] + junk
    labels = [(r[0], int(r[0] < 2000), 0) for r in rows if r[0] is not None and r[0] % 3 != 2] + [(1, None, 0), (None, 1, 0)]
    pipeline_tables(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
    predicted = {(r["doc_id"], r["n"]) for r in quality.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
                 .where("predicted = 1").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    good = {i for i, _ in predicted}
    kept = [r for r in rows if r[0] in good]
    label = components([(i, t) for i, t, _ in kept])
    single = {r[0]: r for r in kept if r[0] is not None and label[r[0]] == r[0]}
    loose = [r for r in kept if r[0] is None]
    size = lambda r: len(WORD.findall(r[1] or ""))
    left = [*single.values(), *loose]
    order = sorted({r[2] for r in left if r[2] is not None}) + [None] * any(r[2] is None for r in left)
    goal = dict(zip(order, water_level([sum(size(r) for r in left if r[2] == s) for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))], 3)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok, taken, seen = encoder(), {}, {}
    for r in got:
        own = single[r["doc_id"]] if r["doc_id"] is not None else loose[0]
        assert r["ids"] == tok.encode_ordinary(own[1] or "") and r["n_tokens"] == len(r["ids"]) and r["exact"]
        assert r["decoded_sha256"] == hashlib.sha256((own[1] or "").encode()).hexdigest()
        taken[own[2]] = taken.get(own[2], 0) + size(own)
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert max(seen.values()) <= 3 and all(seen.get(i) == 1 for i, r in single.items() if not size(r))
    assert not any(i is not None and i >= 2000 for i in seen)
    for s in order:
        longest = max((size(r) for r in left if r[2] == s), default=0)
        assert abs(taken.get(s, 0) - goal[s]) <= max(longest, 0.1 * goal[s])
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_pipeline_of_empty_and_null_tables(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, tmp_path / "empty", [], [(1, 1, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    pipeline_tables(spark, tmp_path / "null", [(None, None, None), (None, "a b", None), (1, None, "s"), (1, None, "s"), (2, "", None)], [(None, None, None)])
    got = corpus_pipeline.run(spark, str(tmp_path / "null")).collect()
    assert {r["doc_id"] for r in got} == {None, 1, 2} and all(r["exact"] for r in got)


def test_ranks_are_read_as_stated():
    line = open(RANKS, "rb").readline().split()
    assert bpe.read_ranks(RANKS)[base64.b64decode(line[0])] == int(line[1])
