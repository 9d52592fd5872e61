"""Quality classifier: gated-attention multiple-instance learning over the passages of a text."""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discard, documents_of, materialize, ship_package

#: Bytes of a passage.
PASSAGE = 512
#: Classes of bytes. A passage is described by its shares of neighbouring classes, and by its hashed words.
CLASSES = [b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"-()", b"|", b"#$%&*", b"<>[]{}/\\=+_@~^`", bytes(range(128, 256))]
PAIRS = len(CLASSES) ** 2
#: Besides: the shares of words that equal the last word, and the last but one.
FEATURES = PAIRS + 2
#: Rows of the table of word vectors; a word's is the one at its hash.
BUCKETS = 4096
#: Labelled rows that the model is fitted on at most (see ``learn``), and rows of a part that learns apart in a round.
FIT_ROWS = 8192
PART_ROWS = 2048
ENCODED, ATTENDED, ROUNDS, BATCH, RATE, DECAY = 16, 8, 20, 16, 0.02, 1e-4
#: Passages of a mini-batch at most (a longer text alone).
BATCH_PASSAGES = 4096
#: Text bytes that a task describes at a time (a longer text alone, in parts), and passages whose words are summed at a time.
HELD = shingles.PIECE
SUMMED = 2048

_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _k
_LINE = CLASSES.index(b"\n")


class Bags(NamedTuple):
    """Passages of texts: features of each, hashed words of all in their order, words of each, first passage of each text."""

    x: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    first: np.ndarray


def passages(texts: pa.Array):
    """For runs of texts: (index of the first, their ``Bags``). Every text has one passage at least; that of a null or empty
    text is all zeros."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + HELD, "right")) - 1))
        size = np.diff(offsets[at:to + 1])
        each = np.maximum(1, -(-size // PASSAGE))
        first = np.cumsum(each) - each
        made = np.zeros((int(each.sum()), PAIRS), np.float32)
        for a in range(int(offsets[at]), int(offsets[to]), HELD):
            b = min(a + HELD, int(offsets[to]))
            place = np.arange(a, b)
            doc = np.searchsorted(offsets[at:to + 1], place, "right") - 1
            inside = place - offsets[at:to][doc]
            kind = _CLASS[data[a:b]]
            before = np.empty_like(kind)
            before[1:], before[:1] = kind[:-1], _CLASS[data[a - 1]] if a else _LINE
            before[inside == 0] = _LINE
            row = first[doc] + inside // PASSAGE
            low = int(row[0])
            counted = np.bincount((row - low) * PAIRS + before * len(CLASSES) + kind, minlength=(int(row[-1]) - low + 1) * PAIRS)
            made[low:int(row[-1]) + 1] += counted.reshape(-1, PAIRS)
        made /= np.maximum(1, made.sum(axis=1, keepdims=True))
        found, owner, begin = shingles.run_words(data, offsets, at, to)
        row = first[owner] + (begin - offsets[at:to][owner]) // PASSAGE
        count = np.bincount(row, minlength=len(made))
        again = [np.bincount(row[d:][(found[d:] == found[:-d]) & (owner[d:] == owner[:-d])], minlength=len(made)) / np.maximum(1, count) for d in (1, 2)]
        bucket = (found >> np.uint64(40)) % np.uint64(BUCKETS)
        yield at, Bags(np.sqrt(np.column_stack([made, *again]).astype(np.float32)), bucket.astype(np.uint16), count, first)
        at = to


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_means(table: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean of the vectors of each passage's words; zeros for one without words."""
    out = np.zeros((len(count), table.shape[1]))
    full = np.flatnonzero(count)
    start = np.cumsum(count) - count
    for s in range(0, len(full), SUMMED):
        own = full[s:s + SUMMED]
        a, b = start[own[0]], start[own[-1]] + count[own[-1]]
        out[own] = np.add.reduceat(table[bucket[a:b]], start[own] - a, axis=0) / count[own][:, None]
    return out


def forward(p: dict, bags: Bags) -> dict:
    """Encoding h of each passage, gates t and g, attention a within its text, and the text's score."""
    first = bags.first
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bags.x))))
    h = np.tanh(bags.x @ p["W"] + word_means(p["E"], bags.bucket, bags.count) + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a /= np.add.reduceat(a, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner, "score": _sigmoid(z @ p["c"] + p["c0"])}


def gradients(p: dict, bags: Bags, y: np.ndarray) -> dict:
    """Of the mean cross-entropy of the texts' labels."""
    f, first = forward(p, bags), bags.first
    error = (f["score"] - y) / len(first)
    dz = error[:, None] * p["c"]
    da = (dz[f["owner"]] * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["owner"]])
    dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[f["owner"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    each = np.repeat(dh / np.maximum(1, bags.count)[:, None], bags.count, axis=0)
    words = np.stack([np.bincount(bags.bucket, weights=each[:, k], minlength=BUCKETS) for k in range(ENCODED)], axis=1)
    return {"E": words, "W": bags.x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "c0": error.sum(keepdims=True)}


def fresh(seed: int = 5) -> dict:
    """A model to start from. Words count for nothing until they are learned."""
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    return {"E": np.zeros((BUCKETS, ENCODED)), "W": small(FEATURES, ENCODED), "b": np.zeros(ENCODED), "V": small(ENCODED, ATTENDED), "U": small(ENCODED, ATTENDED), "w": small(ATTENDED),
            "c": small(ENCODED), "c0": np.zeros(1)}


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.step = {k: q.copy() for k, q in p.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))

    def learn(self, bags: Bags, y: np.ndarray) -> None:
        grad = gradients(self.p, bags, y)
        self.step += 1
        for k, q in self.p.items():
            d = grad[k] + DECAY * q
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            q -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _describe(batches):
    for batch in batches:
        for at, bags in passages(batch.column("text")):
            n = len(bags.first)
            last = np.append(bags.first, len(bags.x))[1:]
            words = np.concatenate([[0], np.cumsum(bags.count)])
            own = lambda v, ends: pa.array([v[a:b].tobytes() for a, b in ends], pa.binary())
            ends = list(zip(bags.first.tolist(), last.tolist()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(at, n) for c in ("part", "turn", "doc_id", "y")), own(bags.x, ends), own(bags.count.astype("<u4"), ends),
                 own(bags.bucket, [(words[a], words[b]) for a, b in ends])], names=["part", "turn", "doc_id", "y", "x", "count", "bucket"])


def _bags(rows: list) -> tuple[Bags, np.ndarray]:
    """Described texts (y, x, count, bucket) as one."""
    x = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.cumsum([0] + [len(v) for v in x])[:-1]
    joined = [np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((2, "<u4"), (3, np.uint16))]
    return Bags(np.concatenate(x).astype(np.float64), joined[1], joined[0].astype(np.int64), first), np.array([r[0] for r in rows])


def _saved(p: dict) -> bytes:
    held = io.BytesIO()
    np.savez(held, **p)
    return held.getvalue()


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """The model of ``labels`` (doc_id, quality 0/1) over ``docs``; None if no row outside the held-out ones is labelled.

    Fitted on at most ``rows`` labelled rows, those of smallest hashed doc_id, whose texts may have any length; null labels
    are left out, and of several labels of a doc_id the smallest counts. The described texts are stored in parts of about
    PART_ROWS. In each round every part starts from the common model and goes once through its texts in mini-batches, by Adam; the
    models' mean is the next common one. So a task holds a mini-batch, and the driver a few models, whatever the texts."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    marks = marks.withColumn("turn", F.xxhash64(F.lit(11), "doc_id")).orderBy("turn", "doc_id").limit(rows)
    parts = max(1, -(-marks.count() // PART_ROWS))
    marks = marks.withColumn("part", F.pmod("turn", F.lit(parts)).cast("int"))
    found = documents_of(docs).join(F.broadcast(marks), "doc_id").select("part", "turn", "doc_id", "y", "text")
    told = found.mapInArrow(_describe, "part int, turn long, doc_id long, y double, x binary, count binary, bucket binary")
    loose = materialize(told)  # so that texts are described once, though the ranges are sampled
    told = materialize(loose.repartitionByRange(parts, "part").sortWithinPartitions("part", "turn", "doc_id", "x"))
    discard(loose)

    def trained(model: dict, rate: float):
        def run(batches):
            part, adam, seen, held, size = None, None, 0, [], 0

            def passed():
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([_saved(adam.p)], pa.binary())], names=["part", "n", "model"])

            for batch in batches:
                for own, *row in zip(*(batch.column(c) for c in ("part", "y", "x", "count", "bucket"))):
                    own, row = own.as_py(), [v.as_py() for v in row]
                    n = len(row[1]) // (4 * FEATURES)
                    if held and (own != part or len(held) == BATCH or size + n > BATCH_PASSAGES):
                        adam.learn(*_bags(held))
                        held, size = [], 0
                    if own != part:
                        if adam is not None:
                            yield passed()
                        part, adam, seen = own, Adam(model, rate), 0
                    held.append(row)
                    size, seen = size + n, seen + 1
            if held:
                adam.learn(*_bags(held))
                yield passed()

        return run

    model = fresh()
    for k in range(ROUNDS):
        rate = RATE * (1 - k / ROUNDS)
        heard = sorted(told.select("part", "y", "x", "count", "bucket").mapInArrow(trained(model, rate), "part int, n long, model binary").collect(), key=lambda r: (r["part"], r["n"], bytes(r["model"])))
        if not heard:
            discard(told)
            return None
        total = sum(r["n"] for r in heard)
        models = [(r["n"] / total, np.load(io.BytesIO(r["model"]))) for r in heard]
        model = {name: sum(w * m[name] for w, m in models) for name in model}
    discard(told)
    return model


def score_of(model: dict | None, bags: Bags) -> np.ndarray:
    """Rounded, so that the order of sums does not show. Without a model every score is 0.5."""
    return np.round(forward(model, bags)["score"], 9) if model else np.full(len(bags.first), 0.5)


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score, 0 to 1, for every row of ``docs``: the whole text's passages by attention."""
    def run(batches):
        for batch in batches:
            for at, bags in passages(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(bags.first)), pa.array(score_of(model, bags))], names=["doc_id", "score"])

    return documents_of(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); see ``learn`` for the fit.

    The score looks at the text alone. Null and empty texts are one blank passage and get a score like any other; texts
    of any length are read whole; repeated rows stay; a null doc_id is not held out; extra columns are left out; an
    empty table gives an empty one. predicted is 1 from ``threshold`` on."""
    ship_package(docs.sparkSession)
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all their columns, that the classifier does not reject. Input is handled as by ``classify``: null
    and empty texts are scored as one blank passage, texts of any length whole; rows with equal texts stay or go together;
    without labels every score is 0.5 and all rows stay; an empty table gives an empty one."""
    ship_package(docs.sparkSession)
    model = learn(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first_row, bags in passages(batch.column(at)):
                kept = batch.slice(first_row, len(bags.first)).filter(pa.array(score_of(model, bags) >= threshold))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)
