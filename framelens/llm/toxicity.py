"""Toxicity: classifiers learned from confirmed toxic and unlabelled texts (non-negative positive-unlabelled learning)."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from .common import discard, documents_of, materialize, ship_package
from .quality import held_out

#: Rows that the classifiers are fitted on at most: confirmed toxic, and unlabelled ones; rows of one classifier, about.
FIT_TOXIC, FIT_UNLABELLED, PART_ROWS = 4096, 12_288, 8192
#: Terms that have a weight at most; a term has one if it stands in so many toxic texts of the fit at least, and if so
#: great a share of the unlabelled texts that hold it are toxic, as the class prior lets estimate.
VOCABULARY, LEAST_TEXTS, LEAST_SHARE = 16_384, 4, 0.45
EPOCHS, BATCH, RATE = 60, 512, 0.1
#: Where the risk of the negative class may be below 0 by no more than this, and how far a step then goes back.
SLACK, BACK = 0.0, 1.0


class Model(NamedTuple):
    """Sorted hashes of the weighted terms, and of each classifier their weights and then its bias."""

    hashes: np.ndarray
    weights: np.ndarray


def hashed(values: pa.Array) -> np.ndarray:
    """64 bits of each term."""
    both = ((zlib.crc32(v), zlib.adler32(v) ^ (zlib.crc32(v, 0x5BD1E995) << 7)) for v in values.to_pylist())
    return np.fromiter((a << 32 | b & 0xFFFFFFFF for a, b in both), np.uint64, len(values))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows(NamedTuple):
    """Terms of texts by their numbers: numbers of all, and first of each text and the end."""

    term: np.ndarray
    bounds: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.bounds)[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return Rows(self.term[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[at], size)], bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def logits(w: np.ndarray, rows: Rows) -> np.ndarray:
    """Bias and the weights of a text's distinct terms."""
    return w[-1] + np.bincount(rows.owner, weights=w[rows.term], minlength=len(rows.bounds) - 1)


def risks(w: np.ndarray, toxic: Rows, unlabelled: Rows, prior: float) -> tuple[float, float]:
    """Under the loss 1 / (1 + e^margin): the toxic class's share of the risk, and the other class's, which is the unlabelled
    texts' less that of the toxic ones among them and can be negative on a sample only."""
    p, u = _sigmoid(logits(w, toxic)), _sigmoid(logits(w, unlabelled))
    return prior * float((1 - p).mean()), float(u.mean()) - prior * float(p.mean())


def step_of(w: np.ndarray, toxic: Rows, unlabelled: Rows, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk. Where the other class's risk has fallen below 0, which only overfitting does, the
    step raises it again and leaves the toxic class alone."""
    p, u = _sigmoid(logits(w, toxic)), _sigmoid(logits(w, unlabelled))
    dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)
    if u.mean() - prior * p.mean() < -SLACK:
        dp, du = BACK * prior * dp, -BACK * du
    else:
        dp = -2 * prior * dp
    out = np.zeros(len(w))
    for d, rows in ((dp, toxic), (du, unlabelled)):
        out += np.bincount(rows.term, weights=d[rows.owner], minlength=len(w))
        out[-1] += d.sum()
    return out


def fit(toxic: Rows, unlabelled: Rows, size: int, prior: float, seed: int) -> np.ndarray:
    """Weights of ``size`` terms and the bias, by Adam on mini-batches with an equal share of both kinds. A term was chosen
    because it speaks for toxicity, so no weight is below 0 and none can excuse another."""
    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
    w[-1] = -1.0
    n, k = len(unlabelled.bounds) - 1, len(toxic.bounds) - 1
    turns = max(1, -(-n // BATCH))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        mixed, own = rng.permutation(n), rng.permutation(k)
        for i in range(turns):
            a = own[(np.arange(max(1, k // turns)) + i * max(1, k // turns)) % k]
            grad = step_of(w, toxic.take(a), unlabelled.take(mixed[i::turns]), prior)
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w[:-1] = np.maximum(0, w[:-1])
    return w


def _described(batches):
    """Hashes of each text's distinct terms."""
    for batch in batches:
        for at, found in terms.counted(batch.column("text")):
            n = len(found.total)
            words = hashed(found.values)[found.code]
            cut = np.searchsorted(found.text, np.arange(n + 1)).tolist()
            own = pa.array([words[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, n) for c in ("part", "toxic", "turn")), own], names=["part", "toxic", "turn", "words"])


def _in_texts(batches):
    """Toxic and unlabelled texts that hold each term, of a batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        words = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
        every = np.concatenate([*words, np.zeros(0, np.uint64)])
        mark = np.repeat(np.array(toxic, np.int64), [len(w) for w in words])
        found, at = np.unique(every, return_inverse=True)
        counts = [np.bincount(at[mark == k], minlength=len(found)) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, counts)], names=["word", "toxic", "unlabelled"])


def _rows(words: list, hashes: np.ndarray) -> Rows:
    """Texts' hashes as numbers of the weighted terms."""
    size = [len(w) for w in words]
    every, owner = np.concatenate([*words, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(words)), size)
    at = np.minimum(np.searchsorted(hashes, every), max(0, len(hashes) - 1))
    hit = hashes[at] == every if len(hashes) else np.zeros(len(every), bool)
    return Rows(at[hit], np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=len(words)))]))


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None, toxic_rows: int = FIT_TOXIC, unlabelled_rows: int = FIT_UNLABELLED) -> Model | None:
    """Classifiers of ``labels`` (doc_id, toxic 0/1) over ``docs``; None if no confirmed toxic text is outside the held-out ones.

    Learned from at most ``toxic_rows`` confirmed toxic documents and ``unlabelled_rows`` documents taken as unlabelled, those
    of smallest hashed doc_id, held-out ones aside; whole texts of any length. Labels of 0 teach nothing but the class prior,
    which is their share of toxic ones unless ``prior`` is given; null labels are left out, and of several labels of a doc_id
    the smallest counts. Each part of about PART_ROWS texts trains a classifier in a task of its own, from the texts' weighted
    terms alone, so a task holds PART_ROWS times VOCABULARY numbers at most; scores use the mean of their weights."""
    ship_package(docs.sparkSession)
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"))
    said = marks.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    if not said[0]:
        return None
    prior = prior or min(0.95, said[0] / said[1])
    rows = documents_of(docs)
    turn = F.xxhash64(F.lit(13), "doc_id")
    chosen = lambda df, n, mark: df.select("doc_id", turn.alias("turn"), F.lit(mark).alias("toxic")).orderBy("turn", "doc_id").limit(n)
    plain = rows.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id")
    taken = chosen(marks.where("toxic = 1"), toxic_rows, 1).unionByName(chosen(plain, unlabelled_rows, 0).distinct())
    parts = max(1, -(-taken.count() // PART_ROWS))
    taken = taken.withColumn("part", F.pmod(F.xxhash64(F.lit(17), "turn"), F.lit(parts)).cast("int"))
    told = materialize(rows.join(F.broadcast(taken), "doc_id").mapInArrow(_described, "part int, toxic int, turn long, words binary"))
    n_toxic, n_plain = told.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n_toxic or not n_plain:
        discard(told)
        return None
    counts = told.mapInArrow(_in_texts, "word long, toxic long, unlabelled long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("unlabelled").alias("unlabelled"))
    kept = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") / n_toxic * prior >= LEAST_SHARE * F.col("unlabelled") / n_plain))
    words = kept.orderBy(F.desc("toxic"), "word").limit(VOCABULARY).select("word").collect()
    hashes = np.sort(np.array([r["word"] for r in words], np.int64).view(np.uint64))

    def numbered(batches):
        for batch in batches:
            found = _rows([np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()], hashes)
            ids = [found.term[a:b].astype("<u2").tobytes() for a, b in zip(found.bounds.tolist(), found.bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "toxic", "turn")), pa.array(ids, pa.binary())], names=["part", "toxic", "turn", "ids"])

    def trained(group: pa.Table) -> pa.Table:
        group = group.sort_by([("turn", "ascending"), ("toxic", "ascending"), ("ids", "ascending")])
        part, toxic = group["part"][0].as_py(), group["toxic"].to_numpy()
        ids = [np.frombuffer(v, "<u2").astype(np.int64) for v in group["ids"].to_pylist()]
        of = lambda mark: (lambda own: Rows(np.concatenate([*own, np.zeros(0, np.int64)]), np.cumsum([0] + [len(v) for v in own])))([ids[i] for i in np.flatnonzero(toxic == mark)])
        if toxic.all() or not toxic.any():  # a part that lacks one kind has nothing to tell
            return pa.table({"n": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "weights": pa.array([], pa.binary())})
        w = fit(of(1), of(0), len(hashes), prior, 1 + part)
        return pa.table({"n": pa.array([len(ids)], pa.int64()), "part": pa.array([part], pa.int32()), "weights": pa.array([w.tobytes()], pa.binary())})

    found = told.mapInArrow(numbered, "part int, toxic int, turn long, ids binary").groupBy("part").applyInArrow(trained, "n long, part int, weights binary").collect()  # one row for each part
    discard(told)
    if not found:
        return None
    return Model(hashes, np.stack([np.frombuffer(r["weights"], np.float64) for r in sorted(found, key=lambda r: r["part"])]))


def score_of(model: Model | None, found: terms.Terms) -> np.ndarray:
    """Of each text, 0 to 1; without a model every score is 0."""
    n = len(found.total)
    if model is None:
        return np.zeros(n)
    w = model.weights.mean(axis=0)
    words = hashed(found.values)
    at = np.minimum(np.searchsorted(model.hashes, words), max(0, len(model.hashes) - 1))
    each = np.where(model.hashes[at] == words, w[at], 0.0) if len(model.hashes) else np.zeros(len(words))
    return np.round(_sigmoid(w[-1] + np.bincount(found.text, weights=each[found.code], minlength=n)), 9)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); see ``learn`` for the fit.

    The score looks at the whole text alone: each distinct term counts once, wherever it stands, so equal texts have equal
    scores. Null and empty texts have no terms and get the bias' score; repeated rows stay; a null doc_id is not held out;
    extra columns are left out; an empty table gives an empty one. predicted is 1 from ``threshold`` on."""
    ship_package(docs.sparkSession)
    model = learn(docs, labels, prior)

    def run(batches):
        for batch in batches:
            for at, found in terms.counted(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(found.total)), pa.array(score_of(model, found))], names=["doc_id", "score"])

    out = documents_of(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
