"""Ranked lexical search over hashed max-sketches.

Index: a table with a row for each document: its distinct terms and their counts, and a sketch, in which every term is
hashed to a slot and a slot keeps the greatest count of its terms. Contributions rise with the count, so a slot bounds
the contribution of every term in it, whatever the statistics of the collection are: the index serves every batch of queries.

Search: a block of queries looks all its terms up in the sketches, which gives an upper bound of each document's score.
Documents are then scored exactly from their terms in the order of falling bounds, until the next bound is below a query's
kth score. A sample of the documents is searched first; its kth scores are floors for all tasks.
"""

from __future__ import annotations

import math
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import terms
from .common import documents_of, materialize, shared_dir, ship_package

#: Slots of a sketch for each distinct term, and the least and greatest sketch. A greater text only has looser bounds.
SPREAD, LEAST_SLOTS, MOST_SLOTS = 8, 64, 1 << 20
#: A slot's value from which the count is not known; it stands for as many as the document has terms.
FULL = 255
#: Pairs of query and term in a block of queries, cells (documents times pairs) that are worked on at a time, documents
#: that a query scores between two looks at its bounds, and rows of the sample.
BLOCK_PAIRS, CELLS, TURN, PILOT_ROWS = 16_384, 1 << 21, 64, 4096
#: Parts in which a query's answers meet before the last ranking.
SALTS = 64

INDEX = "doc_id long, n long, slots int, sketch binary, terms string, counts binary, pilot boolean"


class Block(NamedTuple):
    """Some queries: their distinct terms and slots' hashes, and for each pair of query and term, in the order of the
    queries, the term's place and weight. ``first``: the first pair of each query; a query has one at least."""

    ids: list
    terms: pa.Array
    hashes: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bytes of consecutive ranges of ``values``."""
    offsets = (bounds * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _index(batches):
    schema = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary()]
    for batch in batches:
        for at, found in terms.counted(batch.column("text")):
            n = len(found.total)
            distinct = np.bincount(found.text, minlength=n)
            slots = np.clip(2 ** np.ceil(np.log2(np.maximum(1, SPREAD * distinct))), LEAST_SLOTS, MOST_SLOTS).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(slots)])
            hashes = np.fromiter((zlib.crc32(v) for v in found.values.to_pylist()), np.int64, len(found.values))
            sketch = np.zeros(int(start[-1]), np.uint8)
            np.maximum.at(sketch, start[found.text] + (hashes[found.code] & (slots[found.text] - 1)), np.minimum(found.count, FULL).astype(np.uint8))
            bounds = np.concatenate([[0], np.cumsum(distinct)])
            said = terms.as_strings(found.values).take(pa.array(found.code))
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), said)
            columns = [batch.column("doc_id").slice(at, n), pa.array(found.total), pa.array(slots), _packed(sketch, start), pc.binary_join(listed, pa.scalar(" ", pa.large_string())), _packed(found.count.astype("<u4"), bounds)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema)], names=["doc_id", "n", "slots", "sketch", "terms", "counts"])


def write_index(docs: DataFrame) -> str:
    """Folder of the index of ``docs`` (doc_id, text), a Parquet table in the shared folder. Null texts and texts without
    terms are rows that nothing finds; repeated rows are rows of their own; null ids stay; extra columns are left out."""
    spark = docs.sparkSession
    ship_package(spark)
    path = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    rows = documents_of(docs).mapInArrow(_index, INDEX.rsplit(",", 1)[0])
    share = max(1, docs.count() // PILOT_ROWS)
    rows = rows.withColumn("pilot", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(share)) == 0 if share > 1 else F.lit(False))
    rows.write.partitionBy("pilot").option("compression", "zstd").parquet(path)
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def statistics(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all, repeats counted."""
    return tuple(v or 0 for v in index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())


def _document_counts(index: DataFrame, sought: pa.Array) -> np.ndarray:
    """Documents that hold each of the terms."""
    def run(batches):
        total = np.zeros(len(sought), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held = pc.split_pattern(batch.column("terms").slice(at, 4096), " ")
                place = pc.index_in(held.flatten(), value_set=sought)
                total += np.bincount(place.drop_null().to_numpy(zero_copy_only=False), minlength=len(sought))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(len(sought), np.int64)
    for r in index.select("terms").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # one row for each term of the block
        out[r["place"]] = r["n"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(index: DataFrame, asked: list, n_docs: int) -> Block:
    """``asked``: rows (item, terms), each with one term at least."""
    sought = pa.array(sorted({t for r in asked for t in r["terms"]}), pa.string())
    place_of = {t: i for i, t in enumerate(sought.to_pylist())}
    weights = np.array([weight(n_docs, int(df)) for df in _document_counts(index, sought)], np.int64)
    place = np.array([place_of[t] for r in asked for t in r["terms"]], np.int64)
    first = np.cumsum([0] + [len(r["terms"]) for r in asked])[:-1]
    hashes = np.array([zlib.crc32(t.encode()) for t in sought.to_pylist()], np.int64)
    return Block([r["item_id"] for r in asked], sought, hashes, place, weights[place], first)


def _contribution(count, norm):
    return 1_000_000_000 * count // (1000 * count + 20 * norm)


class _Best:
    """The k best documents of each query so far: score, then smaller id; null ids last. ``floor`` is a score that the kth
    best of all documents reaches."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.score, self.doc = [np.zeros(0, np.int64)] * len(floor), [np.zeros(0, np.int64)] * len(floor)
        self.least = np.maximum(1, floor)

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[q]
        if not good.any():
            return
        score, doc = np.concatenate([self.score[q], score[good]]), np.concatenate([self.doc[q], doc[good]])
        order = np.lexsort((doc, -score))[:self.k]
        self.score[q], self.doc[q] = score[order], doc[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], self.score[q][-1])


#: Stands for a null id in rankings.
_NONE = np.iinfo(np.int64).max


def _scores(block: Block, imp: np.ndarray) -> np.ndarray:
    """Sums over the queries' terms of weight times ``imp`` (documents x terms)."""
    return np.add.reduceat(imp[:, block.place] * block.weight, block.first, axis=1)


def _exact(block: Block, rows: pa.RecordBatch, norm: np.ndarray) -> np.ndarray:
    held = pc.split_pattern(rows.column("terms"), " ")
    sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(rows.num_rows), sizes)
    place = pc.index_in(held.flatten(), value_set=block.terms)
    hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
    count = np.zeros((rows.num_rows, len(block.terms)), np.int64)
    count[owner[hit], place.drop_null().to_numpy(zero_copy_only=False)] = counts[hit]
    return _scores(block, _contribution(count, norm[:, None]))


def _bounds(block: Block, slots: np.ndarray, sketches: list, n: np.ndarray, norm: np.ndarray) -> np.ndarray:
    table = np.repeat(np.arange(FULL + 1)[None, :], len(n), axis=0)
    table[:, FULL] = np.maximum(FULL, n)
    table = _contribution(table, norm[:, None])
    imp = np.empty((len(n), len(block.terms)), np.int64)
    for size in np.unique(slots):
        own = np.flatnonzero(slots == size)
        sketch = np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(len(own), size)
        imp[own] = table[own[:, None], sketch[:, block.hashes & (size - 1)]]
    return _scores(block, imp)


def _found(index: DataFrame, block: Block, k: int, n_docs: int, n_terms: int, floor: np.ndarray) -> DataFrame:
    """Of each task the k best documents of each query that reach the floor: (query, doc_id, score)."""
    step = max(1, CELLS // max(1, len(block.place)))

    def run(batches):
        best = _Best(floor, k)
        for batch in batches:
            batch = batch.filter(pc.greater(batch.column("n"), 0))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                n = rows.column("n").to_numpy(zero_copy_only=False)
                norm = 50 + 50 * n * n_docs // n_terms
                doc = rows.column("doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False)
                bound = _bounds(block, rows.column("slots").to_numpy(zero_copy_only=False), rows.column("sketch").to_pylist(), n, norm)
                while True:  # each round scores the documents of highest bound of every query that may still gain
                    open_ = bound >= best.least
                    if not open_.any():
                        break
                    rank = np.argsort(np.where(open_, -bound, 1), axis=0, kind="stable")[:TURN]
                    turn = np.unique(rank[np.take_along_axis(open_, rank, axis=0)])
                    score = _exact(block, rows.take(pa.array(turn)), norm[turn])
                    for q in np.flatnonzero((score >= best.least).any(axis=0)):
                        best.add(q, score[:, q], doc[turn])
                    bound[turn] = -1  # scored for all queries
        query = np.repeat(np.arange(len(block.ids), dtype=np.int32), [len(s) for s in best.score])
        if len(query):
            ids = np.concatenate(best.doc)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=ids == _NONE), pa.array(np.concatenate(best.score))], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Answers meet in parts first, so that no task sees those of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("salt")


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item of ``items`` (item_id, text).

    Queries go in blocks of about BLOCK_PAIRS terms, whatever their number; the driver holds a block, and a task a block, k
    answers for each of its queries and a few documents. Items with null text or without terms have no answers; items of
    one id are one query with the terms of all; a null id is an id like another. Equal scores rank by doc_id, null ids last."""
    if not 1 <= k <= 1000:
        raise ValueError("k must lie between 1 and 1000")
    spark = index.sparkSession
    ship_package(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    split = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    asked = items.select("item_id", F.explode(split).alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    asked = materialize(asked)
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_PAIRS)
    n_docs, n_terms = statistics(index)
    out = None
    for b in range(blocks if n_terms else 0):
        rows = asked.where(F.pmod(F.xxhash64(F.lit(5), "item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        if not rows:
            continue
        block = _block(index, rows, n_docs)
        pilot = _ranked(_found(index.where("pilot"), block, k, n_docs, n_terms, np.zeros(len(rows), np.int64)), k)
        floor = np.zeros(len(rows), np.int64)
        for r in pilot.where(F.col("rank") == k).select("query", "score").collect():
            floor[r["query"]] = r["score"]
        found = materialize(_ranked(_found(index, block, k, n_docs, n_terms, floor), k))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {kind}")
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a block's queries
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
