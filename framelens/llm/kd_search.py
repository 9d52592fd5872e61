"""Exact top-k inner products with a KD-tree for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_groups import whole_groups
from .common import materialize, ship_package

#: Candidates in a tree, vectors in a leaf, trees that one task searches in turn, queries in a block.
SHARD_ROWS = 4096
LEAF_ROWS = 128
SHARDS_IN_TURN = 4
QUERY_ROWS = 1024

sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"


def tree(x: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Rows of each leaf, children of each node (a leaf: (-1, leaf)), and the tight box of each node. Nodes split at the
    median of their widest dimension, parents first."""
    nodes, leaves, children, low, high = [np.arange(len(x))], [], [], [], []
    for rows in nodes:  # grows meanwhile
        own = x[rows]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        if len(rows) <= LEAF_ROWS:
            children.append((-1, len(leaves)))
            leaves.append(rows)
        else:
            order = np.argpartition(own[:, np.argmax(high[-1] - low[-1])], len(rows) // 2)
            children.append((len(nodes), len(nodes) + 1))
            nodes += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return leaves, children, np.stack(low), np.stack(high)


class Best:
    """The k highest (score, smaller place first) of each query so far; ``floor`` is a score that its kth one reaches."""

    def __init__(self, floor: np.ndarray, k: int):
        n = len(floor)
        self.k, self.floor, self.score, self.place = k, floor, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, rows: np.ndarray, score: np.ndarray, places: np.ndarray) -> None:
        better = (score >= self.kth[rows][:, None]).any(axis=1)
        rows, score = rows[better], score[better]
        score = np.concatenate([self.score[rows], score], axis=1)
        places = np.concatenate([self.place[rows], np.broadcast_to(places, (len(rows), len(places)))], axis=1)
        order = np.lexsort((places, -score), axis=-1)[:, :self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.place[rows] = np.take_along_axis(places, order, axis=1)


def search(q: np.ndarray, own: np.ndarray, x: np.ndarray, places: np.ndarray, best: Best) -> None:
    """Best-first search of one tree for a block of queries. Each query has a frontier of nodes with their bounds, the
    highest inner product of any point in a node's box; it opens the node of highest bound, which puts the children's
    bounds on the frontier or scans a leaf, and stops when that bound lies below its kth score, which it keeps from tree
    to tree. At an equal bound it goes on, as a smaller id may wait there. Queries that open one node do so together.
    ``own``: the place of each query's own row, which is no candidate."""
    leaves, children, low, high = tree(x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    reach = lambda rows, node: up[rows] @ high[node] + down[rows] @ low[node]
    frontier = np.full((len(q), len(children)), -np.inf)
    rows = np.arange(len(q))
    frontier[:, 0] = reach(rows, 0)
    while len(rows):
        node = np.argmax(frontier[rows], axis=1)
        bound = frontier[rows, node]
        live = (bound >= best.kth[rows]) & (bound > -np.inf)
        rows, node = rows[live], node[live]
        frontier[rows, node] = -np.inf
        for k in np.unique(node).tolist():
            some = rows[node == k]
            left, right = children[k]
            if left < 0:
                score = q[some] @ x[leaves[right]].T
                score[own[some][:, None] == places[leaves[right]][None, :]] = -np.inf
                best.add(some, score, places[leaves[right]])
            else:
                frontier[some, left], frontier[some, right] = reach(some, left), reach(some, right)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``vectors`` (vec_id, embedding) for which the column expression
    ``is_query`` holds, the ``k`` other rows of highest integer inner product of floor(``scale`` * x), ties to the
    smaller vec_id; fewer if there are fewer.

    Vectors that are null, empty or hold null or non-finite components, and null vec_ids, take no part. Only vectors
    of equal length meet. Every row is a candidate but the query's own: rows of one vec_id are told apart by ``copy``, their
    number in the order of their components, and each is a query of its own, so that repeated rows repeat in the answer
    (query_copy and copy are returned too). Extra columns are left out; an empty table gives an empty one. Sums must stay
    below 2**53.

    Of equal quantised vectors only the k + 1 smallest ids can be in an answer (one may be the query's own), so the
    others leave before the search; that bounds the work on copies and loses nothing. Shards and query blocks have a
    bounded size, so a task holds a few trees and a block of queries. A first pass searches one turn of shards for each
    block of queries; the kth scores that it finds are the floors under which the second, over all shards, opens no node.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding")))
    rows = rows.select("vec_id", "copy", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))
    rows = materialize(rows.withColumn("dim", F.size("v")))
    first = Window.partitionBy("v").orderBy("vec_id", "copy")
    useful = materialize(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"))
    queries = rows.where(is_query)
    count = {r["dim"]: r["n"] for r in useful.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asked = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def parts(n: dict, size: int):
        """Number of parts of about ``size`` rows, for each length of vector."""
        made = F.lit(1)
        for dim, m in n.items():
            made = F.when(F.col("dim") == dim, -(-m // size)).otherwise(made)
        return made

    step = SHARD_ROWS * SHARDS_IN_TURN
    blocks, turns = parts(asked, QUERY_ROWS), parts(count, step)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "copy"), n).cast("int")
    queries = queries.withColumn("block", spread(blocks))

    def run(batches):
        for table, first_ in whole_groups(batches, ["dim", "block", "turn"], step):
            for a, b in zip(first_.tolist(), [*first_[1:].tolist(), table.num_rows]):
                part = table.slice(a, b - a)
                m = int((part["side"].to_numpy() == 0).sum())
                if not m or m == b - a:
                    continue
                v = part["v"].combine_chunks().flatten().to_numpy().reshape(b - a, -1)
                ids, copies = part["vec_id"].to_numpy(), part["copy"].to_numpy()
                at = {key: p for p, key in enumerate(zip(ids[m:].tolist(), copies[m:].tolist()))}
                own = np.array([at.get(key, -1) for key in zip(ids[:m].tolist(), copies[:m].tolist())])
                best = Best(part["floor"].to_numpy()[:m], k)
                for s in range(0, b - a - m, SHARD_ROWS):  # places are in the order of (vec_id, copy), as the rows are
                    places = np.arange(s, min(b - a - m, s + SHARD_ROWS))
                    search(v[:m], own, v[m + places], places, best)
                q, rank = np.nonzero(best.score > -np.inf)
                place = m + best.place[q, rank]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(copies[q]), pa.array(ids[place]), pa.array(copies[place]), pa.array(best.score[q, rank].astype(np.int64))],
                                                 names=["query_id", "query_copy", "vec_id", "copy", "score"])

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.select("vec_id", "copy", "v", "dim", "block", "turn", F.lit(0).alias("side"), "floor")
        right = right.select("vec_id", "copy", "v", "dim", "block", "turn", F.lit(1).alias("side"), F.lit(0.0).alias("floor"))
        dealt = left.unionByName(right).repartition("dim", "block", "turn").sortWithinPartitions("dim", "block", "turn", "side", "vec_id", "copy")
        return dealt.mapInArrow(run, "query_id long, query_copy int, vec_id long, copy int, score long")

    every = useful.withColumn("turn", spread(turns))
    near = every.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: F.pmod(b, turns) == F.col("turn"))))
    seeds = searched(queries.withColumns({"turn": F.pmod("block", turns), "floor": F.lit(float("-inf"))}), near)
    seeds = seeds.groupBy(F.col("query_id").alias("vec_id"), F.col("query_copy").alias("copy")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    floors = queries.join(materialize(seeds), ["vec_id", "copy"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = searched(floors.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1))), every.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    rank = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_copy", "copy")
