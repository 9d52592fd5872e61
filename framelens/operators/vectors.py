"""Exact and approximate vector search, group vectors and consolidation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot, l2_normalize
from .lexical import _few, top_k

#: Queries and vectors of a tile: a task holds a tile at a time.
QUERY_ROWS = 1024
VECTOR_ROWS = 8192
#: Queries of a tile whose scores a task holds at a time.
SCORED_ROWS = 64

sound = "vector IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", match: tuple[str, str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products for each row of ``queries`` (query_id, vector).

    ``match`` (query column, vector column) restricts answers to equal values: only these meet. Vectors that are null or
    empty or hold null or non-finite components take no part, and only those of equal length meet. Scores are rounded to
    six places before ranking, ties go to the smaller id.

    ``sizes`` (key, dim, blocks, turns): the blocks of queries and of vectors for each value of ``match`` as a string and each
    length, if they are known and few; otherwise both tables are counted.

    Queries in blocks meet vectors in blocks; each pair of blocks is one product in one task, from which k rows for each
    query go on. Rows are dealt by pair of blocks, so a value of ``match`` that most rows have is no hot key. Nothing passes the
    driver; the rows that are dealt grow as queries times vectors over a block's size.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must lie between 1 and 1000")
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *vectors.schema)}
    key = lambda side: (F.col(match[side]) if match else F.lit(0)).cast("string").alias("key")
    plain = [F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim")]
    q = queries.where(sound).select("query_id", F.lit(None).cast(kinds[id_col]).alias("id"), key(0), *plain)
    x = vectors.where(sound).select(F.lit(None).cast(kinds["query_id"]).alias("query_id"), F.col(id_col).alias("id"), key(1), *plain)
    counted = lambda df, name, size: df.groupBy("key", "dim").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    known = sizes is not None
    sizes = sizes if known else counted(q, "blocks", QUERY_ROWS).join(counted(x, "turns", VECTOR_ROWS), ["key", "dim"])
    sizes = F.broadcast(sizes) if known or not match or _few(sizes) else sizes  # a row for each value and length of vector
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = q.join(sizes, ["key", "dim"]).withColumns({"block": some("query_id", "blocks"), "side": F.lit(0)}).withColumn("turn", every("turns"))
    right = x.join(sizes, ["key", "dim"]).withColumns({"turn": some("id", "turns"), "side": F.lit(1)}).withColumn("block", every("blocks"))
    out = f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, score double"

    def product(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)
        asked, ids = table["query_id"].take(a), table["id"].take(b)
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # so that ties go to the smaller id
        b, ids = b[order], ids.take(order)
        known, best, scores = rows[b], [], []
        for start in range(0, len(a), SCORED_ROWS):
            score = np.round(rows[a[start:start + SCORED_ROWS]] @ known.T, 6)
            # Those that reach the kth score, ties among them; only they are sorted.
            least = np.partition(score, -k, axis=1)[:, -k:].min(axis=1) if k < len(b) else np.full(len(score), -np.inf)
            for own, floor in zip(score, least):
                reach = np.flatnonzero(own >= floor)
                reach = reach[np.argsort(-own[reach], kind="stable")][:k]
                best.append(reach)
                scores.append(own[reach])
        place = np.repeat(np.arange(len(a)), np.array([len(x) for x in best], np.int64))
        best, scores = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((best, np.int64), (scores, np.float64)))
        return pa.table({"query_id": asked.take(place), id_col: ids.take(best), "score": scores})

    names = ["key", "dim", "block", "turn", "side", "query_id", "id", "vector"]
    tiles = left.select(names).unionByName(right.select(names)).repartition("key", "dim", "block", "turn")
    found = tiles.groupBy("key", "dim", "block", "turn").applyInArrow(product, out)
    return top_k(found, k, id_col)


def group_vectors(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: mean vector normalised to unit length, first and last time, and number of rows. The mean is that of the
    sound vectors (see ``exact_top_k``) of the group's commonest length, of equally common ones the greatest; a group without a
    sound vector has no row. Times and numbers count all rows of the group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    by_length = rows.where(sound).groupBy(*group, F.size("vector").alias("__dim")).agg(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))).alias("__mean"), F.count("*").alias("__n"))
    made = by_length.groupBy(*group).agg(F.max_by(vector_to_array("__mean"), F.struct("__n", "__dim")).alias("mean"))
    span = rows.groupBy(*group).agg(F.min("pts_time").alias("start_time"), F.max("pts_time").alias("end_time"), F.count("*").alias("keyframe_count"))
    return made.join(span, group).withColumn("vector", l2_normalize(F.col("mean"))).drop("mean")


def recall_at(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row: share of the exact answers that were found."""
    hit = found.select("query_id", id_col, F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", id_col], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def two_stage(queries: DataFrame, vectors: DataFrame, n_groups: int, k: int) -> DataFrame:
    """Best shots by their mean vectors, then the best keyframes inside these. Unsound vectors, and those that differ in
    length from the query's, take no part."""
    shots = group_vectors(vectors, ["shot_id"])
    best = exact_top_k(queries, shots.select("shot_id", "vector"), n_groups, "shot_id").select("query_id", "shot_id")
    inside = vectors.where(sound).join(best, "shot_id").join(queries.where(sound).select("query_id", F.col("vector").alias("q")), "query_id").where("size(q) = size(vector)")
    return top_k(inside.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("vector")), 6).alias("score")), k, "vec_id")


def consolidate(sources: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of several sources (id, source_no, row_no, aligned, vector): misaligned sources are left out, the last
    row of an id wins, vectors become unit, rows get a dense number per video. Also the number of rows left out."""
    sound = sources.where("aligned")
    last = Window.partitionBy(id_col).orderBy(F.desc("source_no"), F.desc("row_no"))
    ranked = sound.withColumn("__r", F.row_number().over(last))
    kept = ranked.where("__r = 1").drop("__r").withColumn("vector", l2_normalize(F.col("vector")))
    dense = Window.partitionBy("video_id").orderBy("pts_time", id_col)
    kept = kept.withColumn("embedding_row", F.row_number().over(dense) - 1)
    return kept, ranked.agg(F.count_if(F.col("__r") > 1).alias("duplicates"))


def self_retrieval(vectors: DataFrame, sample: DataFrame) -> DataFrame:
    """Sampled rows (query_id, vector) whose best match is not their own id."""
    best = exact_top_k(sample, vectors, 1)
    return best.where(F.col("query_id") != F.col("vec_id"))


def dimension_violations(vectors: DataFrame, source_col: str) -> DataFrame:
    """Sources whose vectors differ in length from the commonest length of all."""
    n = vectors.groupBy(source_col, F.size("vector").alias("dim")).agg(F.count("*").alias("rows"))
    common = n.groupBy("dim").agg(F.sum("rows").alias("all_rows")).agg(F.max_by("dim", "all_rows").alias("common"))
    return n.crossJoin(F.broadcast(common)).where("dim <> common")  # one row
