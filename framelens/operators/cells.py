"""A stored index for approximate vector search: cells of a partitioned table.

A folder holds ``cells``, all vectors partitioned by cell, and ``centres`` with the cells' centres. The number of cells to
probe is measured when the index is built and stored with it, so a search neither fits nor searches exactly, and reads
only the partitions of the cells that some query probes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import QUERY_ROWS, VECTOR_ROWS, exact_top_k, sound

#: Cells at most, rows for each cell that centres are fitted on, and rows at least.
MOST_CELLS, FIT_PER_CELL, FIT_ROWS = 4096, 40, 20_000
#: Rows of a file of the index, about.
FILE_ROWS = 1 << 17
#: Copies of queries in memory at a time.
COPIES = 1 << 16


class Cells(NamedTuple):
    """An index that was opened: its folder, the length of its centres, the centres, the number of probes and their recall,
    and the rows of each cell."""

    path: str
    dim: int
    centres: np.ndarray
    probes: int
    recall: float | None
    rows: dict


def _rows(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells by rising distance of their centres."""
    return np.argsort((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1, kind="stable")


def _placed(vectors: DataFrame, dim: int, centres: np.ndarray) -> DataFrame:
    """``vectors`` with their cell: the nearest centre's, or minus the length for vectors of another length."""
    names = vectors.columns
    plain = vectors.select(*names, F.col("vector").cast("array<double>").alias("__x"), F.size("vector").alias("__dim"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                size = part.column("__dim").to_numpy(zero_copy_only=False)
                cell = -size.astype(np.int32)
                own = np.flatnonzero(size == dim)
                if len(own):
                    cell[own] = _order(_rows(part.column("__x").take(pa.array(own))), centres)[:, 0]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(cell)], names=[*names, "cell"])

    return plain.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", cell int")


def write_cells(vectors: DataFrame, path: str, k: int = 10, id_col: str = "vec_id", n_cells: int | None = None, least: float = 0.92, sample: int = 1000, seed: int = 7) -> None:
    """Index ``vectors`` (id, vector, any more columns) in the folder ``path``.

    Cells are fitted by k-means to vectors of the commonest length (of equally common ones the greatest): the square root of
    their number, MOST_CELLS at most, on about FIT_ROWS rows or FIT_PER_CELL for each cell, if that is more. Every sound
    vector (see ``exact_top_k``) is stored; those of other lengths have a cell for each length, which a query of that length
    reads whole. Null ids and repeated rows stay; an empty table gives an index that answers nothing.

    The number of probes is the smallest that finds ``least`` of the exact ``k`` best other vectors of ``sample`` stored ones,
    those of smallest hashed id. The required recall is 0.9; ``least`` lies above it because a sample tells it."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    vectors = vectors.where(sound)
    lengths = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (lengths["dim"], lengths["n"]) if lengths else (0, 0)
    main = vectors.where(F.size("vector") == dim)
    centres = np.zeros((1, dim))
    if n:
        count = min(n, n_cells or max(1, min(MOST_CELLS, round(n**0.5))))
        fitted = max(FIT_ROWS, FIT_PER_CELL * count)
        part = main.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        part = part.sample(False, min(1.0, fitted / n), seed) if n > fitted else part
        if count > 1:
            centres = np.array(KMeans(k=count, seed=seed, maxIter=8, initMode="random").fit(part).clusterCenters())
        else:
            centres = np.array([main.select("vector").first()["vector"]], np.float64)
    placed = _placed(vectors, dim, centres)
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row for each cell
    sizes = spark.createDataFrame([(c, -(-m // FILE_ROWS)) for c, m in counts.items()], "cell int, __files int")
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("__file", F.pmod(F.xxhash64(id_col), F.col("__files")))
    dealt.repartition("cell", "__file").drop("__files", "__file").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    probes, recall = _calibrated(_stored(spark, path, placed.schema).where("cell >= 0"), centres, k, id_col, least, sample) if n else (1, None)
    rows = [(c, centre.tolist(), dim, counts.get(c, 0), probes, recall) for c, centre in enumerate(centres)] + [(c, None, dim, m, probes, recall) for c, m in counts.items() if c < 0]
    spark.createDataFrame(rows, "cell int, centre array<double>, dim int, rows long, probes int, recall double").write.mode("overwrite").parquet(f"{path}/centres")


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/cells")


def _calibrated(stored: DataFrame, centres: np.ndarray, k: int, id_col: str, least: float, sample: int) -> tuple[int, float | None]:
    """Number of probes and their recall. An exact answer is found if its cell is probed, so its cell's place in the
    query's order of cells gives the recall at every number of probes."""
    asked = stored.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample).dropDuplicates(["query_id"])
    exact = exact_top_k(asked, stored, min(1000, k + 1), id_col).where(F.col("query_id") != F.col(id_col)).where(F.col("rank") <= k + 1)
    answers = exact.join(stored.select(id_col, "cell"), id_col).join(asked, "query_id").select(F.col("vector").cast("array<double>").alias("vector"), "cell")

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                order = _order(_rows(part.column("vector")), centres)
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(order == part.column("cell").to_numpy()[:, None], axis=1).astype(np.int32))], names=["place"])

    counts = sorted((r["place"], r["count"]) for r in answers.mapInArrow(place, "place int").groupBy("place").count().collect())  # a row for each cell at most
    found, total = 0, sum(n for _, n in counts)
    for at, n in counts:
        found += n
        if found >= least * total:
            return at + 1, round(found / total, 6)
    return len(centres), None


def open_cells(spark: SparkSession, path: str) -> Cells:
    """The index in ``path``; the driver holds its centres, MOST_CELLS at most."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
    centres = [r["centre"] for r in rows if r["cell"] >= 0]
    return Cells(path, rows[0]["dim"], np.array(centres, np.float64).reshape(len(centres), -1), rows[0]["probes"], rows[0]["recall"], {r["cell"]: r["rows"] for r in rows})


def search_cells(index: Cells, queries: DataFrame, k: int, id_col: str = "vec_id", probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each of ``queries`` (query_id, vector) the ``k`` best inner products in the stored
    number of cells, or in ``probes``, whose centres are nearest. Only the partitions of cells that some query probes are
    read. Queries that are not sound have no answers, nor have those of a length that no stored vector has."""
    spark = queries.sparkSession
    probes = max(1, min(probes or index.probes, len(index.centres)))
    step, dim, centres = max(1, COPIES // probes), index.dim, index.centres
    kind = queries.schema["query_id"].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            size = batch.column("dim").to_numpy(zero_copy_only=False)
            for own, cells_of in ((np.flatnonzero(size == dim), True), (np.flatnonzero(size != dim), False)):
                for at in range(0, len(own), step):
                    part = batch.take(pa.array(own[at:at + step]))
                    cells = _order(_rows(part.column("vector")), centres)[:, :probes] if cells_of else -part.column("dim").to_numpy(zero_copy_only=False)[:, None]
                    copies = part.take(pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([copies.column("query_id"), copies.column("vector"), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "vector", "cell"])

    asked = queries.where(sound).select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    probed = asked.mapInArrow(nearest, f"query_id {kind}, vector array<double>, cell int")
    wanted = {r["cell"]: r["count"] for r in probed.groupBy("cell").count().collect() if index.rows.get(r["cell"])}  # as many as cells at most
    if not wanted:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} long, score double")
    sizes = [(str(c), index.dim if c >= 0 else -c, -(-n // QUERY_ROWS), -(-index.rows[c] // VECTOR_ROWS)) for c, n in wanted.items()]
    stored = spark.read.parquet(f"{index.path}/cells").where(F.col("cell").isin(list(wanted)))
    return exact_top_k(probed, stored, k, id_col, match=("cell", "cell"), sizes=spark.createDataFrame(sizes, "key string, dim int, blocks int, turns int"))
