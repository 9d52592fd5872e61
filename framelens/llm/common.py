"""Shared helpers: tables that cut lineage, joins that spread hot keys, and connected components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: A key with more than 1/HOT of all rows is dealt in parts; there are fewer than HOT of these.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A new local one where that is unset and the session has
    one machine only (tests); elsewhere a local folder would lose results, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{root.name}", "zip", root.parent, root.name))
        _shipped.add(app)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later plans start from stored rows,
    so a lost executor costs a reread and not a recomputation. ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads. The tables that a result is read from stay, as it is
    lazy; whoever has used it up can delete the shared folder."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only: extra columns never clash with the operators' own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def spread_join(rows: DataFrame, classes: DataFrame, keys: list[str], by: Column, weight: str = "weight", found: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` with ``classes`` (one row for each value of ``keys``, and ``weight``, the number of rows that
    have it), in which no key fills a task: keys with more than 1/HOT of all rows are dealt in parts by the hash of ``by``,
    and rows with a null key, which match nothing, in HOT parts. Fewer than HOT keys are hot, so their list is broadcast.

    ``found``: what is joined, if it is not ``classes`` itself but a table with the same keys, of which some may lack."""
    parts = F.ceil(F.col(weight) * HOT / classes.agg(F.sum(weight)).scalar()).cast("int")
    hot = F.broadcast(classes.select(*keys, parts.alias("__parts")).where("__parts > 1"))
    found = classes.drop(weight) if found is None else found
    found = found.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    rows = rows.join(hot, keys, "left")
    parts = F.when(null, F.lit(HOT)).otherwise(F.coalesce("__parts", F.lit(1)))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(29), by), parts).cast("int")).drop("__parts")
    return rows.join(found, [*keys, "__salt"], "left").drop("__salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a long, b long), as (id, component_id).

    Contraction: every label hooks to its smallest neighbouring label, the hooks are compressed by pointer jumping,
    edges are relabelled and duplicates fall away, until no edge joins two labels. Rounds grow with the logarithm
    of the longest hook chain; every step is a join or a partial aggregation on stored tables, nothing is gathered.
    Ids that stand in no edge do not appear; null ids and self loops link nothing.
    """
    live = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    labels = None
    while live.take(1):
        hooks = materialize(live.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("to")))
        while True:
            jump = hooks.select(F.col("id").alias("to"), F.col("to").alias("further"))
            if not hooks.join(jump, "to", "left_semi").take(1):
                break
            before, hooks = hooks, materialize(
                hooks.join(jump, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
            )
            discard(before)
        if labels is None:
            ids = live.select(F.explode(F.array("hi", "lo")).alias("id")).distinct()
            labels = materialize(ids.join(hooks, "id", "left").select("id", F.coalesce("to", "id").alias("label")))
        else:
            step = hooks.select(F.col("id").alias("label"), "to")
            before, labels = labels, materialize(
                labels.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            )
            discard(before)
        hi = hooks.select(F.col("id").alias("hi"), F.col("to").alias("hi_to"))
        lo = hooks.select(F.col("id").alias("lo"), F.col("to").alias("lo_to"))
        moved = live.join(hi, "hi", "left").join(lo, "lo", "left").select(
            F.coalesce("hi_to", "hi").alias("a"), F.coalesce("lo_to", "lo").alias("b"))
        before, live = live, materialize(
            moved.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
        )
        discard(before, hooks)
    if labels is None:
        return live.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    return labels.select("id", F.col("label").alias("component_id"))
