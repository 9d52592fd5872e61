"""Incremental ingest: new files only, refreshed by key, so that the result equals a batch run over all files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.ledger import latest_by_key
from ..sources.writers import replace_partitions


def file_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def prepare(spark: SparkSession, schema: StructType, target: str, *partitions: str) -> None:
    """An empty table in ``target``, unless there is one: a stream that brings nothing leaves a table without rows."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(target)


def read_target(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The table in ``target`` by its schema, which an empty one cannot tell by itself."""
    return spark.read.schema(schema).parquet(target)


def ingest_by_video(stream: DataFrame, target: str, checkpoint: str, key: str = "video_id"):
    """All rows that have arrived, in ``target`` by ``key`` and within it by the batch that brought them (ingest_batch).
    A batch writes its own partitions alone, so later files of a key add to it, and a repeated batch replaces only
    itself. A target belongs to one checkpoint; without rows it is an empty table. Returns the started query, which ends when
    all files are in."""
    prepare(stream.sparkSession, StructType([*stream.schema.fields, StructField("ingest_batch", LongType())]), target, key, "ingest_batch")

    def add(batch: DataFrame, number: int) -> None:
        replace_partitions(batch.withColumn("ingest_batch", F.lit(number)), target, key, "ingest_batch")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64):
    """Latest row of each key of an append log, kept in hashed partitions (bucket) of which a batch rewrites those it touches."""
    schema = StructType([*stream.schema.fields, StructField("bucket", IntegerType())])
    prepare(stream.sparkSession, schema, target, "bucket")

    def merge(batch: DataFrame, _: int) -> None:
        new = latest_by_key(batch, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        old = read_target(batch.sparkSession, target, schema)
        touched = new.select("bucket").distinct()
        replace_partitions(latest_by_key(old.join(touched, "bucket", "left_semi").unionByName(new), keys, order), target, "bucket")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_from(streams: list[DataFrame], build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "video_id"):
    """Documents that rest on several sources: each batch takes the values of ``key`` that new files of any of ``streams``
    name, and ``build`` makes the documents of these keys (a table of ``key``) anew from all that its sources hold; they
    replace the keys' partitions in ``target``.

    The streams are one query, so a key that several of them touch is built once. A batch is recorded when its documents are
    written, and a batch that comes again after a failure is not built again; one that failed half-way is, and replaces what
    it has left. Without new files the target is an empty table."""
    keys = reduce(DataFrame.unionByName, [s.select(key) for s in streams])
    spark = keys.sparkSession
    prepare(spark, build(spark.createDataFrame([], keys.schema)).schema, target, key)
    log, kind = f"{target}-batches", "batch long, keys long"
    spark.createDataFrame([], kind).write.mode("ignore").parquet(log)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = read_target(spark, log, kind)
        if done.where(F.col("batch") == number).take(1):
            return
        touched = batch.where(F.col(key).isNotNull()).distinct()
        replace_partitions(build(touched), target, key)
        touched.agg(F.count("*").alias("keys")).select(F.lit(number).cast("long").alias("batch"), "keys").write.mode("append").parquet(log)

    return keys.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_touched(stream: DataFrame, source: Callable[[SparkSession], DataFrame], build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "video_id"):
    """``refresh_from`` one stream: ``build`` gets the rows of ``source`` that have the touched keys."""
    return refresh_from([stream], lambda touched: build(source(touched.sparkSession).join(touched, key, "left_semi")), target, checkpoint, key)
