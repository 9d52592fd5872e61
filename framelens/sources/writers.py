"""Writers; each goes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def replace_partitions(df: DataFrame, path: str, key: str = "video_id", *inner: str) -> None:
    """Replace the partitions of the keys (and of the ``inner`` columns below them) in ``df`` and leave all others."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, *inner).parquet(path)


def write_submission(lines: DataFrame, path: str) -> None:
    """One folder of text for each question's file name, lines in order."""
    rows = lines.repartition("file_name").sortWithinPartitions("file_name", "line_no")
    rows.select("file_name", F.col("line").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").partitionBy("file_name").text(path)
