"""Views of the driver's tables as a video collection, and the same views as SQL.

One second of media time is one hour of event time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lexical import substring_hits


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one the cluster shares; a local one where a session of one machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written to a new folder and read from there."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


SQL: dict[str, str] = {}


def with_views(*names: str, body: str) -> str:
    """``body`` after the common table expressions it needs, in the order of definition."""
    need = set(names)
    for name in reversed(list(SQL)):
        if name in need:
            need |= {other for other in SQL if other != name and f"FROM {other}" in SQL[name] or f"JOIN {other}" in SQL[name]}
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in SQL if name in need) + "\n" + body


def keyframes(spark, d, events: DataFrame | None = None) -> DataFrame:
    """Of ``events``, or of all."""
    by = Window.partitionBy("video_id").orderBy("pts_time", "event_id")
    rows = (table(spark, d, "events") if events is None else events).select(
        "event_id", "event_type", "value", "props", F.concat(F.lit("kf:"), "event_id").alias("keyframe_id"), F.concat(F.lit("v"), "user_id").alias("video_id"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e9").alias("pts_time"))
    rows = rows.withColumns({"fps": F.lit(25.0), "frame_idx": F.floor(F.col("pts_time") * 25).cast("long"), "quality_score": F.least(F.lit(1.0), F.col("value") / 200),
                             "n": F.row_number().over(by), "gap": F.col("pts_time") - F.lag("pts_time").over(by)})
    return rows.withColumn("shot_no", F.sum(F.when(F.col("gap") > 2, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("shot_id", F.concat_ws(":", "video_id", "shot_no"))


SQL["keyframes0"] = """SELECT event_id, event_type, value, props, 'kf:' || event_id AS keyframe_id, 'v' || user_id AS video_id,
 date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS pts_time FROM events"""
SQL["keyframes1"] = """SELECT *, CAST(25.0 AS DOUBLE) AS fps, CAST(floor(pts_time * 25) AS BIGINT) AS frame_idx, least(1.0, value / 200) AS quality_score,
 row_number() OVER w AS n, pts_time - lag(pts_time) OVER w AS gap FROM keyframes0 WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, event_id)"""
SQL["keyframes2"] = """SELECT *, CAST(sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pts_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shot_no FROM keyframes1"""
SQL["keyframes"] = "SELECT *, video_id || ':' || shot_no AS shot_id FROM keyframes2"


def shots(spark, d) -> DataFrame:
    return keyframes(spark, d).groupBy("video_id", "shot_id", F.col("shot_no").alias("shot_index")).agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.min("pts_time").alias("start_time"), F.max("pts_time").alias("end_time")
    ).withColumn("duration_sec", F.col("end_time") - F.col("start_time"))


SQL["shots"] = """SELECT video_id, shot_id, shot_no AS shot_index, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, min(pts_time) AS start_time,
 max(pts_time) AS end_time, max(pts_time) - min(pts_time) AS duration_sec FROM keyframes GROUP BY ALL"""


def speech(spark, d, turns: DataFrame | None = None) -> DataFrame:
    start = (F.col("turn") * 90 + F.col("conv_id") % 90).cast("double")
    return (table(spark, d, "conversations") if turns is None else turns).select(
        F.concat_ws(":", F.lit("s"), "conv_id", "turn").alias("segment_id"), F.concat(F.lit("v"), "conv_id").alias("video_id"), F.col("turn").alias("segment_index"),
        start.alias("start_time"), (start + 1 + F.length("text") % 8).alias("end_time"), "text")


SQL["speech"] = """SELECT 's:' || conv_id || ':' || turn AS segment_id, 'v' || conv_id AS video_id, turn AS segment_index, CAST(turn * 90 + conv_id % 90 AS DOUBLE) AS start_time,
 CAST(turn * 90 + conv_id % 90 AS DOUBLE) + 1 + length(text) % 8 AS end_time, text FROM conversations"""


def detections(spark, d, events: DataFrame | None = None) -> DataFrame:
    by = Window.partitionBy("video_id").orderBy("pts_time", "event_id")
    k = keyframes(spark, d, events).withColumns({"one": F.lag("event_type", 1).over(by), "two": F.lag("event_type", 2).over(by), "k": F.get_json_object("props", "$.k").cast("int")})
    rows = k.select("*", F.posexplode(F.array("event_type", "one", "two")).alias("pos", "class_name")).where("class_name IS NOT NULL")
    x, y = (F.col("k") % 10) / 10.0, (F.floor(F.col("k") / 10) % 10) / 10.0
    return rows.select(F.concat_ws(":", F.lit("d"), "event_id", "pos").alias("detection_id"), "keyframe_id", "video_id", "shot_id", "frame_idx", "pts_time", "class_name",
                       (F.col("quality_score") * (1 - 0.1 * F.col("pos"))).alias("confidence"), x.alias("x1"), y.alias("y1"), F.least(F.lit(1.0), x + 0.3).alias("x2"), F.least(F.lit(1.0), y + 0.4).alias("y2"))


SQL["detections0"] = """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, lag(event_type, 1) OVER w AS one, lag(event_type, 2) OVER w AS two
 FROM keyframes WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, event_id)"""
SQL["detections1"] = """SELECT *, 0 AS pos, event_type AS class_name FROM detections0 UNION ALL SELECT *, 1, one FROM detections0 UNION ALL SELECT *, 2, two FROM detections0"""
SQL["detections"] = """SELECT 'd:' || event_id || ':' || pos AS detection_id, keyframe_id, video_id, shot_id, frame_idx, pts_time, class_name,
 quality_score * (1 - CAST(0.1 AS DOUBLE) * pos) AS confidence, (k % 10) / 10.0::DOUBLE AS x1, (floor(k / 10) % 10) / 10.0::DOUBLE AS y1,
 least(1.0::DOUBLE, (k % 10) / 10.0::DOUBLE + 0.3::DOUBLE) AS x2, least(1.0::DOUBLE, (floor(k / 10) % 10) / 10.0::DOUBLE + 0.4::DOUBLE) AS y2
 FROM detections1 WHERE class_name IS NOT NULL"""


def ocr_lines(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return rows.select(F.col("doc_id").alias("keyframe_id"), F.col("source").alias("shot_id"), "position", "text", ((F.col("doc_id") * 7 + F.col("position")) % 100 / 100.0).alias("confidence"))


SQL["ocr_lines"] = """SELECT keyframe_id, shot_id, position, text, (keyframe_id * 7 + position) % 100 / 100.0::DOUBLE AS confidence FROM (
 SELECT doc_id AS keyframe_id, source AS shot_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS position FROM documents)"""


def search_documents(spark, d) -> DataFrame:
    level = F.when(F.col("doc_id") % 3 == 0, "event").when(F.col("doc_id") % 3 == 1, "shot").otherwise("frame")
    start = (F.col("doc_id") % 600).cast("double")
    return table(spark, d, "documents").select("doc_id", level.alias("level"), F.col("source").alias("video_id"), F.concat_ws(":", "source", F.floor(F.col("doc_id") / 60)).alias("shot_id"),
                                               F.col("lang").alias("facet"), start.alias("start_time"), (start + 30).alias("end_time"), "text")


SQL["search_documents"] = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'shot' ELSE 'frame' END AS level, source AS video_id,
 source || ':' || (doc_id // 60) AS shot_id, lang AS facet, CAST(doc_id % 600 AS DOUBLE) AS start_time, CAST(doc_id % 600 AS DOUBLE) + 30 AS end_time, text FROM documents"""


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("kf:"), "vec_id").alias("keyframe_id"), F.concat(F.lit("v"), "label").alias("video_id"),
                                                F.concat_ws(":", "label", F.floor(F.col("vec_id") / 50)).alias("shot_id"), F.col("vec_id").cast("double").alias("pts_time"), F.col("embedding").alias("vector"))


SQL["vectors"] = """SELECT vec_id, 'kf:' || vec_id AS keyframe_id, 'v' || label AS video_id, label || ':' || (vec_id // 50) AS shot_id, CAST(vec_id AS DOUBLE) AS pts_time, embedding AS vector FROM embeddings"""


def query_vectors(spark, d) -> DataFrame:
    return vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector", F.col("video_id").alias("wanted_video"))


SQL["query_vectors"] = "SELECT vec_id AS query_id, vector, video_id AS wanted_video FROM vectors WHERE vec_id % 20 = 0"


def queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.array(F.lit("kis"), F.lit("qa"), F.lit("trake")), (F.col("item_id") % 3 + 1).cast("int")).alias("query_type"), "text")


SQL["search_queries"] = "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'kis' WHEN 1 THEN 'qa' ELSE 'trake' END AS query_type, text FROM benchmark"


def qrels(spark, d) -> DataFrame:
    """Grade 2 where a document holds the whole item."""
    docs = search_documents(spark, d)
    hits = substring_hits(docs.select("doc_id", "text"), queries(spark, d).select("query_id", "text"), ["text"]).join(docs.select("doc_id", "shot_id", "video_id"), "doc_id")
    return hits.select("query_id", F.posexplode(F.array(F.col("doc_id").cast("string"), "shot_id", "video_id")).alias("p", "id")).select(
        "query_id", F.element_at(F.array(F.lit("doc_id"), F.lit("shot_id"), F.lit("video_id")), F.col("p") + 1).alias("level"), "id").distinct().withColumn("grade", F.lit(2.0))


SQL["qrels0"] = "SELECT query_id, doc_id, shot_id, video_id FROM search_documents d JOIN search_queries q ON contains(lower(d.text), lower(q.text))"
SQL["qrels"] = """SELECT DISTINCT query_id, 'doc_id' AS level, CAST(doc_id AS VARCHAR) AS id, CAST(2.0 AS DOUBLE) AS grade FROM qrels0
 UNION SELECT query_id, 'shot_id', shot_id, 2.0 FROM qrels0 UNION SELECT query_id, 'video_id', video_id, 2.0 FROM qrels0"""
