"""Interval, nearest and adjacency operators over media time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spans(rows: DataFrame, low: Column, high: Column, unit: float) -> DataFrame:
    """``rows`` with the buckets that [low, high] touches, two at most: a bucket's width is the unit doubled ``level``
    times, until the span fits. So a span of any length is two rows."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(high - low, F.lit(unit)) / unit))).cast("int")
    rows = rows.withColumn("level", level)
    width = unit * F.pow(F.lit(2.0), F.col("level"))
    return rows.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(low / width), F.floor(high / width)))))


def _points(rows: DataFrame, spans: DataFrame, at: str, unit: float) -> DataFrame:
    """``rows`` with the bucket of ``at`` on each level that occurs in ``spans``; there are few."""
    levels = spans.agg(F.collect_set("level")).scalar()
    rows = rows.withColumn("level", F.explode(levels))
    return rows.withColumn("bucket", F.floor(F.col(at) / (unit * F.pow(F.lit(2.0), F.col("level")))))


def interval_join(keyframes: DataFrame, speech: DataFrame, margin: float = 1.5, max_chars: int = 1200, bucket: float = 30.0) -> DataFrame:
    """Each keyframe with the speech around it: (keyframe_id, asr_text).

    A segment counts within ``margin`` seconds of its ends, both included; ends in the wrong order are swapped; rows
    without finite times or words are left out. Texts stand in the order of their expanded start, once for equal folded
    case, joined by single spaces; the text is cut to ``max_chars`` and its right end trimmed. Keyframes without speech
    have an empty text. Segments are dealt to time buckets, two at most whatever their length, so that video and bucket are
    join keys, and only the exact range is left to check.
    """
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    s = speech.where("start_time IS NOT NULL AND end_time IS NOT NULL AND NOT isnan(start_time) AND NOT isnan(end_time) AND abs(start_time) < double('Infinity') AND abs(end_time) < double('Infinity')")
    s = s.select("video_id", (F.least("start_time", "end_time") - margin).alias("low"), (F.greatest("start_time", "end_time") + margin).alias("high"), text.alias("said")).where("said <> ''")
    s = _spans(s, F.col("low"), F.col("high"), bucket)
    k = keyframes.select("keyframe_id", "video_id", "pts_time")
    near = _points(k, s, "pts_time", bucket).join(s, ["video_id", "level", "bucket"]).where(F.col("pts_time").between(F.col("low"), F.col("high")))
    once = near.groupBy("keyframe_id", F.lower("said").alias("folded")).agg(F.min(F.struct("low", "said")).alias("first"))
    said = once.groupBy("keyframe_id").agg(F.array_sort(F.collect_list(F.struct(F.col("first.low").alias("low"), "folded", F.col("first.said").alias("said")))).alias("all"))
    joined = F.rtrim(F.substring(F.array_join(F.transform("all", lambda x: x["said"]), " "), 1, max_chars))
    return k.select("keyframe_id").join(said.select("keyframe_id", joined.alias("asr_text")), "keyframe_id", "left").withColumn("asr_text", F.coalesce("asr_text", F.lit("")))


def nearest_inside(segments: DataFrame, keyframes: DataFrame, bucket: float = 30.0) -> DataFrame:
    """Each segment with the keyframe inside its time that is nearest to its start, or none; ties to the smaller id."""
    s = _spans(segments.where("start_time <= end_time"), F.col("start_time"), F.col("end_time"), bucket)
    k = _points(keyframes.select("video_id", "keyframe_id", "pts_time"), s, "pts_time", bucket)
    near = s.join(k, ["video_id", "level", "bucket"]).where(F.col("pts_time").between(F.col("start_time"), F.col("end_time")))
    best = near.groupBy("segment_id").agg(F.min(F.struct(F.abs(F.col("pts_time") - F.col("start_time")).alias("gap"), "keyframe_id")).alias("best"))
    return segments.join(best, "segment_id", "left").select("segment_id", "video_id", F.col("best.keyframe_id").alias("keyframe_id"), F.col("best.gap").alias("gap"))


def propagate_captions(keyframes: DataFrame, captions: DataFrame) -> DataFrame:
    """Caption of the nearest directly captioned frame of the same shot by frame distance (ties to the earlier frame):
    direct at distance 0, else propagated; evidence_only where the shot has none. One sort of a shot's frames: the last
    caption before a frame and the first one behind it are all that can be nearest."""
    c = captions.where("frame_idx IS NOT NULL").groupBy("shot_id", "frame_idx").agg(F.min("caption").alias("caption"))
    said = F.struct(F.col("frame_idx").alias("c_frame"), "caption").alias("said")
    rows = keyframes.select("keyframe_id", "shot_id", "frame_idx", F.lit(None).cast("struct<c_frame:bigint,caption:string>").alias("said"), F.lit(1).alias("turn")).unionByName(
        c.select(F.lit(None).cast("string").alias("keyframe_id"), "shot_id", F.col("frame_idx").cast("long").alias("frame_idx"), said, F.lit(0).alias("turn")))
    by = Window.partitionBy("shot_id").orderBy("frame_idx", "turn")
    before, after = F.last("said", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first("said", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"before": before, "after": after}).where("turn = 1")
    gap = lambda c: F.abs(F.col("frame_idx") - F.col(f"{c}.c_frame"))
    best = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    rows = rows.withColumn("best", best)
    source = F.when(F.col("best").isNull(), "evidence_only").when(gap("best") == 0, "direct").otherwise("propagated")
    return rows.select("keyframe_id", F.col("best.caption").alias("caption"), F.col("best.c_frame").alias("source_frame"), source.alias("caption_source"))


def temporal_edges(shots: DataFrame, max_gap: float = 3.0) -> DataFrame:
    """Edges from each shot to the previous (AFTER) and the next (NEXT) of its video, with the gap between them."""
    by = Window.partitionBy("video_id").orderBy("shot_index", "shot_id")
    rows = shots.select("video_id", "shot_id", F.lag("shot_id").over(by).alias("before"), F.lead("shot_id").over(by).alias("after"),
                        F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time").over(by)).alias("gap_before"), F.greatest(F.lit(0.0), F.lead("start_time").over(by) - F.col("end_time")).alias("gap_after"))
    edge = F.explode(F.array(F.struct(F.col("before").alias("target"), F.lit("AFTER").alias("relation"), F.col("gap_before").alias("gap_sec")),
                             F.struct(F.col("after").alias("target"), F.lit("NEXT").alias("relation"), F.col("gap_after").alias("gap_sec"))))
    return rows.select("video_id", F.col("shot_id").alias("source"), edge.alias("e")).select("video_id", "source", "e.*").where(F.col("target").isNotNull() & (F.col("gap_sec") <= max_gap))


def pack_events(shots: DataFrame, max_duration: float = 30.0) -> DataFrame:
    """Greedy windows over a video's shots in order: a shot joins while it ends within ``max_duration`` of the window's
    start. A task walks its videos' sorted shots once and holds the open window alone, however many shots a video has."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, number, first, last, ids = None, 0, None, None, []
        for batch in batches:
            out = []
            for v, shot, start, end in zip(*(batch.column(c).to_pylist() for c in ("video_id", "shot_id", "start_time", "end_time"))):
                if ids and (v != video or not (start is not None and end is not None and first is not None and end - first <= max_duration)):
                    out.append((video, number, first, last, ids, len(ids)))
                    number, ids = number + 1, []
                if v != video:
                    video, number = v, 0
                if not ids:
                    first, last = start, end
                ids.append(shot)
                last = max((t for t in (last, end) if t is not None), default=None)
            yield _events(out)
        if ids:
            yield _events([(video, number, first, last, ids, len(ids))])

    rows = shots.select("video_id", "shot_index", "shot_id", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"))
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "shot_index", "shot_id")
    return rows.mapInArrow(walk, "video_id string, event_no int, start_time double, end_time double, shot_ids array<string>, shot_count int")


def _events(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"video_id": pa.string(), "event_no": pa.int32(), "start_time": pa.float64(), "end_time": pa.float64(), "shot_ids": pa.list_(pa.string()), "shot_count": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def merge_short_shots(shots: DataFrame, shortest: float = 0.6) -> DataFrame:
    """Shots shorter than ``shortest`` seconds join the one before; a video's first shot stays."""
    by = Window.partitionBy("video_id").orderBy("shot_index", "shot_id")
    keep = F.when((F.col("duration_sec") >= shortest) | (F.row_number().over(by) == 1), 1).otherwise(0)
    rows = shots.withColumn("keep", keep)
    rows = rows.withColumn("part", F.sum("keep").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "part").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("merged"))


def sub_window(frame, start_frame, fps, seconds: float = 5.0):
    """Number of the sub-window of a frame inside its shot."""
    return F.floor((frame - start_frame) / (seconds * fps))


def frame_plan(shots: DataFrame, per: float = 1.25, most: int = 24) -> DataFrame:
    """Candidate frames of each shot: ceil(duration / 1.25), at most 24, evenly spaced, each frame once."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("duration_sec") / per))).cast("int")
    rows = shots.withColumn("n", n)
    span = F.col("end_frame") - F.col("start_frame")
    frames = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.col("start_frame") + F.floor(F.when(F.col("n") > 1, span * i / (F.col("n") - 1)).otherwise(F.lit(0.0)))).cast("long"))
    return rows.select("video_id", "shot_id", F.explode(F.array_distinct(frames)).alias("frame_idx"))


def checkpoint_alignment(expected: DataFrame, decoded: DataFrame, tolerance: float) -> DataFrame:
    """Expected frame times against decoded ones: error and whether it is within ``tolerance``; none decoded fails."""
    rows = expected.join(decoded.select("video_id", "frame_idx", F.col("pts_time").alias("decoded_time")), ["video_id", "frame_idx"], "left")
    rows = rows.withColumn("error", F.abs(F.col("pts_time") - F.col("decoded_time")))
    return rows.withColumn("aligned", F.coalesce(F.col("error") <= tolerance, F.lit(False)))


def even_sample(rows: DataFrame, n: int, partition: str, order: list[str]) -> DataFrame:
    """``n`` evenly spaced rows of each partition, first and last included; all if there are no more."""
    w = Window.partitionBy(partition)
    rows = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / max(1, n - 1)).cast("int"))
    return rows.where((F.col("__n") <= n) | F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def best_of_splits(rows: DataFrame, limit: int, group: str, order: list[str]) -> DataFrame:
    """Rows of each group in ``limit`` contiguous parts of near equal size, the best quality of each (ties to the
    earlier)."""
    part = rows.withColumn("part", F.ntile(limit).over(Window.partitionBy(group).orderBy(*order)))
    best = Window.partitionBy(group, "part").orderBy(F.desc("quality_score"), *order)
    return part.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def motion_scores(frames: DataFrame, metric: str) -> DataFrame:
    """Mean absolute change of a metric from frame to frame, per shot."""
    by = Window.partitionBy("shot_id").orderBy("frame_idx", "keyframe_id")
    change = F.abs(F.col(metric) - F.lag(metric).over(by))
    return frames.withColumn("change", change).groupBy("shot_id").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("motion_score"))
