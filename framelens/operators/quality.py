"""Audits, contracts and summaries. Validators return the rows that break a rule; an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot


def mapping_audit(rows: DataFrame) -> DataFrame:
    """Issues of keyframe maps (video_id, row_number, n, frame_idx, pts_time, fps as text): INVALID_VALUE where a value
    is not numeric; such a row is no predecessor. Against the last numeric row, n must rise, frame and time must not
    fall, none may be negative and fps must be positive, else INVALID_MONOTONICITY; an equal frame is a DUPLICATE_FRAME
    warning."""
    v = rows.select("video_id", "row_number", F.expr("try_cast(n AS bigint)").alias("n"), F.expr("try_cast(frame_idx AS bigint)").alias("frame"),
                    F.expr("try_cast(pts_time AS double)").alias("t"), F.expr("try_cast(fps AS double)").alias("fps"))
    numeric = F.col("n").isNotNull() & F.col("frame").isNotNull() & F.col("t").isNotNull() & F.col("fps").isNotNull()
    bad = v.where(~numeric).select("video_id", "row_number", F.lit("error").alias("severity"), F.lit("INVALID_VALUE").alias("code"))
    by = Window.partitionBy("video_id").orderBy("row_number")
    good = v.where(numeric).withColumns({f"last_{c}": F.coalesce(F.lag(c).over(by), F.lit(-1)) for c in ("n", "frame", "t")})
    broken = (F.col("n") <= F.col("last_n")) | (F.col("frame") < F.col("last_frame")) | (F.col("t") < F.col("last_t")) | (F.col("frame") < 0) | (F.col("t") < 0) | (F.col("fps") <= 0)
    code = F.when(broken, "INVALID_MONOTONICITY").when(F.col("frame") == F.col("last_frame"), "DUPLICATE_FRAME")
    found = good.withColumn("code", code).where("code IS NOT NULL")
    return bad.unionByName(found.select("video_id", "row_number", F.when(F.col("code") == "DUPLICATE_FRAME", "warning").otherwise("error").alias("severity"), "code"))


def folder_audit(rows: DataFrame, header_issues: DataFrame) -> DataFrame:
    """All issues of a folder of keyframe maps: those of headers (``checked_keyframe_map``) and, of the files whose header is
    sound, ``mapping_audit``. ``rows`` have row_number."""
    return header_issues.unionByName(mapping_audit(rows))


def pair_issues(metadata: DataFrame, mapping: DataFrame, valid_url: Column) -> DataFrame:
    """MISSING_PAIR of videos that stand on one side only, INVALID_JSON (corrupt) and INVALID_WATCH_URL of the others."""
    m = metadata.withColumn("url_ok", valid_url)
    both = m.join(mapping.select("video_id", F.lit(True).alias("mapped")).distinct(), "video_id", "full")
    code = F.when(F.col("mapped").isNull() | F.col("corrupt").isNull(), "MISSING_PAIR").when(F.col("corrupt"), "INVALID_JSON").when(~F.coalesce("url_ok", F.lit(False)), "INVALID_WATCH_URL")
    return both.select("video_id", F.lit("error").alias("severity"), code.alias("code")).where("code IS NOT NULL")


def audit_summary(issues: DataFrame, videos: DataFrame, keyframes: DataFrame) -> DataFrame:
    """One row: valid and invalid videos, keyframes, errors and warnings."""
    errors = issues.where("severity = 'error'").select("video_id").distinct().withColumn("bad", F.lit(1))
    v = videos.select("video_id").distinct().join(errors, "video_id", "left").agg(F.count_if(F.col("bad").isNull()).alias("valid_videos"), F.count_if(F.col("bad").isNotNull()).alias("invalid_videos"))
    i = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return v.crossJoin(keyframes.agg(F.count("*").alias("keyframes"))).crossJoin(i)  # one row each


def frame_contract(keyframes: DataFrame, shots: DataFrame, vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(rule, key) of broken rules: duplicate keyframe ids, keyframes without a vector and vectors without a keyframe, shots
    without a keyframe, vectors that are not finite or not of unit length. If both have video_id, a video with unequal
    numbers of keyframes and vectors is MISALIGNED; if vectors have embedding_row too, one whose rows are not 0, 1, 2, ... is
    NOT_CONTIGUOUS."""
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    k, v = keyframes.select("keyframe_id", "shot_id"), vectors.select("keyframe_id", "vector")
    duplicate = k.groupBy("keyframe_id").agg(F.count("*").alias("n")).where("n > 1")
    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = [rule(duplicate, "DUPLICATE_KEYFRAME", "keyframe_id"), rule(k.join(v, "keyframe_id", "left_anti"), "MISSING_VECTOR", "keyframe_id"), rule(v.join(k, "keyframe_id", "left_anti"), "UNKNOWN_KEYFRAME", "keyframe_id"),
             rule(shots.join(k, "shot_id", "left_anti"), "EMPTY_SHOT", "shot_id"), rule(v.where(~finite), "NOT_FINITE", "keyframe_id"), rule(v.where(finite & (F.abs(norm - 1) > tolerance)), "NOT_UNIT", "keyframe_id")]
    if "video_id" in keyframes.columns and "video_id" in vectors.columns:
        both = keyframes.groupBy("video_id").agg(F.count("*").alias("a")).join(vectors.groupBy("video_id").agg(F.count("*").alias("b")), "video_id", "full")
        parts.append(rule(both.where("NOT a <=> b"), "MISALIGNED", "video_id"))
    if {"video_id", "embedding_row"} <= set(vectors.columns):
        rows = vectors.groupBy("video_id").agg(F.min("embedding_row").alias("low"), F.max("embedding_row").alias("high"), F.countDistinct("embedding_row").alias("n"), F.count("*").alias("all"))
        parts.append(rule(rows.where("low <> 0 OR high <> n - 1 OR n <> all"), "NOT_CONTIGUOUS", "video_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def artifact_violations(rows: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """(artifact, rule, detail) of artifacts (artifact, video_id, ``key``) and their summaries (artifact, video_id): more than
    one video, another video than the summary says, a key that comes twice."""
    videos = rows.groupBy("artifact").agg(F.countDistinct("video_id").alias("n"), F.min("video_id").alias("video_id"))
    many = videos.where("n > 1").select("artifact", F.lit("SEVERAL_VIDEOS").alias("rule"), F.col("n").cast("string").alias("detail"))
    said = videos.join(summaries.select("artifact", F.col("video_id").alias("said")), "artifact").where("n = 1 AND NOT video_id <=> said")
    other = said.select("artifact", F.lit("OTHER_VIDEO").alias("rule"), F.col("said").alias("detail"))
    twice = rows.groupBy("artifact", key).agg(F.count("*").alias("n")).where("n > 1").select("artifact", F.lit("DUPLICATE_KEY").alias("rule"), F.col(key).cast("string").alias("detail"))
    return many.unionByName(other).unionByName(twice)


def incomplete_stages(artifacts: DataFrame, need: str = "shot", then: str = "visual") -> DataFrame:
    """Videos that have an artifact of stage ``need`` (video_id, stage) and none of stage ``then``."""
    have = lambda stage: artifacts.where(F.col("stage") == stage).select("video_id").distinct()
    return have(need).join(have(then), "video_id", "left_anti")


def eligible_frames(frames: DataFrame, most: float = 0.60, least: float = 25.0) -> DataFrame:
    """Frames (black_ratio, white_ratio, sharpness) that are neither mostly black or white nor blurred."""
    return frames.where((F.col("black_ratio") <= most) & (F.col("white_ratio") <= most) & (F.col("sharpness") >= least))


def unknown_references(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def transcript_violations(segments: DataFrame, durations: DataFrame, slack: float = 1.0) -> DataFrame:
    """(segment_id, rule): negative start, end not after start, start before the last segment's, end beyond the video."""
    by = Window.partitionBy("video_id").orderBy("segment_index", "segment_id")
    rows = segments.withColumn("last", F.lag("start_time").over(by)).join(durations, "video_id", "left")
    rules = F.array_compact(F.array(F.when(F.col("start_time") < 0, F.lit("NEGATIVE_START")), F.when(F.col("end_time") <= F.col("start_time"), F.lit("EMPTY")), F.when(F.col("start_time") < F.col("last"), F.lit("ORDER")),
                                    F.when(F.col("end_time") > F.col("duration_sec") + slack, F.lit("BEYOND_END"))))
    return rows.select("segment_id", F.explode(rules).alias("rule"))


def bounds_violations(keyframes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keyframes beyond their video's frame count or duration."""
    rows = keyframes.join(manifest, "video_id")
    return rows.where((F.col("frame_idx") < 0) | (F.col("frame_idx") >= F.col("frame_count")) | (F.col("pts_time") < 0) | (F.col("pts_time") > F.col("duration_sec")))


def coverage_violations(keyframes: DataFrame, shots: DataFrame) -> DataFrame:
    """(shot_id, rule): shots without a keyframe, and shots of keyframes that are not listed."""
    k, s = keyframes.select("shot_id").distinct(), shots.select("shot_id").distinct()
    return s.join(k, "shot_id", "left_anti").withColumn("rule", F.lit("NO_KEYFRAME")).unionByName(k.join(s, "shot_id", "left_anti").withColumn("rule", F.lit("UNKNOWN_SHOT")))


def extraction_report(shots: DataFrame, keyframes: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """Per video: shots, keyframes, shot lengths, qualities, coverage of shots by keyframes, rate and a pass flag."""
    s = shots.groupBy("video_id").agg(F.count("*").alias("shots"), F.min("duration_sec").alias("min_shot"), F.round(F.percentile("duration_sec", F.lit(0.5)), 6).alias("median_shot"), F.max("duration_sec").alias("max_shot"),
                                      (F.max("end_time") - F.min("start_time")).alias("span"))
    k = keyframes.groupBy("video_id").agg(F.count("*").alias("keyframes"), F.countDistinct("shot_id").alias("covered"), F.round(F.percentile("quality_score", F.lit(0.5)), 6).alias("median_quality"), F.count_if("quality_fallback").alias("fallbacks"))
    rows = s.join(k, "video_id", "left").withColumns({"coverage": F.round(F.coalesce("covered", F.lit(0)) / F.col("shots"), 6), "per_minute": F.round(60 * F.coalesce("keyframes", F.lit(0)) / F.greatest("span", F.lit(1e-9)), 6)})
    return rows.withColumn("passed", F.col("coverage") >= least_coverage).drop("covered", "span")


def transcript_summary(segments: DataFrame) -> DataFrame:
    """Per video: segments, seconds of speech, words, mean log-probability, low-confidence and likely silent segments."""
    return segments.groupBy("video_id").agg(
        F.count("*").alias("segments"), F.round(F.sum(F.col("end_time") - F.col("start_time")), 6).alias("speech_sec"), F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))).alias("words"),
        F.round(F.avg("avg_logprob"), 6).alias("mean_logprob"), F.count_if(F.col("avg_logprob") < -1.0).alias("low_confidence"), F.count_if(F.col("no_speech_prob") > 0.5).alias("high_no_speech"))


def lowest_segments(segments: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` segments of lowest log-probability of each video."""
    by = Window.partitionBy("video_id").orderBy("avg_logprob", "segment_id")
    return segments.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


# Fixed value: what stations lay over every frame, without white space, in upper case.
STATIC_OVERLAY = r"^(HTV[\p{L}\p{N}_]*|TV|HD|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|LIVE|TRỰCTIẾP)$"
# Five times the same letter or digit of a folded text in a row, for engines without back references.
STUTTER = "|".join(c * 5 for c in "abcdefghijklmnopqrstuvwxyz0123456789")


def ocr_line_filter(lines: DataFrame, least: float = 0.45) -> DataFrame:
    """Lines of enough confidence that read like text: two letters or digits at least, and these the greater part, no static
    overlay, no character five times in a row; with their folded text (key), worked out once. With columns box_width, box_height and frame_height (pixels), boxes are 10 wide
    and 8 high at least and 0.4 of the frame's height at most."""
    from ..functions.text import fold_key

    plain = F.regexp_replace("text", r"[^\p{L}\p{N}]", "")
    static = F.upper(F.regexp_replace("text", r"(?U)\s+", "")).rlike(STATIC_OVERLAY)
    keep = (F.col("confidence") >= least) & (F.length(plain) >= 2) & (F.length(plain) >= 0.5 * F.length(F.regexp_replace("text", r"\s", ""))) & ~static
    if {"box_width", "box_height", "frame_height"} <= set(lines.columns):
        keep = (F.col("confidence") >= least) & (F.col("box_width") >= 10) & (F.col("box_height") >= 8) & (F.col("box_height") <= 0.40 * F.col("frame_height")) & keep
    # A generator, unlike a projection, is not worked out again in the filter behind it.
    keyed = lines.where(keep).select(*lines.columns, F.explode(F.array(fold_key(F.col("text")))).alias("key"))
    return keyed.where(~F.col("key").rlike(r"([a-z0-9])\1{4}"))


def _keyed(lines: DataFrame) -> DataFrame:
    from ..functions.text import fold_key

    return (lines if "key" in lines.columns else lines.withColumn("key", fold_key(F.col("text")))).where("key <> ''")


def ocr_frame_dedupe(lines: DataFrame) -> DataFrame:
    """The most confident line of each folded text in a frame, in reading order."""
    keyed = _keyed(lines)
    best = Window.partitionBy("keyframe_id", "key").orderBy(F.desc("confidence"), "position")
    kept = keyed.withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy("keyframe_id").orderBy("position"))).drop("__r")


def ocr_shot_merge(lines: DataFrame) -> DataFrame:
    """Per shot and folded text: frames that show it and its best reading, ordered by support, confidence and key."""
    keyed = _keyed(lines)
    grouped = keyed.groupBy("shot_id", "key").agg(F.countDistinct("keyframe_id").alias("support"), F.max(F.struct("confidence", (-F.col("keyframe_id")).alias("k"), (-F.col("position")).alias("p"), "text")).alias("best"))
    rows = grouped.select("shot_id", "key", "support", F.col("best.text").alias("text"), F.col("best.confidence").alias("confidence"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("shot_id").orderBy(F.desc("support"), F.desc("confidence"), "key")))


def error_gate(rows: DataFrame, is_error: Column, most: float = 0.10) -> DataFrame:
    """One row: rows, errors, rate and whether the rate is low enough."""
    n = rows.agg(F.count("*").alias("rows"), F.count_if(is_error).alias("errors"))
    return n.withColumn("rate", F.round(F.col("errors") / F.greatest("rows", F.lit(1)), 6)).withColumn("passed", F.col("rate") <= most)
