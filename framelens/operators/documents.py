"""Frame, shot and event documents from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import prominence
from ..functions.text import evidence_caption, join_distinct, normalize_text, scene_labels


def ordered_texts(order: list[str], text: str) -> Column:
    """Texts of a group in order, as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"])


def frame_objects(keyframes: DataFrame, detections: DataFrame) -> DataFrame:
    """Per keyframe: labels in order of detection, counts by label and number of detections; frames without any stay."""
    n = detections.where("class_name IS NOT NULL AND trim(class_name) <> ''").groupBy("keyframe_id", "class_name").agg(F.count("*").alias("n"), F.min("detection_id").alias("first"))
    per = n.groupBy("keyframe_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "class_name"))), lambda x: x["class_name"]).alias("labels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("object_counts"), F.sum("n").alias("detection_count"))
    return keyframes.select("keyframe_id").join(per, "keyframe_id", "left").select(
        "keyframe_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("object_counts", F.create_map().cast("map<string,bigint>")).alias("object_counts"), F.coalesce("detection_count", F.lit(0)).alias("detection_count"))


def frame_documents(keyframes: DataFrame, ocr: DataFrame, objects: DataFrame, speech: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """One document for each keyframe, from its text on screen (keyframe_id, scene_text, text), objects
    (``frame_objects``), speech (keyframe_id, asr_text) and, where there is one, a direct caption (keyframe_id, caption).

    With a direct caption confidence is 0.85 and propagation 1.0; without, the caption is made from the evidence, with
    0.55 and 0.75. Search text: caption, entities, scene text, all text and speech, each once."""
    blank = F.lit("")
    rows = keyframes.join(ocr, "keyframe_id", "left").join(objects, "keyframe_id", "left").join(speech, "keyframe_id", "left")
    rows = rows.join(captions.withColumnRenamed("caption", "direct"), "keyframe_id", "left") if captions is not None else rows.withColumn("direct", F.lit(None).cast("string"))
    rows = rows.withColumns({"scene": normalize_text(F.coalesce("scene_text", blank)), "ticker": normalize_text(F.coalesce("text", blank)), "speech": normalize_text(F.coalesce("asr_text", blank)),
                             "labels": F.coalesce("labels", F.array().cast("array<string>"))})
    rows = rows.withColumn("scenes", scene_labels(F.concat_ws(" ", "scene", "speech")))
    rows = rows.withColumn("caption", F.coalesce(F.nullif("direct", blank), evidence_caption(F.col("scene"), F.col("speech"), F.col("labels"), F.col("scenes"))))
    entities = join_distinct(F.concat(F.array(F.array_join("labels", " ")), F.col("scenes")), 24)
    rows = rows.withColumn("entities", entities)
    direct = F.col("direct").isNotNull() & (F.col("direct") != "")
    return rows.select(
        F.concat(F.lit("frame:"), "keyframe_id").alias("doc_id"), F.lit("frame").alias("level"), "keyframe_id", "video_id", "shot_id", "frame_idx", "pts_time", "caption",
        join_distinct(F.array("caption", "entities", "scene", "ticker", "speech"), 80).alias("search_text"), F.col("speech").alias("asr_text"), F.col("ticker").alias("ocr_text"),
        F.col("scene").alias("ocr_scene_text"), F.when(F.col("ticker") != F.col("scene"), F.col("ticker")).otherwise(blank).alias("ocr_other_text"), F.array_join("labels", " ").alias("object_labels_text"),
        "object_counts", F.array_sort(F.array_distinct("scenes")).alias("scene_labels"), F.when(direct, "caption").otherwise("evidence").alias("description_source"),
        F.when(direct, 0.85).otherwise(0.55).alias("confidence"), F.when(direct, 1.0).otherwise(0.75).alias("propagation_confidence"))


def max_counts(rows: DataFrame, group: list[str], column: str = "object_counts") -> DataFrame:
    """Greatest count of each label over a group's rows, so a repeated frame does not count twice."""
    long = rows.select(*group, F.explode(column).alias("label", "n")).groupBy(*group, "label").agg(F.max("n").alias("n"))
    return long.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias(column))


def shot_documents(frames: DataFrame) -> DataFrame:
    """One document for each shot from its frame documents: the most confident frame represents it (ties to the
    earlier), texts are joined in time order, each once, counts are the greatest of any frame."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "frame_idx", "keyframe_id"))
    order = ["frame_idx", "keyframe_id"]
    docs = frames.groupBy("video_id", "shot_id").agg(
        best.alias("best"), F.min("pts_time").alias("start_time"), F.max("pts_time").alias("end_time"), F.avg("propagation_confidence").alias("propagation_confidence"), F.max("confidence").alias("confidence"),
        join_distinct(ordered_texts(order, "caption"), 4).alias("caption"), join_distinct(ordered_texts(order, "search_text"), 100).alias("search_text"), join_distinct(ordered_texts(order, "asr_text"), 40).alias("asr_text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("scene_labels")))).alias("scene_labels"), F.count("*").alias("frames"))
    docs = docs.join(max_counts(frames, ["shot_id"]), "shot_id", "left")
    return docs.select(F.concat(F.lit("shot:"), "shot_id").alias("doc_id"), F.lit("shot").alias("level"), "video_id", "shot_id", F.col("best.keyframe_id").alias("keyframe_id"), "start_time", "end_time",
                       "caption", "search_text", "asr_text", "object_counts", "scene_labels", "confidence", "propagation_confidence", "frames")


def event_documents(events: DataFrame, shots: DataFrame) -> DataFrame:
    """One document for each event from the documents of its shots, in the event's order."""
    members = events.select("video_id", "event_no", F.col("start_time").alias("e_start"), F.col("end_time").alias("e_end"), F.posexplode("shot_ids").alias("pos", "shot_id"))
    rows = members.join(shots.drop("video_id"), "shot_id", "left")
    docs = rows.groupBy("video_id", "event_no").agg(
        F.first("e_start").alias("start_time"), F.first("e_end").alias("end_time"), F.min(F.struct("pos", "keyframe_id")).alias("head"), join_distinct(ordered_texts(["pos"], "caption"), 8).alias("caption"),
        join_distinct(ordered_texts(["pos"], "search_text"), 150).alias("search_text"), F.max("confidence").alias("confidence"), F.count("*").alias("shots"))
    return docs.select(F.concat_ws(":", F.lit("event"), "video_id", "event_no").alias("doc_id"), F.lit("event").alias("level"), "video_id", "event_no", F.col("head.keyframe_id").alias("keyframe_id"),
                       "start_time", "end_time", "caption", "search_text", "confidence", "shots")


def weighted_text(scene: Column, objects: Column, *others: Column) -> Column:
    """Search text in which scene text and objects stand twice."""
    parts = [scene, scene, objects, objects, *others]
    return F.concat_ws(" ", *[F.nullif(normalize_text(p), F.lit("")) for p in parts])


def facet_counts(docs: DataFrame, options: DataFrame, facet: str = "facet") -> DataFrame:
    """Documents of each facet option; options without any count 0."""
    n = docs.groupBy(F.col(facet).alias("facet")).agg(F.count("*").alias("n"))
    return options.join(n, "facet", "left").select("facet", F.coalesce("n", F.lit(0)).alias("n"))


def class_summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy("class_name").agg(F.count("*").alias("detections"), F.countDistinct("keyframe_id").alias("frames"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def object_hints(detections: DataFrame, k: int = 12) -> DataFrame:
    """The k most prominent labels of each keyframe, each label by its most prominent box."""
    score = prominence(F.col("confidence"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    best = detections.groupBy("keyframe_id", "class_name").agg(F.round(F.max(score), 6).alias("prominence"))
    by = Window.partitionBy("keyframe_id").orderBy(F.desc("prominence"), "class_name")
    top = best.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    return top.groupBy("keyframe_id").agg(F.array_join(ordered_texts(["r"], "class_name"), ", ").alias("hints"), F.max("prominence").alias("top_prominence"))


def with_shots(detections: DataFrame, shots: DataFrame) -> DataFrame:
    """Detections (video_id, frame_idx, ...) with the shot that holds their frame, or none: of shots that overlap the one that
    starts last. Both are sorted by frame once for each video, so no detection meets all of its video's shots."""
    names = [c for c in detections.columns if c != "shot_id"]
    shot = F.struct("shot_id", "end_frame").alias("shot")
    starts = shots.select("video_id", F.col("start_frame").cast("long").alias("at"), shot, F.lit(0).alias("turn"))
    rows = detections.select(F.struct(*names).alias("row"), "video_id", F.col("frame_idx").cast("long").alias("at"), F.lit(1).alias("turn"))
    by = Window.partitionBy("video_id").orderBy("at", "turn", F.col("shot.shot_id"))
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("last", F.last("shot", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("turn = 1").select("row.*", F.when(F.col("at") <= F.col("last.end_frame"), F.col("last.shot_id")).alias("shot_id"))


def trusted_detections(detections: DataFrame, classes: list[str], least: float) -> DataFrame:
    return detections.where((F.col("confidence") >= least) & F.lower("class_name").isin([c.lower() for c in classes]))


def novelty_selection(frames: DataFrame, n: int = 3, object_least: float = 0.45, text_least: float = 0.65) -> DataFrame:
    """Per shot the representative (0.55 quality, 0.30 prominence, 0.15 for text) and up to n - 1 frames whose objects
    or text differ from it by the thresholds, by the greater relative difference."""
    from ..functions.text import jaccard_distance

    score = F.round(0.55 * F.col("quality_score") + 0.30 * F.col("prominence") + 0.15 * (F.size("words") > 0).cast("double"), 6)
    rows = frames.withColumn("base", score)
    by = Window.partitionBy("shot_id").orderBy(F.desc("base"), "frame_idx", "keyframe_id")
    rows = rows.withColumn("place", F.row_number().over(by))
    head = rows.where("place = 1").select("shot_id", F.col("labels").alias("h_labels"), F.col("words").alias("h_words"))
    rows = rows.join(head, "shot_id").withColumn("novelty", F.round(F.greatest(jaccard_distance(F.col("labels"), F.col("h_labels")) / object_least, jaccard_distance(F.col("words"), F.col("h_words")) / text_least), 6))
    others = rows.where((F.col("place") > 1) & (F.col("novelty") >= 1))
    rank = Window.partitionBy("shot_id").orderBy(F.desc("novelty"), "frame_idx", "keyframe_id")
    others = others.withColumn("pick", F.row_number().over(rank) + 1).where(F.col("pick") <= n)
    columns = ["shot_id", "keyframe_id", "pick", "novelty"]
    return rows.where("place = 1").select("shot_id", "keyframe_id", F.lit(1).alias("pick"), F.lit(0.0).alias("novelty")).unionByName(others.select(columns))


# Cues in a caption that decide a scene's facets.
CAPTION_CUES = {
    "indoor": ["phòng", "phòng mổ", "phòng phẫu thuật", "bệnh viện", "studio", "trong nhà", "văn phòng", "lớp học", "nhà bếp", "phòng khách", "hành lang"],
    "outdoor": ["ngoài trời", "đường phố", "cánh đồng", "bờ sông", "con sông", "biển", "bãi biển", "công viên", "rừng", "đồng lúa", "trên thuyền", "kayak"],
    "night": ["ban đêm", "ban tối", "nửa đêm", "nighttime", "at night", "trời tối"],
    "daytime": ["ban ngày", "buổi sáng", "buổi trưa", "daytime", "day light", "ánh nắng", "trời sáng"],
    "rain": ["trời mưa", "đang mưa", "mưa lớn", "mưa to", "rainy", "in the rain"],
    "sunny": ["trời nắng", "nắng rõ", "ánh nắng", "sunny", "bright sunlight"],
    "uncertain_time": ["hoàng hôn", "chạng vạng", "dusk", "twilight"],
}


def crosscheck_scene(rows: DataFrame) -> DataFrame:
    """Facets (environment, time_of_day, weather) corrected by cues in the caption and the actions, with notes of what was
    changed; indoor scenes have no weather."""
    said = F.lower(normalize_text(F.concat_ws(" ", F.col("caption"), F.array_join("actions", " "))))
    rows = rows.withColumn("__said", said)
    has = lambda label: F.col("__said").rlike("|".join(CAPTION_CUES[label]))
    environment = F.when(has("indoor"), "indoor").when(has("outdoor"), "outdoor")
    time = F.when(has("night"), "night").when(has("daytime"), "daytime").when(has("uncertain_time"), "unknown")
    weather = F.when(has("rain"), "rain").when(has("sunny"), "sunny")
    rows = rows.withColumns({"__e": environment, "__t": time, "__w": weather})
    forced = lambda new, old, name: F.when(F.col(new).isNotNull() & ~F.col(new).eqNullSafe(F.col(old)), name)
    time_note = F.when(F.col("__t") == "unknown", F.lit("caption_cleared_uncertain_time")).otherwise(F.concat(F.lit("caption_forced_"), "__t"))
    rows = rows.withColumn("notes", F.array_compact(F.array(forced("__e", "environment", F.concat(F.lit("caption_forced_"), "__e")), forced("__t", "time_of_day", time_note), forced("__w", "weather", F.concat(F.lit("caption_forced_"), "__w")))))
    rows = rows.withColumns({"environment": F.coalesce("__e", "environment"), "time_of_day": F.coalesce("__t", "time_of_day"), "weather": F.coalesce("__w", "weather")})
    cleared = (F.col("environment") == "indoor") & ~F.col("weather").eqNullSafe(F.lit("unknown"))
    rows = rows.withColumn("notes", F.when(cleared, F.concat("notes", F.array(F.lit("indoor_cleared_weather")))).otherwise(F.col("notes")))
    return rows.withColumn("weather", F.when(F.col("environment") == "indoor", F.lit("unknown")).otherwise(F.col("weather"))).drop("__said", "__e", "__t", "__w")
