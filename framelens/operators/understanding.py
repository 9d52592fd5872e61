"""Model captions as JSON, cleaned, and the rich frame documents made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_distinct, normalize_text
from .documents import crosscheck_scene
from .temporal import propagate_captions

# What a caption's fields may hold.
CATEGORIES = ["person", "animal", "food", "vegetable", "fruit", "vehicle", "object", "text", "other"]
GENDERS = ["male_presenting", "female_presenting", "unknown", "not_applicable"]
AGES = ["child", "adult", "older_adult", "unknown", "not_applicable"]
PROMINENCES = ["primary", "secondary", "background"]
ENVIRONMENTS = ["indoor", "outdoor", "unknown"]
TIMES = ["daytime", "night", "unknown"]
WEATHERS = ["rain", "sunny", "unknown"]
SCENE_WORDS = {"daytime": "ban ngày", "night": "ban đêm", "rain": "trời mưa", "sunny": "trời nắng", "indoor": "trong nhà", "outdoor": "ngoài trời"}
# Fixed value: weight of text in the ticker zone, which is kept apart from the search text.
TICKER_WEIGHT = 0.15

_SUBJECT = ("name_en string, name_vi string, category string, species_en string, species_vi string, dominant_colors array<string>, count string, action_vi string, prominence string, "
            "apparent_gender_presentation string, age_group string, confidence string")
_CAPTION = (f"caption_vi string, main_subjects array<struct<{_SUBJECT.replace(' ', ':').replace(',:', ',')}>>, visible_text array<string>, actions_vi array<string>, environment string, time_of_day string, "
            "weather string, search_text_vi string, confidence string")


def _text(c: Column) -> Column:
    return normalize_text(F.coalesce(c, F.lit("")))


def enum_value(c: Column, allowed: list[str], default: Column | str = "unknown") -> Column:
    """The value in lower case with underscores if it is allowed, else the default."""
    value = F.replace(F.lower(_text(c)), F.lit(" "), F.lit("_"))
    return F.when(value.isin(allowed), value).otherwise(F.lit(default) if isinstance(default, str) else default)


def share(c: Column) -> Column:
    """A number brought to 0..1; 0 for what is no finite number."""
    number = c.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def clean_strings(c: Column, limit: int = 12) -> Column:
    """Distinct texts in order, blank ones left out, at most ``limit``."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _text), lambda t: t != "")), 1, limit)


def _subject(s: Column) -> Column:
    category = enum_value(s["category"], CATEGORIES, "other")
    other = F.when(category == "person", F.lit("unknown")).otherwise(F.lit("not_applicable"))
    count = s["count"].try_cast("int")
    return F.struct(
        _text(s["name_en"]).alias("name_en"), _text(s["name_vi"]).alias("name_vi"), category.alias("category"), _text(s["species_en"]).alias("species_en"), _text(s["species_vi"]).alias("species_vi"),
        clean_strings(s["dominant_colors"], 4).alias("dominant_colors"), F.when(count.isNotNull(), F.greatest(F.lit(1), count)).alias("count"), _text(s["action_vi"]).alias("action_vi"),
        enum_value(s["prominence"], PROMINENCES, "secondary").alias("prominence"), enum_value(s["apparent_gender_presentation"], GENDERS, other).alias("apparent_gender_presentation"),
        enum_value(s["age_group"], AGES, other).alias("age_group"), share(s["confidence"]).alias("confidence"))


def parse_caption(raw: Column) -> Column:
    """The caption in a model's answer, cleaned: the JSON object between the first and the last brace, code fences or not.
    Unknown values become defaults; null where there is no object."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    v = F.from_json(F.nullif(body, F.lit("")), _CAPTION)
    subjects = F.transform(F.slice(F.coalesce(v["main_subjects"], F.array()), 1, 8), _subject)
    made = F.struct(
        _text(v["caption_vi"]).alias("caption"), subjects.alias("main_subjects"), clean_strings(v["visible_text"]).alias("visible_text"), clean_strings(v["actions_vi"]).alias("actions"),
        enum_value(v["environment"], ENVIRONMENTS).alias("environment"), enum_value(v["time_of_day"], TIMES).alias("time_of_day"), enum_value(v["weather"], WEATHERS).alias("weather"),
        _text(v["search_text_vi"]).alias("search_text"), share(v["confidence"]).alias("confidence"))
    return F.when(v.isNotNull() & (body != ""), made)


def subject_words(subjects: Column) -> Column:
    """Names, species, actions and colours of the subjects, each once."""
    fields = lambda s: F.concat(F.array(*[s[c] for c in ("name_vi", "species_vi", "name_en", "species_en", "action_vi")]), s["dominant_colors"])
    return F.array_distinct(F.filter(F.flatten(F.transform(subjects, fields)), lambda t: t != ""))


def understanding_documents(keyframes: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One rich document for each keyframe (keyframe_id, video_id, shot_id, frame_idx, pts_time).

    ``answers``: (keyframe_id, raw), models' answers of some keyframes; others take the caption of the nearest captioned frame
    of their shot, or none. ``evidence``: (keyframe_id, ocr_text, ocr_scene_text, ocr_ticker_text, object_labels). Scene facets are
    corrected by cues in the caption. Search text: caption, its search words, subjects, text and actions seen, scene text,
    objects and scene words, each once; text of the ticker stays apart, with its weight."""
    told = keyframes.join(answers, "keyframe_id").withColumn("told", parse_caption(F.col("raw"))).where("told IS NOT NULL").select("keyframe_id", "shot_id", "frame_idx", "told")
    near = propagate_captions(keyframes, told.select("shot_id", "frame_idx", F.col("keyframe_id").alias("caption")))
    near = near.select("keyframe_id", F.col("caption").alias("source_keyframe_id"), F.when(F.col("caption_source") == "direct", "vlm").otherwise(F.col("caption_source")).alias("description_source"))
    rows = keyframes.join(near, "keyframe_id").join(told.select(F.col("keyframe_id").alias("source_keyframe_id"), "told"), "source_keyframe_id", "left").join(evidence, "keyframe_id", "left")
    blank, none = F.lit(""), F.array().cast("array<string>")
    for name in ("caption", "search_text"):
        rows = rows.withColumn(name, F.coalesce(F.col(f"told.{name}"), blank))
    for name in ("visible_text", "actions"):
        rows = rows.withColumn(name, F.coalesce(F.col(f"told.{name}"), none))
    for name in ("environment", "time_of_day", "weather"):
        rows = rows.withColumn(name, F.coalesce(F.col(f"told.{name}"), F.lit("unknown")))
    rows = rows.withColumns({"subjects": F.coalesce(subject_words(F.col("told.main_subjects")), none), "labels": F.coalesce("object_labels", none), "confidence": F.coalesce("told.confidence", F.lit(0.0)),
                             **{c: F.coalesce(c, blank) for c in ("ocr_text", "ocr_scene_text", "ocr_ticker_text")}})
    rows = crosscheck_scene(rows)
    scenes = F.array_distinct(F.filter(F.array("time_of_day", "weather", "environment"), lambda v: v.isin(list(SCENE_WORDS))))
    word = F.create_map(*[F.lit(x) for pair in SCENE_WORDS.items() for x in pair])
    rows = rows.withColumn("scene_labels", scenes)
    spoken = F.array_join(F.transform("scene_labels", lambda s: word[s]), " ")
    parts = F.concat(F.array("caption", "search_text"), F.col("subjects"), F.col("visible_text"), F.col("actions"), F.array(F.col("ocr_scene_text"), F.array_join("labels", " "), spoken))
    return rows.select("keyframe_id", "video_id", "shot_id", "frame_idx", "pts_time", "caption", join_distinct(parts, 1000).alias("search_text"), "environment", "time_of_day", "weather", "scene_labels",
                       F.col("notes").alias("scene_crosscheck"), "subjects", "confidence", "ocr_text", "ocr_scene_text", "ocr_ticker_text", F.lit(TICKER_WEIGHT).alias("ocr_ticker_weight"),
                       "description_source", "source_keyframe_id")
