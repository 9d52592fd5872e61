"""Temporal and document-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO  # noqa: F401
from ..operators import documents, temporal
from . import fixtures as X
from .fixtures import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SPEECH_SQL = f"""near AS (SELECT k.keyframe_id, lower(said) AS folded, min({{{{'low': low, 'said': said}}}}) AS first FROM keyframes k JOIN (
 SELECT video_id, least(start_time, end_time) - 1.5::DOUBLE AS low, greatest(start_time, end_time) + 1.5::DOUBLE AS high, {CLEAN.format("text")} AS said FROM speech) s
 ON s.video_id = k.video_id AND k.pts_time BETWEEN low AND high WHERE said <> '' GROUP BY 1, 2),
sp AS (SELECT keyframe_id, rtrim(substr(string_agg(first.said, ' ' ORDER BY first.low, folded), 1, 1200)) AS asr_text FROM near GROUP BY 1)""".replace("{{", "{").replace("}}", "}")


@query(with_views("keyframes", "speech", body="," + SPEECH_SQL + " SELECT k.keyframe_id, coalesce(asr_text, '') AS asr_text FROM keyframes k LEFT JOIN sp USING (keyframe_id)"))
def interval_join_speech(spark, d):
    return temporal.interval_join(X.keyframes(spark, d), X.speech(spark, d))


@query(with_views("keyframes", "speech", body="""SELECT segment_id, s.video_id, arg_min(k.keyframe_id, {'a': abs(pts_time - start_time), 'b': k.keyframe_id}) AS keyframe_id, round(min(abs(pts_time - start_time)), 6) AS gap
FROM speech s LEFT JOIN keyframes k ON k.video_id = s.video_id AND pts_time BETWEEN start_time AND end_time GROUP BY 1, 2"""))
def nearest_keyframe(spark, d):
    return temporal.nearest_inside(X.speech(spark, d), X.keyframes(spark, d)).withColumn("gap", F.round("gap", 6))


@query(with_views("keyframes", body=""", c AS (SELECT shot_id, frame_idx AS c_frame, event_type AS caption FROM keyframes WHERE event_id % 5 = 0),
n AS (SELECT keyframe_id, caption, c_frame, abs(frame_idx - c_frame) AS gap, row_number() OVER (PARTITION BY keyframe_id ORDER BY abs(frame_idx - c_frame), c_frame, caption) AS r FROM keyframes k LEFT JOIN c USING (shot_id))
SELECT keyframe_id, caption, coalesce(c_frame, -1) AS source_frame, CASE WHEN c_frame IS NULL THEN 'evidence_only' WHEN gap = 0 THEN 'direct' ELSE 'propagated' END AS caption_source FROM n WHERE r = 1"""))
def caption_propagation(spark, d):
    k = X.keyframes(spark, d)
    return temporal.propagate_captions(k, k.where("event_id % 5 = 0").select("shot_id", "frame_idx", F.col("event_type").alias("caption"))).withColumn("source_frame", F.coalesce("source_frame", F.lit(-1)))


EDGES_SQL = """e AS (SELECT video_id, shot_id AS source, lag(shot_id) OVER w AS target, 'AFTER' AS relation, greatest(0.0, start_time - lag(end_time) OVER w) AS gap_sec FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY shot_index)
 UNION ALL SELECT video_id, shot_id, lead(shot_id) OVER w, 'NEXT', greatest(0.0, lead(start_time) OVER w - end_time) FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY shot_index))"""


@query(with_views("shots", body=f", {EDGES_SQL} SELECT video_id, source, target, relation, round(gap_sec, 6) AS gap_sec FROM e WHERE target IS NOT NULL AND gap_sec <= 3"))
def temporal_edges(spark, d):
    return temporal.temporal_edges(X.shots(spark, d)).withColumn("gap_sec", F.round("gap_sec", 6))


PACK_SQL = """ord AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY shot_index) AS i FROM shots),
walk AS (SELECT video_id, i, shot_id, start_time AS first, end_time AS last, 0 AS event_no FROM ord WHERE i = 1
 UNION ALL SELECT o.video_id, o.i, o.shot_id, CASE WHEN o.end_time - w.first <= 30 THEN w.first ELSE o.start_time END, CASE WHEN o.end_time - w.first <= 30 THEN greatest(w.last, o.end_time) ELSE o.end_time END,
  CASE WHEN o.end_time - w.first <= 30 THEN w.event_no ELSE w.event_no + 1 END FROM walk w JOIN ord o ON o.video_id = w.video_id AND o.i = w.i + 1),
ev AS (SELECT video_id, event_no, min(first) AS start_time, max(last) AS end_time, string_agg(shot_id, ',' ORDER BY i) AS shot_ids, CAST(count(*) AS INTEGER) AS shot_count FROM walk GROUP BY ALL)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_views("shots", body=f", {PACK_SQL} SELECT * FROM ev")))
def event_packing(spark, d):
    return temporal.pack_events(X.shots(spark, d)).withColumn("shot_ids", F.array_join("shot_ids", ","))


@query(with_views("shots", body=""", f AS (SELECT *, CASE WHEN duration_sec >= 0.6 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS keep FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY shot_index)),
p AS (SELECT *, CAST(sum(keep) OVER (PARTITION BY video_id ORDER BY shot_index) AS BIGINT) AS part FROM f) SELECT video_id, part, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS merged FROM p GROUP BY ALL"""))
def merge_short_shots(spark, d):
    return temporal.merge_short_shots(X.shots(spark, d))


@query(with_views("shots", body=""", p AS (SELECT *, CAST(greatest(1, least(24, ceil(duration_sec / 1.25::DOUBLE))) AS INTEGER) AS n FROM shots), i AS (SELECT *, unnest(range(0, n)) AS i FROM p)
SELECT DISTINCT video_id, shot_id, CAST(start_frame + floor(CASE WHEN n > 1 THEN CAST((end_frame - start_frame) * i AS DOUBLE) / (n - 1) ELSE 0 END) AS BIGINT) AS frame_idx FROM i"""))
def frame_plan(spark, d):
    return temporal.frame_plan(X.shots(spark, d))


def _with_windows(spark, d):
    k = X.keyframes(spark, d)
    s = X.shots(spark, d).select("shot_id", "start_frame")
    return k.join(s, "shot_id").withColumn("window_no", temporal.sub_window(F.col("frame_idx"), F.col("start_frame"), F.col("fps")))


@query(with_views("keyframes", "shots", body="SELECT keyframe_id, CAST(floor((frame_idx - start_frame) / (5.0::DOUBLE * fps)) AS BIGINT) AS window_no FROM keyframes JOIN shots USING (shot_id)"))
def shot_windows(spark, d):
    return _with_windows(spark, d).select("keyframe_id", "window_no")


@query(with_views("keyframes", body=""", dec AS (SELECT video_id, frame_idx, max(pts_time) + max(CASE WHEN frame_idx % 7 = 0 THEN 0.9::DOUBLE ELSE 0.01::DOUBLE END) AS t FROM keyframes WHERE frame_idx % 3 <> 0 GROUP BY 1, 2)
SELECT keyframe_id, round(abs(pts_time - t), 6) AS error, coalesce(abs(pts_time - t) <= 0.5, false) AS aligned FROM keyframes k LEFT JOIN dec d ON d.video_id = k.video_id AND d.frame_idx = k.frame_idx"""))
def checkpoint_alignment(spark, d):
    k = X.keyframes(spark, d)
    decoded = k.where("frame_idx % 3 <> 0").groupBy("video_id", "frame_idx").agg((F.max("pts_time") + F.when(F.col("frame_idx") % 7 == 0, 0.9).otherwise(0.01)).alias("pts_time"))
    return temporal.checkpoint_alignment(k, decoded, 0.5).select("keyframe_id", F.round("error", 6).alias("error"), "aligned")


@query(with_views("keyframes", body=""", n AS (SELECT keyframe_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY pts_time, keyframe_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS c FROM keyframes)
SELECT keyframe_id, video_id FROM n WHERE c <= 7 OR list_contains([CAST(floor(j * (c - 1) / 6) AS BIGINT) FOR j IN range(0, 7)], i)"""))
def even_sample(spark, d):
    return temporal.even_sample(X.keyframes(spark, d), 7, "video_id", ["pts_time", "keyframe_id"]).select("keyframe_id", "video_id")


@query(with_views("keyframes", body=""", p AS (SELECT *, ntile(4) OVER (PARTITION BY video_id ORDER BY pts_time, keyframe_id) AS part FROM keyframes)
SELECT video_id, CAST(part AS INTEGER) AS part, keyframe_id FROM p QUALIFY row_number() OVER (PARTITION BY video_id, part ORDER BY quality_score DESC, pts_time, keyframe_id) = 1"""))
def limit_by_split(spark, d):
    return temporal.best_of_splits(X.keyframes(spark, d), 4, "video_id", ["pts_time", "keyframe_id"]).select("video_id", "part", "keyframe_id")


@query(with_views("keyframes", "shots", body=""", c AS (SELECT shot_id, abs(quality_score - lag(quality_score) OVER (PARTITION BY shot_id ORDER BY frame_idx, keyframe_id)) AS ch FROM keyframes),
m AS (SELECT shot_id, coalesce(avg(ch), 0) AS motion FROM c GROUP BY 1)
SELECT shot_id, round(motion, 6) AS motion_score, CAST(least(4, CASE WHEN duration_sec <= 4 THEN 1 WHEN duration_sec <= 12 THEN 2 ELSE 3 END + CASE WHEN round(motion, 6) >= 0.12 AND duration_sec >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS budget FROM m JOIN shots USING (shot_id)"""))
def keyframe_budgets(spark, d):
    from ..functions.geometry import keyframe_budget
    m = temporal.motion_scores(X.keyframes(spark, d), "quality_score").withColumn("motion_score", F.round("motion_score", 6))
    return m.join(X.shots(spark, d).select("shot_id", "duration_sec"), "shot_id").select("shot_id", "motion_score", keyframe_budget(F.col("duration_sec"), F.col("motion_score")).alias("budget"))


@query(with_views("shots", body=" SELECT shot_id, CASE WHEN duration_sec <= 3 THEN 1 WHEN duration_sec <= 10 THEN 2 WHEN duration_sec <= 25 THEN 3 ELSE 4 END AS most FROM shots"))
def keyframe_limits(spark, d):
    """Keyframes of each shot by its length alone."""
    from ..functions.geometry import keyframe_limit
    return X.shots(spark, d).select("shot_id", keyframe_limit(F.col("duration_sec")).alias("most"))


OBJECTS_SQL = """fo0 AS (SELECT keyframe_id, class_name, count(*) AS n, min(detection_id) AS first FROM detections GROUP BY ALL),
fo AS (SELECT k.keyframe_id, coalesce(list(class_name ORDER BY first) FILTER (class_name IS NOT NULL), []) AS labels, list(class_name || '=' || fo0.n ORDER BY class_name) FILTER (class_name IS NOT NULL) AS counts, CAST(coalesce(sum(fo0.n), 0) AS BIGINT) AS detection_count
 FROM keyframes k LEFT JOIN fo0 USING (keyframe_id) GROUP BY 1)"""
MAP_TEXT = "array_join(transform(array_sort(map_entries(object_counts)), e -> concat(e.key, '=', e.value)), ',')"


@query(with_views("keyframes", "detections", body=f", {OBJECTS_SQL} SELECT keyframe_id, array_to_string(labels, ',') AS labels, coalesce(array_to_string(counts, ','), '') AS object_counts, detection_count FROM fo"))
def frame_object_summary(spark, d):
    o = documents.frame_objects(X.keyframes(spark, d), X.detections(spark, d))
    return o.select("keyframe_id", F.array_join("labels", ",").alias("labels"), F.expr(MAP_TEXT).alias("object_counts"), "detection_count")


@query(with_views("detections", body="SELECT class_name, count(*) AS detections, count(DISTINCT keyframe_id) AS frames, round(avg(confidence), 6) AS mean_confidence FROM detections GROUP BY 1"))
def class_summary(spark, d):
    return documents.class_summary(X.detections(spark, d))


@query(with_views("detections", body="SELECT keyframe_id, array_to_string(list_sort(list_distinct(list(class_name))), ', ') AS labels, round(max(confidence), 6) AS confidence FROM detections WHERE confidence >= 0.25 AND lower(class_name) IN ('click', 'purchase', 'view') GROUP BY 1"))
def trusted_objects(spark, d):
    kept = documents.trusted_detections(X.detections(spark, d), ["Click", "Purchase", "View"], 0.25)
    return kept.groupBy("keyframe_id").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ", ").alias("labels"), F.round(F.max("confidence"), 6).alias("confidence"))


def frames_of(spark, d, events=None, turns=None):
    """Frame documents of ``events`` and ``turns`` of speech, or of all."""
    k = X.keyframes(spark, d, events)
    speech = temporal.interval_join(k, X.speech(spark, d, turns))
    text = k.select("keyframe_id", F.concat_ws(" ", "event_type", F.floor(F.col("value") / 50)).alias("scene_text"), F.col("event_type").alias("text"))
    caption = k.where("event_id % 9 = 0").select("keyframe_id", F.concat(F.lit("clip "), "event_type").alias("caption"))
    return documents.frame_documents(k, text, documents.frame_objects(k, X.detections(spark, d, events)), speech, caption)


#: Distinct texts of a list by folded case, in order.
UNIQ = "array_to_string(list_slice(list_filter({0}, lambda t, i: t <> '' AND list_position([lower(x) FOR x IN {0}], lower(t)) = i), 1, {1}), ' ')"
FRAMES_SQL = SPEECH_SQL + ", " + OBJECTS_SQL + f""",
b AS (SELECT k.keyframe_id, k.video_id, k.shot_id, frame_idx, pts_time, labels, event_type || ' ' || CAST(floor(value / 50) AS BIGINT) AS scene, event_type AS ticker, coalesce(trim(asr_text), '') AS speech, CASE WHEN event_id % 9 = 0 THEN 'clip ' || event_type END AS direct
 FROM keyframes k JOIN fo USING (keyframe_id) LEFT JOIN sp USING (keyframe_id)),
c AS (SELECT *, coalesce(direct, concat_ws(' ', CASE WHEN len(labels) > 0 THEN 'có ' || array_to_string(list_slice(labels, 1, 8), ', ') END, 'chữ nhìn thấy: ' || substr(scene, 1, 240), CASE WHEN speech <> '' THEN 'lời thoại: ' || substr(speech, 1, 240) END)) AS caption FROM b),
e AS (SELECT *, [{CLEAN.format("caption")}, array_to_string(labels, ' '), scene, ticker, speech] AS parts FROM c),
fd AS (SELECT 'frame:' || keyframe_id AS doc_id, keyframe_id, video_id, shot_id, frame_idx, pts_time, caption, {UNIQ.format("parts", 80)} AS search_text, speech AS asr_text, CASE WHEN ticker <> scene THEN ticker ELSE '' END AS ocr_other_text,
 array_to_string(labels, ' ') AS object_labels_text, CASE WHEN direct IS NULL THEN 0.55::DOUBLE ELSE 0.85::DOUBLE END AS confidence, CASE WHEN direct IS NULL THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS propagation_confidence FROM e)"""


@query(with_views("keyframes", "speech", "detections", body="," + FRAMES_SQL + " SELECT doc_id, shot_id, frame_idx, caption, search_text, asr_text, ocr_other_text, object_labels_text, confidence, propagation_confidence FROM fd"))
def frame_documents(spark, d):
    return frames_of(spark, d).select("doc_id", "shot_id", "frame_idx", "caption", "search_text", "asr_text", "ocr_other_text", "object_labels_text", "confidence", "propagation_confidence")


SHOTS_SQL = f""", sg AS (SELECT video_id, shot_id, min(pts_time) AS start_time, max(pts_time) AS end_time, max(confidence) AS confidence, round(avg(propagation_confidence), 6) AS propagation_confidence, count(*) AS frames,
 arg_min(keyframe_id, {{'c': -confidence, 'f': frame_idx, 'k': keyframe_id}}) AS keyframe_id, list({CLEAN.format("caption")} ORDER BY frame_idx, keyframe_id) AS caps, list({CLEAN.format("search_text")} ORDER BY frame_idx, keyframe_id) AS sts FROM fd GROUP BY 1, 2),
sd AS (SELECT *, {UNIQ.format("caps", 4)} AS caption, {UNIQ.format("sts", 100)} AS search_text FROM sg),
mc0 AS (SELECT shot_id, class_name, max(fo0.n) AS n FROM fo0 JOIN keyframes USING (keyframe_id) GROUP BY 1, 2), mc AS (SELECT shot_id, string_agg(class_name || '=' || n, ',' ORDER BY class_name) AS object_counts FROM mc0 GROUP BY 1)"""


@query(with_views("keyframes", "speech", "detections", body="," + FRAMES_SQL + SHOTS_SQL + " SELECT 'shot:' || shot_id AS doc_id, keyframe_id, start_time, end_time, caption, search_text, object_counts, confidence, propagation_confidence, frames FROM sd JOIN mc USING (shot_id)"))
def shot_documents(spark, d):
    s = documents.shot_documents(frames_of(spark, d))
    return s.select("doc_id", "keyframe_id", "start_time", "end_time", "caption", "search_text", F.expr(MAP_TEXT).alias("object_counts"), "confidence", F.round("propagation_confidence", 6).alias("propagation_confidence"), "frames")


@query(recursive(with_views("keyframes", "speech", "detections", "shots", body="," + FRAMES_SQL + SHOTS_SQL + ", " + PACK_SQL + f""",
mem AS (SELECT w.video_id, w.event_no, w.i, sd.* EXCLUDE (video_id, start_time, end_time) FROM walk w LEFT JOIN sd ON sd.shot_id = w.shot_id),
eg AS (SELECT video_id, event_no, list(caption ORDER BY i) AS caps, list(search_text ORDER BY i) AS sts, arg_min(keyframe_id, i) AS keyframe_id, max(confidence) AS confidence, count(*) AS shots FROM mem GROUP BY 1, 2)
SELECT 'event:' || eg.video_id || ':' || eg.event_no AS doc_id, keyframe_id, start_time, end_time, {UNIQ.format("caps", 8)} AS caption, {UNIQ.format("sts", 150)} AS search_text, confidence, shots FROM eg JOIN ev USING (video_id, event_no)""")))
def event_documents(spark, d):
    e = documents.event_documents(temporal.pack_events(X.shots(spark, d)), documents.shot_documents(frames_of(spark, d)))
    return e.select("doc_id", "keyframe_id", "start_time", "end_time", "caption", "search_text", "confidence", "shots")


@query("SELECT facet, count(doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('vi')) o(facet) LEFT JOIN documents ON lang = facet GROUP BY 1")
def scene_facets(spark, d):
    options = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "vi")], "facet string")
    return documents.facet_counts(X.search_documents(spark, d), options)


AREA = "(greatest(x2 - x1, 0) * greatest(y2 - y1, 0))"


@query(with_views("detections", body=f""", p AS (SELECT keyframe_id, class_name, round(max(confidence * (0.45::DOUBLE + 0.55::DOUBLE * sqrt({AREA})) * (1 - 0.35::DOUBLE * least(1.0, sqrt(pow((x1 + x2) / 2 - 0.5::DOUBLE, 2) + pow((y1 + y2) / 2 - 0.5::DOUBLE, 2)) / sqrt(0.5::DOUBLE)))), 6) AS prominence FROM detections GROUP BY 1, 2)
SELECT keyframe_id, string_agg(class_name, ', ' ORDER BY prominence DESC, class_name) AS hints, max(prominence) AS top_prominence FROM p GROUP BY 1"""))
def object_hints(spark, d):
    return documents.object_hints(X.detections(spark, d))


@query(with_views("keyframes", "detections", body=f", {OBJECTS_SQL}" + """, f AS (SELECT k.keyframe_id, k.shot_id, frame_idx, quality_score, list_distinct(labels) AS labels, [event_type, 'w' || CAST(floor(value / 20) AS BIGINT)] AS words, detection_count / 10.0::DOUBLE AS prominence FROM keyframes k JOIN fo USING (keyframe_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY round(0.55::DOUBLE * quality_score + 0.30::DOUBLE * prominence + 0.15::DOUBLE, 6) DESC, frame_idx, keyframe_id) AS place FROM f),
j AS (SELECT r.*, round(greatest((1 - len(list_intersect(r.labels, h.labels)) / len(list_distinct(list_concat(r.labels, h.labels)))) / 0.45::DOUBLE, (1 - len(list_intersect(r.words, h.words)) / len(list_distinct(list_concat(r.words, h.words)))) / 0.65::DOUBLE), 6) AS novelty
 FROM r JOIN r h ON r.shot_id = h.shot_id AND h.place = 1)
SELECT shot_id, keyframe_id, 1 AS pick, 0.0::DOUBLE AS novelty FROM j WHERE place = 1
UNION ALL SELECT shot_id, keyframe_id, CAST(p AS INTEGER), novelty FROM (SELECT *, 1 + row_number() OVER (PARTITION BY shot_id ORDER BY novelty DESC, frame_idx, keyframe_id) AS p FROM j WHERE place > 1 AND novelty >= 1) WHERE p <= 3"""))
def novelty_selection(spark, d):
    k = X.keyframes(spark, d)
    o = documents.frame_objects(k, X.detections(spark, d))
    frames = k.join(o, "keyframe_id").withColumns({"words": F.array(F.col("event_type"), F.concat(F.lit("w"), F.floor(F.col("value") / 20))), "prominence": F.col("detection_count") / 10.0})
    return documents.novelty_selection(frames, 3)


@query(with_views("keyframes", "shots", body="SELECT s.shot_id FROM shots s WHERE s.shot_id NOT IN (SELECT shot_id FROM keyframes WHERE event_type = 'view')"))
def shots_without_keyframes(spark, d):
    return X.shots(spark, d).join(X.keyframes(spark, d).where("event_type = 'view'"), "shot_id", "left_anti").select("shot_id")
