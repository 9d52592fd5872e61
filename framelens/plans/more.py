"""Contracts, reports, set operations, templates and understanding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, ids
from ..functions.text import compose
from ..operators import documents, enrichment, ledger, lexical, quality, understanding, vectors
from . import fixtures as X
from .enrich import TRANSCRIPTS_SQL, tokens_sql, transcripts
from .fixtures import with_views
from .records import OCR_KEY as FOLD_KEY

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _measured(spark, d):
    """Keyframes with measures of brightness and sharpness."""
    return X.keyframes(spark, d).select("keyframe_id", "shot_id", (F.col("event_id") % 10 / 10.0).alias("black_ratio"), (F.col("event_id") % 7 / 10.0).alias("white_ratio"), F.col("value").alias("sharpness"))


@query(with_views("keyframes", body=" SELECT keyframe_id FROM keyframes WHERE event_id % 10 / 10.0::DOUBLE <= 0.6 AND event_id % 7 / 10.0::DOUBLE <= 0.6 AND value >= 25"))
def eligible_frames(spark, d):
    return quality.eligible_frames(_measured(spark, d)).select("keyframe_id")


@query(with_views("keyframes", body=""" SELECT keyframe_id, round(0.60::DOUBLE * least(1.0, ln(1 + value) / ln(1501.0::DOUBLE)) + 0.25::DOUBLE * greatest(0.0, 1 - abs(event_id % 256 - 127.5) / 127.5) + 0.15::DOUBLE * (1 - greatest(event_id % 10 / 10.0::DOUBLE, event_id % 7 / 10.0::DOUBLE)), 6) AS quality,
 CASE WHEN event_id % 100 / 100.0::DOUBLE >= 0.82 THEN 'ticker' WHEN event_id % 100 / 100.0::DOUBLE <= 0.18 AND (event_id % 9 / 9.0::DOUBLE <= 0.22 OR event_id % 9 / 9.0::DOUBLE >= 0.78) THEN 'logo' ELSE 'scene' END AS zone, printf('%s:%08d', video_id, frame_idx) AS name, 'frame:' || keyframe_id AS doc_id FROM keyframes"""))
def frame_measures(spark, d):
    """Frame quality, text zone and identifiers of every keyframe."""
    k = _measured(spark, d).join(X.keyframes(spark, d).select("keyframe_id", "video_id", "frame_idx", "event_id"), "keyframe_id")
    score = geometry.frame_quality(F.col("sharpness"), (F.col("event_id") % 256).cast("double"), F.col("black_ratio"), F.col("white_ratio"))
    return k.select("keyframe_id", F.round(score, 6).alias("quality"), geometry.text_zone(F.col("event_id") % 9 / 9.0, F.col("event_id") % 100 / 100.0).alias("zone"),
                    ids.keyframe_id(F.col("video_id"), F.col("frame_idx")).alias("name"), ids.document_id(F.lit("frame"), F.col("keyframe_id")).alias("doc_id"))


@query("""WITH r AS (SELECT 'a' || user_id AS artifact, CASE WHEN user_id % 5 = 0 AND event_type = 'error' THEN 'other' ELSE 'v' || user_id END AS video_id, CAST(floor(value) AS BIGINT) AS k FROM events),
v AS (SELECT artifact, count(DISTINCT video_id) AS n, min(video_id) AS video_id FROM r GROUP BY artifact), s AS (SELECT DISTINCT 'a' || user_id AS artifact, 'v' || (user_id + CAST(user_id % 9 = 0 AS BIGINT)) AS said FROM events)
SELECT artifact, 'SEVERAL_VIDEOS' AS rule, CAST(n AS VARCHAR) AS detail FROM v WHERE n > 1 UNION ALL SELECT artifact, 'OTHER_VIDEO', said FROM v JOIN s USING (artifact) WHERE n = 1 AND video_id <> said
UNION ALL SELECT artifact, 'DUPLICATE_KEY', CAST(k AS VARCHAR) FROM r GROUP BY artifact, k HAVING count(*) > 1""")
def artifact_violations(spark, d):
    e = X.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("a"), "user_id").alias("artifact"), F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "error"), "other").otherwise(F.concat(F.lit("v"), "user_id")).alias("video_id"), F.floor("value").alias("k"))
    said = e.select(F.concat(F.lit("a"), "user_id").alias("artifact"), F.concat(F.lit("v"), F.col("user_id") + (F.col("user_id") % 9 == 0).cast("int")).alias("video_id")).distinct()
    return quality.artifact_violations(rows, said, "k")


@query("SELECT DISTINCT 'v' || o_custkey AS video_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def incomplete_stages(spark, d):
    stage = F.when(F.col("o_orderstatus") == "F", "shot").when(F.col("o_orderstatus") == "P", "visual").otherwise("other")
    return quality.incomplete_stages(X.table(spark, d, "orders").select(F.concat(F.lit("v"), "o_custkey").alias("video_id"), stage.alias("stage")))


@query(with_views("keyframes", "shots", body=""", k AS (SELECT DISTINCT shot_id FROM keyframes WHERE event_id % 3 > 0), s AS (SELECT shot_id FROM shots WHERE shot_index % 5 <> 1)
SELECT shot_id, 'NO_KEYFRAME' AS rule FROM s WHERE shot_id NOT IN (SELECT shot_id FROM k) UNION ALL SELECT shot_id, 'UNKNOWN_SHOT' FROM k WHERE shot_id NOT IN (SELECT shot_id FROM s)"""))
def coverage_violations(spark, d):
    return quality.coverage_violations(X.keyframes(spark, d).where("event_id % 3 > 0"), X.shots(spark, d).where("shot_index % 5 <> 1"))


@query(with_views("vectors", body=""", k AS (SELECT video_id, keyframe_id, shot_id FROM vectors WHERE vec_id % 40 <> 3), v AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 + CAST(video_id = 'v2' AND vec_id % 2 = 0 AS BIGINT) AS r FROM vectors WHERE video_id <> 'v3' OR vec_id % 40 <> 3),
a AS (SELECT video_id, count(*) AS a FROM k GROUP BY 1), b AS (SELECT video_id, count(*) AS b, min(r) AS low, max(r) AS high, count(DISTINCT r) AS n FROM v GROUP BY 1)
SELECT 'MISALIGNED' AS rule, coalesce(a.video_id, b.video_id) AS key FROM a FULL JOIN b ON a.video_id = b.video_id WHERE a IS DISTINCT FROM b UNION ALL SELECT 'NOT_CONTIGUOUS', video_id FROM b WHERE low <> 0 OR high <> n - 1 OR n <> b"""))
def frame_alignment(spark, d):
    """The rules of ``frame_contract`` on numbers and order of rows."""
    from pyspark.sql import Window
    v = X.vectors(spark, d)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1 + ((F.col("video_id") == "v2") & (F.col("vec_id") % 2 == 0)).cast("int")
    rows = v.where("video_id <> 'v3' OR vec_id % 40 <> 3").withColumn("embedding_row", place)
    return quality.frame_contract(v.where("vec_id % 40 <> 3"), v.select("shot_id").distinct(), rows).where("rule IN ('MISALIGNED', 'NOT_CONTIGUOUS')")


@query(with_views("speech", body=" SELECT segment_id, CAST(row_number() OVER w AS INTEGER) AS place FROM (SELECT *, -(length(text) % 30) / 10.0::DOUBLE AS lp FROM speech) WINDOW w AS (PARTITION BY video_id ORDER BY lp, segment_id) QUALIFY row_number() OVER w <= 5"))
def lowest_segments(spark, d):
    return quality.lowest_segments(X.speech(spark, d).withColumn("avg_logprob", -(F.length("text") % 30) / 10.0)).select("segment_id", "place")


@query(with_views("keyframes", body=" SELECT DISTINCT video_id FROM keyframes WHERE video_id NOT IN (SELECT 'v' || conv_id FROM conversations)"))
def unknown_references(spark, d):
    known = X.speech(spark, d).select("video_id")
    return quality.unknown_references(X.keyframes(spark, d), known, "video_id")


@query("WITH v AS (SELECT label AS source, CASE WHEN label % 7 = 1 AND vec_id % 2 = 0 THEN 63 ELSE 64 END AS dim FROM embeddings), n AS (SELECT source, dim, count(*) AS rows FROM v GROUP BY ALL) SELECT source, CAST(dim AS INTEGER) AS dim, rows FROM n WHERE dim <> 64")
def dimension_violations(spark, d):
    v = X.table(spark, d, "embeddings").select(F.col("label").alias("source"), F.when((F.col("label") % 7 == 1) & (F.col("vec_id") % 2 == 0), F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return vectors.dimension_violations(v, "source").select("source", "dim", "rows")


@query(f"SELECT source AS video_id, doc_id, CAST(tokens AS INTEGER) AS tokens FROM (SELECT *, len({tokens_sql('text')}) AS tokens FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY tokens DESC, printf('%08d', doc_id)) = 1")
def choose_transcript(spark, d):
    copies = X.table(spark, d, "documents").select(F.col("source").alias("video_id"), "doc_id", "text", F.format_string("%08d", "doc_id").alias("path"))
    return ledger.choose_transcript(copies).select("video_id", "doc_id", "tokens")


@query("""WITH q AS (SELECT o_custkey AS set_id, o_orderdate AS seen, o_orderpriority AS part, o_orderkey AS number FROM orders), n AS (SELECT set_id FROM q GROUP BY set_id ORDER BY max(seen) DESC, set_id DESC LIMIT 1) SELECT set_id, part, number FROM q JOIN n USING (set_id)""")
def latest_questions(spark, d):
    q = X.table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderdate").alias("imported_at"), F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("number"))
    return ledger.latest_questions(q).select("set_id", "part", "number")


@query(with_views("detections", body=", n AS (SELECT keyframe_id, class_name FROM detections GROUP BY ALL) SELECT keyframe_id AS doc_id FROM n WHERE class_name = 'click' INTERSECT SELECT keyframe_id FROM n WHERE class_name = 'view'"))
def object_filter(spark, d):
    n = X.detections(spark, d).groupBy(F.col("keyframe_id").alias("doc_id"), F.col("class_name").alias("label")).agg(F.count("*").alias("count"))
    return lexical.filter_objects(X.keyframes(spark, d).select(F.col("keyframe_id").alias("doc_id")), n, ["click", "view"])


@query(r"""SELECT doc_id, concat_ws(' ', s, s, lang, lang, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')) AS text FROM (SELECT *, nullif(source, '') AS s FROM documents)""")
def weighted_text(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", documents.weighted_text(F.col("source"), F.col("lang"), F.col("text")).alias("text"))


_MARKED = "replace(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'ñ', 'n' || chr(771))"


@query(rf"SELECT doc_id, trim(regexp_replace(nfc_normalize({_MARKED}), '\s+', ' ', 'g')) AS text FROM documents")
def composed_text(spark, d):
    """Texts with decomposed accents, composed again."""
    marked = F.replace(F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308")), F.lit("ñ"), F.lit("n\u0303"))
    return compose(X.table(spark, d, "documents").select("doc_id", marked.alias("text")), "text")


@query("SELECT c_nationkey AS run_id, max(c_mktsegment) AS dataset_group, max(CAST(c_custkey AS BIGINT)) AS batch FROM customer GROUP BY 1")
def greatest_provenance(spark, d):
    rows = X.table(spark, d, "customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_mktsegment").alias("dataset_group"), F.col("c_custkey").cast("long").alias("batch"))
    return ledger.greatest_provenance(rows, "run_id", ["dataset_group", "batch"])


@query(with_views("search_documents", body=" SELECT doc_id, level, CASE WHEN level <> 'event' THEN shot_id END AS shot_id, CASE WHEN level = 'event' THEN end_time END AS end_time FROM search_documents"))
def union_levels(spark, d):
    docs = X.search_documents(spark, d)
    return ledger.union_levels(*(docs.where(F.col("level") == level).select("doc_id", "level", "end_time" if level == "event" else "shot_id") for level in ("event", "shot", "frame"))).select("doc_id", "level", "shot_id", "end_time")


@query("SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b FROM (SELECT DISTINCT conv_id AS id FROM conversations) a FULL JOIN (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase') b ON a.id = b.id")
def compare_ids(spark, d):
    """Transcripts without metadata and the other way round."""
    a = X.table(spark, d, "conversations").select(F.col("conv_id").alias("id"))
    return ledger.compare_ids(a, X.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id")), "id")


@query("""WITH c AS (SELECT a.id AS a, b.id AS b FROM (SELECT DISTINCT conv_id AS id FROM conversations) a FULL JOIN (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase') b ON a.id = b.id)
SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a = b) AS both, count(*) FILTER (b IS NULL) = 0 AS subset, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS equal FROM c""")
def compare_summary(spark, d):
    return ledger.compare_summary(compare_ids(spark, d))


@query(with_views("search_documents", "keyframes", "shots", body=""", g AS (SELECT *, lead(start_time) OVER (PARTITION BY video_id ORDER BY shot_index, shot_id) - end_time AS gap FROM shots)
SELECT 'documents ' || level AS part, count(*) AS n FROM search_documents GROUP BY level UNION ALL SELECT 'edges', 2 * count(*) FILTER (gap <= 3) FROM g
UNION ALL SELECT 'source ' || event_type, count(*) FROM keyframes GROUP BY event_type"""))
def fusion_summary(spark, d):
    """Documents of each level, temporal edges and keyframes of each source."""
    from ..operators import temporal
    counted = lambda df, name: df.groupBy(name.alias("part")).agg(F.count("*").alias("n"))
    docs = counted(X.search_documents(spark, d), F.concat(F.lit("documents "), "level"))
    edges = temporal.temporal_edges(X.shots(spark, d)).agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "n")
    return docs.unionByName(edges).unionByName(counted(X.keyframes(spark, d), F.concat(F.lit("source "), "event_type")))


GROUP = "'L' || (20 + page_id % 12)"
PAGES_SQL = f"p AS (SELECT CAST(page_id AS VARCHAR) AS video_id, {GROUP} AS g, CASE page_id % 12 WHEN 1 THEN '60 Giây Sáng - ' WHEN 5 THEN 'BÍ QUYẾT ÔN THI THPT 2024 ' WHEN 9 THEN 'Đôi Mắt MeKong ' ELSE '' END AS head, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
_DETAIL = r"regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '^[ |–—-]+|[ |–—-]+$', '', 'g')"


def _titled(spark, d):
    p = X.table(spark, d, "pages")
    head = F.coalesce(F.create_map(F.lit(1), F.lit("60 Giây Sáng - "), F.lit(5), F.lit("BÍ QUYẾT ÔN THI THPT 2024 "), F.lit(9), F.lit("Đôi Mắt MeKong "))[(F.col("page_id") % 12).cast("int")], F.lit(""))
    return p.select(F.col("page_id").cast("string").alias("video_id"), F.concat(F.lit("L"), 20 + F.col("page_id") % 12).alias("group"), F.concat(head, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), "page_id")


_CASE = lambda table, other: "CASE g " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query(f"WITH {PAGES_SQL} SELECT video_id, {_CASE(enrichment.GROUP_LABELS, enrichment.OTHER_LABEL)} || CASE WHEN g IN ('L21', 'L22', 'L28') THEN ' - ' ELSE ': ' END || coalesce(nullif({_DETAIL}, ''), head || title) AS topic FROM p")
def video_topics(spark, d):
    """Topics from the group's label and the title's detail; the titles begin with what their group's titles repeat."""
    return _titled(spark, d).select("video_id", enrichment.topic_for(F.col("group"), F.col("title")).alias("topic"))


@query(f"""WITH {PAGES_SQL} SELECT video_id, replace({_CASE(enrichment.SUMMARY_INTROS, enrichment.OTHER_INTRO)}, '{{}}', coalesce(nullif({_DETAIL}, ''), head || title)) ||
 CASE CAST(video_id AS BIGINT) % 4 WHEN 0 THEN chr(10) || chr(10) || 'Nội dung chính:' || chr(10) || '- ' || g || chr(10) || '- ' || title WHEN 1 THEN chr(10) || chr(10) || 'Ghi chú dữ liệu: {enrichment.SUMMARY_NOTES['missing']}' ELSE chr(10) || chr(10) || 'Ghi chú dữ liệu: {enrichment.OTHER_NOTE}' END AS summary FROM p""")
def video_summaries(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = _titled(spark, d).join(X.table(spark, d, "pages").select("page_id", title.alias("plain")), "page_id").withColumns({
        "points": F.when(F.col("page_id") % 4 == 0, F.array("group", "plain")).otherwise(F.array().cast("array<string>")), "status": F.when(F.col("page_id") % 4 == 1, "missing").otherwise("sparse")})
    return enrichment.summaries(rows)


@query(with_views("speech", body=f", {TRANSCRIPTS_SQL}" + f""", t AS (SELECT video_id, 'L' || (20 + CAST(substr(video_id, 2) AS BIGINT) % 12) AS g, reverse(title) AS title, text FROM transcripts),
c AS (SELECT video_id, g, text, {FOLD_KEY.format('text')} AS folded, {tokens_sql("regexp_replace(trim(regexp_replace(title, '[[:space:]]+', ' ', 'g')), '^[ |–—-]+|[ |–—-]+$', '', 'g')")} AS w, {tokens_sql('text')} AS x, list_distinct(list_filter({tokens_sql('title')}, lambda y: length(y) >= 3 AND NOT regexp_full_match(y, '[0-9]+'))) AS tt FROM t),
o AS (SELECT *, CASE WHEN len(tt) > 0 THEN round(len(list_intersect(tt, x)) / len(tt), 3) END AS cov, list_filter(list_distinct(w), lambda y: y NOT IN ({", ".join(f"'{v}'" for v in enrichment.CUED_GROUP_WORDS)})) AS own FROM c)
SELECT video_id, CASE WHEN g = 'L24' THEN len(x) >= 80 AND len(list_filter([{", ".join(f"'{v}'" for v in enrichment.CUED_GROUP_CUES)}], lambda m: contains(folded, m))) = 0 AND len(list_intersect(own, x)) / greatest(1, len(own)) < 0.2
 ELSE coalesce(g NOT IN ('L21', 'L22') AND cov < 0.12 AND len(w) >= 5, false) END AS conflict FROM o"""))
def topic_conflicts(spark, d):
    """Titles, read backwards so that some do not fit, against transcripts."""
    t = transcripts(spark, d).select("video_id", F.concat(F.lit("L"), 20 + F.substring("video_id", 2, 20).cast("long") % 12).alias("group"), F.reverse("title").alias("title"), "text")
    return t.select("video_id", enrichment.topic_conflict(F.col("group"), F.col("title"), F.col("text"), enrichment.title_coverage(F.col("title"), F.col("text"))).alias("conflict"))


@query(with_views("speech", body=f", {TRANSCRIPTS_SQL}" + f""", t AS (SELECT video_id, title AS summary, length(text) % 5 = 0 AS conflict, sha256({FOLD_KEY.format('text')}) AS h FROM transcripts),
s AS (SELECT *, count(*) OVER (PARTITION BY summary) > 1 AS a, count(*) OVER (PARTITION BY h) > 1 AS b FROM t)
SELECT 'conflict' AS kind, '' AS key, video_id FROM s WHERE conflict UNION ALL SELECT 'summary', sha256(summary), video_id FROM s WHERE a UNION ALL SELECT 'transcript', h, video_id FROM s WHERE b"""))
def enrichment_problems(spark, d):
    from ..functions.text import fold_key
    t = transcripts(spark, d).select("video_id", F.lit("usable").alias("status"), F.col("title").alias("summary"), (F.length("text") % 5 == 0).alias("conflict"), F.sha2(fold_key(F.col("text")), 256).alias("text_hash"))
    return enrichment.enrichment_problems(t)


def _answered(spark, d):
    """Models' answers about every third keyframe of a video: JSON in a code fence, with values to be cleaned."""
    k = X.keyframes(spark, d)
    subject = F.concat(F.lit('{"name_vi": " '), "event_type", F.lit('  x", "category": "Person", "dominant_colors": ["red", "red", " ", "blue"], "count": "0", "confidence": 3}'))
    raw = F.concat(F.lit('Here it is: ```json {"caption_vi": "'), "event_type", F.when(F.col("event_id") % 2 == 0, F.lit(" trong nhà")).otherwise(F.lit(" ngoài trời")), F.lit('", "main_subjects": ['), subject,
                   F.lit('], "visible_text": ["A", "A", ""], "actions_vi": ["chạy"], "environment": "OUTDOOR", "time_of_day": "noon", "weather": "Rain", "search_text_vi": "", "confidence": "'), (F.col("event_id") % 3).cast("string"), F.lit('"} ```'))
    return k.where("n % 3 = 0").select("keyframe_id", F.when(F.col("event_id") % 11 == 0, F.lit("no answer")).otherwise(raw).alias("raw"))


@query(with_views("keyframes", body=""", told AS (SELECT keyframe_id, shot_id, frame_idx, event_id, event_type FROM keyframes WHERE n % 3 = 0 AND event_id % 11 <> 0),
once AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY shot_id, frame_idx ORDER BY keyframe_id) = 1),
near AS (SELECT k.keyframe_id, k.frame_idx, o.keyframe_id AS src, o.event_id, o.event_type, abs(k.frame_idx - o.frame_idx) AS far FROM keyframes k LEFT JOIN once o USING (shot_id) QUALIFY row_number() OVER (PARTITION BY k.keyframe_id ORDER BY far, o.frame_idx) = 1)
SELECT * EXCLUDE (text0), trim(regexp_replace(text0, ' +', ' ', 'g')) AS search_text FROM (SELECT keyframe_id, src AS source_keyframe_id, CASE WHEN src IS NULL THEN 'evidence_only' WHEN far = 0 THEN 'vlm' ELSE 'propagated' END AS description_source, CASE WHEN src IS NULL THEN 'unknown' WHEN event_id % 2 = 0 THEN 'indoor' ELSE 'outdoor' END AS environment,
 CASE WHEN src IS NULL OR event_id % 2 = 0 THEN 'unknown' ELSE 'rain' END AS weather, CASE WHEN src IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, event_id % 3) END AS confidence,
 CASE WHEN src IS NULL THEN '' WHEN event_id % 2 = 0 THEN event_type || ' trong nhà ' || event_type || ' x red blue A chạy ' ELSE event_type || ' ngoài trời ' || event_type || ' x red blue A chạy ' END
 || CASE WHEN keyframe_id LIKE '%7' THEN '' ELSE 'line ' || right(keyframe_id, 1) || ' obj cam' END || CASE WHEN src IS NULL THEN '' WHEN event_id % 2 = 0 THEN ' trong nhà' ELSE ' trời mưa ngoài trời' END AS text0,
 CASE WHEN keyframe_id LIKE '%7' THEN '' ELSE 'tick ' || right(keyframe_id, 1) END AS ocr_ticker_text FROM near)"""))
def understanding_documents(spark, d):
    k = X.keyframes(spark, d).select("keyframe_id", "video_id", "shot_id", "frame_idx", "pts_time")
    last = F.substring("keyframe_id", -1, 1)
    evidence = k.where(last != "7").select("keyframe_id", F.concat(F.lit("line "), last, F.lit(" tick "), last).alias("ocr_text"), F.concat(F.lit("line "), last).alias("ocr_scene_text"), F.concat(F.lit("tick "), last).alias("ocr_ticker_text"),
                                           F.array(F.lit("obj"), F.lit("cam")).alias("object_labels"))
    made = understanding.understanding_documents(k, _answered(spark, d), evidence)
    return made.select("keyframe_id", "source_keyframe_id", "description_source", "environment", "weather", "confidence", "search_text", "ocr_ticker_text")
