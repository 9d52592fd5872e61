"""Audit, validation, summary and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..operators import documents, ledger, lexical, quality
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


MAPPING_SQL = """raw AS (SELECT video_id, n AS row_number, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE CAST(CASE WHEN event_id % 41 = 0 THEN n - 2 ELSE n END AS VARCHAR) END AS n,
 CAST(CASE WHEN event_id % 29 = 0 THEN lag(frame_idx) OVER w ELSE frame_idx END AS VARCHAR) AS frame_idx, CAST(floor(pts_time) AS BIGINT) || '.5' AS pts_time, CASE WHEN event_id % 211 = 0 THEN '0' ELSE '25' END AS fps
 FROM keyframes WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, event_id)),
v AS (SELECT video_id, row_number, try_cast(n AS BIGINT) AS n, try_cast(frame_idx AS BIGINT) AS frame, try_cast(pts_time AS DOUBLE) AS t, try_cast(fps AS DOUBLE) AS fps FROM raw),
g AS (SELECT *, coalesce(lag(n) OVER w, -1) AS ln, coalesce(lag(frame) OVER w, -1) AS lf, coalesce(lag(t) OVER w, -1) AS lt FROM v WHERE n IS NOT NULL AND frame IS NOT NULL AND t IS NOT NULL AND fps IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY row_number)),
issues AS (SELECT video_id, row_number, 'error' AS severity, 'INVALID_VALUE' AS code FROM v WHERE n IS NULL OR frame IS NULL OR t IS NULL OR fps IS NULL
 UNION ALL SELECT video_id, row_number, 'error', 'INVALID_MONOTONICITY' FROM g WHERE n <= ln OR frame < lf OR t < lt OR frame < 0 OR t < 0 OR fps <= 0
 UNION ALL SELECT video_id, row_number, 'warning', 'DUPLICATE_FRAME' FROM g WHERE NOT (n <= ln OR frame < lf OR t < lt OR frame < 0 OR t < 0 OR fps <= 0) AND frame = lf)"""


def _mapping(spark, d):
    from pyspark.sql import Window
    k = X.keyframes(spark, d)
    by = Window.partitionBy("video_id").orderBy("pts_time", "event_id")
    return k.select("video_id", F.col("n").cast("bigint").alias("row_number"), F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.when(F.col("event_id") % 41 == 0, F.col("n") - 2).otherwise(F.col("n")).cast("string")).alias("n"),
                    F.when(F.col("event_id") % 29 == 0, F.lag("frame_idx").over(by)).otherwise(F.col("frame_idx")).cast("string").alias("frame_idx"),
                    F.concat(F.floor("pts_time").cast("string"), F.lit(".5")).alias("pts_time"), F.when(F.col("event_id") % 211 == 0, "0").otherwise("25").alias("fps"))


@query(with_views("keyframes", body=", " + MAPPING_SQL + " SELECT * FROM issues"))
def keyframe_audit(spark, d):
    return quality.mapping_audit(_mapping(spark, d))


@query(with_views("keyframes", body=", " + MAPPING_SQL + """, b AS (SELECT DISTINCT video_id FROM issues WHERE severity = 'error'), a AS (SELECT DISTINCT video_id FROM keyframes)
SELECT (SELECT count(*) FROM a WHERE video_id NOT IN (SELECT video_id FROM b)) AS valid_videos, (SELECT count(*) FROM b) AS invalid_videos, (SELECT count(*) FROM keyframes) AS keyframes,
 (SELECT count(*) FROM issues WHERE severity = 'error') AS errors, (SELECT count(*) FROM issues WHERE severity = 'warning') AS warnings"""))
def audit_summary(spark, d):
    k = X.keyframes(spark, d)
    return quality.audit_summary(quality.mapping_audit(_mapping(spark, d)), k, k)


@query("""WITH m AS (SELECT CAST(page_id AS VARCHAR) AS video_id, url, page_id % 19 = 0 AS corrupt FROM pages WHERE page_id % 7 <> 0), k AS (SELECT CAST(page_id AS VARCHAR) AS video_id FROM pages WHERE page_id % 11 <> 0),
h AS (SELECT *, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM m)
SELECT coalesce(h.video_id, k.video_id) AS video_id, 'error' AS severity, CASE WHEN k.video_id IS NULL OR h.video_id IS NULL THEN 'MISSING_PAIR' WHEN corrupt THEN 'INVALID_JSON' ELSE 'INVALID_WATCH_URL' END AS code
FROM h FULL JOIN k ON h.video_id = k.video_id WHERE k.video_id IS NULL OR h.video_id IS NULL OR corrupt OR NOT (host IN ('example.com', 'example.net') OR ends_with(host, '.example.com') OR ends_with(host, '.example.net'))""")
def pair_issues(spark, d):
    p = X.table(spark, d, "pages")
    m = p.where("page_id % 7 <> 0").select(F.col("page_id").cast("string").alias("video_id"), "url", (F.col("page_id") % 19 == 0).alias("corrupt"))
    k = p.where("page_id % 11 <> 0").select(F.col("page_id").cast("string").alias("video_id"))
    return quality.pair_issues(m, k, I.url_host(F.col("url"), ["example.com", "example.net"]).isNotNull())


@query(with_views("vectors", body=""", k AS (SELECT keyframe_id, shot_id FROM vectors WHERE vec_id % 13 <> 0 UNION ALL SELECT keyframe_id, shot_id FROM vectors WHERE vec_id % 31 = 1), s AS (SELECT DISTINCT shot_id FROM vectors),
v AS (SELECT keyframe_id, CASE WHEN vec_id % 17 = 0 THEN [CAST(x AS DOUBLE) * 2 FOR x IN vector] ELSE CAST(vector AS DOUBLE[]) END AS vector FROM vectors WHERE vec_id % 23 <> 0)
SELECT 'DUPLICATE_KEYFRAME' AS rule, keyframe_id AS key FROM k GROUP BY keyframe_id HAVING count(*) > 1
UNION ALL SELECT 'MISSING_VECTOR', keyframe_id FROM k WHERE keyframe_id NOT IN (SELECT keyframe_id FROM v) UNION ALL SELECT 'UNKNOWN_KEYFRAME', keyframe_id FROM v WHERE keyframe_id NOT IN (SELECT keyframe_id FROM k)
UNION ALL SELECT 'EMPTY_SHOT', shot_id FROM s WHERE shot_id NOT IN (SELECT shot_id FROM k) UNION ALL SELECT 'NOT_UNIT', keyframe_id FROM v WHERE abs(sqrt(list_dot_product(vector, vector)) - 1) > 1e-3"""))
def frame_contract(spark, d):
    v = X.vectors(spark, d)
    k = v.where("vec_id % 13 <> 0").select("keyframe_id", "shot_id").unionByName(v.where("vec_id % 31 = 1").select("keyframe_id", "shot_id"))
    w = v.where("vec_id % 23 <> 0").select("keyframe_id", F.when(F.col("vec_id") % 17 == 0, F.transform("vector", lambda x: x.cast("double") * 2)).otherwise(F.col("vector").cast("array<double>")).alias("vector"))
    return quality.frame_contract(k, v.select("shot_id").distinct(), w)


@query(with_views("speech", body=""", l AS (SELECT s.*, lag(start_time) OVER (PARTITION BY video_id ORDER BY segment_index, segment_id) AS last FROM (SELECT * REPLACE (CASE WHEN segment_index % 3 = 2 THEN start_time - 200 ELSE start_time END AS start_time) FROM speech) s),
m AS (SELECT video_id, max(end_time) - 2 AS d FROM speech GROUP BY 1), r AS (SELECT segment_id, unnest([CASE WHEN start_time < 0 THEN 'NEGATIVE_START' END, CASE WHEN end_time <= start_time THEN 'EMPTY' END, CASE WHEN start_time < last THEN 'ORDER' END, CASE WHEN end_time > d + 1 THEN 'BEYOND_END' END]) AS rule FROM l JOIN m USING (video_id))
SELECT * FROM r WHERE rule IS NOT NULL"""))
def transcript_violations(spark, d):
    s = X.speech(spark, d)
    m = s.groupBy("video_id").agg((F.max("end_time") - 2).alias("duration_sec"))
    return quality.transcript_violations(s.withColumn("start_time", F.when(F.col("segment_index") % 3 == 2, F.col("start_time") - 200).otherwise(F.col("start_time"))), m)


@query(with_views("keyframes", body=""", m AS (SELECT video_id, max(frame_idx) - 500 AS fc, max(pts_time) - 30 AS d FROM keyframes GROUP BY 1) SELECT keyframe_id FROM keyframes JOIN m USING (video_id) WHERE frame_idx < 0 OR frame_idx >= fc OR pts_time > d"""))
def bounds_violations(spark, d):
    k = X.keyframes(spark, d)
    m = k.groupBy("video_id").agg((F.max("frame_idx") - 500).alias("frame_count"), (F.max("pts_time") - 30).alias("duration_sec"))
    return quality.bounds_violations(k, m).select("keyframe_id")


@query(with_views("keyframes", "shots", body=""", s AS (SELECT video_id, count(*) AS shots, min(duration_sec) AS min_shot, round(quantile_cont(duration_sec, 0.5), 6) AS median_shot, max(duration_sec) AS max_shot, max(end_time) - min(start_time) AS span FROM shots GROUP BY 1),
k AS (SELECT video_id, count(*) AS keyframes, count(DISTINCT shot_id) AS covered, round(quantile_cont(quality_score, 0.5), 6) AS median_quality, count(*) FILTER (quality_score < 0.05) AS fallbacks FROM keyframes WHERE event_type <> 'view' GROUP BY 1)
SELECT s.video_id, shots, round(min_shot, 6) AS min_shot, median_shot, round(max_shot, 6) AS max_shot, keyframes, median_quality, fallbacks, round(CAST(covered AS DOUBLE) / shots, 6) AS coverage, round(60.0::DOUBLE * keyframes / greatest(span, 1e-9), 6) AS per_minute, round(CAST(covered AS DOUBLE) / shots, 6) >= 0.5 AS passed FROM s LEFT JOIN k USING (video_id)"""))
def quality_report(spark, d):
    k = X.keyframes(spark, d).where("event_type <> 'view'").withColumn("quality_fallback", F.col("quality_score") < 0.05)
    r = quality.extraction_report(X.shots(spark, d), k)
    return r.withColumns({"min_shot": F.round("min_shot", 6), "max_shot": F.round("max_shot", 6)})


@query(with_views("speech", body=r""", p AS (SELECT *, -(length(text) % 30) / 10.0::DOUBLE AS lp, (length(text) % 10) / 10.0::DOUBLE AS ns FROM speech)
SELECT video_id, count(*) AS segments, round(sum(end_time - start_time), 6) AS speech_sec, CAST(sum(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))) AS BIGINT) AS words, round(avg(lp), 6) AS mean_logprob, count(*) FILTER (lp < -1.0) AS low_confidence, count(*) FILTER (ns > 0.5) AS high_no_speech FROM p GROUP BY 1"""))
def transcript_summary(spark, d):
    s = X.speech(spark, d).withColumns({"avg_logprob": -(F.length("text") % 30) / 10.0, "no_speech_prob": (F.length("text") % 10) / 10.0})
    return quality.transcript_summary(s)


OCR_KEY = "trim(regexp_replace(lower(replace(replace(strip_accents({}), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g'))"
OCR_SQL = r", keep AS (SELECT *, " + OCR_KEY.format("text") + r" AS key FROM ocr_lines WHERE NOT regexp_matches(upper(regexp_replace(text, '\s+', '', 'g')), '" + quality.STATIC_OVERLAY + r"') AND NOT regexp_matches(" + OCR_KEY.format("text") + f", '{quality.STUTTER}') AND " + r" confidence >= 0.45 AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 2 AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 0.5 * length(regexp_replace(text, '\s', '', 'g')))"


@query(with_views("ocr_lines", body=OCR_SQL + """, b AS (SELECT * FROM keep WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY keyframe_id, key ORDER BY confidence DESC, position) = 1)
SELECT keyframe_id, CAST(row_number() OVER (PARTITION BY keyframe_id ORDER BY position) AS INTEGER) AS line_no, key, confidence FROM b"""))
def ocr_frame_dedupe(spark, d):
    return quality.ocr_frame_dedupe(quality.ocr_line_filter(X.ocr_lines(spark, d))).select("keyframe_id", "line_no", "key", "confidence")


@query(with_views("ocr_lines", body=OCR_SQL + """, g AS (SELECT shot_id, key, count(DISTINCT keyframe_id) AS support, max(confidence) AS confidence FROM keep WHERE key <> '' GROUP BY 1, 2)
SELECT shot_id, key, support, confidence, CAST(row_number() OVER (PARTITION BY shot_id ORDER BY support DESC, confidence DESC, key) AS INTEGER) AS line_no FROM g"""))
def ocr_shot_merge(spark, d):
    return quality.ocr_shot_merge(quality.ocr_line_filter(X.ocr_lines(spark, d))).select("shot_id", "key", "support", "confidence", "line_no")


@query("SELECT count(*) AS rows, count(*) FILTER (toxic = 1) AS errors, round(count(*) FILTER (toxic = 1) / greatest(count(*), 1), 6) AS rate, round(count(*) FILTER (toxic = 1) / greatest(count(*), 1), 6) <= 0.1 AS passed FROM labels")
def ocr_error_gate(spark, d):
    return quality.error_gate(X.table(spark, d, "labels"), F.col("toxic") == 1)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_by_key(spark, d):
    return ledger.latest_by_key(X.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH l AS (SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l WHERE o_orderstatus = 'F')""")
def pending_work(spark, d):
    items = X.table(spark, d, "customer").select("c_custkey")
    log = X.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return ledger.pending(items, log, ["c_custkey"], ["o_orderdate", "o_orderkey"], "F")


def _target_source(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1000, 2))


PAIR_SQL = "WITH t AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey, c_name, round(CAST(c_acctbal AS DOUBLE) + 1000, 2) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) "


@query(PAIR_SQL + "SELECT * FROM t UNION ALL SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM t)")
def insert_missing(spark, d):
    return ledger.insert_missing(*_target_source(spark, d), ["c_custkey"])


@query(PAIR_SQL + "SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM t FULL JOIN s ON t.c_custkey = s.c_custkey")
def upsert(spark, d):
    t, s = _target_source(spark, d)
    return ledger.upsert(t, s, ["c_custkey"], ["c_name", "c_acctbal"])


@query("""WITH p AS (SELECT p_brand AS video_id, p_name AS path, p_type AS version, p_size AS score FROM part), s AS (SELECT *, CASE WHEN version = (SELECT min(p_type) FROM part) THEN 10 ELSE 0 END + CASE WHEN contains(path, video_id) THEN 1 ELSE 0 END AS choice_score FROM p)
SELECT video_id, path, version, CAST(choice_score AS INTEGER) AS choice_score FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY choice_score DESC, path, score DESC) = 1""")
def choose_artifact(spark, d):
    p = X.table(spark, d, "part")
    preferred = p.agg(F.min("p_type").alias("v")).first()["v"]
    return ledger.choose_artifact(p.select(F.col("p_brand").alias("video_id"), F.col("p_name").alias("path"), F.col("p_type").alias("version"), F.col("p_size").alias("score")), preferred).select("video_id", "path", "version", "choice_score")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own' ELSE n_name END AS dataset_group, r_name AS artifact_batch FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def provenance_fill(spark, d):
    rows = X.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"), F.when(F.col("c_custkey") % 4 == 0, "own").alias("dataset_group"), F.lit(None).cast("string").alias("artifact_batch"))
    owners = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("owner"), F.col("n_name").alias("dataset_group"), F.col("r_name").alias("artifact_batch"))
    return ledger.fill_provenance(rows, owners, "owner", ["dataset_group", "artifact_batch"]).drop("owner")


@query("SELECT c_custkey, c_mktsegment AS known, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE lower(c_mktsegment) END AS found FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment IS NOT NULL")
def provenance_conflicts(spark, d):
    n = X.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("batch"))
    return ledger.provenance_conflicts(n, n.withColumn("batch", F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.lower("batch"))), "c_custkey", "batch")


@query(with_views("keyframes", body="SELECT substr(sha1('ocr|' || video_id), 1, 20) AS job_id, video_id, count(*) AS records, 'completed' AS status FROM keyframes GROUP BY video_id"))
def feature_ledger(spark, d):
    return ledger.feature_jobs(X.keyframes(spark, d), "ocr")


@query(with_views("keyframes", body="SELECT keyframe_id, substr(sha1('ocr|' || video_id), 1, 20) AS job_id, CAST(('0x' || substr(sha256(keyframe_id), 1, 16))::UBIGINT % 9223372036854775808 AS BIGINT) AS vector_pk FROM keyframes"))
def feature_records(spark, d):
    return ledger.feature_records(X.keyframes(spark, d), "ocr")


@query("""WITH p AS (SELECT *, CASE page_id % 8 WHEN 0 THEN 'https://www.youtube.com/watch?a=1&v=' WHEN 1 THEN 'http://YOUTU.be/' WHEN 2 THEN 'https://m.youtube.com/watch?v=' WHEN 3 THEN 'https://music.youtube.com/watch?v=' WHEN 4 THEN 'https://youtube.com/watch?v=&v=' WHEN 5 THEN 'youtube.com/watch?v=' WHEN 6 THEN 'https://youtube.com/v/' ELSE url || '?v=' END
 || substr(sha256(CAST(page_id AS VARCHAR)), 1, CASE WHEN page_id % 5 = 0 THEN 10 ELSE 11 END) || CASE WHEN page_id % 3 = 0 THEN '#t' ELSE '' END AS u FROM pages),
h AS (SELECT page_id, lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) AS host, trim(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(regexp_extract(u, '[?]([^#]*)', 1), '(?:^|&)v=([^&]+)', 1) AS v FROM p),
f AS (SELECT page_id, CASE WHEN host = 'youtu.be' THEN path WHEN host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') THEN v END AS id FROM h) SELECT page_id, CASE WHEN regexp_full_match(id, '[A-Za-z0-9_-]{11}') THEN id END AS watch_id FROM f""")
def watch_ids(spark, d):
    """Ids of watch urls of many forms, made of the pages' ids."""
    p = X.table(spark, d, "pages")
    heads = ["https://www.youtube.com/watch?a=1&v=", "http://YOUTU.be/", "https://m.youtube.com/watch?v=", "https://music.youtube.com/watch?v=", "https://youtube.com/watch?v=&v=", "youtube.com/watch?v=", "https://youtube.com/v/"]
    n = F.col("page_id")
    head = F.coalesce(*[F.when(n % 8 == i, F.lit(h)) for i, h in enumerate(heads)], F.concat("url", F.lit("?v=")))
    name = F.sha2(n.cast("string"), 256)
    url = F.concat(head, F.when(n % 5 == 0, F.substring(name, 1, 10)).otherwise(F.substring(name, 1, 11)), F.when(n % 3 == 0, F.lit("#t")).otherwise(F.lit("")))
    return p.select("page_id", I.watch_id(url).alias("watch_id"))


@query("SELECT DISTINCT 'd' || o_custkey AS path FROM orders WHERE o_orderstatus IN ('P', 'F')")
def trusted_files(spark, d):
    """Files (one for each customer) of which some row comes from a trusted model."""
    o = X.table(spark, d, "orders").select(F.concat(F.lit("d"), "o_custkey").alias("path"), F.col("o_orderstatus").alias("model"))
    return ledger.trusted_files(o.select("path").distinct(), o, ["P", "F"])


@query(with_views("detections", "shots", body=" SELECT detection_id, d.frame_idx, s.shot_id FROM detections d LEFT JOIN (SELECT * FROM shots WHERE shot_index % 4 <> 2) s ON s.video_id = d.video_id AND d.frame_idx BETWEEN s.start_frame AND s.end_frame"
                  " QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY s.start_frame DESC NULLS LAST, s.shot_id DESC) = 1"))
def detections_with_shots(spark, d):
    """Detections joined to the shot that holds their frame; every fourth shot is missing."""
    return documents.with_shots(X.detections(spark, d), X.shots(spark, d).where("shot_index % 4 <> 2")).select("detection_id", "frame_idx", "shot_id")


@query(with_views("ocr_lines", body=r""", b AS (SELECT *, 4 + keyframe_id * 7 % 60 AS w, 3 + position * 5 % 50 AS h FROM ocr_lines),
p AS (SELECT *, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS plain FROM b WHERE confidence >= 0.45 AND w >= 10 AND h >= 8 AND h <= 0.40 * 100)
SELECT keyframe_id, position FROM p WHERE length(plain) >= 2 AND length(plain) >= 0.5 * length(regexp_replace(text, '\s', '', 'g')) AND NOT regexp_full_match(upper(regexp_replace(text, '\s+', '', 'g')), '(HTV[\p{L}\p{N}_]*|TV|HD|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|LIVE|TRỰCTIẾP)')
 AND NOT regexp_matches(""" + OCR_KEY.format("text") + """, '""" + quality.STUTTER + """')"""))
def ocr_line_boxes(spark, d):
    """The line gate with boxes."""
    lines = X.ocr_lines(spark, d).withColumns({"box_width": 4 + F.col("keyframe_id") * 7 % 60, "box_height": 3 + F.col("position") * 5 % 50, "frame_height": F.lit(100)})
    return quality.ocr_line_filter(lines).select("keyframe_id", "position")


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def inventory(spark, d):
    return ledger.inventory({t: X.table(spark, d, t) for t in TABLES})


@query(with_views("search_documents", "vectors", body="""SELECT 'documents ' || level AS part, count(*) AS n FROM search_documents GROUP BY level UNION ALL SELECT 'vectors ' || len(vector), count(*) FROM vectors WHERE vector IS NOT NULL GROUP BY len(vector)
 UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '([\\p{L}\\p{N}_]+)', 1)) FROM search_documents)"""))
def index_counts(spark, d):
    """Documents of each level, vectors of each length and postings."""
    counted = lambda df, name: df.groupBy(name.alias("part")).agg(F.count("*").alias("n"))
    docs = X.search_documents(spark, d)
    postings = lexical.postings(docs.select("doc_id", "text")).agg(F.count("*").alias("n")).select(F.lit("postings").alias("part"), "n")
    vectors = X.vectors(spark, d).where("vector IS NOT NULL")
    return counted(docs, F.concat(F.lit("documents "), "level")).unionByName(counted(vectors, F.concat(F.lit("vectors "), F.size("vector")))).unionByName(postings)


@query("SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND d.source IS NOT NULL AND trim(d.source) <> '' ORDER BY l.doc_id LIMIT 25")
def select_valid(spark, d):
    items = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("valid"), F.col("source").alias("url"))
    return ledger.first_valid(items, 25, ["doc_id"]).select("doc_id", F.col("url").alias("source"))


FEED_SQL = "f AS (SELECT user_id AS session_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events)"


@query(f"WITH {FEED_SQL} SELECT session_id, CAST(revision AS INTEGER) AS revision, count(*) FILTER (event_type = 'purchase') OVER w AS positives, count(*) FILTER (event_type = 'error') OVER w AS negatives FROM f WINDOW w AS (PARTITION BY session_id ORDER BY revision ROWS UNBOUNDED PRECEDING)")
def feedback_fold(spark, d):
    from pyspark.sql import Window
    e = X.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("revision"),
                                           F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("positive_id"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("negative_id"))
    return ledger.feedback_sizes(e)


def _answers(spark, d):
    k = X.keyframes(spark, d)
    u = F.substring("video_id", 2, 20).cast("bigint")
    frame = F.struct(F.col("n"), F.when((u % 10 == 3) & (F.col("n") == 2), F.lit("clip.mp4")).otherwise(F.col("video_id")).alias("video_id"), "frame_idx", F.when(u % 7 == 1, -F.col("pts_time")).otherwise(F.col("pts_time")).alias("pts_time"))
    a = k.groupBy(F.col("video_id").alias("question_id")).agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    q = F.substring("question_id", 2, 20).cast("bigint")
    frames = F.transform(F.slice("frames", F.lit(1), F.when(q % 11 == 0, 0).when(q % 6 == 5, 3).when((q % 3 == 2) & (q % 12 != 2), 4).otherwise(F.size("frames"))), lambda x: F.struct(x["video_id"].alias("video_id"), x["frame_idx"].alias("frame_idx"), x["pts_time"].alias("pts_time")))
    return a.select("question_id", F.element_at(F.array(F.lit("kis"), F.lit("qa"), F.lit("trake")), (q % 3 + 1).cast("int")).alias("qtype"), F.lit(4).alias("events"), frames.alias("frames"), F.when(q % 4 == 1, F.lit(" ")).otherwise(F.concat(F.lit('say "'), "question_id", F.lit('"'))).alias("answer_text"))


ANSWERS_SQL = """k AS (SELECT *, CAST(substr(video_id, 2) AS BIGINT) AS u FROM keyframes),
l AS (SELECT video_id AS question_id, u, n, CASE WHEN u % 10 = 3 AND n = 2 THEN 'clip.mp4' ELSE video_id END AS v, frame_idx, CASE WHEN u % 7 = 1 THEN -pts_time ELSE pts_time END AS t,
 CASE u % 3 WHEN 0 THEN 'kis' WHEN 1 THEN 'qa' ELSE 'trake' END AS qtype, CASE WHEN u % 4 = 1 THEN ' ' ELSE 'say "' || video_id || '"' END AS answer_text, n <= CASE WHEN u % 11 = 0 THEN 0 WHEN u % 6 = 5 THEN 3 WHEN u % 3 = 2 AND u % 12 <> 2 THEN 4 ELSE 1000000000 END AS kept FROM k),
w AS (SELECT *, lag(t) OVER (PARTITION BY question_id ORDER BY n) AS last FROM l),
a AS (SELECT question_id, any_value(u) AS u, any_value(qtype) AS q, trim(any_value(answer_text)) AS txt, count(*) FILTER (kept) AS n, count(DISTINCT v) FILTER (kept) AS vids, coalesce(bool_or(kept AND v LIKE '%.mp4'), false) AS badf, coalesce(bool_or(kept AND t < last), false) AS falling FROM w GROUP BY 1),
r AS (SELECT question_id, q AS qtype, n, list_filter([CASE WHEN n = 0 THEN 'NO_FRAME' END, CASE WHEN q = 'qa' AND txt = '' THEN 'NO_ANSWER' END, CASE WHEN q = 'trake' AND n > 0 AND n < 4 THEN 'TOO_FEW_FRAMES' END], lambda x: x IS NOT NULL) AS missing,
 list_filter([CASE WHEN badf THEN 'FRAME' END, CASE WHEN q IN ('kis', 'qa') AND n > 100 THEN 'TOO_MANY_ROWS' END, CASE WHEN q = 'trake' AND n > 4 THEN 'TOO_MANY_FRAMES' END, CASE WHEN q = 'trake' AND vids > 1 THEN 'VIDEOS' END, CASE WHEN q = 'trake' AND falling THEN 'ORDER' END], lambda x: x IS NOT NULL) AS errors FROM a),
s AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'invalid' WHEN len(missing) > 0 THEN 'missing' ELSE 'ready' END AS status FROM r)"""


@query(with_views("keyframes", body=f", {ANSWERS_SQL} SELECT question_id, status, CAST(CASE WHEN qtype IN ('kis', 'qa') THEN n WHEN status = 'ready' THEN 1 ELSE 0 END AS INTEGER) AS row_count, array_to_string(list_concat(missing, errors), ',') AS messages FROM s"))
def submission_review(spark, d):
    return ledger.review_answers(_answers(spark, d)).select("question_id", "status", "row_count", F.array_join("messages", ",").alias("messages"))


@query(with_views("keyframes", body=f", {ANSWERS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'invalid') AS invalid, count(*) > 0 AND count(*) FILTER (status = 'ready') = count(*) AS valid FROM s"))
def submission_summary(spark, d):
    return ledger.submission_summary(ledger.review_answers(_answers(spark, d)))


@query(with_views("keyframes", body=f""", {ANSWERS_SQL} SELECT question_id, CAST(n AS INTEGER) AS line_no, v || ',' || frame_idx || CASE WHEN qtype = 'qa' THEN ',"' || replace(trim(answer_text), '"', '""') || '"' ELSE '' END AS line FROM w WHERE kept AND qtype <> 'trake'
UNION ALL SELECT question_id, 1, arg_min(v, n) || ',' || string_agg(frame_idx, ',' ORDER BY n) FROM w WHERE kept AND qtype = 'trake' GROUP BY question_id"""))
def submission_rows(spark, d):
    return ledger.submission_rows(_answers(spark, d))
