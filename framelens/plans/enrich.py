"""Enrichment, selection and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BOILERPLATE, STOPWORDS, clean_text, content_tokens, keyword_union
from ..operators import documents, enrichment, fusion, ledger, lexical, selection
from ..streaming import ingest
from . import fixtures as X
from .fixtures import with_views
from .media import FRAMES_SQL, frames_of
from .records import OCR_KEY as FOLD_KEY
from .search import ASKED_SQL, MEDIA_SQL, TOPIC_FIELDS, asked, bm25_sql, bodied, field_bm25_sql, media_info

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
MARKS = "[" + ", ".join(f"'{m}'" for m in BOILERPLATE) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split({FOLD_KEY.format(text)}, ' '), lambda x: length(x) > 1 AND x NOT IN {STOP})"


TRANSCRIPTS_SQL = "transcripts AS (SELECT video_id, string_agg(text, ' ' ORDER BY segment_index) AS text, arg_min(text, segment_index) AS title FROM speech GROUP BY video_id)"


def transcripts(spark, d):
    return X.speech(spark, d).groupBy("video_id").agg(F.array_join(documents.ordered_texts(["segment_index"], "text"), " ").alias("text"), F.min_by("text", "segment_index").alias("title"))


def titles(spark, d):
    """The first segment of each video as its title."""
    return X.speech(spark, d).groupBy("video_id").agg(F.min_by("text", "segment_index").alias("title"))


@query(with_views("speech", body=f"SELECT {FOLD_KEY.format('text')} AS key, count(DISTINCT video_id) AS videos FROM speech WHERE {FOLD_KEY.format('text')} <> '' GROUP BY 1"))
def segment_doc_frequency(spark, d):
    return enrichment.segment_frequency(X.speech(spark, d))


GRAMS_SQL = f""", w AS (SELECT video_id, title, string_split({FOLD_KEY.format('text')}, ' ') AS w FROM transcripts),
g AS (SELECT video_id, title, unnest(list_concat([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS phrase FROM w)"""


@query(with_views("speech", body=f", {TRANSCRIPTS_SQL}{GRAMS_SQL} SELECT phrase, count(DISTINCT video_id) AS videos FROM g GROUP BY phrase"))
def phrase_doc_frequency(spark, d):
    return enrichment.phrase_frequency(X.speech(spark, d))


@query(with_views("ocr_lines", body=f", h AS (SELECT keyframe_id || ':' || position AS video_id, sha256({FOLD_KEY.format('text')}) AS text_hash FROM ocr_lines) SELECT text_hash, min(video_id) AS first_video, count(*) AS videos FROM h GROUP BY 1 HAVING count(*) > 1"))
def duplicate_transcripts(spark, d):
    lines = X.ocr_lines(spark, d).select(F.concat_ws(":", "keyframe_id", "position").alias("video_id"), "text")
    return enrichment.duplicate_transcripts(lines)


INFO_SQL = f""", k AS (SELECT *, {FOLD_KEY.format('text')} AS key, len({tokens_sql('text')}) AS tokens FROM speech), f AS (SELECT key, count(DISTINCT video_id) AS videos FROM k WHERE key <> '' GROUP BY key),
first AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY video_id, key ORDER BY segment_index, segment_id) = 1),
info AS (SELECT first.*, videos FROM first JOIN f USING (key) WHERE tokens >= 3 AND len(list_filter({MARKS}, lambda m: contains(key, m))) = 0 AND NOT (videos >= 4 AND tokens < 18))"""


@query(with_views("speech", body=INFO_SQL + " SELECT segment_id, CAST(tokens AS INTEGER) AS tokens, videos FROM info"))
def informative_segments(spark, d):
    s = X.speech(spark, d)
    return enrichment.informative_segments(s, enrichment.segment_frequency(s)).select("segment_id", "tokens", "videos")


@query(with_views("speech", body=f""", p AS (SELECT *, start_time - coalesce(lag(end_time) OVER (PARTITION BY video_id ORDER BY segment_index, segment_id), 0) AS pause, {FOLD_KEY.format('text')} AS key FROM speech)
SELECT segment_id, round(pause, 6) AS pause FROM p WHERE start_time >= 30 AND (pause >= 2.4 OR len(list_filter(['trong phan sau', 'tiep theo', 'mo dau chuong trinh', 'thong tin an ninh', 'thong tin quoc te'], lambda c: contains(key, c))) > 0)"""))
def news_leads(spark, d):
    return enrichment.news_leads(X.speech(spark, d)).select("segment_id", F.round("pause", 6).alias("pause"))


@query(with_views("speech", body=f""", n AS (SELECT segment_id, video_id, segment_index, CAST(substr(video_id, 2) AS BIGINT) AS v, segment_index * 6 + 1.0::DOUBLE AS start_time, text FROM speech),
c AS (SELECT *, CASE WHEN segment_index = 1 AND v % 3 = 0 THEN 'Nổi bật sau đây: ' WHEN segment_index = 2 AND v % 5 = 0 THEN 'Xin chào tất cả các bạn! ' ELSE '' END || text AS said FROM n),
k AS (SELECT *, {FOLD_KEY.format('said')} AS key, row_number() OVER w AS no, max(CAST(start_time > 38 AS INTEGER)) OVER (w ROWS UNBOUNDED PRECEDING) AS late FROM c WINDOW w AS (PARTITION BY video_id ORDER BY segment_index, segment_id)),
f AS (SELECT *, coalesce(min(no) FILTER (no <= 12 AND len(list_filter(['noi bat sau day', 'noi dung dang chu y sau day', 'noi dung chinh sau day', 'thong tin duoc quan tam'], lambda m: contains(key, m))) > 0) OVER (PARTITION BY video_id), 0) AS cue FROM k)
SELECT segment_id FROM f WHERE no > cue AND late = 0 AND len(list_filter({MARKS}, lambda m: contains(key, m))) = 0 AND len({tokens_sql('said')}) >= 5"""))
def news_headlines(spark, d):
    """Some videos announce their headlines, some greet in between."""
    v, at = F.substring("video_id", 2, 20).cast("long"), F.col("segment_index")
    head = F.when((at == 1) & (v % 3 == 0), "Nổi bật sau đây: ").when((at == 2) & (v % 5 == 0), "Xin chào tất cả các bạn! ").otherwise("")
    s = X.speech(spark, d).select("segment_id", "video_id", "segment_index", (at * 6 + 1.0).cast("double").alias("start_time"), F.concat(head, "text").alias("text"))
    return enrichment.news_headlines(s).select("segment_id")


STATUS_SQL = """ SELECT video_id, CASE WHEN tw <= 25 OR iw <= 20 THEN 'insufficient' WHEN iw / greatest(tw, 1) < 0.12 THEN 'boilerplate_only' WHEN iw < 140 THEN 'sparse' ELSE 'usable' END AS status,
 CASE WHEN tw <= 25 OR iw <= 20 OR iw / greatest(tw, 1) < 0.12 OR iw < 140 THEN 'low' WHEN iw >= 700 AND lp >= -0.35 THEN 'high' ELSE 'medium' END AS quality, coverage FROM j"""


@query(with_views("speech", body=f", {TRANSCRIPTS_SQL}{INFO_SQL}" + f""", a AS (SELECT video_id, sum(tokens) AS iw FROM info GROUP BY 1), b AS (SELECT video_id, sum(tokens) AS tw, -avg(length(text) % 10) / 10.0::DOUBLE AS lp FROM k GROUP BY 1),
c AS (SELECT video_id, list_distinct(list_filter({tokens_sql('title')}, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+'))) AS tt, {tokens_sql('text')} AS xt FROM transcripts),
j AS (SELECT b.video_id, tw, coalesce(iw, 0) AS iw, lp, CASE WHEN len(tt) > 0 THEN round(len(list_intersect(tt, xt)) / len(tt), 3) END AS coverage FROM b LEFT JOIN a USING (video_id) JOIN c ON c.video_id = b.video_id)""" + STATUS_SQL))
def transcript_status(spark, d):
    s = X.speech(spark, d)
    info = enrichment.informative_segments(s, enrichment.segment_frequency(s)).groupBy("video_id").agg(F.sum("tokens").alias("iw"))
    all_ = s.groupBy("video_id").agg(F.sum(F.size(content_tokens(F.col("text")))).alias("tw"), (-F.avg(F.length("text") % 10) / 10.0).alias("lp"))
    rows = all_.join(info, "video_id", "left").withColumn("iw", F.coalesce("iw", F.lit(0))).join(transcripts(spark, d), "video_id")
    status = enrichment.transcript_status(F.col("tw"), F.col("iw"), F.col("lp"), F.lit(True), F.lit(False))
    return rows.select("video_id", status.alias("s"), enrichment.title_coverage(F.col("title"), F.col("text")).alias("coverage")).select("video_id", "s.status", "s.quality", "coverage")


SUBJECT_SQL = GRAMS_SQL + f""", fr AS (SELECT phrase, count(DISTINCT video_id) AS videos FROM g GROUP BY phrase), n AS (SELECT count(*) AS n FROM transcripts),
t AS (SELECT video_id, {tokens_sql('title')} AS tt FROM transcripts),
pw AS (SELECT g.video_id, phrase, string_split(phrase, ' ') AS p, tt FROM g JOIN t USING (video_id)),
ok AS (SELECT *, list_filter(p, lambda x: x NOT IN {STOP}) AS content FROM pw WHERE p[1] NOT IN {STOP} AND p[-1] NOT IN {STOP} AND len(list_filter(p, lambda x: length(x) < 3)) = 0
 AND len(list_filter(['video', 'kenh', 'subscribe', 'hap dan', 'chuong trinh', 'tin tuc nhanh', 'tin thoi su', 'tin tuc the gioi'], lambda m: contains(phrase, m))) = 0 AND len(list_filter({MARKS}, lambda m: contains(phrase, m))) = 0),
c AS (SELECT video_id, phrase, any_value(tt) AS tt, any_value(content) AS content, CAST(sum(1 + CAST(list_has_any(p, tt) AS INTEGER)) AS BIGINT) AS count FROM ok WHERE len(content) >= 2 GROUP BY 1, 2),
sc AS (SELECT video_id, phrase, count, round((1 + ln(count)) * ln((n + 1) / (videos + 1) + 1), 6) AS score FROM c JOIN fr USING (phrase), n WHERE count >= 2 OR list_has_all(tt, content))"""


@query(with_views("speech", body=f", {TRANSCRIPTS_SQL}{SUBJECT_SQL} SELECT * FROM sc"))
def subject_scores(spark, d):
    return enrichment.subject_scores(X.speech(spark, d), titles(spark, d))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_views("speech", body=f", {TRANSCRIPTS_SQL}{SUBJECT_SQL}" + f""", o AS (SELECT video_id, phrase, score, list_filter(list_distinct(string_split(phrase, ' ')), lambda x: x NOT IN {STOP}) AS w, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, phrase) AS i FROM sc),
k AS (SELECT video_id, i, phrase, score, true AS taken, [w] AS kept FROM o WHERE i = 1
 UNION ALL SELECT o.video_id, o.i, o.phrase, o.score, t, CASE WHEN t THEN list_append(k.kept, o.w) ELSE k.kept END FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1,
  LATERAL (SELECT len(k.kept) < 8 AND len(list_filter(k.kept, lambda v: len(list_intersect(v, o.w)) / greatest(1, len(list_distinct(list_concat(v, o.w)))) >= 0.65)) = 0 AS t))
SELECT video_id, CAST(len(kept) AS INTEGER) AS rank, phrase, score FROM k WHERE taken""")))
def subject_terms(spark, d):
    return enrichment.subject_terms(subject_scores(spark, d))


_TOPIC_HELD = "(contains(lower(d.title), lower(trim(q.text))) OR contains(lower(d.topic), lower(trim(q.text))))"


@query(with_views("speech", "keyframes", body=f", {TRANSCRIPTS_SQL}{SUBJECT_SQL}{INFO_SQL}, " + MEDIA_SQL + """,
kp AS (SELECT substr(video_id, 2) AS video_id, string_agg(text, ' ' ORDER BY segment_index) AS key_points FROM info GROUP BY 1),
su0 AS (SELECT video_id, phrase, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, phrase) AS i FROM sc QUALIFY i <= 8),
su AS (SELECT substr(video_id, 2) AS video_id, string_agg(phrase, ', ' ORDER BY i) AS subject_terms FROM su0 GROUP BY 1),
docs AS (SELECT video_id AS doc_id, title, topic, description, key_points, subject_terms FROM media LEFT JOIN kp USING (video_id) LEFT JOIN su USING (video_id)),
search_queries AS (SELECT item_id AS query_id, text FROM benchmark), titled AS (SELECT CAST(video_id AS BIGINT) + 2000000 AS query_id, substr(title, 3, 20) AS text FROM media WHERE CAST(video_id AS BIGINT) % 20 = 0),
spoken AS (SELECT CAST(substr(video_id, 2) AS BIGINT) + 3000000 AS query_id, phrase AS text FROM su0 WHERE i = 1), """
       + ASKED_SQL.replace("asked AS (", "asked AS (SELECT query_id, text FROM titled UNION ALL SELECT query_id, text FROM spoken UNION ALL ") + "," + field_bm25_sql("docs", "asked", TOPIC_FIELDS, 5) + f""",
held AS (SELECT q.query_id, d.doc_id FROM docs d JOIN asked q ON {_TOPIC_HELD} WHERE regexp_matches(q.text, '[\\p{{L}}\\p{{N}}_]')),
merged AS (SELECT query_id, doc_id, score FROM ranked UNION ALL SELECT query_id, doc_id, 0 FROM held ANTI JOIN ranked USING (query_id, doc_id)),
found AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM merged QUALIFY rank <= 5),
ff AS (SELECT video_id AS v, min(keyframe_id) AS first_keyframe FROM keyframes GROUP BY 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id AS video_id, score, first_keyframe FROM found LEFT JOIN ff ON v = 'v' || doc_id"""))
def topic_search(spark, d):
    """Any term of title, topic, description, informative segments and subject terms, each field weighed, or a substring of
    title or topic; each hit with its video's first keyframe."""
    media, s = media_info(spark, d), X.speech(spark, d)
    info = enrichment.informative_segments(s, enrichment.segment_frequency(s)).groupBy(F.substring("video_id", 2, 20).alias("video_id")).agg(F.array_join(documents.ordered_texts(["segment_index"], "text"), " ").alias("key_points"))
    best = lexical.top_k(enrichment.subject_scores(s, titles(spark, d)).withColumnRenamed("video_id", "query_id"), 8, "phrase")
    best = X.stored(best, "subjects")  # of the documents and of the queries
    terms = best.groupBy(F.substring("query_id", 2, 20).alias("video_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]), ", ").alias("subject_terms"))
    docs = media.join(info, "video_id", "left").join(terms, "video_id", "left").select(F.col("video_id").alias("doc_id"), *TOPIC_FIELDS)
    docs = X.stored(docs, "topics")  # the search reads it several times
    n = F.col("doc_id").cast("long")
    titled = docs.where(n % 20 == 0).select((n + 2_000_000).alias("query_id"), F.substring("title", 3, 20).alias("text"))
    spoken = best.where("rank = 1").select((F.substring("query_id", 2, 20).cast("long") + 3_000_000).alias("query_id"), F.col("phrase").alias("text"))
    queries = X.stored(titled.unionByName(spoken).unionByName(asked(spark, d)), "asked")
    ranked = lexical.text_search(docs, queries, 5, columns=["title", "topic"], fields=TOPIC_FIELDS, many=True)
    first = X.keyframes(spark, d).groupBy(F.substring("video_id", 2, 20).alias("doc_id")).agg(F.min("keyframe_id").alias("first_keyframe"))
    return ranked.join(first, "doc_id", "left").withColumnRenamed("doc_id", "video_id")


#: Fields of a line on screen and their weights: the text to be searched counts, the others are looked through for substrings.
SCREEN_SQL = """screen AS (SELECT keyframe_id || ':' || position AS doc_id, lower(text) AS search_text, text, string_agg(text, ' ') OVER (PARTITION BY keyframe_id ORDER BY position ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS shot_text, confidence AS pts_time FROM ocr_lines)"""


@query(with_views("ocr_lines", "search_queries", body=", " + SCREEN_SQL + "," + ASKED_SQL + "," + field_bm25_sql("screen", "asked", {"search_text": 1.0}, 10, True, "pts_time") + """,
held AS (SELECT q.query_id, d.doc_id FROM screen d JOIN asked q ON contains(lower(d.text), lower(trim(q.text))) OR contains(lower(d.shot_text), lower(trim(q.text))) WHERE regexp_matches(q.text, '[\\p{L}\\p{N}_]')),
merged AS (SELECT query_id, doc_id, score FROM ranked UNION ALL SELECT query_id, doc_id, 0 FROM held ANTI JOIN ranked USING (query_id, doc_id))
SELECT query_id, doc_id, pts_time, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pts_time, doc_id) AS INTEGER) AS rank FROM merged JOIN screen USING (doc_id) QUALIFY rank <= 10"""))
def screen_text_search(spark, d):
    """Lines on screen: all terms of the searched text, or a substring of the line or of it with its neighbours; by score, then time."""
    from pyspark.sql import Window
    by = Window.partitionBy("keyframe_id").orderBy("position").rowsBetween(-1, 1)
    lines = X.ocr_lines(spark, d).select(F.concat_ws(":", "keyframe_id", "position").alias("doc_id"), F.lower("text").alias("search_text"), "text",
                                         F.array_join(F.collect_list("text").over(by), " ").alias("shot_text"), F.col("confidence").alias("pts_time"))
    return lexical.text_search(lines, asked(spark, d), 10, require_all=True, columns=["text", "shot_text"], fields={"search_text": 1.0}, then="pts_time")


@query("WITH t AS (SELECT CAST(page_id AS VARCHAR) AS video_id, split_part(url, '/', 5) AS topic FROM pages) SELECT video_id, CASE WHEN count(*) OVER (PARTITION BY topic) > 1 THEN topic || ' [' || video_id || ']' ELSE topic END AS topic FROM t WHERE topic IS NOT NULL")
def unique_topics(spark, d):
    t = X.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("video_id"), F.split_part("url", F.lit("/"), F.lit(5)).alias("topic")).where("topic IS NOT NULL")
    return enrichment.unique_topics(t)


@query(recursive(with_views("speech", body=""", o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY segment_index, segment_id) AS i FROM speech),
g AS (SELECT video_id, segment_id, i, start_time, end_time, text FROM o
 UNION ALL SELECT g.video_id, g.segment_id, o.i, g.start_time, o.end_time, g.text || ' ' || o.text FROM g JOIN o ON o.video_id = g.video_id AND o.i = g.i + 1 WHERE length(g.text) < 120 AND o.start_time - g.end_time <= 2.5 AND length(g.text) + length(o.text) <= 280)
SELECT video_id, segment_id, start_time, end_time, text FROM g QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY i DESC) = 1""")))
def sentence_windows(spark, d):
    return enrichment.sentence_windows(X.speech(spark, d))


@query()
def key_points(spark, d):
    s = X.speech(spark, d)
    windows = enrichment.sentence_windows(s)
    return enrichment.key_points(enrichment.window_scores(windows, s, titles(spark, d)))


@query(recursive(with_views("speech", body=f""", o AS (SELECT video_id, segment_index, text, list_distinct({tokens_sql('text')}) AS w, row_number() OVER (PARTITION BY video_id ORDER BY segment_index, text) AS i FROM speech),
k AS (SELECT video_id, segment_index, text, i, len(w) >= 3 AS taken, CASE WHEN len(w) >= 3 THEN [w] ELSE [] END AS kept FROM o WHERE i = 1
 UNION ALL SELECT o.video_id, o.segment_index, o.text, o.i, t, CASE WHEN t THEN list_append(k.kept, o.w) ELSE k.kept END FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1,
  LATERAL (SELECT len(o.w) >= 3 AND len(list_filter(k.kept, lambda v: len(list_intersect(v, o.w)) / len(list_distinct(list_concat(v, o.w))) >= 0.67)) = 0 AS t))
SELECT video_id, segment_index, text FROM k WHERE taken""")))
def near_duplicate_text(spark, d):
    s = X.speech(spark, d).select("video_id", "segment_index", "text")
    return selection.drop_near_texts(s, "video_id", "segment_index", 0.67)


def _vector_frames(spark, d):
    return X.vectors(spark, d).select("keyframe_id", "shot_id", "vector", F.col("vec_id").alias("frame_idx"), (F.col("vec_id") % 11 / 11.0).alias("quality_score"))


def _farthest_sql(k: int) -> str:
    """CTEs c1 ... ck: shots with more than k frames and the frames chosen so far."""
    far = "0.65::DOUBLE * (1 - list_max([list_dot_product(f.vector, c.vector) FOR c IN chosen])) + 0.20::DOUBLE * list_min([abs(f.frame_idx - c.frame_idx) FOR c IN chosen]) / span + 0.15::DOUBLE * quality"
    out = [f"""f AS (SELECT keyframe_id, shot_id, vec_id AS frame_idx, vec_id % 11 / 11.0::DOUBLE AS quality, CAST(vector AS DOUBLE[]) AS vector FROM vectors),
l AS (SELECT shot_id, unnest(vector) AS x, unnest(range(0, len(vector))) AS pos FROM f), mp AS (SELECT shot_id, pos, avg(x) AS x FROM l GROUP BY ALL), m AS (SELECT shot_id, list(x ORDER BY pos) AS mean FROM mp GROUP BY shot_id),
s AS (SELECT shot_id, count(*) AS n, CAST(greatest(max(frame_idx) - min(frame_idx), 1) AS DOUBLE) AS span FROM f GROUP BY shot_id),
c1 AS (SELECT shot_id, span, [{{'keyframe_id': keyframe_id, 'frame_idx': frame_idx, 'vector': vector}}] AS chosen FROM f JOIN s USING (shot_id) JOIN m USING (shot_id) WHERE n > {k}
 QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY round(0.65::DOUBLE * quality + 0.35::DOUBLE * list_dot_product(vector, mean), 9) DESC, frame_idx, keyframe_id) = 1)"""]
    for i in range(2, k + 1):
        out.append(f"""c{i} AS (SELECT shot_id, span, list_append(chosen, {{'keyframe_id': keyframe_id, 'frame_idx': frame_idx, 'vector': f.vector}}) AS chosen FROM f JOIN c{i - 1} USING (shot_id)
 WHERE NOT list_contains([c.keyframe_id FOR c IN chosen], keyframe_id) QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY round({far}, 9) DESC, frame_idx, keyframe_id) = 1)""")
    return ",\n".join(out)


@query(with_views("vectors", body=f", {_farthest_sql(4)} SELECT shot_id, c.keyframe_id, c.frame_idx FROM (SELECT shot_id, unnest(chosen) AS c FROM c4) UNION ALL SELECT shot_id, keyframe_id, frame_idx FROM f JOIN s USING (shot_id) WHERE n <= 4"))
def farthest_point(spark, d):
    return selection.farthest_points(_vector_frames(spark, d), 4)


@query()
def cluster_reps(spark, d):
    frames = _vector_frames(spark, d).withColumn("window_no", F.floor(F.col("frame_idx") / 25))
    return selection.cluster_representatives(frames, ["shot_id", "window_no"], 0.9)


@query(recursive(with_views("vectors", body=""", h AS (SELECT keyframe_id, shot_id, vec_id % 11 / 11.0::DOUBLE AS q, list_sum([CASE WHEN vector[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END FOR i IN range(0, 63)])::BIGINT AS b FROM vectors),
o AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY q DESC, keyframe_id) AS i FROM h),
k AS (SELECT shot_id, keyframe_id, i, true AS taken, [b] AS kept FROM o WHERE i = 1
 UNION ALL SELECT o.shot_id, o.keyframe_id, o.i, t, CASE WHEN t THEN list_append(k.kept, o.b) ELSE k.kept END FROM k JOIN o ON o.shot_id = k.shot_id AND o.i = k.i + 1, LATERAL (SELECT len(list_filter(k.kept, lambda v: bit_count(xor(v, o.b)) < 20)) = 0 AS t))
SELECT shot_id, keyframe_id FROM k WHERE taken""")))
def phash_dedupe(spark, d):
    signs = F.aggregate(F.transform(F.slice("vector", 1, 63), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return selection.drop_near_hashes(_vector_frames(spark, d).withColumn("phash", signs), least=20)


@query(with_views("keyframes", body=""", o AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY frame_idx, keyframe_id) AS i, first_value(event_type) OVER (PARTITION BY shot_id ORDER BY frame_idx, keyframe_id) AS f FROM keyframes)
SELECT shot_id, keyframe_id, CASE WHEN i = 1 THEN 'shot_representative' ELSE 'evidence_change' END AS reason FROM o WHERE i = 1 OR event_type <> f QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY i) <= 2"""))
def evidence_change(spark, d):
    return selection.evidence_changes(X.keyframes(spark, d).select("shot_id", "keyframe_id", "frame_idx", F.col("event_type").alias("signature")))


@query(r"""WITH n AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[ –—,;:-]+|[ –—,;:-]+$', '', 'g') AS t FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN length(t) > 320 THEN regexp_replace(regexp_replace(substr(t, 1, 321), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' ELSE t END AS t FROM n)
SELECT conv_id, turn, CASE WHEN t = '' THEN t WHEN regexp_matches(t, '[.!?…]$') THEN upper(t[1]) || substr(t, 2) ELSE upper(t[1]) || substr(t, 2) || '.' END AS sentence FROM c""")
def clean_sentences(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", clean_text(F.col("text")).alias("sentence"))


def _cued(*labels: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(said, '{'|'.join(documents.CAPTION_CUES[cues])}') THEN '{label}'" for cues, label in (x.split(":") for x in labels)) + " END"


@query(f"""WITH b AS (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'Trong nhà, trời mưa ' WHEN 1 THEN 'ngoài trời ban đêm ' WHEN 2 THEN 'hoàng hôn ' ELSE '' END || text) AS said, CASE WHEN doc_id % 3 = 0 THEN 'indoor' ELSE 'unknown' END AS e, 'daytime' AS t, CASE WHEN doc_id % 5 = 0 THEN 'sunny' ELSE 'unknown' END AS w FROM documents),
c AS (SELECT *, {_cued("indoor:indoor", "outdoor:outdoor")} AS e2, {_cued("night:night", "daytime:daytime", "uncertain_time:unknown")} AS t2, {_cued("rain:rain", "sunny:sunny")} AS w2 FROM b),
f AS (SELECT *, coalesce(e2, e) AS environment, coalesce(t2, t) AS time_of_day, coalesce(w2, w) AS weather0 FROM c)
SELECT doc_id, environment, time_of_day, CASE WHEN environment = 'indoor' THEN 'unknown' ELSE weather0 END AS weather, concat_ws(',', CASE WHEN e2 <> e THEN 'caption_forced_' || e2 END, CASE WHEN t2 = 'unknown' THEN 'caption_cleared_uncertain_time' WHEN t2 <> t THEN 'caption_forced_' || t2 END,
 CASE WHEN w2 <> w THEN 'caption_forced_' || w2 END, CASE WHEN environment = 'indoor' AND weather0 <> 'unknown' THEN 'indoor_cleared_weather' END) AS notes FROM f""")
def scene_crosscheck(spark, d):
    """Captions are the documents' texts, three in four with cues before them."""
    cue = F.element_at(F.array(F.lit("Trong nhà, trời mưa "), F.lit("ngoài trời ban đêm "), F.lit("hoàng hôn "), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = X.table(spark, d, "documents").select("doc_id", F.concat(cue, "text").alias("caption"), F.array().cast("array<string>").alias("actions"), F.when(F.col("doc_id") % 3 == 0, "indoor").otherwise("unknown").alias("environment"),
                                                 F.lit("daytime").alias("time_of_day"), F.when(F.col("doc_id") % 5 == 0, "sunny").otherwise("unknown").alias("weather"))
    return documents.crosscheck_scene(rows).select("doc_id", "environment", "time_of_day", "weather", F.array_join("notes", ",").alias("notes"))


@query("SELECT CAST(o_orderpriority AS VARCHAR) AS scope FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all'")
def scope_options(spark, d):
    return ledger.scope_options(X.table(spark, d, "orders"), "o_orderpriority")


@query("""WITH l AS (SELECT o_custkey AS run_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'error' ELSE 'running' END AS status, o_orderdate AS done_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT run_id, status, CASE WHEN status = 'completed' THEN seq ELSE -1 END AS items, CASE WHEN status = 'error' THEN 'failed' END AS error, CASE WHEN status = 'completed' THEN CAST(done_at AS VARCHAR) END AS completed_at FROM l""")
def run_ledger(spark, d):
    log = X.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "error").otherwise("running").alias("status"),
                                             F.col("o_orderkey").alias("items"), F.lit("failed").alias("error"), F.col("o_orderdate").cast("string").alias("at"))
    return ledger.run_ledger(log).withColumn("items", F.coalesce("items", F.lit(-1)))


@query("WITH k AS (SELECT source, list_sort(list_distinct(list(lang))) AS a FROM documents GROUP BY source) SELECT source, array_to_string(list_concat(a, [upper(source), 'film']), ',') AS keywords FROM k")
def keyword_lists(spark, d):
    k = X.table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("a"))
    return k.select("source", F.array_join(keyword_union(F.col("a"), F.array(F.upper("source"), F.concat("source", F.lit("!")), F.lit("film"), F.lit(" - "))), ",").alias("keywords"))


@query(with_views("speech", body=f", {TRANSCRIPTS_SQL}" + f""", t AS (SELECT video_id, CASE WHEN length(text) % 3 = 0 THEN 'sparse' ELSE 'usable' END AS status, title AS summary, length(text) % 5 = 0 AS conflict, sha256({FOLD_KEY.format('text')}) AS text_hash FROM transcripts),
s AS (SELECT *, count(*) OVER (PARTITION BY summary) > 1 AS a, count(*) OVER (PARTITION BY text_hash) > 1 AS b FROM t) SELECT status, count(*) AS videos, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (a) AS duplicate_summaries, count(*) FILTER (b) AS duplicate_transcripts FROM s GROUP BY status"""))
def enrichment_report(spark, d):
    from ..functions.text import fold_key
    t = transcripts(spark, d).select("video_id", F.when(F.length("text") % 3 == 0, "sparse").otherwise("usable").alias("status"), F.col("title").alias("summary"), (F.length("text") % 5 == 0).alias("conflict"), F.sha2(fold_key(F.col("text")), 256).alias("text_hash"))
    return enrichment.enrichment_report(t)


@query(bodied(bm25_sql("documents", "search_queries", 40), """, p AS (SELECT query_id, doc_id, rank FROM ranked JOIN search_documents USING (doc_id) WHERE level IN ('frame', 'shot') AND end_time >= 60 AND start_time <= 400)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS new_rank FROM p QUALIFY new_rank <= 10""", "search_queries", "search_documents"))
def post_filtered_search(spark, d):
    """Over-fetched lexical answers filtered after retrieval."""
    docs = X.search_documents(spark, d)
    ranked = lexical.bm25(docs.select("doc_id", "text"), X.queries(spark, d), 40)
    return fusion.post_filter(ranked, docs.drop("text"), 10, ["frame", "shot"], low=60.0, high=400.0).select("query_id", "doc_id", "new_rank")


@query("SELECT event_id, user_id, event_type FROM events")
def streaming_ingest(spark, d):
    """Events as files that arrive, kept by user."""
    at, schema = X.new_folder(spark, "stream"), X.table(spark, d, "events").schema
    stream = ingest.file_stream(spark, f"{d}/events.parque[t]", schema)
    ingest.ingest_by_video(stream.withColumn("part", F.col("user_id") % 16), f"{at}/table", f"{at}/log", "part").awaitTermination()
    return ingest.read_target(spark, f"{at}/table", schema).select("event_id", "user_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def streaming_latest(spark, d):
    """Latest order of each customer from an append log that arrives as files."""
    at, schema = X.new_folder(spark, "stream"), X.table(spark, d, "orders").schema
    stream = ingest.file_stream(spark, f"{d}/orders.parque[t]", schema)
    ingest.keep_latest(stream, f"{at}/table", f"{at}/log", ["o_custkey"], ["o_orderdate", "o_orderkey"], 8).awaitTermination()
    return ingest.read_target(spark, f"{at}/table", schema).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(with_views("speech", body="SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"))
def streaming_refresh(spark, d):
    """Transcripts of the conversations that new files touch, rebuilt from all their turns."""
    at = X.new_folder(spark, "stream")
    stream = ingest.file_stream(spark, f"{d}/conversations.parque[t]", X.table(spark, d, "conversations").schema).withColumn("part", F.col("conv_id") % 16)
    source = lambda s: X.table(s, d, "conversations").withColumn("part", F.col("conv_id") % 16)
    build = lambda rows: rows.groupBy("part", "conv_id").agg(F.array_join(documents.ordered_texts(["turn"], "text"), " ").alias("text"))
    ingest.refresh_touched(stream, source, build, f"{at}/table", f"{at}/log", "part").awaitTermination()
    return ingest.read_target(spark, f"{at}/table", "conv_id long, text string").select("conv_id", "text")


#: Parts in which frame documents are kept and rebuilt.
FRAME_PARTS = 16


def refresh_frames(spark, d, at: str, files: int = 100):
    """Frame documents kept in ``at`` as files of events (keyframes, their texts and detections) and of speech arrive, from
    either of them first. Returns the started query."""
    streams = [ingest.file_stream(spark, f"{d}/{name}.parque[t]", X.table(spark, d, name).schema, files).select((F.col(c) % FRAME_PARTS).alias("part")) for name, c in (("events", "user_id"), ("conversations", "conv_id"))]

    def build(touched):
        own = lambda name, c: X.table(touched.sparkSession, d, name).join(touched, F.col(c) % FRAME_PARTS == F.col("part"), "left_semi")
        made = frames_of(touched.sparkSession, d, own("events", "user_id"), own("conversations", "conv_id"))
        return made.select("doc_id", "shot_id", "frame_idx", "caption", "search_text", "asr_text", "confidence", (F.substring("video_id", 2, 20).cast("long") % FRAME_PARTS).alias("part"))

    return ingest.refresh_from(streams, build, f"{at}/table", f"{at}/log", "part")


@query(with_views("keyframes", "speech", "detections", body="," + FRAMES_SQL + " SELECT doc_id, shot_id, frame_idx, caption, search_text, asr_text, confidence FROM fd"))
def streaming_frame_documents(spark, d):
    """Frame documents refreshed from two streams."""
    at = X.new_folder(spark, "stream")
    refresh_frames(spark, d, at).awaitTermination()
    columns = "doc_id string, shot_id string, frame_idx long, caption string, search_text string, asr_text string, confidence double"
    return ingest.read_target(spark, f"{at}/table", columns).drop("part")
