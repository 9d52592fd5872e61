"""Search, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO
from ..operators import cells, encoder, evaluate, fusion, lexical, temporal, vectors
from . import fixtures as X
from .fixtures import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

K = 10
FOLD = f"translate(text, '{FOLD_FROM}', '{FOLD_TO}')"
TOKENS = r"regexp_extract_all(lower(replace({}, 'ß', 'ss')), '([\p{{L}}\p{{N}}_]+)', 1)"
TERMS = r"list_distinct(regexp_extract_all(lower(replace({}, 'ß', 'ss')), '([\p{{L}}\p{{N}}]+)', 1))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def bm25_sql(docs: str, queries: str, k: int = K, where: str = "true", all_terms: bool = False, fold: bool = True, p: str = "", level: str = "") -> str:
    """CTEs up to ``{p}ranked`` (query_id, doc_id, score, rank); ``level``: an expression whose values are ranked apart."""
    text = FOLD if fold else "text"
    return f"""
{p}tok AS (SELECT doc_id, {TOKENS.format(text)} AS w FROM {docs}),
{p}st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_length FROM {p}tok),
{p}tf AS (SELECT token, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS token FROM {p}tok) GROUP BY ALL),
{p}dfs AS (SELECT token, count(*) AS df FROM {p}tf GROUP BY token),
{p}terms AS (SELECT DISTINCT query_id, unnest({TERMS.format(text)}) AS token FROM {queries}),
{p}nt AS (SELECT query_id, count(*) AS n_terms FROM {p}terms GROUP BY query_id),
{p}scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score, count(*) AS matched
  FROM {p}terms JOIN {p}tf USING (token) JOIN {p}dfs USING (token), {p}st WHERE {where} GROUP BY query_id, doc_id),
{p}ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id{", " + level if level else ""} ORDER BY score DESC, doc_id) AS rank
  FROM {p}scored {f"JOIN {p}nt USING (query_id) WHERE matched = n_terms" if all_terms else ""} QUALIFY rank <= {k})"""


def bodied(ctes: str, body: str, *views: str) -> str:
    head = with_views(*views, body="")
    return head.rstrip() + "," + ctes + "\n" + body


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format("text")} AS w FROM documents)
SELECT token, doc_id, length, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS INTEGER) AS length, unnest(w) AS token FROM t) GROUP BY ALL""")
def bm25_postings(spark, d):
    return lexical.postings(X.table(spark, d, "documents"))


@query(bodied(bm25_sql("documents", "search_queries"), "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked", "search_queries"))
def bm25_search(spark, d):
    return lexical.bm25(X.table(spark, d, "documents").select("doc_id", "text"), X.queries(spark, d), K)


FILTER = "doc_id IN (SELECT doc_id FROM search_documents WHERE level IN ('frame', 'shot') AND end_time >= 60 AND start_time <= 400 AND facet = 'en')"


@query(bodied(bm25_sql("documents", "search_queries", where=FILTER), "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked", "search_queries", "search_documents"))
def bm25_search_filtered(spark, d):
    docs = X.search_documents(spark, d)
    allowed = lexical.filter_time(lexical.filter_level(docs, ["frame", "shot"]), 60.0, 400.0)
    allowed = lexical.filter_facets(allowed, docs.select("doc_id", "facet"), ["en"])
    return lexical.bm25(docs.select("doc_id", "text"), X.queries(spark, d), K, allowed)


def field_bm25_sql(docs: str, queries: str, fields: dict[str, float], k: int = K, all_terms: bool = False, then: str = "doc_id", p: str = "") -> str:
    """CTEs up to ``{p}ranked`` (query_id, doc_id, score, rank) over several columns of ``docs``; equal scores by ``then`` of docs."""
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in fields.items()) + " END"
    return f"""
{p}ft AS (SELECT doc_id, unnest([{", ".join(f"'{f}'" for f in fields)}]) AS field, unnest([{", ".join(f"coalesce({f}, '')" for f in fields)}]) AS text FROM {docs}),
{p}tok AS (SELECT doc_id, field, {TOKENS.format(FOLD)} AS w FROM {p}ft),
{p}st AS (SELECT field, count(*) AS n_docs, avg(len(w)) AS avg_length FROM {p}tok GROUP BY field),
{p}tf AS (SELECT field, token, doc_id, length, count(*) AS tf FROM (SELECT field, doc_id, len(w) AS length, unnest(w) AS token FROM {p}tok) GROUP BY ALL),
{p}dfs AS (SELECT field, token, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}terms AS (SELECT DISTINCT query_id, unnest({TERMS.format(FOLD)}) AS token FROM {queries}),
{p}nt AS (SELECT query_id, count(*) AS n_terms FROM {p}terms GROUP BY query_id),
{p}scored AS (SELECT query_id, doc_id, round(sum({weight} * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score, count(DISTINCT token) AS matched
  FROM {p}terms JOIN {p}tf USING (token) JOIN {p}dfs USING (field, token) JOIN {p}st USING (field) GROUP BY query_id, doc_id),
{p}ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.{then}, doc_id) AS rank
  FROM {p}scored JOIN {docs} d USING (doc_id) {f"JOIN {p}nt USING (query_id) WHERE matched = n_terms" if all_terms else ""} QUALIFY rank <= {k})"""


def text_search_sql(docs: str, queries: str, k: int = K, all_terms: bool = False, held: str = "contains(lower(text), lower(trim(q.text)))") -> str:
    """``bm25_sql`` and, with score 0, the documents that hold the query's text otherwise, up to ``found``."""
    held = held.replace("text)", "d.text)", 1) if held.startswith("contains(lower(text)") else held
    return bm25_sql(docs, queries, k, all_terms=all_terms) + f""",
held AS (SELECT q.query_id, d.doc_id FROM {docs} d JOIN {queries} q ON {held} WHERE regexp_matches(q.text, '[\\p{{L}}\\p{{N}}_]')),
merged AS (SELECT query_id, doc_id, score FROM ranked UNION ALL SELECT query_id, doc_id, 0 FROM held ANTI JOIN ranked USING (query_id, doc_id)),
found AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM merged QUALIFY rank <= {k})"""


#: The benchmark's texts, and of each a piece that starts and ends inside words, which only a substring can find.
ASKED_SQL = "asked AS (SELECT query_id, text FROM search_queries UNION ALL SELECT query_id + 1000000, substr(text, 4, 25) FROM search_queries)"


def asked(spark, d):
    q = X.queries(spark, d).select("query_id", "text")
    return q.unionByName(q.select((F.col("query_id") + 1_000_000).alias("query_id"), F.substring("text", 4, 25).alias("text")))


@query(bodied(ASKED_SQL + "," + text_search_sql("documents", "asked", all_terms=True), "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM found", "search_queries"))
def lexical_and_search(spark, d):
    """All terms or a substring, as text on screen is searched."""
    return lexical.text_search(X.table(spark, d, "documents").select("doc_id", "text"), asked(spark, d), K, require_all=True)


@query(bodied(bm25_sql("documents", "search_queries", all_terms=True), "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked", "search_queries"))
def caption_search(spark, d):
    """All terms, as captions are searched."""
    return lexical.bm25(X.table(spark, d, "documents").select("doc_id", "text"), X.queries(spark, d), K, require_all=True)


@query(bodied("docs AS (SELECT segment_id AS doc_id, text FROM speech)," + ASKED_SQL + "," + text_search_sql("docs", "asked") + """,
near AS (SELECT r.query_id, r.rank, r.doc_id, r.score, k.keyframe_id, row_number() OVER (PARTITION BY r.query_id, r.rank ORDER BY abs(k.pts_time - s.start_time), k.keyframe_id) AS rn
  FROM found r JOIN speech s ON s.segment_id = r.doc_id LEFT JOIN keyframes k ON k.video_id = s.video_id AND k.pts_time BETWEEN s.start_time AND s.end_time)""",
              "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score, keyframe_id FROM near WHERE rn = 1", "search_queries", "speech", "keyframes"))
def transcript_search(spark, d):
    """Any term or a substring, each hit with the keyframe inside the segment that is nearest to its start."""
    speech = X.speech(spark, d)
    ranked = lexical.text_search(speech.select(F.col("segment_id").alias("doc_id"), "text"), asked(spark, d), K)
    hits = ranked.join(speech.select(F.col("segment_id").alias("doc_id"), "video_id", "start_time", "end_time"), "doc_id")
    inside = temporal.nearest_inside(hits.select(F.col("doc_id").alias("segment_id"), "video_id", "start_time", "end_time").distinct(), X.keyframes(spark, d))
    return hits.join(inside.select(F.col("segment_id").alias("doc_id"), "keyframe_id"), "doc_id", "left").select("query_id", "rank", "doc_id", "score", "keyframe_id")


@query(with_views("detections", body=""", types AS (SELECT class_name, row_number() OVER (ORDER BY class_name) AS i FROM (SELECT DISTINCT class_name FROM detections)),
q AS (SELECT i AS query_id, upper(class_name) AS text FROM types UNION ALL SELECT 1000 + i, substr(class_name, 2, 3) FROM types UNION ALL SELECT 2000 + i, substr(class_name, 1, 1) FROM types)
SELECT query_id, keyframe_id, labels, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pts_time, keyframe_id) AS rank FROM (
 SELECT q.query_id, keyframe_id, pts_time, array_to_string(list_sort(list_distinct(list(class_name))), ', ') AS labels, max(confidence) AS score
 FROM detections JOIN q ON contains(lower(class_name), lower(q.text)) GROUP BY ALL)) WHERE rank <= 20"""))
def object_search(spark, d):
    """Each class by its whole name, by a piece of it and by its first letter."""
    found = X.detections(spark, d)
    # Every class is some event's own type, so the classes are known without the events before it; one row for each class.
    types = X.table(spark, d, "events").select(F.col("event_type").alias("class_name")).where("class_name IS NOT NULL").distinct()
    types = X.stored(types.withColumn("i", F.row_number().over(Window.orderBy("class_name"))), "classes")
    name = lambda add, text: types.select((F.col("i") + add).alias("query_id"), text.alias("text"))
    asked_ = name(0, F.upper("class_name")).unionByName(name(1000, F.substring("class_name", 2, 3))).unionByName(name(2000, F.substring("class_name", 1, 1)))
    return lexical.object_search(found, asked_, 20).select(F.col("query_id").cast("long").alias("query_id"), "keyframe_id", "labels", F.round("score", 6).alias("score"), "rank")


MEDIA_SQL = """media AS (SELECT CAST(page_id AS VARCHAR) AS video_id, url AS watch_url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
 regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS description, split_part(url, '/', 5) AS topic FROM pages)"""


def media_info(spark, d):
    return X.table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("video_id"), F.col("url").alias("watch_url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1).alias("description"), F.split_part("url", F.lit("/"), F.lit(5)).alias("topic"))


#: Fields of a video that topic search reads, and their weights.
TOPIC_FIELDS = {"title": 2.0, "topic": 2.0, "description": 1.0, "key_points": 1.0, "subject_terms": 1.0}


VECTOR_SQL = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"
DOT_SQL = "round(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 6)"


@query(with_views("vectors", "query_vectors", body=f", s AS (SELECT query_id, vec_id, {DOT_SQL} AS score FROM query_vectors q, vectors v) {VECTOR_SQL}"))
def vector_topk(spark, d):
    return vectors.exact_top_k(X.query_vectors(spark, d), X.vectors(spark, d), K)


@query(with_views("vectors", "query_vectors", body=f", s AS (SELECT query_id, vec_id, {DOT_SQL} AS score FROM query_vectors q JOIN vectors v ON q.wanted_video = v.video_id) {VECTOR_SQL}"))
def vector_topk_by_video(spark, d):
    return vectors.exact_top_k(X.query_vectors(spark, d), X.vectors(spark, d), K, match=("wanted_video", "video_id"))


@query()
def ivf_topk(spark, d):
    """A stored index of cells, built here, and its answers; each row has the recall measured when it was built."""
    path = X.new_folder(spark, "cells")
    cells.write_cells(X.vectors(spark, d).select("vec_id", "vector"), path, K)
    index = cells.open_cells(spark, path)
    return cells.search_cells(index, X.query_vectors(spark, d), K).withColumn("recall", F.lit(index.recall).cast("double"))


@query(with_views("vectors", "query_vectors", body=f""", long AS (SELECT shot_id, unnest(vector) AS x, unnest(range(0, len(vector))) AS pos FROM vectors),
m AS (SELECT shot_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM long GROUP BY ALL),
g AS (SELECT shot_id, list(x ORDER BY pos) AS mean FROM m GROUP BY shot_id),
n AS (SELECT shot_id, [x / greatest(sqrt(list_dot_product(mean, mean)), 1e-12) FOR x IN mean] AS vector FROM g),
b AS (SELECT query_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(CAST(q.vector AS DOUBLE[]), n.vector), 6) DESC, shot_id) AS r FROM query_vectors q, n QUALIFY r <= 5),
s AS (SELECT b.query_id, vec_id, {DOT_SQL} AS score FROM b JOIN vectors v USING (shot_id) JOIN query_vectors q ON q.query_id = b.query_id) {VECTOR_SQL}"""))
def two_stage_topk(spark, d):
    return vectors.two_stage(X.query_vectors(spark, d), X.vectors(spark, d), 5, K)


#: Weights of the channels of level-aware search, text by level and vectors by level.
WEIGHTS = {"fts:event": 0.8, "fts:shot": 1.0, "fts:frame": 0.65, "ann:shot": 1.15, "ann:frame": 0.85}
CANDIDATES = 50


def _encoded(spark, d):
    """Vectors of documents (shots and frames) and of queries, in one space."""
    docs = X.search_documents(spark, d)
    weights = X.stored(encoder.bucket_weights(docs.select("doc_id", "text")), "weights")  # read by both, BUCKETS rows
    seen = encoder.encode(docs.where("level IN ('shot', 'frame')").select("doc_id", "text"), weights)
    return seen, encoder.encode(X.queries(spark, d).select("query_id", "text"), weights, "query_id")


def _near(spark, d, k):
    """(query_id, level, rank, doc_id): vectors of each level, ranked apart."""
    seen, asked = _encoded(spark, d)
    seen = X.stored(seen.join(X.search_documents(spark, d).select("doc_id", "level"), "doc_id"), "text-vectors")  # counted, then dealt
    asked = asked.select(F.explode(F.array(F.lit("shot"), F.lit("frame"))).alias("level"), "query_id", "vector")
    asked = asked.select("level", F.concat_ws(":", "query_id", "level").alias("query_id"), "vector")
    found = vectors.exact_top_k(asked, seen, k, "doc_id", match=("level", "level"))
    return found.select(F.split_part("query_id", F.lit(":"), F.lit(1)).cast("long").alias("query_id"), F.split_part("query_id", F.lit(":"), F.lit(2)).alias("level"), "rank", "doc_id", "score")


def _channels(spark, d, k=CANDIDATES):
    """(query_id, channel, rank, doc_id): BM25 and text vectors, each level ranked apart."""
    docs, queries = X.search_documents(spark, d), X.queries(spark, d)
    text = lexical.bm25(docs.select("doc_id", "text", "level"), queries, k, within="level").select("query_id", F.concat(F.lit("fts:"), "level").alias("channel"), "rank", "doc_id")
    near = _near(spark, d, k).select("query_id", F.concat(F.lit("ann:"), "level").alias("channel"), "rank", "doc_id")
    return text.unionByName(near)


#: The first 40 bits of a token's MD5.
_NUMBER = " + ".join(f"{16 ** (9 - j)}::BIGINT * (strpos('0123456789abcdef', substr(md5(token), {1 + j}, 1)) - 1)" for j in range(10))
_BUCKET = f"((h >> {7 * encoder.ENTRIES}) & 4095)"


def _vector_sql(name: str, rows: str, key: str) -> str:
    """CTE ``name`` (key, vector): text vectors of ``rows`` (key, text) with the weights ``bw``."""
    places = ", ".join(f"(h >> {7 * i}) & 63" for i in range(encoder.ENTRIES))
    signs = ", ".join(f"1 - 2 * ((h >> {7 * i + 6}) & 1)" for i in range(encoder.ENTRIES))
    return f"""{name}1 AS (SELECT {key}, h, count(*) AS tf FROM (SELECT {key}, {_NUMBER} AS h FROM (SELECT {key}, unnest({TOKENS.format(FOLD)}) AS token FROM {rows})) GROUP BY ALL),
{name}2 AS (SELECT {key}, tf * weight AS w, unnest([{places}]) AS place, unnest([{signs}]) AS sign FROM {name}1 JOIN bw ON bucket = {_BUCKET}),
{name}3 AS (SELECT {key}, place, sum(w * sign) AS v FROM {name}2 GROUP BY ALL), {name}4 AS (SELECT {key}, map(list(place), list(v)) AS m FROM {name}3 GROUP BY {key}),
{name}5 AS (SELECT {key}, [coalesce(m[i], 0.0::DOUBLE) FOR i IN range(0, {encoder.DIMS})] AS vector FROM {name}4),
{name} AS (SELECT {key}, [x / sqrt(list_dot_product(vector, vector)) FOR x IN vector] AS vector FROM {name}5 WHERE len(list_filter(vector, lambda x: abs(x) > 1e-9)) > 0)"""


#: CTEs up to ``nv`` (query_id, level, doc_id, rank) of all documents, without a limit.
NEAR_SQL = f"""
bh AS (SELECT doc_id, {_NUMBER} AS h FROM (SELECT doc_id, unnest({TOKENS.format(FOLD)}) AS token FROM search_documents)), bd AS (SELECT DISTINCT doc_id, {_BUCKET} AS bucket FROM bh),
bw AS (SELECT bucket, ln(1 + ((SELECT count(*) FROM search_documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS weight FROM bd GROUP BY bucket),
{_vector_sql("dv", "(SELECT doc_id, text FROM search_documents WHERE level IN ('shot', 'frame'))", "doc_id")},
{_vector_sql("qv", "search_queries", "query_id")},
nv AS (SELECT query_id, level, doc_id, {DOT_SQL.replace("v.vector", "dv.vector").replace("q.vector", "qv.vector")} AS score, row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, doc_id) AS rank
  FROM qv, dv JOIN search_documents USING (doc_id))"""

#: CTEs up to ``c`` (query_id, channel, rank, doc_id).
CHANNELS_SQL = (bm25_sql("search_documents", "search_queries", CANDIDATES, level="(SELECT level FROM search_documents s WHERE s.doc_id = x.doc_id)").replace("FROM scored ", "FROM scored x ") + "," + NEAR_SQL
                + f""",
c AS (SELECT query_id, 'fts:' || level AS channel, rank, doc_id FROM ranked JOIN search_documents USING (doc_id) UNION ALL SELECT query_id, 'ann:' || level, rank, doc_id FROM nv WHERE rank <= {CANDIDATES})""")

_WEIGHT = "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in WEIGHTS.items()) + " END"
RRF_SQL = f""", fused0 AS (SELECT query_id, doc_id, round(sum({_WEIGHT} / (60 + rank)), 9) AS score, count(*) AS channels, CAST(min(rank) AS INTEGER) AS best_rank FROM c GROUP BY query_id, doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused0)"""


@query(bodied(CHANNELS_SQL + RRF_SQL, "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, CAST(channels AS INTEGER) AS channels, best_rank FROM fused WHERE rank <= 10", "search_queries", "search_documents"))
def rrf_fuse(spark, d):
    fused = fusion.rrf(_channels(spark, d), K, WEIGHTS)
    return fused.select("query_id", "doc_id", "score", "rank", F.size("ranks").alias("channels"), F.array_min(F.map_values("ranks")).alias("best_rank"))


@query(bodied(CHANNELS_SQL + RRF_SQL + """, col AS (SELECT f.*, d.shot_id, d.level, row_number() OVER (PARTITION BY query_id, d.shot_id ORDER BY f.rank) AS r FROM fused f JOIN search_documents d USING (doc_id) WHERE f.rank <= 50)""",
              "SELECT query_id, doc_id, shot_id, level, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM col WHERE r = 1 WINDOW w AS (PARTITION BY query_id ORDER BY col.rank) QUALIFY row_number() OVER w <= 10", "search_queries", "search_documents"))
def hybrid_search(spark, d):
    """Text and vectors of every level fused, hydrated and collapsed by shot."""
    out = fusion.hybrid(_channels(spark, d), X.search_documents(spark, d).drop("text"), K, CANDIDATES, WEIGHTS)
    return out.select("query_id", "doc_id", "shot_id", "level", "score", F.col("new_rank").alias("rank"))


#: Filters of a whole search: levels, time and facet.
WANTED = "d.level IN ('frame', 'shot') AND d.end_time >= 60 AND d.start_time <= 400 AND d.facet = 'en'"
_FILTERED_SQL = (bm25_sql("search_documents", "search_queries", 20, where=f"doc_id IN (SELECT doc_id FROM search_documents d WHERE {WANTED})", level="(SELECT level FROM search_documents s WHERE s.doc_id = x.doc_id)").replace("FROM scored ", "FROM scored x ") + "," + NEAR_SQL
                 + f""",
nf AS (SELECT query_id, level, doc_id, row_number() OVER (PARTITION BY query_id, level ORDER BY nv.rank) AS rank FROM nv JOIN search_documents d USING (doc_id, level) WHERE nv.rank <= 80 AND {WANTED} QUALIFY row_number() OVER (PARTITION BY query_id, level ORDER BY nv.rank) <= 20),
c AS (SELECT query_id, 'fts:' || level AS channel, rank, doc_id FROM ranked JOIN search_documents USING (doc_id) UNION ALL SELECT query_id, 'ann:' || level, rank, doc_id FROM nf)""")


@query(bodied(_FILTERED_SQL + RRF_SQL + """, col AS (SELECT f.*, d.shot_id, d.level, row_number() OVER (PARTITION BY query_id, d.shot_id ORDER BY f.rank) AS r FROM fused f JOIN search_documents d USING (doc_id) WHERE f.rank <= 20)""",
              "SELECT query_id, doc_id, shot_id, level, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM col WHERE r = 1 WINDOW w AS (PARTITION BY query_id ORDER BY col.rank) QUALIFY row_number() OVER w <= 10", "search_queries", "search_documents"))
def filtered_hybrid_search(spark, d):
    """The whole chain under filters: BM25 filters before it ranks, vectors are over-fetched and filtered after; then
    fusion, documents' columns and one answer for each shot."""
    docs = X.search_documents(spark, d)
    allowed = lexical.filter_facets(lexical.filter_time(lexical.filter_level(docs, ["frame", "shot"]), 60.0, 400.0), docs.select("doc_id", "facet"), ["en"])
    text = lexical.bm25(docs.select("doc_id", "text", "level"), X.queries(spark, d), 20, allowed, within="level").select("query_id", F.concat(F.lit("fts:"), "level").alias("channel"), "rank", "doc_id")
    near = _near(spark, d, 20 * fusion.OVER_FETCH)
    known = docs.select("doc_id", F.col("facet").alias("scene_text"), "video_id", "start_time", "end_time", "level")
    for level in ("shot", "frame"):
        kept = fusion.over_fetched(near.where(F.col("level") == level).drop("level"), known, 20, levels=["frame", "shot"], low=60.0, high=400.0, scenes=["en"])
        text = text.unionByName(kept.withColumn("channel", F.lit(f"ann:{level}")))
    out = fusion.hybrid(text, docs.drop("text"), K, 20, WEIGHTS)
    return out.select("query_id", "doc_id", "shot_id", "level", "score", F.col("new_rank").alias("rank"))


@query(bodied(NEAR_SQL, """SELECT query_id, doc_id, shot_id, start_time, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, score
FROM nv JOIN search_documents USING (doc_id, level) WHERE level = 'frame' AND rank <= 10""", "search_queries", "search_documents"))
def caption_vector_search(spark, d):
    """Vectors of captions (the texts of frames), with the frames' columns."""
    near = _near(spark, d, K).where("level = 'frame'").select("query_id", "rank", "doc_id", "score")
    return fusion.hydrate(near, X.search_documents(spark, d).select("doc_id", "shot_id", "start_time")).select("query_id", "doc_id", "shot_id", "start_time", "rank", "score")


@query(bodied(bm25_sql("documents", "search_queries", 50), """, hit AS (SELECT query_id // 2 AS session_id, query_id, rank, shot_id FROM ranked JOIN search_documents USING (doc_id))
SELECT session_id, shot_id AS key, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, count(DISTINCT query_id) AS groups, count(*) AS contributions, CAST(min(rank) AS INTEGER) AS best_rank
FROM hit GROUP BY ALL HAVING count(DISTINCT query_id) >= 2""", "search_queries", "search_documents"))
def multi_query_fusion(spark, d):
    docs = X.search_documents(spark, d)
    ranked = lexical.bm25(docs.select("doc_id", "text"), X.queries(spark, d), 50)
    hits = ranked.join(docs.select("doc_id", "shot_id", "video_id"), "doc_id").withColumn("session_id", F.floor(F.col("query_id") / 2))
    return fusion.fuse_groups(hits)


@query(bodied(bm25_sql("documents", "search_queries", 50), """, hit AS (SELECT query_id // 2 AS session_id, query_id, rank, shot_id FROM ranked JOIN search_documents USING (doc_id)),
n AS (SELECT session_id, shot_id, count(DISTINCT query_id) AS n FROM hit GROUP BY ALL)
SELECT session_id, query_id, shot_id AS key, CAST(rank AS INTEGER) AS rank, round(1 / (60.0::DOUBLE + rank), 9) AS adds FROM hit JOIN n USING (session_id, shot_id) WHERE n >= 2""", "search_queries", "search_documents"))
def fusion_contributions(spark, d):
    """What each hit of a session's queries adds to its shot."""
    docs = X.search_documents(spark, d)
    ranked = lexical.bm25(docs.select("doc_id", "text"), X.queries(spark, d), 50)
    hits = ranked.join(docs.select("doc_id", "shot_id", "video_id"), "doc_id").withColumn("session_id", F.floor(F.col("query_id") / 2))
    return fusion.contributions(hits).select("session_id", "query_id", "key", "rank", "adds")


@query(bodied(bm25_sql("documents", "search_queries", 50), """, p AS (SELECT query_id, doc_id, rank FROM ranked JOIN documents USING (doc_id) WHERE source = 'src1' AND contains(lower(lang || ' ' || source), 'src') AND contains(lower(lang), 'e'))
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS new_rank FROM p QUALIFY new_rank <= 10""", "search_queries"))
def content_filtered_search(spark, d):
    """Over-fetched answers of one video, by words of its objects and its scene."""
    docs = X.table(spark, d, "documents").select("doc_id", F.col("source").alias("video_id"), F.concat_ws(" ", "lang", "source").alias("objects_text"), F.col("lang").alias("scene_text"), *[F.lit(None).cast("double").alias(c) for c in ("start_time", "end_time")])
    ranked = lexical.bm25(X.table(spark, d, "documents").select("doc_id", "text"), X.queries(spark, d), 50)
    return fusion.post_filter(ranked, docs, 10, video_id="src1", objects=["SRC"], scenes=["E"]).select("query_id", "doc_id", "new_rank")


@query(bodied(bm25_sql("documents", "search_queries", 50), """, h AS (SELECT r.*, shot_id, row_number() OVER (PARTITION BY query_id, shot_id ORDER BY rank) AS x FROM ranked r JOIN search_documents USING (doc_id))
SELECT query_id, doc_id, shot_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS new_rank FROM h WHERE x = 1 QUALIFY new_rank <= 10""", "search_queries", "search_documents"))
def collapse_by_shot(spark, d):
    docs = X.search_documents(spark, d)
    ranked = lexical.bm25(docs.select("doc_id", "text"), X.queries(spark, d), 50)
    return fusion.collapse(fusion.hydrate(ranked, docs.select("doc_id", "shot_id")), K).select("query_id", "doc_id", "shot_id", "new_rank")


def _vector_hits(spark, d, k):
    v = X.vectors(spark, d)
    return vectors.exact_top_k(X.query_vectors(spark, d), v, k).join(v.select("vec_id", "keyframe_id", "video_id", "shot_id", "pts_time"), "vec_id")


_TOP50 = f"""s AS (SELECT query_id, vec_id, {DOT_SQL} AS score FROM query_vectors q, vectors v),
t AS (SELECT query_id, keyframe_id, video_id, shot_id, pts_time, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.vec_id) AS i FROM s JOIN vectors USING (vec_id) QUALIFY i <= 50)"""


@query(with_views("vectors", "query_vectors", body="," + _TOP50 + """,
a AS (SELECT query_id, i, true AS taken, [shot_id] AS shots, [{'v': video_id, 't': pts_time}] AS seen, 1 AS n FROM t WHERE i = 1
 UNION ALL SELECT t.query_id, t.i, x, CASE WHEN x THEN list_append(a.shots, t.shot_id) ELSE a.shots END, CASE WHEN x THEN list_append(a.seen, {'v': t.video_id, 't': t.pts_time}) ELSE a.seen END, a.n + CAST(x AS INTEGER)
 FROM a JOIN t ON t.query_id = a.query_id AND t.i = a.i + 1, LATERAL (SELECT a.n < 10 AND NOT list_contains(a.shots, t.shot_id) AND len(list_filter(a.seen, lambda p: p.v = t.video_id AND abs(p.t - t.pts_time) < 3)) = 0 AS x)),
b AS (SELECT query_id, CAST(0 AS BIGINT) AS i, false AS taken, max_by(shots, i) AS shots, max_by(n, i) AS n FROM a GROUP BY query_id
 UNION ALL SELECT t.query_id, t.i, x, CASE WHEN x THEN list_append(b.shots, t.shot_id) ELSE b.shots END, b.n + CAST(x AS INTEGER) FROM b JOIN t ON t.query_id = b.query_id AND t.i = b.i + 1, LATERAL (SELECT b.n < 10 AND NOT list_contains(b.shots, t.shot_id) AS x)),
u AS (SELECT query_id, i, n FROM a WHERE taken UNION ALL SELECT query_id, i, n FROM b WHERE taken)
SELECT query_id, CAST(i AS INTEGER) AS rank, keyframe_id, video_id, shot_id, pts_time, score, CAST(n AS INTEGER) AS new_rank FROM u JOIN t USING (query_id, i)""").replace("WITH ", "WITH RECURSIVE ", 1))
def diversify(spark, d):
    """Answers apart in shot and time."""
    hits = _vector_hits(spark, d, 50).select("query_id", "rank", "keyframe_id", "video_id", "shot_id", "pts_time", "score")
    return fusion.diversify(hits, K)


RANK50 = f"""s AS (SELECT query_id, vec_id, {DOT_SQL} AS score FROM query_vectors q, vectors v),
top AS (SELECT s.*, keyframe_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s JOIN vectors USING (vec_id) QUALIFY rank <= 50)"""


@query(with_views("vectors", "query_vectors", body="," + RANK50 + """, reg AS (SELECT query_id, keyframe_id, unnest([1, 2]) AS clause, unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS weight, unnest([(vec_id % 7) / 7.0::DOUBLE, (vec_id % 5) / 5.0::DOUBLE]) AS region_score FROM top),
r AS (SELECT query_id, keyframe_id, sum(weight * region_score) / greatest(sum(weight), 1e-9) AS region FROM reg GROUP BY ALL),
g AS (SELECT *, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-6) AS g FROM top WINDOW w AS (PARTITION BY query_id))
SELECT query_id, keyframe_id, round(0.4::DOUBLE * g + 0.6::DOUBLE * region, 6) AS final_score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.4::DOUBLE * g + 0.6::DOUBLE * region, 6) DESC, keyframe_id) AS INTEGER) AS new_rank FROM g JOIN r USING (query_id, keyframe_id)"""))
def localized_rerank(spark, d):
    hits = _vector_hits(spark, d, 50)
    clause = F.explode(F.array(F.struct(F.lit(1).alias("clause"), F.lit(1.0).alias("weight"), (F.col("vec_id") % 7 / 7.0).alias("region_score")),
                               F.struct(F.lit(2).alias("clause"), F.lit(2.0).alias("weight"), (F.col("vec_id") % 5 / 5.0).alias("region_score"))))
    regions = hits.select("query_id", "keyframe_id", clause.alias("c")).select("query_id", "keyframe_id", "c.*")
    return fusion.localized_rerank(hits, regions).select("query_id", "keyframe_id", "final_score", "new_rank")


@query(with_views("vectors", "query_vectors", body="," + RANK50 + """, b AS (SELECT *, min(rank) OVER (PARTITION BY query_id, video_id) AS best_rank FROM top)
SELECT query_id, video_id, vec_id, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY best_rank, video_id) AS INTEGER) AS group_no,
 CAST(row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS INTEGER) AS item_no FROM b"""))
def results_by_video(spark, d):
    return fusion.results_by_video(_vector_hits(spark, d, 50)).select("query_id", "video_id", "vec_id", "group_no", "item_no")


@query("WITH " + MEDIA_SQL + """ SELECT video_id, title, match FROM (SELECT *, CASE WHEN lower(video_id) = '12' THEN 0 WHEN starts_with(lower(video_id), '12') THEN 1 WHEN starts_with(lower(title), '12') THEN 2
 WHEN contains(lower(title), '12') OR contains(lower(video_id), '12') THEN 3 END AS match FROM media) WHERE match IS NOT NULL ORDER BY match, video_id LIMIT 20""")
def video_lookup(spark, d):
    return lexical.video_lookup(media_info(spark, d), "12", 20).select("video_id", "title", "match")


@query("WITH " + MEDIA_SQL + " SELECT video_id, title FROM media WHERE starts_with(lower(video_id), '1') OR starts_with(lower(video_id), '20')")
def scope_filter(spark, d):
    return lexical.filter_scope(media_info(spark, d), "1_a", "20").select("video_id", "title")


def _levels(spark, d):
    docs = X.search_documents(spark, d)
    ranked = lexical.bm25(docs.select("doc_id", "text"), X.queries(spark, d), 20)
    full = ranked.join(docs.select("doc_id", "shot_id", "video_id"), "doc_id")
    return full.select("query_id", "rank", F.explode(F.map_from_arrays(F.array(F.lit("doc_id"), F.lit("shot_id"), F.lit("video_id")), F.array(F.col("doc_id").cast("string"), "shot_id", "video_id"))).alias("level", "id"))


def _metrics_sql() -> str:
    cuts = ", ".join(f"""round(count(*) FILTER (place <= {k}) / count(*), 6) AS recall_{k},
 round(sum(CASE WHEN place <= {k} THEN (pow(2.0, grade) - 1) / log2(place + 1) ELSE 0 END) / sum(CASE WHEN ideal <= {k} THEN (pow(2.0, grade) - 1) / log2(ideal + 1) ELSE 0 END), 6) AS ndcg_{k}""" for k in (1, 5, 10))
    return bm25_sql("documents", "search_queries", 20) + f""",
lv AS (SELECT query_id, rank, unnest(['doc_id', 'shot_id', 'video_id']) AS level, unnest([CAST(doc_id AS VARCHAR), shot_id, video_id]) AS id FROM ranked JOIN search_documents USING (doc_id)),
once AS (SELECT query_id, level, id, min(rank) AS rank FROM lv GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY rank, id) AS place FROM once),
j AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.level ORDER BY grade DESC, r.id) AS ideal, place FROM qrels r LEFT JOIN pl ON pl.query_id = r.query_id AND pl.level = r.level AND pl.id = r.id),
met AS (SELECT query_id, level, round(coalesce(max(1.0::DOUBLE / place), 0), 6) AS mrr, {cuts} FROM j GROUP BY ALL)"""


@query(bodied(_metrics_sql(), "SELECT * FROM met", "search_queries", "search_documents", "qrels"))
def ranking_metrics(spark, d):
    return evaluate.ranking_metrics(_levels(spark, d), X.qrels(spark, d))


@query(bodied(_metrics_sql(), """, b AS (SELECT met.*, unnest([NULL, query_type]) AS query_type FROM met JOIN search_queries USING (query_id))
SELECT query_type, level, count(*) AS labeled, round(avg(mrr), 6) AS mrr, """ + ", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}, round(avg(ndcg_{k}), 6) AS ndcg_{k}" for k in (1, 5, 10)) + " FROM b GROUP BY ALL",
              "search_queries", "search_documents", "qrels"))
def quality_by_type_and_level(spark, d):
    return evaluate.macro_quality(ranking_metrics(spark, d), X.queries(spark, d))


@query("""SELECT "group", count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99
FROM (SELECT unnest(['all', event_type]) AS "group", value AS v FROM events) GROUP BY 1""")
def latency_summary(spark, d):
    return evaluate.latency_summary(X.table(spark, d, "events"), "event_type", "value")


@query(with_views("keyframes", body=""", a AS (SELECT video_id AS question_id, n AS rank, 0 AS moment, CASE WHEN n % 4 = 0 THEN 'other' ELSE video_id END AS video_id, frame_idx FROM keyframes WHERE n <= 100),
t AS (SELECT video_id AS question_id, min(frame_idx) + 2000 AS s, min(frame_idx) + 9000 AS e, video_id AS tv FROM keyframes GROUP BY video_id),
r AS (SELECT a.question_id, rank, CASE WHEN a.video_id = tv AND frame_idx BETWEEN s AND e THEN 1.0::DOUBLE ELSE 0 END AS r FROM a JOIN t USING (question_id))
SELECT question_id, round((""" + " + ".join(f"coalesce(max(r) FILTER (rank <= {k}), 0)" for k in (1, 5, 20, 50, 100)) + ") / 5, 6) AS final_score FROM r GROUP BY question_id"))
def task_score(spark, d):
    k = X.keyframes(spark, d)
    answers = k.where("n <= 100").select(F.col("video_id").alias("question_id"), F.col("n").alias("rank"), F.lit(0).alias("moment"),
                                         F.when(F.col("n") % 4 == 0, "other").otherwise(F.col("video_id")).alias("video_id"), "frame_idx", F.lit(None).cast("string").alias("answer"))
    truth = k.groupBy("video_id").agg((F.min("frame_idx") + 2000).alias("start"), (F.min("frame_idx") + 9000).alias("end")).select(
        F.col("video_id").alias("question_id"), F.lit(0).alias("moment"), "video_id", "start", "end", F.lit(None).cast("string").alias("answer"))
    return evaluate.final_scores(evaluate.r_scores(answers, truth))


@query(with_views("vectors", "query_vectors", body=f""", w AS (SELECT query_id, CASE WHEN query_id % 60 = 0 THEN list_reverse(vector) ELSE vector END AS vector FROM query_vectors), s AS (SELECT query_id, vec_id, {DOT_SQL} AS score FROM w q, vectors v),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank = 1) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM b WHERE query_id <> vec_id"""))
def self_retrieval(spark, d):
    """Vectors that do not find themselves; of every third query the vector was stored backwards."""
    asked_ = X.query_vectors(spark, d).withColumn("vector", F.when(F.col("query_id") % 60 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    return vectors.self_retrieval(X.vectors(spark, d), asked_)


@query(with_views("vectors", body=""", src AS (SELECT vec_id, video_id, pts_time, vector, unnest([0, 1]) AS source_no FROM vectors),
al AS (SELECT *, source_no = 0 OR vec_id % 3 = 0 AS aligned FROM src), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY source_no DESC) AS r FROM al WHERE aligned)
SELECT vec_id, video_id, CAST(source_no AS INTEGER) AS source_no, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pts_time, vec_id) - 1 AS INTEGER) AS embedding_row,
 round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) / greatest(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 1e-12), 6) AS norm FROM k WHERE r = 1"""))
def consolidate_vectors(spark, d):
    from ..functions.geometry import dot
    rows = X.vectors(spark, d).withColumn("source_no", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "row_no": F.col("vec_id"), "aligned": (F.col("source_no") == 0) | (F.col("vec_id") % 3 == 0)})
    kept, _ = vectors.consolidate(rows, "vec_id")
    return kept.select("vec_id", "video_id", "source_no", "embedding_row", F.round(F.sqrt(dot(F.col("vector"), F.col("vector"))), 6).alias("norm"))


@query(with_views("vectors", body=""", long AS (SELECT shot_id, unnest(vector) AS x, unnest(range(0, len(vector))) AS pos FROM vectors), m AS (SELECT shot_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM long GROUP BY ALL),
g AS (SELECT shot_id, list(x ORDER BY pos) AS v FROM m GROUP BY shot_id), s AS (SELECT shot_id, min(pts_time) AS start_time, max(pts_time) AS end_time, count(*) AS keyframe_count FROM vectors GROUP BY shot_id)
SELECT shot_id, start_time, end_time, keyframe_count, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS first, round(v[64] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS last FROM g JOIN s USING (shot_id)"""))
def shot_embeddings(spark, d):
    g = vectors.group_vectors(X.vectors(spark, d), ["shot_id"])
    return g.select("shot_id", "start_time", "end_time", "keyframe_count", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))
