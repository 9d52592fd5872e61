"""The queries of this subpackage and their SQL; ``__spark_entry__`` registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kd_search, max_sketch, merkle, mixing, near_dedup, quality, sharding, token_files, toxicity, url_rules, vector_dedup, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of query 1, as (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_PARTS = r"^.*?://([^/?#]*)([^?#]*)"
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2, 's'), '') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS rn
  FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, p.host, p.path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path AND rn = 1
"""


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_merkle_audit(spark, sf_dir):
    """Pages as WARC segments against a replica with known faults: status of every record, ours and extra ones."""
    path = merkle.write_warc(table(spark, sf_dir, "pages"))
    ours = merkle.materialize(merkle.records(merkle.read_chunks(spark, path)))
    theirs = merkle.materialize(merkle.damaged(merkle.read_chunks(spark, path)))
    found = merkle.materialize(merkle.audit(ours, theirs))
    own = ours.join(found.where("status <> 'extra'").select("segment", "offset", "status"), ["segment", "offset"], "left")
    extra = theirs.join(found.where("status = 'extra'").select("segment", "offset", "status"), ["segment", "offset"])
    columns = ["page_id", "length", "digest", F.coalesce("status", F.lit("same")).alias("status")]
    return own.select(*columns).unionByName(extra.select(*columns))


def _record_sql(page_id: str, url: str, html: str) -> str:
    return f"""concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', {page_id}, '>', chr(13), chr(10),
    'WARC-Target-URI: ', {url}, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', strlen({html}), chr(13), chr(10), chr(13), chr(10), {html}, chr(13), chr(10), chr(13), chr(10))"""


OP9_SQL = f"""
WITH r AS (
  SELECT page_id, {_record_sql("coalesce(CAST(page_id AS VARCHAR), '')", "replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A')", "coalesce(html, '')")} AS rec
  FROM pages),
d AS (SELECT page_id, rec, sha256(rec) AS digest FROM r),
x AS (SELECT {_record_sql("''", "''", "digest")} AS rec FROM d WHERE substr(digest, 1, 2) = '03')
SELECT page_id, strlen(rec) AS length, digest,
  CASE substr(digest, 1, 2) WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' WHEN '02' THEN 'missing' ELSE 'same' END AS status
FROM d
UNION ALL
SELECT NULL, strlen(rec), sha256(rec), 'extra' FROM x
"""


def op10_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_vectors(spark, sf_dir):
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op5_kd_search(spark, sf_dir):
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op7_byte_bpe(spark, sf_dir):
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


#: The id that ends a document in query 8.
END_ID = 2


def op8_token_files(spark, sf_dir):
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    read, starts = token_files.read_token_files(spark, path)
    read = token_files.with_starts(read.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), starts)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32)


def op12_lexical_search(spark, sf_dir):
    index = max_sketch.read_index(spark, max_sketch.write_index(table(spark, sf_dir, "documents")))
    return max_sketch.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), 50)


_TERMS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS_SQL.format("text")} AS t, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM t),
s AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS l FROM t WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL.format("text")}) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, nn),
c AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 50
"""


def op13_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_rules": op1_url_rules,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_near_vectors": op4_near_vectors,
    "op5_kd_search": op5_kd_search,
    "op6_sharding": op6_sharding,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_files": op8_token_files,
    "op9_merkle_audit": op9_merkle_audit,
    "op10_near_dedup": op10_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
}

#: Components of links l (a, b): the smallest id that each end reaches.
REACHED = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)"""

OP4_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
  WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.9),
{REACHED}, n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{REACHED}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

ORACLES = {
    "op1_url_rules": OP1_SQL,
    "op4_near_vectors": OP4_SQL,
    "op5_kd_search": OP5_SQL,
    "op9_merkle_audit": OP9_SQL,
    "op10_near_dedup": OP10_SQL,
    "op12_lexical_search": OP12_SQL,
}
