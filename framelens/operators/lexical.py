"""Postings, BM25 and filtered lexical search over batches of queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, query_terms, tokenize

K1, B = 1.2, 0.75
#: Terms of queries that are broadcast (about 100 bytes each), and parts of a token beyond that.
BROADCAST_TERMS = 200_000
SALTS = 32
#: Pairs of document and query in a task, about: as many at most, and so many at least before a further task is opened.
PAIRS, LEAST_PAIRS = 1_000_000, 50_000
#: Parts up to which Spark writes an exchange straight to files (its default); for more, a task first gathers all that it deals in memory.
STRAIGHT = 200
#: Documents and queries of a tile, which a task holds, where both grow: as many at most, and so many documents at least before a further tile is opened.
TILE_DOCS, LEAST_TILE_DOCS, TILE_QUERIES = 8_192, 512, 262_144
#: Parts of a word that is sought in many short texts.
SHORT_SALTS = 8


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = False) -> DataFrame:
    """(token, doc_id, tf, length): term frequencies and the document's number of tokens."""
    text = ascii_fold(F.col(text_col)) if fold else F.col(text_col)
    words = docs.select(F.col(id_col).alias("doc_id"), tokenize(text).alias("words")).withColumn("length", F.size("words"))
    return words.select("doc_id", "length", F.explode("words").alias("token")).groupBy("token", "doc_id", "length").agg(F.count("*").alias("tf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def dealt_parts(docs: DataFrame, queries: DataFrame) -> int:
    """Parts in which ``docs`` are dealt, so that a task meets about PAIRS pairs of document and query however many there are."""
    pairs = docs.count() * queries.count()
    return max(1, math.ceil(pairs / PAIRS), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / LEAST_PAIRS)))


def tile_blocks(docs: DataFrame) -> int:
    """Blocks of about TILE_DOCS documents at most, two for each core where there are enough documents."""
    n = docs.count()
    return max(1, math.ceil(n / TILE_DOCS), min(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST_TILE_DOCS)))


def term_counts(words: DataFrame, keys: list[str], counts: list[Column], parts: int) -> tuple[DataFrame, DataFrame]:
    """``counts`` of ``words`` (``keys`` with a doc_id, token) by keys and token, twice the same rows: to be summed up, and dealt by doc_id in
    ``parts`` to be scored. Beyond STRAIGHT of them words go to STRAIGHT parts and only the counts that are scored go on to all, so
    that no task gathers the words of a whole split to deal them."""
    hits = words.repartition(min(parts, STRAIGHT), "doc_id").groupBy(*keys, "token").agg(*counts)
    return hits, hits if parts <= STRAIGHT else hits.repartition(parts, "doc_id")


def bm25(docs: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, require_all: bool = False, fold: bool = True, k1: float = K1, b: float = B, within: str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) for ``queries`` (query_id, text) over ``docs`` (doc_id, text).

    A document matches with any query term, or with all under ``require_all``. Statistics are those of the whole index;
    ``allowed`` (doc_id) restricts answers only. Ties by doc_id. With ``within``, a column of ``docs``, the k best of each
    of its values are ranked apart, and it is returned too.

    Texts are tokenised once: tokens that some query has, and an empty one for each document, are dealt by doc_id; document
    frequencies, lengths and scores all come from that one exchange (``term_counts``), and a document's scores need no other. Its parts are as many
    as pairs of document and query ask for (``dealt_parts``): a task sums and sorts these pairs. Terms of the queries with their weights are broadcast up to BROADCAST_TERMS of them; beyond that they meet the hits in a shuffle
    join in which every token is dealt in SALTS parts, so a common word is no hot key.
    """
    if k < 1:
        raise ValueError("k must be positive")
    text = ascii_fold(F.col("text")) if fold else F.col("text")
    terms = queries.select("query_id", F.explode(query_terms(text)).alias("token")).distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = terms.select("token").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    keys = ["doc_id", "length", *([within] if within else [])]
    words = docs.select("doc_id", *([within] if within else []), F.coalesce(tokenize(text), F.array().cast("array<string>")).alias("words"))
    words = words.select(*[c for c in keys if c != "length"], F.size("words").alias("length"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("token"))
    parts = dealt_parts(docs, queries)
    hits, scored = term_counts(words.join(F.broadcast(wanted) if few else wanted, "token", "left_semi"), keys, [F.count("*").alias("tf")], parts)
    own = F.col("token") == ""  # no filters here, so that all three plans share the exchange
    stats = hits.agg(F.count_if(own).alias("n_docs"), F.avg(F.when(own, F.col("length"))).alias("avg_length"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weights = terms.join(df, "token").crossJoin(F.broadcast(stats))  # one row of statistics
    weights = weights.select("query_id", "token", "avg_length", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    if allowed is not None:
        scored = scored.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    if few:
        scored = scored.join(F.broadcast(weights), "token")
    else:
        salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]).repartition(parts, "doc_id")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = scored.withColumn("part", part)
    groups = ["query_id", *[c for c in keys if c != "length"]]
    total = scored.groupBy(*groups).agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("matched"))
    if require_all:
        size = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        total = total.join(F.broadcast(size) if few else size, "query_id").where("matched = n_terms")
    return top_k(total.select(*groups, "score"), k, within=within)


def _few(rows: DataFrame, most: int = BROADCAST_TERMS) -> bool:
    """Whether a table is small enough to be broadcast."""
    return rows.limit(most + 1).count() <= most


def field_bm25(docs: DataFrame, queries: DataFrame, k: int, fields: dict[str, float], require_all: bool = False, fold: bool = True, then: str | None = None, k1: float = K1, b: float = B, many: bool = False) -> DataFrame:
    """``bm25`` over several text columns of ``docs`` (doc_id, ...): a document's score is the sum over ``fields`` (column to
    weight) of weight times the column's own BM25, with document frequencies and mean lengths of the column. A term is matched,
    also for ``require_all``, whichever column has it. Equal scores rank by ``then``, a column of ``docs`` (nulls last), and
    doc_id. Null columns are empty. A token's counts in all fields are one row of its document, so that one exchange by doc_id
    serves all fields and a document's matched terms are a plain count.

    With ``many``, for queries that grow with the documents, pairs of query and document are never rows: what a token adds to a
    document's score is the same for all queries, so it is counted once, and queries meet it in tiles (``tiled_top_k``)."""
    if k < 1:
        raise ValueError("k must be positive")
    if many and (require_all or then or min(fields.values()) <= 0):
        raise ValueError("many queries are ranked by any term, by score and doc_id, with weights above 0")
    plain = ascii_fold if fold else (lambda c: c)
    terms = queries.select("query_id", F.explode(query_terms(plain(F.col("text")))).alias("token")).distinct()
    few = _few(terms.select("token").distinct() if many else terms)
    wanted = terms.select("token").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    keys = ["doc_id", *([then] if then else [])]
    of = range(len(fields))
    lengths = [f"length{i}" for i in of]
    words = docs.select(*keys, *[F.coalesce(tokenize(plain(F.col(f))), F.array().cast("array<string>")).alias(f"words{i}") for i, f in enumerate(fields)])
    words = words.select(*keys, *[F.size(f"words{i}").alias(f"length{i}") for i in of], F.posexplode(F.array(F.array(F.lit("")), *[F.col(f"words{i}") for i in of])).alias("field", "words"))
    words = words.select(*keys, *lengths, "field", F.explode("words").alias("token"))  # field 0: an empty token for each document
    parts = tile_blocks(docs) if many else dealt_parts(docs, queries)
    counts = [F.count_if(F.col("field") == i + 1).alias(f"tf{i}") for i in of]
    if few or not many:  # else all words are counted before any is dealt by itself
        words = words.join(F.broadcast(wanted) if few else wanted, "token", "left_semi")
    hits, dealt = term_counts(words, [*keys, *lengths], counts, parts)
    own = (F.col("token") == "") & (F.col("tf0") == 0)  # names a count, so that all three plans share the exchange
    stats = hits.agg(F.count_if(own).alias("n_docs"), *[F.avg(F.when(own, F.col(f"length{i}"))).alias(f"mean{i}") for i in of])
    df = hits.groupBy("token").agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in of])
    weights = (terms.select("token").distinct() if many else terms).join(df, "token").crossJoin(F.broadcast(stats))  # one row of statistics
    weights = weights.select(*([] if many else ["query_id"]), "token", *[f"mean{i}" for i in of], *[(F.lit(float(w)) * idf(F.col("n_docs"), F.col(f"df{i}"))).alias(f"idf{i}") for i, w in enumerate(fields.values())])
    if few:
        scored = dealt.join(F.broadcast(weights), "token")
    else:
        salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
        scored = scored if many else scored.repartition(parts, "doc_id")
    part = F.lit(0.0)
    for i in of:
        tf = F.col(f"tf{i}")
        part = part + F.when(tf > 0, F.col(f"idf{i}") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"length{i}") / F.col(f"mean{i}")))).otherwise(0.0)
    if many:
        return tiled_top_k(scored.groupBy("doc_id", "token").agg(F.sum(part).alias("part")), terms, k, parts)  # a repeated doc_id is one document
    total = scored.groupBy("query_id", *keys).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
    if require_all:
        size = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        total = total.join(F.broadcast(size) if few else size, "query_id").where("matched = n_terms")
    return top_k(total.select("query_id", *keys, "score"), k, then=then)


def tiled_top_k(parts: DataFrame, terms: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query of ``terms`` (query_id, token) the k documents with the highest sums of their
    ``parts`` (doc_id, token, part above 0; one row for each token of a document) over its tokens, rounded to six places, ties by doc_id.

    Documents in ``blocks`` meet queries in sets of about TILE_QUERIES; each pair is a tile in one task, which adds up a query's
    parts over the tile's documents and gives k rows at most for each query. No document is left out that could be among the k: as k documents
    reach the kth highest part of a token among all documents, a query has no answer below the greatest of these, nor in a tile whose
    highest parts for its tokens add up to less. A task holds one tile however many documents and queries there are; the work
    grows as their product, a few nanoseconds for a pair."""
    kinds = {f.name: f.dataType.simpleString() for f in (*parts.schema, *terms.schema)}
    kth = parts.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("part")))).where(F.col("r") == k).select("token", F.col("part").alias("kth"))
    asked = terms.join(kth, "token", "left").groupBy("query_id").agg(F.collect_list("token").alias("tokens"), F.coalesce(F.max("kth"), F.lit(0.0)).alias("floor"))
    sets = max(1, math.ceil(terms.select("query_id").distinct().count() / TILE_QUERIES))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("set", some("query_id", sets)).withColumn("block", every(blocks)).repartition(4 * sets * blocks, "set", "block")  # few tiles meet in a task
    right = parts.withColumn("block", some("doc_id", blocks)).withColumn("set", every(sets)).repartition(4 * sets * blocks, "set", "block")

    def best(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "doc_id": known["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        place = lambda values, among: pc.index_in(values, among).fill_null(-1).to_numpy()
        ids, words = pc.unique(known["doc_id"]), pc.unique(known["token"])
        ids = ids.take(pc.sort_indices(ids, null_placement="at_start"))  # so that ties go to the smaller id
        word = place(known["token"], words)
        order = np.argsort(word, kind="stable")
        start = np.searchsorted(word[order], np.arange(len(words) + 1))
        doc, part = place(known["doc_id"], ids)[order], known["part"].to_numpy()[order]
        wide = {w: np.bincount(doc[start[w]:start[w + 1]], part[start[w]:start[w + 1]], len(ids)) for w in np.flatnonzero(8 * np.diff(start) > len(ids)).tolist()}
        lists = asked["tokens"].combine_chunks()
        said, at = place(lists.flatten(), words), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        size, high = np.diff(start).tolist(), np.maximum.reduceat(part, start[:-1])
        highest = np.add.reduceat(np.where(said >= 0, high[said], 0.0), at[:-1])
        floor = np.maximum(asked["floor"].to_numpy() - 1e-6, np.nextafter(0.0, 1.0))  # less is only of use if it is rounded to as much
        alive = np.flatnonzero(highest >= floor).tolist()
        high, highest, floor, said, at, start = (x.tolist() for x in (high, highest, floor, said, at, start))
        total, found, scores, sizes = np.empty(len(ids)), [], [], np.zeros(asked.num_rows, np.int64)
        for i in alive:
            own = [w for w in said[at[i]:at[i + 1]] if w >= 0]
            total[:] = 0.0
            for w in own:
                if w not in wide:
                    total[doc[start[w]:start[w + 1]]] += part[start[w]:start[w + 1]]
            needed = [w for w in own if highest[i] - high[w] < floor[i]]  # without one of these a document is below the floor
            if needed:
                rarest = min(needed, key=size.__getitem__)
                near = doc[start[rarest]:start[rarest + 1]]
                score = total[near]
                for w in own:
                    if w in wide:
                        score += wide[w][near]
                reach = np.flatnonzero(score >= floor[i])
                near, score = near[reach], score[reach]
            else:
                for w in own:
                    if w in wide:
                        total += wide[w]
                near = np.flatnonzero(total >= floor[i])
                score = total[near]
            if len(near) > 16 * k:
                top = np.lexsort((near, -np.round(score, 6)))[:k]
                near, score = near[top], score[top]
            found.append(near)
            scores.append(score)
            sizes[i] = len(near)
        flat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        query, near, score = np.repeat(np.arange(asked.num_rows), sizes), flat(found, np.int64), np.round(flat(scores, np.float64), 6)
        order = np.lexsort((near, -score, query))
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]  # queries stand in order before and after
        return pa.table({"query_id": asked["query_id"].take(query[order]), "doc_id": ids.take(near[order]), "score": score[order]})

    rows = left.groupBy("set", "block").cogroup(right.groupBy("set", "block")).applyInArrow(best, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    return top_k(rows, k)


def substring_hits(docs: DataFrame, queries: DataFrame, columns: list[str], keep: list[str] = (), many: bool = False) -> DataFrame:
    """(query_id, doc_id) where a column of ``docs`` (doc_id, ...) holds the query's whole text, ignoring case; also the columns
    ``keep`` of ``docs``.

    A word that stands between two others in the query stands whole in any text that holds the query, so documents are
    found by the query's longest inner word and then checked. Of queries without one the longest word stands inside a word of
    the text: these words are found by an index of the vocabulary's pieces of up to three letters, through the query's
    rarest piece. Queries without words match nothing. Sought words are broadcast up to BROADCAST_TERMS of them, and texts are
    checked where they stand; beyond that a word is dealt in SALTS parts, so a frequent one is no hot key, and ids of
    documents and queries alone meet before the texts do.

    With ``many``, for queries that grow with the documents and short texts such as titles, the longest of all words of a query is sought, since
    the inner one of three is mostly a common one. Its first word ends a word of the text and its last begins one. Texts are dealt
    with their words and checked where these meet, so pairs that hold the word alone are never dealt."""
    word = r"[\p{L}\p{N}_]+"
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("said")).where("said <> ''")
    found = F.regexp_extract_all("said", F.lit(f"({word})"), F.lit(1))
    inner = F.slice(found, F.lit(2), F.greatest(F.size(found) - 2, F.lit(0)))
    longest = lambda words: F.element_at(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), 1)
    asked = asked.withColumns({"inner": F.size(found) > 2, "key": F.when(F.size(found) > 2, longest(inner)).when(F.size(found) > 0, longest(found))}).where("key IS NOT NULL")
    stands = F.contains("token", F.col("key"))
    if many:
        first, last, own = F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1)), F.when(F.col("inner"), F.length("key")).otherwise(0)
        asked = asked.withColumn("side", F.when(own >= F.greatest(F.length(first), F.length(last)), "inner").when(F.size(found) == 1, "only").when(F.length(last) >= F.length(first), "last").otherwise("first"))
        asked = asked.withColumns({"key": F.when(F.col("side") == "last", last).when(F.col("side") == "first", first).otherwise(F.col("key")), "inner": F.col("side") == "inner"})
        stands = F.when(F.col("side") == "last", F.startswith("token", F.col("key"))).when(F.col("side") == "first", F.endswith("token", F.col("key"))).otherwise(stands)
    held_ = [f"held{i}" for i in range(len(columns))]
    lowered = docs.select("doc_id", *keep, *[F.lower(F.col(c)).alias(h) for c, h in zip(columns, held_)])
    found_words = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", *held_), F.lit(f"({word})"), F.lit(1)))
    rows = lowered.select("*", F.explode(found_words).alias("token"))
    words = rows.select("doc_id", "token")
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    short = asked.where("NOT inner").withColumn("n", F.least(F.lit(3), F.length("key")))
    sizes = [r["n"] for r in short.select("n").distinct().collect()]  # three at most
    sought = asked.where("inner").select("query_id", "said", F.col("key").alias("token"))
    if sizes:
        vocabulary = words.select("token").distinct()
        held = vocabulary.select("token", F.explode(F.array_distinct(F.concat(*[F.when(F.length("token") >= n, pieces("token", n)).otherwise(F.array().cast("array<string>")) for n in sizes]))).alias("piece"))
        more = ["side"] if many else []
        own = short.select("query_id", "said", "key", *more, F.explode(pieces("key", F.col("n"))).alias("piece"))
        held = held.join(own.select("piece").distinct(), "piece", "left_semi")
        count = held.groupBy("piece").agg(F.count("*").alias("tokens"))
        rarest = own.join(count, "piece").groupBy("query_id", "said", "key", *more).agg(F.min_by("piece", F.struct("tokens", "piece")).alias("piece"))
        sought = sought.unionByName(held.join(rarest, "piece").where(stands).select("query_id", "said", "token"))
    holds = F.lit(False)
    for h in held_:
        holds = holds | F.coalesce(F.contains(F.col(h), F.col("said")), F.lit(False))
    out = ["query_id", "doc_id", *keep]
    if many:
        salted = sought.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SHORT_SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SHORT_SALTS)).cast("int")).join(salted, ["token", "salt"]).where(holds).select(*out).distinct()
    if _few(sought):
        return rows.join(F.broadcast(sought), "token").where(holds).select(*out).distinct()
    salted = sought.select("query_id", "token").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = words.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]).select("doc_id", "query_id").repartition("doc_id").distinct()
    near = near.join(asked.select("query_id", "said"), "query_id")
    return near.join(lowered, "doc_id").where(holds).select(*out).distinct()


def text_search(docs: DataFrame, queries: DataFrame, k: int, require_all: bool = False, columns: list[str] | None = None, fields: dict[str, float] | None = None, then: str | None = None, many: bool = False) -> DataFrame:
    """``bm25`` over ``docs`` (doc_id, text), or ``field_bm25`` over ``fields``, and after its answers, with score 0, the documents
    that hold a query's text as a substring of one of ``columns`` (default: text) without matching its terms. Equal scores
    rank by ``then`` and doc_id. ``many`` is for queries that grow with the documents, see ``field_bm25`` and ``substring_hits``; both
    tables are read several times."""
    if many:
        ranked = field_bm25(docs, queries, k, fields or {"text": 1.0}, require_all, then=then, many=True).select("query_id", "doc_id", "score")
        held = substring_hits(docs, queries, columns or ["text"], many=True).withColumn("score", F.lit(0.0))
        return top_k(ranked.unionByName(held).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)
    ranked = field_bm25(docs, queries, k, fields or {"text": 1.0}, require_all, then=then) if fields or then else bm25(docs.select("doc_id", "text"), queries, k, require_all=require_all)
    held = substring_hits(docs, queries, columns or ["text"], [then] if then else [])
    more = held.join(ranked, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    names = ["query_id", "doc_id", *([then] if then else []), "score"]
    return top_k(ranked.select(*names).unionByName(more.select(*names)), k, then=then)


def top_k(scores: DataFrame, k: int, id_col: str = "doc_id", within: str | None = None, then: str | None = None) -> DataFrame:
    """The k best of each query (and value of ``within``) by score, ties by ``then`` (nulls last) and id."""
    more = [c for c in (within, then) if c]
    by = Window.partitionBy("query_id", *([within] if within else [])).orderBy(F.desc("score"), *([F.asc_nulls_last(then)] if then else []), id_col)
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", *more, "rank", id_col, "score")


def ilike_any(columns: list[str], text: Column) -> Column:
    """Whether any column holds the text, ignoring case; wildcards in it are ordinary characters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(text)), F.lit(False))
    return found


def filter_level(docs: DataFrame, levels: list[str]) -> DataFrame:
    unknown = set(levels) - {"frame", "shot", "event"}
    if unknown:
        raise ValueError(f"unsupported levels: {sorted(unknown)}")
    return docs.where(F.col("level").isin(levels))


def filter_time(docs: DataFrame, low: float | None, high: float | None, pts: str | None = None) -> DataFrame:
    """Documents that overlap [low, high]."""
    extra = [F.col(pts)] if pts else []
    if low is not None:
        docs = docs.where(F.coalesce("end_time", "start_time", *extra) >= low)
    if high is not None:
        docs = docs.where(F.coalesce("start_time", *extra, "end_time") <= high)
    return docs


def filter_facets(docs: DataFrame, facets: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents with every wanted facet; ``facets`` (doc_id, facet)."""
    for value in wanted:
        docs = docs.join(facets.where(F.col("facet") == value).select("doc_id").distinct(), "doc_id", "left_semi")
    return docs


def filter_objects(docs: DataFrame, counts: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents with every wanted object; ``counts`` (doc_id, label, count)."""
    for value in wanted:
        docs = docs.join(counts.where((F.col("label") == value) & (F.col("count") > 0)).select("doc_id").distinct(), "doc_id", "left_semi")
    return docs


def filter_scope(docs: DataFrame, batch: str = "", directory: str = "") -> DataFrame:
    """Rows of either scope: a batch prefix (its sub-batch suffix taken off) or a directory prefix of the video id."""
    batch, directory = (None if v in ("", "all") else v.lower() for v in (batch.strip(), directory.strip()))
    if not batch and not directory:
        return docs
    keep = F.lit(False)
    if batch:
        root = F.regexp_replace(F.lit(batch), r"[_-][a-z]$", "")
        keep = keep | F.startswith(F.lower("video_id"), root)
    if directory:
        keep = keep | F.startswith(F.lower("video_id"), F.lit(directory))
    return docs.where(keep)


def object_search(detections: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Keyframes with a class that holds the query's text, by greatest confidence, then time, then id: labels are the
    distinct classes in order.

    A keyframe among a query's k best has its confidence from a class among whose own k best it is. So each class names its k
    best, texts are matched with the distinct classes alone, and queries rank what their classes name. Only for those keyframes
    are labels gathered, from the same exchange of detections by keyframe."""
    frame = ["keyframe_id", "pts_time"]
    order = [F.desc("score"), *frame[::-1]]
    rows = detections.select(*frame, "class_name", "confidence").repartition(*frame)
    best = rows.groupBy(*frame, "class_name").agg(F.max("confidence").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("class_name").orderBy(*order))).where(F.col("place") <= k)
    wanted = best.select("class_name").distinct().join(queries, ilike_any(["class_name"], F.col("text"))).select("class_name", "query_id")
    by = Window.partitionBy("query_id").orderBy(*order)
    named = best.join(wanted, "class_name").groupBy("query_id", *frame).agg(F.max("score").alias("score"))
    kept = named.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    kept = kept.select("query_id", "rank", *[F.col(c).alias(f"kept_{c}") for c in frame])
    here = F.lit(True)
    for c in frame:
        here = here & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    hits = rows.join(F.broadcast(kept) if _few(queries, BROADCAST_TERMS // k) else kept, here).join(wanted, ["class_name", "query_id"])
    return hits.groupBy("query_id", *frame, "rank").agg(
        F.array_join(F.array_sort(F.collect_set("class_name")), ", ").alias("labels"), F.max("confidence").alias("score")).select("query_id", *frame, "labels", "score", "rank")


def video_lookup(media: DataFrame, query: str, k: int) -> DataFrame:
    """Videos by exact id, id prefix, title prefix, then a title or id that holds the query; then id."""
    q, vid, title = query.lower(), F.lower("video_id"), F.lower("title")
    order = F.when(vid == q, 0).when(vid.startswith(q), 1).when(title.startswith(q), 2).when(title.contains(q) | vid.contains(q), 3)
    return media.withColumn("match", order).where("match IS NOT NULL").orderBy("match", "video_id").limit(k)
