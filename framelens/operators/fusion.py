"""Fusing, collapsing, diversifying and reranking rankings (query_id, rank, id, score)."""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid_box
from .lexical import filter_level, filter_time
from .walk import Walk, walk

RRF_K = 60.0
#: Candidates that a channel without filters of its own fetches for each one that it passes on.
OVER_FETCH = 4


def rrf(rankings: DataFrame, k: int, weights: dict[str, float] | None = None, id_col: str = "doc_id", rrf_k: float = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, channel, rank, id): sum of weight / (60 + rank), ties by id, with
    each channel's rank. An id that a channel names twice counts there once, at its better rank."""
    hits = rankings.groupBy("query_id", id_col).agg(F.array_sort(F.collect_list(F.struct("channel", "rank"))).alias("hits"))  # as many as channels
    hits = hits.withColumn("hits", F.filter("hits", lambda h, i: (i == 0) | (F.try_element_at("hits", i)["channel"] != h["channel"])))

    def part(h):
        weight = F.lit(1.0)
        for channel, w in (weights or {}).items():
            weight = F.when(h["channel"] == channel, F.lit(float(w))).otherwise(weight)
        return weight / (rrf_k + h["rank"])

    fused = hits.select("query_id", id_col, F.round(F.aggregate("hits", F.lit(0.0), lambda s, h: s + part(h)), 9).alias("score"), F.map_from_entries("hits").alias("ranks"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def fuse_groups(hits: DataFrame, min_groups: int = 2) -> DataFrame:
    """Fusion of several query boxes by shot (or video without one): every hit adds 1 / (60 + rank); keys that fewer
    than ``min_groups`` boxes found are left out when several boxes were asked."""
    key = F.coalesce(F.nullif("shot_id", F.lit("")), "video_id")
    fused = hits.withColumn("key", key).groupBy("session_id", "key").agg(
        F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.countDistinct("query_id").alias("groups"), F.count("*").alias("contributions"), F.min("rank").alias("best_rank"))
    return fused.where(F.col("groups") >= min_groups)


def contributions(hits: DataFrame, min_groups: int = 2) -> DataFrame:
    """What each hit adds to its key in ``fuse_groups``: a row for each contribution, so that none is lost in a count."""
    kept = fuse_groups(hits, min_groups).select("session_id", "key")
    rows = hits.withColumns({"key": F.coalesce(F.nullif("shot_id", F.lit("")), "video_id"), "adds": F.round(1 / (RRF_K + F.col("rank")), 9)})
    return rows.join(kept, ["session_id", "key"], "left_semi")


def hydrate(ranked: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ranked ids with their documents' columns; repeated ids of a query collapse to the best rank."""
    best = Window.partitionBy("query_id", id_col).orderBy("rank")
    once = ranked.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return once.join(docs, id_col)


def collapse(ranked: DataFrame, k: int, key: str = "shot_id", id_col: str = "doc_id") -> DataFrame:
    """The best hit of each shot (or document without one), ranked anew."""
    first = Window.partitionBy("query_id", F.coalesce(F.col(key), F.col(id_col).cast("string"))).orderBy("rank")
    kept = ranked.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    by = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("new_rank", F.row_number().over(by)).where(F.col("new_rank") <= k)


def results_by_video(ranked: DataFrame) -> DataFrame:
    """Results grouped by video: groups by their best rank, items by rank."""
    best = Window.partitionBy("query_id", "video_id")
    rows = ranked.withColumn("best_rank", F.min("rank").over(best))
    group = Window.partitionBy("query_id").orderBy("best_rank", "video_id")
    item = Window.partitionBy("query_id", "video_id").orderBy("rank")
    return rows.withColumns({"group_no": F.dense_rank().over(group), "item_no": F.row_number().over(item)})


class _Apart(Walk):
    """Answers of one query that are apart in shot and time, and those that a second choice may fill up from."""

    def __init__(self, k: int, per_shot: int, gap: float):
        self.k, self.per_shot, self.gap = k, per_shot, gap
        self.n, self.of_shot, self.seconds = 0, Counter(), {}
        self.spare: list[tuple[str, dict]] = []
        self.spare_of_shot: Counter = Counter()

    def _answer(self, shot: str, row: dict) -> dict:
        self.n += 1
        self.of_shot[shot] += 1
        self.done = self.n == self.k
        return row | {"new_rank": self.n}

    def step(self, row):
        shot = row["shot_id"] or f"keyframe {row['keyframe_id']}"
        if self.of_shot[shot] == self.per_shot:
            return None  # its shot is full for good
        t, times = row["pts_time"], self.seconds.setdefault(row["video_id"], [])
        if t is not None:
            at = bisect.bisect_left(times, t)
            if any(abs(t - other) < self.gap for other in times[max(0, at - 1):at + 1]):
                if self.spare_of_shot[shot] < self.per_shot:
                    self.spare_of_shot[shot] += 1
                    self.spare.append((shot, row))
                return None
            times.insert(at, t)
        return self._answer(shot, row)

    def finish(self):
        for shot, row in self.spare:
            if not self.done and self.of_shot[shot] < self.per_shot:
                yield self._answer(shot, row)


def diversify(ranked: DataFrame, k: int, per_shot: int = 1, gap: float = 3.0) -> DataFrame:
    """Greedy by rank: at most ``per_shot`` of a shot and none within ``gap`` seconds of a chosen one of its video; then
    filled up by rank under the shot limit alone. ``ranked`` (query_id, rank, keyframe_id, video_id, shot_id, pts_time,
    score) is walked once: what the second choice may need, ``per_shot`` candidates of a shot at most, is remembered on the
    way. Rows without a time are near nothing; a row without a shot is a shot of its own."""
    if k < 1 or per_shot < 1:
        raise ValueError("k and per_shot must be positive")
    if gap < 0:
        raise ValueError("gap must not be negative")
    return walk(ranked, ["query_id"], ["rank"], lambda: _Apart(k, per_shot, gap), ranked.schema.simpleString()[7:-1].replace(":", " ") + ", new_rank int")


def localized_rerank(candidates: DataFrame, regions: DataFrame, rerank_k: int = 50) -> DataFrame:
    """0.4 of the global score, brought to 0..1 within the query, and 0.6 of the weighted mean of the region scores.
    ``regions`` (query_id, keyframe_id, clause, weight, region_score) come from an encoder; candidates without regions fall
    away. If regions have boxes (x1, y1, x2, y2), one outside 0 <= low < high <= 1 is an error."""
    top = candidates.where(F.col("rank") <= rerank_k)
    by = Window.partitionBy("query_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    top = top.withColumn("global_score", (F.col("score") - low) / F.greatest(high - low, F.lit(1e-6)))
    if {"x1", "y1", "x2", "y2"} <= set(regions.columns):
        sound = F.coalesce(valid_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.lit(False))
        regions = regions.withColumn("weight", F.when(sound, F.col("weight")).otherwise(F.raise_error(F.lit("invalid normalised box")).cast("double")))
    region = regions.groupBy("query_id", "keyframe_id").agg((F.sum(F.col("weight") * F.col("region_score")) / F.greatest(F.sum("weight"), F.lit(1e-9))).alias("region"))
    scored = top.join(region, ["query_id", "keyframe_id"]).withColumn("final_score", F.round(0.4 * F.col("global_score") + 0.6 * F.col("region"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "keyframe_id")
    return scored.withColumn("new_rank", F.row_number().over(order))


def localized_search(candidates: DataFrame, regions: DataFrame, k: int = 20, rerank_k: int = 50) -> DataFrame:
    """``localized_rerank``, then ``diversify``: the answers of a search by regions."""
    scored = localized_rerank(candidates, regions, rerank_k)
    rows = scored.select("query_id", F.col("new_rank").alias("rank"), "keyframe_id", "video_id", "shot_id", "pts_time", F.col("final_score").alias("score"))
    return diversify(rows, k)


def hybrid(channels: DataFrame, docs: DataFrame, k: int, candidate_k: int, weights: dict[str, float] | None = None, collapse_key: str | None = "shot_id") -> DataFrame:
    """Channels (query_id, channel, rank, doc_id), such as text and vectors of each level, to fused, hydrated and collapsed
    answers, each with its rank in every channel."""
    if not candidate_k >= k >= 1:
        raise ValueError("candidate_k >= k >= 1 is required")
    full = hydrate(rrf(channels, candidate_k, weights), docs)
    return collapse(full, k, collapse_key) if collapse_key else full.withColumn("new_rank", F.col("rank")).where(F.col("rank") <= k)


def post_filter(ranked: DataFrame, docs: DataFrame, k: int, levels: list[str] | None = None, video_id: str | None = None, low: float | None = None, high: float | None = None, objects: list[str] = (), scenes: list[str] = ()) -> DataFrame:
    """Filters after retrieval: ranked candidates (more than k are asked for) that pass, k at most; it can return fewer."""
    rows = hydrate(ranked, docs)
    if levels:
        rows = filter_level(rows, levels)
    if video_id:
        rows = rows.where(F.col("video_id") == video_id)
    rows = filter_time(rows, low, high)
    for column, wanted in (("objects_text", objects), ("scene_text", scenes)):
        for value in wanted:
            rows = rows.where(F.contains(F.lower(column), F.lit(value.lower())))
    by = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("new_rank", F.row_number().over(by)).where(F.col("new_rank") <= k)


def over_fetched(ranked: DataFrame, docs: DataFrame, k: int, **filters) -> DataFrame:
    """A channel whose search cannot filter: of its candidates, OVER_FETCH times k of which are asked for, the ``k`` best that
    pass ``post_filter``, ranked anew; (query_id, rank, doc_id)."""
    kept = post_filter(ranked, docs, k, **filters)
    return kept.select("query_id", F.col("new_rank").alias("rank"), "doc_id")
