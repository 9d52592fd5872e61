"""Retrieval quality, task scores and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, cuts=(1, 5, 10)) -> DataFrame:
    """(query_id, level, mrr, recall_k.., ndcg_k..) of ``ranking`` (query_id, level, rank, id) against ``qrels``
    (query_id, level, id, grade); an id counts once, at its best rank; gains are 2^grade - 1. Queries without qrels have
    no row."""
    once = ranking.groupBy("query_id", "level", "id").agg(F.min("rank").alias("rank"))
    by = Window.partitionBy("query_id", "level").orderBy("rank", "id")
    once = once.withColumn("place", F.row_number().over(by))
    best = qrels.groupBy("query_id", "level", "id").agg(F.max("grade").alias("grade"))
    ideal = Window.partitionBy("query_id", "level").orderBy(F.desc("grade"), "id")
    rows = best.withColumn("ideal", F.row_number().over(ideal)).join(once.select("query_id", "level", "id", "place"), ["query_id", "level", "id"], "left")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    out = [F.round(F.coalesce(F.max(1 / F.col("place")), F.lit(0.0)), 6).alias("mrr")]
    for k in cuts:
        out.append(F.round(F.count_if(F.col("place") <= k) / F.count("*"), 6).alias(f"recall_{k}"))
        dcg = F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1)).otherwise(0.0))
        out.append(F.round(dcg / F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}"))
    return rows.groupBy("query_id", "level").agg(*out)


def macro_quality(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """Means of the metrics by level and by (query_type, level); query_type is null for all."""
    joined = metrics.join(queries.select("query_id", "query_type"), "query_id")
    names = [c for c in metrics.columns if c not in ("query_id", "level")]
    both = joined.withColumn("query_type", F.explode(F.array(F.lit(None).cast("string"), F.col("query_type"))))
    return both.groupBy("query_type", "level").agg(F.count("*").alias("labeled"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def latency_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, extremes and exact p50, p95, p99 by group, and overall under 'all', which a group of that name does not
    join."""
    pair = lambda overall, name: F.struct(F.lit(overall).alias("overall"), name.cast("string").alias("group"))
    both = rows.select(F.explode(F.array(pair(True, F.lit("all")), pair(False, F.col(by)))).alias("g"), F.col(value).alias("v"))
    pct = [F.round(F.percentile("v", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return both.groupBy("g.overall", "g.group").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), *pct).drop("overall")


def r_scores(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(question_id, rank, r_score): share of an answer's moments inside the truth's frame ranges, in the right video.

    ``answers`` (question_id, rank, moment, video_id, frame_idx, answer), ``truth`` (question_id, moment, video_id, start,
    end, answer); kis and qa have one moment; a null answer in the truth asks for none."""
    n = truth.groupBy("question_id").agg(F.count("*").alias("moments"))
    t = truth.select("question_id", "moment", F.col("video_id").alias("t_video"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("answer").alias("t_answer"))
    hit = (F.col("video_id") == F.col("t_video")) & F.col("frame_idx").between(F.col("t_start"), F.col("t_end")) & (F.col("t_answer").isNull() | F.col("answer").eqNullSafe(F.col("t_answer")))
    rows = answers.join(t, ["question_id", "moment"], "left").groupBy("question_id", "rank").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    return rows.join(n, "question_id").select("question_id", "rank", F.round(F.col("hits") / F.col("moments"), 6).alias("r_score"))


def final_scores(scores: DataFrame, cuts=(1, 5, 20, 50, 100)) -> DataFrame:
    """Mean over the cuts of the best R-score among the first k answers."""
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r_score"))), F.lit(0.0)) for k in cuts]
    total = best[0]
    for b in best[1:]:
        total = total + b
    return scores.groupBy("question_id").agg(F.round(total / len(cuts), 6).alias("final_score"))
