"""Logs, upserts, source choice, provenance and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id, vector_key


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append log."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def pending(items: DataFrame, ledger: DataFrame, keys: list[str], order: list[str], done: str = "completed") -> DataFrame:
    """Work items whose last ledger entry is not a success; failed ones come again."""
    finished = latest_by_key(ledger, keys, order).where(F.col("status") == done).select(*keys)
    return items.join(finished, keys, "left_anti")


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the source rows whose key it lacks; rows that exist stay as they are."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target with the source's values in ``columns`` where the source has the key, and the source's new keys."""
    new = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__in"))
    rest = [c for c in target.columns if c not in keys]
    value = lambda c: F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return target.join(new, keys, "full").select(*keys, *[value(c) for c in rest])


def trusted_files(files: DataFrame, rows: DataFrame, models: list[str]) -> DataFrame:
    """Files (path) of which some row (path, model) comes from a trusted model."""
    return files.join(rows.groupBy("path").agg(F.bool_or(F.col("model").isin(models)).alias("trusted")).where("trusted").select("path"), "path", "left_semi")


def choose_artifact(files: DataFrame, preferred: str) -> DataFrame:
    """Best file of each video: 10 for the preferred version, 1 for the video id in the path; then the path."""
    score = F.when(F.col("version") == preferred, 10).otherwise(0) + F.when(F.contains("path", "video_id"), 1).otherwise(0)
    by = Window.partitionBy("video_id").orderBy(F.desc("choice_score"), "path", F.desc("score"))
    return files.withColumn("choice_score", score).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def choose_transcript(copies: DataFrame) -> DataFrame:
    """Copy of each video's transcript with the most content tokens, then the smallest path."""
    from ..functions.text import content_tokens

    by = Window.partitionBy("video_id").orderBy(F.desc("tokens"), "path")
    return copies.withColumn("tokens", F.size(content_tokens(F.col("text")))).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def fill_provenance(rows: DataFrame, owners: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Missing provenance of rows from their owner's."""
    o = owners.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(o, key, "left")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def provenance_conflicts(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose known value differs, ignoring case, from the found one."""
    f = found.select(key, F.col(column).alias("__found"))
    return rows.join(f, key).where(F.col(column).isNotNull() & (F.lower(column) != F.lower("__found"))).select(key, F.col(column).alias("known"), F.col("__found").alias("found"))


def feature_jobs(keyframes: DataFrame, feature: str) -> DataFrame:
    """One job for each video with its number of records."""
    n = keyframes.groupBy("video_id").agg(F.count("*").alias("records"))
    return n.select(stable_id(F.lit(feature), F.col("video_id")).alias("job_id"), "video_id", "records", F.lit("completed").alias("status"))


def feature_records(keyframes: DataFrame, feature: str) -> DataFrame:
    """One record for each keyframe with a stable key."""
    return keyframes.select("keyframe_id", stable_id(F.lit(feature), F.col("video_id")).alias("job_id"), vector_key(F.col("keyframe_id")).alias("vector_pk"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def greatest_provenance(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The greatest value of each provenance column among a run's or a job's rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def union_levels(*tables: DataFrame) -> DataFrame:
    """Documents of several levels as one table; columns that a level lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compare_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(``key``, in_a, in_b) for the union of two sets of ids: their differences and their intersection are filters on it."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, key, "full").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def compare_summary(compared: DataFrame) -> DataFrame:
    """One row of ``compare_ids``: sizes of the differences and the intersection, and whether a is part of b or equals it."""
    only_a, only_b, both = (F.count_if(c) for c in (F.col("in_a") & ~F.col("in_b"), F.col("in_b") & ~F.col("in_a"), F.col("in_a") & F.col("in_b")))
    n = compared.agg(only_a.alias("only_a"), only_b.alias("only_b"), both.alias("both"))
    return n.withColumns({"subset": F.col("only_a") == 0, "equal": (F.col("only_a") == 0) & (F.col("only_b") == 0)})


def first_valid(items: DataFrame, n: int, order: list[str], strict: bool = False) -> DataFrame:
    """The first ``n`` valid items with a url; ``strict``: fewer are an error."""
    found = items.where("valid AND url IS NOT NULL AND trim(url) <> ''").orderBy(*order).limit(n)
    if strict and (have := found.count()) < n:
        raise ValueError(f"only {have} of {n} items are valid")
    return found


def feedback_marks(events: DataFrame) -> DataFrame:
    """(session_id, polarity, id, since): each id marked positive or negative in a session, and the revision that first did
    so. The set of a revision is what has ``since`` up to it, so sets that grow are stored once."""
    long = events.select("session_id", "revision", F.explode(F.array(F.struct(F.lit("positive").alias("polarity"), F.col("positive_id").alias("id")), F.struct(F.lit("negative").alias("polarity"), F.col("negative_id").alias("id")))).alias("m"))
    return long.where("m.id IS NOT NULL").groupBy("session_id", "m.polarity", "m.id").agg(F.min("revision").alias("since"))


def feedback_sizes(events: DataFrame) -> DataFrame:
    """Per session and revision the numbers of different ids marked positive and negative so far, as running sums."""
    new = feedback_marks(events).groupBy("session_id", F.col("since").alias("revision")).agg(*[F.count_if(F.col("polarity") == p).alias(f"new_{p}s") for p in ("positive", "negative")])
    by = Window.partitionBy("session_id").orderBy("revision").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.select("session_id", "revision").distinct().join(new, ["session_id", "revision"], "left")
    return rows.select("session_id", "revision", *[F.sum(F.coalesce(f"new_{p}s", F.lit(0))).over(by).alias(f"{p}s") for p in ("positive", "negative")])


def review_answers(answers: DataFrame, most: int = 100) -> DataFrame:
    """Problems, status and rows of each answer (question_id, qtype, events, frames array<struct<video_id, frame_idx,
    pts_time>>, answer_text): ready, missing or invalid."""
    f, q = F.col("frames"), F.col("qtype")
    n = F.size(f)
    times = F.transform(f, lambda x: x["pts_time"])
    falling = F.exists(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.coalesce(F.try_element_at(times, i) < F.try_element_at(times, i - 1), F.lit(False)))
    bad_frame = F.exists(f, lambda x: x["video_id"].isNull() | (F.trim(x["video_id"]) == "") | F.lower(x["video_id"]).endswith(".mp4") | x["frame_idx"].isNull() | (x["frame_idx"] < 0))
    videos = F.size(F.array_distinct(F.transform(f, lambda x: x["video_id"])))
    text = F.trim(F.coalesce("answer_text", F.lit("")))
    missing = F.array_compact(F.array(F.when(n == 0, F.lit("NO_FRAME")), F.when((q == "qa") & (text == ""), F.lit("NO_ANSWER")), F.when((q == "trake") & (n > 0) & (n < F.col("events")), F.lit("TOO_FEW_FRAMES"))))
    errors = F.array_compact(F.array(
        F.when(~q.isin("kis", "qa", "trake"), F.lit("TYPE")), F.when(bad_frame, F.lit("FRAME")), F.when(q.isin("kis", "qa") & (n > most), F.lit("TOO_MANY_ROWS")), F.when((q == "qa") & (F.length(text) > 100), F.lit("LONG_ANSWER")),
        F.when((q == "trake") & (F.col("events") == 0), F.lit("NO_EVENTS")), F.when((q == "trake") & (n > F.col("events")), F.lit("TOO_MANY_FRAMES")), F.when((q == "trake") & (videos > 1), F.lit("VIDEOS")), F.when((q == "trake") & falling, F.lit("ORDER"))))
    rows = answers.withColumns({"missing": missing, "errors": errors})
    status = F.when(F.size("errors") > 0, "invalid").when(F.size("missing") > 0, "missing").otherwise("ready")
    count = F.when(q.isin("kis", "qa"), n).when(F.col("status") == "ready", 1).otherwise(0)
    return rows.withColumn("status", status).withColumn("row_count", count).withColumn("messages", F.concat("missing", "errors"))


def submission_summary(reviewed: DataFrame) -> DataFrame:
    n = reviewed.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "missing", "invalid")])
    return n.withColumn("valid", (F.col("total") > 0) & (F.col("ready") == F.col("total")))


def submission_rows(answers: DataFrame) -> DataFrame:
    """(question_id, line_no, line): kis video,frame; qa with the quoted answer; trake one line of a video's frames."""
    quoted = F.concat(F.lit('"'), F.replace(F.trim(F.coalesce("answer_text", F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))
    single = F.transform("frames", lambda x: F.concat_ws(",", x["video_id"], x["frame_idx"].cast("string"), F.when(F.col("qtype") == "qa", quoted)))
    chain = F.array(F.concat_ws(",", F.try_element_at(F.col("frames"), F.lit(1))["video_id"], F.array_join(F.transform("frames", lambda x: x["frame_idx"].cast("string")), ",")))
    lines = F.when(F.size("frames") == 0, F.array().cast("array<string>")).when(F.col("qtype") == "trake", chain).otherwise(single)
    return answers.select("question_id", F.posexplode(lines).alias("pos", "line")).select("question_id", (F.col("pos") + 1).alias("line_no"), "line")


def run_ledger(log: DataFrame) -> DataFrame:
    """State of each run from its log (run_id, seq, status, items, error, at): the last entry's status; completed with its
    time and counts; a restart clears the error and the completion."""
    last = latest_by_key(log, ["run_id"], ["seq"])
    done = F.col("status") == "completed"
    return last.select("run_id", "status", F.when(done, F.col("items")).alias("items"), F.when(F.col("status") == "error", F.col("error")).alias("error"), F.when(done, F.col("at")).alias("completed_at"))


def latest_questions(questions: DataFrame) -> DataFrame:
    """Questions of the set that was imported last, by part and number."""
    newest = questions.groupBy("set_id").agg(F.max("imported_at").alias("__at")).orderBy(F.desc("__at"), F.desc("set_id")).limit(1)
    return questions.join(F.broadcast(newest), "set_id").drop("__at").orderBy("part", "number")


def scope_options(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a scope column, and all."""
    spark = rows.sparkSession
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("scope")).distinct().unionByName(spark.range(1).select(F.lit("all").alias("scope")))
