"""Readers of the collection's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP_COLUMNS = ["n", "pts_time", "fps", "frame_idx"]


def _stem(pattern: str = r"([^/]+)\.[^./]+$"):
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def read_keyframe_map(spark: SparkSession, path: str) -> DataFrame:
    """Keyframe maps (n, pts_time, fps, frame_idx) as text, with the video id from the file's name; a header that
    differs from the contract fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MAP_COLUMNS])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return rows.select(_stem().alias("video_id"), *MAP_COLUMNS)


def checked_keyframe_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Keyframe maps as ``read_keyframe_map`` reads them, and the issues of their headers (video_id, row_number, severity, code).

    A file whose first line is not the contract's names in their order (a byte-order mark and carriage returns aside) is an
    INVALID_COLUMNS issue, and its rows are left out; the other files are read all the same. A file
    of no bytes is nothing that Spark reads: its video has no mapping, which ``quality.pair_issues`` tells. Maps are one small file for each video, so the first lines are read with whole files."""
    files = spark.read.text(path, wholetext=True).select(_stem().alias("video_id"), F.regexp_replace(F.substring_index("value", "\n", 1), r"^\uFEFF|\r$", "").alias("head"))
    bad = files.where(F.col("head") != ",".join(MAP_COLUMNS)).select("video_id")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MAP_COLUMNS])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True).select(_stem().alias("video_id"), *MAP_COLUMNS).join(bad, "video_id", "left_anti")
    return rows, bad.select("video_id", F.lit(None).cast("long").alias("row_number"), F.lit("error").alias("severity"), F.lit("INVALID_COLUMNS").alias("code"))


def read_media_info(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file: its known fields, and corrupt where it cannot be parsed."""
    kind = "author string, title string, description string, keywords array<string>, length long, publish_date string, thumbnail_url string, watch_url string, topic string, bad string"
    rows = spark.read.schema(kind).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    return rows.select(_stem().alias("video_id"), "*").withColumn("corrupt", F.col("bad").isNotNull()).drop("bad")


def read_jsonl(spark: SparkSession, path: str, schema: str, text_col: str = "text") -> DataFrame:
    """JSON lines; blank and broken lines and rows without text are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.where(F.col(text_col).isNotNull() & (F.trim(text_col) != ""))


def read_artifacts(spark: SparkSession, root: str, name: str, required: list[str]) -> DataFrame:
    """All Parquet files called ``name`` under ``root``; a missing required column is an error."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("mergeSchema", True).parquet(root)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return rows


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query files query-p<part>-<number>-<kis|qa|trake>.txt: part, number, qtype, text and, of trake, intro and events
    (lines that start with E and a number). Other names come back with matched false."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    name = lambda k: F.regexp_extract("file_name", r"(?i)^query-(p\d+)-(\d+)-(kis|qa|trake)\.txt$", k)
    rows = rows.withColumns({"part": F.lower(name(1)), "number": F.expr("try_cast(regexp_extract(file_name, '(?i)^query-(p[0-9]+)-([0-9]+)-', 2) AS int)"), "qtype": F.lower(name(3))})
    lines = F.transform(F.split("text", r"\r?\n"), F.trim)
    event = r"^E\d+\s*[:.)-]?\s*"
    events = F.when(F.col("qtype") == "trake", F.transform(F.filter(lines, lambda x: x.rlike(event)), lambda x: F.regexp_replace(x, event, ""))).otherwise(F.array().cast("array<string>"))
    intro = F.when(F.col("qtype") == "trake", F.array_join(F.filter(lines, lambda x: ~x.rlike(event) & (x != "")), " ")).otherwise(F.col("text"))
    return rows.select("file_name", (F.col("qtype") != "").alias("matched"), "part", "number", "qtype", "text", intro.alias("intro"), events.alias("events"))


#: Levels of judgements, and the names that lines use for them; hyphens are underscores.
LEVELS = ["doc_id", "shot_id", "video_id"]
LEVEL_ALIASES = {"doc": "doc_id", "document": "doc_id", "documents": "doc_id", "docid": "doc_id", "shot": "shot_id", "shots": "shot_id", "shotid": "shot_id", "video": "video_id", "videos": "video_id", "videoid": "video_id",
                 "doc_id": "doc_id", "shot_id": "shot_id", "video_id": "video_id"}
#: Fields of a line that hold judgements: by level, by item, and plain lists of document ids.
LEVEL_FIELDS = ["{}", "relevant_{}s", "relevant_{}", "gold_{}s", "gold_{}", "positive_{}s", "positive_{}", "{}s"]
ITEM_FIELDS = ["relevant", "relevance", "qrels", "ground_truth", "positives", "relevant_items"]
ID_FIELDS = ["relevant_ids", "positive_ids", "gold_ids"]


def level_alias(c: Column) -> Column:
    """The level that a name means, whatever its case and hyphens; null for others."""
    names = F.create_map(*[F.lit(x) for pair in LEVEL_ALIASES.items() for x in pair])
    return names[F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))]


def grade_of(c: Column) -> Column:
    """A grade; 1 where it is missing, no finite number or not above 0."""
    number = c.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf")), number).otherwise(F.lit(1.0))


def _items(value: Column, of: Column) -> Column:
    """(level, id, grade) of a JSON value: an id, {id, relevance}, a map of ids to grades, or a list of the first two."""
    text = F.trim(value)
    pair = lambda name, one, grade: F.struct(name.cast("string").alias("level"), one.cast("string").alias("id"), grade_of(grade).alias("grade"))

    def one(v):
        """An item: an object with an id, or an id."""
        o = F.when(F.startswith(v, F.lit("{")), F.from_json(v, "map<string,string>"))
        grade = F.coalesce(o["relevance"], o["relevance_score"], o["score"], o["grade"], F.lit("1"))
        named = level_alias(F.coalesce(o["level"], o["type"]))
        own = [pair(F.lit(n), o[n], grade) for n in LEVELS]
        inside = F.when(named.isNotNull(), F.array(pair(named, F.coalesce(F.when(named == "doc_id", o["doc_id"]).when(named == "shot_id", o["shot_id"]).otherwise(o["video_id"]), o["id"], o["value"]), grade))) \
            .when(F.coalesce(o["id"], o["value"]).isNotNull() & F.coalesce(o["level"], o["type"]).isNull(), F.array(pair(of, F.coalesce(o["id"], o["value"]), grade))).otherwise(F.filter(F.array(*own), lambda p: p["id"].isNotNull()))
        return F.when(o.isNotNull(), inside).otherwise(F.array(pair(of, F.when(~F.startswith(v, F.lit("[")), v), F.lit("1"))))

    table = F.from_json(text, "map<string,string>")
    is_item = F.exists(F.array(*[table[n] for n in (*LEVELS, "id", "value")]), lambda x: x.isNotNull())
    pairs = F.transform(F.map_entries(table), lambda e: pair(of, e["key"], e["value"]))
    listed = F.flatten(F.transform(F.from_json(text, "array<string>"), one))
    made = F.when(F.startswith(text, F.lit("[")), listed).when(F.startswith(text, F.lit("{")) & is_item, one(text)).when(F.startswith(text, F.lit("{")), pairs).otherwise(one(text))
    return F.filter(F.coalesce(made, F.array()), lambda p: p["id"].isNotNull() & (F.trim(p["id"]) != "") & p["level"].isNotNull())


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements in JSON lines: (query_id, level, id, grade), the greatest grade of an id. A line names its query as query_id,
    qid, query or id, and its judgements in fields by level (LEVEL_FIELDS), in fields of items with levels (ITEM_FIELDS: lists
    of items, or a map of levels, or a map of document ids to grades) or in lists of document ids (ID_FIELDS). Grades that
    are missing, not finite or not above 0 count 1. Lines without a query or that are no JSON objects are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", "map<string,string>").alias("m")).where("m IS NOT NULL")
    m = F.col("m")
    rows = rows.withColumn("query_id", F.trim(F.coalesce(m["query_id"], m["qid"], m["query"], m["id"]))).where("query_id <> ''")
    fields = F.create_map(*[F.lit(x) for level in LEVELS for f in LEVEL_FIELDS for x in (f.format(level), level)])
    rows = rows.select("query_id", F.explode(F.map_entries("m")).alias("e")).select("query_id", "e.key", "e.value").where("value IS NOT NULL")
    item = F.col("key").isin(ITEM_FIELDS)
    rows = rows.withColumn("nested", F.when(item & F.startswith(F.trim("value"), F.lit("{")), F.from_json("value", "map<string,string>")))
    rows = rows.withColumn("by_level", F.filter(F.transform(F.map_entries("nested"), lambda e: F.struct(fields[e["key"]].alias("level"), e["value"].alias("value"))), lambda p: p["level"].isNotNull()))
    one = lambda level: F.array(F.struct(level.alias("level"), F.col("value").alias("value")))
    held = F.when(fields[F.col("key")].isNotNull(), one(fields[F.col("key")])).when(item & (F.size("by_level") > 0), F.col("by_level")).when(item | F.col("key").isin(ID_FIELDS), one(F.lit("doc_id")))
    rows = rows.select("query_id", F.explode(held).alias("h")).select("query_id", "h.level", "h.value").where("value IS NOT NULL")
    out = rows.select("query_id", F.explode(_items(F.col("value"), F.col("level"))).alias("j")).select("query_id", "j.level", F.trim("j.id").alias("id"), "j.grade")
    return out.groupBy("query_id", "level", "id").agg(F.max("grade").alias("grade"))
