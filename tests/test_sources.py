import json

import pytest
from pyspark.sql import functions as F

from framelens.sources import readers, writers
from framelens.streaming import ingest


def test_keyframe_map_checks_its_header(spark, tmp_path):
    (tmp_path / "L01_V001.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,25.0,0\n2,x,25.0,9\n")
    got = readers.read_keyframe_map(spark, f"{tmp_path}/*.csv").collect()
    assert {r["video_id"] for r in got} == {"L01_V001"} and [r["pts_time"] for r in got] == ["0.0", "x"]
    (tmp_path / "L01_V002.csv").write_text("n,fps,pts_time,frame_idx\n1,25.0,0.0,0\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_keyframe_map(spark, f"{tmp_path}/L01_V002.csv").collect()


def test_media_info_marks_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "t", "keywords": ["x"], "watch_url": "u"}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    got = {r["video_id"]: (r["title"], r["corrupt"]) for r in readers.read_media_info(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"a": ("t", False), "b": (None, True)}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n\n{bad\n{"id": 2, "text": " "}\n')
    assert [r["id"] for r in readers.read_jsonl(spark, str(tmp_path), "id int, text string").collect()] == [1]


def test_artifacts_keep_their_contract(spark, tmp_path):
    spark.range(3).withColumn("a", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/x/one")
    assert readers.read_artifacts(spark, str(tmp_path), "*.parquet", ["id", "a"]).count() == 3
    with pytest.raises(ValueError):
        readers.read_artifacts(spark, str(tmp_path), "*.parquet", ["missing"])


def test_query_files(spark, tmp_path):
    (tmp_path / "query-p1-2-kis.txt").write_text("find it\n")
    (tmp_path / "query-p1-10-trake.txt").write_text("A jump.\nE1: take-off\nE2: landing\n")
    (tmp_path / "notes.txt").write_text("no")
    got = {r["file_name"]: r for r in readers.read_queries(spark, f"{tmp_path}/*.txt").collect()}
    trake = got["query-p1-10-trake.txt"]
    assert (trake["part"], trake["number"], trake["intro"], trake["events"]) == ("p1", 10, "A jump.", ["take-off", "landing"])
    assert got["query-p1-2-kis.txt"]["text"] == "find it" and not got["notes.txt"]["matched"]


def test_qrels_of_every_shape(spark, tmp_path):
    lines = [{"query_id": "q", "relevant_doc_ids": ["d1", {"id": "d2", "relevance": 3}, {"id": "d0", "relevance": 0}]}, {"query_id": "q", "relevant_video_ids": ["v"], "relevant": [{"level": "shot", "id": "s", "relevance": 2}, {"level": "doc", "id": "d1", "relevance": 2}]}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {(r["level"], r["id"], r["grade"]) for r in readers.read_qrels(spark, str(tmp_path)).collect()}
    assert got == {("doc_id", "d0", 1.0), ("doc_id", "d1", 2.0), ("doc_id", "d2", 3.0), ("video_id", "v", 1.0), ("shot_id", "s", 2.0)}


def test_qrels_of_other_names_and_grades(spark, tmp_path):
    lines = [
        {"qid": 7, "gold_shot_ids": {"s1": 2, "s2": -1, "s3": "x"}, "video_ids": "v1", "positive_ids": ["d1", {"value": "d2", "score": 2.5}]},
        {"query": "q", "relevant": {"relevant_video_ids": ["v2"], "shot_id": {"id": "s4", "relevance_score": 4}}, "qrels": {"d3": 3, "d4": None}},
        {"id": "r", "ground_truth": ["d5", {"level": "Video-ID", "video_id": "v3", "relevance": 1e400}, {"type": "SHOTS", "id": "s5"}, {"level": "scene", "id": "no"}, {"doc_id": "d6", "shot_id": "s6"}]},
        {"relevant_ids": ["nobody"]}, "no object",
    ]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nbroken")
    got = {tuple(r) for r in readers.read_qrels(spark, str(tmp_path)).collect()}
    assert got == {("7", "shot_id", "s1", 2.0), ("7", "shot_id", "s2", 1.0), ("7", "shot_id", "s3", 1.0), ("7", "video_id", "v1", 1.0), ("7", "doc_id", "d1", 1.0), ("7", "doc_id", "d2", 2.5),
                   ("q", "video_id", "v2", 1.0), ("q", "shot_id", "s4", 4.0), ("q", "doc_id", "d3", 3.0), ("q", "doc_id", "d4", 1.0),
                   ("r", "doc_id", "d5", 1.0), ("r", "video_id", "v3", 1.0), ("r", "shot_id", "s5", 1.0), ("r", "doc_id", "d6", 1.0), ("r", "shot_id", "s6", 1.0)}


def test_replacing_leaves_other_videos(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, n int"), path)
    writers.replace_partitions(spark.createDataFrame([("b", 3)], "video_id string, n int"), path)
    assert {(r["video_id"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_plain_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f1", 2, "b"), ("f1", 1, "a"), ("f2", 1, "c")], "file_name string, line_no int, line string")
    writers.write_submission(df, f"{tmp_path}/s")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/s/file_name=f1").collect()] == ["a", "b"]
    for write, read in ((writers.write_jsonl, spark.read.json), (writers.write_table, spark.read.parquet)):
        write(df, f"{tmp_path}/{write.__name__}")
        assert read(f"{tmp_path}/{write.__name__}").count() == 3
    writers.write_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 3


def test_streams_equal_a_batch_run(spark, tmp_path):
    log = f"{tmp_path}/log"
    kind = "key int, at int, status string"
    for part in ([(1, 1, "a"), (2, 1, "a")], [(1, 2, "b"), (3, 1, "c")], [(2, 0, "old")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(log)
        stream = ingest.file_stream(spark, log, spark.read.parquet(log).schema, 1)
        ingest.keep_latest(stream, f"{tmp_path}/t", f"{tmp_path}/ck", ["key"], ["at"], 4).awaitTermination()
    assert {(r["key"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "b"), (2, "a"), (3, "c")}
    stream = ingest.file_stream(spark, log, spark.read.parquet(log).schema)
    build = lambda rows: rows.groupBy("key").count()
    ingest.refresh_touched(stream, lambda s: s.read.parquet(log), build, f"{tmp_path}/u", f"{tmp_path}/ck2", "key").awaitTermination()
    assert {(r["key"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/u").collect()} == {(1, 2), (2, 2), (3, 1)}


def test_ingest_keeps_what_earlier_batches_brought(spark, tmp_path):
    log, rows = f"{tmp_path}/log", []
    for part in ([(1, 1), (2, 1), (2, 1)], [(1, 2), (3, 2)], [(1, 3), (2, 3)]):
        rows += part
        spark.createDataFrame(part, "key int, at int").coalesce(1).write.mode("append").parquet(log)
    for more in ([], [(3, 4), (1, 4)]):  # several batches in one run, then a run that brings one more file
        if more:
            rows += more
            spark.createDataFrame(more, "key int, at int").coalesce(1).write.mode("append").parquet(log)
        stream = ingest.file_stream(spark, log, "key int, at int", 1).withColumn("part", F.col("key") % 2)
        ingest.ingest_by_video(stream, f"{tmp_path}/t", f"{tmp_path}/ck", "part").awaitTermination()
        assert sorted((r["key"], r["at"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == sorted(rows)
