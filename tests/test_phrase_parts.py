"""Videos are dealt by their text when phrases are made."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from framelens.operators import enrichment

WORDS = ["red", "blue", "car", "bus", "tree", "sea", "river", "road"]



def test_a_task_holds_the_phrases_of_a_share_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(enrichment, "CHARS", 1000)
    rng = random.Random(3)
    said = [(f"v{i}", j, " ".join(rng.choices(WORDS, k=20))) for i in range(100) for j in range(3)]
    segments = spark.createDataFrame(said, "video_id string, segment_index int, text string")
    chars = sum(len(t) for *_, t in said)
    made = enrichment.phrases(segments).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(made) > chars / 1000 / 2 and max(r["count"] for r in made) < 119 * 100 / 8
    expected = defaultdict(set)
    for i in range(100):
        words = " ".join(t for v, _, t in said if v == f"v{i}").split()
        for n in (2, 3):
            for at in range(len(words) - n + 1):
                expected[" ".join(words[at:at + n])].add(i)
    assert {r["phrase"]: r["videos"] for r in enrichment.phrase_frequency(segments).collect()} == {p: len(v) for p, v in expected.items()}


def test_phrases_of_no_text(spark):
    none = spark.createDataFrame([], "video_id string, segment_index int, text string")
    null = spark.createDataFrame([("v", 1, None), ("v", 2, " ")], "video_id string, segment_index int, text string")
    assert enrichment.phrase_frequency(none).collect() == [] == enrichment.phrase_frequency(null).collect()


def test_phrases_of_subjects_are_made_once(spark):
    said = [(f"v{i}", j, f"red river road {w} tree") for i in range(4) for j, w in enumerate(WORDS[:i + 2])]
    segments = spark.createDataFrame(said, "video_id string, segment_index int, text string")
    titles = segments.groupBy("video_id").agg(F.min_by("text", "segment_index").alias("title"))
    made = enrichment.subject_scores(segments, titles)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([line for line in plan if "Aggregate [video_id#" in line and ", phrase#" in line.split("]")[0]]) == 1
    assert {(r["video_id"], r["count"]) for r in made.where("phrase = 'red river'").collect()} == {(f"v{i}", 2 * (i + 2)) for i in range(4)}
