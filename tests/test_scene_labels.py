"""Texts are cleaned once for all cues of scenes."""

from pyspark.sql import functions as F

from framelens.functions import text


def test_a_text_is_cleaned_once_for_all_cues(spark):
    rows = spark.createDataFrame([(0, "Trong   NHÀ,\ttrời\u00a0mưa"), (1, "trời sáng"), (2, ""), (3, None), (4, "không có gì")], "id int, said string")
    found = rows.select("id", text.scene_labels(F.col("said")).alias("labels"))
    assert {r["id"]: r["labels"] for r in found.collect()} == {0: ["indoor", "rain"], 1: ["daytime", "sunny"], 2: [], 3: [], 4: []}
    plan = rows.select(text.scene_labels(F.col("said")).alias("labels"))._jdf.queryExecution().analyzed().toString().splitlines()
    assert sum(line.count("regexp_replace(") for line in plan) == 1
