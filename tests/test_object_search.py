"""Objects are ranked before labels are gathered."""

import random

import pytest

from framelens.operators import lexical


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def objects_by_hand(rows, queries, k):
    out = []
    for q, text in queries:
        best = {}
        for frame, at, name, sure in rows:
            if name is not None and text is not None and text.lower() in name.lower():
                best.setdefault((frame, at), []).append((name, sure))
        found = [(f, t, ", ".join(sorted({n for n, _ in hits})), max((s for _, s in hits if s is not None), default=None)) for (f, t), hits in best.items()]
        found.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[1] is not None, r[1] or 0, r[0] is not None, r[0] or ""))
        out += [(q, *r, n + 1) for n, r in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_objects_are_ranked_before_labels_are_gathered(spark, monkeypatch, seed, few):
    if not few:
        monkeypatch.setattr(lexical, "_few", lambda *a: False)
    rng = random.Random(seed)
    names = ["view", "review", "click", "Car", "scar", "cart", None, ""]
    frames = [(rng.choice([f"k{i}", f"k{i}", None]), rng.choice([float(i // 4), None])) for i in range(60)]
    rows = [(*rng.choice(frames), rng.choice(names), rng.choice([0.5, 0.9, 1.0, None, rng.random()])) for _ in range(400)]
    rows += rows[:40]
    asked = [(1, "CAR"), (2, "view"), (3, "c"), (4, ""), (5, "none"), (6, None)]
    detections = spark.createDataFrame(rows, "keyframe_id string, pts_time double, class_name string, confidence double")
    found = lexical.object_search(detections, spark.createDataFrame(asked, "query_id long, text string"), 7)
    assert found.columns == ["query_id", "keyframe_id", "pts_time", "labels", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == objects_by_hand(rows, asked, 7)
    plan = optimized(found)
    assert plan.index("collect_set") < plan.index("row_number")  # the tree's root comes first
