"""Boxes, frames and vectors, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_area(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def valid_box(x1, y1, x2, y2) -> Column:
    return (x1 >= 0) & (x1 < x2) & (x2 <= 1) & (y1 >= 0) & (y1 < y2) & (y2 <= 1)


def prominence(confidence, x1, y1, x2, y2) -> Column:
    """Confidence, raised by the box's area and lowered by its distance from the centre."""
    distance = F.least(F.lit(1.0), F.sqrt(F.pow((x1 + x2) / 2 - 0.5, 2) + F.pow((y1 + y2) / 2 - 0.5, 2)) / F.lit(0.5**0.5))
    return confidence * (0.45 + 0.55 * F.sqrt(box_area(x1, y1, x2, y2))) * (1 - 0.35 * distance)


def text_zone(x: Column, y: Column) -> Column:
    """scene, ticker or logo, by the centre of a text box."""
    return F.when(y >= 0.82, "ticker").when((y <= 0.18) & ((x <= 0.22) | (x >= 0.78)), "logo").otherwise("scene")


def frame_quality(sharpness, luma, black, white) -> Column:
    sharp = F.least(F.lit(1.0), F.log1p(sharpness) / F.log1p(F.lit(1500.0)))
    exposure = F.greatest(F.lit(0.0), 1 - F.abs(luma - 127.5) / 127.5)
    return 0.60 * sharp + 0.25 * exposure + 0.15 * (1 - F.greatest(black, white))


def keyframe_budget(duration, motion) -> Column:
    base = F.when(duration <= 4, 1).when(duration <= 12, 2).otherwise(3)
    return F.least(F.lit(4), base + F.when((motion >= 0.12) & (duration >= 2), 1).otherwise(0))


def keyframe_limit(duration, most: int = 4) -> Column:
    """Keyframes of a shot by its length alone: one up to 3 seconds, two up to 10, three up to 25, else ``most``."""
    return F.when(duration <= 3, 1).when(duration <= 10, 2).when(duration <= 25, 3).otherwise(most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / norm)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
