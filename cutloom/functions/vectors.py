"""Vectors held in arrays, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def box_iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes [x, y, width, height]; 0 where there is none."""
    at = lambda box, i: F.get(box, F.lit(i)).cast("double")
    w = F.least(at(a, 0) + at(a, 2), at(b, 0) + at(b, 2)) - F.greatest(at(a, 0), at(b, 0))
    h = F.least(at(a, 1) + at(a, 3), at(b, 1) + at(b, 3)) - F.greatest(at(a, 1), at(b, 1))
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = at(a, 2) * at(a, 3) + at(b, 2) * at(b, 3) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)
