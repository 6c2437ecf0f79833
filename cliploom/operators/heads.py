"""Scoring heads and landmark vectors, row by row: nothing depends on other rows. Null arrays give null results, and so do null components in sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.numeric import sigmoid, unit_clip, weight

#: The gaze directions in the order of their vector.
GAZE = ("eyeLookDownLeft", "eyeLookDownRight", "eyeLookInLeft", "eyeLookInRight", "eyeLookOutLeft", "eyeLookOutRight", "eyeLookUpLeft", "eyeLookUpRight")
#: The landmarks of the face's contour.
CONTOUR = (10, 338, 297, 332, 284, 251, 389, 356, 454, 323, 361, 288, 397, 365, 379, 378, 400, 377, 152, 148, 176, 149, 150, 136, 172, 58, 132, 93, 234, 127, 162, 21, 54, 103, 67, 109)


def logit(token: Column, bias: float = 0.0) -> Column:
    return F.aggregate(F.transform(token, lambda v, d: v.cast("double") * weight(d, F.lit(0))), F.lit(0.0), lambda s, x: s + x) + bias


def predict(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds probability and prediction from ``logit``; the threshold itself counts as positive."""
    p = sigmoid(F.col("logit"))
    return scored.withColumn("probability", p).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Of a with the positive part of b; 0 if either has no length. Vectors of unequal lengths give null."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    da, db = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    norm = lambda x: F.greatest(F.sqrt(total(F.transform(x, lambda y: y * y))), F.lit(eps))
    return total(F.zip_with(da, db, lambda x, y: x * y)) / (norm(da) * norm(db))


def gaze_vector(scores: Column, names: Sequence[str] = GAZE) -> Column:
    """array<double> in the order of ``names`` from map<string,double>; what is missing is 0."""
    return F.array(*[F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)) for n in names])


def gather_points(points: Column, indices: Sequence[int]) -> Column:
    """Points (array of [x, y, z]) at 0-based indices; x and y clipped to 0..1; -1 where there is none."""
    none = F.array(F.lit(-1.0), F.lit(-1.0), F.lit(-1.0))
    clip = lambda p: F.array(unit_clip(F.get(p, F.lit(0))), unit_clip(F.get(p, F.lit(1))), F.get(p, F.lit(2)))
    return F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.when(F.get(points, i).isNull(), none).otherwise(clip(F.get(points, i))))
