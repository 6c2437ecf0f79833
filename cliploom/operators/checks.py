"""Constraints on clips, detections and fusion inputs, as tables of what breaks them; :mod:`guards` raises instead. Empty tables break nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_detections(frames: DataFrame, detections: DataFrame, width: int, fill: float) -> DataFrame:
    """clip_id, frame_idx, vector: the detection of frames that have exactly one; others, and those whose one vector is null, are filled. Repeated frames stay repeated; null keys match nothing."""
    one = detections.groupBy("clip_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")).where("n = 1").drop("n")
    none = F.array_repeat(F.lit(float(fill)), width)
    return frames.select("clip_id", "frame_idx").join(one, ["clip_id", "frame_idx"], "left").withColumn("vector", F.coalesce("vector", none))


def unequal_batches(clips: DataFrame) -> DataFrame:
    """Batches whose clips differ in length, from (batch_id, n_frames); unknown lengths don't differ."""
    return clips.groupBy("batch_id").agg(F.min("n_frames").alias("shortest"), F.max("n_frames").alias("longest")).where("shortest <> longest")


def fusion_input_problems(bank: DataFrame, dim: int, max_time_steps: int, num_modalities: int) -> DataFrame:
    """clip_id and the number of places of each kind that fusion can't take; clips without any are left out."""
    bad = {"width": F.size("token") != dim, "time": ~F.col("time_id").between(0, max_time_steps - 1), "modality": ~F.col("modality_id").between(0, num_modalities - 1)}
    counts = bank.groupBy("clip_id").agg(*[F.count_if(c).alias(f"bad_{k}") for k, c in bad.items()])
    return counts.where(" OR ".join(f"bad_{k} > 0" for k in bad))


def missing_names(expected: DataFrame, registered: DataFrame) -> DataFrame:
    return expected.select("name").join(registered.select("name"), "name", "left_anti")
