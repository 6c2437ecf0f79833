"""Uniform frame sampling and shared decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_sample(frames: DataFrame, k: int, clip: str = "clip_id", index: str = "frame_idx") -> DataFrame:
    """clip, slot, frame: k frames spread evenly from the first to the last, halves to even. Clips of fewer frames have none.

    The slots are generated from each clip's count: the frames themselves are only
    counted, so payloads needn't be read to choose.
    """
    if k < 1:
        raise ValueError("k must be positive")
    counts = frames.groupBy(clip).agg(F.count(index).alias("n")).where(F.col("n") >= k)
    slots = counts.select(clip, "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    place = F.rint((F.col("n") - 1) * F.col("slot") / float(k - 1)) if k > 1 else F.lit(0)
    return slots.select(clip, F.col("slot").cast("int"), place.cast("int").alias("frame_idx"))


def too_short(frames: DataFrame, k: int, clip: str = "clip_id") -> DataFrame:
    """Clips with fewer than k frames and their counts."""
    return frames.groupBy(clip).agg(F.count(F.lit(1)).alias("n_frames")).where(F.col("n_frames") < k)


def decode_shares(wanted: DataFrame) -> DataFrame:
    """``wanted`` (clip_id, modality, frame_count, seconds): modalities of equal frame_count share one decode, so each bears an equal part of its seconds."""
    same = Window.partitionBy("clip_id", "frame_count")
    return wanted.withColumn("sharers", F.count(F.lit(1)).over(same)).withColumn("load_seconds", F.max("seconds").over(same) / F.col("sharers"))
