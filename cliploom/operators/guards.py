"""Constraints that raise inside the plan: they cost no scan of their own, and say which clip broke them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(df: DataFrame, checks: Mapping[str, Column], clip: str = "clip_id") -> DataFrame:
    """``df`` as it is; an action that meets a row for which a check isn't true raises, naming the check and the clip.

    The checks are a filter that keeps every row or raises, so they run where the rows
    are read anyway. A check that is null fails.
    """
    for what, ok in checks.items():
        told = F.concat(F.lit(f"{what}: clip "), F.coalesce(F.col(clip).cast("string"), F.lit("null")))
        df = df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    return df


def enough_frames(k: int, n: str = "n_frames") -> dict[str, Column]:
    return {f"fewer than {k} frames": F.col(n) >= k}


def frame_shapes() -> dict[str, Column]:
    """For decoded frames: height, width and channels as their data say."""
    return {"a frame must have three channels": F.col("channels") == 3, "a frame's data don't fit its size": F.octet_length("data") == F.col("height") * F.col("width") * F.col("channels")}


def bank_tokens(dim: int, max_time_steps: int, modalities: int) -> dict[str, Column]:
    """For places of the token bank."""
    return {
        f"a token must have {dim} numbers": F.size("token") == dim,
        f"time_id must be in 0..{max_time_steps - 1}": F.col("time_id").between(0, max_time_steps - 1),
        f"modality_id must be in 0..{modalities - 1}": F.col("modality_id").between(0, modalities - 1),
    }


def whole_banks(bank: DataFrame, places: int, clip: str = "clip_id") -> DataFrame:
    """``bank`` as one row a clip (clip, places); raises for a clip with another number of places."""
    return required(bank.groupBy(clip).agg(F.count(F.lit(1)).alias("places")), {f"a bank must have {places} places": F.col("places") == places}, clip)
