"""The fixed-layout token bank, its mask and its embeddings; fusion over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.numeric import weight

from . import attention
from .subsets import modality_table, offsets


def layout(spark, slots: str = "slots") -> DataFrame:
    """pos, modality, modality_id, slot: one row per place, enabled or not. time_id is the slot's ordinal."""
    rows = offsets(modality_table(spark), slots)
    places = rows.select("name", "modality_id", "offset", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return places.select((F.col("offset") + F.col("slot")).alias("pos"), F.col("name").alias("modality"), "modality_id", "slot", F.col("slot").alias("time_id"))


def token_bank(clips: DataFrame, tokens: DataFrame, dim: int, slots: str = "slots") -> DataFrame:
    """clip_id, pos, modality, modality_id, slot, time_id, mask, token: every place of every clip.

    Places without a token are zeros with a false mask. ``tokens`` has clip_id,
    modality, slot, token. The layout is a table of fixed size.
    """
    every = clips.select("clip_id").distinct().crossJoin(F.broadcast(layout(clips.sparkSession, slots)))
    found = every.join(tokens.select("clip_id", "modality", "slot", "token"), ["clip_id", "modality", "slot"], "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return found.select("clip_id", "pos", "modality", "modality_id", "slot", "time_id", F.col("token").isNotNull().alias("mask"), F.coalesce("token", zeros).alias("token"))


def validate_tokens(tokens: DataFrame, dim: int) -> DataFrame:
    """clip_id, modality, problem: wrong widths, repeated or missing slots, unknown modalities."""
    known = offsets(modality_table(tokens.sparkSession)).select(F.col("name").alias("modality"), F.col("slots").alias("expected"))
    seen = tokens.groupBy("clip_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("k"), F.max(F.size("token") != dim).alias("wide"))
    joined = seen.join(F.broadcast(known), "modality", "left")
    problem = F.when(F.col("expected").isNull(), "unknown modality").when(F.col("wide"), "wrong width").when(F.col("n") != F.col("k"), "repeated slot").when(F.col("k") != F.col("expected"), "wrong number of slots")
    return joined.select("clip_id", "modality", problem.alias("problem")).where("problem IS NOT NULL")


def embedded(bank: DataFrame) -> DataFrame:
    """Adds to each token the embeddings of its time and modality, from closed-form tables."""
    token = F.transform("token", lambda v, d: v + weight(F.col("time_id"), d, 2.0) + weight(F.col("modality_id"), d, 3.0))
    return bank.withColumn("token", token)


def fuse(bank: DataFrame, heads: int = 4, layers: int = 1) -> DataFrame:
    """clip_id, d, v: the class token of a transformer over each clip's unmasked places; see :func:`cliploom.operators.attention.fuse`."""
    tokens = bank.where("mask").select("clip_id", F.col("pos").alias("t"), F.lit(0).alias("element"), F.col("token").alias("features"))
    return attention.fuse(tokens, heads, layers).drop("slot")


def required_features(available: DataFrame, required: dict[str, Sequence[str]]) -> DataFrame:
    """clip_id, modality, ready: whether all of a modality's feature keys are there, from (clip_id, key)."""
    spark = available.sparkSession
    need = spark.createDataFrame([(m, k) for m, keys in required.items() for k in keys], "modality string, key string")
    every = available.select("clip_id").distinct().crossJoin(F.broadcast(need))
    have = available.select("clip_id", "key").distinct().withColumn("_there", F.lit(True))
    return every.join(have, ["clip_id", "key"], "left").groupBy("clip_id", "modality").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("ready"))


def used_places(tokens: DataFrame) -> DataFrame:
    """clip_id, modality, offset, slots, tokens: where each modality of a clip stands in the bank and how many tokens it has there."""
    places = offsets(modality_table(tokens.sparkSession)).select(F.col("name").alias("modality"), "offset", "slots")
    return tokens.groupBy("clip_id", "modality").agg(F.count(F.lit(1)).alias("tokens")).join(F.broadcast(places), "modality").select("clip_id", "modality", "offset", "slots", "tokens")


def totals(tokens: DataFrame) -> DataFrame:
    """clip_id, slots, enabled: places of the whole bank, and of the modalities that the clip has."""
    table = modality_table(tokens.sparkSession).where("slots IS NOT NULL")
    whole = F.broadcast(table.agg(F.sum("slots").alias("slots")))
    own = tokens.select("clip_id", "modality").distinct().join(F.broadcast(table.select(F.col("name").alias("modality"), F.col("slots").alias("own"))), "modality")
    return own.groupBy("clip_id").agg(F.sum("own").alias("enabled")).crossJoin(whole).select("clip_id", "slots", "enabled")
