"""The modality dimension and its subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: All modalities in the order of their ids.
MODALITIES = ("rgb", "metadata", "depth", "face_mesh", "rppg", "eye_gaze", "fau", "fft", "stft", "text", "manipulation_mask")
#: Those of the token bank in the order of its layout, with slots by default and as configured.
LAYOUT = (("rgb", 8, 8), ("fau", 32, 32), ("rppg", 4, 16), ("eye_gaze", 4, 4), ("face_mesh", 16, 16), ("depth", 4, 4), ("fft", 4, 4), ("stft", 4, 4))


def modality_table(spark: SparkSession) -> DataFrame:
    """modality_id, name, ord, slots, configured_slots; those without a branch have null from ord on."""
    place = {name: (i, a, b) for i, (name, a, b) in enumerate(LAYOUT)}
    rows = [(i, name, *place.get(name, (None, None, None))) for i, name in enumerate(MODALITIES)]
    return spark.createDataFrame(rows, "modality_id int, name string, ord int, slots int, configured_slots int")


def pending(table: DataFrame) -> DataFrame:
    return table.where("ord IS NULL").select("modality_id", "name")


def offsets(table: DataFrame, slots: str = "slots") -> DataFrame:
    """name, modality_id, ord, offset, slots: the layout's cumulative places, from the table of modalities, which is of fixed size."""
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return table.where("ord IS NOT NULL").select("name", "modality_id", "ord", F.coalesce(F.sum(slots).over(before), F.lit(0)).cast("int").alias("offset"), F.col(slots).alias("slots"))


def modality_sets(spark: SparkSession, names: Sequence[str], mode: str = "all") -> DataFrame:
    """set_id, name, size: the sets to run, ordered by size and then place.

    none: all in one; singletons; singletons_plus_all; all: every non-empty subset.
    """
    n = len(names)
    whole = (1 << n) - 1
    masks = spark.range(1, whole + 1).withColumnRenamed("id", "mask")
    size = F.bit_count("mask")
    keep = {"none": F.col("mask") == whole, "singletons": size == 1, "singletons_plus_all": (size == 1) | (F.col("mask") == whole), "all": F.lit(True)}
    if mode not in keep:
        raise ValueError(f"unknown mode {mode!r}")
    members = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    listed = masks.where(keep[mode]).select("mask", size.alias("size"), members.alias("places"))
    name = F.array_join(F.transform("places", lambda i: F.get(F.array(*[F.lit(x) for x in names]), i)), "__")
    order = Window.orderBy("size", "places")
    return listed.select(F.row_number().over(order).alias("set_id"), name.alias("name"), F.col("size").cast("int"))


def key_difference(expected: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """(key, side): missing from ``found``, or unexpected there. Repeated keys count once, a null is a key like others, other columns play no part."""
    missing = expected.select(key).subtract(found.select(key)).withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(key).subtract(expected.select(key)).withColumn("side", F.lit("unexpected")))


def ready_clips(sets: DataFrame, have: DataFrame) -> DataFrame:
    """``sets`` (set_id, name, size) with clips: how many have every modality of the set, from (clip_id, modality).

    Sets are a table of bounded size; a clip meets those that hold one of its modalities.
    """
    members = sets.select("set_id", "size", F.explode(F.split("name", "__")).alias("modality"))
    met = have.distinct().join(F.broadcast(members), "modality").groupBy("set_id", "size", "clip_id").count().where("count = size")
    counts = met.groupBy("set_id").agg(F.count(F.lit(1)).alias("clips"))
    return sets.join(counts, "set_id", "left").withColumn("clips", F.coalesce("clips", F.lit(0)))


def lacking(have: DataFrame, names: Sequence[str]) -> DataFrame:
    """(clip_id, modality): the modalities of ``names`` that a clip lacks, from (clip_id, modality). A clip without any isn't known."""
    wanted = have.groupBy("clip_id").agg(F.collect_set("modality").alias("own"))
    return wanted.select("clip_id", F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), "own")).alias("modality"))
