"""Labelled manifests: rows, group-wise splits and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions import paths
from cliploom.sources.shared import written

from . import ordering

SPLITS = ("train", "val", "test")
COLUMNS = ("path", "label", "class_name", "source_id", "split", "identity_id")


def group_split(rows: DataFrame, group: str, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """(within, group, split): whole groups go to one split, in the order of a seeded hash; each value of ``within`` is split by itself.

    One group trains, of two the second tests, and from three on each split has one
    at least. Groups are counted by the hash's first digits, so that only those
    counts, fixed in number, are added up in one place; the rank inside a bucket of
    hashes is found in parallel. Null groups and null values of ``within`` get no
    split; repeated rows count once.
    """
    if not (0 < train_ratio < 1 and 0 <= val_ratio < 1 and train_ratio + val_ratio < 1):
        raise ValueError("ratios must leave a share for each split")
    ids = rows.select(*within, F.col(group).alias("g")).where("g IS NOT NULL").dropna(subset=list(within) or None).distinct()
    ids = ids.withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), F.col("g"))))
    ids = ids.withColumn("bucket", F.substring("mark", 1, 3))
    order = Window.partitionBy(*within).orderBy("bucket")
    counts = ids.groupBy(*within, "bucket").agg(F.count(F.lit(1)).alias("k"))
    counts = counts.select(*within, "bucket", (F.sum("k").over(order) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy(*within)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*within, "bucket").orderBy("mark", "g")) - 1
    train, val = F.floor(F.col("n") * F.lit(train_ratio)).cast("int"), F.floor(F.col("n") * F.lit(val_ratio)).cast("int")
    ranked = ids.withColumn("place", place).join(counts, [*within, "bucket"]).select(*within, "g", (F.col("before") + F.col("place")).alias("i"), "n", train.alias("t0"), val.alias("v0"))
    many = F.col("n") >= 3
    t = F.when(many, F.least(F.greatest(F.col("t0"), F.lit(1)), F.col("n") - 2)).otherwise(F.lit(1))
    v = F.when(many, F.least(F.greatest(t + F.col("v0"), t + 1), F.col("n") - 1)).otherwise(F.lit(1))
    split = F.when(F.col("i") < t, "train").when(F.col("i") < v, "val").otherwise("test")
    return ranked.select(*within, F.col("g").alias(group), split.alias("split"))


def labelled_rows(files: DataFrame, label: int, path: str = "path", identity: Column | None = None) -> DataFrame:
    """Manifest rows without split from a table of paths; label 1 is fake."""
    p = F.col(path)
    source = paths.fake_source_id(p) if label else paths.real_source_id(p)
    who = (paths.parent_name(p) if identity is None else identity) if label else F.lit(None).cast("string")
    return files.select(p.alias("path"), F.lit(label).alias("label"), F.lit("fake" if label else "real").alias("class_name"), source.alias("source_id"), who.alias("identity_id"))


def with_splits(rows: DataFrame, splits: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The table of splits joins by group; its size decides how."""
    return rows.join(splits, [*within, "source_id"]).select(*COLUMNS)


def split_by_class(rows: DataFrame, **ratios) -> DataFrame:
    """The manifest of labelled rows: each class is split by itself, all in one pass."""
    return with_splits(rows, group_split(rows, "source_id", within=("class_name",), **ratios), ("class_name",))


def build_manifest(real: DataFrame, fake: DataFrame, **ratios) -> DataFrame:
    """Reals and fakes stand in one table and are split independently."""
    return split_by_class(real.unionByName(fake), **ratios)


def split_summary(manifest: DataFrame) -> DataFrame:
    """split, real, fake, total; splits without rows have zeros."""
    counts = manifest.groupBy("split").agg(F.count_if(F.col("class_name") == "real").alias("real"), F.count_if(F.col("class_name") == "fake").alias("fake"), F.count(F.lit(1)).alias("total"))
    every = manifest.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(counts, "split", "left").select("split", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("real", "fake", "total")])


def in_split(manifest: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return manifest.where(F.col("split") == split)


def label_keys(manifest: DataFrame) -> DataFrame:
    return manifest.select("class_name", paths.file_name(F.col("path")).alias("file_name")).distinct()


def overlaps(train: DataFrame, other: DataFrame) -> DataFrame:
    """Keys (class_name, file_name) in both."""
    return label_keys(train).intersect(label_keys(other))


def seen_in(rows: DataFrame, train: DataFrame) -> DataFrame:
    """``rows`` with seen_in_train: whether its key is among those of ``train``."""
    keys = label_keys(train).withColumn("_seen", F.lit(True))
    keyed = rows.withColumn("file_name", paths.file_name(F.col("path")))
    return keyed.join(keys, ["class_name", "file_name"], "left").withColumn("seen_in_train", F.coalesce("_seen", F.lit(False))).drop("_seen", "file_name")


def path_order(path: Column) -> Column:
    """Sorts as paths do, part by part: a folder's files stand before those of a folder whose name goes on from it."""
    return F.split(path, "/")


def numbered_manifest(rows: DataFrame) -> DataFrame:
    """``rows`` with number, from 0: reals before fakes, each by the parts of its path, repeated paths in no fixed order.

    Numbers come from ranges and their offsets, so no task orders all rows.
    """
    table = written(rows, "manifest").withColumn("_tie", F.monotonically_increasing_id())
    return ordering.numbered(table, ["label", path_order(F.col("path")), "_tie"], "number").drop("_tie")


def epoch_order(rows: DataFrame, epochs: int, seed: int, batch_size: int, key: str = "path") -> DataFrame:
    """(epoch, ``key``, place, batch): every epoch takes all rows in an order of its own, by a hash of epoch, seed and key, in batches of ``batch_size``; the last is shorter.

    The same seed gives the same orders. Keys should differ.
    """
    if epochs < 1 or batch_size < 1:
        raise ValueError("epochs and batch_size must be positive")
    each = rows.select(F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"), key)
    mixed = written(each.withColumn("mix", F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.lit(str(seed)), F.col(key).cast("string")))), "epochs")
    placed = ordering.numbered(mixed, ["epoch", "mix", key], "place")
    n = F.lit(rows.count())
    place = (F.col("place") - (F.col("epoch") - 1) * n).cast("long")
    return placed.select("epoch", key, place.alias("place"), F.floor(place / batch_size).cast("int").alias("batch"))


def first_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(item, path): of each item's candidates (item, ord, path) the first, by ord, that is among ``existing`` (path); null if none is."""
    there = candidates.join(existing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    return there.groupBy("item").agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("ord"))).alias("path"))


def routed(batch: DataFrame, overrides: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """(clip_id, modality, frames): what each modality reads, its own entry in ``overrides`` (clip_id, modality, frames) if there is one, else the clip's ``frames``."""
    every = batch.select("clip_id", "frames", F.explode(F.array(*[F.lit(m) for m in modalities])).alias("modality"))
    own = overrides.select("clip_id", "modality", F.col("frames").alias("own"))
    return every.join(own, ["clip_id", "modality"], "left").select("clip_id", "modality", F.coalesce("own", "frames").alias("frames"))
