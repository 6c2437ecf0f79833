"""Files in and out: clips, manifests, reports and the feature cache."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import paths
from cliploom.operators import manifest
from cliploom.sources.shared import exists

MANIFEST_SCHEMA = "path string, label int, class_name string, source_id string, split string, identity_id string"


def discover(spark: SparkSession, real_dir: str, fake_dir: str) -> tuple[DataFrame, DataFrame]:
    """(real, fake) paths: ``*.mp4`` one level below real_dir and exactly two below fake_dir. Raises if a side is empty."""

    def scan(path: str, levels: int) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(path + "/*" * (levels - 1)).select("path")
        folder = path.rstrip("/").rsplit("/", 1)[-1]
        return found.where(F.substring_index(F.col("path"), "/", -levels - 1).startswith(f"{folder}/"))

    sides = scan(real_dir, 1), scan(fake_dir, 2)
    for side, where in zip(sides, (real_dir, fake_dir), strict=True):
        if side.isEmpty():
            raise FileNotFoundError(f"no .mp4 files under {where}")
    return sides


def labelled_folder(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Manifest rows of ``root/real`` and ``root/fake``: any video extension, any case, no subfolders; the stem is the source."""
    if split not in manifest.SPLITS:
        raise ValueError(f"unknown split {split!r}")
    out = None
    for label, name in ((0, "real"), (1, "fake")):
        files = spark.read.format("binaryFile").load(f"{root}/{name}").select("path").where(paths.is_video(F.col("path")))
        if files.isEmpty():
            raise FileNotFoundError(f"no videos under {root}/{name}")
        rows = files.select("path", F.lit(label).alias("label"), F.lit(name).alias("class_name"), paths.stem(F.col("path")).alias("source_id"), F.lit(split).alias("split"), F.lit(None).cast("string").alias("identity_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of a manifest CSV; an empty identity is null. The split filter goes to the scan."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)
    return rows if split is None else manifest.in_split(rows, split)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*manifest.COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """CSV with probabilities at eight places and seen_in_train as 0 or 1."""
    out = rows.select("path", "class_name", "label", "prediction", F.format_string("%.8f", "probability").alias("probability"), "split", F.col("seen_in_train").cast("int").alias("seen_in_train"))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    places = [F.format_string("%.8f", c).alias(c) for c in ("train_loss", "train_accuracy")]
    rows.select("epoch", *places).write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("epoch int, train_loss double, train_accuracy double").option("header", True).csv(path)


def write_timings(rows: DataFrame, path: str) -> None:
    """CSV with all seconds at six places."""
    out = [F.format_string("%.6f", c).alias(c) if c.endswith("_seconds") else F.col(c) for c in rows.columns]
    rows.select(*out).write.mode("overwrite").option("header", True).csv(path)


def read_timings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def summary_json(row: DataFrame, indent: bool = False) -> Column:
    """One JSON string per row, keys sorted and nulls kept; with ``indent``, two spaces and a newline behind."""
    options = {"ignoreNullFields": "false", "pretty": str(indent).lower()}
    text = F.to_json(F.struct(*sorted(row.columns)), options)
    return F.concat(F.regexp_replace(text, '" : ', '": '), F.lit("\n")) if indent else text


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row report as one indented JSON text file."""
    if (n := row.count()) != 1:
        raise ValueError(f"a summary has one row, not {n}")
    row.select(F.rtrim(summary_json(row, True), F.lit("\n"))).coalesce(1).write.mode("overwrite").text(path)


def file_record(version: int = 1) -> Column:
    """What a file adds to a fingerprint: version, path, size, time and label."""
    return F.to_json(F.struct(F.col("label").alias("label"), F.col("modified_ns").alias("mtime_ns"), F.col("path").alias("path"), F.col("size").alias("size"), F.lit(version).alias("version")))


def fingerprint(files: DataFrame, config: dict, modalities: list[str]) -> DataFrame:
    """(fingerprint): SHA-256 over the configuration, the ordered modalities and the set of file records.

    A tree of digests: those of the records, sorted within the bucket that their
    first digits name, give the bucket's, and the sorted buckets' give the result. So
    files may come in any order; one place lists the digests of one bucket at most.
    """
    head = json.dumps({"config": config, "modalities": modalities}, sort_keys=True, separators=(",", ":"))
    each = files.select(F.sha2(file_record(), 256).alias("d")).withColumn("b", F.substring("d", 1, 3))
    buckets = each.groupBy("b").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list("d"))), 256).alias("s")).select(F.concat_ws(":", "b", "s").alias("d"))
    return buckets.agg(F.sha2(F.concat_ws("|", F.lit(head), F.sort_array(F.collect_list("d"))), 256).alias("fingerprint"))


def write_features(items: DataFrame, path: str, mark: str) -> None:
    items.write.mode("overwrite").parquet(f"{path}/fingerprint={mark}")


def read_features(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The cached items of this fingerprint, or None."""
    place = f"{path}/fingerprint={mark}"
    return spark.read.parquet(place) if exists(spark, place) else None
