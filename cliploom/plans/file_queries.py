"""Queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.numeric import sigmoid
from cliploom.operators import manifest
from cliploom.plans import surrogates as S
from cliploom.plans.manifest_queries import FILES_SQL, MANIFEST_SQL
from cliploom.sources import tables
from cliploom.sources.shared import fresh_folder


def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows of a manifest that was written as CSV."""
    rows = S.files(spark, sf_dir).select("path", "label", "class_name", "source_id", "identity_id")
    path = fresh_folder(spark, "manifest")
    tables.write_manifest(manifest.split_by_class(rows), path)
    return tables.read_manifest(spark, path, "test")


def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.predictions(spark, sf_dir).withColumn("probability", sigmoid(F.col("logit")))
    rows = rows.withColumn("prediction", (F.col("probability") >= 0.5).cast("int")).withColumn("seen_in_train", F.col("doc_id") % 3 == 0)
    path = fresh_folder(spark, "predictions")
    tables.write_predictions(rows, path)
    schema = "path string, class_name string, label int, prediction int, probability double, split string, seen_in_train int"
    return spark.read.schema(schema).option("header", True).csv(path)


def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for epochs."""
    ev = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("int").alias("epoch"))
    path = fresh_folder(spark, "metrics")
    tables.write_metrics(ev.agg((F.max("value") / 7).alias("train_loss"), (F.min("value") / 7).alias("train_accuracy")), path)
    return tables.read_metrics(spark, path)


def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features kept under the fingerprint of their files, as they come back."""
    files = S.files(spark, sf_dir).select("path", "label", F.col("doc_id").alias("size"), F.col("doc_id").alias("modified_ns"))
    mark = tables.fingerprint(files, {"clip": S.CLIP}, ["rgb"]).first()[0]
    path = fresh_folder(spark, "features")
    tables.write_features(S.clips(spark, sf_dir), path, mark)
    return tables.read_features(spark, path, mark).select("clip_id", "t", F.posexplode("embedding").alias("d", "x")).select("clip_id", "t", "d", F.col("x").cast("double").alias("v"))


QUERIES = {f.__name__: f for f in (manifest_csv, predictions_csv, metrics_csv, feature_cache)}

_LOGIT = "(doc_id % 17 - 8) / 4.0e0"
ORACLES = {
    "manifest_csv": f"WITH {MANIFEST_SQL} SELECT * FROM manifest WHERE split = 'test'",
    "predictions_csv": f"WITH {FILES_SQL}, p AS (SELECT *, 1 / (1 + exp(-({_LOGIT}))) AS probability FROM files) SELECT path, class_name, label, (probability >= 0.5)::INT AS prediction, printf('%.8f', probability)::DOUBLE AS probability, CASE WHEN doc_id % 5 = 0 THEN 'train' ELSE 'test' END AS split, (doc_id % 3 = 0)::INT AS seen_in_train FROM p",
    "metrics_csv": "SELECT user_id::INT AS epoch, printf('%.8f', max(value) / 7)::DOUBLE AS train_loss, printf('%.8f', min(value) / 7)::DOUBLE AS train_accuracy FROM events GROUP BY 1",
    "feature_cache": f"SELECT vec_id // {S.CLIP} AS clip_id, (vec_id % {S.CLIP})::INT AS t, (i - 1)::INT AS d, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
}
