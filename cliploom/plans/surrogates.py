"""Stand-ins for video tables, made from the general test tables.

Documents stand for files, events for the frames of a user's clip, event types
for modalities, embeddings in a row for feature sequences, line items for pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.functions import paths

#: Embeddings of a clip.
CLIP = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, label, class_name, source_id, identity_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    label = F.coalesce("toxic", F.lit(0)).cast("int")
    rows = docs.join(labels, "doc_id", "left").withColumn("label", label)
    path = F.concat(F.lit("/clips/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".MP4").when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".mp4"))
    return rows.select("doc_id", path.alias("path"), "label", paths.class_name(F.col("label")).alias("class_name"), F.col("source").alias("source_id"), F.when(F.col("label") == 1, F.col("lang")).alias("identity_id"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, modality, frame_idx, value: a user's events of one type in order. Clips are users x types."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("modality"), (F.row_number().over(order) - 1).cast("int").alias("frame_idx"), "value")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, class_name, label, logit, split."""
    split = F.when(F.col("doc_id") % 5 == 0, "train").otherwise("test")
    logit = (F.col("doc_id") % 17 - 8) / 4.0
    rows = files(spark, sf_dir).withColumn("split", split).withColumn("logit", logit.cast("double"))
    return rows.select("doc_id", "path", "class_name", "label", "logit", "split")


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, modality, elapsed_seconds, load_seconds, extract_seconds."""
    ev = table(spark, sf_dir, "events")
    load = F.when(F.col("event_id") % 3 != 0, F.col("value") / 4000.0)
    return ev.select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("modality"), (F.col("value") / 1000.0).alias("elapsed_seconds"), load.alias("load_seconds"), (F.col("value") / 2000.0).alias("extract_seconds"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, t, embedding: CLIP embeddings in a row, by vec_id, make a clip; the last may be shorter."""
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(k / CLIP).cast("long").alias("clip_id"), (k % CLIP).cast("int").alias("t"), "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, t, element, features: the clips' vectors, whole, one to a frame."""
    return clips(spark, sf_dir).select("clip_id", "t", F.lit(0).alias("element"), F.col("embedding").alias("features"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, t, d, v: the clips' vectors, all components, in long form."""
    rows = clips(spark, sf_dir).select("clip_id", "t", F.posexplode("embedding").alias("d", "x"))
    return rows.select("clip_id", "t", "d", F.col("x").cast("double").alias("v"))


def pixels(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """frame_id, y, x, r, g, b of 0..255: parts laid out in frames of size x size; those at the ends may lack pixels."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    n = size * size
    return p.select(F.floor(F.col("k") / n).cast("long").alias("frame_id"), F.floor(F.col("k") % n / size).cast("int").alias("y"), (F.col("k") % size).cast("int").alias("x"), (F.col("p_size") * 5).cast("double").alias("r"), (F.floor("p_retailprice") % 256).cast("double").alias("g"), (F.floor(F.col("p_retailprice") * 7) % 256).cast("double").alias("b"))
