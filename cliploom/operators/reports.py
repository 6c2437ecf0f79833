"""Prediction, timing and training reports.

Repeated rows count each time, columns that aren't named are left alone or out, and an
empty table gives no rows unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions import numeric, paths


def seen_summary(predictions: DataFrame, split: str = "test") -> DataFrame:
    """seen_in_train, count, misses, accuracy, miss_percent of one split. A null label or prediction is no miss; null flags are a group of their own."""
    out = predictions.where(F.col("split") == split).groupBy("seen_in_train").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("prediction") != F.col("label")).alias("misses"))
    accuracy = F.try_divide((F.col("count") - F.col("misses")).cast("double"), F.col("count"))
    return out.select("*", accuracy.alias("accuracy"), numeric.miss_rate_percent(F.col("misses"), F.col("count")).alias("miss_percent"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Per modality, and in all (``grand_total``, under the name total): count, sums, mean and maximum of the seconds. Missing load and extraction seconds count as 0."""
    out = timings.rollup("modality").agg(
        F.grouping("modality").alias("_all"),
        F.count(F.lit(1)).alias("count"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
        F.sum(F.coalesce("load_seconds", F.lit(0.0))).alias("load_seconds"),
        F.sum(F.coalesce("extract_seconds", F.lit(0.0))).alias("extract_seconds"),
        F.avg("elapsed_seconds").alias("mean_seconds"),
        F.max("elapsed_seconds").alias("max_seconds"),
    )
    return out.withColumn("modality", F.when(F.col("_all") == 1, "total").otherwise(F.col("modality"))).withColumn("grand_total", F.col("_all") == 1).drop("_all")


def allocate_load(timings: DataFrame, loads: DataFrame) -> DataFrame:
    """load_seconds of (clip_id, modality): its own entry in ``loads``, else the clip's ``default``, else 0."""
    own = loads.withColumnRenamed("seconds", "_own")
    default = loads.where("modality = 'default'").select("clip_id", F.col("seconds").alias("_default"))
    joined = timings.join(own, ["clip_id", "modality"], "left").join(default, "clip_id", "left")
    return joined.withColumn("load_seconds", F.coalesce("_own", "_default", F.lit(0.0))).drop("_own", "_default")


def batch_shares(rows: DataFrame, elapsed: str = "batch_elapsed_seconds") -> DataFrame:
    """Each row of a batch bears an equal part of the batch's seconds; rows without a batch are one batch. Null seconds stay null."""
    return rows.withColumn("batch_size", F.count(F.lit(1)).over(Window.partitionBy("batch_id"))).withColumn("elapsed_seconds", F.col(elapsed) / F.col("batch_size"))


def epoch_means(batches: DataFrame) -> DataFrame:
    """Loss and accuracy per epoch, weighted by batch size. A batch with a null value counts in the weights alone, and batches of size 0 alone give an error."""
    n = F.sum("batch_size")
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("batch_size")) / n).alias("train_loss"), (F.sum(F.col("accuracy") * F.col("batch_size")) / n).alias("train_accuracy"))


def running_best(metrics: DataFrame, value: str = "train_accuracy") -> DataFrame:
    """``is_best``: above every earlier epoch's value. The first value is, a null never. Epochs are few; facts never come here."""
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return metrics.withColumn("is_best", F.coalesce(F.col(value) > F.max(value).over(before), F.col(value).isNotNull()))


def next_run_index(names: DataFrame) -> DataFrame:
    return names.agg((F.coalesce(F.max(paths.run_index(F.col("name"))), F.lit(0)) + 1).cast("int").alias("next_index"))


def logged_epochs(metrics: DataFrame, epochs: int) -> DataFrame:
    return metrics.where((F.col("epoch") % 10 == 0) | (F.col("epoch") == epochs))


def batch_ids(rows: DataFrame, batch_size: int, group: str, order: list[str]) -> DataFrame:
    """Consecutive batches of each group's rows, the last one shorter; rows that tie in ``order`` go in no fixed order, nulls come first."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / batch_size).cast("int"))


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: count, accuracy and mean binary cross entropy of logit against label; 0.5 counts as positive. Rows with a null logit or label count in ``count`` alone; of an empty table the means are null."""
    hit = ((numeric.sigmoid(F.col("logit")) >= 0.5).cast("int") == F.col("label")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("count"), F.avg(hit).alias("accuracy"), F.avg(numeric.bce_with_logits(F.col("logit"), F.col("label"))).alias("bce"))
