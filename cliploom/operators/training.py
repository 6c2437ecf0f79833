"""Training the chain or its head alone, and the runs over modality subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.layers import cross_entropy
from cliploom.sources.shared import delete, fresh_folder

from .chain import Chain
from .clips import batches, ragged
from .parameters import BLOCK, load


def train_head(features: DataFrame, epochs: int = 50) -> LogisticRegressionModel:
    """A linear head under binary cross entropy, from (feature array<double>, label). Only the head is trained."""
    rows = features.select(array_to_vector(F.col("feature").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=epochs, standardization=False).fit(rows)


def apply_head(features: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    rows = features.withColumn("features", array_to_vector(F.col("feature").cast("array<double>")))
    out = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int")).drop("features", "rawPrediction")


def subset_runs(sets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Accuracy of every modality set, from (set_id, name, size) and predictions of single modalities (clip_id, modality, label, logit).

    A set's logit is the mean of its members'. Sets are a small fixed table; they meet
    predictions by modality, so no clip is scored twice.
    """
    members = sets.select("set_id", "name", F.explode(F.split("name", "__")).alias("modality"))
    scored = predictions.join(F.broadcast(members), "modality").groupBy("set_id", "name", "clip_id").agg(F.avg("logit").alias("logit"), F.max("label").alias("label"))
    hit = ((F.col("logit") >= 0).cast("int") == F.col("label")).cast("double")
    return scored.groupBy("set_id", "name").agg(F.count(F.lit(1)).alias("clips"), F.avg(hit).alias("accuracy"))


@dataclass
class Training:
    """``metrics``: (epoch, train_loss, train_accuracy), measured before each step's update. ``last`` and ``best``: the parameters after the last epoch and after the first of the best accuracy."""

    metrics: list[tuple[int, float, float]]
    last: DataFrame
    best: DataFrame


def gradients(clips: DataFrame, chain: Chain, sent: Broadcast[Mapping[str, np.ndarray]]) -> DataFrame:
    """(part, name, block, gradient): each task's sums over its clips (tokens, label), by the parameters sent; the row without a name holds loss, hits and clips.

    Rows whose label is null teach nothing.
    """
    widths = chain.widths()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, g, stats = sent.value, {}, np.zeros(3)
        for b in batches(stream, chain.step()):
            label = np.asarray(b.column(1).to_numpy(zero_copy_only=False), float)
            logit, _, _, back = chain.forward(p, ragged(b.column(0), widths), b.num_rows)
            loss, slope = cross_entropy(logit, label)
            back(slope, g)
            del back  # it holds all of the call, which the next must not find there
            stats += [loss.sum(), ((logit >= 0) == (label > 0)).sum(), len(label)]
        rows = [("", 0, stats)] + [(n, k, flat[k * BLOCK : (k + 1) * BLOCK]) for n, flat in ((n, np.ravel(x)) for n, x in g.items()) for k in range(-(-flat.size // BLOCK))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))], ["name", "block", "gradient"])

    taught = clips.select("tokens", "label").where("label IS NOT NULL")
    return taught.mapInArrow(run, "name string, block int, gradient array<double>").withColumn("part", F.spark_partition_id())


def summed(grads: DataFrame, fan_in: int = 64) -> DataFrame:
    """(name, block, gradient) over all tasks, in the order of the tasks. Two rounds, so that no row gathers more than a root of them."""

    def total(df: DataFrame, *keys: str) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "gradient"))).alias("all"))
        add = F.aggregate(F.expr("slice(all, 2, size(all))"), F.col("all")[0]["gradient"], lambda a, x: F.zip_with(a, x["gradient"], lambda u, v: u + v))
        return listed.select(*keys, add.alias("gradient"))

    groups = grads.withColumn("part_group", F.floor(F.col("part") / fan_in))
    return total(total(groups, "name", "block", "part_group").withColumnRenamed("part_group", "part"), "name", "block")


def stepped(state: DataFrame, grads: DataFrame, clips: float, step: int, rate: float, decay: float) -> DataFrame:
    """One step of Adam with decoupled weight decay: the state (name, block, shape, values, mean, square) moved by summed gradients.

    Parameters without a gradient decay only, as if it were 0.
    """
    pair = lambda a, b, f: F.zip_with(F.col(a), F.col(b), f)
    df = state.join(grads, ["name", "block"], "left")
    df = df.withColumn("gradient", F.coalesce(F.transform("gradient", lambda x: x / clips), F.transform("values", lambda x: F.lit(0.0))))
    df = df.withColumn("mean", pair("mean", "gradient", lambda m, g: 0.9 * m + 0.1 * g)).withColumn("square", pair("square", "gradient", lambda v, g: 0.999 * v + 0.001 * g * g))
    df = df.withColumn("move", pair("mean", "square", lambda m, v: m / (1 - 0.9**step) / (F.sqrt(v / (1 - 0.999**step)) + 1e-8)))
    return df.select("name", "block", "shape", pair("values", "move", lambda x, d: x * (1 - rate * decay) - rate * d).alias("values"), "mean", "square")


def train_chain(clips: DataFrame, chain: Chain, params: DataFrame, epochs: int, batches_per_epoch: int = 1, rate: float = 1e-3, decay: float = 0.01, seed: int = 0) -> Training:
    """Branches, fusion and head trained together, from packed clips with ``label`` (0 or 1).

    Every step is a pass of the executors over one batch of clips; what they send is a
    gradient a task, added up block by block, and the parameters and both moments move
    on as tables, written at each step. So nothing hangs on earlier steps, and a lost
    executor repeats its share of one. Clips are dealt to batches by a hash, stored
    apart, so a step reads only its own; their order changes with epoch and seed.
    An empty table raises.
    """
    spark, shapes = clips.sparkSession, chain.shapes()
    folder = fresh_folder(spark, "training")
    dealt = F.pmod(F.xxhash64(*[c for c in clips.columns if c not in ("tokens", "label")]), F.lit(batches_per_epoch)).cast("int")
    table = clips.select("tokens", "label", dealt.alias("batch"))
    table.write.partitionBy("batch").parquet(f"{folder}/clips")
    stored = spark.read.schema(table.schema).parquet(f"{folder}/clips")
    zeros = F.transform("values", lambda x: F.lit(0.0))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    state = keep(params.select("name", "block", "shape", "values", zeros.alias("mean"), zeros.alias("square")), "state0")
    metrics, best, top, step, kept = [], state, -1.0, 0, "state0"
    for epoch in range(1, epochs + 1):
        order = sorted(range(batches_per_epoch), key=lambda k: hashlib.md5(f"{epoch}:{seed}:{k}".encode()).hexdigest())
        totals = np.zeros(3)
        for k in order:
            sent = spark.sparkContext.broadcast(load(state, shapes)[0])
            grads = keep(summed(gradients(stored.where(F.col("batch") == k), chain, sent)), f"gradient{epoch}-{k}")
            sent.destroy()
            stats = grads.where("name = ''").first()
            if stats is not None and stats["gradient"][2]:  # else the batch is empty
                step += 1
                totals += stats["gradient"]
                state = keep(stepped(state, grads, stats["gradient"][2], step, rate, decay), f"state{step}")
                if kept != f"state{step - 1}":
                    delete(spark, f"{folder}/state{step - 1}")
            delete(spark, f"{folder}/gradient{epoch}-{k}")
        if not totals[2]:
            raise ValueError("no labelled clips to learn from")
        metrics.append((epoch, float(totals[0] / totals[2]), float(totals[1] / totals[2])))
        if metrics[-1][2] > top:
            if kept != f"state{step}":
                delete(spark, f"{folder}/{kept}")
            top, best, kept = metrics[-1][2], state, f"state{step}"
    return Training(metrics, state, best)
