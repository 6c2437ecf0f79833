"""Experiments: the chain trained and judged for each of several sets of modalities, over one table of features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.sources import tables
from cliploom.sources.shared import children, claim, written

from . import chain, clips, heads, manifest, parameters, reports, subsets, training

KEYS = ("path", "class_name", "label", "split")


@dataclass
class Result:
    """What one set of modalities gave: where its files are, and its report as one row."""

    name: str
    folder: str
    report: DataFrame


def next_folder(spark: SparkSession, root: str) -> str:
    """A new ``run_001``, ``run_002``, ... below ``root``: one more than the highest there; two runs that ask at once get different ones."""
    while True:
        names = spark.createDataFrame([(n,) for n in children(spark, root)], "name string")
        folder = f"{root}/run_{reports.next_run_index(names).first()[0]:03d}"
        if claim(spark, folder):
            return folder


def predictions(packed: DataFrame, spec: chain.Chain, params: DataFrame, train: DataFrame) -> DataFrame:
    """path, class_name, label, probability, prediction, split, seen_in_train of packed clips; ``train`` has class_name and path of those learned from."""
    values, _ = parameters.load(params, spec.shapes())
    scored = heads.predict(chain.logits(packed, spec, values, KEYS))
    return manifest.seen_in(scored.select(*KEYS, "probability", "prediction"), train.select("class_name", "path"))


def report(rows: DataFrame, overlaps: int, **settings) -> DataFrame:
    """One row: counts, misses and accuracies of the predictions, those of clips seen in training apart from the others; null where there are none."""
    hit, test = F.col("prediction") == F.col("label"), F.col("split") == "test"
    out = []
    for name, kept in (("train", ~test), ("predict", test), ("predict_seen", test & F.col("seen_in_train")), ("predict_unseen", test & ~F.col("seen_in_train"))):
        n = F.count_if(kept)
        out += [n.alias(f"{name}_count"), F.count_if(kept & ~hit).alias(f"{name}_misses"), F.try_divide(F.count_if(kept & hit).cast("double"), n).alias(f"{name}_accuracy")]
    return rows.agg(*out).select("*", F.lit(overlaps).cast("long").alias("overlap_count"), *[F.lit(v).alias(k) for k, v in settings.items()])


def run(features: DataFrame, spec: chain.Chain, root: str, epochs: int, mode: str = "none", batches_per_epoch: int = 1, rate: float = 1e-3, seed: int = 0, sets: Sequence[Sequence[str]] | None = None) -> list[Result]:
    """Train and judge ``spec`` for each set of its modalities (by ``mode``, or as given), and write what came out.

    ``features``: path, class_name, label, split, modality, t, element, features; the
    split ``test`` is judged, all others train. Features of the chain's modalities are
    packed by clip once, for all sets, as one written table; of a clip's tokens only those
    of a set's own modalities go to its Python workers. Each set starts from the same
    parameters as far as it has them. Its folder holds metrics, predictions, the
    parameters of the best epoch and a summary; with one set, that is the run's folder.
    """
    spark = features.sparkSession
    names = [m.name for m in spec.modalities]
    packed = written(clips.packed(features, KEYS, names), "packed")
    train = packed.where("split <> 'test'")
    both = manifest.overlaps(train, packed.where("split = 'test'")).count()
    chosen = [list(s) for s in sets] if sets is not None else [r["name"].split("__") for r in subsets.modality_sets(spark, names, mode).orderBy("set_id").collect()]
    folder, out = next_folder(spark, root), []
    for members in chosen:
        if unknown := set(members) - set(names):
            raise ValueError(f"not among the chain's modalities: {', '.join(sorted(unknown))}")
        name = "__".join(members)
        own = replace(spec, modalities=tuple(m for m in spec.modalities if m.name in members))
        place = folder if len(chosen) == 1 else f"{folder}/modality_permutations/{name}"
        fresh, read = parameters.initial(spark, own.shapes(), seed), clips.only(packed, members)
        taught = training.train_chain(read.where("split <> 'test'").select(F.xxhash64(*KEYS).alias("clip"), "tokens", "label"), own, fresh, epochs, batches_per_epoch, rate, seed=seed)
        metrics = spark.createDataFrame(taught.metrics, "epoch int, train_loss double, train_accuracy double")
        parameters.write(taught.best, f"{place}/best")
        tables.write_metrics(metrics, f"{place}/metrics")
        rows = written(predictions(read, own, parameters.read(spark, f"{place}/best"), train), "predictions")
        tables.write_predictions(rows, f"{place}/predictions")
        row = report(rows, both, epochs=epochs, lr=rate, modality_set=name, output_dir=place, final_train_loss=taught.metrics[-1][1])
        tables.write_summary(row, f"{place}/summary")
        out.append(Result(name, place, row))
    return out

