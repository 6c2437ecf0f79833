"""python -m cliploom manifest|run|predict: manifests from clip folders, experiments from a configuration, predictions with stored parameters."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators import chain, clips, config, experiment, heads, manifest, parameters
from cliploom.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cliploom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("manifest", help="scan real and fake clips, split them by source and write a manifest")
    m.add_argument("real_dir")
    m.add_argument("fake_dir")
    m.add_argument("output")
    m.add_argument("--train-ratio", type=float, default=0.8)
    m.add_argument("--val-ratio", type=float, default=0.1)
    m.add_argument("--seed", type=int, default=0)
    r = sub.add_parser("run", help="train and judge the configured chain on a table of features")
    r.add_argument("config")
    r.add_argument("features", help="Parquet with path, class_name, label, split, modality, t, element, features")
    r.add_argument("output")
    r.add_argument("--epochs", type=int, default=50)
    r.add_argument("--batches", type=int, default=1, help="steps of an epoch")
    r.add_argument("--lr", type=float, default=1e-3)
    r.add_argument("--seed", type=int, default=0)
    r.add_argument("--modalities", nargs="*")
    r.add_argument("--permutations", choices=("none", "singletons", "singletons_plus_all", "all"), default="none")
    q = sub.add_parser("predict", help="score a table of features with stored parameters")
    q.add_argument("config")
    q.add_argument("features")
    q.add_argument("parameters")
    q.add_argument("output")
    q.add_argument("--modalities", nargs="*")
    return p


def widths(features: DataFrame) -> dict[str, int]:
    """Of each modality's features, from the table itself; a modality with several widths raises."""
    found = features.groupBy("modality").agg(F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).collect()
    if mixed := sorted(r["modality"] for r in found if r["least"] != r["most"]):
        raise ValueError(f"features of several widths: {', '.join(mixed)}")
    return {r["modality"]: r["least"] for r in found}


def _configured(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, chain.Chain]:
    features = spark.read.parquet(a.features)
    return features, config.chain_of(config.load_yaml(a.config, spark), widths(features), a.modalities)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("cliploom").getOrCreate()
    if a.command == "manifest":
        real, fake = tables.discover(spark, a.real_dir, a.fake_dir)
        rows = manifest.build_manifest(manifest.labelled_rows(real, 0), manifest.labelled_rows(fake, 1), train_ratio=a.train_ratio, val_ratio=a.val_ratio, seed=a.seed)
        tables.write_manifest(rows, a.output)
        for r in manifest.split_summary(tables.read_manifest(spark, a.output)).collect():
            print(f"{r['split']}: real={r['real']} fake={r['fake']} total={r['total']}")
    elif a.command == "run":
        features, spec = _configured(spark, a)
        for result in experiment.run(features, spec, a.output, a.epochs, a.permutations, a.batches, a.lr, a.seed):
            r = result.report.first()
            print(f"{result.name}: predict_accuracy={r['predict_accuracy']} misses={r['predict_misses']} of {r['predict_count']} in {result.folder}")
    else:
        features, spec = _configured(spark, a)
        values, _ = parameters.load(parameters.read(spark, a.parameters), spec.shapes())
        scored = heads.predict(chain.logits(clips.packed(features, experiment.KEYS), spec, values, experiment.KEYS))
        tables.write_predictions(scored.withColumn("seen_in_train", F.lit(False)), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
