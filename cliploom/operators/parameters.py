"""The parameter store: learned weights as tables.

A parameter is kept in blocks: name, block, shape, values. Blocks keep rows small and
let gradients be added up block by block. A model travels to the tasks that apply it
as one broadcast of checked size.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import paths

SCHEMA = "name string, block int, shape array<int>, values array<double>"
#: Numbers of a block, and of a model that may be broadcast.
BLOCK, MOST = 4096, 1 << 23


def initial(spark: SparkSession, shapes: Mapping[str, Sequence[int]], seed: int = 0) -> DataFrame:
    """A fresh model. Weights are spread evenly around zero by the fraction of a sine, so every engine finds the same; by their number of inputs.

    Names that end in ``bias``, ``shift``, ``mean`` or ``cls`` start at 0, in ``norm.weight``, ``scale`` or ``var`` at 1.
    """
    rows = [(k, name, list(shape), int(np.prod(shape))) for k, (name, shape) in enumerate(sorted(shapes.items()))]
    table = spark.createDataFrame(rows, "phase int, name string, shape array<int>, size int")
    blocks = table.withColumn("block", F.explode(F.expr(f"sequence(0, cast((size - 1) div {BLOCK} as int))")))
    place = F.expr(f"sequence(block * {BLOCK}, least(size, (block + 1) * {BLOCK}) - 1)")
    reach = F.sqrt(F.lit(3.0) / F.when(F.size("shape") > 1, F.element_at("shape", 1)).otherwise(1))

    def value(i: Column) -> Column:
        x = F.sin(i * 12.9898 + F.col("phase") * 78.233 + float(seed) + 1.0) * 43758.5453
        return F.when(F.col("name").rlike("(bias|shift|mean|cls)$"), 0.0).when(F.col("name").rlike(r"(norm\d?\.weight|scale|var)$"), 1.0).otherwise((2 * (x - F.floor(x)) - 1) * reach)

    return blocks.select("name", "block", "shape", F.transform(place, value).alias("values"))


def from_arrays(spark: SparkSession, params: Mapping[str, np.ndarray]) -> DataFrame:
    rows = []
    for name, value in params.items():
        flat = np.ravel(value).astype(float)
        rows += [(name, k, list(np.shape(value)), flat[k * BLOCK : (k + 1) * BLOCK].tolist()) for k in range(-(-flat.size // BLOCK))]
    return spark.createDataFrame(rows, SCHEMA)


def write(params: DataFrame, path: str) -> None:
    params.select("name", "block", "shape", "values").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def differences(params: DataFrame, shapes: Mapping[str, Sequence[int]], prefixes: Iterable[str] = ()) -> DataFrame:
    """(name, problem): what the store lacks, has too much or in another shape, once prefixes are stripped."""
    spark = params.sparkSession
    want = spark.createDataFrame([(n, list(s)) for n, s in shapes.items()], "name string, want array<int>")
    have = stripped(params, prefixes).where("block = 0").select("name", F.col("shape").alias("have"))
    both = have.join(want, "name", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "shape")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def stripped(params: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    prefixes = list(prefixes)
    return params.withColumn("name", paths.strip_prefixes(F.col("name"), prefixes)) if prefixes else params


def load(params: DataFrame, shapes: Mapping[str, Sequence[int]], strict: bool = True, prefixes: Iterable[str] = (), most: int = MOST) -> tuple[dict[str, np.ndarray], list[tuple[str, str]]]:
    """The model's parameters as arrays, and (name, problem) of what doesn't fit.

    Strict loading raises if anything differs. Lenient loading leaves out what is
    unexpected and zeros what is missing; a wrong shape raises always. ``most`` bounds
    the numbers that come to the driver and go to every task.
    """
    found = sorted(tuple(r) for r in differences(params, shapes, prefixes).collect())
    bad = [f"{n} ({p})" for n, p in found if strict or p == "shape"]
    if bad:
        raise ValueError("parameters don't fit: " + ", ".join(bad[:20]))
    if (size := sum(int(np.prod(s)) for s in shapes.values())) > most:
        raise ValueError(f"a model of {size} numbers is more than the {most} that may be broadcast")
    wanted = params.sparkSession.createDataFrame([(n,) for n in shapes], "name string")
    rows = stripped(params, prefixes).join(F.broadcast(wanted), "name", "left_semi").orderBy("name", "block").collect()
    parts: dict[str, list] = {}
    for r in rows:
        parts.setdefault(r["name"], []).append(r["values"])
    return {n: np.concatenate(parts[n]).reshape(s) if n in parts else np.zeros(s) for n, s in shapes.items()}, found
