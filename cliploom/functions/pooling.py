"""Norms, projections and position codes over long tables (clip_id, t, d, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numeric import gelu, weight

EPS = 1e-5


def position_code(t: Column, d: Column, dim: int) -> Column:
    """Sines at even places, cosines at odd ones."""
    even = d - d % 2
    angle = t * F.exp(-even * (math.log(10000.0) / dim))
    return F.when(d % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def position_table(spark: SparkSession, steps: int, dim: int) -> DataFrame:
    t = spark.range(steps).select(F.col("id").cast("int").alias("t"))
    d = spark.range(dim).select(F.col("id").cast("int").alias("d"))
    return t.crossJoin(d).select("t", "d", position_code(F.col("t"), F.col("d"), dim).alias("code"))


def layer_norm(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``value`` normalised over the rows that share ``keys``, by population variance."""
    w = Window.partitionBy(*keys)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + EPS))


def linear(df: DataFrame, width: int, keys: list[str], phase: float = 0.0) -> DataFrame:
    """keys, d, v: the rows' vectors times a closed-form matrix. The input places multiply out, then sum with map-side totals."""
    wide = df.select(*keys, F.col("d").alias("i"), "v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("d"))
    return wide.groupBy(*keys, "d").agg(F.sum(F.col("v") * weight(F.col("i"), F.col("d"), phase)).alias("v"))


def mlp(df: DataFrame, hidden: int, width: int, keys: list[str]) -> DataFrame:
    """Linear, GELU, linear."""
    return linear(linear(df, hidden, keys).withColumn("v", gelu(F.col("v"))), width, keys, 1.0)


def _mean_rows(rows: Column, dim: Column) -> Column:
    """Mean of an array of vectors, place by place."""
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), dim), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(rows))


def spatial_mean(hidden: Column, rank: int, dim: int | None = None, drop_class: bool = False) -> Column:
    """The mean feature vector of one item's hidden state, whatever its layout.

    Rank 2 is tokens (places, dim), without the first if ``drop_class``. Rank 3 is a map:
    channels first if its first axis is ``dim`` or that is None, else channels last if
    its last axis is; others raise, and so do tokens of another width.
    """
    width = lambda v, n: F.when(F.size(v) == n, v).otherwise(F.raise_error(F.concat(F.lit(f"features must have {n} numbers, not "), F.size(v).cast("string"))).cast("array<double>"))
    if rank == 2:
        rows = F.slice(hidden, 2, F.greatest(F.size(hidden) - 1, F.lit(0))) if drop_class else hidden
        mean = _mean_rows(rows, F.size(hidden[0]))
        return mean if dim is None else width(mean, dim)
    if rank != 3:
        raise ValueError(f"hidden states have rank 2 or 3, not {rank}")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    first = F.transform(hidden, lambda plane: total(F.transform(plane, lambda row: total(row))) / (F.size(plane) * F.size(plane[0])))
    if dim is None:
        return first
    last = _mean_rows(F.flatten(hidden), F.size(hidden[0][0]))
    wrong = F.raise_error(F.concat(F.lit(f"no axis of a hidden map has {dim} channels: "), F.concat_ws("x", F.size(hidden).cast("string"), F.size(hidden[0]).cast("string"), F.size(hidden[0][0]).cast("string")))).cast("array<double>")
    return F.when(F.size(hidden) == dim, first).when(F.size(hidden[0][0]) == dim, last).otherwise(wrong)
