"""Scalar expressions of models and reports."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Mean and deviation of the red, green and blue channel.
IMAGENET = ((0.485, 0.229), (0.456, 0.224), (0.406, 0.225))
CLIP = ((0.45, 0.225),) * 3


def normalized(value: Column, channel: Column, table=IMAGENET) -> Column:
    """(value / 255 - mean) / deviation of the channel 0, 1 or 2; null for another."""
    out = F.lit(None).cast("double")
    for c, (mean, deviation) in enumerate(table):
        out = F.when(channel == c, (value / 255.0 - mean) / deviation).otherwise(out)
    return out


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def chrominance(r: Column, b: Column) -> Column:
    return r - b


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + erf(x / 1.4142135623730951))


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def softmax(z: Column, *keys: str) -> Column:
    """Over the rows that share ``keys``; shifted by their maximum."""
    w = Window.partitionBy(*keys)
    e = F.exp(z - F.max(z).over(w))
    return e / F.sum(e).over(w)


def miss_rate_percent(misses: Column, count: Column) -> Column:
    """Null for a null or zero count or null misses."""
    return F.try_divide(misses.cast("double"), count) * 100.0


def miss_line(name: str, misses: Column, count: Column) -> Column:
    """One line; an unknown number is None, not nought."""
    rate = miss_rate_percent(misses, count)
    said = [F.coalesce(c.cast("string"), F.lit("None")) for c in (misses, count)]
    head = F.concat(F.lit(f"{name}="), said[0], F.lit(" of "), said[1], F.lit(" "))
    return F.concat(head, F.when(rate.isNull(), "(n/a)").otherwise(F.format_string("(%.2f%%)", rate)))


def weight(i: Column, j: Column, phase: float = 0.0) -> Column:
    """A closed-form parameter table, the same in every engine: no trained weights are shipped."""
    return 0.02 * F.sin(12.9898 * i + 78.233 * j + phase)
