"""Spectral features: radially binned 2-D spectra, short-time Fourier transforms, grid means.

Long tables and joins do the small transforms, so the optimiser sees them; an
Arrow function per clip does 2-D spectra of realistic frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numeric import chrominance, luminance

TAU = 2 * math.pi


def hann(spark: SparkSession, n: int) -> DataFrame:
    """(j, hann): the periodic window."""
    return spark.range(n).select(F.col("id").cast("int").alias("j"), (0.5 - 0.5 * F.cos(F.lit(TAU) * F.col("id") / n)).alias("hann"))


def stft(signal: DataFrame, n_fft: int = 8, hop: int | None = None, clip: str = "clip_id", index: str = "t", value: str = "v") -> DataFrame:
    """clip, w, k, logmag: log(1 + |STFT|) of each clip's signal, centred, reflected at its ends.

    Clips shorter than ``n_fft`` have none. One shuffle, by clip: each row sees the few
    samples around it, and those at a window's centre turn them into its bins. The
    last window may be centred on the place behind the last sample.
    """
    if n_fft < 2 or hop is not None and hop < 1:
        raise ValueError("n_fft must exceed 1 and hop be positive")
    hop, half = hop or max(1, n_fft // 4), n_fft // 2
    order = Window.partitionBy(clip).orderBy(index)
    near = F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(order.rowsBetween(-half - 1, half))
    rows = signal.select(clip, (F.row_number().over(order) - 1).alias("t"), F.count(F.lit(1)).over(Window.partitionBy(clip)).cast("int").alias("n"), near.alias("near")).where(F.col("n") >= n_fft)
    centre = F.filter(F.array(F.col("t"), F.col("t") + 1), lambda c: (c % hop == 0) & ((c == F.col("t")) | ((F.col("t") == F.col("n") - 1) & (c == F.col("n")))))
    rows = rows.where((F.col("t") % hop == 0) | (F.col("t") == F.col("n") - 1)).select(clip, "n", "near", F.greatest(F.lit(0), F.col("t") - half - 1).alias("first"), F.explode(centre).alias("c"))

    def tap(j: int) -> Column:
        at = F.abs(F.col("c") + (j - half))
        at = F.when(at <= F.col("n") - 1, at).otherwise(2 * (F.col("n") - 1) - at)
        return F.get("near", at - F.col("first"))["v"]

    taps = rows.select(clip, (F.col("c") / hop).cast("int").alias("w"), *[tap(j).alias(f"x{j}") for j in range(n_fft)])
    hann = [0.5 - 0.5 * math.cos(TAU * j / n_fft) for j in range(n_fft)]

    def part(k: int, wave: Callable[[float], float]) -> Column:
        return sum((F.col(f"x{j}") * (hann[j] * wave(TAU * k / n_fft * j)) for j in range(n_fft)), F.lit(0.0))

    bins = F.array(*[F.struct(F.lit(k).alias("k"), F.log1p(F.hypot(part(k, math.cos), part(k, math.sin))).alias("logmag")) for k in range(half + 1)])
    return taps.select(clip, "w", F.explode(bins).alias("b")).select(clip, "w", "b.k", "b.logmag")


def radial_bins(spark: SparkSession, size: int, n_bins: int) -> DataFrame:
    """(y, x, bin) of a centred spectrum: equal widths of distance, closed on the right."""
    grid = spark.range(size).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(size).select(F.col("id").cast("int").alias("x")))
    c = size // 2
    far = math.hypot(max(c, size - 1 - c), max(c, size - 1 - c))
    width = (far + 1e-6) / n_bins
    r = F.sqrt((F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c))
    return grid.select("y", "x", F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.ceil(r / width) - 1)).cast("int").alias("bin"))


def radial_spectrum(pixels: DataFrame, size: int, n_bins: int) -> DataFrame:
    """frame_id, bin, value: mean log magnitude of the 2-D DFT by distance, from (frame_id, y, x, v).

    The transform is separable: along x for each row, then along y for each column.
    Every bin is present; empty ones are 0. Meant for small frames; see
    :func:`radial_spectrum_arrow` for large ones.
    """
    spark = pixels.sparkSession
    freq = F.sequence(F.lit(0), F.lit(size - 1))
    rows = pixels.select("frame_id", "y", "x", "v", F.explode(freq).alias("kx"))
    angle = F.lit(-TAU / size) * ((F.col("kx") * F.col("x")) % size)
    rows = rows.groupBy("frame_id", "y", "kx").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    both = rows.select("*", F.explode(freq).alias("ky"))
    angle = F.lit(-TAU / size) * ((F.col("ky") * F.col("y")) % size)
    re = F.sum(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))
    im = F.sum(F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle))
    full = both.groupBy("frame_id", "kx", "ky").agg(re.alias("re"), im.alias("im"))
    shifted = full.select("frame_id", ((F.col("ky") + size // 2) % size).alias("y"), ((F.col("kx") + size // 2) % size).alias("x"), F.log1p(F.hypot("re", "im")).alias("m"))
    means = shifted.join(F.broadcast(radial_bins(spark, size, n_bins)), ["y", "x"]).groupBy("frame_id", "bin").agg(F.avg("m").alias("value"))
    every = pixels.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return every.join(means, ["frame_id", "bin"], "left").select("frame_id", "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def radial_spectrum_arrow(frames: DataFrame, size: int, n_bins: int) -> DataFrame:
    """The same from (frame_id, pixels array<struct<y, x, v>>), by FFT in Arrow batches. Pixels that a frame lacks count as 0."""
    c = size // 2
    y, x = np.mgrid[:size, :size]
    r = np.hypot(y - c, x - c)
    bins = np.clip(np.ceil(r / ((r.max() + 1e-6) / n_bins)).astype(int) - 1, 0, n_bins - 1).ravel()
    count = np.maximum(np.bincount(bins, minlength=n_bins), 1)

    def laid(pixels: list) -> np.ndarray:
        out = np.zeros((size, size))
        for p in pixels:
            out[p["y"], p["x"]] = p["v"]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.bincount(bins, np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(laid(p))))).ravel(), n_bins) / count for p in pdf["pixels"]]
            yield pd.DataFrame({"frame_id": np.repeat(pdf["frame_id"].to_numpy(), n_bins), "bin": np.tile(np.arange(n_bins, dtype=np.int32), len(out)), "value": np.concatenate(out) if out else []})

    return frames.select("frame_id", "pixels").mapInPandas(run, f"frame_id {dict(frames.dtypes)['frame_id']}, bin int, value double")


def regional_signals(pixels: DataFrame, size: int, grid: int) -> DataFrame:
    """frame_id, cell, luma, chroma: means over a grid of cells, from (frame_id, y, x, r, g, b) scaled to 0..1. Rows and columns beyond whole cells are left out."""
    side = size // grid
    if side < 1:
        raise ValueError("grid doesn't fit the frame")
    inside = pixels.where((F.col("y") < side * grid) & (F.col("x") < side * grid))
    cell = (F.floor(F.col("y") / side) * grid + F.floor(F.col("x") / side)).cast("int")
    return inside.groupBy("frame_id", cell.alias("cell")).agg(F.avg(luminance(F.col("r"), F.col("g"), F.col("b"))).alias("luma"), F.avg(chrominance(F.col("r"), F.col("b"))).alias("chroma"))


def block_means(pixels: DataFrame, factor: int) -> DataFrame:
    """Frames shrunk by an integer factor: each new pixel is the mean of its block, from (frame_id, y, x, v)."""
    return pixels.groupBy("frame_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def _overlap(at: Column, source: int, target: int) -> Column:
    """array<struct<to, share>>: the target places that a source place reaches into, and the share of each that it fills."""
    ratio = source / target
    first = F.floor(at / F.lit(ratio)).cast("int")
    last = F.least(F.ceil((at + 1) / F.lit(ratio)).cast("int") - 1, F.lit(target - 1))
    filled = lambda t: (F.least((at + 1).cast("double"), (t + 1) * F.lit(ratio)) - F.greatest(at.cast("double"), t * F.lit(ratio))) / F.lit(ratio)
    return F.filter(F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("to"), filled(t).alias("share"))), lambda s: s["share"] > 1e-12)


def area_resize(pixels: DataFrame, source: int, target: int) -> DataFrame:
    """frame_id, y, x, v: frames of source x source pixels (frame_id, y, x, v) shrunk to target x target by area, for any two sizes.

    A pixel goes to the few target pixels that it overlaps, with the shares of its two
    axes multiplied, and those are summed with map-side totals: one shuffle. Pixels
    that a frame lacks count as 0.
    """
    if not 1 <= target <= source:
        raise ValueError("area resizing shrinks")
    rows = pixels.select("frame_id", "v", F.explode(_overlap(F.col("y"), source, target)).alias("row"), "x")
    cells = rows.select("frame_id", "v", "row", F.explode(_overlap(F.col("x"), source, target)).alias("column"))
    value = F.sum(F.col("v") * F.col("row.share") * F.col("column.share"))
    return cells.groupBy("frame_id", F.col("row.to").alias("y"), F.col("column.to").alias("x")).agg(value.alias("v"))


def spectral_features(pixels: DataFrame, source: int, target: int, n_bins: int) -> DataFrame:
    """frame_id, bin, value: the whole spectral extractor on (frame_id, y, x, r, g, b) of 0..255.

    Grey levels, rounded; shrunk by area, rounded; scaled to 0..1; two-dimensional FFT;
    log magnitudes; radial means. A frame's grey pixels come together once, as an array.
    """
    gray = pixels.select("frame_id", "y", "x", F.rint(luminance(F.col("r"), F.col("g"), F.col("b"))).alias("v"))
    small = gray if source == target else area_resize(gray, source, target).withColumn("v", F.rint(F.round("v", 9)))
    frames = small.groupBy("frame_id").agg(F.collect_list(F.struct("y", "x", (F.col("v") / 255.0).alias("v"))).alias("pixels"))
    return radial_spectrum_arrow(frames, target, n_bins)
