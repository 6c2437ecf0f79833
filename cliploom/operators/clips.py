"""Clips as rows: every feature of a clip in one array, and ragged batches of many clips for numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clips that one numpy call takes.
STEP = 256


def packed(features: DataFrame, keys: Sequence[str] = ("clip_id",), names: Sequence[str] | None = None) -> DataFrame:
    """keys, tokens: from (keys, modality, t, element, features), a clip's tokens in that order. One shuffle by clip.

    A clip has a bounded number of frames, so it is one row. Null features are left
    out; a token that stands there twice stays twice. With ``names``, only tokens of
    these modalities are gathered; clips that have none of them stay, without tokens.
    """
    token = F.struct("modality", "t", "element", F.transform("features", lambda x: x.cast("double")).alias("features"))
    kept = token if names is None else F.when(F.col("modality").isin(list(names)), token)
    return features.where("features IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list(kept)).alias("tokens"))


def only(packed: DataFrame, names: Sequence[str]) -> DataFrame:
    """:func:`packed` clips, all of them, with the tokens of these modalities."""
    return packed.withColumn("tokens", F.filter("tokens", lambda x: x["modality"].isin(list(names))))


@dataclass
class Ragged:
    """Tokens of one modality: the clips that have it, padded features (clips, frames, elements, width) and which elements are there."""

    who: np.ndarray
    x: np.ndarray
    mask: np.ndarray


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where any of the keys differs from the row before."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return fresh


def _places(fresh: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of fresh rows before this one within its group of consecutive rows."""
    count = np.cumsum(fresh)
    starts = np.flatnonzero(_runs(group))
    return count - np.repeat(count[starts], np.diff(np.append(starts, len(group))))


def ragged(tokens: pa.Array, widths: dict[str, int], name_clip: Callable[[int], object] = int) -> dict[str, Ragged]:
    """The modalities of ``widths`` in a batch of :func:`packed` clips; others are passed over. Raises for features of another width, naming the clip."""
    flat, size = tokens.flatten(), np.asarray(tokens.value_lengths().fill_null(0))
    clip = np.repeat(np.arange(len(tokens)), size)
    modality, t, element, features = (flat.field(k) for k in ("modality", "t", "element", "features"))
    modality, t, element = np.asarray(modality.to_numpy(zero_copy_only=False)), np.asarray(t), np.asarray(element)
    length, values = np.asarray(features.value_lengths()), np.asarray(features.flatten())
    first = np.cumsum(length) - length
    out = {}
    for name, width in widths.items():
        rows = np.flatnonzero(modality == name)
        if not len(rows):
            continue
        if (bad := rows[length[rows] != width]).size:
            raise ValueError(f"clip {name_clip(int(clip[bad[0]]))}: {name} features have {length[bad[0]]} numbers, not {width}")
        who, row = np.unique(clip[rows], return_inverse=True)
        new = _runs(row, t[rows])
        frame = _places(new, row)
        at = _places(np.ones(len(rows), bool), np.cumsum(new))
        shape = len(who), int(frame.max()) + 1, int(at.max()) + 1
        x, mask = np.zeros((*shape, width)), np.zeros(shape, bool)
        x[row, frame, at] = values[first[rows][:, None] + np.arange(width)]
        mask[row, frame, at] = True
        out[name] = Ragged(who, x, mask)
    return out


def batches(stream: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The stream's rows, at most ``step`` at a time."""
    for b in stream:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
