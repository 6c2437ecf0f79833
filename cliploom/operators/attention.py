"""Attention over the vectors of a clip: a clip is one row, many clips are one numpy call, and nothing is joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions import layers

from .clips import Ragged, batches, packed, ragged

_ONE = "x"


def table(rows: int, columns: int, phase: float = 0.0) -> np.ndarray:
    """The closed-form parameters of :func:`cliploom.functions.numeric.weight`."""
    i, j = np.mgrid[:rows, :columns]
    return 0.02 * np.sin(12.9898 * i + 78.233 * j + phase)


def per_clip(vectors: DataFrame, run: Callable[[Ragged], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """clip_id, slot, values: what ``run`` makes of each clip's vectors (clip_id, t, element, features).

    ``run`` gets a padded batch and gives (clips, rows, dim) and how many rows of each
    clip count. One shuffle, by clip; a clip's vectors are one row of bounded size.
    Null vectors are left out, and clips without any; vectors of unequal lengths raise.
    """
    clips = packed(vectors.select("clip_id", F.lit(_ONE).alias("modality"), "t", "element", "features"))

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream):
            tokens = b.column(1)
            ids = b.column(0)
            width = len(tokens[0].as_py()[0]["features"]) if b.num_rows else 0
            found = ragged(tokens, {_ONE: width}, lambda i, ids=ids: ids[i].as_py()).get(_ONE)
            if found is None:
                continue
            y, count = run(found)
            keep = np.arange(y.shape[1]) < np.asarray(count)[:, None]
            who = np.repeat(found.who, np.asarray(count))
            slot = np.broadcast_to(np.arange(y.shape[1]), keep.shape)[keep]
            rows = pa.FixedSizeListArray.from_arrays(pa.array(y[keep].ravel()), y.shape[2]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(slot.astype(np.int32)), rows], ["clip_id", "slot", "values"])

    kind = dict(clips.dtypes)["clip_id"]
    return clips.mapInArrow(apply, f"clip_id {kind}, slot int, values array<double>")


def components(rows: DataFrame) -> DataFrame:
    """clip_id, slot, d, v."""
    return rows.select("clip_id", "slot", F.posexplode("values").alias("d", "v"))


def latent_pool(vectors: DataFrame, slots: int, temporal: bool = True, inner: int = 0) -> DataFrame:
    """clip_id, slot, d, v: learned queries attend to each clip's normalised vectors; see :func:`cliploom.functions.layers.pool`.

    With ``inner``, the elements of each frame are pooled into so many tokens first,
    and those over time, frame by frame. Queries come from a closed-form table.
    """

    def run(found: Ragged) -> tuple[np.ndarray, np.ndarray]:
        x, mask = found.x, found.mask
        n, frames, elements, dim = x.shape
        if inner:
            x, _ = layers.pool({"p.queries": table(inner, dim)}, "p", x.reshape(n * frames, elements, dim), mask.reshape(n * frames, elements), temporal=False)
            mask = np.repeat(mask.any(2), inner, axis=1)
        y, _ = layers.pool({"p.queries": table(slots, dim)}, "p", x.reshape(n, -1, dim), mask.reshape(n, -1), temporal)
        return y, np.full(n, slots)

    return components(per_clip(vectors, run))


def cross_attention(vectors: DataFrame) -> DataFrame:
    """clip_id, slot, d, v: each vector of a clip attends to all of the clip's, itself included, by scaled dot products."""

    def run(found: Ragged) -> tuple[np.ndarray, np.ndarray]:
        n, *_, dim = found.x.shape
        x, mask = found.x.reshape(n, -1, dim), found.mask.reshape(n, -1)
        z = np.where(mask[:, None, :], x @ x.transpose(0, 2, 1) / np.sqrt(dim), layers.HIDDEN)
        return layers.softmax(z) @ x, mask.sum(1)

    return components(per_clip(vectors, run))


def fuse(tokens: DataFrame, heads: int = 4, depth: int = 1) -> DataFrame:
    """clip_id, slot, d, v (slot 0): the class token behind a post-norm transformer over a clip's tokens (clip_id, t, element, features).

    Masked places can't reach the class token, so they needn't be among the tokens.
    Weights come from closed-form tables, without biases.
    """

    def run(found: Ragged) -> tuple[np.ndarray, np.ndarray]:
        n, *_, dim = found.x.shape
        if dim % heads:
            raise ValueError("dim must divide by heads")
        p = {f"l.attention.{part}.weight": table(dim, dim, k) for k, part in enumerate(("query", "key", "value", "out"))}
        p |= {"l.mlp.up.weight": table(dim, 4 * dim, 4), "l.mlp.down.weight": table(4 * dim, dim, 5)}
        cls = np.broadcast_to(table(1, dim, 6), (n, 1, dim))
        x = np.concatenate([cls, found.x.reshape(n, -1, dim)], 1)
        mask = np.concatenate([np.ones((n, 1), bool), found.mask.reshape(n, -1)], 1)
        for _ in range(depth):
            x, _ = layers.encoder_layer(p, "l", x, mask, heads)
        y, _ = layers.norm({}, "", x[:, :1])
        return y, np.ones(n, int)

    return components(per_clip(tokens, run))
