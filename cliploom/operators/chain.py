"""The whole chain as one transformation: features, branches, token bank, fusion, head.

A batch of clips goes through numpy once; clips of different lengths and with different
modalities share it by padding and masks. Nothing of a clip depends on the others of
its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions import layers
from cliploom.functions.layers import Back, Gradients, Parameters

from .clips import STEP, Ragged, batches, ragged
from .subsets import LAYOUT, MODALITIES

Shapes = dict[str, tuple[int, ...]]
#: What the fusion of one numpy call may hold.
CALL_BYTES = 32 << 20


class Branch(Protocol):
    """What turns a modality's features into tokens. Branches from elsewhere fit in by having these two."""

    def shapes(self, name: str, width: int, dim: int, slots: int) -> Shapes:
        """The branch's parameters, all named ``name.…``."""

    def encode(self, p: Parameters, name: str, batch: Ragged) -> tuple[np.ndarray, Back]:
        """(clips, slots, dim) and the way back to the parameters; what it returns for the features may be None."""


def _pool_shapes(name: str, dim: int, slots: int, temporal: bool) -> Shapes:
    out: Shapes = {f"{name}.queries": (slots, dim)}
    for part in ("input_norm", "output_norm"):
        out |= {f"{name}.{part}.weight": (dim,), f"{name}.{part}.bias": (dim,)}
    return out | ({f"{name}.position_scale": (1,)} if temporal else {})


def _linear_shapes(name: str, n: int, m: int) -> Shapes:
    return {f"{name}.weight": (n, m), f"{name}.bias": (m,)}


def _mlp_shapes(name: str, n: int, hidden: int, m: int) -> Shapes:
    return _linear_shapes(f"{name}.up", n, hidden) | _linear_shapes(f"{name}.down", hidden, m)


@dataclass(frozen=True)
class Pooled:
    """Projected frames pooled over time. With ``inner``, the elements of a frame are first pooled into so many tokens; with ``deep``, the projection has two layers."""

    inner: int = 0
    deep: bool = False

    def shapes(self, name: str, width: int, dim: int, slots: int) -> Shapes:
        project = _mlp_shapes(f"{name}.project", width, dim, dim) if self.deep else _linear_shapes(f"{name}.project", width, dim)
        within = _pool_shapes(f"{name}.frame_pool", dim, self.inner, False) if self.inner else {}
        return project | within | _pool_shapes(f"{name}.pool", dim, slots, True)

    def encode(self, p: Parameters, name: str, batch: Ragged) -> tuple[np.ndarray, Back]:
        x, mask = batch.x, batch.mask
        n, frames, elements, _ = x.shape
        tokens, back_project = (layers.mlp if self.deep else layers.linear)(p, f"{name}.project", x)
        dim = tokens.shape[-1]
        if self.inner:
            tokens, back_inner = layers.pool(p, f"{name}.frame_pool", tokens.reshape(n * frames, elements, dim), mask.reshape(n * frames, elements), temporal=False)
            mask = np.repeat(mask.any(2), self.inner, axis=1)
        else:
            back_inner = lambda dy, g: dy
            mask = mask.reshape(n, frames * elements)
        pooled, back_pool = layers.pool(p, f"{name}.pool", tokens.reshape(n, -1, dim), mask)

        def back(dy: np.ndarray, g: Gradients) -> np.ndarray:
            dt = back_pool(dy, g)
            if self.inner:
                dt = back_inner(dt.reshape(n * frames, self.inner, dim), g)
            return back_project(dt.reshape(n, frames, elements, dim), g)

        return pooled, back


@dataclass(frozen=True)
class Modality:
    """A modality of the chain: its place in the bank, the width of its features and the branch that reads them."""

    name: str
    width: int
    slots: int
    modality_id: int
    branch: Branch = field(default_factory=Pooled)


#: Branches of the usual modalities: frames with elements are pooled within first, landmarks and gaze get a projection of two layers.
BRANCHES: dict[str, Branch] = {name: Pooled() for name, *_ in LAYOUT} | {"fau": Pooled(inner=2), "face_mesh": Pooled(inner=1, deep=True), "eye_gaze": Pooled(deep=True)}


def modality(name: str, width: int, slots: int | None = None, branch: Branch | None = None) -> Modality:
    """One of the usual modalities, with slots and branch of its own if given."""
    usual = {n: s for n, s, _ in LAYOUT}
    if name not in usual:
        raise ValueError(f"the token bank has no place for {name!r}")
    return Modality(name, width, slots or usual[name], MODALITIES.index(name), branch or BRANCHES[name])


@dataclass(frozen=True)
class Chain:
    """Enabled modalities in the bank's order, and the sizes of the fusion transformer."""

    modalities: tuple[Modality, ...]
    dim: int = 64
    heads: int = 4
    layers: int = 2
    ratio: float = 2.0
    max_time_steps: int = 64

    def __post_init__(self) -> None:
        if min(self.dim, self.heads, self.layers, self.max_time_steps) < 1 or int(self.dim * self.ratio) < 1:
            raise ValueError("sizes must be positive")
        if self.dim % self.heads:
            raise ValueError("dim must divide by heads")
        if not self.modalities:
            raise ValueError("at least one modality must be enabled")
        for m in self.modalities:
            if m.slots > self.max_time_steps:
                raise ValueError(f"max_time_steps is {self.max_time_steps}, {m.name} needs {m.slots}")

    def shapes(self) -> Shapes:
        dim, hidden = self.dim, int(self.dim * self.ratio)
        out: Shapes = {"fusion.cls": (dim,), "fusion.time": (self.max_time_steps, dim), "fusion.modality": (len(MODALITIES), dim)}
        for m in self.modalities:
            out |= m.branch.shapes(m.name, m.width, dim, m.slots)
        for k in range(self.layers):
            name = f"fusion.layer{k}"
            for part in ("query", "key", "value", "out"):
                out |= _linear_shapes(f"{name}.attention.{part}", dim, dim)
            out |= _mlp_shapes(f"{name}.mlp", dim, hidden, dim)
            for part in ("norm1", "norm2"):
                out |= {f"{name}.{part}.weight": (dim,), f"{name}.{part}.bias": (dim,)}
        return out | {"fusion.norm.weight": (dim,), "fusion.norm.bias": (dim,)} | _linear_shapes("head", dim, 1)

    def step(self) -> int:
        """Clips of one numpy call: as many as keep what the fusion's layers hold for the way back within CALL_BYTES, and STEP at most."""
        places, hidden = 1 + sum(m.slots for m in self.modalities), int(self.dim * self.ratio)
        held = 8 * self.layers * places * (4 * self.heads * places + 12 * self.dim + 4 * hidden)
        return max(1, min(STEP, CALL_BYTES // held))

    def widths(self) -> dict[str, int]:
        return {m.name: m.width for m in self.modalities}

    def bank(self, p: Parameters, found: Mapping[str, Ragged], clips: int, keep: bool = True) -> tuple[np.ndarray, np.ndarray, Back]:
        """(clips, places, dim), mask and the way back. Places of modalities that aren't enabled are left out: masked, they reach nothing.

        Without ``keep`` a branch's way back goes before the next branch begins, and the way back is none.
        """
        places = sum(m.slots for m in self.modalities)
        x, mask, backs, at = np.zeros((clips, places, self.dim)), np.zeros((clips, places), bool), [], 0
        for m in self.modalities:
            if m.name in found:
                who = found[m.name].who
                tokens, back = m.branch.encode(p, m.name, found[m.name])
                if tokens.shape != (len(who), m.slots, self.dim):
                    raise ValueError(f"{m.name} must give {m.slots} tokens of {self.dim}, not {tokens.shape[1:]}")
                x[who, at : at + m.slots] = tokens
                mask[who, at : at + m.slots] = True
                if keep:
                    backs.append((slice(at, at + m.slots), who, back))
                del tokens, back
            at += m.slots

        def back(dx: np.ndarray, g: Gradients) -> None:
            for where, who, b in backs:
                b(dx[who, where], g)

        return x, mask, back

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Time (the slot's number) and modality id of each place."""
        slots = [m.slots for m in self.modalities]
        return np.concatenate([np.arange(n) for n in slots]), np.repeat([m.modality_id for m in self.modalities], slots)

    def placed(self, p: Parameters, tokens: np.ndarray) -> np.ndarray:
        """The class token, then the bank's tokens with codes of time and modality."""
        time, of = self.places()
        tokens = tokens + p["fusion.time"][time] + p["fusion.modality"][of]
        return np.concatenate([np.broadcast_to(p["fusion.cls"], (len(tokens), 1, self.dim)), tokens], 1)

    def parts(self, p: Parameters, mask: np.ndarray) -> list[Callable[[np.ndarray], tuple[np.ndarray, Back]]]:
        """What the fusion's layers do, one after the other."""
        there = np.concatenate([np.ones((len(mask), 1), bool), mask], 1)
        return [part for k in range(self.layers) for part in layers.encoder_parts(p, f"fusion.layer{k}", there, self.heads)]

    def forward(self, p: Parameters, found: Mapping[str, Ragged], clips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Back]:
        """Logits, the fused tokens (the class token first), the mask, and the way back from the logits."""
        tokens, mask, back_bank = self.bank(p, found, clips)
        (time, of), x = self.places(), self.placed(p, tokens)
        x, back_stack = layers.chained(*self.parts(p, mask))(x)
        fused, back_norm = layers.norm(p, "fusion.norm", x)
        logit, back_head = layers.linear(p, "head", fused[:, 0])

        def back(d: np.ndarray, g: Gradients) -> None:
            dx = np.zeros_like(x)
            dx[:, 0] = back_head(d[:, None], g)
            dx = back_stack(back_norm(dx, g), g)
            layers.add(g, "fusion.cls", dx[:, 0].sum(0))
            each = dx[:, 1:].sum(0)
            for name, index in (("fusion.time", time), ("fusion.modality", of)):
                into = np.zeros_like(p[name])
                np.add.at(into, index, each)
                layers.add(g, name, into)
            back_bank(dx[:, 1:], g)

        return logit[:, 0], fused, mask, back

    def infer(self, p: Parameters, found: Mapping[str, Ragged], clips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, the fused tokens and the mask. The way back of each part goes before the next begins, so a call holds one part's, whatever the layers."""
        tokens, mask, _ = self.bank(p, found, clips, keep=False)
        x = self.placed(p, tokens)
        for part in self.parts(p, mask):
            x = part(x)[0]
        fused = layers.norm(p, "fusion.norm", x)[0]
        return layers.linear(p, "head", fused[:, 0])[0][:, 0], fused, mask


def logits(clips: DataFrame, chain: Chain, params: Mapping[str, np.ndarray], keep: Sequence[str] = ("clip_id",)) -> DataFrame:
    """keep, logit, cls, places: the chain on every row of :func:`cliploom.operators.clips.packed`, where its tokens stand; no shuffle.

    A clip without any of the enabled modalities has no places and is scored by its
    class token alone. ``params`` are broadcast; :func:`parameters.load` bounds them.
    """
    sent, widths = clips.sparkSession.sparkContext.broadcast(dict(params)), chain.widths()
    rows = clips.select(F.struct(*keep).alias("row"), "tokens")
    names = [*keep, "logit", "cls", "places"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, chain.step()):
            kept = b.column(0)
            found = ragged(b.column(1), widths, lambda i: kept[i].as_py())
            logit, fused, mask = chain.infer(sent.value, found, b.num_rows)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(fused[:, 0].ravel()), chain.dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(logit), flat, pa.array(mask.sum(1).astype(np.int32))], names)

    types = dict(clips.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", logit double, cls array<double>, places int")


def fused_tokens(clips: DataFrame, chain: Chain, params: Mapping[str, np.ndarray], keep: Sequence[str] = ("clip_id",)) -> DataFrame:
    """keys, pos, modality_id, time_id, mask, token: what fusion makes of every place; the class token is at 0, of no modality.

    Places whose modality a clip lacks are computed too, with a false mask: they see
    the others and aren't seen.
    """
    sent, widths = clips.sparkSession.sparkContext.broadcast(dict(params)), chain.widths()
    time, of = chain.places()
    rows = clips.select(F.struct(*keep).alias("row"), "tokens")
    n, names = len(time) + 1, [*keep, "pos", "modality_id", "time_id", "mask", "token"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, chain.step()):
            kept = b.column(0)
            _, fused, mask = chain.infer(sent.value, ragged(b.column(1), widths, lambda i: kept[i].as_py()), b.num_rows)
            each = [c.take(pa.array(np.repeat(np.arange(b.num_rows), n))) for c in kept.flatten()]
            tile = lambda first, rest: pa.array([first, *rest.tolist()] * b.num_rows, pa.int32())
            there = np.concatenate([np.ones((b.num_rows, 1), bool), mask], 1).ravel()
            token = pa.FixedSizeListArray.from_arrays(pa.array(fused.ravel()), chain.dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*each, pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), tile(None, of), tile(None, time), pa.array(there), token], names)

    types = dict(clips.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", pos int, modality_id int, time_id int, mask boolean, token array<double>")
