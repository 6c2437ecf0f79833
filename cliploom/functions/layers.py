"""Neural layers on numpy batches, each with its backward pass.

A layer takes parameters by name and gives its output and ``back(dy, g)``, which adds
the parameters' gradients to ``g`` and returns that of the input. Weights are stored
as (inputs, outputs). Batches are padded; a mask says which tokens are there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import cache

import numpy as np

Parameters = Mapping[str, np.ndarray]
Gradients = dict[str, np.ndarray]
Back = Callable[[np.ndarray, Gradients], np.ndarray]
#: Score of a token that isn't there.
HIDDEN = -1e30
EPS = 1e-5


def add(g: Gradients, name: str, value: np.ndarray) -> None:
    g[name] = g[name] + value if name in g else value


def linear(p: Parameters, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
    """x w + b; without a bias if the parameters have none."""
    w, bias = p[f"{name}.weight"], f"{name}.bias"

    def back(dy: np.ndarray, g: Gradients) -> np.ndarray:
        rows = dy.reshape(-1, dy.shape[-1])
        add(g, f"{name}.weight", x.reshape(len(rows), -1).T @ rows)
        if bias in p:
            add(g, bias, rows.sum(0))
        return dy @ w.T

    y = x @ w
    return (y + p[bias] if bias in p else y), back


def erf(x: np.ndarray) -> np.ndarray:
    """The polynomial of :func:`cliploom.functions.numeric.erf`."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    below = 0.5 * (1 + erf(x / math.sqrt(2)))
    return x * below, lambda dy, g: dy * (below + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi))


def chained(*layers: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> Callable[[np.ndarray], tuple[np.ndarray, Back]]:
    """One layer after the other."""

    def run(x: np.ndarray) -> tuple[np.ndarray, Back]:
        backs = []
        for layer in layers:
            x, b = layer(x)
            backs.append(b)

        def back(dy: np.ndarray, g: Gradients) -> np.ndarray:
            for b in reversed(backs):
                dy = b(dy, g)
            return dy

        return x, back

    return run


def mlp(p: Parameters, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
    """Linear, GELU, linear."""
    return chained(lambda v: linear(p, f"{name}.up", v), gelu, lambda v: linear(p, f"{name}.down", v))(x)


def norm(p: Parameters, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
    """Layer norm by population variance; scaled and shifted if the parameters say so."""
    scale, shift = f"{name}.weight", f"{name}.bias"
    middle = x - x.mean(-1, keepdims=True)
    spread = np.sqrt((middle * middle).mean(-1, keepdims=True) + EPS)
    z, w = middle / spread, p.get(scale, 1.0)

    def back(dy: np.ndarray, g: Gradients) -> np.ndarray:
        if scale in p:
            add(g, scale, (dy * z).reshape(-1, dy.shape[-1]).sum(0))
        if shift in p:
            add(g, shift, dy.reshape(-1, dy.shape[-1]).sum(0))
        dz = dy * w
        return (dz - dz.mean(-1, keepdims=True) - z * (dz * z).mean(-1, keepdims=True)) / spread

    return z * w + p.get(shift, 0.0), back


def softmax(z: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(z - z.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def softmax_back(a: np.ndarray, da: np.ndarray, axis: int = -1) -> np.ndarray:
    return a * (da - (a * da).sum(axis, keepdims=True))


@cache
def position_codes(steps: int, dim: int) -> np.ndarray:
    """Sines at even places, cosines at odd ones."""
    t, d = np.mgrid[:steps, :dim]
    angle = t * np.exp(-(d - d % 2) * (math.log(10000.0) / dim))
    return np.where(d % 2 == 0, np.sin(angle), np.cos(angle))


def pool(p: Parameters, name: str, tokens: np.ndarray, mask: np.ndarray, temporal: bool = True) -> tuple[np.ndarray, Back]:
    """(B, N, D) to (B, slots, D): learned queries attend to normalised tokens, whose weighted sum is normalised again.

    With ``temporal``, scaled position codes add to the scores, never to the values.
    """
    query, gain = p[f"{name}.queries"], f"{name}.position_scale"
    root = math.sqrt(query.shape[1])
    n, back_in = norm(p, f"{name}.input_norm", tokens)
    z = query @ n.transpose(0, 2, 1) / root
    codes = position_codes(tokens.shape[1], query.shape[1])
    by_place = query @ codes.T / root
    if temporal:
        z = z + p.get(gain, 1.0) * by_place
    a = softmax(np.where(mask[:, None, :], z, HIDDEN))
    y, back_out = norm(p, f"{name}.output_norm", a @ n)

    def back(dy: np.ndarray, g: Gradients) -> np.ndarray:
        do = back_out(dy, g)
        dz = softmax_back(a, do @ n.transpose(0, 2, 1)) / root
        add(g, f"{name}.queries", (dz @ n).sum(0))
        if temporal:
            each = dz.sum(0)
            add(g, f"{name}.queries", p.get(gain, 1.0) * each @ codes)
            if gain in p:
                add(g, gain, np.reshape((each * by_place).sum() * root, np.shape(p[gain])))
        return back_in(a.transpose(0, 2, 1) @ do + dz.transpose(0, 2, 1) @ query, g)

    return y, back


def attention(p: Parameters, name: str, x: np.ndarray, mask: np.ndarray, heads: int) -> tuple[np.ndarray, Back]:
    """Self-attention of several heads over (B, N, D); nobody attends to tokens that aren't there."""
    b, n, dim = x.shape
    width = dim // heads
    split = lambda v: v.reshape(b, n, heads, width).transpose(0, 2, 1, 3)
    merge = lambda v: v.transpose(0, 2, 1, 3).reshape(b, n, dim)
    (q, bq), (k, bk), (v, bv) = (linear(p, f"{name}.{part}", x) for part in ("query", "key", "value"))
    q, k, v = split(q), split(k), split(v)
    a = softmax(np.where(mask[:, None, None, :], q @ k.transpose(0, 1, 3, 2) / math.sqrt(width), HIDDEN))
    y, back_out = linear(p, f"{name}.out", merge(a @ v))

    def back(dy: np.ndarray, g: Gradients) -> np.ndarray:
        do = split(back_out(dy, g))
        dz = softmax_back(a, do @ v.transpose(0, 1, 3, 2)) / math.sqrt(width)
        return bq(merge(dz @ k), g) + bk(merge(dz.transpose(0, 1, 3, 2) @ q), g) + bv(merge(a.transpose(0, 1, 3, 2) @ do), g)

    return y, back


def _plus(layer: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> Callable[[np.ndarray], tuple[np.ndarray, Back]]:
    """A layer beside a straight way."""

    def run(x: np.ndarray) -> tuple[np.ndarray, Back]:
        y, b = layer(x)
        return x + y, lambda dy, g: dy + b(dy, g)

    return run


def encoder_parts(p: Parameters, name: str, mask: np.ndarray, heads: int) -> list[Callable[[np.ndarray], tuple[np.ndarray, Back]]]:
    """A transformer layer that normalises behind each of its two halves, as what to do one after the other."""
    return [
        _plus(lambda v: attention(p, f"{name}.attention", v, mask, heads)),
        lambda v: norm(p, f"{name}.norm1", v),
        _plus(lambda v: mlp(p, f"{name}.mlp", v)),
        lambda v: norm(p, f"{name}.norm2", v),
    ]


def encoder_layer(p: Parameters, name: str, x: np.ndarray, mask: np.ndarray, heads: int) -> tuple[np.ndarray, Back]:
    return chained(*encoder_parts(p, name, mask, heads))(x)


def cross_entropy(logit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each logit against its label of 0 or 1, and its derivative."""
    return np.maximum(logit, 0) - logit * label + np.log1p(np.exp(-np.abs(logit))), 1 / (1 + np.exp(-logit)) - label
