"""Graph operators on complete digraphs with self loops: as edge tables, and as arrays, a row for each graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import layers

from .clips import batches


def complete_digraph(spark: SparkSession, n: int) -> DataFrame:
    """edge_id, i (end), j (start): edge i * n + j."""
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    j = spark.range(n).select(F.col("id").cast("int").alias("j"))
    return i.crossJoin(j).select((F.col("i") * n + F.col("j")).alias("edge_id"), "i", "j")


def edges_of(nodes: DataFrame, n: int) -> DataFrame:
    """graph_id, edge_id, target, source: the edges between the nodes (graph_id, i, name) that graphs of up to ``n`` nodes have, self loops too."""
    table = F.broadcast(complete_digraph(nodes.sparkSession, n))
    ends = nodes.select("graph_id", "i", F.col("name").alias("target")).join(table, "i")
    return ends.join(nodes.select("graph_id", F.col("i").alias("j"), F.col("name").alias("source")), ["graph_id", "j"]).select("graph_id", "edge_id", "target", "source")


def normalized(edges: DataFrame) -> DataFrame:
    """a / sqrt(deg_i * deg_j) by row degrees, from (i, j, a); 0 where a degree is 0."""
    degree = edges.groupBy("i").agg(F.sum("a").alias("deg"))
    both = edges.join(degree.withColumnRenamed("deg", "di"), "i").join(degree.select(F.col("i").alias("j"), F.col("deg").alias("dj")), "j")
    return both.select("i", "j", F.coalesce(F.try_divide(F.col("a"), F.sqrt(F.col("di") * F.col("dj"))), F.lit(0.0)).alias("a"))


def architecture_edges(modalities: DataFrame) -> DataFrame:
    """(source, target): input to each modality, those to the bank, the bank to fusion, fusion to its outputs."""
    spark = modalities.sparkSession
    fixed = spark.createDataFrame([("token_bank", "fusion"), ("fusion", "cls"), ("fusion", "fused_tokens")], "source string, target string")
    into = modalities.select(F.lit("input").alias("source"), F.col("name").alias("target"))
    out = modalities.select(F.col("name").alias("source"), F.lit("token_bank").alias("target"))
    return into.unionByName(out).unionByName(fixed)


def gated_message(graphs: DataFrame, column: str, u: float = 0.5, v: float = 0.8, a: float = 0.3, b: float = -0.2) -> DataFrame:
    """``graphs`` with ``column``, an array with a number for each node of a complete digraph, sent through one gated layer.

    edge = a x_i + b x_j; gate = softmax over j of its sigmoid; x_i = relu(x_i + u x_i + sum_j gate v x_j / n).
    A graph is one row and stays where it is. Null and empty arrays stay as they are.
    """
    rows = graphs.select(F.struct(*[c for c in graphs.columns if c != column]).alias("row"), F.transform(column, lambda x: x.cast("double")).alias("x"))
    names = [*[c for c in graphs.columns if c != column], column]
    types = dict(graphs.dtypes)

    def layer(x: np.ndarray) -> np.ndarray:
        gate = layers.softmax(1 / (1 + np.exp(-(a * x[:, :, None] + b * x[:, None, :]))))
        return np.maximum(x + u * x + v * (gate @ x[:, :, None])[:, :, 0] / x.shape[1], 0)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            lists = batch.column(1)
            size, flat = np.asarray(lists.value_lengths().fill_null(0)), np.asarray(lists.flatten())
            first, out = np.cumsum(size) - size, np.empty(len(flat))
            for n in np.unique(size[size > 0]).tolist():
                at = first[size == n][:, None] + np.arange(n)
                out[at] = layer(flat[at])
            made = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(out), mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), made], names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names[:-1]) + f", `{column}` array<double>")


# --- graphs with vectors on nodes and edges --------------------------------


def _affine(p: layers.Parameters, name: str, x: np.ndarray, axis: int) -> np.ndarray:
    """Batch norm as it is applied: by stored mean and variance, for each place of ``axis``."""
    shape = [1] * x.ndim
    shape[axis] = x.shape[axis]
    mean, var, scale, shift = (p[f"{name}.{part}"][: x.shape[axis]].reshape(shape) for part in ("mean", "var", "scale", "shift"))
    return (x - mean) / np.sqrt(var + layers.EPS) * scale + shift


def affine_shapes(name: str, n: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.{part}": (n,) for part in ("mean", "var", "scale", "shift")}


def linear_block(p: layers.Parameters, name: str, x: np.ndarray) -> np.ndarray:
    """Linear, batch norm by output, ReLU."""
    return np.maximum(_affine(p, f"{name}.norm", layers.linear(p, name, x)[0], x.ndim - 1), 0)


def linear_block_shapes(name: str, n: int, m: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.weight": (n, m), f"{name}.bias": (m,)} | affine_shapes(f"{name}.norm", m)


def gated_layers(p: layers.Parameters, name: str, x: np.ndarray, edge: np.ndarray, mask: np.ndarray, depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Node (B, N, C) and edge (B, N, N, C) states after ``depth`` gated layers over complete digraphs with self loops.

    For the edge from j to i: edge += relu(norm(A x_i + B x_j + E edge)); its gate is,
    channel by channel, the softmax over j of its sigmoid; x_i = relu(x_i + norm(U x_i +
    sum_j gate V x_j / n)). The edges' state lives on from layer to layer. Nodes that a
    graph lacks (``mask``) send nothing, and n counts those it has.
    """
    there, n = mask[:, None, :, None], mask.sum(1)[:, None, None]
    for k in range(depth):
        of = lambda part, v, k=k: v @ p[f"{name}{k}.{part}"]
        b, nodes, _, c = edge.shape
        moved = of("a", x)[:, :, None, :] + of("b", x)[:, None, :, :] + of("e", edge)
        by_edge = _affine(p, f"{name}{k}.edge_norm", moved.reshape(b, nodes * nodes, c), 1).reshape(moved.shape)
        edge = edge + np.maximum(by_edge, 0)
        gate = layers.softmax(np.where(there, 1 / (1 + np.exp(-edge)), layers.HIDDEN), 2)
        sent = of("u", x) + np.einsum("bijc,bjc->bic", gate, of("v", x)) / n
        x = np.maximum(x + _affine(p, f"{name}{k}.node_norm", sent, 1), 0)
    return x, edge


def gated_shapes(name: str, nodes: int, channels: int, depth: int = 2) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for k in range(depth):
        out |= {f"{name}{k}.{part}": (channels, channels) for part in "uvabe"}
        out |= affine_shapes(f"{name}{k}.node_norm", nodes) | affine_shapes(f"{name}{k}.edge_norm", nodes * nodes)
    return out


def cross(p: layers.Parameters, name: str, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Projected cross attention of y to x; queries and keys have half the channels."""
    q, k, v = (layers.linear(p, f"{name}.{part}", z)[0] for part, z in (("query", y), ("key", x), ("value", x)))
    return layers.softmax(q @ k.swapaxes(-1, -2) / np.sqrt(q.shape[-1])) @ v


def cross_shapes(name: str, c: int) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for part, m in (("query", c // 2), ("key", c // 2), ("value", c)):
        out |= {f"{name}.{part}.weight": (c, m), f"{name}.{part}.bias": (m,)}
    return out


@dataclass(frozen=True)
class UnitHead:
    """Places of a feature map (B, D, width) to ``units`` graph nodes, their cosine logits and four logits for every edge."""

    width: int
    channels: int
    units: int

    def shapes(self) -> dict[str, tuple[int, ...]]:
        c, n = self.channels, self.units
        out = linear_block_shapes("global", self.width, c)
        for i in range(n):
            out |= linear_block_shapes(f"unit{i}", c, c)
        out |= cross_shapes("to_map", c) | cross_shapes("to_unit", c) | {"edge.weight": (c, c), "edge.bias": (c,)} | affine_shapes("edge.norm", n * n)
        return out | gated_shapes("layer", n, c) | {"centre": (n, c), "edge_logit.weight": (c, 4), "edge_logit.bias": (4,)}

    def forward(self, p: layers.Parameters, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node features (B, N, C), cosines (B, N) and edge logits (B, N, N, 4), the edge from j to i at [i, j]."""
        whole = linear_block(p, "global", x)
        units = np.stack([linear_block(p, f"unit{i}", whole) for i in range(self.units)], 1)
        b, n, d, c = units.shape
        seen = cross(p, "to_map", units, whole[:, None])
        pairs = cross(p, "to_unit", seen[:, None, :], seen[:, :, None])
        edge = layers.linear(p, "edge", pairs)[0].reshape(b, n * n, d, c)
        edge = _affine(p, "edge.norm", edge, 1).mean(2).reshape(b, n, n, c)
        node, edge = gated_layers(p, "layer", units.mean(2), edge, np.ones((b, n), bool))
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
        cosine = (unit(node) * unit(np.maximum(p["centre"], 0))).sum(-1)
        return node, cosine, layers.linear(p, "edge_logit", edge)[0]
