"""Queries of the whole chain, of its training and of graphs with vectors on nodes and edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import paths
from cliploom.operators import attention, chain, clips, experiment, graph, heads, parameters, training
from cliploom.operators.subsets import LAYOUT
from cliploom.plans import model_queries as M
from cliploom.plans import surrogates as S
from cliploom.sources import shared

#: Numbers that a modality reads of each embedding, and elements of a frame where frames have several.
WIDTH, ELEMENTS = 8, {"fau": 3, "face_mesh": 4}


def chain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, modality, t, element, features: every embedding is a frame, of which each modality reads its own numbers; elements read on, around the end.

    Every third clip has no depth, and other clips lack rppg in their later frames, so
    clips of one batch differ.
    """
    c = S.clips(spark, sf_dir).where("embedding IS NOT NULL")
    parts = [F.struct(F.lit(name).alias("modality"), F.lit(e).alias("element"), F.lit(k * WIDTH + e * WIDTH).alias("start")) for k, (name, *_) in enumerate(LAYOUT) for e in range(ELEMENTS.get(name, 1))]
    rows = c.select("clip_id", "t", "embedding", F.inline(F.array(*parts)))
    rows = rows.where("NOT (modality = 'depth' AND clip_id % 3 = 1) AND NOT (modality = 'rppg' AND clip_id % 2 = 1 AND t > 4)")
    n = F.size("embedding")
    values = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.get(F.col("embedding"), (F.col("start") + i) % n))
    return rows.select("clip_id", "modality", "t", "element", values.alias("features"))


def small_chain() -> chain.Chain:
    return chain.Chain(tuple(chain.modality(name, WIDTH) for name, *_ in LAYOUT), dim=32, heads=4, layers=2)


def chain_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit, probability and prediction of each clip by the chain of all eight modalities, with fresh parameters out of the store."""
    spec = small_chain()
    path = shared.fresh_folder(spark, "parameters")
    parameters.write(parameters.initial(spark, spec.shapes()), path)
    params, _ = parameters.load(parameters.read(spark, path), spec.shapes())
    scored = chain.logits(clips.packed(chain_features(spark, sf_dir)), spec, params)
    out = heads.predict(scored.select("clip_id", "logit", "places"))
    return out.select("clip_id", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"), "prediction", "places")


def fused_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, pos, modality_id, time_id, mask, squares: what the chain's fusion makes of every place of every clip, its squares added up."""
    spec = small_chain()
    params, _ = parameters.load(parameters.initial(spark, spec.shapes()), spec.shapes())
    rows = chain.fused_tokens(clips.packed(chain_features(spark, sf_dir)), spec, params)
    squares = F.aggregate("token", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("clip_id", "pos", "modality_id", "time_id", "mask", F.round(squares, 5).alias("squares"))


def labelled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed clips; a clip is fake if most of its embeddings have a label of 5 or more."""
    e = S.table(spark, sf_dir, "embeddings")
    label = (F.avg((F.col("label") >= 5).cast("double")) >= 0.5).cast("int").alias("label")
    labels = e.groupBy(F.floor(F.col("vec_id") / S.CLIP).cast("long").alias("clip_id")).agg(label)
    return clips.packed(chain_features(spark, sf_dir)).join(labels, "clip_id")


def trained_chain(spark: SparkSession, sf_dir: str, epochs: int = 16) -> DataFrame:
    """epoch, train_loss, train_accuracy of training all parameters on all clips, in two batches an epoch."""
    spec = chain.Chain(tuple(chain.modality(name, WIDTH, slots=2) for name, *_ in LAYOUT), dim=16, heads=2, layers=1)
    run = training.train_chain(labelled_clips(spark, sf_dir), spec, parameters.initial(spark, spec.shapes()), epochs, 2, rate=0.01)
    return spark.createDataFrame(run.metrics, "epoch int, train_loss double, train_accuracy double")


def experiment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of two sets of modalities, trained on three quarters of the clips and judged on all; names repeat, so some clips to judge were seen."""
    e = S.table(spark, sf_dir, "embeddings")
    clip = F.floor(F.col("vec_id") / S.CLIP).cast("long")
    label = (F.avg((F.col("label") >= 5).cast("double")) >= 0.5).cast("int")
    known = e.groupBy(clip.alias("clip_id")).agg(label.alias("label"))
    folder = F.when(F.col("clip_id") % 4 == 0, "test").otherwise("train")
    known = known.select("clip_id", "label", folder.alias("split"), F.concat(F.lit("/"), folder, F.lit("/"), (F.col("clip_id") % 30).cast("string"), F.lit(".mp4")).alias("path"), paths.class_name(F.col("label")).alias("class_name"))
    rows = chain_features(spark, sf_dir).join(known, "clip_id").withColumn("path", F.concat("path", F.lit("?"), F.col("clip_id").cast("string")))
    rows = rows.withColumn("path", F.regexp_replace("path", r"/([0-9]+\.mp4)\?([0-9]+)$", "/$2/$1"))
    spec = chain.Chain(tuple(chain.modality(name, WIDTH, slots=2) for name in ("rgb", "fau", "eye_gaze")), dim=16, heads=2, layers=1)
    results = experiment.run(rows, spec, shared.fresh_folder(spark, "runs"), 2, rate=0.01, sets=(("rgb",), ("rgb", "fau", "eye_gaze")))
    out = results[0].report.unionByName(results[1].report)
    return out.select("modality_set", *[c for c in out.columns if c.endswith(("_count", "_misses"))])


#: Channels of a graph's nodes, and units of the unit head.
CHANNELS, UNITS = 8, 6


def _graph_shapes(width: int) -> dict[str, tuple[int, ...]]:
    return graph.linear_block_shapes("block", width, CHANNELS) | graph.gated_shapes("layer", S.CLIP, CHANNELS)


def vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, slot, d, v: a clip's vectors, each through a linear block, are the nodes of a graph; an edge starts as the product of its ends; two gated layers."""
    shapes = _graph_shapes(64)
    p, _ = parameters.load(parameters.initial(spark, shapes), shapes)

    def run(found: clips.Ragged) -> tuple[np.ndarray, np.ndarray]:
        n, frames, *_ = found.x.shape
        x, mask = np.zeros((n, S.CLIP, CHANNELS)), np.zeros((n, S.CLIP), bool)
        mask[:, :frames] = found.mask[:, :, 0]
        x[:, :frames] = graph.linear_block(p, "block", found.x[:, :, 0]) * mask[:, :frames, None]
        return graph.gated_layers(p, "layer", x, x[:, :, None] * x[:, None], mask)[0], mask.sum(1)

    rows = attention.components(attention.per_clip(S.vectors(spark, sf_dir), run))
    return rows.withColumn("v", F.round("v", 5) + F.lit(0.0))


def unit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, unit, cosine, edge0 to edge3: a clip's vectors as a feature map through the unit head; of each unit the cosine logit and its edges' logits, added up."""
    spec = graph.UnitHead(64, CHANNELS, UNITS)
    p, _ = parameters.load(parameters.initial(spark, spec.shapes()), spec.shapes())

    def run(found: clips.Ragged) -> tuple[np.ndarray, np.ndarray]:
        frames = found.mask[:, :, 0].sum(1)
        out = np.empty((len(frames), UNITS, 5))
        for n in np.unique(frames).tolist():
            _, cosine, edge = spec.forward(p, found.x[frames == n, :n, 0])
            out[frames == n] = np.concatenate([cosine[..., None], edge.sum(2)], -1)
        return out, np.full(len(frames), UNITS)

    rows = attention.per_clip(S.vectors(spark, sf_dir), run)
    names = ["cosine", "edge0", "edge1", "edge2", "edge3"]
    return rows.select("clip_id", F.col("slot").alias("unit"), *[(F.round(F.col("values")[k], 6) + F.lit(0.0)).alias(n) for k, n in enumerate(names)])


def _graph_sql() -> str:
    shapes = _graph_shapes(M.DIM)
    phase = {n: k for k, n in enumerate(sorted(shapes))}

    def w(name: str, i: str, j: str) -> str:
        n, m = shapes[name]
        s = f"(sin(({i} * {m} + {j}) * 12.9898e0 + {phase[name]} * 78.233e0 + 1e0) * 43758.5453e0)"
        return f"((2e0 * ({s} - floor({s})) - 1e0) * sqrt(3e0 / {n}))"

    def times(source: str, part: str, k: int, keys: str) -> str:
        return f"(SELECT {keys}, o.d AS d, sum(v * {w(f'layer{k}.{part}', 's.d', 'o.d')}) AS v FROM {source} s, range({CHANNELS}) o(d) GROUP BY ALL)"

    root = "sqrt(1e0 + 1e-5)"
    parts = [M.FEATURES_SQL, "cnt AS (SELECT clip_id, count(DISTINCT t) AS n FROM tok GROUP BY 1)", f"x0 AS MATERIALIZED (SELECT clip_id, t AS i, o.d AS d, greatest(0e0, sum(v * {w('block.weight', 'tok.d', 'o.d')}) / {root}) AS v FROM tok, range({CHANNELS}) o(d) GROUP BY 1, 2, 3)", "e0 AS MATERIALIZED (SELECT a.clip_id, a.i, b.i AS j, a.d, a.v * b.v AS v FROM x0 a JOIN x0 b ON a.clip_id = b.clip_id AND a.d = b.d)"]
    for k in range(2):
        parts += [f"{p}{k} AS MATERIALIZED {times(f'x{k}', p, k, 'clip_id, i')}" for p in "uvab"]
        parts += [
            f"m{k} AS MATERIALIZED {times(f'e{k}', 'e', k, 'clip_id, i, j')}",
            f"e{k + 1} AS MATERIALIZED (SELECT e.clip_id, e.i, e.j, e.d, e.v + greatest(0e0, (a.v + b.v + m.v) / {root}) AS v FROM e{k} e JOIN m{k} m USING (clip_id, i, j, d) JOIN a{k} a ON a.clip_id = e.clip_id AND a.i = e.i AND a.d = e.d JOIN b{k} b ON b.clip_id = e.clip_id AND b.i = e.j AND b.d = e.d)",
            f"g{k} AS (SELECT clip_id, i, j, d, z / sum(z) OVER (PARTITION BY clip_id, i, d) AS g FROM (SELECT *, exp(1e0 / (1e0 + exp(-v))) AS z FROM e{k + 1}))",
            f"s{k} AS (SELECT g.clip_id, g.i, g.d, sum(g * v.v) / any_value(n) AS v FROM g{k} g JOIN v{k} v ON v.clip_id = g.clip_id AND v.i = g.j AND v.d = g.d JOIN cnt ON cnt.clip_id = g.clip_id GROUP BY 1, 2, 3)",
            f"x{k + 1} AS MATERIALIZED (SELECT x.clip_id, x.i, x.d, greatest(0e0, x.v + (u.v + s.v) / {root}) AS v FROM x{k} x JOIN u{k} u USING (clip_id, i, d) JOIN s{k} s USING (clip_id, i, d))",
        ]
    return "WITH " + ",\n".join(parts) + " SELECT clip_id, i AS slot, d::INT AS d, round(v, 5) + 0e0 AS v FROM x2"


QUERIES = {f.__name__: f for f in (chain_logits, fused_places, trained_chain, experiment_sets, vector_graph, unit_head)}
#: The whole chain and its training have none: they are held against plain loops in tests/test_chain.py.
ORACLES = {"vector_graph": _graph_sql()}
