"""Layers against finite differences, the chain against plain loops, training, and the parameter store."""

import math
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliploom.functions import layers
from cliploom.operators import chain, clips, parameters, training
from cliploom.operators.subsets import LAYOUT, MODALITIES
from cliploom.plans import chain_queries

DATA = "/root/testdata/sf0.001"


def fresh(shapes, seed=0):
    rng = np.random.default_rng(seed)
    return {n: rng.standard_normal(s) * 0.5 for n, s in shapes.items()}


# --- a clip at a time, in plain loops ---------------------------------------


def gelu(x):
    return np.vectorize(lambda v: v * 0.5 * (1 + math.erf(v / math.sqrt(2))))(x)


def line(p, n, x):
    return x @ p[f"{n}.weight"] + p[f"{n}.bias"]


def normed(p, n, x):
    z = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    return z * p[f"{n}.weight"] + p[f"{n}.bias"]


def soft(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def pooled(p, n, tokens, temporal):
    x, q = normed(p, f"{n}.input_norm", tokens), p[f"{n}.queries"]
    out = []
    for row in q:
        score = [row @ v / math.sqrt(len(row)) for v in x]
        if temporal:
            code = [[math.sin(t / 10000 ** (d / len(row))) if d % 2 == 0 else math.cos(t / 10000 ** ((d - 1) / len(row))) for d in range(len(row))] for t in range(len(x))]
            score = [s + p[f"{n}.position_scale"][0] * (row @ c) / math.sqrt(len(row)) for s, c in zip(score, np.array(code))]
        out.append(soft(np.array(score)) @ x)
    return normed(p, f"{n}.output_norm", np.array(out))


def clip_by_hand(p, spec, frames):
    """``frames``: modality -> list (frames) of lists (elements) of vectors."""
    x = [p["fusion.cls"]]
    for m in spec.modalities:
        if m.name not in frames:
            continue
        project = (lambda v, n=m.name: line(p, f"{n}.project.down", gelu(line(p, f"{n}.project.up", v)))) if m.branch.deep else (lambda v, n=m.name: line(p, f"{n}.project", v))
        found = [project(np.array(f)) for f in frames[m.name]]
        if m.branch.inner:
            found = [pooled(p, f"{m.name}.frame_pool", f, False) for f in found]
        for slot, token in enumerate(pooled(p, f"{m.name}.pool", np.concatenate(found), True)):
            x.append(token + p["fusion.time"][slot] + p["fusion.modality"][MODALITIES.index(m.name)])
    x = np.array(x)
    for k in range(spec.layers):
        n, w = f"fusion.layer{k}", spec.dim // spec.heads
        q, key, v = (line(p, f"{n}.attention.{part}", x) for part in ("query", "key", "value"))
        mixed = np.zeros_like(x)
        for h in range(spec.heads):
            s = slice(h * w, h * w + w)
            for i in range(len(x)):
                mixed[i, s] = soft(key[:, s] @ q[i, s] / math.sqrt(w)) @ v[:, s]
        x = normed(p, f"{n}.norm1", x + line(p, f"{n}.attention.out", mixed))
        x = normed(p, f"{n}.norm2", x + line(p, f"{n}.mlp.down", gelu(line(p, f"{n}.mlp.up", x))))
    return float(line(p, "head", normed(p, "fusion.norm", x[0]))[0])


def clips_by_hand(path):
    """Frames of every clip, straight from the table."""
    out = {}
    for vec_id, v in sorted(duckdb.sql(f"SELECT vec_id, embedding FROM '{path}/embeddings.parquet'").fetchall()):
        clip, t = divmod(vec_id, 12)
        for k, (name, *_) in enumerate(LAYOUT):
            if (name == "depth" and clip % 3 == 1) or (name == "rppg" and clip % 2 == 1 and t > 4):
                continue
            elements = [[v[(8 * (k + e) + i) % len(v)] for i in range(8)] for e in range({"fau": 3, "face_mesh": 4}.get(name, 1))]
            out.setdefault(clip, {}).setdefault(name, []).append(elements)
    return out


def test_chain_equals_plain_loops_on_the_whole_table(spark):
    spec = chain_queries.small_chain()
    params, _ = parameters.load(parameters.initial(spark, spec.shapes()), spec.shapes())
    expected = {clip: clip_by_hand(params, spec, frames) for clip, frames in clips_by_hand(DATA).items()}
    rows = chain_queries.chain_logits(spark, DATA).collect()
    assert {r["clip_id"] for r in rows} == set(expected)
    for r in rows:
        assert r["logit"] == pytest.approx(expected[r["clip_id"]], abs=2e-5)
        assert r["prediction"] == (r["probability"] >= 0.5)
        assert r["places"] == 76 - 4 * (r["clip_id"] % 3 == 1)
    assert np.std(list(expected.values())) > 1e-3


def test_fused_tokens_of_all_places(spark):
    """The class token is that of the logits; what a clip lacks is masked and changes nothing else."""
    spec, rows = small(), some_rows(np.random.default_rng(11))
    p = fresh(spec.shapes())
    packed = clips.packed(spark.createDataFrame(rows, TOKENS))
    cls = {r["clip_id"]: r["cls"] for r in chain.logits(packed, spec, p).collect()}
    places = chain.fused_tokens(packed, spec, p).collect()
    assert len(places) == 7 * 7
    for r in places:
        if r["pos"] == 0:
            assert r["token"] == pytest.approx(cls[r["clip_id"]]) and r["mask"] and r["modality_id"] is None
        else:
            assert r["modality_id"] == [0, 0, 6, 6, 5, 5][r["pos"] - 1] and r["time_id"] == (r["pos"] - 1) % 2
            assert r["mask"] == (r["modality_id"] != 6 or r["clip_id"] % 3 > 0)
    noisy = p | {n: v + 1 for n, v in p.items() if n.startswith("fau.")}
    other = {(r["clip_id"], r["pos"]): r["token"] for r in chain.fused_tokens(packed, spec, noisy).collect()}
    for r in places:
        if r["clip_id"] % 3 == 0:
            assert r["token"] == pytest.approx(other[r["clip_id"], r["pos"]])


def test_fused_places_of_the_whole_table(spark):
    rows = chain_queries.fused_places(spark, DATA).collect()
    assert len(rows) == 77 * len(clips_by_hand(DATA))
    hidden = {(r["clip_id"] % 3 == 1, r["modality_id"] == 2) for r in rows if not r["mask"]}
    assert hidden == {(True, True)}


def small(**more):
    names = more.pop("names", ("rgb", "fau", "eye_gaze"))
    return chain.Chain(tuple(chain.modality(n, 3, slots=2) for n in names), **({"dim": 8, "heads": 2, "layers": 2} | more))


TOKENS = "clip_id long, modality string, t int, element int, features array<double>, label int"


def some_rows(rng, n=7):
    rows = []
    for clip in range(n):
        for name, frames, elements in (("rgb", 1 + clip, 1), ("fau", clip % 3, 2), ("eye_gaze", 3, 1)):
            rows += [(clip, name, t, e, rng.standard_normal(3).tolist(), clip % 2) for t in range(frames) for e in range(elements)]
    return rows


def in_numpy(rows, spec):
    groups = {}
    for clip, name, t, e, v, _ in rows:
        groups.setdefault(clip, []).append({"modality": name, "t": t, "element": e, "features": v})
    column = pa.array([sorted(g, key=lambda x: (x["modality"], x["t"], x["element"])) for _, g in sorted(groups.items())])
    return clips.ragged(column, spec.widths()), len(column)


def test_gradients_equal_finite_differences():
    rng, spec = np.random.default_rng(4), small()
    p = fresh(spec.shapes())
    found, n = in_numpy(some_rows(rng), spec)
    label, g = rng.integers(0, 2, n).astype(float), {}

    def loss():
        logit, _, _, back = spec.forward(p, found, n)
        each, slope = layers.cross_entropy(logit, label)
        return each.sum(), slope, back

    _, slope, back = loss()
    back(slope, g)
    for name, value in p.items():
        assert g.get(name, np.zeros(0)).shape in (value.shape, (0,))
        for at in {tuple(int(rng.integers(k)) for k in value.shape) for _ in range(4)}:
            old, side = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = old + d
                side.append(loss()[0])
            value[at] = old
            assert (g[name][at] if name in g else 0.0) == pytest.approx((side[0] - side[1]) / 2e-5, rel=2e-3, abs=2e-6), (name, at)


def test_padding_and_company_change_nothing(spark):
    spec = small()
    p, rows = fresh(spec.shapes()), some_rows(np.random.default_rng(6))
    df = spark.createDataFrame(rows, TOKENS)
    together = {r["clip_id"]: r["logit"] for r in chain.logits(clips.packed(df).coalesce(1), spec, p).collect()}
    shuffled = df.orderBy(F.rand(3)).repartition(5)
    apart = {r["clip_id"]: r["logit"] for r in chain.logits(clips.packed(shuffled), spec, p).collect()}
    alone = {c: float(spec.forward(p, *in_numpy([r for r in rows if r[0] == c], spec))[0][0]) for c in together}
    assert together == pytest.approx(apart) and together == pytest.approx(alone)
    other = [r for r in rows if r[1] != "fau"] + [(c, "smell", 0, 0, [9.0], 0) for c in range(7)]
    without = small(names=("rgb", "eye_gaze"))
    less = {n: v for n, v in p.items() if not n.startswith("fau")}
    seen = {r["clip_id"]: r["logit"] for r in chain.logits(clips.packed(spark.createDataFrame(other, TOKENS)), spec, p).collect()}
    assert seen == pytest.approx({r["clip_id"]: r["logit"] for r in chain.logits(clips.packed(df), without, less).collect()})
    many = spark.createDataFrame([(c, "rgb", t, 0, [c / 600, 1.0, float(t)], 0) for c in range(600) for t in range(1 + c % 3)], TOKENS)
    scores = {r["clip_id"]: r["logit"] for r in chain.logits(clips.packed(many).coalesce(1), spec, p).collect()}
    for c in (0, 255, 256, 257, 599):
        one = [(c, "rgb", t, 0, [c / 600, 1.0, float(t)], 0) for t in range(1 + c % 3)]
        assert scores[c] == pytest.approx(float(spec.forward(p, *in_numpy(one, spec))[0][0]))


def test_order_of_frames_counts_and_hidden_tokens_do_not():
    rng = np.random.default_rng(7)
    p = fresh(chain.Pooled().shapes("x", 3, 8, 2), 1)
    tokens, mask = rng.standard_normal((1, 6, 8)), np.array([[True] * 4 + [False] * 2])
    y, _ = layers.pool(p, "x.pool", tokens, mask)
    tokens[:, 4:] += 100
    assert np.allclose(layers.pool(p, "x.pool", tokens, mask)[0], y)
    assert not np.allclose(layers.pool(p, "x.pool", tokens[:, ::-1], mask[:, ::-1])[0], y)
    flat = layers.pool(p, "x.pool", tokens, mask, temporal=False)[0]
    assert np.allclose(layers.pool(p, "x.pool", tokens[:, ::-1], mask[:, ::-1], temporal=False)[0], flat)


def test_clips_without_features_wrong_widths_and_settings(spark):
    spec = small()
    p = fresh(spec.shapes())
    none = spark.createDataFrame([(1, "smell", 0, 0, [1.0], 0)], TOKENS)
    row = chain.logits(clips.packed(none), spec, p).first()
    assert row["places"] == 0 and math.isfinite(row["logit"])
    assert chain.logits(clips.packed(none.limit(0)), spec, p).collect() == []
    bad = spark.createDataFrame([(41, "rgb", 0, 0, [1.0, 2.0], 0)], TOKENS)
    with pytest.raises(Exception, match=r"clip \{'clip_id': 41\}: rgb features have 2 numbers, not 3"):
        chain.logits(clips.packed(bad), spec, p).collect()
    for error in ({"dim": 9}, {"layers": 0}, {"max_time_steps": 1}, {"names": ()}):
        with pytest.raises(ValueError):
            small(**error)
    with pytest.raises(ValueError, match="no place"):
        chain.modality("smell", 3)


def test_a_branch_from_elsewhere(spark):
    class Mean:
        """A branch from elsewhere: the mean frame in every slot, times a weight."""

        def shapes(self, name, width, dim, slots):
            return {f"{name}.mix": (width, dim)}

        def encode(self, p, name, batch):
            n = batch.mask.sum((1, 2))
            mean = batch.x.sum((1, 2)) / n[:, None]

            def back(dy, g):
                layers.add(g, f"{name}.mix", mean.T @ dy.sum(1))

            return np.repeat((mean @ p[f"{name}.mix"])[:, None], 2, 1), back

    spec = chain.Chain((chain.modality("rgb", 3, 2), chain.modality("depth", 3, 2, Mean())), dim=8, heads=2, layers=1)
    p = fresh(spec.shapes())
    rows = [(c, n, t, 0, [float(c), t + 1.0, 1.0], c % 2) for c in range(6) for n in ("rgb", "depth") for t in range(3)]
    packed = clips.packed(spark.createDataFrame(rows, TOKENS), ("clip_id", "label"))
    assert {r["places"] for r in chain.logits(packed, spec, p).collect()} == {4}
    start = parameters.from_arrays(spark, p)
    run = training.train_chain(packed, spec, start, 3, rate=0.05)
    assert run.metrics[2][1] < run.metrics[0][1]
    moved = parameters.load(run.last, spec.shapes())[0]
    assert not np.allclose(moved["depth.mix"], p["depth.mix"])


def test_a_step_is_adam_with_decoupled_decay(spark):
    spec = small(layers=1)
    p, rows = fresh(spec.shapes()), some_rows(np.random.default_rng(9))
    packed = clips.packed(spark.createDataFrame(rows, TOKENS).repartition(4), ("clip_id", "label"))
    run = training.train_chain(packed, spec, parameters.from_arrays(spark, p), 2, rate=0.01, decay=0.1)
    found, n = in_numpy(rows, spec)
    label, mean, square = np.arange(n) % 2.0, {}, {}
    for step in (1, 2):
        logit, _, _, back = spec.forward(p, found, n)
        loss, slope = layers.cross_entropy(logit, label)
        assert run.metrics[step - 1][1] == pytest.approx(loss.mean())
        g = {}
        back(slope / n, g)
        for name in p:
            d = g.get(name, np.zeros_like(p[name]))
            mean[name] = 0.9 * mean.get(name, 0) + 0.1 * d
            square[name] = 0.999 * square.get(name, 0) + 0.001 * d * d
            p[name] = p[name] * (1 - 0.01 * 0.1) - 0.01 * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    after = parameters.load(run.last, spec.shapes())[0]
    for name in p:
        assert np.allclose(after[name], p[name], atol=1e-6), name


def test_training_halves_the_loss_on_the_given_table(spark):
    rows = chain_queries.trained_chain(spark, DATA).orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == list(range(1, 17))
    assert rows[-1]["train_loss"] < 0.5 * rows[0]["train_loss"]


def test_more_batches_than_clips(spark):
    """Empty batches pass; clips without a label teach nothing; the best epoch is the first of the highest accuracy."""
    spec = small(layers=1)
    rows = some_rows(np.random.default_rng(12), 3)
    rows += [(*r[:5], None) for r in some_rows(np.random.default_rng(13), 9) if r[0] > 2]
    packed = clips.packed(spark.createDataFrame(rows, TOKENS), ("clip_id", "label"))
    run = training.train_chain(packed, spec, parameters.from_arrays(spark, fresh(spec.shapes())), 3, 7, rate=0.01)
    assert len(run.metrics) == 3 and all(0 <= a <= 1 and a * 3 == pytest.approx(round(a * 3)) for _, _, a in run.metrics)
    assert {n: v.shape for n, v in parameters.load(run.best, spec.shapes())[0].items()} == spec.shapes()
    same = training.train_chain(packed.repartition(3), spec, parameters.from_arrays(spark, fresh(spec.shapes())), 3, 7, rate=0.01)
    assert [m[1] for m in same.metrics] == pytest.approx([m[1] for m in run.metrics])


def test_training_without_labels_raises(spark):
    spec = small()
    empty = clips.packed(spark.createDataFrame([], TOKENS), ("clip_id", "label"))
    with pytest.raises(ValueError, match="no labelled clips"):
        training.train_chain(empty, spec, parameters.initial(spark, spec.shapes()), 1)


def test_parameter_store(spark, tmp_path):
    spec = small()
    shapes = spec.shapes()
    table = parameters.initial(spark, shapes)
    values, found = parameters.load(table, shapes)
    assert found == [] and {n: v.shape for n, v in values.items()} == shapes
    assert not values["head.bias"].any() and (values["fusion.norm.weight"] == 1).all()
    assert np.abs(values["fusion.layer0.mlp.up.weight"]).max() <= math.sqrt(3 / 8)
    parameters.write(table.withColumn("name", F.concat(F.lit("module.model."), "name")), f"{tmp_path}/store")
    stored = parameters.read(spark, f"{tmp_path}/store")
    again, _ = parameters.load(stored, shapes, prefixes=["module.", "model."])
    assert all((again[n] == values[n]).all() for n in shapes)
    with pytest.raises(ValueError, match="missing"):
        parameters.load(stored, shapes)
    big = {"a": (3, parameters.BLOCK)}
    many = {"a": np.arange(3.0 * parameters.BLOCK).reshape(3, -1), "b": np.ones(2)}
    odd = parameters.from_arrays(spark, many)
    kept, problems = parameters.load(odd, big | {"c": (4,)}, strict=False)
    assert problems == [("b", "unexpected"), ("c", "missing")]
    assert (kept["a"] == many["a"]).all() and not kept["c"].any()
    with pytest.raises(ValueError, match=r"a \(shape\)"):
        parameters.load(odd, {"a": (2, 2)}, strict=False)
    with pytest.raises(ValueError, match="may be broadcast"):
        parameters.load(odd, {"a": (3, parameters.BLOCK), "b": (2,)}, most=10)


# --- graphs ----------------------------------------------------------------


def test_unit_head_against_plain_loops(spark):
    from cliploom.operators import graph

    spec = graph.UnitHead(5, 4, 3)
    p = fresh(spec.shapes(), 2)
    p |= {n: np.abs(v) + 0.5 for n, v in p.items() if n.endswith("var")}
    x = np.random.default_rng(3).standard_normal((2, 6, 5))
    node, cosine, logit = spec.forward(p, x)

    def affine(n, v, at):
        return (v - p[f"{n}.mean"][at]) / np.sqrt(p[f"{n}.var"][at] + 1e-5) * p[f"{n}.scale"][at] + p[f"{n}.shift"][at]

    def block(n, v):
        return np.maximum(np.stack([affine(f"{n}.norm", line(p, n, v)[:, c], c) for c in range(4)], 1), 0)

    def cross(n, y, z):
        q, k, v = (line(p, f"{n}.{part}", w) for part, w in (("query", y), ("key", z), ("value", z)))
        return np.stack([soft(k @ row / math.sqrt(2)) @ v for row in q])

    for b in range(2):
        whole = block("global", x[b])
        units = [block(f"unit{i}", whole) for i in range(3)]
        seen = [cross("to_map", u, whole) for u in units]
        v = [u.mean(0) for u in units]
        e = {(i, j): affine("edge.norm", line(p, "edge", cross("to_unit", seen[j], seen[i])), 3 * i + j).mean(0) for i in range(3) for j in range(3)}
        for k in range(2):
            w = {part: p[f"layer{k}.{part}"] for part in "uvabe"}
            e = {(i, j): s + np.maximum(affine(f"layer{k}.edge_norm", v[i] @ w["a"] + v[j] @ w["b"] + s @ w["e"], 3 * i + j), 0) for (i, j), s in e.items()}
            gate = {(i, c): soft(np.array([1 / (1 + math.exp(-e[i, j][c])) for j in range(3)])) for i in range(3) for c in range(4)}
            sent = [v[i] @ w["u"] + np.array([sum(gate[i, c][j] * (v[j] @ w["v"])[c] for j in range(3)) / 3 for c in range(4)]) for i in range(3)]
            v = [np.maximum(v[i] + affine(f"layer{k}.node_norm", sent[i], i), 0) for i in range(3)]
        for i in range(3):
            assert np.allclose(node[b, i], v[i])
            centre = np.maximum(p["centre"][i], 0)
            assert cosine[b, i] == pytest.approx(v[i] @ centre / max(np.linalg.norm(v[i]), 1e-12) / max(np.linalg.norm(centre), 1e-12))
            for j in range(3):
                assert np.allclose(logit[b, i, j], line(p, "edge_logit", e[i, j]))


def test_unit_head_reads_every_clip(spark):
    rows = chain_queries.unit_head(spark, DATA).collect()
    expected = {c for (c,) in duckdb.sql(f"SELECT DISTINCT vec_id // 12 FROM '{DATA}/embeddings.parquet'").fetchall()}
    assert {r["clip_id"] for r in rows} == expected and len(rows) == len(expected) * chain_queries.UNITS
    assert all(-1 <= r["cosine"] <= 1 for r in rows)


def test_gated_message_keeps_odd_rows(spark):
    from cliploom.operators import graph

    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, None), (3, []), (4, [0.5])], "graph_id int, x array<double>")
    got = {r["graph_id"]: r["x"] for r in graph.gated_message(df, "x").collect()}
    assert got[2] is None and got[3] == [] and got[4] == pytest.approx([0.5 * 1.5 + 0.5 * 0.8])
    gate = soft(np.array([1 / (1 + math.exp(-(0.3 * 1 - 0.2 * x))) for x in (1.0, -2.0)]))
    assert got[1][0] == pytest.approx(1.5 + 0.8 * (gate @ [1.0, -2.0]) / 2)

def test_calls_of_the_chain_are_bounded():
    """A call of as many clips as a chain takes at once holds little, and scoring keeps nothing of the way back."""
    spec, rng = chain_queries.small_chain(), np.random.default_rng(3)
    p = {n: rng.normal(size=s) for n, s in spec.shapes().items()}
    sizes = []
    for run in (spec.infer, spec.forward):
        tracemalloc.start()
        kept = run(p, {}, spec.step())
        sizes.append(tracemalloc.get_traced_memory())
        tracemalloc.stop()
        assert len(kept[0]) == spec.step()
    (left, peak), (held, _) = sizes
    assert peak < 2 * chain.CALL_BYTES and left < held / 4
    assert chain.Chain((chain.modality("rgb", 8, slots=1),), dim=4, heads=1, layers=1).step() == clips.STEP
    assert chain.Chain(tuple(chain.modality(m, 8, slots=400) for m in ("rgb", "fau")), dim=512, max_time_steps=400).step() == 1


def test_scoring_holds_one_part_whatever_the_layers():
    """Eight layers hold little more than one, and give what the forward pass gives."""
    rng, peaks = np.random.default_rng(4), {}
    for deep in (1, 8):
        spec = chain.Chain(chain_queries.small_chain().modalities, dim=32, heads=4, layers=deep)
        p = {n: 0.2 * rng.normal(size=s) for n, s in spec.shapes().items()}
        found = {m.name: clips.Ragged(np.arange(4), rng.normal(size=(4, 12, 4, 8)), rng.random((4, 12, 4)) < 0.9) for m in spec.modalities}
        for name, run in (("infer", spec.infer), ("forward", spec.forward)):
            tracemalloc.start()
            out = run(p, found, 4)
            peaks[name, deep] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            if name == "infer":
                scored = out
            else:
                assert all(np.array_equal(a, b) for a, b in zip(scored, out))
    assert peaks["infer", 8] < 1.2 * peaks["infer", 1] < peaks["forward", 8] / 2
