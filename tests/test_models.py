import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import numeric, signal
from cliploom.operators import attention, heads, reports, sampling, subsets, token_bank


def test_frame_sampling_rounds_half_to_even(spark):
    frames = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 0)], "clip_id string, frame_idx int")
    got = [r["frame_idx"] for r in sampling.frame_sample(frames, 3).orderBy("slot").collect()]
    assert got == [0, 4, 7]  # 3.5 goes to 4
    assert [(r["clip_id"], r["frame_idx"]) for r in sampling.frame_sample(frames, 1).orderBy("clip_id").collect()] == [("a", 0), ("b", 0)]
    with pytest.raises(ValueError, match="positive"):
        sampling.frame_sample(frames, 0)


def test_stft_against_numpy(spark):
    v = np.random.default_rng(1).normal(size=16)
    got = signal.stft(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "clip_id int, t int, v double")).toPandas()
    padded, window = np.pad(v, 4, mode="reflect"), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8)
    want = np.array([np.log1p(np.abs(np.fft.rfft(padded[w * 2 : w * 2 + 8] * window))) for w in range(9)])
    assert np.allclose(got.pivot(index="w", columns="k", values="logmag").to_numpy(), want)


def test_both_spectra_agree_with_numpy(spark):
    n, bins = 8, 4
    x = np.random.default_rng(2).random((2, n, n))
    long = spark.createDataFrame([(f, i, j, float(x[f, i, j])) for f in range(2) for i in range(n) for j in range(n)], "frame_id int, y int, x int, v double")
    wide = spark.createDataFrame([(f, [(i, j, float(x[f, i, j])) for i in range(n) for j in range(n)]) for f in range(2)], "frame_id int, pixels array<struct<y int, x int, v double>>")
    a = signal.radial_spectrum(long, n, bins).orderBy("frame_id", "bin").toPandas()
    b = signal.radial_spectrum_arrow(wide, n, bins).orderBy("frame_id", "bin").toPandas()
    assert np.allclose(a["value"], b["value"])
    assert len(a) == 2 * bins


def test_pooling_order_matters_only_with_time(spark):
    rows = [(1, t, 0, [float(np.sin(t * 3 + d)) for d in range(8)]) for t in range(5)]
    turned = [(c, 4 - t, e, v) for c, t, e, v in rows]
    frame = lambda r: spark.createDataFrame(r, "clip_id int, t int, element int, features array<double>")
    pool = lambda r, temporal: attention.latent_pool(frame(r), 2, temporal).orderBy("slot", "d").toPandas()["v"].to_numpy()
    assert np.allclose(pool(rows, False), pool(turned, False))
    assert not np.allclose(pool(rows, True), pool(turned, True))


def test_gelu(spark):
    got = [r[0] for r in spark.createDataFrame([(-2.0,), (0.0,), (1.5,)], "x double").select(numeric.gelu(F.col("x"))).collect()]
    assert np.allclose(got, [-0.0455003, 0.0, 1.3997892], atol=1e-6)


def bank_of(spark, modalities):
    slots = {name: n for name, n, _ in subsets.LAYOUT}
    rows = [(1, m, s, [float(s + i) for i in range(4)]) for m in modalities for s in range(slots[m])]
    tokens = spark.createDataFrame(rows, "clip_id int, modality string, slot int, token array<double>")
    return token_bank.token_bank(tokens, tokens, 4)


@pytest.mark.parametrize(("modalities", "used"), [(("rgb", "rppg"), [*range(8), *range(40, 44)]), (("depth",), [64, 65, 66, 67]), (("face_mesh", "rppg"), [*range(40, 44), *range(48, 64)])])
def test_bank_mask(spark, modalities, used):
    bank = bank_of(spark, modalities).orderBy("pos").collect()
    assert [r["pos"] for r in bank] == list(range(76))
    assert [r["pos"] for r in bank if r["mask"]] == used
    assert all(r["token"] == [0.0] * 4 for r in bank if not r["mask"])


def test_masked_places_leave_the_class_token(spark):
    bank = bank_of(spark, ("rgb",))
    noisy = bank.withColumn("token", F.when(F.col("mask"), F.col("token")).otherwise(F.array(*[F.lit(9.0)] * 4)))
    assert np.allclose(*([r["v"] for r in token_bank.fuse(b, heads=2).orderBy("d").collect()] for b in (bank, noisy)))


def test_modality_sets(spark):
    got = [(r["set_id"], r["name"]) for r in subsets.modality_sets(spark, ("rgb", "fau")).orderBy("set_id").collect()]
    assert got == [(1, "rgb"), (2, "fau"), (3, "rgb__fau")]
    assert [r["name"] for r in subsets.modality_sets(spark, ("rgb", "fau"), "none").collect()] == ["rgb__fau"]


def test_miss_rates(spark):
    rows = spark.createDataFrame([(1, 4), (0, 0), (None, 3)], "m int, c int")
    assert [r[0] for r in rows.select(numeric.miss_rate_percent(F.col("m"), F.col("c"))).collect()] == [25.0, None, None]


def test_seen_summary(spark):
    rows = spark.createDataFrame([("test", True, 1, 1), ("test", True, 0, 1), ("train", True, 0, 1)], "split string, seen_in_train boolean, label int, prediction int")
    r = reports.seen_summary(rows).first()
    assert (r["count"], r["misses"], r["accuracy"]) == (2, 1, 0.5)


def test_threshold_is_inclusive(spark):
    assert heads.predict(spark.createDataFrame([(0.0,)], "logit double")).first()["prediction"] == 1


def test_gathering_points(spark):
    df = spark.createDataFrame([([[1.5, -0.5, -2.0]],)], "p array<array<double>>")
    assert df.select(heads.gather_points(F.col("p"), (0, 7))).first()[0] == [[1.0, 0.0, -2.0], [-1.0, -1.0, -1.0]]


def test_fusion_sees_every_embedding(spark):
    from cliploom.plans import model_queries

    ids = [r["vec_id"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id").collect()]
    clips = {r["clip_id"] for r in model_queries.fusion_cls(spark, "/root/testdata/sf0.001").select("clip_id").distinct().collect()}
    assert clips == {i // 12 for i in ids}
    tokens = model_queries._tokens(spark, "/root/testdata/sf0.001")
    assert tokens.count() == tokens.select("clip_id", "modality", "slot").distinct().count() == len(ids)


def test_whole_vectors_are_read(spark, tmp_path):
    from cliploom.plans import model_queries

    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 20))
    y = x.copy()
    y[:, 16:] += 1.0  # told apart by the last components only
    for name, z in (("x", x), ("y", y)):
        spark.createDataFrame([(i, i % 2, z[i].tolist()) for i in range(6)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    for query in (model_queries.gelu_mlp, model_queries.two_stage_pool, model_queries.fusion_cls):
        assert sorted(map(tuple, query(spark, f"{tmp_path}/x").collect())) != sorted(map(tuple, query(spark, f"{tmp_path}/y").collect()))
    got = model_queries.gelu_mlp(spark, f"{tmp_path}/x").toPandas().set_index(["clip_id", "t", "d"])["v"]
    table = lambda a, b, p: 0.02 * np.sin(12.9898 * np.arange(a)[:, None] + 78.233 * np.arange(b) + p)
    h = np.float32(x).astype(float) @ table(20, 32, 0)
    want = (0.5 * h * (1 + np.vectorize(math.erf)(h / math.sqrt(2)))) @ table(32, 8, 1)
    assert all(got[0, i, d] == pytest.approx(want[i, d], abs=1e-6) for i in range(6) for d in range(8))


def test_trained_head_is_the_maximum_of_the_likelihood(spark):
    """Against Newton's method in plain numpy, on the whole table."""
    from cliploom.plans import check_queries

    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.c_[np.array([r["embedding"] for r in rows], float), np.ones(len(rows))]
    y = np.array([r["label"] >= 5 for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(len(w)), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ w))
    got = {r["vec_id"]: r for r in check_queries.trained_head(spark, data).collect()}
    assert len(got) == len(rows)
    for r, q in zip(rows, p, strict=True):
        assert got[r["vec_id"]]["probability"] == pytest.approx(q, abs=5e-3)
        assert got[r["vec_id"]]["prediction"] == (got[r["vec_id"]]["probability"] >= 0.5)
