"""Cached extraction, extractors from elsewhere, guards, orders, resizing and pooling by layout."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import pooling, signal
from cliploom.operators import cache, extractors, guards, manifest
from cliploom.sources import tables

FILES = "path string, label int, size long, modified_ns long"


def run_cache(spark, rows, path, config=None, modalities=("rgb",)):
    """Runs the cache and says which paths were extracted."""
    asked = []

    def extract(missing):
        asked.extend(r["path"] for r in missing.collect())
        return missing.select("path", F.array(F.col("size").cast("double")).alias("features"), F.lit(2.0).alias("seconds"))

    done = cache.features(spark.createDataFrame(rows, FILES), extract, path, config or {"a": 1}, list(modalities))
    return sorted(asked), done


def test_only_what_is_missing_is_extracted(spark, tmp_path):
    rows, path = [(f"/v/{i}.mp4", i % 2, i, 5) for i in range(20)], f"{tmp_path}/store"
    first, done = run_cache(spark, rows, path)
    assert len(first) == 20 and (done.hits, done.misses) == (0, 20)
    second, done = run_cache(spark, rows, path)
    assert second == [] and (done.hits, done.misses) == (20, 0)
    assert {r["path"]: r["features"] for r in done.items.collect()} == {p: [float(s)] for p, _, s, _ in rows}
    times = done.timings.collect()
    assert {r["cache_status"] for r in times} == {"hit"} and {(r["load_seconds"], r["extract_seconds"]) for r in times} == {(0.0, 0.0)}
    rows[3] = ("/v/3.mp4", 1, 3, 6)
    third, done = run_cache(spark, [*rows, ("/v/new.mp4", 0, 77, 5)], path)
    assert third == ["/v/3.mp4", "/v/new.mp4"] and (done.hits, done.misses) == (19, 2)
    assert len(run_cache(spark, rows, path, {"a": 2})[0]) == 20
    both, done = run_cache(spark, rows, path, modalities=("rgb", "fau"))
    assert len(both) == 20 and {r["extract_seconds"] for r in done.timings.collect()} == {1.0}
    assert run_cache(spark, rows, path, modalities=("fau", "rgb"))[0] == both
    keep = cache.fingerprinted(spark.createDataFrame(rows, FILES), {"a": 1}, ["rgb"])
    assert cache.prune(spark, path, keep) == 2 + 20 + 20 + 20
    assert cache.prune(spark, path, keep) == 0
    assert run_cache(spark, rows, path)[0] == []
    assert cache.features(spark.createDataFrame([], FILES), lambda m: m, path, {}, ["rgb"]).items.collect() == []


def test_an_extractor_from_elsewhere(spark):
    class Ends:
        """First and last of a clip."""

        required = ("clip_id", "features")

        def __init__(self):
            self.seen = []

        @staticmethod
        def analyze(table):
            from pyspark.sql import types as T
            from pyspark.sql.udtf import AnalyzeResult

            extractors.needs(table, Ends.required)
            return AnalyzeResult(T.StructType().add("first", "double").add("last", "double"))

        def eval(self, row):
            self.seen.append(row["features"][0])

        def terminate(self):
            if self.seen:
                yield self.seen[0], self.seen[-1]

    known = extractors.Extractors()
    known.register("ends", Ends)
    frames = spark.createDataFrame([(c, t, [float(c * 10 + t)]) for c in range(4) for t in range(c + 1)], "clip_id long, t int, features array<double>").repartition(3)
    assert sorted(map(tuple, known.extract("ends", frames).collect())) == [(c * 10.0, c * 11.0) for c in range(4)]
    with pytest.raises(KeyError, match="smell"):
        known.extract("smell", frames)
    with pytest.raises(TypeError, match="lacks"):
        known.register("x", dict)
    with pytest.raises(Exception, match="needs features"):
        known.extract("ends", frames.drop("features")).collect()


def test_guards_raise_with_the_clip(spark):
    df = spark.createDataFrame([(1, 16), (2, 16), (77, 3), (5, None)], "clip_id long, n_frames int")
    good = guards.required(df.where("clip_id < 5"), guards.enough_frames(8))
    assert good.count() == 2 and len(good.collect()) == 2
    with pytest.raises(Exception, match="fewer than 8 frames: clip 77"):
        guards.required(df.where("clip_id <> 5"), guards.enough_frames(8)).collect()
    with pytest.raises(Exception, match="fewer than 8 frames: clip 5"):
        guards.required(df.where("clip_id = 5"), guards.enough_frames(8)).count()
    frames = spark.createDataFrame([(1, 2, 2, 3, bytes(12)), (9, 2, 2, 3, bytes(11))], "clip_id long, height int, width int, channels int, data binary")
    with pytest.raises(Exception, match="don't fit its size: clip 9"):
        guards.required(frames, guards.frame_shapes()).collect()
    bank = spark.createDataFrame([(1, [0.0], 0, 0), (4, [0.0], 9, 0)], "clip_id long, token array<double>, time_id int, modality_id int")
    with pytest.raises(Exception, match=r"time_id must be in 0\.\.7: clip 4"):
        guards.required(bank, guards.bank_tokens(1, 8, 2)).collect()
    with pytest.raises(Exception, match="a bank must have 2 places: clip 1"):
        guards.whole_banks(bank.where("clip_id = 1"), 2).collect()


def test_guards_cost_no_scan(spark):
    df = guards.required(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), {"has a vector": F.col("embedding").isNotNull()}, "vec_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_path_and_epoch_orders(spark):
    names = ["/a/b/c.mp4", "/a/b.mp4", "/a/b-1/c.mp4", "/a/b/c.mp4", "/Z/x.mp4"]
    rows = spark.createDataFrame([(n, k % 2) for k, n in enumerate(names)], "path string, label int").repartition(3)
    got = [(r["label"], r["path"]) for r in manifest.numbered_manifest(rows).orderBy("number").collect()]
    assert got == sorted(((k % 2, n) for k, n in enumerate(names)), key=lambda r: (r[0], r[1].split("/")))
    keys = spark.range(101).select(F.col("id").cast("string").alias("path"))
    order = lambda seed: [(r["epoch"], r["place"], r["path"], r["batch"]) for r in manifest.epoch_order(keys, 3, seed, 10).orderBy("epoch", "place").collect()]
    a = order(1)
    assert a == order(1) and a != order(2)
    assert [x[:2] for x in a] == [(e, p) for e in (1, 2, 3) for p in range(101)] and [x[3] for x in a[:101]] == [p // 10 for p in range(101)]
    assert all(sorted(x[2] for x in a if x[0] == e) == sorted(map(str, range(101))) for e in (1, 2, 3))
    assert [x[2] for x in a[:101]] != [x[2] for x in a[101:202]]
    with pytest.raises(ValueError):
        manifest.epoch_order(keys, 0, 1, 1)


@pytest.mark.parametrize(("source", "target"), [(7, 5), (8, 3), (6, 6), (9, 1), (12, 4)])
def test_area_resize_is_the_mean_of_the_area(spark, source, target):
    x = np.random.default_rng(source).random((source, source))
    df = spark.createDataFrame([(1, i, j, float(x[i, j])) for i in range(source) for j in range(source)], "frame_id int, y int, x int, v double")
    got = {(r["y"], r["x"]): r["v"] for r in signal.area_resize(df, source, target).collect()}
    fine = np.kron(x, np.ones((target, target)))
    want = fine.reshape(target, source, target, source).mean((1, 3))
    assert got == pytest.approx({(i, j): want[i, j] for i in range(target) for j in range(target)})
    with pytest.raises(ValueError):
        signal.area_resize(df, source, source + 1)


def test_one_mean_from_all_layouts(spark):
    x = np.random.default_rng(1).random((2, 3, 5))  # y, x, channel
    layouts = {"last": x.tolist(), "first": x.transpose(2, 0, 1).tolist()}
    mean = x.mean((0, 1))
    for kept in layouts.values():
        df = spark.createDataFrame([(kept,)], "h array<array<array<double>>>")
        assert np.allclose(df.select(pooling.spatial_mean(F.col("h"), 3, 5)).first()[0], mean)
    df = spark.createDataFrame([(layouts["first"],)], "h array<array<array<double>>>")
    assert np.allclose(df.select(pooling.spatial_mean(F.col("h"), 3)).first()[0], mean)
    with pytest.raises(Exception, match="no axis of a hidden map has 7 channels: 5x2x3"):
        df.select(pooling.spatial_mean(F.col("h"), 3, 7)).collect()
    tokens = x.reshape(6, 5).tolist()
    rows = spark.createDataFrame([(tokens, [[9.0] * 5, *tokens])], "a array<array<double>>, b array<array<double>>")
    got = rows.select(pooling.spatial_mean(F.col("a"), 2, 5), pooling.spatial_mean(F.col("b"), 2, 5, drop_class=True)).first()
    assert np.allclose(got[0], mean) and np.allclose(got[1], mean)
    with pytest.raises(Exception, match="must have 4 numbers, not 5"):
        rows.select(pooling.spatial_mean(F.col("a"), 2, 4)).collect()


def test_first_existing_and_routing(spark):
    tried = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "item int, ord int, path string")
    there = spark.createDataFrame([("c",), ("b",), ("b",)], "path string")
    assert sorted(map(tuple, manifest.first_existing(tried, there).collect())) == [(1, "b"), (2, None)]
    batch = spark.createDataFrame([(1, "all"), (2, "every")], "clip_id int, frames string")
    own = spark.createDataFrame([(1, "rgb", "mine")], "clip_id int, modality string, frames string")
    assert sorted(map(tuple, manifest.routed(batch, own, ["rgb", "fau"]).collect())) == [(1, "fau", "all"), (1, "rgb", "mine"), (2, "fau", "every"), (2, "rgb", "every")]


def test_summary_is_one_indented_file(spark, tmp_path):
    row = spark.createDataFrame([(3, None, ["a"])], "z int, b string, m array<string>")
    tables.write_summary(row, f"{tmp_path}/s")
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert json.loads(text) == {"b": None, "m": ["a"], "z": 3}
    assert text.startswith('{\n  "b": null') and text.endswith("}\n")
    with pytest.raises(ValueError, match="one row"):
        tables.write_summary(row.union(row), f"{tmp_path}/t")
