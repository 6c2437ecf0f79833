"""Experiments over modality sets, their files, and configurations."""

import json

import pytest

from cliploom.operators import chain, config, experiment, parameters
from cliploom.plans import chain_queries
from cliploom.sources import tables

FRAMES = "path string, class_name string, label int, split string, modality string, t int, element int, features array<double>"


def frames(spark, n=12):
    rows = []
    for c in range(n):
        label, split = c % 2, "test" if c % 3 == 0 else "train"
        path = f"/{split}/{c}/{c % 6}.mp4"
        for m in ("rgb", "fau"):
            rows += [(path, "fake" if label else "real", label, split, m, t, 0, [1.0 if label else -1.0, c / n, t / 3]) for t in range(3)]
    return spark.createDataFrame(rows, FRAMES)


SPEC = chain.Chain(tuple(chain.modality(m, 3, 2) for m in ("rgb", "fau")), dim=8, heads=2, layers=1)


def test_sets_share_features_and_leave_their_files(spark, tmp_path):
    root = f"{tmp_path}/runs"
    results = experiment.run(frames(spark), SPEC, root, 6, "all", rate=0.05)
    assert [r.name for r in results] == ["rgb", "fau", "rgb__fau"]
    assert [r.folder for r in results] == [f"{root}/run_001/modality_permutations/{r.name}" for r in results]
    for r in results:
        row = r.report.first()
        assert (row["train_count"], row["predict_count"]) == (8, 4)
        assert row["predict_seen_count"] + row["predict_unseen_count"] == 4
        metrics = tables.read_metrics(spark, f"{r.folder}/metrics").orderBy("epoch").collect()
        assert [m["epoch"] for m in metrics] == list(range(1, 7))
        assert metrics[-1]["train_loss"] < metrics[0]["train_loss"]
        said = json.loads("".join(p.read_text() for p in (tmp_path / r.folder[len(str(tmp_path)) + 1 :] / "summary").glob("part-*")))
        assert said["modality_set"] == r.name and said["predict_count"] == 4 and said["overlap_count"] == row["overlap_count"]
        own = parameters.read(spark, f"{r.folder}/best")
        assert {x["name"].split(".")[0] for x in own.select("name").distinct().collect()} == {*r.name.split("__"), "fusion", "head"}
        rows = spark.read.option("header", True).csv(f"{r.folder}/predictions").collect()
        assert len(rows) == 12
        train = {(x["class_name"], x["path"].rsplit("/", 1)[-1]) for x in rows if x["split"] == "train"}
        assert all((x["seen_in_train"] == "1") == ((x["class_name"], x["path"].rsplit("/", 1)[-1]) in train) for x in rows)


def test_one_set_fills_the_run_folder(spark, tmp_path):
    root = f"{tmp_path}/runs"
    (tmp_path / "runs" / "run_007").mkdir(parents=True)
    (tmp_path / "runs" / "notes.txt").write_text("x")
    (result,) = experiment.run(frames(spark), SPEC, root, 1)
    assert result.folder == f"{root}/run_008"
    assert {"best", "metrics", "predictions", "summary"} <= {p.name for p in (tmp_path / "runs" / "run_008").iterdir()}
    assert experiment.next_folder(spark, root) == f"{root}/run_009"
    with pytest.raises(ValueError, match="not among"):
        experiment.run(frames(spark), SPEC, root, 1, sets=[("depth",)])


def test_experiment_query_counts_every_clip(spark):
    rows = {r["modality_set"]: r for r in chain_queries.experiment_sets(spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"rgb", "rgb__fau__eye_gaze"}
    clips = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id div 12 as c").distinct().collect()
    for r in rows.values():
        assert r["train_count"] == sum(c["c"] % 4 > 0 for c in clips) and r["predict_count"] == sum(c["c"] % 4 == 0 for c in clips)
        assert r["predict_seen_count"] + r["predict_unseen_count"] == r["predict_count"]


def test_a_set_sends_its_own_tokens_only(spark, tmp_path, monkeypatch):
    """Training and scoring get no tokens of other modalities, and all clips, those without any token of the set too."""
    sent = []
    for module, name in ((experiment.training, "train_chain"), (experiment.chain, "logits")):
        monkeypatch.setattr(module, name, lambda rows, spec, *a, f=getattr(module, name), **k: sent.append((rows, {m.name for m in spec.modalities})) or f(rows, spec, *a, **k))
    rows = frames(spark)
    rows = rows.where("NOT (modality = 'rgb' AND path LIKE '%/5/%')").unionByName(rows.where("modality = 'fau'").selectExpr("path", "class_name", "label", "split", "'depth' AS modality", "t", "element", "features"))
    results = experiment.run(rows, SPEC, f"{tmp_path}/runs", 1, sets=[("rgb",), ("rgb", "fau")])
    assert len(sent) == 4
    for df, names in sent:
        got = df.select("tokens.modality").collect()
        assert {m for r in got for m in r["modality"]} == names and sum(not r["modality"] for r in got) == (len(names) == 1)
    for r in results:
        row = r.report.first()
        assert (row["train_count"], row["predict_count"]) == (8, 4)


YAML = """
modalities: [stft, " rgb ", fau]
dim: 8
fusion: {num_layers: 1, num_heads: 2, mlp_ratio: 2, max_time_steps: 32, checkpoint_path: null}
rgb: {slot_count: 3}
"""


def test_configuration_makes_a_chain(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    for session in (None, spark):
        c = config.load_yaml(f"{tmp_path}/c.yaml", session)
        spec = config.chain_of(c, {"rgb": 5, "fau": 6, "stft": 7, "depth": 8})
        assert [(m.name, m.width, m.slots) for m in spec.modalities] == [("rgb", 5, 3), ("fau", 6, 32), ("stft", 7, 4)]
        assert (spec.dim, spec.heads, spec.layers, spec.ratio, spec.max_time_steps) == (8, 2, 1, 2.0, 32)
        assert [m.name for m in config.chain_of(c, {"depth": 8}, ["depth"]).modalities] == ["depth"]
    assert c.section("fusion").path("checkpoint_path") is None


@pytest.mark.parametrize(("change", "problem"), [
    ({"dim": True}, "dim must be a whole number, not True"),
    ({"dim": None}, "dim must be a whole number"),
    ({"fusion": 3}, "fusion must be a mapping"),
    ({"fusion": {"max_time_steps": 31}}, "31, fau needs 32"),
    ({"fusion": {"max_time_steps": 64, "num_heads": 2, "num_layers": 1, "mlp_ratio": "x"}}, "fusion.mlp_ratio must be a number"),
    ({"modalities": []}, "modalities must be a list of names"),
    ({"modalities": ["rgb", 3]}, "modalities must be a list of names"),
    ({"modalities": ["smell"]}, "no place for smell"),
    ({"modalities": ["depth"]}, "no features for depth"),
    ({"rgb": {"slot_count": 0}}, "rgb.slot_count"),
])
def test_broken_configurations_say_where(change, problem):
    good = {"modalities": ["rgb"], "dim": 8, "fusion": {"num_layers": 1, "num_heads": 2, "mlp_ratio": 2.0, "max_time_steps": 64}}
    assert config.chain_of(config.Section(good), {"rgb": 1}).dim == 8
    with pytest.raises(ValueError, match=problem):
        config.chain_of(config.Section(good | change), {"rgb": 1})


def test_paths_and_roots(tmp_path):
    assert config.Section({"p": " a "}, "x.").path("p") == "a"
    with pytest.raises(ValueError, match="x.p must be a text"):
        config.Section({"p": " "}, "x.").path("p")
    (tmp_path / "list.yaml").write_text("[1]")
    with pytest.raises(ValueError, match="root"):
        config.load_yaml(f"{tmp_path}/list.yaml")


def test_commands(spark, tmp_path, capsys):
    from cliploom.__main__ import main

    for f in ("real/a_1.mp4", "real/b_1.mp4", "real/c_1.mp4", "fake/x/a_clip_1.mp4", "fake/x/b_clip_1.mp4", "fake/y/c_swapped.mp4"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    assert main(["manifest", f"{tmp_path}/real", f"{tmp_path}/fake", f"{tmp_path}/m"], spark) == 0
    assert sorted(capsys.readouterr().out.split("\n"))[1:] == ["test: real=1 fake=1 total=2", "train: real=1 fake=1 total=2", "val: real=1 fake=1 total=2"]
    frames(spark).write.parquet(f"{tmp_path}/features")
    (tmp_path / "c.yaml").write_text("{modalities: [rgb, fau], dim: 8, fusion: {num_layers: 1, num_heads: 2, mlp_ratio: 2, max_time_steps: 32}}")
    given = [f"{tmp_path}/c.yaml", f"{tmp_path}/features"]
    assert main(["run", *given, f"{tmp_path}/runs", "--epochs", "2", "--modalities", "rgb"], spark) == 0
    assert f"in {tmp_path}/runs/run_001" in capsys.readouterr().out
    assert main(["predict", *given, f"{tmp_path}/runs/run_001/best", f"{tmp_path}/p", "--modalities", "rgb"], spark) == 0
    key = lambda r: (r["path"], r["probability"])
    read = lambda p: sorted(map(key, spark.read.option("header", True).csv(p).collect()))
    assert read(f"{tmp_path}/p") == read(f"{tmp_path}/runs/run_001/predictions")
    with pytest.raises(ValueError, match="missing"):
        main(["predict", *given, f"{tmp_path}/runs/run_001/best", f"{tmp_path}/q"], spark)
    spark.createDataFrame([("rgb", [1.0]), ("rgb", [1.0, 2.0])], "modality string, features array<double>").write.parquet(f"{tmp_path}/odd")
    with pytest.raises(ValueError, match="several widths: rgb"):
        main(["run", given[0], f"{tmp_path}/odd", f"{tmp_path}/runs"], spark)
