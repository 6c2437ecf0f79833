import pytest
from pyspark.sql import functions as F

from cliploom.functions import paths
from cliploom.operators import manifest
from cliploom.sources import tables


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "p string").select(expression(F.col("p"))).first()[0]


@pytest.mark.parametrize(
    ("path", "real", "fake"),
    [
        ("/r/abcdEFGhijk_00_00_01part1_f.mp4", "abcdEFGhijk", "abcdEFGhijk_00_00_01part1_f"),
        ("/f/f1/clipA_clip_1_0_20_swapped.mp4", "clipA", "clipA"),
        ("/f/x_swapped.mp4", "x", "x"),
        ("plain.mp4", "plain.mp4", "plain"),
    ],
)
def test_source_ids(spark, path, real, fake):
    assert one(spark, path, paths.real_source_id) == real
    assert one(spark, path, paths.fake_source_id) == fake


def test_names(spark):
    assert one(spark, "/a/b/c.tar.MP4", paths.suffix) == ".MP4"
    assert one(spark, "/a/b/c.tar.MP4", paths.stem) == "c.tar"
    assert one(spark, "/a/b/c", paths.suffix) == ""
    assert one(spark, "/a/b/c", paths.parent_name) == "b"
    assert one(spark, "run_010", paths.run_index) == 10
    assert one(spark, "run_x", paths.run_index) is None
    assert one(spark, "a.a.b.a.c", lambda c: paths.strip_prefixes(c, ["a.", "b."])) == "c"


@pytest.mark.parametrize(("n", "cuts"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (5, (3, 1, 1)), (10, (8, 1, 1)), (40, (32, 4, 4))])
def test_split_sizes(spark, n, cuts):
    rows = spark.createDataFrame([(f"s{i}",) for i in range(n) for _ in range(2)], "source_id string")
    got = {r["split"]: r["count"] for r in manifest.group_split(rows, "source_id").groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in manifest.SPLITS) == cuts


def test_split_repeats_and_follows_seed(spark):
    rows = spark.createDataFrame([(f"s{i}",) for i in range(30)], "source_id string")
    a, b, c = (sorted(manifest.group_split(rows, "source_id", seed=s).collect()) for s in (0, 0, 1))
    assert a == b != c
    with pytest.raises(ValueError, match="ratios"):
        manifest.group_split(rows, "source_id", train_ratio=0.9, val_ratio=0.2)


def test_manifest_round_trip(spark, tmp_path):
    files = ["real/q_1.mp4", "real/z_1.mp4", "real/a_1.mp4", "fake/f1/a_clip_1.mp4", "fake/f1/b_clip_2.mp4", "fake/f2/c_clip_1.mp4"]
    for f in [*files, "real/no.txt", "fake/top.mp4"]:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    real, fake = tables.discover(spark, str(tmp_path / "real"), str(tmp_path / "fake"))
    built = manifest.build_manifest(manifest.labelled_rows(real, 0), manifest.labelled_rows(fake, 1))
    tables.write_manifest(built, str(tmp_path / "out"))
    back = tables.read_manifest(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, built.collect()), key=str)
    assert back.count() == 6
    assert back.where("label = 0 AND identity_id IS NOT NULL").isEmpty()
    assert {r["identity_id"] for r in back.where("label = 1").collect()} == {"f1", "f2"}
    summary = {r["split"]: (r["real"], r["fake"], r["total"]) for r in manifest.split_summary(back).collect()}
    assert summary == {"train": (1, 1, 2), "val": (1, 1, 2), "test": (1, 1, 2)}
    with pytest.raises(ValueError, match="unknown split"):
        tables.read_manifest(spark, str(tmp_path / "out"), "dev")


def test_discover_needs_both_sides(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "fake/a").mkdir(parents=True)
    (tmp_path / "real/a.mp4").write_bytes(b"x")
    with pytest.raises(FileNotFoundError, match="fake"):
        tables.discover(spark, str(tmp_path / "real"), str(tmp_path / "fake"))


def test_labelled_folder(spark, tmp_path):
    for f in ("real/a.MP4", "real/ignored.txt", "fake/b.webm"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    rows = tables.labelled_folder(spark, str(tmp_path), "test").orderBy("label").collect()
    assert [(r["label"], r["source_id"], r["class_name"]) for r in rows] == [(0, "a", "real"), (1, "b", "fake")]


def test_feature_cache(spark, tmp_path):
    files = spark.createDataFrame([("a.mp4", 1, 5, 7), ("b.mp4", 0, 6, 8)], "path string, label int, size long, modified_ns long")
    mark = tables.fingerprint(files, {"image": 224}, ["rgb", "fft"]).first()[0]
    assert mark == tables.fingerprint(files.orderBy(F.col("path").desc()), {"image": 224}, ["rgb", "fft"]).first()[0]
    assert mark != tables.fingerprint(files, {"image": 224}, ["fft", "rgb"]).first()[0]
    where = str(tmp_path / "cache")
    assert tables.read_features(spark, where, mark) is None
    tables.write_features(files, where, mark)
    assert tables.read_features(spark, where, mark).count() == 2
