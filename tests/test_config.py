import pytest
from pyspark.sql import functions as F

from cliploom.operators import checks, config, training


def test_frame_counts_take_the_nearest_setting():
    settings = {"frames": {"default": 16, "rppg": 32}, "rgb": {"frames": 8}}
    assert [config.frame_count(settings, m) for m in ("rgb", "rppg", "face_mesh")] == [8, 32, 16]
    assert config.frame_count({"frames": 4}, "rgb") == 4
    with pytest.raises(ValueError, match="no frame count"):
        config.frame_count({}, "rgb")
    with pytest.raises(ValueError, match="rgb.frames"):
        config.frame_count({"rgb": {"frames": True}}, "rgb")


def test_slots_and_time_steps():
    assert config.slot_count({"rppg": {"slot_count": 16}}, "rppg") == 16
    assert config.slot_count({}, "fau") == 32
    with pytest.raises(ValueError, match="rppg.slot_count"):
        config.slot_count({"rppg": {"slot_count": 0}}, "rppg")
    with pytest.raises(KeyError):
        config.slot_count({}, "text")
    config.check_time_steps({}, 32)
    with pytest.raises(ValueError, match="max_time_steps is 31"):
        config.check_time_steps({}, 31)


def test_head_separates(spark):
    rows = spark.createDataFrame([([-2.0],  0), ([-1.5], 0), ([1.5], 1), ([2.0], 1)], "feature array<double>, label int")
    out = training.apply_head(rows, training.train_head(rows))
    assert out.where(F.col("prediction") != F.col("label")).isEmpty()


def test_only_single_detections_count(spark):
    frames = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "clip_id int, frame_idx int")
    found = spark.createDataFrame([(1, 0, [0.5]), (1, 1, [0.1]), (1, 1, [0.2])], "clip_id int, frame_idx int, vector array<double>")
    got = {r["frame_idx"]: r["vector"] for r in checks.single_detections(frames, found, 1, -1.0).collect()}
    assert got == {0: [0.5], 1: [-1.0], 2: [-1.0]}
