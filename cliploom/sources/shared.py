"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, in the folder that ``spark.checkpoint.dir`` names or that was set on the context; a local session without one gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = on_context.get() if on_context.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="cliploom-files-")
        atexit.register(shutil.rmtree, own, True)
        named = f"file://{own}"
    return f"{named.rstrip('/')}/cliploom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once and read back, without upstream lineage."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _located(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    store, place = _located(spark, path)
    store.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no folder."""
    store, place = _located(spark, path)
    return [str(s.getPath().getName()) for s in store.listStatus(place)] if store.exists(place) else []


def claim(spark: SparkSession, path: str) -> bool:
    """Make a folder one's own: False if somebody else has. A file in it that only one can create decides."""
    store, place = _located(spark, f"{path}/_claimed")
    return bool(store.createNewFile(place))
