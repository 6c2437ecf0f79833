"""Cache-aside extraction: features are kept by what they were made of, and only what is missing is extracted.

The store is a Parquet folder with a row for each item, in shelves by the first
digits of its fingerprint. So a lookup reads the fingerprints of the shelves it needs,
new items are appended, and dropping stale ones rewrites their shelves alone.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.sources.shared import delete, exists, written
from cliploom.sources.tables import file_record

STORE = "fingerprint string, path string, features array<double>, seconds double, shelf string"
#: Hexadecimal digits that name a shelf.
SHELF = 2


def fingerprinted(files: DataFrame, config: Mapping, modalities: Sequence[str], version: int = 1) -> DataFrame:
    """``files`` (path, size, modified_ns, label and more) with fingerprint and shelf: SHA-256 over configuration, ordered modalities and the file's own record."""
    head = json.dumps({"config": config, "modalities": list(modalities)}, sort_keys=True, separators=(",", ":"))
    return files.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit(head), file_record(version)), 256)).withColumn("shelf", F.substring("fingerprint", 1, SHELF))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; none if there is no store yet."""
    return spark.read.schema(STORE).parquet(path) if exists(spark, path) else spark.createDataFrame([], STORE)


@dataclass
class Cached:
    """``items``: the files with features. ``timings``: a row for each file and modality."""

    items: DataFrame
    timings: DataFrame
    hits: int
    misses: int


def features(files: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, config: Mapping, modalities: Sequence[str]) -> Cached:
    """Features of all files, extracted only for those whose fingerprint the store lacks.

    ``extract`` gets the missing files and returns path, features and seconds; each of
    its modalities bears an equal part of a file's seconds. Those of a hit bear equal
    parts of the time that the lookup took, and no load or extraction. Files that are
    alike in all that counts share one stored item. A store that two runs filled at
    once may hold an item twice; one is read.
    """
    spark, began = files.sparkSession, time.perf_counter()
    marked = written(fingerprinted(files, config, modalities), "marked")
    known = stored(spark, path).select("shelf", "fingerprint").distinct()
    state = written(marked.join(known.withColumn("known", F.lit(True)), ["shelf", "fingerprint"], "left").withColumn("cache_status", F.when(F.col("known"), "hit").otherwise("miss")).drop("known"), "state")
    counts = {r["cache_status"]: r["count"] for r in state.groupBy("cache_status").count().collect()}
    hits, misses = counts.get("hit", 0), counts.get("miss", 0)
    looked = time.perf_counter() - began
    if misses:
        missing = state.where("cache_status = 'miss'").drop("cache_status")
        made = extract(missing.dropDuplicates(["fingerprint"])).select("path", "features", "seconds")
        rows = missing.select("fingerprint", "path", "shelf").dropDuplicates(["fingerprint"]).join(made, "path").select("fingerprint", "path", "features", "seconds", "shelf")
        rows.repartition("shelf").write.mode("append").partitionBy("shelf").parquet(path)
    kept = stored(spark, path).join(marked.select("shelf", "fingerprint").distinct(), ["shelf", "fingerprint"], "left_semi").groupBy("shelf", "fingerprint").agg(F.first("features").alias("features"), F.max("seconds").alias("seconds"))
    items = state.join(kept, ["shelf", "fingerprint"])
    hit, n = F.col("cache_status") == "hit", len(modalities)
    share = F.lit(looked / max(hits * n, 1))
    spent = F.when(hit, 0.0).otherwise(F.col("seconds") / n)
    timings = items.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in modalities]))).select("path", "label", "modality", F.when(hit, share).otherwise(spent).alias("elapsed_seconds"), F.lit(0.0).alias("load_seconds"), spent.alias("extract_seconds"), "cache_status", F.lit(path).alias("cache_path"))
    return Cached(items.drop("seconds", "shelf"), timings, hits, misses)


def prune(spark: SparkSession, path: str, keep: DataFrame) -> int:
    """Drop the items whose fingerprint isn't in ``keep``, and say how many there were. Only shelves with such items are written again."""
    stale = written(stored(spark, path).select("shelf", "fingerprint").join(keep.select("fingerprint").distinct(), "fingerprint", "left_anti"), "stale")
    if not (n := stale.count()):
        return 0
    shelves = F.broadcast(stale.select("shelf").distinct())
    left = written(stored(spark, path).join(shelves, "shelf", "left_semi").join(stale.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*[c.split()[0] for c in STORE.split(", ")]), "left")
    emptied = [r["shelf"] for r in stale.select("shelf").distinct().join(left.select("shelf").distinct(), "shelf", "left_anti").collect()]
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf").parquet(path)
    for shelf in emptied:
        delete(spark, f"{path}/shelf={shelf}")
    return n
