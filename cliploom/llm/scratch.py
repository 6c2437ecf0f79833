"""Shared scratch tables.

Long plans cut their lineage by writing a Parquet table into the folder that
``spark.checkpoint.dir`` names (or that was set on the context), which every executor
and the driver can see. Only a local session that names none uses a temporary folder
of this process; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table goes to every task only up to this many rows (of a few numbers each); beyond it, a join shuffles both sides.
BROADCAST_ROWS = 500_000
#: A join with texts is done in up to so many parts, to keep each within that; beyond it, it shuffles the texts.
MOST_PARTS = 8
#: Spark's setting that removes a query's shuffle files when the query ends.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, list[str]] = defaultdict(list)
_owner: ContextVar[str] = ContextVar("owner", default="")
_own: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = on_context.get() if on_context.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="cliploom-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/cliploom-{label}-{uuid.uuid4().hex}"
    _made[_owner.get()].append(path)
    return path


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Tables made inside belong to ``name``, and only :func:`release` of that name deletes them."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession, name: str = "") -> None:
    """Delete the tables of ``name`` (those without an owner, if empty). Results that still read them must have been written."""
    made = _made.pop(name, [])
    while made:
        delete(spark, made.pop())


def drop(table: DataFrame) -> None:
    """Delete a written table that nothing will read again, before its owner is released."""
    names = {f.rsplit("/", 2)[1] for f in table.inputFiles()}
    for made in _made.values():
        for path in [p for p in made if p.rsplit("/", 1)[1] in names]:
            delete(table.sparkSession, path)
            made.remove(path)


def parts(rows: int) -> int:
    """In how many parts a table of so many rows is joined with texts."""
    return max(1, min(MOST_PARTS, -(-rows // BROADCAST_ROWS)))


def narrow(table: DataFrame, lists: str | None = None) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it is of checked size.

    ``lists`` names a column of arrays, whose entries count as rows.
    """
    rows = table.count() if lists is None else table.select(F.sum(F.size(lists) + 1)).first()[0] or 0
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table.

    The result has no upstream lineage: a lost executor costs a re-read of the
    table, not a re-run of what made it. The shuffles of the write are deleted when it
    has ended, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _short_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files at their end; then the session is as before."""
    before = spark.conf.get(SHORT_SHUFFLES, None)
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHORT_SHUFFLES)
        else:
            spark.conf.set(SHORT_SHUFFLES, before)
