"""Global row numbers without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.sources.shared import written

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = 33


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number", start: int = 0, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``df`` with ``name``: the place of each row in the rising order of ``order`` (nulls first), from ``start``.

    Rows are dealt by ranges of the order and sorted within them; a row's number is
    its place in its range plus the rows of the ranges before, of which there are as
    many as partitions. Rows that tie get different numbers in no fixed order, and all
    rows of one value land in one range, so ``order`` should end with a column that
    tells rows apart. ``df`` is read twice (its ranges are sampled) and should be a
    table; ``write`` stores the sorted rows and returns the stored table. An empty
    table gives an empty one. A column called ``name`` is replaced, other names are free.
    """
    kept = [c for c in df.columns if c != name]
    keys = [df[f"`{c}`"] if isinstance(c, str) else c for c in order]
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in kept]).alias("row"), *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    sort = [f"key{i}" for i in range(len(keys))]
    stored = write(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("row", F.monotonically_increasing_id().alias("place")))
    stored = stored.withColumn("part", F.shiftright("place", _WITHIN))
    offsets, total = [], start
    for r in stored.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["count"]
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "part long, before long"))
    number = (F.col("before") + F.col("place").bitwiseAND((1 << _WITHIN) - 1)).cast("long")
    return stored.join(before, "part").select(*[F.col("row").getField(c).alias(c) for c in kept], number.alias(name))
