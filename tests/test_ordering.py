"""Global row numbers against sorted lists."""

import pytest
from pyspark.sql import functions as F

from cliploom.operators.ordering import numbered


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_numbers_follow_the_order_whatever_the_partitions(spark, parts):
    rows = [(i * 7919 % 1000, i) for i in range(3000)] + [(None, -1), (None, -2)]
    df = spark.createDataFrame(rows, "row long, key0 long").repartition(parts)
    got = {r["key0"]: r["place"] for r in numbered(df, ["row", "key0"], "place", start=1).collect()}
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {k: i + 1 for i, (_, k) in enumerate(expected)}


def test_ties_and_falling_orders(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), F.lit("x").alias("part"))
    got = numbered(df, [-F.col("a")]).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(500))
    assert [r["a"] for r in got] == sorted((r["a"] for r in got), reverse=True)
    assert got[0].asDict() == {"a": 2, "part": "x", "number": 0}


def test_empty(spark):
    assert numbered(spark.createDataFrame([], "a long"), ["a"]).collect() == []
