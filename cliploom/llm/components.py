"""Connected components of a link table by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest neighbour, and
then every node and its smaller neighbours on the smallest of those. The table of
links shrinks to one star for each component. A node's smallest neighbour is
aggregated with map-side minima and written before the join, so that a node with
a great share of all links is split over tasks in the join; no list of neighbours
is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
    # Large star: v > u hangs on m; m is smaller than v.
    large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "largestar")
    least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "small")
    hung = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return materialize(hung.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link to another; component is the smallest id reachable.

    Direction, repeats and links of an id with itself don't matter; links with a
    null end are ignored. No links give an empty table.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = materialize(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    while not _are_stars(links):
        links = _round(links)
    leaves = links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return leaves.union(links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Every upper end has one lower end, and no lower end is an upper end of another link."""
    ends = links.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")
    return odd.isEmpty()
