"""Lookups by name with aliases, and documents of the architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(names: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """``names`` (name) with the catalog's columns, by alias (alias, target) or else by the name itself; ``known`` says whether it was found."""
    target = F.coalesce("target", "name").alias("key")
    keyed = names.join(aliases, F.col("name") == F.col("alias"), "left").select("name", target)
    return keyed.join(catalog.withColumn("known", F.lit(True)), "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def escaped(text: Column) -> Column:
    """Text for HTML-like labels."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def dot_lines(edges: DataFrame) -> DataFrame:
    """One line of a DOT graph per edge; head and tail are the writer's."""
    return edges.select(F.concat(F.lit('  "'), escaped(F.col("source")), F.lit('" -> "'), escaped(F.col("target")), F.lit('";')).alias("line"))


def markdown_rows(table: DataFrame) -> DataFrame:
    """One Markdown table row per row; bars in cells are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in table.columns]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
