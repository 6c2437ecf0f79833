"""Column expressions over raw text that the native operators share.

A word is a maximal run of characters other than ASCII white space (space and
U+0009..U+000D). Everything here stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """array<string> of the words; null text has none."""
    return F.filter(F.split(text_or_empty(text), SPACE_CLASS, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as a long.

    Each run of white space becomes one space, the ends are trimmed and the
    spaces are counted: no array of words is built.
    """
    flat = F.trim(F.regexp_replace(text_or_empty(text), SPACE_CLASS, " "))
    spaces = F.length(flat) - F.length(F.translate(flat, " ", ""))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")
