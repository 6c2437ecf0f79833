"""Column expressions on file paths and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as video, in lower case.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows it in the file name; empty without one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def real_source_id(path: Column) -> Column:
    """The file name up to its first underscore; all of it, extension included, without one."""
    return F.split_part(file_name(path), F.lit("_"), F.lit(1))


def fake_source_id(path: Column) -> Column:
    """The stem before the first ``_clip_``, else without a final ``_swapped``."""
    s = stem(path)
    return F.when(F.contains(s, F.lit("_clip_")), F.substring_index(s, "_clip_", 1)).otherwise(F.regexp_replace(s, "_swapped$", ""))


def is_video(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*VIDEO_EXTENSIONS)


def class_name(label: Column) -> Column:
    return F.when(label == 1, "fake").otherwise("real")


def strip_prefixes(key: Column, prefixes: Sequence[str]) -> Column:
    """Any of the prefixes, again and again until none is left."""
    escaped = "|".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in p) for p in prefixes)
    return F.regexp_replace(key, f"^(?:{escaped})+", "")


def run_index(name: Column) -> Column:
    """The number of ``run_<digits>``, else null."""
    return F.regexp_extract(name, r"^run_([0-9]+)$", 1).try_cast("int")
