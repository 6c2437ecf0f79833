"""Extractors from elsewhere as table functions.

An extractor is a Python class with ``required`` (columns it needs), ``analyze`` (the
columns it gives), ``eval`` (a row of a clip, in order) and, if it wants, ``terminate``
(the clip's end). It sees one clip at a time, whatever executor the clip is on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def needs(argument: AnalyzeArgument, columns: tuple[str, ...]) -> None:
    """For ``analyze``: raise unless the table has these columns."""
    if not argument.isTable:
        raise ValueError("an extractor takes a table")
    have = set(argument.dataType.names)
    if missing := [c for c in columns if c not in have]:
        raise ValueError(f"an extractor needs {', '.join(missing)}")


@dataclass
class Extractors:
    """A registry by modality. A query names a modality and gets whatever is registered for it."""

    known: dict[str, type] = field(default_factory=dict)

    def register(self, modality: str, extractor: type) -> None:
        if not all(hasattr(extractor, part) for part in ("required", "analyze", "eval")):
            raise TypeError(f"{extractor.__name__} lacks required, analyze or eval")
        self.known[modality] = extractor

    def extract(self, modality: str, frames: DataFrame, clip: str = "clip_id", order: str = "t") -> DataFrame:
        """The extractor's columns for every clip of ``frames``; a clip's rows come to one task, in order."""
        if modality not in self.known:
            raise KeyError(f"no extractor for {modality}")
        function = F.udtf(self.known[modality])
        return function(frames.asTable().partitionBy(clip).orderBy(order))


class Movement:
    """How far each frame's vector is from the one before: clip_id, t, features of one number. A clip's first frame has none."""

    required = ("clip_id", "t", "features")

    def __init__(self) -> None:
        self.before = None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        needs(table, Movement.required)
        return AnalyzeResult(T.StructType([table.dataType["clip_id"], table.dataType["t"], T.StructField("features", T.ArrayType(T.DoubleType()))]))

    def eval(self, row):  # noqa: ANN001, ANN201
        now = row["features"]
        if now is not None and self.before is not None:
            yield row["clip_id"], row["t"], [sum((a - b) ** 2 for a, b in zip(now, self.before, strict=True)) ** 0.5]
        self.before = now if now is not None else self.before
