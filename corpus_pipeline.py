"""Raw documents to packed training sequences, in five stages.

Each stage reads all rows that the one before it kept, written as Parquet in
between. Decisions take effect: rejected documents go, one document of each group
of near-duplicates stays, secrets are masked, documents are dropped or repeated to
reach the target mix, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import scratch
from cliploom.llm.bin_packing import pack, pieces
from cliploom.llm.ngram_join import similar_groups
from cliploom.llm.quality_llr import keep_good, trusted_documents
from cliploom.llm.secret_scan import masked
from cliploom.llm.source_mix import fair_mix, sized_documents

OWNER = "pipeline"


def _owned(stage: Callable) -> Callable:
    """Deletes what the stage before this one left in the scratch folder; its result has been written by now."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, OWNER)
        with scratch.owned(OWNER):
            return stage(spark, docs, sf_dir)

    return run_stage


@_owned
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject. The trusted rows are those that ``labels`` calls good.

    Rows without words, and with null texts, go: they fail the base rule. Repeated rows
    and rows without ids are judged one by one; other columns are kept, whatever their
    names; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, trusted_documents(docs, labels))


def _numbered(docs: DataFrame) -> DataFrame:
    """(number, row): the rows with a written number, by which a stage finds each of them again, whatever ids they share or lack."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return scratch.materialize(docs.select(F.monotonically_increasing_id().alias("number"), row), "rows")


@_owned
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: that with the smallest id, rows without an id last, and of several one.

    Groups are of rows: rows of one id with unlike texts stay, rows with like texts are
    a group whether they share an id, have others or none. Rows without words stay.
    """
    rows = _numbered(docs)
    groups = scratch.materialize(similar_groups(rows.select("number", "row.text"), "number", "text"), "groups")
    groups = groups.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    shared = scratch.narrow(scratch.materialize(groups.where("group <> number").select("group").distinct(), "shared"))
    members = groups.join(shared, "group", "left_semi").join(rows.select("number", "row.doc_id"), "number")
    members = scratch.materialize(members.select("group", "number", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number").alias("place")), "members")
    first = scratch.materialize(members.groupBy("group").agg(F.min("place").alias("first")).select("first.number"), "first")
    gone = members.select("number").join(scratch.narrow(first), "number", "left_anti")
    return rows.join(scratch.narrow(scratch.materialize(gone, "gone")), "number", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@_owned
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets, but for widely copied examples; n_chars follows the text.

    Every row stays, repeated ones too. A null text stays null, with its n_chars; a null
    source or language is an owner like others; other columns are left alone.
    """
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    out = masked(docs, owner=F.col("source"), repo=repo)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_owned
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents to reach the sources' targets.

    Rows get a written number, by which the mix finds them again: rows that share an
    id, or have none, are taken one by one.
    """
    rows = _numbered(docs)
    numbers = rows.select("number", "row.doc_id", "row.source", "row.text")
    sized = sized_documents(numbers, keep=("number",))
    mix = fair_mix(sized, carry=("number",)).where("copies > 0").select("number", "copies")
    taken = rows.join(scratch.narrow(scratch.materialize(mix, "mix")), "number")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@_owned
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack; a row for each piece with its sequence and offset.

    Null and empty texts are one piece with the end id alone. Repeated rows and rows
    without ids are packed one by one; other columns end here.
    """
    return pack(scratch.materialize(pieces(docs), "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: The stages hash, learn and search; no SQL gives their rows. tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch.fresh_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            scratch.delete(spark, before)
        before = path
    scratch.release(spark, OWNER)
    return docs
