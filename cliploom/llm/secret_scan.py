"""Secret scans with corpus-wide ownership frequency (native).

Fixed patterns find assigned secrets, access key ids and long hex runs in every
whole text. A wider pattern finds opaque key-like strings, too loose to report on
its own. All candidates are hashed and the hashes are aggregated by distinct
repository and distinct owner over the whole corpus: a value that many owners
hold is a copied example, a value that one owner holds looks live. Opaque strings
are reported only where their hash is live; candidates of the fixed patterns are
always reported, with their ownership beside them.

Positions are code points. They come from the lengths of the pieces between the
matches of a pattern and of the matches, by a running sum over one document's
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .native_text import text_or_empty
from .scratch import materialize, narrow

KINDS = ("assign", "access", "hex", "opaque")
#: The patterns of the base kinds. Runs are maximal, so a minimal length may stand in the
#: pattern for access and hex; an assignment is matched first and its value measured after.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9_-]{24,}"
MIN_VALUE = 8
#: From so many owners on, a value is a copied example.
EXAMPLE_OWNERS = 3


def _candidate(kind: int, pattern: str):
    """Match and its place in the list -> struct; gap: code points since the match before."""

    def one(hit: Column, i: Column) -> Column:
        value = F.regexp_extract(hit, pattern, 2) if kind == 0 else hit
        keep = {0: F.length(value) >= MIN_VALUE, 3: value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")}.get(kind, F.lit(True))
        return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.get(F.col(f"_p{kind}"), i).alias("gap"), F.length(hit).alias("len"), keep.alias("keep"), F.when(keep, F.sha2(value, 256)).alias("hash"))

    return one


def _count(field: str, value) -> Column:
    return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_hits``: the matches of all patterns, in order by pattern."""
    df = docs.withColumn("_t", text_or_empty(F.col(text_col)))
    columns = []
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, OPAQUE)):
        there = F.col("_t").rlike(pattern)
        df = df.withColumn(f"_m{kind}", F.when(there, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))))
        df = df.withColumn(f"_p{kind}", F.when(F.col(f"_m{kind}").isNotNull(), F.transform(F.split("_t", pattern, -1), F.length)))

        columns.append(F.coalesce(F.transform(f"_m{kind}", _candidate(kind, pattern)), F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,keep:boolean,hash:string>>")))
    return df.withColumn("_hits", F.concat(*columns)).drop("_t", *[f"_{x}{k}" for x in "mp" for k in range(4)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).

    rows: one for each input row: ``row_id`` and the id. spans: row_id, start, stop
    (exclusive), kind, hash, n_repos, n_owners, verdict (live, shared or example).

    Null text is empty. A null repository or owner is one of its own. Repeated rows
    are scanned one by one and count as one owner. Ties in position are ordered by
    kind as listed. No row is dropped; an empty table gives empty results.
    """
    owner = F.lit(None).cast("string") if owner is None else owner.cast("string")
    repo = owner if repo is None else repo.cast("string")
    found = candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), owner.alias("owner"), repo.alias("repo")))
    found = materialize(found.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", "repo", "_hits"), "secrets")
    hits = found.where(F.size("_hits") > 0).select("row_id", "owner", "repo", F.explode("_hits").alias("h")).select("row_id", "owner", "repo", "h.*")
    order = Window.partitionBy("row_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("stop") - F.col("len")).where("keep")
    # An opaque string that touches a base span is part of it.
    base = F.col("kind") < 3
    earlier = Window.partitionBy("row_id").orderBy("start", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row_id").orderBy(F.col("start").desc(), F.col("kind").asc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_end", F.max(F.when(base, F.col("stop"))).over(earlier)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(later))
    apart = (F.coalesce(F.col("_end"), F.lit(0)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("stop")))
    placed = placed.where(base | apart).select("row_id", "owner", "repo", "kind", F.col("start").cast("long"), F.col("stop").cast("long"), "hash")
    placed = materialize(placed, "placed")
    # Three steps, each with map-side sums: a value in a third of all rows stays small.
    pairs = placed.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("copies"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("copies").alias("copies"))
    spread = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("copies").alias("n_copies"))
    spread = materialize(spread, "spread")
    spans = placed.join(spread, "hash")
    verdict = F.when(F.col("n_owners") == 1, "live").when(F.col("n_owners") >= example_owners, "example").otherwise("shared")
    spans = spans.withColumn("verdict", verdict).where(base | (F.col("verdict") == "live"))
    return found.select("row_id", "doc_id"), spans.drop("owner", "repo")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. The table has no repositories: source stands for the owner, source and language for the repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, spans = scan(docs, owner=F.col("source"), repo=F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    by_row = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "verdict"))).alias("spans"))
    out = rows.join(by_row, "row_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)))
    of_kind = [_count("kind", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    verdicts = [_count("verdict", v).alias(f"n_{v}") for v in ("live", "example")]
    return out.select("doc_id", *of_kind[:3], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), of_kind[3], *verdicts)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>", repo: Column | None = None, owner: Column | None = None, **scan_args) -> DataFrame:
    """``docs`` with live and shared secrets replaced by ``mask``; copied examples stay.

    Overlapping spans become one. All rows and columns stay, whatever their names; null
    text stays null. Rows are told apart by id and text, so repeated rows are masked alike.
    """
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)])
    owner = F.lit(None).cast("string") if owner is None else owner.cast("string")
    repo = owner if repo is None else repo.cast("string")
    boxed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), key.alias("key"), owner.alias("owner"), repo.alias("repo"))
    rows, spans = scan(boxed, id_col="key", repo=F.col("repo"), owner=F.col("owner"), **scan_args)
    hidden = spans.where("verdict <> 'example'").join(rows, "row_id").groupBy(F.col("doc_id").alias("key")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    df = boxed.select("row", "text", "key").join(narrow(materialize(hidden, "masks"), "spans"), "key", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    text = F.when(F.col("spans").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, finish))
    return df.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
