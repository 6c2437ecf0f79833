"""Mixing sources to target weights by weighted fair queueing (native).

Every document of a source gets a place in a seeded shuffle of that source. Its
virtual finish time is the cumulative number of words of its source up to and
including it, divided by the source's weight. Sorting all documents by that time
interleaves the sources in proportion to their weights; cutting the sorted list
at the total budget gives the mix. The queue of a source holds ``max_repeats``
passes over its documents, so a source that runs dry stops there and what it
leaves over goes to the others by weight, which is what a fair queue does.

Running sums are two-level: buckets of the sort key are summed first, the bucket
totals get a running sum (a few thousand rows), and only then rows are summed
within their bucket. No source and no total order is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .native_text import n_words
from .scratch import materialize

#: Rows that a bucket of a running sum holds on average, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 20_000, 1024


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, tie): size in words; a null text has size 0. Rows without an id are told apart by a hash of their text. ``keep`` names other columns to keep."""
    tie = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), tie.alias("tie"), *keep)


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(source, weight, source_size, target), one row for each source.

    Sources in code-point order, null last, get ``weights`` in turn. The budget is
    ``share`` times all sizes; a target stops at ``max_repeats`` times its source's
    size and the excess is shared again by weight until none is above. That fixed
    point is a water level: sources ordered by cap/weight are capped as long as
    the level that the remaining budget and weight give lies at or above their own.
    The table has as many rows as there are sources.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = by_source.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * max_repeats).cast("double").alias("cap"))
    everything = Window.partitionBy()
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        caps.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # The capped sources come first in this order; the first that isn't capped sets the level of all others.
    open_level = F.max(F.when(~F.col("capped"), F.struct("rest_weight", "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(open_level * F.col("weight"))
    return level.select("source", "weight", "source_size", target.alias("target"), "budget")


def running_sum(df: DataFrame, part: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``part``, in the order of ``bucket`` and then ``order``."""
    df = df.withColumn("_bucket", bucket)
    keys = [*part, "_bucket"]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    prior = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(prior), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = df.withColumn("_inner", F.sum(value).over(own))
    matched = [inner[k].eqNullSafe(offsets[k]) for k in keys]
    on = matched[0]
    for m in matched[1:]:
        on = on & m
    return inner.join(offsets, on, "left").select(*[inner[c] for c in df.columns if c != "_bucket"], (F.col("_inner") + F.col("_before")).alias(out))


def fair_mix(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """The mix: one row per document with ``taken`` words.

    ``sized`` is what :func:`sized_documents` returns. Gives doc_id, size, source,
    source_size, target, taken, copies (how often the mix holds the document), and
    the columns that ``carry`` names.

    Null or repeated doc_id: rows are queued one by one; rows without an id take their
    place by their text. Documents of size 0 take
    nothing. An empty table gives an empty mix. In each pass a document is taken
    whole or not at all, so a source ends within about one document of its target.
    Other columns of the input play no part.
    """
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized, weights, share, max_repeats), "targets")
    buckets = max(MIN_BUCKETS, sized.count() // BUCKET_ROWS)
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie").cast("string")))
    place = (F.conv(F.substring("lot", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("int")
    queue = running_sum(sized.withColumn("lot", lot), ["source"], place, [F.col("lot"), F.col("doc_id"), F.col("size")], "size", "cum")
    queue = queue.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    queue = materialize(queue.select("d.doc_id", "d.source", "d.size", "d.lot", "d.cum", *[f"d.{c}" for c in carry], "t.weight", "t.source_size", "t.target", "t.budget"), "queue")

    # One row with the latest virtual time of all; the range of times is dealt evenly into slots.
    top = targets.agg(F.max(F.col("source_size") * max_repeats / F.col("weight")).alias("top"))

    def entry(k: int) -> Column:
        finish = (F.lit(k) * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight")
        key = F.struct(finish.alias("finish"), F.col("source").isNull().alias("last"), F.col("source"), F.col("lot"), F.col("doc_id"), F.lit(k).alias("k"))
        return F.struct(F.floor(finish / F.col("top") * buckets).cast("int").alias("slot"), key.alias("key"))

    entries = [entry(k) for k in range(max_repeats)]
    timed = queue.where("size > 0").crossJoin(F.broadcast(top)).select("size", "budget", F.explode(F.array(*entries)).alias("e")).select("size", "budget", "e.slot", "e.key")
    by_slot = timed.groupBy("slot").agg(F.sum("size").alias("in_slot"), F.first("budget").alias("budget"))
    upto = by_slot.withColumn("upto", F.sum("in_slot").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    crossing = upto.where("upto > budget").agg(F.min(F.struct("slot", (F.col("upto") - F.col("in_slot")).alias("before"))).alias("c")).select("c.slot", "c.before")
    crossing = materialize(crossing, "crossing")
    last = timed.join(F.broadcast(crossing), "slot").withColumn("run", F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    cut = last.where("before + run <= budget").agg(F.max("key").alias("cut_key")).crossJoin(crossing.select(F.col("slot").alias("cut_slot")))

    def taken(e: Column) -> Column:
        within = (e["slot"] < F.col("cut_slot")) | ((e["slot"] == F.col("cut_slot")) & (e["key"] <= F.col("cut_key")))
        return F.when((F.col("size") > 0) & (F.col("cut_slot").isNull() | F.coalesce(within, F.lit(False))), 1).otherwise(0)

    copies = sum((taken(e) for e in entries[1:]), taken(entries[0]))
    out = queue.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(cut)).withColumn("copies", copies)
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", *carry)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fair_mix(sized_documents(docs)).drop("copies", "source")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS lot
  FROM documents),
caps AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         (sum(size) * 2)::DOUBLE AS cap
  FROM sized GROUP BY source),
lev AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS rest,
    ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rest_weight
  FROM caps
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flag AS (SELECT *, rest / rest_weight AS level, cap <= rest / rest_weight * weight AS capped FROM lev),
targets AS (
  SELECT source, weight, source_size, budget,
    CASE WHEN capped THEN cap
         ELSE (SELECT arg_max(level, rest_weight) FROM flag WHERE NOT capped) * weight END AS target
  FROM flag),
queue AS (
  SELECT s.doc_id, s.source, s.size, s.lot, t.weight, t.source_size, t.target, t.budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.lot, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
timed AS (
  SELECT doc_id, size, budget,
    sum(size) OVER (ORDER BY (k * source_size + cum)::DOUBLE / weight, source NULLS LAST, lot, doc_id, k
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM queue, (VALUES (0), (1)) AS p(k) WHERE size > 0),
mixed AS (SELECT doc_id, sum(size) AS taken FROM timed WHERE run <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(m.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN mixed m USING (doc_id)
"""
