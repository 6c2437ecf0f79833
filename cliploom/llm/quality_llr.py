"""Quality rules: hashed n-gram log-likelihood ratio, target against raw corpus (native).

Every document becomes a bag of hashed word 1-grams and 2-grams. Two multinomials
over the hash buckets are counted: one over a bounded, documented sample of
trusted rows, one over all rows of the corpus. A document's score is the mean
over its n-grams of ``log(p_target / p_raw)``; one fixed threshold decides every
document, so the verdict doesn't depend on the other documents' ranks.

Beside it stand plain text statistics and a rule on them (too short, or mostly
repeated three-word windows), which the verdict never overrules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native_text import SPACES, text_or_empty, words
from .scratch import materialize

#: Hash buckets of the two multinomials; their log ratios are one row of this many floats.
BUCKETS = 1 << 14
#: At most so many trusted documents make the target multinomial.
TARGET_ROWS = 20_000
#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.1
#: Occurrences as the raw corpus has them that are added to what the target has of a bucket, and to what it should have.
EVIDENCE = 16
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _unigram(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _bigram(word: Column, after: Column) -> Column:
    """The last word of a text pairs with null, its end."""
    return F.pmod(F.hash(F.lit(2), word, after), F.lit(BUCKETS))


def boxed(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): the caller's columns as one struct, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))


def unboxed(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [df["row"].getField(c).alias(c) for c in columns]


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null text counts as empty: all zero, and failed. Rows are independent, repeated
    ones too. Columns of the input are kept; those that this adds replace any of that
    name. ``n_repeat_words`` counts the positions inside three-word windows whose words
    occur in two windows or more; windows are compared by a 64-bit hash of their words.
    """
    df = _statistics(boxed(docs, text_col))
    return df.select(*unboxed(df, [c for c in docs.columns if c not in STATISTICS]), *STATISTICS)


def _statistics(df: DataFrame) -> DataFrame:
    """(row, text, _w) and the statistics."""
    text = text_or_empty(F.col("text"))
    df = df.withColumn("_w", words(F.col("text")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_k": F.transform(F.slice(F.col("_w"), 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))),
    }).drop("_lines")
    repeats = F.size(F.array_distinct("_k")) < F.size("_k")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i")))))).drop("_k")
    alike = F.filter("_s", lambda e, j: (e["k"] == F.get(F.col("_s"), j - 1)["k"]) | (e["k"] == F.get(F.col("_s"), j + 1)["k"]))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(alike, lambda e: e["i"])))).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("_p").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("_p")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return df.withColumn("base_failed", failed)


def ngram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often each bucket's 1-grams and 2-grams occur, over all rows, repeated ones too. Null and empty texts have none; other columns play no part."""
    df = docs.select(words(F.col(text_col)).alias("_w"))
    grams = F.flatten(F.transform("_w", lambda x, i: F.array(_unigram(x), _bigram(x, F.get(F.col("_w"), i + 1)))))
    return df.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame, text_col: str = "text") -> DataFrame:
    """One row with ``ratios``: BUCKETS floats, log(p_target / p_raw).

    The raw counts are smoothed by one. A bucket's count in the target is held against
    what a target of its size should have by the raw share, EVIDENCE added to both:
    the ratio stays near 0 where little is expected, and grows with the evidence of
    that bucket, not with the number of labels as a whole.
    The row is of fixed size, so it may be broadcast whatever the corpus.
    """
    spark = raw.sparkSession
    t = ngram_counts(target, text_col).select("bucket", F.col("n").alias("t"))
    r = ngram_counts(raw, text_col).select("bucket", F.col("n").alias("r"))
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(t, "bucket", "left").join(r, "bucket", "left")
    both = both.select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    row = both.agg(F.sum("t").alias("tt"), F.sum("r").alias("rr"), F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("all"))
    raw_p = lambda x: (x["r"] + 1) / (F.col("rr") + BUCKETS)
    ratio = F.transform("all", lambda x: F.log((x["t"] + EVIDENCE) / (F.col("tt") * raw_p(x) + EVIDENCE)).cast("float"))
    return row.select(ratio.alias("ratios"))


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` doc_ids of quality 1, by the order of a hash: a bounded sample that reruns repeat."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _scored(docs: DataFrame, target: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(row, statistics, score, kept)."""
    ratios = materialize(log_ratios(target, docs, text_col), "ratios")
    df = _statistics(boxed(docs, text_col)).crossJoin(F.broadcast(ratios))
    each = F.transform("_w", lambda x, i: F.get(F.col("ratios"), _unigram(x)).cast("double") + F.get(F.col("ratios"), _bigram(x, F.get(F.col("_w"), i + 1))))
    score = F.when(F.size("_w") > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (2 * F.size("_w"))).otherwise(F.lit(0.0))
    out = df.select("row", *STATISTICS, score.alias("score"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def score_documents(docs: DataFrame, target: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the text statistics, ``score`` and ``kept``.

    ``target`` holds the trusted rows (of a bounded number); all rows of ``docs``
    make the raw multinomial, repeated rows and rows with a null id too. Null text is
    empty. Texts without words score 0 and fail by the rule. With an empty target all
    ratios are 0 and only the rule rejects; an empty table gives an empty result.
    Columns of the input are kept; those that this adds replace any of that name.
    """
    added = (*STATISTICS, "score", "kept")
    df = _scored(docs, target, text_col, threshold)
    return df.select(*unboxed(df, [c for c in docs.columns if c not in added]), *added)


def keep_good(docs: DataFrame, target: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names; repeated rows and null ids one by one.

    The filter reads a row number beside the verdict. That has no influence on it but
    holds the filter above the projections: pushed below them, the nested array
    expressions would be written out again for each use.
    """
    scored = _scored(docs, target, text_col, threshold).withColumn("place", F.monotonically_increasing_id()).where("kept AND place >= 0")
    return scored.select(*unboxed(scored, docs.columns))


def trusted_documents(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """The trusted rows of ``docs``, every row of a trusted id; their bounded list of ids goes to every task, the texts stay where they are. Rows without an id are never trusted; all columns are kept."""
    return docs.join(F.broadcast(materialize(trusted_ids(labels, rows), "trusted")), "doc_id", "left_semi")


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the verdict for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(docs, trusted_documents(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
