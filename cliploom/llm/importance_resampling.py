"""Resampling towards a target distribution by hashed n-gram importance, with segment deduplication.

Newlines separate words, so a text's n-grams are those of its lines and those that
run across them. Lines repeat in a corpus far more often than texts do: occurrences
of every distinct line are counted first, a line's n-grams are hashed once and their
counts multiplied by its occurrences. The n-grams that span lines come from the
words at the lines' ends and are added apart.

An n-gram's bucket is a CRC of its bytes. The CRC of two words and the space between
is put together from those of the words, which are remembered, so the bytes of a
word are read once a block and not once for every n-gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.ordering import numbered

from .scratch import materialize

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Lines are taken in pieces of about so many bytes, and so many bytes at a time.
SEGMENT, BLOCK = 1 << 18, 1 << 21
#: Words that a worker remembers; the memory starts afresh beyond that.
REMEMBERED = 1 << 19
#: Words of so many bytes or more are hashed behind each word they follow.
SHORT = 64


def _separated() -> bytes:
    """For bytes.translate: A-Z in lower case; digits, letters and all beyond ASCII as they are; the newline kept; all else a space."""
    word = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if word(b) or b == 0x0A else 0x20 for b in range(256))


def _step() -> np.ndarray:
    """What each value of the last byte does to a CRC register that moves on by one byte: the register of that byte alone."""
    return np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _shifts(step: np.ndarray) -> np.ndarray:
    """[n, k, v]: byte k of a register, of value v, after n zero bytes; a register is the sum (xor) of its bytes."""
    out = np.empty((SHORT, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


SEPARATED, STEP = _separated(), _step()
SHIFTS = _shifts(STEP)


class _Memory(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code = zlib.crc32(word)
        return code


def joined(first: np.ndarray, second: np.ndarray, words: Sequence[bytes]) -> np.ndarray:
    """CRCs of two words with a space between, from their CRCs; ``words`` are the second ones."""
    register = first ^ np.uint32(0xFFFFFFFF)
    spaced = STEP[(register ^ 0x20) & 255] ^ (register >> 8) ^ np.uint32(0xFFFFFFFF)
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = np.where(size < SHORT, size, 0)
    out = second.copy()
    for k in range(4):
        out ^= SHIFTS[n, k, (spaced >> (8 * k)) & 255]
    for i in np.flatnonzero(size >= SHORT):
        out[i] = zlib.crc32(words[i], int(spaced[i]))
    return out


class Grams:
    """Buckets of 1- and 2-grams."""

    def __init__(self, buckets: int):
        self.buckets, self.memory = buckets, _Memory()

    def codes(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memory.__getitem__, words), np.uint32, len(words))

    def across(self, left: Sequence[bytes], right: Sequence[bytes]) -> np.ndarray:
        """Buckets of the pairs of words at the same places."""
        return joined(self.codes(left), self.codes(right), right) % self.buckets

    def within(self, segments: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(segment, bucket) of every n-gram inside the segments, which are lists of words."""
        words = list(chain.from_iterable(segments))
        code = self.codes(words)
        owner = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        at = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = joined(code[at], code[at + 1], [words[i + 1] for i in at.tolist()])
        return np.concatenate([owner, owner[at]]), np.concatenate([code, pairs]) % self.buckets


def cut(line: bytes) -> Iterator[bytes]:
    """Pieces of about SEGMENT bytes of a separated line, cut at spaces. A line is mostly one piece."""
    at = 0
    while len(line) - at > SEGMENT:
        end = line.find(b" ", at + SEGMENT)
        if end < 0:
            break
        yield line[at:end]
        at = end
    yield line[at:] if at else line


def ends(words: bytes) -> tuple[bytes, bytes] | None:
    """First and last word of a separated line, if it has any."""
    first = words.split(None, 1)
    return (first[0], words.rsplit(None, 1)[-1]) if first else None


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _totals(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at].astype(np.int64))], ["bucket", "n"])


def line_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the n-grams inside lines: every distinct line is hashed once and counts as often as it occurs.

    Lines are added up before and after the shuffle, so a line that most texts share is
    a few rows.
    """
    lines = docs.select(F.explode(F.split(docs[f"`{text_col}`"].cast("string"), "\n", -1)).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(buckets), np.zeros(buckets)

        def add(segments: list[list[bytes]], times: list[int]) -> None:
            owner, bucket = grams.within(segments)
            counts[:] += np.bincount(bucket, np.array(times, float)[owner], buckets)

        for batch in batches:
            segments, times, size = [], [], 0
            for line, n in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                before = None
                for piece in cut(line.as_py().translate(SEPARATED)):
                    words = piece.split()
                    if not words:
                        continue
                    if before is not None:
                        counts[grams.across([before], words[:1])] += n
                    before = words[-1]
                    segments.append(words)
                    times.append(n)
                    size += len(piece)
                    if size > BLOCK:
                        add(segments, times)
                        segments, times, size = [], [], 0
            add(segments, times)
        yield from _totals(counts)

    return lines.mapInArrow(run, "bucket long, n long")


def crossing_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the 2-grams that run from one line with words to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(buckets), np.zeros(buckets)
        for batch in batches:
            left, right = [], []
            for text in _bytes(batch.column(0)):
                before = None
                for line in (text.as_py() or b"").translate(SEPARATED).split(b"\n"):
                    if found := ends(line):
                        if before is not None:
                            left.append(before)
                            right.append(found[0])
                        before = found[1]
            if left:
                counts += np.bincount(grams.across(left, right), minlength=buckets)
        yield from _totals(counts)

    return docs.select(docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")


def ngram_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the n-grams of each bucket occur in all texts. Null and empty texts have none; repeated rows count."""
    both = line_counts(docs, text_col, buckets).unionByName(crossing_counts(docs, text_col, buckets))
    return both.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """A whole number for each bucket: thousandths of the log ratio of its shares in ``target`` and in ``docs``, both smoothed by one.

    Both tables are counted whole; what comes to the driver is one number a bucket.
    """
    s = ngram_counts(docs, text_col, buckets).select("bucket", F.col("n").alias("s"))
    t = ngram_counts(target, target_col, buckets).select("bucket", F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    counts = materialize(every.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * (F.lit(total["s"]) + buckets)) / ((F.col("s") + 1) * (F.lit(total["t"]) + buckets))
    return np.array([r["gain"] for r in counts.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).orderBy("bucket").collect()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with n_features and weight, the mean gain rounded down; 0 and 0 without words.

    A line is looked up once in a block of texts and counts in each text as often as
    it stands there. Columns of these names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_features", "weight")]
    kept = docs.select(*[docs[f"`{c}`"] for c in keep])
    schema = kept.schema.add("n_features", "long").add("weight", "long")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    buckets, names = len(gain), [*keep, "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = Grams(buckets), gain.astype(float)
        for batch in batches:
            n_docs = batch.num_rows
            number, total = np.zeros(n_docs, np.int64), np.zeros(n_docs)
            known: dict[bytes, int] = {}
            segments, uses, left, right, pair_of, size = [], [], [], [], [], 0

            def settle() -> None:
                owner, bucket = grams.within(segments)
                value, n = np.bincount(owner, table[bucket], len(segments)), np.bincount(owner, minlength=len(segments))
                use = np.array(uses, np.int64).reshape(-1, 2)
                np.add.at(total, use[:, 0], value[use[:, 1]])
                np.add.at(number, use[:, 0], n[use[:, 1]])
                if left:
                    np.add.at(total, pair_of, table[grams.across(left, right)])
                    np.add.at(number, pair_of, 1)
                for kept in (known, segments, uses, left, right, pair_of):
                    kept.clear()

            for d, text in enumerate(_bytes(batch.column(1))):
                before = None
                for line in (text.as_py() or b"").translate(SEPARATED).split(b"\n"):
                    for piece in cut(line):
                        at = known.get(piece)
                        if at is None:
                            words = piece.split()
                            if not words:
                                continue
                            at = known[piece] = len(segments)
                            segments.append(words)
                            size += len(piece)
                        uses.append((d, at))
                        if before is not None:
                            left.append(before)
                            right.append(segments[at][0])
                            pair_of.append(d)
                        before = segments[at][-1]
                        if size > BLOCK:
                            settle()
                            size = 0
            settle()
            whole = total.astype(np.int64)
            weight = np.where(number > 0, whole // np.maximum(number, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(number), pa.array(weight)], names)

    return rows.mapInArrow(run, schema)


def score(id_: Column, weight: Column, seed: int = SEED) -> Column:
    """``weight`` plus Gumbel noise in thousandths, from a hash of the seed and the id (nothing, if null): the highest scores are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return (weight + F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)).cast("long")


def ranked(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (a written table with n_features and score) with ``rank``: 1, 2, ... among those drawn, else null.

    Of the rows with at least ``min_words`` words, ``percent`` per cent with the
    highest scores are drawn; ties go to smaller ids, null ids last. Rows are numbered
    by ranges of the score, so neither a tie nor a repeated row can fill a task.
    """
    enough = F.col("n_features") >= 2 * min_words - 1
    rows = scored.drop("rank")
    able = materialize(rows.where(enough).withColumn("row_number", F.monotonically_increasing_id()), "able")
    drawn = able.count() * percent // 100
    placed = numbered(able, [-F.col("score"), able[id_col].isNull(), id_col, "row_number"], "rank", 1, lambda df: materialize(df, "ranked"))
    out = placed.drop("row_number").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Only ids and scores are sorted; texts are kept or dropped where they stand, by the last drawn score and id.

    Rows that share the last one's score and id all stay.
    """
    gain = gains(docs, target, text_col)
    mine = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    few = weighed(mine, gain, keep=["doc_id"])
    last = ranked(materialize(few.withColumn("score", score(F.col("doc_id"), F.col("weight"), seed)), "scored"), "doc_id", percent, min_words).where("rank IS NOT NULL").orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    wide = weighed(whole, gain, keep=["row", "doc_id"]).withColumn("score", score(F.col("doc_id"), F.col("weight"), seed))
    id_ = F.lit(last["doc_id"])
    before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < id_, F.lit(False))
    tie = (F.col("score") == last["score"]) & (before | F.col("doc_id").eqNullSafe(id_))
    out = wide.where((F.col("n_features") >= 2 * min_words - 1) & ((F.col("score") > last["score"]) | tie))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and, if drawn towards ``benchmark``, rank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gain = gains(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    scored = weighed(docs, gain, keep=["doc_id"]).withColumn("score", score(F.col("doc_id"), F.col("weight")))
    return ranked(materialize(scored, "scored")).select("doc_id", "n_features", "weight", "score", "rank")
