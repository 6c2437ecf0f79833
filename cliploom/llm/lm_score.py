"""Cross-entropy difference between a target and a background language model.

Both are bigram models over one vocabulary: every word of the corpus and the end of
a text. The background model counts every document; the target model counts every
trusted one. Both use the same order and the same smoothing (bigrams over
Dirichlet-smoothed unigrams), so the losses of a token under the two are comparable,
and the mean of their differences scores each document: the lower, the closer to the
target.

The models grow with the corpus and stay distributed: each bigram of each document
goes to the bucket of its rarer side, where all its occurrences meet, are counted and
priced; the prices return to the documents by a second shuffle. Frequent words would
crowd a bucket, so bigrams of two of the HEAD most frequent words are counted ahead, and
only this table, of fixed size, goes to every task. It decides where a bigram is counted,
not how.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, materialize

#: Words whose bigrams with each other are counted ahead; ids after them: unlisted word, end of text (also the start).
HEAD = 1023
#: Tokens and documents of a block, bits of the tokens of a bucket, buckets at least, words whose hash a task remembers.
BLOCK_TOKENS, BLOCK_ROWS, BUCKET_BITS, LEAST_BUCKETS, REMEMBERED = 1 << 20, 1 << 12, 21, 64, 1 << 18
#: Ids of words that aren't in the head start here: 62 bits of a hash.
HASHED = 1 << 62
#: Pseudo-counts: of every unigram, and of the unigram distribution behind each bigram context.
UNIGRAM_PRIOR, CONTEXT_PRIOR = 1.0, 50.0


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0):
                seen.update(text_words(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent words; ties by the word itself."""
    return [r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(size).collect()]


class Ids(dict):
    """Word -> id; all words that aren't listed are the unknown word."""

    def __init__(self, words: list[str]):
        super().__init__({w.encode(): i for i, w in enumerate(words)})
        self.unknown, self.end = len(words), len(words) + 1
        self.cells = (self.end + 1) ** 2

    def __missing__(self, word: bytes) -> int:
        return self.unknown

    def bigrams(self, text: str | None) -> np.ndarray:
        """Cell of each bigram, from the start to the end of the text; none for a text without words."""
        words = text_words(text)
        if not words:
            return np.empty(0, np.int64)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.concatenate([[self.end], ids]) * (self.end + 1) + np.concatenate([ids, [self.end]])


def bigram_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """(cell, background, target) summed over all rows; ``docs`` has text and is_target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(words)
        sums = np.zeros((2, ids.cells), np.int64)
        for batch in batches:
            some: tuple[list, list] = ([], [])
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                some[target].append(ids.bigrams(text.as_py()))
            for k in range(2):
                if some[k]:
                    sums[k] += np.bincount(np.concatenate(some[k]), minlength=ids.cells)
        cell = np.flatnonzero(sums.any(axis=0))
        for a in range(0, len(cell), 1 << 16):
            part = cell[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[:, part].sum(axis=0)), pa.array(sums[1, part])], ["cell", "background", "target"])

    counts = docs.select("text", "is_target").mapInArrow(run, "cell int, background long, target long")
    return counts.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Hashes(Ids):
    """Word -> id; a word that isn't listed is its own hash."""

    def __missing__(self, word: bytes) -> int:
        found = HASHED | int.from_bytes(blake2b(word, digest_size=8).digest()) >> 2
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def price(pairs: np.ndarray, words: np.ndarray, total: float, size: int) -> np.ndarray:
    """-log p(word | context) from the counts of pair and word, but for a term of the context.

    A word is a context as often as it is a word, in each text too (the start being the
    end), so log(count + prior) of the word stands for that of the context: the sums over
    a text are the same.
    """
    unigram = (words + UNIGRAM_PRIOR) / (total + UNIGRAM_PRIOR * size)
    return np.log(words + CONTEXT_PRIOR) - np.log(pairs + CONTEXT_PRIOR * unigram)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row; losses in nats per token.

    ``target_ids`` holds the ids (doc_id) of all trusted rows. Tokens are the words
    and the end of the text. Texts without words, and null texts, have no tokens and
    null losses. Without target rows the target model is uniform over the vocabulary
    and scores say so. Repeated rows count each time; rows with a null id are
    background. Other columns play no part. With ``size``, only so many of the most
    frequent words are told apart, and all others are one unknown word.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    target = materialize(target_ids.where("doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("is_target")).distinct(), "target")
    few = target.count() <= BROADCAST_ROWS
    flagged = docs.join(F.broadcast(target) if few else target, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(0)).alias("is_target"))
    if not few:
        flagged = materialize(flagged, "flagged")  # joined once, and rows keep their order
    counts = materialize(word_counts(docs), "words")
    words = most_frequent(counts, HEAD if size is None else size)
    n_words = counts.count() + 1 if size is None else len(words) + 2
    side = len(words) + 2
    told = bigram_counts(flagged, words).toArrow()
    both = np.zeros((2, side * side))
    cell = told.column("cell").to_numpy()
    both[0, cell], both[1, cell] = told.column("target").to_numpy(), told.column("background").to_numpy()
    totals, heads = both.sum(axis=1), both.reshape(2, side, side).sum(axis=1)
    tables = spark.sparkContext.broadcast(np.stack([price(x.reshape(side, side), h, n, n_words).ravel() for x, h, n in zip(both, heads, totals, strict=True)]).astype(np.float32))
    buckets = max(LEAST_BUCKETS, int(totals[1]) >> BUCKET_BITS)
    id_type = dict(docs.dtypes)["doc_id"]
    kind = Ids if size is not None else Hashes

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the documents of a block, in a bucket of its own, with what the head tells of them, and one for each bucket with bigrams of theirs."""
        ids, table, block = kind(words), tables.value, TaskContext.get().partitionId() << 32

        def packed(doc_ids: pa.Array, flags: np.ndarray, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            n = np.array([len(x) + 1 if len(x) else 0 for x in texts], np.int64)
            ends = [[ids.end]] * len(texts)
            first = np.concatenate([x for t, e in zip(texts, ends, strict=True) if len(t) for x in (e, t)] or [[]]).astype(np.int64)
            second = np.concatenate([x for t, e in zip(texts, ends, strict=True) if len(t) for x in (t, e)] or [[]]).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            away = (first > ids.end) | (second > ids.end)
            cells = first[~away] * (ids.end + 1) + second[~away]
            sums = [np.bincount(row[~away], table[k][cells], len(n)) for k in range(2)]
            out = [(-1 - block, block, doc_ids.to_pylist(), n.tobytes(), sums[0].tobytes(), sums[1].tobytes(), None, None, None)]
            first, second, row = first[away], second[away], row[away]
            bucket = np.where(second > ids.end, second, first) % buckets
            order = np.lexsort((second, bucket))
            first, second, bucket, row = first[order], second[order], bucket[order], (row << 1 | flags[row])[order].astype(np.uint16)
            new = np.flatnonzero(np.r_[True, (second[1:] != second[:-1]) | (bucket[1:] != bucket[:-1])][: len(second)])
            runs, at = np.diff(np.r_[new, len(second)]).astype(np.uint32), np.searchsorted(bucket, np.arange(buckets + 1))
            word_at = np.searchsorted(new, at)
            for b in np.flatnonzero(np.diff(at)):
                i, j = slice(at[b], at[b + 1]), slice(word_at[b], word_at[b + 1])
                out.append((int(b), block, None, row[i].tobytes(), None, None, second[new[j]].tobytes(), runs[j].tobytes(), first[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(doc_ids.type), *[pa.binary()] * 6), strict=True)], ["bucket", "block", "ids", "rows", "target", "background", "words", "runs", "contexts"])

        for batch in batches:
            flags, texts, start, size_ = batch.column(2).to_numpy(), [], 0, 0
            for i, text in enumerate(batch.column(1)):
                found = text_words(text.as_py())
                texts.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
                size_ += len(found)
                if size_ >= BLOCK_TOKENS or len(texts) == BLOCK_ROWS or i + 1 == batch.num_rows:
                    yield from packed(batch.column(0)[start : i + 1], flags[start : i + 1], texts)
                    texts, start, size_, block = [], i + 1, 0, block + 1

    end = side - 1

    def priced(group: pa.Table) -> pa.Table:
        """What the bigrams of a bucket cost each document of each block; the blocks' own rows pass."""
        if group.column("bucket")[0].as_py() < 0:
            return group.select(["block", "ids", "rows", "target", "background"])
        read = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in group.column(c)]
        contexts, rows = read("contexts", np.int64), np.concatenate(read("rows", np.uint16))
        word = np.repeat(np.concatenate(read("words", np.int64)), np.concatenate(read("runs", np.uint32)))
        blocks_ = group.column("block").to_numpy()
        place = np.repeat(np.arange(len(blocks_)), [len(x) for x in contexts]) << 16 | rows >> 1
        context = np.concatenate(contexts)
        order = np.lexsort((context, word))
        word, context, place, is_target = word[order], context[order], place[order], (rows & 1)[order]
        new_word = np.r_[True, word[1:] != word[:-1]]
        new_pair = new_word | np.r_[True, context[1:] != context[:-1]]
        of_word, of_pair = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
        known = word[new_word]
        listed = known <= end
        docs_, of_doc = np.unique(place, return_inverse=True)
        sums = []
        for k, weights in enumerate((is_target, None)):
            n_word = np.bincount(of_word, weights).astype(np.float64)
            n_word[listed] = heads[k][known[listed]]
            cost = price(np.bincount(of_pair, weights), n_word[of_word[new_pair]], totals[k], n_words)
            sums.append(np.bincount(of_doc, cost[of_pair]).astype(np.float32))
        at = np.searchsorted(docs_ >> 16, np.arange(len(blocks_) + 1))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.table([pa.array(blocks_), pa.nulls(len(blocks_), group.schema.field("ids").type), cut((docs_ & 0xFFFF).astype(np.uint16)), cut(sums[0]), cut(sums[1])], ["block", "ids", "rows", "target", "background"])

    def summed(group: pa.Table) -> pa.Table:
        """The documents of a block, with the means of all that their bigrams cost."""
        sums, n, doc_ids = [], None, None
        parts = group.to_pylist()
        (base,) = [p for p in parts if p["ids"] is not None]
        n, doc_ids = np.frombuffer(base["rows"], np.int64), base["ids"]
        for side_ in ("target", "background"):
            total = np.frombuffer(base[side_], np.float64).copy()
            for p in parts:
                if p["ids"] is None:
                    total[np.frombuffer(p["rows"], np.uint16)] += np.frombuffer(p[side_], np.float32)
            sums.append(pa.array(total / np.maximum(n, 1), mask=n == 0))
        return pa.table([pa.array(doc_ids, group.schema.field("ids").type.value_type), pa.array(n), *sums], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    sums = f"block long, ids array<{id_type}>, rows binary, target binary, background binary"
    cut = flagged.mapInArrow(blocks, f"bucket long, {sums}, words binary, runs binary, contexts binary")
    out = cut.groupBy("bucket").applyInArrow(priced, sums)
    out = out.groupBy("block").applyInArrow(summed, f"doc_id {id_type}, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all the trusted ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1").select("doc_id"))
