"""Best-fit packing by minimum bin slack.

Texts become token ids with an end id behind each. Only documents longer than a
sequence are cut. Pieces are dealt into groups of bounded size, and each group is
packed on its own: for every sequence, starting from the longest piece left, a
bitset subset-sum over the lengths that are available finds the fullest feasible
combination, which is then removed. A group leaves at most a few sequences that
aren't full, so the number of sequences stays close to tokens / capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_transducer import Vocabulary
from .pretokens import PATTERN, astral
from .scratch import materialize

CAPACITY, END_ID = 1024, 2
#: Pieces that one group packs on average.
GROUP_PIECES = 50_000
GROUP_BITS = 40


class Ids:
    """Texts -> the ids that the tokenizers library gives.

    If the vocabulary's ids are in the order of its merges, they serve as the ranks of
    tiktoken, which finds the same ids in a third of the time. Texts with characters
    beyond the basic plane, for which libraries know different letters, texts that it
    refuses and other vocabularies are left to the tokenizers library.
    """

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        v = Vocabulary(path)
        order = sorted(v.made, key=lambda t: v.made[t][0])
        ranks = [v.ids[t] for t in order]
        self.ranked = v.one_way and ranks == sorted(ranks) and len(v.ids) == len(order) + 256
        if self.ranked:
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.ranked and not astral(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern gives up on very long runs of white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_ids: dict[str, Ids] = {}


def encoder(name: str) -> Ids:
    """One for each worker."""
    if name not in _ids:
        _ids[name] = Ids(name)
    return _ids[name]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece of every row's ids.

    A text longer than ``capacity`` is cut into full pieces behind a shorter first
    one. Null text is empty: its only id is ``end_id``. Repeated rows and rows with a
    null id are cut like any other; other columns of the input play no part.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()).astype("<u4").tobytes() + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate((0, *range(first, n, capacity))):
                    size = first if k == 0 else capacity
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one sequence: the longest available, and the combination of the others that leaves the least slack.

    ``sums[k]`` is a bitset of the totals that the first k choices reach. Lengths
    are offered from long to short and the search ends once the gap is filled.
    """
    longest = int(np.flatnonzero(counts)[-1])
    counts[longest] -= 1
    gap = capacity - longest
    if gap == 0:
        return [longest]
    if gap < len(counts) and counts[gap]:
        counts[gap] -= 1
        return [longest, gap]
    offered, sums, mask = [], [1], (1 << gap + 1) - 1
    for size in np.flatnonzero(counts[: gap + 1])[::-1].tolist():
        copies, take = min(int(counts[size]), gap // size), 1
        while copies:
            take = min(take, copies)
            copies -= take
            offered.append((size, take))
            sums.append(sums[-1] | sums[-1] << size * take & mask)
            take *= 2
        if sums[-1] >> gap & 1:
            break
    total, chosen = sums[-1].bit_length() - 1, [longest]
    for k in range(len(offered), 0, -1):
        if not sums[k - 1] >> total & 1:
            size, take = offered[k - 1]
            total -= size * take
            counts[size] -= take
            chosen += [size] * take
    return chosen


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]  # next unused row of each length, in order
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, n = len(lengths), 0
    while left:
        place = 0
        for size in fullest(counts, capacity):
            row = order[at[size]]
            at[size] += 1
            sequence[row], offset[row] = n, place
            place += size
            left -= 1
        n += 1
    return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` (what :func:`pieces` returns, read more than once) with sequence_id and offset.

    Every piece is placed once; within a sequence offsets run without gaps from 0.
    Pieces are dealt by a hash of their row in the written table, so that no source,
    document or repeated row fills a group; repeated rows and rows with a null id are
    packed one by one, and ids of any size stay as they are. Columns of ``cut`` beside
    those of pieces travel along. An empty table gives an empty result.
    """
    n = cut.count()
    groups = max(1, -(-n // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    columns = cut.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        sequence, offset = pack_lengths(t["length"].to_numpy(), capacity)
        first = t["group"][0].as_py() << GROUP_BITS
        return t.select(columns).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes)
    return dealt.groupBy("group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def op10_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return pack(materialize(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces"))
