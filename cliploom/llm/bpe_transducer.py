"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary.

Within one pretoken, every prefix of the bytes has exactly one BPE encoding, and
its last token together with the encoding of what stands before it is all that
longer prefixes need. What can still matter is bounded by the longest live suffix
(one that some token starts with), so the prefixes fall into finitely many
classes: the states of a deterministic transducer. A transition reads a byte and
emits the change of the number of tokens. States are compiled when a text first
reaches them and kept in a dense table.

Chunks have state maps: (state before) -> (state behind, tokens emitted), which
compose associatively. A chunk that ends a pretoken leads to the start state from
wherever it began, so texts are cut where pretokens end and those counts add up. A
long pretoken is cut into blocks. All chunks of a batch run side by side, a byte a
step; blocks run from the start state and once more from the state in which the
block before them was left, which is nearly always the true one, and the scan that
composes their maps runs the few that are missing. One path serves every length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Remembering

#: Bytes of a block and of the words that run side by side; states that a worker keeps before it starts anew.
BLOCK, BATCH_BYTES, STATES = 32, 1 << 16, 1 << 17
#: A transition is ``state << EMIT_BITS | tokens emitted + EMIT_ZERO``.
EMIT_BITS, EMIT_ZERO = 10, 512


def byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes name themselves, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, model = byte_names(), spec["model"]
        special = {x["content"] for x in spec["added_tokens"]}
        to_bytes = lambda s: bytes(names[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        #: The merge that makes a token; bytes are there from the start.
        self.made = {a + b: (r, a, b) for (a, b), r in reversed(self.ranks.items())}
        self.one_way = len(self.made) == len(self.ranks)
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.special = special
        self.longest = max(map(len, self.ids))

    def merge(self, word: bytes) -> list[bytes]:
        """The BPE encoding of a short byte string, merge by merge."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves the tokens ``left`` (nothing, at the start) and ``right`` side by side as they are.

        Back in time, the two are taken apart merge by merge, the later first. What then
        meets at the border must not merge before that.
        """
        if not left or not self.one_way:
            return self.merge(left + right) == ([left, right] if left else [right])
        none, until = (-1, b"", b""), (1 << 30, 0)
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and (rank, 0) < until:
                return False
            (a, _, inner), (b, outer, _) = self.made.get(left, none), self.made.get(right, none)
            if a < 0 and b < 0:
                return True
            # Of equal merges the one further left comes first, so the border's goes before one inside the right token.
            if a > b:
                left, until = inner, (a, 0)
            else:
                right, until = outer, (b, 1)


class Transducer:
    """The lazily compiled machine; ``counts`` runs it over many pretokens.

    A state is (live, last, count): the live suffix of the bytes read; for each
    place in it, the token that ends there (empty at the start of the pretoken);
    and the number of tokens up to there, less that of the whole prefix.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        start = (b"", (b"",), (0,))
        self.states = [start]
        self.index = {start: 0}
        # Zero is unknown: no transition leads to the start. Pages that no state has reached take no memory.
        self.table = np.zeros((STATES + BATCH_BYTES + 1, 256), np.int32)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def number(self, state: tuple) -> int:
        """The state's row of the table, which grows by what is reached."""
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.table) // 2, 256), np.int32)])
        return self.index[state]

    def compile(self, at: int, byte: int) -> None:
        (live, last, count), ids, pairs = self.states[at], self.v.ids, self.pairs
        read = live + bytes((byte,))
        for start, left in enumerate(last):
            token = read[start:]
            if token in ids:
                apart = pairs.get((left, token))
                if apart is None:
                    apart = pairs[left, token] = self.v.apart(left, token)
                if apart:
                    break
        else:
            raise ValueError(f"no token ends with byte {byte}")
        emitted = count[start] + 1
        keep, prefixes = 0, self.v.prefixes
        while keep < len(read) and read[keep:] not in prefixes:
            keep += 1
        state = (read[keep:], (*last[keep:], token), (*(c - emitted for c in count[keep:]), 0))
        to = self.number(state)
        self.table[at, byte] = to << EMIT_BITS | emitted + EMIT_ZERO

    def run(self, at: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's state map at the state given for it: the state behind it and the tokens emitted."""
        size = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(-size, kind="stable")
        read = np.zeros((len(chunks), int(size.max(initial=0))), np.uint8)
        read[np.arange(read.shape[1]) < size[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
        read, state, total = read[order], at[order], np.zeros(len(chunks), np.int64)
        active = np.searchsorted(-size[order], -np.arange(read.shape[1]))  # chunks that have a byte at this place
        for k, n in enumerate(active.tolist()):
            s, byte = state[:n], read[:n, k]
            step = self.table[s, byte]
            if (unknown := step == 0).any():
                for key in np.unique(s[unknown] << 8 | byte[unknown]).tolist():
                    self.compile(key >> 8, key & 255)
                step = self.table[s, byte]
            state[:n] = step >> EMIT_BITS
            total[:n] += (step & (1 << EMIT_BITS) - 1) - EMIT_ZERO
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each word, in batches of bounded bytes; a longer word goes through in such pieces."""
        out, some, size = [], [], 0
        for word in words:
            if size + len(word) > BATCH_BYTES and some:
                out += self._counts(some)[0]
                some, size = [], 0
            if len(word) > BATCH_BYTES:
                here, n = 0, 0
                for i in range(0, len(word), BATCH_BYTES):
                    (more,), here = self._counts([word[i : i + BATCH_BYTES]], here)
                    n += more
                out.append(n)
            else:
                some.append(word)
                size += len(word)
        return out + (self._counts(some)[0] if some else [])

    def _counts(self, words: list[bytes], here: int = 0) -> tuple[list[int], int]:
        """Tokens of each word, the first one from state ``here``, and the state behind the last one."""
        if len(self.states) > STATES:
            kept = self.states[here]
            self.forget()
            here = self.number(kept)
        chunks, first = [], [0]
        for word in words:
            chunks += [word[i : i + BLOCK] for i in range(0, len(word), BLOCK)]
            first.append(len(chunks))
        at = np.zeros(len(chunks), np.int64)
        at[:1] = here
        state, total = self.run(at, chunks)
        inner = np.setdiff1d(np.arange(1, len(chunks)), first)  # blocks that go on with a word
        if not len(inner):
            return total.tolist(), int(state[-1]) if len(chunks) else here
        maps = {(chunks[i], 0): (int(state[i]), int(total[i])) for i in inner.tolist()}
        likely = state[inner - 1]
        for i, s, (to, n) in zip(inner.tolist(), likely.tolist(), zip(*(x.tolist() for x in self.run(likely, [chunks[i] for i in inner])), strict=True), strict=True):
            maps[chunks[i], s] = (to, n)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            here, n = (int(state[a]), int(total[a])) if b > a else (0, 0)
            for chunk in chunks[a + 1 : b]:
                if (chunk, here) not in maps:
                    to, more = self.run(np.array([here]), [chunk])
                    maps[chunk, here] = (int(to[0]), int(more[0]))
                here, more = maps[chunk, here]
                n += more
            out.append(n)
        return out, here


class Counter(Remembering):
    """Counts the tokens of whole texts; a special string is one token."""

    def __init__(self, path: str):
        v = Vocabulary(path)
        self.machine = Transducer(v)
        super().__init__(lambda words: self.machine.counts([w.encode() for w in words]), dict.fromkeys(v.special, 1))


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """The machine of a vocabulary file (a name in the tokenizer folder, or a path), one for each worker."""
    if name not in _counters:
        _counters[name] = Counter(public_tokenizers.path(name))
    return _counters[name]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Special strings in a text count as their one token. Null text is empty and has
    no tokens. Rows are independent: repeated rows and null ids are counted like
    any other; other columns of the input play no part.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary).texts
        for batch in batches:
            n = pa.array(list(counts(t.as_py() for t in batch.column(2))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(df.dtypes)["doc_id"]
    out = df.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
