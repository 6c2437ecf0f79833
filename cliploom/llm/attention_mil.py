"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of which only the bag has a label. Every passage of
the whole text is encoded from the bytes it is made of; a gate, a product of a tanh
and a sigmoid layer, gives each passage a weight within its bag; the weighted sum of
the encodings is scored. Encoder, gate and head are learned together from the bags'
labels.

Scoring is one pass over the texts, each in pieces of bounded size: the softmax over
a bag is a running one, so a text of any length takes the memory of a piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

#: Words of a passage; a word of more bytes than LONG_WORD counts as several.
PASSAGE, LONG_WORD = 64, 256
#: Texts are taken in pieces of about so many bytes; no passage runs across two.
PIECE = 1 << 20
#: Hashed byte trigrams, and other features of a passage.
HASHED, PLAIN = 512, 8
WIDTH = HASHED + PLAIN
HIDDEN, GATE = 32, 16
#: At most so many labelled documents, and so many of a document's passages (evenly spread), teach the model.
TRAIN_ROWS, TRAIN_PASSAGES = 5_000, 256
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.004, 1e-4
FOLDS, THRESHOLD = 5, 0.3
BAG = "label double, n int, features binary"

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UPPER = ((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)).astype(np.float32)
_DIGIT = ((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)).astype(np.float32)
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)], np.float32)
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, LONG_WORD + 1, dtype=np.uint64)).astype(np.uint64)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at a space if one is near."""
    at = 0
    while len(text) - at > PIECE:
        end = text.find(b" ", at + PIECE, at + PIECE + 4096)
        end = end if end >= 0 else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encode(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, features): a row for each passage of the texts, float32. A text without words is one passage of zeros."""
    size = np.array([len(t) + 1 for t in texts])
    b = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    space, place = _SPACE[b], np.arange(len(b), dtype=np.int32)
    inside = ~space
    fresh = inside.copy()
    fresh[1:] &= space[:-1]
    offset = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % LONG_WORD
    begins = inside & (offset == 0)
    words = np.cumsum(begins, dtype=np.int32)
    ends = np.cumsum(size)
    before = np.concatenate([[0], words[ends[:-1] - 1]]).astype(np.int32)
    local = np.maximum(words - before[text_of] - 1, 0) // PASSAGE
    count = local[ends - 1] + 1
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    passage = local + first[:-1].astype(np.int32)[text_of]
    owner = np.repeat(np.arange(len(texts)), count)

    code = b[:-2].astype(np.uint32) | (b[1:-1].astype(np.uint32) << 8) | (b[2:].astype(np.uint32) << 16)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - HASHED.bit_length() + 1)
    here = (text_of[:-2] == text_of[2:]) & (inside[:-2] | inside[1:-1])
    hashed = np.bincount(passage[:-2][here].astype(np.int64) * HASHED + bucket[here], minlength=n * HASHED).reshape(n, HASHED).astype(np.float32)
    out = np.empty((n, WIDTH), np.float32)
    out[:, :HASHED] = np.sqrt(hashed / np.maximum(hashed.sum(1, keepdims=True), 1))

    total = lambda weight: np.bincount(passage, weight, n)
    chars, at = np.maximum(total(inside), 1), np.flatnonzero(begins)
    n_words = np.bincount(passage[at], minlength=n)
    many = np.maximum(n_words, 1)
    plain = [total(_UPPER[b]) / chars, total(_DIGIT[b]) / chars, total(_SYMBOL[b]) / chars, total(b == 0x0A) / many, chars / many / 10, np.log1p(n_words) / 5]
    if len(at):
        value = np.add.reduceat(np.where(inside, b, 0).astype(np.uint64) * _POWERS[offset], at)
        of = passage[at]
        seen = of[np.unique(value + of.astype(np.uint64) * _POWERS[1], return_index=True)[1]]
        again = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
        plain += [np.bincount(seen, minlength=n) / many, np.bincount(of[1:][again], minlength=n) / many]
    else:
        plain += [np.zeros(n)] * 2
    out[:, HASHED:] = np.stack(plain, 1)
    out[n_words == 0] = 0
    return owner, out


@dataclass
class Model:
    """Encoder (w, b), gate (v, u, g) and head (c, d)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    g: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @staticmethod
    def fresh(seed: int = 11) -> Model:
        """Where learning starts. The head is zero, so an untaught model scores one half."""
        r = np.random.default_rng(seed)
        of = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        w = of(WIDTH, HIDDEN) * np.float32(4)
        return Model(w, np.zeros(HIDDEN, np.float32), of(HIDDEN, GATE), of(HIDDEN, GATE), of(GATE), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.g, self.c, self.d]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encodings, both halves of the gate, and the scores that softmax turns into weights."""
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        return h, t, s, (t * s) @ self.g

    def dump(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype("<f4").tobytes()

    @staticmethod
    def load(data: bytes) -> Model:
        flat, out, at = np.frombuffer(data, "<f4"), [], 0
        for p in Model.fresh().parts():
            out.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        return Model(*out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def loss_and_gradient(m: Model, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over bags of ``sizes`` consecutive passages, and its gradient by the model's parts."""
    first, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
    h, t, s, score = m.passages(x)
    a = np.exp(score - np.maximum.reduceat(score, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(h * a[:, None], first)
    logit = z @ m.c + m.d[0]
    loss = float(np.mean(np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))))
    e = (_sigmoid(logit) - y) / len(y)
    dz = (e[:, None] * m.c)[bag]
    da = (dz * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first)[bag])
    dt, dgate = ds[:, None] * m.g * s * (1 - t * t), ds[:, None] * m.g * t * s * (1 - s)
    dh = a[:, None] * dz + dt @ m.v.T + dgate @ m.u.T
    dx = dh * (1 - h * h)
    return loss, [x.T @ dx, dx.sum(0), h.T @ dt, h.T @ dgate, (t * s).T @ ds, z.T @ e, e.sum(keepdims=True)]


def fit(bags: Sequence[tuple[float, np.ndarray]], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Adam over batches of bags (label, passages x WIDTH), in an order that the seed fixes."""
    m = Model.fresh(seed)
    order, step = np.random.default_rng(seed), 0
    mean, square = ([np.zeros_like(p, np.float32) for p in m.parts()] for _ in range(2))
    for _ in range(epochs if bags else 0):
        places = order.permutation(len(bags))
        for k in range(0, len(places), BATCH):
            chosen = [bags[i] for i in places[k : k + BATCH]]
            x = np.concatenate([f for _, f in chosen]).astype(np.float32)
            _, grad = loss_and_gradient(m, x, np.array([len(f) for _, f in chosen]), np.array([y for y, _ in chosen], np.float32))
            step += 1
            rate = RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, q in zip(m.parts(), grad, mean, square, strict=True):
                a += 0.1 * (g - a)
                q += 0.001 * (g * g - q)
                p -= rate * (a / (np.sqrt(q) + 1e-8)) + RATE * DECAY * p
    return m


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled ids, the first in the order of a hash.

    Rows of ``labels`` without an id or a label teach nothing; of several labels of an
    id the highest counts, of several texts of an id one does. The sample is bounded,
    so one task fits it; without any rows the model is the fresh one.
    """
    known = labels.select(labels[f"`{id_col}`"].alias("id"), labels[f"`{label_col}`"].cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    ids = materialize(known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows), "labelled")
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def to_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_bytes(batch.column(2))):
                x = np.concatenate([encode([p])[1].astype(np.float16) for p in pieces(text.as_py())])
                if len(x) > TRAIN_PASSAGES:
                    x = x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()])], ["id", "label", "n", "features"])

    bags = materialize(one.mapInArrow(to_bags, f"id {dict(one.dtypes)['id']}, {BAG}"), "bags")

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for label, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found.append((label, np.frombuffer(data, np.float16).reshape(n, WIDTH)))
        yield pa.RecordBatch.from_arrays([pa.array([fit(found).dump()])], ["model"])

    ordered = bags.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("label", "n", "features")
    taught = ordered.mapInArrow(teach, "model binary").first()
    return Model.load(taught["model"]) if taught else Model.fresh()


class _Bags:
    """Running softmax sums of the bags of one batch."""

    def __init__(self, n: int):
        self.most, self.sum, self.z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        self.n, self.focus = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def add(self, m: Model, doc: np.ndarray, x: np.ndarray) -> None:
        """Passages ``x`` of documents ``doc``, which is sorted."""
        h, _, _, score = m.passages(x)
        at = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
        who, size = doc[at], np.diff(np.append(at, len(doc)))
        most = np.maximum.reduceat(score, at)
        place = np.arange(len(doc)) - np.repeat(at, size)
        best = np.minimum.reduceat(np.where(score == np.repeat(most, size), place, len(doc)), at)
        self.focus[who] = np.where(most > self.most[who], self.n[who] + best, self.focus[who])
        top = np.maximum(self.most[who], most)
        e = np.exp(score - np.repeat(top, size))
        old = np.exp(self.most[who] - top)
        self.sum[who] = self.sum[who] * old + np.add.reduceat(e, at)
        self.z[who] = self.z[who] * old[:, None] + np.add.reduceat(h * e[:, None], at)
        self.most[who], self.n[who] = top, self.n[who] + size

    def result(self, m: Model) -> list[np.ndarray]:
        score = _sigmoid((self.z / self.sum[:, None]) @ m.c.astype(float) + m.d[0])
        return [score, self.n, self.focus, 1 / self.sum]


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with score, n_passages, focus (the passage with the most weight, from 0) and focus_weight.

    Whole texts are read; null counts as empty, which is one passage without words.
    Rows don't depend on one another. Columns of these names are replaced.
    """
    added = ["score", "n_passages", "focus", "focus_weight"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    kept = docs.select(*[docs[f"`{c}`"] for c in keep])
    schema = kept.schema.add("score", "double").add("n_passages", "long").add("focus", "long").add("focus_weight", "double")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    data = model.dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(data)
        for batch in batches:
            bags, block, who, size = _Bags(batch.num_rows), [], [], 0
            for d, text in enumerate(_bytes(batch.column(1))):
                for piece in pieces(text.as_py() or b""):
                    block.append(piece)
                    who.append(d)
                    size += len(piece)
                    if size >= PIECE:
                        owner, x = encode(block)
                        bags.add(m, np.array(who)[owner], x)
                        block, who, size = [], [], 0
            if block:
                owner, x = encode(block)
                bags.add(m, np.array(who)[owner], x)
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *map(pa.array, bags.result(m))], [*keep, *added])

    return rows.mapInArrow(run, schema)


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    """Whether the CRC of the id as text divides by ``folds``; a row without an id never teaches."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == 0, F.lit(True))


def op11_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by a model of the labels that aren't held out.

    Scores have six places: beyond them sums of single precision depend on what stood beside a row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = scored(docs, model, keep=["doc_id"])
    return out.withColumn("score", F.round("score", 6)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "focus", "focus_weight")
