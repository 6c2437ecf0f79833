"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Vectors are centred on the sample's mean and projected on principal axes, turned by
rotations that are learned for balanced binary codes (each bit splits the sample in
half). The code is cut into substrings, and each substring is the key of one hash
table. Two vectors whose substrings agree in some table and whose codes differ in at
most ``radius`` of their leading bits are a candidate pair; pairs are made distinct,
and only then the original vectors are fetched and compared by their cosine in double
precision.

Number and length of the substrings and the radius follow from the number of rows and
from pairs at the very threshold, found in the sample and made from it: tables are
added until such pairs meet as often as the recall asks. Only ids and code words
travel for each table. Buckets of more than CROWD rows would list too many pairs: their
rows, with vectors, are compared block by block, each pair of blocks by a task of its
own, and what a row links to is summed there. A pair that meets in crowded buckets is
counted in the first of these and nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize, narrow

#: Smallest cosine of a link, and the share of pairs just above it that meet in some table.
COSINE, RECALL = 0.9, 0.97
#: The rotations are learned from at most about this many distinct vectors of a length, taken by a hash.
FIT_ROWS, FIT_ROUNDS = 20_000, 20
#: Sample rows from which pairs at the threshold are found and made; how far above it those found may lie.
EDGE_ROWS, EDGE = 2000, 0.03
#: Bits of a substring at least, for as many vectors of a length as the second number; fewer vectors are one bucket.
LEAST_BITS, FEW = 8, 64
#: Leading bits of the code that travel with each entry (two longs), the share of pairs at the threshold within the radius, and tables at most.
LEADING_BITS, WITHIN, MOST_TABLES = 128, 0.998, 256
#: What an entry of a table costs, in comparisons of two codes.
ENTRY_COST = 256
#: Rows of a bucket up to which its pairs are listed; rows of a block of a larger one.
CROWD, BLOCK = 512, 1024


class Coder(NamedTuple):
    """Codes of the vectors of one length."""

    projection: np.ndarray
    thresholds: np.ndarray
    bits: int
    tables: int
    radius: int

    def code(self, x: np.ndarray) -> np.ndarray:
        return x @ self.projection >= self.thresholds

    def keys(self, code: np.ndarray) -> np.ndarray:
        """Each row's substring in each table."""
        place = 1 << np.arange(self.bits, dtype=np.int64)
        return (code[:, : self.bits * self.tables].reshape(len(code), self.tables, self.bits) @ place).astype(np.int32)


def learn_codes(sample: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Projection (dimensions x bits) and threshold of each bit: centred principal axes, turned by as many learned rotations as the bits take."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    parts = []
    for _ in range(-(-bits // d)):
        rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(FIT_ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (left @ right).T
        parts.append(axes @ rotation)
    projection = np.concatenate(parts, axis=1)[:, :bits]
    return projection, np.median(sample @ projection, axis=0)


def edge_pairs(sample: np.ndarray, cosine: float, seed: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold: vectors turned away from the sample's in random directions, and pairs of the sample if it has enough."""
    x = sample[:EDGE_ROWS]
    aside = np.random.default_rng(seed).standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
    out = [(x, _unit(cosine * x + math.sqrt(1 - cosine * cosine) * aside))]
    near = x @ x.T
    a, b = np.nonzero(np.triu((near >= cosine) & (near <= cosine + EDGE), 1))
    if len(a) >= 50:
        every = np.linspace(0, len(a) - 1, min(len(a), EDGE_ROWS)).astype(int)
        out.append((x[a[every]], x[b[every]]))
    return out


def table_plan(rows: int, differ: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, tables) of least cost, if a bit of two vectors at the threshold differs with this probability."""

    def tables(bits: int) -> int:
        meet = (1 - differ) ** bits
        return 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))

    fits = [b for b in range(LEAST_BITS, 31) if tables(b) <= MOST_TABLES] or [LEAST_BITS]
    bits = min(fits, key=lambda b: tables(b) * (rows / 2**b + ENTRY_COST))
    return bits, tables(bits)


def learn(sample: np.ndarray, rows: int, cosine: float, recall: float) -> Coder:
    """The coder of one length from a sample of its unit vectors, for so many rows.

    Where codes can't be told to find enough, since so few vectors or components make
    them, and a bucket would list all pairs anyway, all vectors are one bucket.
    """
    edges = edge_pairs(sample, cosine)
    projection, thresholds = learn_codes(sample, LEADING_BITS)
    draft = Coder(projection, thresholds, 0, 0, 0)
    apart = [(draft.code(a) != draft.code(b)) for a, b in edges]
    bits, tables = table_plan(rows, max(float(x.mean()) for x in apart), recall)
    one = Coder(projection, thresholds, 0, 1, LEADING_BITS)
    if rows < FEW:
        return one
    most = tables + tables // 2 + 2  # bits of a code depend on each other, so tables may have to be added
    if bits * most > LEADING_BITS:
        projection, thresholds = learn_codes(sample, bits * most)
    coder = Coder(projection, thresholds, bits, most, 0)
    codes = [(coder.code(a), coder.code(b)) for a, b in edges]
    met = np.min([np.logical_or.accumulate(coder.keys(a) == coder.keys(b), axis=1).mean(axis=0) for a, b in codes], axis=0)
    enough = np.flatnonzero(met >= recall)
    radius = max(int(np.quantile((a[:, :LEADING_BITS] != b[:, :LEADING_BITS]).sum(axis=1), WITHIN)) for a, b in codes) + 1
    if not len(enough) and rows <= CROWD:
        return one
    return coder._replace(tables=int(enough[0]) + 1 if len(enough) else most, radius=radius)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def coded_vectors(vectors: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """(rep, w, embedding) with its length d, its key in each table, and the leading bits c0 and c1."""
    known = vectors.sparkSession.sparkContext.broadcast(coders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                some = batch.filter(pa.array(length == d))
                coder = known.value[d]
                code = coder.code(_unit(_matrix(some.column(2))))
                keys = coder.keys(code)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, coder.tables, dtype=np.int32), keys.ravel())
                words = np.packbits(code[:, :LEADING_BITS], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(words), d, np.int32)), lists, pa.array(words[:, 0]), pa.array(words[:, 1])], ["rep", "w", "embedding", "d", "keys", "c0", "c1"])

    kind = dict(vectors.dtypes)["embedding"]
    return vectors.select("rep", "w", "embedding").mapInArrow(run, f"rep long, w long, embedding {kind}, d int, keys array<int>, c0 long, c1 long")


def by_group(work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], columns: int) -> Callable:
    """Hands complete groups to ``work``: rows sorted by their first ``columns`` within a partition, and where each group starts and ends."""

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(columns)])
        return np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            new = edges(rest)
            if len(new):
                if (out := work(rest.slice(0, int(new[-1])), np.append(0, new))) is not None:
                    yield out
                rest = rest.slice(int(new[-1]))
        if rest is not None and rest.num_rows and (out := work(rest, np.array([0, *edges(rest), rest.num_rows]))) is not None:
            yield out

    return run


def candidate_pairs(entries: DataFrame, radius: dict[int, int]) -> DataFrame:
    """(a, b): distinct pairs of (d, t, key, rep, c0, c1) that share a bucket and whose leading bits are within the radius."""

    def work(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch | None:
        d, rep, c0, c1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3, 4, 5))
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i > 1:
                x, y = c0[i:j].view(np.uint64), c1[i:j].view(np.uint64)
                apart = np.bitwise_count(x[:, None] ^ x) + np.bitwise_count(y[:, None] ^ y)
                a, b = np.nonzero(np.triu(apart <= radius[int(d[i])], 1))
                if len(a):
                    a, b = rep[i:j][a], rep[i:j][b]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        if not out:
            return None
        a, b = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    group = ["d", "t", "key"]
    rows = entries.select(*group, "rep", "c0", "c1").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(by_group(work, 3), "a long, b long").distinct()


def reranked(pairs: DataFrame, coded: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) from the pairs whose original vectors are near."""
    x = coded.select(F.col("rep").alias("a"), F.col("w").alias("wa"), F.col("embedding").alias("ea"))
    y = coded.select(F.col("rep").alias("b"), F.col("w").alias("wb"), F.col("embedding").alias("eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                some = batch.filter(pa.array(length == d))
                near = np.einsum("ij,ij->i", _unit(_matrix(some.column(4))), _unit(_matrix(some.column(5)))) >= cosine
                a, b, wa, wb = (some.column(c).to_numpy(zero_copy_only=False)[near] for c in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((a, b), (wb, wa), (a, a))], ["rep", "links", "root"])

    both = pairs.join(x, "a").join(y, "b").select("a", "b", "wa", "wb", "ea", "eb")
    return both.mapInArrow(run, "rep long, links long, root long")


def crowd_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) from (d, t, key, bi, bj, block, rep, w, embedding, keys); ``keys`` is negative where a row's bucket isn't crowded."""

    def work(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch | None:
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            group = batch.slice(i, j - i)
            t, bi, bj = (group.column(c)[0].as_py() for c in (1, 3, 4))
            block, rep, w = (group.column(c).to_numpy(zero_copy_only=False) for c in (5, 6, 7))
            x, keys = _unit(_matrix(group.column(8))), group.column(9).flatten().to_numpy().reshape(j - i, -1)
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if bi != bj:
                near &= (block == bj)[:, None] != (block == bj)[None, :]
            for k in keys[:, :t].T:
                near &= (k[:, None] != k[None, :]) | (k < 0)
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                near, rep, w = near[np.ix_(some, some)], rep[some], w[some]
                root = rep.copy()
                while True:  # smallest number reachable inside the group
                    least = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (least == root).all():
                        break
                    root = least
                out.append((rep, near @ w, root))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "links", "root"])

    group = ["d", "t", "key", "bi", "bj"]
    rows = rows.select(*group, "block", "rep", "w", "embedding", "keys").repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(by_group(work, 5), "rep long, links long, root long")


def near_links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(rep, links, root): for distinct vectors (rep, w, h1, h2, embedding), pieces of the weight of what each links to, and a smallest rep reached.

    Vectors of each length have codes and tables of their own, and meet only each
    other. Samples are taken and ordered by the vectors' hashes h1 and h2, so codes and
    what they find don't depend on how rows are partitioned or named. There is a row,
    a sample and a coder (about half a megabyte for 64 components, more with the square
    of their number) on the driver for each length: lengths should be few.
    """
    lengths = {r["d"]: r["n"] for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    coders = {}
    for d, n in sorted(lengths.items()):
        part = int(min(1.0, FIT_ROWS / n) * (1 << 20)) + 1
        sample = vectors.where((F.size("embedding") == d) & (F.pmod("h1", F.lit(1 << 20)) < part)).orderBy("h1", "h2").select("embedding").toArrow().column(0).combine_chunks()
        if len(sample) < 2:
            sample = vectors.where(F.size("embedding") == d).orderBy("h1", "h2").limit(FIT_ROWS).select("embedding").toArrow().column(0).combine_chunks()
        coders[d] = learn(_unit(_matrix(sample)), n, cosine, recall)
    coded = materialize(coded_vectors(vectors, coders), "codes")
    entries = coded.select("d", "rep", "c0", "c1", F.posexplode("keys").alias("t", "key"))
    bucket = ["d", "t", "key"]
    crowded = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD)
    crowded = materialize(crowded.select(*bucket, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "crowded")
    radius = {d: c.radius for d, c in coders.items()}
    if crowded.isEmpty():
        return reranked(materialize(candidate_pairs(entries, radius), "pairs"), coded, cosine)
    few = narrow(crowded)
    pairs = candidate_pairs(entries.join(few, bucket, "left_anti"), radius)
    within = entries.join(few, bucket).groupBy("rep").agg(F.collect_list("t").alias("ts"), F.collect_list(F.shiftleft(F.col("t").cast("long"), 32) + F.col("key")).alias("crowds"))
    within = materialize(within, "within")
    sides = [within.select(F.col("rep").alias(c), F.col("crowds").alias(f"crowds_{c}")) for c in "ab"]
    pairs = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
    pairs = materialize(pairs.where(~F.coalesce(F.arrays_overlap("crowds_a", "crowds_b"), F.lit(False))).select("a", "b"), "pairs")
    keys = F.transform("keys", lambda k, t: F.when(F.array_contains("ts", t), k).otherwise(F.lit(-1)))
    rows = coded.join(within, "rep").select("d", "rep", "w", "embedding", keys.alias("keys"))
    rows = rows.select("*", F.posexplode("keys").alias("t", "key")).where("key >= 0").join(few, bucket)
    rows = rows.withColumn("block", F.pmod(F.hash("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    return reranked(pairs, coded, cosine).unionByName(crowd_links(rows, cosine))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths don't link with each other. Ids are whole
    numbers; others raise. Equal vectors are
    one class: they link with each other and share all other links, without being
    expanded into pairs. Rows with a null id count as vectors; their component is null
    only if no row in it has an id. Other columns of the input play no part; an empty
    table gives an empty result.
    """
    v = F.col("embedding")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    rows = rows.withColumns({f"h{k}": F.when(sound, F.xxhash64(F.lit(k), v)) for k in (1, 2)})
    keyed = materialize(rows.select("vec_id", "h1", "h2"), "vectors")
    classes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    found = materialize(near_links(classes.select("rep", "w", "h1", "h2", "embedding"), cosine, recall), "near")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = materialize(connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("id", "rep"), "groups")
    least = groups.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("group_least"))
    groups = groups.join(least, "component").select("rep", "group_least", "component")
    told = classes.select("h1", "h2", "rep", "w", "least").join(total, "rep", "left").join(groups, "rep", "left")
    component = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("group_least"))
    told = materialize(told.select("h1", "h2", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id")), "told")
    out = keyed.join(told, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings, whatever their labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
sound AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM parts GROUP BY 1 HAVING count(*) = count(v) AND bool_and(isfinite(v)) AND sum(v * v) > 0),
unit AS (SELECT vec_id, d, v / norm AS v FROM parts JOIN sound USING (vec_id)),
cosines AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.d = b.d AND a.vec_id <> b.vec_id GROUP BY 1, 2 HAVING sum(a.v * b.v) >= 0.9e0),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.c FROM reach r JOIN cosines e ON e.x = r.id)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM cosines GROUP BY 1) l ON l.x = e.vec_id JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) c ON c.id = e.vec_id
"""
