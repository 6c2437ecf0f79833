"""Merkle manifest of a dataset, with checkpoint and recompute.

Each row is a leaf; the leaves of a group (a language), by id, make a tree in which
``FANOUT`` consecutive nodes become one, and the groups' subroots, by name, make the
tree on top. Only every ``LEVELS``-th level of a tree is stored. The nodes below one
stored node, FANOUT ** LEVELS of the stored level beneath at most, are an aligned
subtree; a proof regenerates its missing inner levels from the stored nodes beneath,
emits the siblings and forgets them. So raising a level and proving are both one
shuffle of digests by subtree, and no task holds more than a subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.ordering import numbered

from .scratch import materialize, narrow

FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, height int, at long, digest string"
BLOCK = "tree long, block long, path array<string>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 over the fields: ``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*parts), 256)


def height(n: Column, fanout: int = FANOUT) -> Column:
    """Levels above n leaves: the number of digits of n - 1 in base ``fanout``, none for a single leaf."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, fanout))).cast("int")


def join_hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def regenerate(stored: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The levels of an aligned subtree, ``stored`` first, up to its top."""
    out = [stored]
    for _ in range(levels):
        below = out[-1]
        out.append([join_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[str]], i: int, fanout: int) -> list[str]:
    """Of the i-th stored node on each level below the top: what stands left of it in its run, and what stands right."""
    out = []
    for nodes in levels[:-1]:
        run = i - i % fanout
        out += ["".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])]
        i //= fanout
    return out


def fold(digest: str, path: Sequence[str]) -> str:
    """The root that a leaf and its siblings (left and right of each level) give."""
    for k in range(0, len(path), 2):
        digest = hashlib.sha256(f"{path[k]}{digest}{path[k + 1]}".encode()).hexdigest()
    return digest


def steps(k: int, height: int, levels: int) -> int:
    """Levels from stored level k to the next one or to the tree's root."""
    return min(levels, height - k * levels)


@dataclass
class Forest:
    """Trees by their stored levels: tables (tree, height, at, digest) of level 0, ``levels``, 2 * ``levels`` and so on.

    A tree that ends before such a level stands in it with its root.
    """

    stored: list[DataFrame]
    fanout: int
    levels: int

    @property
    def span(self) -> int:
        """Stored nodes beneath a node of the next stored level, at most."""
        return self.fanout**self.levels

    def ends(self, k: int) -> Column:
        """Whether a tree's root is the top of its only subtree over stored level k."""
        last = F.col("height") <= (k + 1) * self.levels
        return last & (F.col("height") > k * self.levels) if k else last

    def roots(self) -> DataFrame:
        """(tree, digest): the root of every tree."""
        out = self.stored[0].where("height = 0")
        for k in range(1, len(self.stored)):
            out = out.unionByName(self.stored[k].where(self.ends(k - 1) & (F.col("height") > 0)))
        return out.select("tree", "digest")


def forest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Forest:
    """Trees from a written table (tree, height, at, digest); ``at`` numbers a tree's leaves from 0 without gaps.

    Every pass raises all trees by ``levels`` and stores the result, which has one row
    for fanout ** levels. An empty table gives a forest without trees.
    """
    out = Forest([leaves.select("tree", "height", "at", "digest")], fanout, levels)
    most = leaves.agg(F.max("height")).first()[0] or 0
    for k in range(-(-most // levels)):
        out.stored.append(materialize(_raised(out, k), f"level{(k + 1) * levels}"))
    return out


def _raised(trees: Forest, k: int) -> DataFrame:
    """The next stored level above stored level k."""
    fanout, levels = trees.fanout, trees.levels

    def reduce(key: tuple, t: pa.Table) -> pa.Table:
        height = t["height"][0].as_py()
        top = regenerate(t.sort_by("at")["digest"].to_pylist(), steps(k, height, levels), fanout)[-1]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "height": pa.array([height], pa.int32()), "at": pa.array([key[1].as_py()], pa.int64()), "digest": top})

    nodes = trees.stored[k].where(F.col("height") > k * trees.levels)
    return nodes.groupBy("tree", F.expr(f"at div {trees.span}").alias("block")).applyInArrow(reduce, NODE)


Emit = Callable[[pa.Table, pa.Table, Iterator[list[str]]], pa.Table]


def prove(trees: Forest, k: int, nodes: DataFrame, blocks: DataFrame, emit: Emit, schema: str) -> DataFrame:
    """What ``emit`` makes of each subtree over stored level k.

    It gets the subtree's rows of ``nodes`` in their order, its row of ``blocks``
    (tree, block, path and more; ``path`` is that of the subtree's top) and the rows'
    paths, one at a time: the siblings on the levels that are regenerated here and
    then those above. A path lists for each level what stands left of the node in its
    run and what stands right of it, as hex.
    """
    fanout, levels = trees.fanout, trees.levels

    def subtree(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("at")
        inner = regenerate(t["digest"].to_pylist(), steps(k, t["height"][0].as_py(), levels), fanout)
        over = right["path"][0].as_py()
        return emit(t, right, (siblings(inner, i, fanout) + over for i in range(len(t))))

    keyed = nodes.withColumn("block", F.expr(f"at div {trees.span}"))
    tops = blocks.withColumns({"of_tree": F.col("tree") + 0, "of_block": F.col("block") + 0}).drop("tree", "block")
    return keyed.groupBy("tree", "block").cogroup(tops.groupBy("of_tree", "of_block")).applyInArrow(subtree, schema)


def _as_blocks(t: pa.Table, right: pa.Table, paths: Iterator[list[str]]) -> pa.Table:
    """A node of a stored level is the top of the block of that number beneath."""
    return pa.table({"tree": t["tree"], "block": t["at"], "path": pa.array(list(paths), pa.list_(pa.string()))})


def lowest_blocks(trees: Forest, above: DataFrame) -> DataFrame:
    """(tree, block, path): the paths of the tops of the lowest subtrees, from (tree, path) of the trees' roots.

    Goes down from the highest stored level; each has a fanout ** levels-th of the
    rows of the one beneath, so the paths stay few beside the leaves.
    """
    over = None
    for k in range(max(len(trees.stored) - 2, 0), -1, -1):
        only = trees.stored[k].where(trees.ends(k) & (F.col("at") == 0)).select("tree", F.lit(0).cast("long").alias("block"))
        blocks = only.join(above, "tree").select("tree", "block", "path")
        blocks = blocks if over is None else blocks.unionByName(over)
        if k:
            nodes = trees.stored[k].where(F.col("height") > k * trees.levels)
            over = materialize(prove(trees, k, nodes, blocks, _as_blocks, BLOCK), f"paths{k * trees.levels}")
    return blocks


@dataclass
class Manifest:
    """``rows``: the leaves with tree, height and at. ``groups``: (at, tree, name, n, digest) of each group's root. The trees beneath and above, and the root, None without rows."""

    rows: DataFrame
    groups: DataFrame
    lower: Forest
    upper: Forest
    root: str | None


def leaves(docs: DataFrame, digest: Column, group: Column, key: Column, **carry: Column) -> DataFrame:
    """A written table (name, key, digest, row, carry): what :func:`build` makes a manifest of.

    Other columns of ``docs`` play no part, whatever their names; ``carry`` travels
    with each leaf. ``row`` tells repeated rows apart.
    """
    carried = F.struct(*[c.alias(n) for n, c in carry.items()]) if carry else F.lit(None).cast("string")
    return materialize(docs.select(group.alias("name"), key.alias("key"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"), carried.alias("carry")), "leaves")


def build(table: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of :func:`leaves`: a tree for each group by key, one over the groups' roots by name.

    Nulls come first among names and keys; equal keys go by digest, so the root depends
    on the rows alone. A group may hold any share of the rows: leaves are numbered by
    ranges, of which a group takes as many as it needs.
    """
    placed = numbered(table, ["name", "key", "digest", "row"], write=lambda df: materialize(df, "ordered"))
    found = materialize(placed.groupBy("name").agg(F.min("number").alias("tree"), F.count(F.lit(1)).alias("n")), "groups")
    sizes = narrow(found.select(F.col("name").alias("group"), "tree", height(F.col("n"), fanout).alias("height")))
    joined = placed.join(sizes, placed["name"].eqNullSafe(sizes["group"]))
    rows = materialize(joined.select("tree", "height", (F.col("number") - F.col("tree")).alias("at"), "digest", "carry"), "leaves")
    lower = forest(rows, fanout, levels)
    roots = materialize(lower.roots().join(found, "tree"), "roots")
    groups = materialize(numbered(roots, ["name"], "at", write=lambda df: materialize(df, "ordered")), "roots")
    total = height(F.lit(found.count()).cast("long"), fanout)
    upper = forest(groups.select(F.lit(0).cast("long").alias("tree"), total.alias("height"), "at", "digest"), fanout, levels)
    root = upper.roots().first()
    return Manifest(rows, groups, lower, upper, root["digest"] if root else None)


def proofs(m: Manifest, emit: Emit, schema: str) -> DataFrame:
    """What ``emit`` makes of the leaves and their paths to the root of all (see :func:`prove`), subtree by subtree.

    ``right`` has the group's root as ``subroot``. Inner levels live only as long as
    their subtree is at hand; paths too, unless ``emit`` returns them.
    """
    top = m.rows.sparkSession.createDataFrame([(0, [])], "tree long, path array<string>")
    tops = prove(m.upper, 0, m.upper.stored[0], lowest_blocks(m.upper, F.broadcast(top)), _as_blocks, BLOCK)
    above = materialize(tops.select(F.col("block").alias("at"), "path").join(m.groups, "at").select("tree", "path", F.col("digest").alias("subroot")), "above")
    blocks = lowest_blocks(m.lower, above.select("tree", "path")).join(above.select("tree", "subroot"), "tree")
    return prove(m.lower, 0, m.rows, blocks, emit, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the row still verifies once a third of the texts were lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    other = leaf_digest([F.translate("text", upper, lower) if f == "text" else F.col(f) for f in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    table = leaves(docs, leaf_digest([F.col(f) for f in FIELDS]), F.col("lang"), F.col("doc_id"), doc_id=F.col("doc_id"), other=F.when(chosen, other))
    m = build(table)
    root = m.root

    def check(t: pa.Table, right: pa.Table, paths: Iterator[list[str]]) -> pa.Table:
        ids, other = t["carry"].combine_chunks().flatten()
        digest = t["digest"].to_pylist()
        proof, folded = [], []
        for own, changed, path in zip(digest, other.to_pylist(), paths, strict=True):
            proof.append(join_hash(path))
            folded.append(fold(changed or own, path))
        same = pa.array([f == root for f in folded])
        return pa.table({"doc_id": ids, "leaf": digest, "subroot": [right["subroot"][0].as_py()] * len(t), "root": [root] * len(t), "proof_sha256": proof, "folded_root": folded, "verified": same})

    kind = dict(docs.dtypes)["doc_id"]
    return proofs(m, check, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
