"""The Merkle manifest, importance resampling and the multiple-instance classifier against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import attention_mil, importance_resampling, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def rows_of(path):
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{path}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Writes ``rows`` as the documents of a folder and gives its path."""

    def write(rows, **others):
        root = tmp_path_factory.mktemp("tables")
        extra = {"tree": F.lit(3), "row": F.lit("x"), "carry": F.lit(1.5), "n_features": F.lit(-1), "bucket": F.lit("b"), "label": F.lit(9)}
        spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3).write.parquet(f"{root}/documents.parquet")
        for name, (data, schema) in others.items():
            spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return write


# --- Merkle manifest -------------------------------------------------------


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return sha("-" if x is None else f"{len(x.encode())}:{x}" for x in fields)


def climb(nodes):
    """All levels of a tree, and for each leaf its siblings as (left, right) of each level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i - i % 8 : i - i % 8 + 8]
            path.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def manifest_by_hand(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((ordered, *climb([leaf(*r) for r in ordered])))
    root, top = climb([t[1] for t in trees])
    out = []
    for (ordered, subroot, paths), over in zip(trees, top, strict=True):
        for r, path in zip(ordered, paths, strict=True):
            whole = path + over
            proof = sha(x for a, b in whole for x in a + b)
            text, changed = r[1], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            if changed and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r[0], text, *r[2:])
            for a, b in whole:
                node = sha([*a, node, *b])
            out.append((r[0], leaf(*r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "ABC é ÄÖ 😀", "en", "a", 9), (2, "other", "en", "b", None), (2**60 + 1, "X" * 300_000, "é", None, 1), (None, "Z", "zz", "s", 3), (0, "A", "", "s", 3)]


@pytest.mark.parametrize("n", [1, 9, 65, 513, 4100])
def test_manifest_equals_plain_trees(spark, tables, n):
    rng = random.Random(n)
    rows = [(i, f"Text {i} {rng.random()}", rng.choice(["en", "en", "de", None]), "s", i) for i in range(n)] + ODD
    rng.shuffle(rows)
    assert got(merkle_manifest.op13_merkle_manifest(spark, tables(rows))) == manifest_by_hand(rows)


def test_manifest_on_the_given_table(spark):
    assert got(merkle_manifest.op13_merkle_manifest(spark, DATA)) == manifest_by_hand(rows_of(DATA))


def test_manifest_of_nothing_and_of_one_row(spark, tables):
    assert merkle_manifest.op13_merkle_manifest(spark, tables([])).collect() == []
    one = merkle_manifest.op13_merkle_manifest(spark, tables(ODD[1:2])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"]
    assert one["verified"] and one["proof_sha256"] == sha([])


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 4), (3, 2), (8, 1)])
def test_stored_levels_do_not_change_proofs(spark, fanout, levels):
    docs = spark.range(300).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).cast("string").alias("g"))
    table = merkle_manifest.leaves(docs, F.sha2(F.col("id").cast("string"), 256), F.col("g"), F.col("id"), id=F.col("id"))
    m = merkle_manifest.build(table, fanout, levels)

    def emit(t, right, paths):
        import pyarrow as pa

        return pa.table({"at": t["at"], "root": [merkle_manifest.fold(d, p) for d, p in zip(t["digest"].to_pylist(), paths, strict=True)]})

    assert {r["root"] for r in merkle_manifest.proofs(m, emit, "at long, root string").collect()} == {m.root}


# --- importance resampling -------------------------------------------------


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c > "\x7f" or c.isalnum() else " " for c in lower).split(" ")


def features_of(text):
    words = [w for w in words_of(text) if w]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def resampled_by_hand(docs, items):
    """doc_id, n_features, weight, score, rank of every row."""
    s, t = collections.Counter(), collections.Counter()
    for counts, texts in ((s, [r[1] for r in docs]), (t, items)):
        for text in texts:
            counts.update(map(bucket, features_of(text)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)}
    rows = []
    for doc_id, text, *_ in docs:
        f = features_of(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, rows), key=repr)


def test_crc_of_joined_words():
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(0, 70), 300]]
    left = [rng.choice(words) for _ in words]
    code = lambda ws: np.array([zlib.crc32(w) for w in ws], np.uint32)
    assert importance_resampling.joined(code(left), code(words), words).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(left, words)]


PARAGRAPH = "The museum's façade — built 1911 — ist ÉTÉ\x85x 中文 no_break space"
TEXTS = [None, "", "\n\n", " \t", "one", "One\ntwo\n\n three\n", PARAGRAPH * 9, "\n".join([PARAGRAPH, "", "license line"] * 40), "x" * 700_000 + " y " + "z" * 70, "a b c\n" * 90_000, "word " * 120_000, " Ünï A1" * 30]


def test_resampling_equals_plain_counts(spark, tables):
    rng = random.Random(5)
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, PARAGRAPH * 7, "en", "s", 1), (6, TEXTS[6], "en", "s", 1)]
    docs += [(100 + i, " ".join(rng.choice("abcdefgh") + rng.choice(["Museum", "tax", "é"]) for _ in range(rng.randrange(60))), "de", "t", 1) for i in range(200)]
    items = ["the museum façade built 1911\nlicense line", None, "", "tax b-museum"]
    path = tables(docs, benchmark=([(i, t) for i, t in enumerate(items)], "item_id long, text string"))
    assert got(importance_resampling.op12_importance_resampling(spark, path)) == resampled_by_hand(docs, items)


def test_resampling_of_the_given_tables(spark):
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    expected = resampled_by_hand(rows_of(DATA), items)
    assert got(importance_resampling.op12_importance_resampling(spark, DATA)) == expected
    docs, target = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = importance_resampling.resampled(docs.withColumn("weight", F.lit("mine")), target)
    assert kept.columns == [*docs.columns, "weight"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in expected if r[4])


def test_resampling_of_nothing(spark, tables):
    path = tables([], benchmark=([], "item_id long, text string"))
    assert importance_resampling.op12_importance_resampling(spark, path).collect() == []
    path = tables(ODD, benchmark=([], "item_id long, text string"))
    assert got(importance_resampling.op12_importance_resampling(spark, path)) == resampled_by_hand(ODD, [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert importance_resampling.resampled(docs, docs.limit(0)).collect() == []


# --- multiple-instance classifier ------------------------------------------


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    m = attention_mil.Model(*[p.astype(float) for p in attention_mil.Model.fresh().parts()])
    m.c += rng.standard_normal(m.c.shape)
    x, sizes, y = rng.random((9, attention_mil.WIDTH)) * 0.1, np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])
    grads = attention_mil.loss_and_gradient(m, x, sizes, y)[1]
    for p, g in zip(m.parts(), grads, strict=True):
        assert p.shape == g.shape
        for at in [tuple(rng.integers(n) for n in p.shape) for _ in range(8)]:
            old, eps, side = p[at], 1e-5, []
            for d in (eps, -eps):
                p[at] = old + d
                side.append(attention_mil.loss_and_gradient(m, x, sizes, y)[0])
            p[at] = old
            assert g[at] == pytest.approx((side[0] - side[1]) / 2 / eps, rel=1e-4, abs=1e-8)


def passages_by_hand(text):
    """Words by 64, those of more than 256 bytes as several, as (words, bytes)."""
    parts = []
    for w in re.findall(rb"[^\x20\x09-\x0d]+", text):
        parts += [w[i : i + 256] for i in range(0, len(w), 256)]
    return [parts[i : i + 64] for i in range(0, len(parts), 64)] or [[]]


def test_passages_and_their_plain_features():
    texts = [b"", b"  \n ", b"A b", ("Wörter und ## MEHR mehr mehr " * 50).encode(), b"x" * 1000 + b" y\n" * 200, b"", b"1 2 3"]
    owner, x = attention_mil.encode(texts)
    expected = [(d, p) for d, t in enumerate(texts) for p in passages_by_hand(t)]
    assert owner.tolist() == [d for d, _ in expected]
    for row, (_, parts) in zip(x, expected, strict=True):
        chars, plain = sum(map(len, parts)), row[attention_mil.HASHED :]
        if not parts:
            assert not row.any()
            continue
        upper = sum(65 <= c <= 90 for p in parts for c in p)
        assert plain[0] == pytest.approx(upper / chars) and plain[4] == pytest.approx(chars / len(parts) / 10)
        assert plain[6] == pytest.approx(len(set(parts)) / len(parts))
        assert plain[7] == pytest.approx(sum(a == b for a, b in zip(parts, parts[1:])) / len(parts))
        assert (row[: attention_mil.HASHED] ** 2).sum() == pytest.approx(1, abs=1e-3)


def test_running_softmax_is_the_whole_one(spark):
    rng = np.random.default_rng(2)
    m = attention_mil.Model.fresh()
    m.c[:] = rng.standard_normal(m.c.shape)
    text = " ".join(rng.choice(["Alpha", "beta##", "GAMMA", "12"]) * int(rng.integers(1, 4)) for _ in range(70_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "short", "c"), (None, text[:900], "d"), (1, text, "e")], "doc_id long, text string, score string")
    rows = attention_mil.scored(docs, m).collect()
    assert rows[0]["n_passages"] > 1000
    for r in rows:
        x = np.concatenate([attention_mil.encode([p])[1] for p in attention_mil.pieces((r["text"] or "").encode())])
        h, _, _, s = m.passages(x)
        a = np.exp(s - s.max())
        a /= a.sum()
        assert (r["n_passages"], r["focus"]) == (len(x), int(a.argmax()))
        assert r["focus_weight"] == pytest.approx(a.max(), rel=1e-4)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(a @ h @ m.c + m.d[0]))), rel=1e-4)


def area(score, label):
    order = np.argsort(np.argsort(score))
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / n1 / (len(label) - n1)


def test_quality_of_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in attention_mil.op11_quality_mil(spark, data).collect()}
    assert len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    labels = [x for x in duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall() if rows[x[0]]["held_out"]]
    score, label = np.array([rows[i]["score"] for i, _ in labels]), np.array([q for _, q in labels])
    print("area", area(score, label), "kept good", (score[label == 1] >= 0.3).mean(), "rejected bad", (score[label == 0] < 0.3).mean())
    assert area(score, label) > 0.9
    assert (score[label == 1] >= 0.3).mean() > 0.98


def test_labels_of_held_out_rows_teach_nothing(spark, tables):
    docs = [(i, ("good words here " if i % 3 else "BAD!! ### ") * 30, "en", "s", 1) for i in range(60)] + [(None, "x", "en", "s", 1), (3, "good again", "en", "s", 1)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 0, 0), (4, None, 0), (5, 0, 0)]
    kinds = "doc_id long, quality int, toxic int"
    flip = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (attention_mil.op11_quality_mil(spark, tables(docs, labels=(x, kinds))).collect() for x in (labels, flip))
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    untaught = attention_mil.op11_quality_mil(spark, tables(docs, labels=([], kinds))).collect()
    assert {r["score"] for r in untaught} == {0.5}
    assert attention_mil.op11_quality_mil(spark, tables([], labels=(labels, kinds))).collect() == []
