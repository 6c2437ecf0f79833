"""Constraint, training and attention queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.numeric import weight
from cliploom.operators import attention, catalog, checks, graph, subsets, token_bank, training
from cliploom.plans import model_queries as M
from cliploom.plans import surrogates as S


def single_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for detections in their order's frame."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.lit(0).alias("frame_idx"), F.array("l_quantity", "l_tax").alias("vector"))
    frames = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), F.lit(0).alias("frame_idx"))
    return checks.single_detections(frames, li, 2, -1.0).select("clip_id", "frame_idx", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


def unequal_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return checks.unequal_batches(n.select(F.floor(F.col("user_id") / 2).alias("batch_id"), "n_frames"))


def fusion_input_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In some clips a token is cut short; the layout has places beyond 16 time steps and 8 modalities."""
    t = M._tokens(spark, sf_dir)
    t = t.withColumn("token", F.when(F.expr("clip_id % 5 = 2 AND modality = 'rgb' AND slot IN (1, 3)"), F.slice("token", 1, 7)).otherwise(F.col("token")))
    width = M._width(spark, sf_dir)
    return checks.fusion_input_problems(token_bank.token_bank(t, t, width), width, 16, 8)


def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no order names."""
    named = S.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    ordered = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return checks.missing_names(named, named.join(ordered, "c_custkey"))


def cross_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of a clip attends to all of the clip's."""
    out = attention.cross_attention(S.vectors(spark, sf_dir))
    return M._r(out.select(F.col("clip_id").alias("graph_id"), F.col("slot").alias("i"), "d", "v"), 7)


def architecture_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's graph for the modalities that events have."""
    return graph.architecture_edges(S.table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct())


def subset_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [x[0] for x in subsets.LAYOUT]
    one = S.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    each = one.select(F.col("doc_id").alias("clip_id"), F.col("toxic").alias("label"), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("k", "modality"))
    p = each.select("clip_id", "modality", "label", ((F.col("clip_id") * (F.col("k") + 3)) % 11 - 7.25).cast("double").alias("logit"))
    return M._r(training.subset_runs(subsets.modality_sets(spark, names), p), 6)


def trained_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("feature"), (F.col("label") >= 5).cast("int").alias("label"))
    return training.apply_head(e, training.train_head(e)).select("vec_id", "label", "prediction", F.round("probability", 6).alias("probability"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial means of projected features: the mean over t of each clip's linear outputs."""
    f = S.features(spark, sf_dir).withColumn("w", weight(F.col("d"), F.lit(1)))
    return M._r(f.groupBy("clip_id", "d").agg(F.avg(F.col("v") * F.col("w")).alias("v")), 8)


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "nation")
    names = n.select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("old "), F.col("n_name"))).otherwise(F.col("n_name")).alias("name"))
    aliases = n.where("n_nationkey % 8 = 0").select(F.concat(F.lit("old "), F.col("n_name")).alias("alias"), F.col("n_name").alias("target"))
    return catalog.resolve(names, aliases, n.select(F.col("n_name").alias("key"), "n_regionkey")).select("name", "n_regionkey", "known")


def architecture_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dot_lines(architecture_edges(spark, sf_dir))


def modality_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the report for each modality: its events and users."""
    ev = S.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"))
    return catalog.markdown_rows(ev.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")))


QUERIES = {f.__name__: f for f in (single_detections, unequal_batches, fusion_input_problems, missing_names, cross_attention, architecture_edges, subset_runs, trained_head, mean_pool, alias_lookup, architecture_dot, modality_markdown)}
ORACLES = {
    "single_detections": "WITH d AS (SELECT l_orderkey, count(*) AS n, any_value(l_quantity) AS a, any_value(l_tax) AS b FROM lineitem GROUP BY 1) SELECT o_orderkey AS clip_id, 0::INTEGER AS frame_idx, CASE WHEN n = 1 THEN a ELSE -1e0 END AS a, CASE WHEN n = 1 THEN b ELSE -1e0 END AS b FROM orders LEFT JOIN d ON l_orderkey = o_orderkey",
    "unequal_batches": "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id // 2 AS batch_id, min(n) AS shortest, max(n) AS longest FROM n GROUP BY 1 HAVING min(n) <> max(n)",
    "fusion_input_problems": f"""WITH {M._TOKENS}, {M.LAYOUT_SQL}, places AS (SELECT modality_id, s.slot FROM lay, range(32) s(slot) WHERE s.slot < slots),
late AS (SELECT count(*) FILTER (WHERE slot >= 16) AS t, count(*) FILTER (WHERE modality_id >= 8) AS m FROM places)
SELECT clip_id, count(DISTINCT slot) FILTER (WHERE clip_id % 5 = 2 AND modality = 'rgb' AND slot IN (1, 3)) AS bad_width, any_value(late.t) AS bad_time, any_value(late.m) AS bad_modality FROM k, late GROUP BY 1""",
    "missing_names": "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "cross_attention": f"""WITH {M.FEATURES_SQL}, f AS (SELECT * FROM tok),
z AS (SELECT q.clip_id, q.t AS i, k.t AS j, exp(sum(q.v * k.v) / sqrt({M.DIM}::DOUBLE)) AS z FROM f q JOIN f k ON q.clip_id = k.clip_id AND q.d = k.d GROUP BY 1, 2, 3),
a AS (SELECT clip_id, i, j, z / sum(z) OVER (PARTITION BY clip_id, i) AS a FROM z)
SELECT a.clip_id AS graph_id, i, d, round(sum(a * v), 7) + 0e0 AS v FROM a JOIN f ON f.clip_id = a.clip_id AND f.t = j GROUP BY 1, 2, 3""",
    "architecture_edges": "WITH m AS (SELECT DISTINCT event_type AS name FROM events) SELECT 'input' AS source, name AS target FROM m UNION ALL SELECT name, 'token_bank' FROM m UNION ALL SELECT * FROM (VALUES ('token_bank', 'fusion'), ('fusion', 'cls'), ('fusion', 'fused_tokens'))",
    "subset_runs": """WITH n(k, modality) AS (VALUES (0, 'rgb'), (1, 'fau'), (2, 'rppg'), (3, 'eye_gaze'), (4, 'face_mesh'), (5, 'depth'), (6, 'fft'), (7, 'stft')),
s AS (SELECT m.mask, list(n.k ORDER BY n.k) AS places, string_agg(n.modality, '__' ORDER BY n.k) AS name, count(*) AS size FROM range(1, 256) m(mask), n WHERE (m.mask >> n.k) & 1 = 1 GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY size, places)::INTEGER AS set_id FROM s),
p AS (SELECT set_id, name, doc_id, avg((doc_id * (n.k + 3)) % 11 - 7.25e0) AS logit, max(toxic) AS label FROM r JOIN n ON (r.mask >> n.k) & 1 = 1, labels GROUP BY 1, 2, 3)
SELECT set_id, name, count(*) AS clips, round(avg(((logit >= 0)::INT = label)::INT::DOUBLE), 6) AS accuracy FROM p GROUP BY 1, 2""",
    "alias_lookup": "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'old ' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey % 8 <> 0 THEN NULL ELSE n_regionkey END AS n_regionkey, NOT (n_nationkey % 4 = 0 AND n_nationkey % 8 <> 0) AS known FROM nation",
    "architecture_dot": "WITH m AS (SELECT DISTINCT event_type AS name FROM events), e AS (SELECT 'input' AS source, name AS target FROM m UNION ALL SELECT name, 'token_bank' FROM m UNION ALL SELECT * FROM (VALUES ('token_bank', 'fusion'), ('fusion', 'cls'), ('fusion', 'fused_tokens'))) SELECT '  \"' || source || '\" -> \"' || target || '\";' AS line FROM e",
    "modality_markdown": "SELECT '| ' || event_type || ' | ' || count(*) || ' | ' || count(DISTINCT user_id) || ' |' AS line FROM events GROUP BY event_type",
    "mean_pool": f"WITH {M.FEATURES_SQL} SELECT clip_id, d, round(avg(v * 0.02e0 * sin(12.9898e0 * d + 78.233e0)), 8) + 0e0 AS v FROM tok GROUP BY 1, 2",
}
