"""Signal, pooling, token-bank, graph and subset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.functions import numeric, pooling, signal
from cliploom.operators import attention, graph, heads, subsets, token_bank
from cliploom.plans import surrogates as S

#: Components of an embedding in the test tables, as the SQL reads them; edge of a frame.
DIM, SIZE = 64, 8
W = "0.02e0 * sin(12.9898e0 * {i} + 78.233e0 * {j} + {p})"
FEATURES_SQL = f"tok AS (SELECT vec_id // {S.CLIP} AS clip_id, (vec_id % {S.CLIP})::INT AS t, (r.d)::INT AS d, embedding[r.d + 1]::DOUBLE AS v FROM embeddings, range({DIM}) r(d))"
PIXELS_SQL = f"px AS (SELECT k // {SIZE * SIZE} AS frame_id, (k % {SIZE * SIZE} // {SIZE})::INT AS y, (k % {SIZE})::INT AS x, (p_size * 5)::DOUBLE AS r, (floor(p_retailprice)::BIGINT % 256)::DOUBLE AS g, (floor(p_retailprice * 7)::BIGINT % 256)::DOUBLE AS b FROM (SELECT p_partkey AS k, p_size, p_retailprice FROM part))"
LAYOUT_SQL = "lay(ord, name, modality_id, slots) AS (VALUES (0, 'rgb', 0, 8), (1, 'fau', 6, 32), (2, 'rppg', 4, 4), (3, 'eye_gaze', 5, 4), (4, 'face_mesh', 3, 16), (5, 'depth', 2, 4), (6, 'fft', 7, 4), (7, 'stft', 8, 4)), off AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS offset_ FROM lay)"

NAMES_SQL = "names AS (SELECT unnest(range(11))::INT AS modality_id, unnest(['rgb', 'metadata', 'depth', 'face_mesh', 'rppg', 'eye_gaze', 'fau', 'fft', 'stft', 'text', 'manipulation_mask']) AS name)"


def _r(df: DataFrame, places: int = 5) -> DataFrame:
    """Doubles rounded; adding zero turns -0.0 into 0.0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.frames(spark, sf_dir)
    return f.select(F.concat_ws(":", F.col("clip_id").cast("string"), "modality").alias("clip_id"), F.col("frame_idx").alias("t"), F.col("value").alias("v"))


def _width(spark: SparkSession, sf_dir: str) -> int:
    """Of the vectors, which all have one; from the first."""
    first = S.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.size("embedding")).first()
    return first[0] if first else 0


def normalize_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = S.pixels(spark, sf_dir, SIZE)
    return _r(px.select("frame_id", "y", "x", *[numeric.normalized(F.col(c), F.lit(i)).alias(f"{c}_image") for i, c in enumerate("rgb")], *[numeric.normalized(F.col(c), F.lit(i), numeric.CLIP).alias(f"{c}_clip") for i, c in enumerate("rgb")]))


def grid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = S.pixels(spark, sf_dir, SIZE)
    return _r(signal.regional_signals(px.select("frame_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in "rgb"]), SIZE, 3))


def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = S.pixels(spark, sf_dir, SIZE)
    return _r(signal.block_means(px.select("frame_id", "y", "x", F.rint(numeric.luminance(F.col("r"), F.col("g"), F.col("b"))).alias("v")), 2))


def hann_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's value through a window of sixteen frames."""
    f = _signal(spark, sf_dir).withColumn("j", (F.col("t") % 16).cast("int")).join(F.broadcast(signal.hann(spark, 16)), "j")
    return _r(f.select("clip_id", "t", (F.col("v") * F.col("hann")).alias("v")), 6)


def stft_logmag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(signal.stft(_signal(spark, sf_dir)))


def radial_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and mean grey level of each frame by distance from its centre."""
    px = S.pixels(spark, sf_dir, SIZE).join(F.broadcast(signal.radial_bins(spark, SIZE, 4)), ["y", "x"])
    return _r(px.groupBy("frame_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.rint(numeric.luminance(F.col("r"), F.col("g"), F.col("b")))).alias("v")))


def dft_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = S.pixels(spark, sf_dir, SIZE)
    gray = px.select("frame_id", "y", "x", (F.rint(numeric.luminance(F.col("r"), F.col("g"), F.col("b"))) / 255.0).alias("v"))
    return _r(signal.radial_spectrum(gray, SIZE, 4))


def fft2_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result as dft_radial, by FFT."""
    px = S.pixels(spark, sf_dir, SIZE)
    gray = px.select("frame_id", F.struct("y", "x", (F.rint(numeric.luminance(F.col("r"), F.col("g"), F.col("b"))) / 255.0).alias("v")).alias("p"))
    whole = gray.groupBy("frame_id").agg(F.collect_list("p").alias("pixels"))
    return _r(signal.radial_spectrum_arrow(whole, SIZE, 4))


def pos_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips' vectors with their frames' position codes added."""
    codes = F.broadcast(pooling.position_table(spark, S.CLIP, _width(spark, sf_dir)))
    return _r(S.features(spark, sf_dir).join(codes, ["t", "d"]).select("clip_id", "t", "d", (F.col("v") + F.col("code")).alias("v")), 6)


def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pooling.layer_norm(S.features(spark, sf_dir), ["clip_id", "t"]))


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(S.features(spark, sf_dir).select("clip_id", "t", "d", numeric.softmax(F.col("v"), "clip_id", "d").alias("a")), 9)


def linear_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pooling.linear(S.features(spark, sf_dir), 8, ["clip_id", "t"]), 7)


def gelu_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pooling.mlp(S.features(spark, sf_dir), 32, 8, ["clip_id", "t"]), 8)


def latent_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(attention.latent_pool(S.vectors(spark, sf_dir), 4, temporal=False), 4)


def temporal_latent_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(attention.latent_pool(S.vectors(spark, sf_dir), 4), 4)


def two_stage_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors make a frame."""
    v = S.vectors(spark, sf_dir).select("clip_id", F.floor(F.col("t") / 5).cast("int").alias("t"), (F.col("t") % 5).alias("element"), "features")
    return _r(attention.latent_pool(v, 3, inner=2), 4)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's embeddings in the places of rgb and depth."""
    token = F.transform("embedding", lambda x: x.cast("double")).alias("token")
    place = F.when(F.col("t") < 8, F.col("t")).otherwise(F.col("t") - 8).alias("slot")
    return S.clips(spark, sf_dir).select("clip_id", F.when(F.col("t") < 8, "rgb").otherwise("depth").alias("modality"), place, token)


def token_bank_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    bank = token_bank.embedded(token_bank.token_bank(t, t, _width(spark, sf_dir)))
    total = F.aggregate("token", F.lit(0.0), lambda a, x: a + x)
    return _r(bank.select("clip_id", "pos", "modality", "modality_id", "slot", "time_id", "mask", total.alias("total")), 5)


def bank_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bank.used_places(_tokens(spark, sf_dir))


def bank_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    return token_bank.token_bank(t, t, _width(spark, sf_dir)).groupBy("clip_id").agg(F.count(F.lit(1)).alias("places"), F.count_if("mask").alias("used"))


def bank_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with a token missing, one repeated, one cut short or one of an unknown modality, in turn; the last clip may be short."""
    t = _tokens(spark, sf_dir).withColumn("kind", F.col("clip_id") % 5).where("NOT (kind = 3 AND slot = 2)")
    t = t.withColumn("token", F.when(F.expr("kind = 2 AND modality = 'depth' AND slot = 1"), F.slice("token", 1, 7)).otherwise(F.col("token")))
    t = t.withColumn("modality", F.when(F.expr("kind = 4 AND modality = 'depth'"), "smell").otherwise(F.col("modality")))
    return token_bank.validate_tokens(t.unionByName(t.where("kind = 1 AND slot = 0")), _width(spark, sf_dir))


def fusion_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, dim = _tokens(spark, sf_dir), _width(spark, sf_dir)
    return _r(token_bank.fuse(token_bank.embedded(token_bank.token_bank(t, t, dim))), 5)


def required_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("key"))
    return token_bank.required_features(have, {"rgb": ["click"], "fau": ["click", "view", "purchase"]})


def head_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings")
    return _r(heads.predict(e.select("vec_id", heads.logit(F.col("embedding"), 0.01).alias("logit"))), 6)


def cosine_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings")
    class_ = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda d: F.sin((d + 1) * 0.7))
    return _r(e.select("vec_id", heads.cosine(F.col("embedding"), class_).alias("cosine")), 6)


def gaze_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    scores = F.map_from_entries(F.array(*[F.struct(F.lit(g), (n / 10.0 + i).cast("double")) for i, g in enumerate(heads.GAZE) if i != 3]))
    return S.table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(heads.gaze_vector(scores)).alias("d", "v"))


def mesh_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    points = F.transform(F.sequence(F.lit(0), 150 + n * 10), lambda i: F.array(i / 100.0, i / 200.0, -i / 300.0))
    return _r(S.table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(heads.gather_points(points, heads.CONTOUR)).alias("point", "p")).select("n_nationkey", "point", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"), F.col("p")[2].alias("pz")), 6)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region, in order, are the nodes of its graph."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nodes = S.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), (F.row_number().over(order) - 1).cast("int").alias("i"), F.col("n_name").alias("name"))
    return graph.edges_of(nodes, 8)


def graph_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an event of one type follows one of another, over all users."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = S.table(spark, sf_dir, "events").select(F.col("event_type").alias("i"), F.lead("event_type").over(order).alias("j")).where("j IS NOT NULL")
    return _r(graph.normalized(steps.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("a"))), 8)


def gated_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a graph with a node for each component."""
    g = S.clips(spark, sf_dir).select((F.col("clip_id") * 100 + F.col("t")).alias("graph_id"), F.col("embedding").alias("x"))
    return _r(graph.gated_message(g, "x").select("graph_id", F.posexplode("x").alias("i", "x")), 7)


def _have(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Users and the types of their events, which stand for modalities, and the types in order: a handful."""
    have = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("modality"))
    return have, sorted(r["modality"] for r in have.select("modality").distinct().collect())


def modality_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set of modalities, and how many clips have all of it."""
    have, names = _have(spark, sf_dir)
    return subsets.ready_clips(subsets.modality_sets(spark, names), have)


def modality_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, names = _have(spark, sf_dir)
    return subsets.ready_clips(subsets.modality_sets(spark, names, "singletons_plus_all"), have)


def pending_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each clip lacks of the modalities; every third clip has lost its views."""
    have, names = _have(spark, sf_dir)
    return subsets.lacking(have.where("modality <> 'view' OR clip_id % 3 > 0"), names)


def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), "n_nationkey")
    return subsets.key_difference(n.where("n_nationkey < 15"), n.where("n_nationkey > 9"))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bank.totals(_tokens(spark, sf_dir))


QUERIES = {f.__name__: f for f in (normalize_channels, grid_means, block_means, hann_window, stft_logmag, radial_bins, dft_radial, fft2_arrow, pos_encoding, layer_norm, softmax_scores, linear_projection, gelu_mlp, latent_pool, temporal_latent_pool, two_stage_pool, token_bank_places, bank_offsets, bank_mask_counts, bank_problems, fusion_cls, required_features, head_logit, cosine_logits, gaze_vectors, mesh_gather, graph_edges, graph_normalize, gated_message, modality_subsets, modality_singletons, pending_modalities, key_difference, token_totals)}


def _w(i: str, j: str, p: str = "0e0") -> str:
    return W.format(i=i, j=j, p=p)


_CODE = "CASE WHEN {d} % 2 = 0 THEN sin({t} * exp(-({d} - {d} % 2) * (ln(10000e0) / {n}))) ELSE cos({t} * exp(-({d} - {d} % 2) * (ln(10000e0) / {n}))) END"
_LN = "(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5)"


def _pool_ctes(source: str, keys: str, slots: int, temporal: bool, p: str = "") -> str:
    """CTEs from (keys, t, d, v) to {p}o: keys, slot, d, v before its last norm."""
    code = _CODE.format(d="d", t="t", n=DIM) if temporal else "0e0"
    return f"""{p}nt AS (SELECT {keys}, t, d, {_LN} AS v FROM {source} WINDOW w AS (PARTITION BY {keys}, t)),
{p}z AS (SELECT {keys}, s.slot::INT AS slot, t, sum((v + {code}) * {_w('s.slot', 'd')}) / sqrt({DIM}::DOUBLE) AS z FROM {p}nt, range({slots}) s(slot) GROUP BY {keys}, s.slot, t),
{p}m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY {keys}, slot)) AS e FROM {p}z),
{p}a AS (SELECT {keys}, slot, t, e / sum(e) OVER (PARTITION BY {keys}, slot) AS a FROM {p}m),
{p}o AS (SELECT {keys}, slot, d, sum(a * v) AS v FROM {p}a JOIN {p}nt USING ({keys}, t) GROUP BY {keys}, slot, d)"""


def _pool_sql(temporal: bool) -> str:
    return f"""WITH {FEATURES_SQL}, {_pool_ctes("tok", "clip_id", 4, temporal)}
SELECT clip_id, slot, d, round({_LN}, 4) + 0e0 AS v FROM o WINDOW w AS (PARTITION BY clip_id, slot)"""


_TWO_STAGE = f"""WITH {FEATURES_SQL}, el AS (SELECT clip_id, t // 5 AS frame, t % 5 AS t, d, v FROM tok), {_pool_ctes("el", "clip_id, frame", 2, False, "i")},
flat AS (SELECT clip_id, frame * 2 + slot AS t, d, {_LN} AS v FROM io WINDOW w AS (PARTITION BY clip_id, frame, slot)), {_pool_ctes("flat", "clip_id", 3, True)}
SELECT clip_id, slot, d, round({_LN}, 4) + 0e0 AS v FROM o WINDOW w AS (PARTITION BY clip_id, slot)"""
_ERF = "sign({x}) * (1e0 - 1e0 / (1e0 + 0.3275911e0 * abs({x})) * (0.254829592e0 + 1e0 / (1e0 + 0.3275911e0 * abs({x})) * (-0.284496736e0 + 1e0 / (1e0 + 0.3275911e0 * abs({x})) * (1.421413741e0 + 1e0 / (1e0 + 0.3275911e0 * abs({x})) * (-1.453152027e0 + 1e0 / (1e0 + 0.3275911e0 * abs({x})) * 1.061405429e0)))) * exp(-{x} * {x}))"
_GELU = f"""WITH {FEATURES_SQL}, h AS (SELECT clip_id, t, o.d AS d, sum(v * {_w('tok.d', 'o.d')}) AS v FROM tok, range(32) o(d) GROUP BY 1, 2, 3),
g AS (SELECT clip_id, t, d, 0.5e0 * v * (1e0 + {_ERF.format(x='(v / 1.4142135623730951e0)')}) AS v FROM h)
SELECT clip_id, t, o.d::INT AS d, round(sum(v * {_w('g.d', 'o.d', '1e0')}), 8) + 0e0 AS v FROM g, range(8) o(d) GROUP BY 1, 2, 3"""


def _linear(source: str, phase: int, width: int) -> str:
    return f"SELECT clip_id, t, o.d AS d, sum(v * {_w('s.d', 'o.d', f'{phase}e0')}) AS v FROM {source} s, range({width}) o(d) GROUP BY 1, 2, 3"


def _normed(source: str) -> str:
    return f"SELECT clip_id, t, d, {_LN} AS v FROM {source} WINDOW w AS (PARTITION BY clip_id, t)"


def _sum(a: str, b: str) -> str:
    return f"(SELECT clip_id, t, d, a.v + b.v AS v FROM {a} a JOIN {b} b USING (clip_id, t, d))"


_FUSION = f"""WITH {FEATURES_SQL}, x AS (SELECT DISTINCT clip_id, 0 AS t, (r.d)::INT AS d, {_w('0', 'r.d', '6e0')} AS v FROM tok, range({DIM}) r(d)
UNION ALL SELECT clip_id, t + 1, d, v + {_w('CASE WHEN t < 8 THEN t ELSE t - 8 END', 'd', '2e0')} + {_w('CASE WHEN t < 8 THEN 0 ELSE 2 END', 'd', '3e0')} FROM tok),
q AS MATERIALIZED ({_linear('x', 0, DIM)}), k AS MATERIALIZED ({_linear('x', 1, DIM)}), u AS MATERIALIZED ({_linear('x', 2, DIM)}),
z AS (SELECT q.clip_id, q.t AS i, k.t AS j, q.d // 16 AS h, exp(sum(q.v * k.v) / 4e0) AS e FROM q JOIN k ON q.clip_id = k.clip_id AND q.d = k.d GROUP BY 1, 2, 3, 4),
a AS (SELECT clip_id, i, j, h, e / sum(e) OVER (PARTITION BY clip_id, i, h) AS a FROM z),
m AS (SELECT a.clip_id, i AS t, u.d, sum(a * v) AS v FROM a JOIN u ON u.clip_id = a.clip_id AND u.t = j AND u.d // 16 = h GROUP BY 1, 2, 3),
o AS MATERIALIZED ({_linear('m', 3, DIM)}), n1 AS MATERIALIZED ({_normed(_sum('x', 'o'))}), h AS ({_linear('n1', 4, 4 * DIM)}),
g AS (SELECT clip_id, t, d, 0.5e0 * v * (1e0 + {_ERF.format(x='(v / 1.4142135623730951e0)')}) AS v FROM h),
f AS MATERIALIZED ({_linear('g', 5, DIM)}), n2 AS ({_normed(_sum('n1', 'f'))}), n3 AS ({_normed('n2')})
SELECT clip_id, d::INT AS d, round(v, 5) + 0e0 AS v FROM n3 WHERE t = 0"""
_GRAY = "round_even(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 0)"
_DFT = f"""WITH {PIXELS_SQL}, g AS (SELECT frame_id, y, x, {_GRAY} / 255e0 AS v FROM px),
f AS (SELECT frame_id, ky.k AS ky, kx.k AS kx, sum(v * cos(-2e0 * pi() * ((kx.k * x) % {SIZE} + (ky.k * y) % {SIZE}) / {SIZE})) AS re, sum(v * sin(-2e0 * pi() * ((kx.k * x) % {SIZE} + (ky.k * y) % {SIZE}) / {SIZE})) AS im FROM g, range({SIZE}) kx(k), range({SIZE}) ky(k) GROUP BY 1, 2, 3),
s AS (SELECT frame_id, greatest(0, least(3, ceil(sqrt((((ky + 4) % 8) - 4)::DOUBLE ^ 2 + (((kx + 4) % 8) - 4)::DOUBLE ^ 2) / ((sqrt(32e0) + 1e-6) / 4)) - 1))::INT AS bin, ln(1e0 + sqrt(re * re + im * im)) AS m FROM f)
SELECT q.frame_id, b.bin::INT AS bin, round(coalesce(avg(m), 0e0), 5) AS value FROM (SELECT DISTINCT frame_id FROM px) q CROSS JOIN range(4) b(bin) LEFT JOIN s ON s.frame_id = q.frame_id AND s.bin = b.bin GROUP BY 1, 2"""
_IMAGE, _CLIP = ((0.485, 0.229), (0.456, 0.224), (0.406, 0.225)), ((0.45, 0.225),) * 3
_TOKENS = f"{FEATURES_SQL}, k AS (SELECT clip_id, CASE WHEN t < 8 THEN 'rgb' ELSE 'depth' END AS modality, CASE WHEN t < 8 THEN t ELSE t - 8 END AS slot, d, v FROM tok)"
_SETS = """names AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) - 1 AS o FROM (SELECT DISTINCT event_type FROM events)),
i AS (SELECT m.mask, list(o ORDER BY o) AS places, string_agg(name, '__' ORDER BY o) AS name, count(*)::INT AS size FROM range(1, 1024) m(mask), names WHERE (m.mask >> o) & 1 = 1 AND m.mask < (1::BIGINT << (SELECT count(*) FROM names)) GROUP BY 1),
u AS (SELECT user_id, sum(1::BIGINT << o)::BIGINT AS own FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN names ON name = event_type GROUP BY 1)"""
_READY = "SELECT row_number() OVER (ORDER BY size, places)::INT AS set_id, name, size, (SELECT count(*) FROM u WHERE (own & i.mask) = i.mask) AS clips FROM i"

ORACLES = {
    "normalize_channels": f"WITH {PIXELS_SQL} SELECT frame_id, y, x, " + ", ".join(f"round(({c} / 255e0 - {m}e0) / {s}e0, 5) + 0e0 AS {c}_{n}" for n, t in (("image", _IMAGE), ("clip", _CLIP)) for c, (m, s) in zip("rgb", t, strict=True)) + " FROM px",
    "grid_means": f"WITH {PIXELS_SQL} SELECT frame_id, (y // 2 * 3 + x // 2)::INT AS cell, round(avg((0.299e0 * r + 0.587e0 * g + 0.114e0 * b) / 255e0), 5) AS luma, round(avg((r - b) / 255e0), 5) + 0e0 AS chroma FROM px WHERE y < 6 AND x < 6 GROUP BY 1, 2",
    "block_means": f"WITH {PIXELS_SQL} SELECT frame_id, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg({_GRAY}), 5) AS v FROM px GROUP BY 1, 2, 3",
    "hann_window": "WITH f AS (SELECT user_id::VARCHAR || ':' || event_type AS clip_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value AS v FROM events) SELECT clip_id, t::INT AS t, round(v * (0.5e0 - 0.5e0 * cos(2e0 * pi() * (t % 16) / 16)), 6) + 0e0 AS v FROM f",
    "stft_logmag": """WITH s AS (SELECT user_id::VARCHAR || ':' || event_type AS clip_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value AS v FROM events),
n AS (SELECT clip_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 8),
x AS (SELECT clip_id, n, w.w, j.j, abs(w.w * 2 + j.j - 4) AS a FROM n, range(1000) w(w), range(8) j(j) WHERE w.w <= n // 2),
y AS (SELECT x.clip_id, w, j, v * (0.5e0 - 0.5e0 * cos(2e0 * pi() * j / 8)) AS v FROM x JOIN s ON s.clip_id = x.clip_id AND s.t = CASE WHEN a <= n - 1 THEN a ELSE 2 * (n - 1) - a END)
SELECT clip_id, w::INT AS w, k.k::INT AS k, round(ln(1e0 + sqrt(sum(v * cos(2e0 * pi() * k.k * j / 8)) ^ 2 + sum(v * sin(2e0 * pi() * k.k * j / 8)) ^ 2)), 5) + 0e0 AS logmag FROM y, range(5) k(k) GROUP BY 1, 2, 3""",
    "radial_bins": f"WITH {PIXELS_SQL} SELECT frame_id, greatest(0, least(3, ceil(sqrt((y - 4)::DOUBLE ^ 2 + (x - 4)::DOUBLE ^ 2) / ((sqrt(32e0) + 1e-6) / 4)) - 1))::INT AS bin, count(*) AS n, round(avg({_GRAY}), 5) + 0e0 AS v FROM px GROUP BY 1, 2",
    "dft_radial": _DFT,
    "fft2_arrow": _DFT,
    "pos_encoding": f"WITH {FEATURES_SQL} SELECT clip_id, t, d, round(v + {_CODE.format(d='d', t='t', n=DIM)}, 6) + 0e0 AS v FROM tok",
    "layer_norm": f"WITH {FEATURES_SQL} SELECT clip_id, t, d, round({_LN}, 5) + 0e0 AS v FROM tok WINDOW w AS (PARTITION BY clip_id, t)",
    "softmax_scores": f"WITH {FEATURES_SQL} SELECT clip_id, t, d, round(exp(v) / sum(exp(v)) OVER (PARTITION BY clip_id, d), 9) + 0e0 AS a FROM tok",
    "linear_projection": f"WITH {FEATURES_SQL} SELECT clip_id, t, o.d::INT AS d, round(sum(v * {_w('tok.d', 'o.d')}), 7) + 0e0 AS v FROM tok, range(8) o(d) GROUP BY 1, 2, 3",
    "gelu_mlp": _GELU,
    "latent_pool": _pool_sql(False),
    "two_stage_pool": _TWO_STAGE,
    "temporal_latent_pool": _pool_sql(True),
    "token_bank_places": f"""WITH {_TOKENS}, {LAYOUT_SQL}, clips AS (SELECT DISTINCT clip_id FROM k),
places AS (SELECT clip_id, (offset_ + s.slot)::INT AS pos, name AS modality, modality_id, s.slot::INT AS slot FROM clips, off, range(32) s(slot) WHERE s.slot < slots),
sums AS (SELECT clip_id, modality, slot, sum(v) AS v FROM k GROUP BY 1, 2, 3)
SELECT p.clip_id, pos, p.modality, modality_id, p.slot, p.slot AS time_id, s.v IS NOT NULL AS mask,
  round(coalesce(s.v, 0e0) + (SELECT sum({_w('p.slot', 'd', '2e0')} + {_w('p.modality_id', 'd', '3e0')}) FROM range({DIM}) r(d)), 5) + 0e0 AS total
FROM places p LEFT JOIN sums s ON s.clip_id = p.clip_id AND s.modality = p.modality AND s.slot = p.slot""",
    "bank_offsets": f"WITH {_TOKENS}, {LAYOUT_SQL} SELECT clip_id, modality, any_value(offset_) AS \"offset\", any_value(slots)::INT AS slots, count(DISTINCT slot) AS tokens FROM k JOIN off ON off.name = modality GROUP BY 1, 2",
    "bank_mask_counts": f"WITH {_TOKENS}, {LAYOUT_SQL} SELECT clip_id, (SELECT sum(slots) FROM lay)::BIGINT AS places, count(DISTINCT modality || slot::VARCHAR) AS used FROM k GROUP BY 1",
    "bank_problems": f"""WITH {_TOKENS}, {LAYOUT_SQL}, u AS (SELECT clip_id, clip_id % 5 AS kind, modality, slot, count(v) AS width FROM k GROUP BY ALL),
u2 AS (SELECT clip_id, kind, slot, CASE WHEN kind = 4 AND modality = 'depth' THEN 'smell' ELSE modality END AS modality, CASE WHEN kind = 2 AND modality = 'depth' AND slot = 1 THEN 7 ELSE width END AS width FROM u WHERE NOT (kind = 3 AND slot = 2)),
x AS (SELECT * FROM u2 UNION ALL SELECT * FROM u2 WHERE kind = 1 AND slot = 0),
c AS (SELECT clip_id, modality, any_value(slots) AS slots, count(*) AS n, count(DISTINCT slot) AS k, bool_or(width <> {DIM}) AS wide FROM x LEFT JOIN lay ON name = modality GROUP BY 1, 2)
SELECT clip_id, modality, CASE WHEN slots IS NULL THEN 'unknown modality' WHEN wide THEN 'wrong width' WHEN n <> k THEN 'repeated slot' ELSE 'wrong number of slots' END AS problem FROM c WHERE slots IS NULL OR wide OR n <> k OR k <> slots""",
    "fusion_cls": _FUSION,
    "required_features": "SELECT user_id AS clip_id, m.modality, CASE WHEN m.modality = 'rgb' THEN bool_or(event_type = 'click') ELSE bool_or(event_type = 'click') AND bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') END AS ready FROM events, (VALUES ('rgb'), ('fau')) m(modality) GROUP BY 1, 2",
    "head_logit": f"WITH z AS (SELECT vec_id, (SELECT sum(embedding[d + 1]::DOUBLE * {_w('d', '0e0')}) FROM range(64) r(d)) + 0.01e0 AS logit FROM embeddings) SELECT vec_id, round(logit, 6) + 0e0 AS logit, round(1e0 / (1e0 + exp(-logit)), 6) AS probability, (1e0 / (1e0 + exp(-logit)) >= 0.5e0)::INT AS prediction FROM z",
    "cosine_logits": "WITH p AS (SELECT vec_id, embedding[d + 1]::DOUBLE AS x, greatest(sin((d + 1) * 0.7e0), 0e0) AS y FROM embeddings, range(64) r(d)) SELECT vec_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) + 0e0 AS cosine FROM p GROUP BY 1",
    "gaze_vectors": "SELECT n_nationkey, d::INT AS d, CASE WHEN d = 3 THEN 0e0 ELSE n_nationkey / 10e0 + d END AS v FROM nation, range(8) r(d)",
    "mesh_gather": f"WITH c AS (SELECT unnest([{', '.join(map(str, heads.CONTOUR))}]) AS i, generate_subscripts([{', '.join(map(str, heads.CONTOUR))}], 1) - 1 AS point) SELECT n_nationkey, point::INT AS point, CASE WHEN i <= 150 + n_nationkey * 10 THEN round(least(1e0, i / 100e0), 6) ELSE -1e0 END AS px, CASE WHEN i <= 150 + n_nationkey * 10 THEN round(least(1e0, i / 200e0), 6) ELSE -1e0 END AS py, CASE WHEN i <= 150 + n_nationkey * 10 THEN round(-i / 300e0, 6) + 0e0 ELSE -1e0 END AS pz FROM nation, c",
    "graph_edges": "WITH n AS (SELECT n_regionkey AS graph_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_name AS name FROM nation) SELECT a.graph_id, (a.i * 8 + b.i)::INT AS edge_id, a.name AS target, b.name AS source FROM n a JOIN n b ON a.graph_id = b.graph_id",
    "graph_normalize": "WITH s AS (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events), e AS (SELECT i, j, count(*)::DOUBLE AS a FROM s WHERE j IS NOT NULL GROUP BY 1, 2), d AS (SELECT i, sum(a) AS deg FROM e GROUP BY 1) SELECT e.i, e.j, round(a / sqrt(p.deg * q.deg), 8) AS a FROM e JOIN d p ON p.i = e.i JOIN d q ON q.i = e.j",
    "gated_message": f"""WITH {FEATURES_SQL}, n AS (SELECT clip_id * 100 + t AS graph_id, d AS i, v AS x FROM tok),
g0 AS (SELECT a.graph_id, a.i, a.x AS xi, b.x AS xj, exp(1e0 / (1e0 + exp(-(0.3e0 * a.x - 0.2e0 * b.x)))) AS z FROM n a JOIN n b USING (graph_id)),
s AS (SELECT *, z / sum(z) OVER (PARTITION BY graph_id, i) AS g FROM g0)
SELECT graph_id, i, round(greatest(0e0, any_value(xi) * 1.5e0 + sum(g * xj * 0.8e0 / {DIM})), 7) + 0e0 AS x FROM s GROUP BY 1, 2""",
    "modality_subsets": f"WITH {_SETS} {_READY}",
    "modality_singletons": f"WITH {_SETS} {_READY} WHERE size IN (1, (SELECT count(*) FROM names))",
    "pending_modalities": "WITH h AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'view' OR user_id % 3 > 0), c AS (SELECT DISTINCT user_id FROM h), t AS (SELECT DISTINCT event_type FROM events) SELECT c.user_id AS clip_id, t.event_type AS modality FROM c, t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = c.user_id AND h.event_type = t.event_type)",
    "key_difference": "SELECT n_name AS key, CASE WHEN n_nationkey <= 9 THEN 'missing' ELSE 'unexpected' END AS side FROM nation WHERE n_nationkey <= 9 OR n_nationkey >= 15",
    "token_totals": f"WITH {_TOKENS}, {LAYOUT_SQL}, m AS (SELECT DISTINCT clip_id, modality FROM k) SELECT clip_id, (SELECT sum(slots) FROM lay)::BIGINT AS slots, sum(slots)::BIGINT AS enabled FROM m JOIN lay ON name = modality GROUP BY 1",
}
