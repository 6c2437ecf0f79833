"""Queries of cached extraction, extractors, guards, stable orders, resizing and pooling by layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import numeric, pooling, signal
from cliploom.operators import cache, extractors, guards, manifest, token_bank
from cliploom.plans import model_queries as M
from cliploom.plans import surrogates as S
from cliploom.plans.manifest_queries import FILES_SQL
from cliploom.sources import tables
from cliploom.sources.shared import fresh_folder, written

SMALL, BINS = 5, 3
ENDINGS = (".mov", ".mp4", ".MP4")


def cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, cache_status, files, rows, total: three runs over one store. The second extracts nothing, the third only the files that changed."""
    files = S.files(spark, sf_dir).select("path", "label", "doc_id", F.col("doc_id").alias("size"), F.lit(1).cast("long").alias("modified_ns"))
    changed = files.withColumn("modified_ns", F.when(F.col("doc_id") % 97 == 0, 2).otherwise(F.col("modified_ns")))
    store, out = fresh_folder(spark, "store"), None
    measure = F.array(F.length("path").cast("double"), F.col("modified_ns").cast("double"))
    for run, rows in enumerate((files, files, changed), 1):
        done = cache.features(rows, lambda m: m.select("path", measure.alias("features"), F.lit(0.5).alias("seconds")), store, {"clip": S.CLIP}, ["rgb", "fau"])
        spent = done.timings.groupBy("cache_status").agg(F.count(F.lit(1)).alias("rows"), F.sum("extract_seconds").alias("extract_seconds"))
        total = done.items.groupBy("cache_status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("features")[0] + F.col("features")[1]).alias("total"))
        part = written(total.join(spent, "cache_status").select(F.lit(run).alias("run"), "cache_status", "files", "rows", "total", "extract_seconds"), "run")
        out = part if out is None else out.unionByName(part)
    return out


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, t, v: how far each vector of a clip is from the one before, by an extractor out of the registry."""
    known = extractors.Extractors()
    known.register("movement", extractors.Movement)
    frames = S.clips(spark, sf_dir).select("clip_id", "t", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return M._r(known.extract("movement", frames).select("clip_id", "t", F.col("features")[0].alias("v")), 6)


def guarded_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, places: every clip's bank, past guards that would raise for a token, time or modality that fusion can't take, or a place too few."""
    t, width = M._tokens(spark, sf_dir), M._width(spark, sf_dir)
    bank = guards.required(token_bank.token_bank(t, t, width), guards.bank_tokens(width, 32, 11))
    return guards.whole_banks(bank, 76)


def manifest_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.numbered_manifest(S.files(spark, sf_dir).select("path", "label", "class_name"))


def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.epoch_order(S.files(spark, sf_dir), 2, 7, 16)


def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file's name with several endings, the first that is there."""
    f = S.files(spark, sf_dir)
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    tried = f.select(F.col("doc_id").alias("item"), F.posexplode(F.array(*[F.concat(stem, F.lit(e)) for e in ENDINGS])).alias("ord", "path"))
    return manifest.first_existing(tried, f)


def modality_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clip has as many frames as events; clicks and views have their own where there are any."""
    ev = S.table(spark, sf_dir, "events")
    clips = ev.groupBy(F.col("user_id").alias("clip_id")).agg(F.count(F.lit(1)).alias("frames"))
    own = ev.where("event_type IN ('click', 'view')").groupBy(F.col("user_id").alias("clip_id"), F.col("event_type").alias("modality")).agg(F.count(F.lit(1)).alias("frames"))
    return manifest.routed(clips, own, ["click", "view", "purchase"])


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = S.pixels(spark, sf_dir, M.SIZE)
    return px.select("frame_id", "y", "x", F.rint(numeric.luminance(F.col("r"), F.col("g"), F.col("b"))).alias("v"))


def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M._r(signal.area_resize(_gray(spark, sf_dir), M.SIZE, SMALL), 6)


def spectral_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M._r(signal.spectral_features(S.pixels(spark, sf_dir, M.SIZE), M.SIZE, SMALL, BINS))


def spatial_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, layout, d, v: a vector as eight tokens of eight numbers, with and without a class token before them, and as a map of eight channels, first or last."""
    e = S.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = lambda n, size, start: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col("x"), start + i * size + 1, size))
    tokens = rows(8, 8, F.lit(0))
    maps = {
        "tokens": pooling.spatial_mean(tokens, 2, 8),
        "class dropped": pooling.spatial_mean(tokens, 2, 8, drop_class=True),
        "channels first": pooling.spatial_mean(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: rows(2, 4, c * 8)), 3, 8),
        "channels last": pooling.spatial_mean(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda y: rows(4, 8, y * 32)), 3, 8),
    }
    out = e.select("vec_id", F.inline(F.array(*[F.struct(F.lit(n).alias("layout"), m.alias("mean")) for n, m in maps.items()])))
    return M._r(out.select("vec_id", "layout", F.posexplode("mean").alias("d", "v")), 7)


def timings_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seconds go through a factor that leaves no tie at the sixth place."""
    path, rows = fresh_folder(spark, "timings"), S.timings(spark, sf_dir)
    tables.write_timings(rows.withColumns({c: F.col(c) / 3.1 for c in rows.columns if c.endswith("_seconds")}), path)
    return tables.read_timings(spark, path, "clip_id long, modality string, elapsed_seconds double, load_seconds double, extract_seconds double")


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row report of all predictions, as its JSON file says."""
    hit = F.col("label") == (F.col("logit") >= 0).cast("int")
    row = S.predictions(spark, sf_dir).agg(F.count(F.lit(1)).alias("predict_count"), F.count_if(~hit).alias("misses"), F.max(F.when(F.col("split") == "none", F.lit(1))).alias("unseen"))
    path = fresh_folder(spark, "summary")
    tables.write_summary(row, path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.inline(F.array(F.from_json("value", "misses long, predict_count long, unseen int"))))


QUERIES = {f.__name__: f for f in (cache_aside, movement, guarded_bank, manifest_numbered, epoch_batches, first_existing, modality_routing, area_resize, spectral_extractor, spatial_means, timings_csv, summary_file)}

_RATIO = f"({M.SIZE}e0 / {SMALL})"
_SHARE = "(greatest(0e0, least({s} + 1e0, ({t} + 1) * " + _RATIO + ") - greatest({s}::DOUBLE, {t} * " + _RATIO + ")) / " + _RATIO + ")"
_RESIZED = f"{M.PIXELS_SQL}, g AS (SELECT frame_id, y, x, {M._GRAY} AS v FROM px), rs AS (SELECT frame_id, a.t AS y, b.t AS x, sum(v * {_SHARE.format(s='y', t='a.t')} * {_SHARE.format(s='x', t='b.t')}) AS v FROM g, range({SMALL}) a(t), range({SMALL}) b(t) GROUP BY 1, 2, 3 HAVING sum({_SHARE.format(s='y', t='a.t')} * {_SHARE.format(s='x', t='b.t')}) > 1e-9)"
_CORNER = f"sqrt({2 * (SMALL // 2) ** 2}e0)"
ORACLES = {
    "cache_aside": f"""WITH {FILES_SQL}, r AS (SELECT 1 AS run, 'miss' AS cache_status, doc_id, path, 1 AS m FROM files UNION ALL SELECT 2, 'hit', doc_id, path, 1 FROM files UNION ALL SELECT 3, CASE WHEN doc_id % 97 = 0 THEN 'miss' ELSE 'hit' END, doc_id, path, CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END FROM files)
SELECT run::INT AS run, cache_status, count(*) AS files, 2 * count(*) AS rows, sum(length(path) + m)::DOUBLE AS total, CASE WHEN cache_status = 'hit' THEN 0e0 ELSE count(*) * 0.5e0 END AS extract_seconds FROM r GROUP BY 1, 2""",
    "movement": f"""WITH {M.FEATURES_SQL}, l AS (SELECT clip_id, t, v - lag(v) OVER (PARTITION BY clip_id, d ORDER BY t) AS s FROM tok)
SELECT clip_id, t, round(sqrt(sum(s * s)), 6) + 0e0 AS v FROM l WHERE s IS NOT NULL GROUP BY 1, 2""",
    "guarded_bank": f"SELECT DISTINCT vec_id // {S.CLIP} AS clip_id, 76::BIGINT AS places FROM embeddings",
    "manifest_numbered": f"WITH {FILES_SQL} SELECT path, label, class_name, row_number() OVER (ORDER BY label, string_split(path, '/')) - 1 AS number FROM files",
    "epoch_batches": f"""WITH {FILES_SQL}, o AS (SELECT e.e::INT AS epoch, path, row_number() OVER (PARTITION BY e.e ORDER BY md5(e.e::VARCHAR || ':7:' || path), path) - 1 AS place FROM files, range(1, 3) e(e))
SELECT epoch, path, place, (place // 16)::INT AS batch FROM o""",
    "first_existing": f"""WITH {FILES_SQL}, c AS (SELECT doc_id AS item, k.ord, regexp_replace(path, '\\.[^.]+$', '') || k.e AS path FROM files, (VALUES (0, '.mov'), (1, '.mp4'), (2, '.MP4')) k(ord, e))
SELECT item, arg_min(c.path, ord) FILTER (files.path IS NOT NULL) AS path FROM c LEFT JOIN files ON files.path = c.path GROUP BY 1""",
    "modality_routing": """WITH n AS (SELECT user_id, count(*) AS frames FROM events GROUP BY 1), o AS (SELECT user_id, event_type, count(*) AS frames FROM events GROUP BY 1, 2)
SELECT n.user_id AS clip_id, m.m AS modality, CASE WHEN m.m <> 'purchase' THEN coalesce(o.frames, n.frames) ELSE n.frames END AS frames FROM n CROSS JOIN (VALUES ('click'), ('view'), ('purchase')) m(m) LEFT JOIN o ON o.user_id = n.user_id AND o.event_type = m.m""",
    "area_resize": f"WITH {_RESIZED} SELECT frame_id, y::INT AS y, x::INT AS x, round(v, 6) + 0e0 AS v FROM rs",
    "spectral_extractor": f"""WITH {_RESIZED}, p AS (SELECT frame_id, y, x, round_even(round(v, 9), 0) / 255e0 AS v FROM rs),
f AS (SELECT frame_id, ky.k AS ky, kx.k AS kx, sum(v * cos(-2e0 * pi() * ((kx.k * x) % {SMALL} + (ky.k * y) % {SMALL}) / {SMALL})) AS re, sum(v * sin(-2e0 * pi() * ((kx.k * x) % {SMALL} + (ky.k * y) % {SMALL}) / {SMALL})) AS im FROM p, range({SMALL}) kx(k), range({SMALL}) ky(k) GROUP BY 1, 2, 3),
s AS (SELECT frame_id, greatest(0, least({BINS - 1}, ceil(sqrt((((ky + {SMALL // 2}) % {SMALL}) - {SMALL // 2})::DOUBLE ^ 2 + (((kx + {SMALL // 2}) % {SMALL}) - {SMALL // 2})::DOUBLE ^ 2) / (({_CORNER} + 1e-6) / {BINS})) - 1))::INT AS bin, ln(1e0 + sqrt(re * re + im * im)) AS m FROM f)
SELECT q.frame_id, b.bin::INT AS bin, round(coalesce(avg(m), 0e0), 5) AS value FROM (SELECT DISTINCT frame_id FROM px) q CROSS JOIN range({BINS}) b(bin) LEFT JOIN s ON s.frame_id = q.frame_id AND s.bin = b.bin GROUP BY 1, 2""",
    "spatial_means": """WITH v AS (SELECT vec_id, k.k, d.d, embedding[k.k * 8 + d.d + 1]::DOUBLE AS across, embedding[d.d * 8 + k.k + 1]::DOUBLE AS along FROM embeddings, range(8) k(k), range(8) d(d)),
u AS (SELECT vec_id, 'tokens' AS layout, d, across AS x FROM v UNION ALL SELECT vec_id, 'class dropped', d, across FROM v WHERE k > 0 UNION ALL SELECT vec_id, 'channels first', d, along FROM v UNION ALL SELECT vec_id, 'channels last', d, across FROM v)
SELECT vec_id, layout, d::INT AS d, round(avg(x), 7) + 0e0 AS v FROM u GROUP BY 1, 2, 3""",
    "timings_csv": "SELECT user_id AS clip_id, event_type AS modality, printf('%.6f', value / 1000e0 / 3.1e0)::DOUBLE AS elapsed_seconds, CASE WHEN event_id % 3 <> 0 THEN printf('%.6f', value / 4000e0 / 3.1e0)::DOUBLE END AS load_seconds, printf('%.6f', value / 2000e0 / 3.1e0)::DOUBLE AS extract_seconds FROM events",
    "summary_file": f"WITH {FILES_SQL} SELECT count(*) FILTER (label <> ((doc_id % 17 - 8) / 4e0 >= 0)::INT) AS misses, count(*) AS predict_count, NULL::INT AS unseen FROM files",
}
