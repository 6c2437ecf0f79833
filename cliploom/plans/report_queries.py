"""Sampling, prediction, timing and training-report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import numeric, paths
from cliploom.operators import heads, manifest, reports, sampling
from cliploom.plans import surrogates as S
from cliploom.plans.manifest_queries import FILES_SQL

FRAMES_SQL = "frames AS (SELECT user_id::VARCHAR || ':' || event_type AS clip_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame_idx, value FROM events)"
PREDICTIONS_SQL = f"""{FILES_SQL}, p0 AS (
  SELECT doc_id, path, class_name, label, CASE WHEN doc_id % 5 = 0 THEN 'train' ELSE 'test' END AS split, (doc_id % 17 - 8) / 4.0e0 AS logit FROM files),
predictions AS (SELECT *, 1e0 / (1e0 + exp(-logit)) AS probability, CASE WHEN 1e0 / (1e0 + exp(-logit)) >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM p0)"""
TIMINGS_SQL = "timings AS (SELECT user_id AS clip_id, event_type AS modality, value / 1000e0 AS elapsed_seconds, CASE WHEN event_id % 3 <> 0 THEN value / 4000e0 END AS load_seconds, value / 2000e0 AS extract_seconds FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frames(spark, sf_dir).withColumn("clip_id", F.concat_ws(":", F.col("clip_id").cast("string"), "modality"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.predict(S.predictions(spark, sf_dir))


def frame_sample_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.frame_sample(_frames(spark, sf_dir), 8)


def frame_sample_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.frame_sample(_frames(spark, sf_dir), 5)


def frame_count_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.too_short(_frames(spark, sf_dir), 12)


def decode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip_id"), F.col("event_type").alias("modality")).agg(F.max("event_id").alias("e"))
    wanted = ev.select("clip_id", "modality", F.when(F.col("modality").isin("click", "view"), 16).otherwise(32).alias("frame_count"), F.col("clip_id").cast("double").alias("seconds"))
    return sampling.decode_shares(wanted).select("clip_id", "modality", "sharers", F.round("load_seconds", 6).alias("load_seconds"))


def seen_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.predictions(spark, sf_dir)
    return manifest.seen_in(p.where("split = 'test'"), p.where("doc_id % 10 < 5")).select("path", "seen_in_train")


def seen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    out = reports.seen_summary(manifest.seen_in(p, p.where("doc_id % 10 < 5")))
    return out.select("seen_in_train", "count", "misses", F.round("accuracy", 6).alias("accuracy"), F.round("miss_percent", 6).alias("miss_percent"))


def predict_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("path", "prediction", F.round("probability", 6).alias("probability"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.evaluate(S.predictions(spark, sf_dir))
    return out.select("count", F.round("accuracy", 6).alias("accuracy"), F.round("bce", 6).alias("bce"))


def miss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey") % 5).alias("m"), (F.col("n_nationkey") % 7).alias("c"))
    return rows.select("n_nationkey", F.round(numeric.miss_rate_percent(F.col("m"), F.col("c")), 6).alias("percent"), numeric.miss_line("nation", F.col("m"), F.col("c")).alias("line"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.timing_summary(S.timings(spark, sf_dir)))


def timing_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.timings(spark, sf_dir).groupBy("clip_id", "modality").agg(F.sum("extract_seconds").alias("extract_seconds"))
    one = S.table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("v"))
    loads = one.select(F.col("user_id").alias("clip_id"), F.when(F.col("user_id") % 2 == 0, "click").otherwise("default").alias("modality"), F.col("v").alias("seconds"))
    return _rounded(reports.allocate_load(t, loads).select("clip_id", "modality", "extract_seconds", "load_seconds"))


def batch_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = S.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    b = reports.batch_ids(ev, 4, "user_id", ["ts", "event_id"])
    b = b.withColumn("batch_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("batch_id").cast("string"))).withColumn("batch_elapsed_seconds", F.lit(2.0))
    return reports.batch_shares(b).select("event_id", "batch_id", "batch_size", F.round("elapsed_seconds", 6).alias("elapsed_seconds"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40 + 1).alias("epoch"), F.col("o_totalprice").alias("loss"), (F.col("o_orderkey") % 9 + 1).alias("batch_size"), (F.col("o_custkey") % 100 / 100.0).alias("accuracy"))
    return reports.epoch_means(li)


METRICS_SQL = "m AS (SELECT o_orderkey % 40 + 1 AS epoch, sum(o_totalprice * (o_orderkey % 9 + 1)) / sum(o_orderkey % 9 + 1) AS train_loss, sum(o_custkey % 100 / 100e0 * (o_orderkey % 9 + 1)) / sum(o_orderkey % 9 + 1) AS train_accuracy FROM orders GROUP BY 1)"


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("epoch", F.round("train_loss", 3).alias("train_loss"), F.round("train_accuracy", 6).alias("train_accuracy"))


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).select("epoch", F.round("train_accuracy", 6).alias("train_accuracy"))
    return reports.running_best(m)


def logged_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.logged_epochs(_metrics(spark, sf_dir).select("epoch"), 33)


def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 == 0, F.format_string("run_%03d", F.col("n_nationkey"))).otherwise(F.concat(F.lit("run_"), F.col("n_name")))
    return reports.next_run_index(S.table(spark, sf_dir, "nation").select(name.alias("name")))


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "labels").select("doc_id", paths.class_name(F.col("toxic")).alias("class_name"))


QUERIES = {f.__name__: f for f in (frame_sample_8, frame_sample_5, frame_count_reject, decode_share, seen_flag, seen_summary, predict_threshold, evaluation, miss_lines, timing_summary, timing_allocation, batch_timing, epoch_means, running_best, logged_epochs, run_index, class_names)}

_KEY = "class_name || ':' || split_part(path, '/', -1)"


def _sample_sql(k: int) -> str:
    return f"WITH {FRAMES_SQL}, c AS (SELECT clip_id, count(*) AS n FROM frames GROUP BY 1 HAVING count(*) >= {k}) SELECT clip_id, t.slot::INTEGER AS slot, round_even((n - 1) * t.slot / {float(k - 1)}e0, 0)::INTEGER AS frame_idx FROM c, range({k}) t(slot)"


ORACLES = {
    "frame_sample_8": _sample_sql(8),
    "frame_sample_5": _sample_sql(5),
    "frame_count_reject": f"WITH {FRAMES_SQL} SELECT clip_id, count(*) AS n_frames FROM frames GROUP BY 1 HAVING count(*) < 12",
    "decode_share": "WITH w AS (SELECT DISTINCT user_id AS clip_id, event_type AS modality, CASE WHEN event_type IN ('click', 'view') THEN 16 ELSE 32 END AS k FROM events) SELECT clip_id, modality, count(*) OVER w2 AS sharers, round(clip_id::DOUBLE / count(*) OVER w2, 6) AS load_seconds FROM w WINDOW w2 AS (PARTITION BY clip_id, k)",
    "seen_flag": f"WITH {PREDICTIONS_SQL} SELECT path, {_KEY} IN (SELECT {_KEY} FROM p0 WHERE doc_id % 10 < 5) AS seen_in_train FROM p0 WHERE split = 'test'",
    "seen_summary": f"WITH {PREDICTIONS_SQL}, s AS (SELECT *, {_KEY} IN (SELECT {_KEY} FROM p0 WHERE doc_id % 10 < 5) AS seen FROM predictions WHERE split = 'test') SELECT seen AS seen_in_train, count(*) AS count, count(*) FILTER (prediction <> label) AS misses, round(count(*) FILTER (prediction = label)::DOUBLE / count(*), 6) AS accuracy, round(count(*) FILTER (prediction <> label)::DOUBLE / count(*) * 100, 6) AS miss_percent FROM s GROUP BY 1",
    "predict_threshold": f"WITH {PREDICTIONS_SQL} SELECT path, prediction, round(probability, 6) AS probability FROM predictions",
    "evaluation": f"WITH {PREDICTIONS_SQL} SELECT count(*) AS count, round(avg((prediction = label)::INT::DOUBLE), 6) AS accuracy, round(avg(greatest(logit, 0e0) - logit * label + ln(1e0 + exp(-abs(logit)))), 6) AS bce FROM predictions",
    "miss_lines": "WITH r AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey % 5 END AS m, n_nationkey % 7 AS c FROM nation) SELECT n_nationkey, CASE WHEN c <> 0 THEN round(m::DOUBLE / c * 100, 6) END AS percent, 'nation=' || coalesce(m::VARCHAR, 'None') || ' of ' || c || ' ' || CASE WHEN c = 0 OR m IS NULL THEN '(n/a)' ELSE '(' || printf('%.2f', m::DOUBLE / c * 100) || '%)' END AS line FROM r",
    "timing_summary": f"WITH {TIMINGS_SQL} SELECT CASE WHEN grouping(modality) = 1 THEN 'total' ELSE modality END AS modality, count(*) AS count, round(sum(elapsed_seconds), 8) AS elapsed_seconds, round(sum(coalesce(load_seconds, 0e0)), 8) AS load_seconds, round(sum(extract_seconds), 8) AS extract_seconds, round(avg(elapsed_seconds), 8) AS mean_seconds, round(max(elapsed_seconds), 8) AS max_seconds, grouping(modality) = 1 AS grand_total FROM timings GROUP BY ROLLUP (modality)",
    "timing_allocation": f"WITH {TIMINGS_SQL}, t AS (SELECT clip_id, modality, sum(extract_seconds) AS extract_seconds FROM timings GROUP BY 1, 2), l AS (SELECT user_id AS clip_id, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'default' END AS modality, max(value) AS seconds FROM events WHERE event_type = 'click' GROUP BY 1) SELECT t.clip_id, t.modality, round(extract_seconds, 8) AS extract_seconds, round(coalesce(o.seconds, d.seconds, 0e0), 8) AS load_seconds FROM t LEFT JOIN l o ON o.clip_id = t.clip_id AND o.modality = t.modality LEFT JOIN l d ON d.clip_id = t.clip_id AND d.modality = 'default'",
    "batch_timing": "WITH b AS (SELECT event_id, user_id::VARCHAR || ':' || ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4)::VARCHAR AS batch_id FROM events) SELECT event_id, batch_id, count(*) OVER w AS batch_size, round(2e0 / count(*) OVER w, 6) AS elapsed_seconds FROM b WINDOW w AS (PARTITION BY batch_id)",
    "epoch_means": f"WITH {METRICS_SQL} SELECT epoch, round(train_loss, 3) AS train_loss, round(train_accuracy, 6) AS train_accuracy FROM m",
    "running_best": f"WITH {METRICS_SQL}, r AS (SELECT epoch, round(train_accuracy, 6) AS train_accuracy FROM m) SELECT epoch, train_accuracy, coalesce(train_accuracy > max(train_accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM r",
    "logged_epochs": f"WITH {METRICS_SQL} SELECT epoch FROM m WHERE epoch % 10 = 0 OR epoch = 33",
    "run_index": "SELECT (max(n_nationkey) + 1)::INTEGER AS next_index FROM nation WHERE n_nationkey % 3 = 0",
    "class_names": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'fake' ELSE 'real' END AS class_name FROM labels",
}
