"""Manifest, path and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import paths
from cliploom.operators import manifest
from cliploom.plans import surrogates as S

FILES_SQL = """
files AS (
  SELECT d.doc_id, '/clips/' || d.source || '/' || d.lang || '_' || d.doc_id::VARCHAR ||
      CASE WHEN d.doc_id % 7 = 0 THEN '.MP4' WHEN d.doc_id % 11 = 0 THEN '.txt' ELSE '.mp4' END AS path,
    coalesce(l.toxic, 0)::INTEGER AS label, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'fake' ELSE 'real' END AS class_name,
    d.source AS source_id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN d.lang END AS identity_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _split_sql(name: str, where: str) -> str:
    return f"""
{name}_ids AS (SELECT source_id, row_number() OVER (ORDER BY md5('0:' || source_id), source_id) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT source_id FROM files WHERE {where} AND source_id IS NOT NULL)),
{name}_cut AS (SELECT source_id, i, n,
    CASE WHEN n >= 3 THEN least(greatest(floor(n * 0.8e0)::INT, 1), n - 2) ELSE 1 END AS t,
    floor(n * 0.1e0)::INT AS v0 FROM {name}_ids),
{name}_split AS (SELECT source_id, CASE WHEN i < t THEN 'train'
    WHEN i < CASE WHEN n >= 3 THEN least(greatest(t + v0, t + 1), n - 1) ELSE 1 END THEN 'val' ELSE 'test' END AS split FROM {name}_cut)"""


MANIFEST_SQL = f"""{FILES_SQL},{_split_sql('real', "label = 0")},{_split_sql('fake', "label = 1")},
manifest AS (
  SELECT path, label, class_name, source_id, split, identity_id FROM files JOIN real_split USING (source_id) WHERE label = 0
  UNION ALL
  SELECT path, label, class_name, source_id, split, identity_id FROM files JOIN fake_split USING (source_id) WHERE label = 1)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.files(spark, sf_dir).select("path", "label", "class_name", "source_id", "identity_id")
    return manifest.split_by_class(f)


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.group_split(S.files(spark, sf_dir).where("label = 0"), "source_id")


def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.in_split(_manifest(spark, sf_dir), "test")


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.split_summary(_manifest(spark, sf_dir))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return S.files(spark, sf_dir).select("path", paths.file_name(p).alias("name"), paths.stem(p).alias("stem"), paths.suffix(p).alias("suffix"), paths.parent_name(p).alias("parent"))


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/f/"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, "_clip_1_0").when(F.col("doc_id") % 3 == 1, "_swapped").otherwise(""), F.lit(".mp4")).alias("path"))
    return rows.select("doc_id", paths.real_source_id(p).alias("real_source"), paths.fake_source_id(p).alias("fake_source"))


def video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files(spark, sf_dir).where(paths.is_video(F.col("path"))).select("path", "label")


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.files(spark, sf_dir)
    return manifest.labelled_rows(f.where("label = 0"), 0).unionByName(manifest.labelled_rows(f.where("label = 1"), 1))


def overlap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.files(spark, sf_dir)
    return manifest.overlaps(f.where("doc_id % 2 = 0"), f.where("doc_id % 3 = 0"))


def strip_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.when(F.col("doc_id") % 2 == 0, "module.module.").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "backbone.").otherwise(""), F.col("lang"), F.lit(".weight"))
    return S.table(spark, sf_dir, "documents").select("doc_id", paths.strip_prefixes(key, ["module.", "backbone."]).alias("key"))


QUERIES = {f.__name__: f for f in (split_summary, group_split, manifest_union, manifest_filter, path_parts, source_ids, video_files, labelled_rows, overlap_keys, strip_prefixes)}

_NAME = "split_part(path, '/', -1)"
ORACLES = {
    "split_summary": f"WITH {MANIFEST_SQL} SELECT s.split, count(m.path) FILTER (m.label = 0)::BIGINT AS real, count(m.path) FILTER (m.label = 1)::BIGINT AS fake, count(m.path)::BIGINT AS total FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN manifest m ON m.split = s.split GROUP BY s.split",
    "group_split": f"WITH {MANIFEST_SQL} SELECT source_id, split FROM real_split",
    "manifest_union": f"WITH {MANIFEST_SQL} SELECT * FROM manifest",
    "manifest_filter": f"WITH {MANIFEST_SQL} SELECT * FROM manifest WHERE split = 'test'",
    "path_parts": f"WITH {FILES_SQL}, n AS (SELECT path, {_NAME} AS name FROM files) SELECT path, name, regexp_replace(name, '\\.[^.]+$', '') AS stem, regexp_extract(name, '(\\.[^.]+)$', 1) AS suffix, split_part(path, '/', -2) AS parent FROM n",
    "source_ids": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 THEN source ELSE source || '.mp4' END AS real_source, source AS fake_source FROM documents",
    "video_files": f"WITH {FILES_SQL} SELECT path, label FROM files WHERE lower(regexp_extract(path, '(\\.[^.]+)$', 1)) IN ('.mp4', '.mov', '.avi', '.mkv', '.webm')",
    "labelled_rows": f"WITH {FILES_SQL} SELECT path, label, class_name, CASE WHEN label = 0 THEN split_part({_NAME}, '_', 1) ELSE regexp_replace({_NAME}, '\\.[^.]+$', '') END AS source_id, CASE WHEN label = 1 THEN split_part(path, '/', -2) END AS identity_id FROM files",
    "overlap_keys": f"WITH {FILES_SQL} SELECT class_name, {_NAME} AS file_name FROM files WHERE doc_id % 2 = 0 INTERSECT SELECT class_name, {_NAME} FROM files WHERE doc_id % 3 = 0",
    "strip_prefixes": "SELECT doc_id, lang || '.weight' AS key FROM documents",
}
