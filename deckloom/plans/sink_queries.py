"""Queries for the writers: write to the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.plans.registry import query
from deckloom.session import shared_dir
from deckloom.sources import sinks

c = F.col


@query("snk01_write_summary", "fx_eval_case", "", """
SELECT CAST(case_id AS VARCHAR) AS id, CASE WHEN passed THEN 'success' ELSE 'failed' END AS status, score_milli AS objects FROM fx_eval_case""")
def snk01(t):
    rows = t.fx_eval_case.select(c("case_id").cast("string").alias("id"), F.when(c("passed"), "success").otherwise("failed")
                                 .alias("status"), c("score_milli").alias("objects"))
    path, stem = shared_dir(t.spark, "summary"), sinks.summary_stem()
    sinks.write_summary(rows, path, stem)
    return t.spark.read.schema("id string, status string, objects bigint").json(f"{path}/{stem}.json")


@query("snk02_register_artifacts", "documents", "", """
SELECT doc_id % 97 AS job_id, 'doc ' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.PNG' ELSE '.xyz' END AS name,
 CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256, CASE doc_id % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS media_type FROM documents""")
def snk02(t):
    suffix = F.when(c("doc_id") % 3 == 0, ".json").when(c("doc_id") % 3 == 1, ".PNG").otherwise(".xyz")
    new = t.documents.select(
        (c("doc_id") % 97).alias("job_id"), F.concat(F.lit("dir/doc "), c("doc_id").cast("string"), suffix).alias("name"),
        F.lit("report").alias("kind"), F.encode("text", "UTF-8").alias("content"),
        F.lit(None).cast("string").alias("parent_artifact_id"), F.lit("2024-01-01").alias("created_at"))
    path = shared_dir(t.spark, "artifacts")
    # Twice: the second time every name is already there.
    sinks.register_artifacts(new, path)
    sinks.register_artifacts(new, path)
    return t.spark.read.parquet(path).select("job_id", "name", "size_bytes", "sha256", "media_type")


@query("snk03_catalog_append", "documents", "", """
SELECT DISTINCT sha256(text) AS sha256 FROM documents""")
def snk03(t):
    rows = t.documents.select(F.sha2("text", 256).alias("sha256"), "lang")
    path = shared_dir(t.spark, "catalog")
    sinks.catalog_append(rows.filter("lang = 'en'"), path)
    sinks.catalog_append(rows, path)
    return t.spark.read.parquet(path).select("sha256")
