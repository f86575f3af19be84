"""Summaries, artifacts and the template catalogue on storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.functions import text as tx
from deckloom.operators.skew import first_by
from deckloom.operators.stored import materialize

c = F.col

# Media types by suffix.
MEDIA_TYPES = {
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".json": "application/json", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".webp": "image/webp", ".svg": "image/svg+xml", ".pdf": "application/pdf", ".zip": "application/zip",
    ".txt": "text/plain", ".log": "text/plain", ".csv": "text/csv", ".html": "text/html", ".xml": "text/xml",
}
SUMMARY_COLUMNS = ["id", "status", "elapsed_seconds", "similarity_score", "pixel_mae", "edge_mae",
                   "foreground_color_similarity", "objects", "native_text_runs", "picture_objects",
                   "flattened_slide", "canvas_overflow_count", "iterations"]


def summary_stem(cases: list[str] | None = None, rescore: bool = False) -> str:
    """Name of a summary; a subset or a rescore never takes the full run's name."""
    prefix = "summary-rescore" if rescore else "summary"
    return f"{prefix}-{'-'.join(sorted(cases))}" if cases else prefix


def write_summary(rows: DataFrame, path: str, stem: str, columns: list[str] | None = None) -> None:
    """The summary as JSON and as CSV with fixed columns; an existing one is an error."""
    names = columns or SUMMARY_COLUMNS
    fixed = rows.select(*[c(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])
    fixed.write.mode("errorifexists").json(f"{path}/{stem}.json")
    fixed.write.mode("errorifexists").option("header", True).csv(f"{path}/{stem}.csv")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(v) for pair in MEDIA_TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream"))


def register_artifacts(new: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Append artifacts (job_id, name, kind, content, parent_artifact_id, created_at); returns the rejected ones.

    Names are made safe and are unique per job. Every row that is not appended comes back as
    (job_id, given_name, name, sha256, reason): ``empty_name`` where nothing of the name is safe, ``name_taken`` where
    the job has the name already, ``name_repeated`` where an earlier row of ``new`` takes it. Files are
    partitioned by a hash bucket of the job, so very many jobs do not make very many folders.
    """
    rows = materialize(new.select(
        F.monotonically_increasing_id().alias("_row"), "job_id", c("name").alias("given_name"), tx.safe_name(c("name")).alias("name"),
        "kind", F.length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        media_type(c("name")).alias("media_type"), "parent_artifact_id", "created_at"), "artifacts-new")
    empty = F.coalesce(c("name"), F.lit("")) == ""
    named = rows.filter(~empty)
    have = existing(new.sparkSession, path)
    if have is None:
        taken, free = named.limit(0), named
    else:
        # Read once: the appended rows must not count as taken.
        known = materialize(have.select("job_id", "name").join(named.select("job_id", "name"), ["job_id", "name"], "left_semi").distinct(),
                            "artifacts-known")
        taken = named.join(known, ["job_id", "name"], "left_semi")
        free = named.join(known, ["job_id", "name"], "left_anti")
    first = materialize(first_by(free, ["job_id", "name"], ["created_at", "sha256", "given_name", "_row"]), "artifacts-added")
    added = first.drop("_row", "given_name").withColumns({
        "artifact_id": F.sha2(F.concat_ws("/", c("job_id").cast("string"), "name"), 256),
        "job_bucket": F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")})
    added.write.mode("append").partitionBy("job_bucket").parquet(path)
    repeated = free.join(first.select("_row"), "_row", "left_anti")
    parts = [df.select("job_id", "given_name", "name", "sha256", F.lit(reason).alias("reason")) for df, reason in (
        (rows.filter(empty), "empty_name"), (taken, "name_taken"), (repeated, "name_repeated"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def catalog_append(new: DataFrame, path: str, key: str = "sha256") -> None:
    """Append catalogue rows whose key is not there yet, of equal keys the least row; doing it twice changes nothing."""
    rows = first_by(new, [key], [n for n in new.columns if n != key])
    have = existing(new.sparkSession, path)
    if have is not None:
        rows = rows.join(have.select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folders(spark: SparkSession, path: str) -> list[int]:
    """The batch numbers of the folders ``batch=`` that were written whole below a path, rising; none if there is no such path."""
    where, fs = _file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(where) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.partition("=")[2]) for p, n in names if n.startswith("batch=") and fs.exists(done(p, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)
