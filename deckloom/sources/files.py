"""Slide graphs, images, reports, manifests and text trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.schemas import COMPONENT_KEYS, ELEMENT_KEYS, MANIFEST, NESTED_KEYS, REPORT, SLIDE, SLIDE_KEYS

c = F.col


def _unknown(where: str, objects: Column, known: list[str]) -> Column:
    """Keys of JSON objects (an array of texts) that are not known, with the place they stand at."""
    keys = F.flatten(F.transform(objects, lambda o: F.coalesce(F.json_object_keys(o), F.array().cast("array<string>"))))
    odd = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
    return F.transform(odd, lambda k: F.concat(F.lit(where), k))


def _members(objects: Column, key: str) -> Column:
    """Objects under a key of JSON objects: each itself, or the members of an array."""
    found = F.transform(objects, lambda o: F.get_json_object(o, f"$.{key}"))
    lists = F.transform(found, lambda f: F.when(F.substring(f, 1, 1) == "[", F.from_json(f, "array<string>")).otherwise(F.array(f)))
    return F.filter(F.flatten(F.filter(lists, lambda v: v.isNotNull())), lambda v: v.isNotNull())


def unknown_keys(spec: Column) -> Column:
    """Keys of a slide graph, given as JSON, that its schema does not have, at any depth."""
    parts = [("", F.array(spec), SLIDE_KEYS)]
    components = _members(F.array(spec), "components")
    parts.append(("components.", components, COMPONENT_KEYS))
    for where, elements in (("elements.", _members(F.array(spec), "elements")), ("components.elements.", _members(components, "elements"))):
        parts.append((where, elements, ELEMENT_KEYS))
        for key, known in NESTED_KEYS.items():
            inner = elements
            for step in key.split("."):
                inner = _members(inner, step)
            parts.append((f"{where}{key}.", inner, known))
    return F.array_distinct(F.concat(*[_unknown(*p) for p in parts]))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row per slide graph file: its path, fields, ``_corrupt_record`` and ``unknown_keys`` (dotted places)."""
    return specs(spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("path"), "value"))


def specs(files: DataFrame) -> DataFrame:
    """``read_specs`` of files that are rows already (path, value)."""
    parsed = F.from_json("value", SLIDE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return files.select("path", parsed.alias("_s"), F.when(F.json_object_keys("value").isNotNull(), unknown_keys(c("value"))).alias(
        "unknown_keys")).select("path", "_s.*", "unknown_keys")


def spec_elements(slides: DataFrame, key: str = "path") -> DataFrame:
    """Element rows with their place in the slide, box columns flattened."""
    rows = slides.select(key, "source_width", "source_height", F.posexplode("elements").alias("ordinal", "e"))
    return rows.select(key, "source_width", "source_height", "ordinal", "e.*").select(
        "*", "bounds.x", "bounds.y", "bounds.width", "bounds.height").drop("bounds")


def spec_primitives(slides: DataFrame, key: str = "path") -> DataFrame:
    """Primitives of the component library of each slide."""
    parts = slides.select(key, F.explode("components").alias("p"))
    return parts.select(key, c("p.id").alias("component_id"), F.posexplode("p.elements").alias("ordinal", "e")).select(
        key, "component_id", "ordinal", c("e").dropFields("component_id").alias("e")).select(
        key, "component_id", "ordinal", "e.*")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels (image_id, x, y, r, g, b). Bytes are stored as blue, green, red rows."""
    images = spark.read.format("image").load(path).select("image.*").filter(c("height") > 0)
    lines = images.select(c("origin").alias("image_id"), "width", "nChannels",
                          F.posexplode(F.transform(F.sequence(F.lit(0), c("height") - 1), lambda y: F.substring(
                              c("data"), y * c("width") * c("nChannels") + 1, c("width") * c("nChannels"))))
                          .alias("y", "line"))
    dots = lines.withColumn("x", F.explode(F.sequence(F.lit(0), c("width") - 1)))

    def byte(channel: int):
        # Grey images have one channel for all three colours.
        at = c("x") * c("nChannels") + 1 + F.when(c("nChannels") >= 3, F.lit(channel)).otherwise(F.lit(0))
        return F.conv(F.hex(F.substring(c("line"), at, F.lit(1))), 16, 10).cast("bigint")

    return dots.select("image_id", c("x").cast("bigint").alias("x"), c("y").cast("bigint").alias("y"),
                       byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases with the url and landing page of their source."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    cases = rows.select("canvas", "sources", F.explode("cases").alias("k"))
    source = F.try_element_at(c("sources"), c("k.source"))
    return cases.select(c("k.id").alias("case_id"), c("k.source").alias("source"), c("k.page").alias("page"),
                        c("k.category").alias("category"), c("k.difficulty").alias("difficulty"),
                        c("canvas.width").alias("canvas_width"), c("canvas.height").alias("canvas_height"),
                        source.url.alias("url"), source.landing_page.alias("landing_page"))


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """One flat row per run report; the case is the report's folder."""
    return report_rows(spark.read.schema(REPORT).option("multiLine", True).json(glob).select("*", c("_metadata.file_path").alias("path")))


def reports(files: DataFrame) -> DataFrame:
    """``read_reports`` of files that are rows already (path, value)."""
    return report_rows(files.select("path", F.from_json("value", REPORT).alias("_r")).select("path", "_r.*"))


def report_rows(rows: DataFrame) -> DataFrame:
    """One flat row per parsed report (``path`` and the fields of REPORT)."""
    native = F.coalesce(c("audit.native_shape_objects"), F.lit(0)) + F.coalesce(c("audit.picture_objects"), F.lit(0))
    keys = ["engine_version", "metric_version", "model", "quality_profile", "local_optimization",
            "powerpoint_validation_mode", "font_policy", "raster_policy", "requested_iterations", "target_score"]
    return rows.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case_id"), *keys, "best_metrics.*",
        c("audit.native_shape_objects").alias("native_shape_objects"),
        c("audit.picture_objects").alias("picture_objects"), c("audit.native_text_runs").alias("native_text_runs"),
        c("audit.flattened_slide").alias("flattened_slide"),
        c("audit.canvas_overflow_count").alias("canvas_overflow_count"),
        c("ooxml_validation.compatible").alias("compatible"),
        F.when(c("audit").isNotNull(), native).alias("objects"), F.size("iterations").alias("iterations"))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder: path, suffix, and the text, null when it is not UTF-8."""
    return text_corpus(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def text_corpus(files: DataFrame) -> DataFrame:
    """``read_text_corpus`` of files that are rows already (path, content)."""
    text = F.try_validate_utf8(c("content").cast("string"))
    return files.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"),
                        text.alias("content"))
