"""Incremental template import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deckloom.operators.catalog import NEAR_BITS, family_match, first_near
from deckloom.operators.skew import first_by
from deckloom.operators.stored import materialize
from deckloom.sources.sinks import existing
from deckloom.streaming.events import run_to_end

c = F.col


def _first_come(fresh: DataFrame, catalog: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Decks that are near to no accepted one, in the order of their ids, and the near pairs of the others.

    A deck waits while an earlier one near to it is undecided; the rest are accepted, and turn
    away what is near to them. Every round decides at least the first deck that waits.
    """
    pending, known = fresh, catalog
    kept, turned = [], []
    while True:
        hits = materialize(first_near(pending, "template_id", "phash", "slide_count", NEAR_BITS, catalog=known), "import")
        turned.append(hits.filter("in_catalog").select("template_id", "existing_id"))
        known = materialize(pending.join(hits.select("template_id"), "template_id", "left_anti"), "import")
        kept.append(known)
        waiting = hits.filter("NOT in_catalog").select("template_id")
        if waiting.isEmpty():
            break
        pending = materialize(pending.join(waiting, "template_id", "left_semi"), "import")
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, turned)


def import_templates(new: DataFrame, slides: DataFrame, catalog: DataFrame | None,
                     catalog_slides: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Accepted templates with their family, and what the others duplicate.

    ``new``: template_id (bigint), sha256, phash, slide_count; ``slides``: template_id, archetype.
    Content that exists already goes first, then near images with the same slide count, then
    the families: the best known one, or a new one shared by equal signatures. Within a batch the
    lower id counts as the earlier deck; only accepted decks turn others away.
    """
    first = first_by(new, ["sha256"], ["template_id"])
    copies = new.join(first.select("sha256", c("template_id").alias("existing_id")), "sha256").filter(
        c("existing_id") != c("template_id")).select("template_id", "existing_id", F.lit("exact").alias("kind"))
    fresh = first
    if catalog is not None:
        known = first.join(catalog.select("sha256", c("template_id").alias("existing_id")), "sha256").select(
            "template_id", "existing_id", F.lit("exact").alias("kind"))
        copies = copies.unionByName(known)
        fresh = first.join(catalog.select("sha256"), "sha256", "left_anti")
    fresh = materialize(fresh, "import")
    accepted, near = _first_come(fresh, catalog)
    duplicates = copies.unionByName(near.withColumn("kind", F.lit("near")))
    own = slides.join(accepted.select("template_id"), "template_id", "left_semi")
    if catalog_slides is None:
        matched = own.groupBy("template_id").agg(F.lit(None).cast("string").alias("family_id"))
    else:
        matched = family_match(own, catalog_slides, "template_id").select("template_id", "family_id")
    # Every archetype count is bounded by the number of archetypes, so the signature is short.
    counts = own.groupBy("template_id", "archetype").agg(F.count("*").alias("_n"))
    signature = counts.groupBy("template_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", "archetype", c("_n").cast("string")))), ",").alias("_sig"))
    named = accepted.join(matched, "template_id", "left").join(signature, "template_id", "left").withColumn(
        "_sig", F.coalesce(c("_sig"), F.lit("")))
    # A new family is named after its signature and its first deck, so it never takes an old name.
    leaders = named.filter(c("family_id").isNull()).groupBy("_sig").agg(F.min("template_id").alias("_lead"))
    family = F.coalesce(c("family_id"), F.concat(F.lit("family-"), F.substring(
        F.sha2(F.concat_ws("|", c("_sig"), c("_lead").cast("string")), 256), 1, 16)))
    return named.join(leaders, "_sig", "left").select(
        "template_id", "sha256", "phash", "slide_count", family.alias("family_id")), duplicates


def ingest_templates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Import a stream of decks (template_id, sha256, phash, slide_count, archetypes array).

    Each batch matches against what earlier batches left in ``path``/templates and
    ``path``/slides, and writes its own folder there; a replayed batch overwrites it.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def earlier(name: str) -> DataFrame | None:
            table = existing(spark, f"{path}/{name}")
            return None if table is None else table.filter(c("batch") < number).drop("batch")

        slides = batch.select("template_id", F.explode("archetypes").alias("archetype"))
        accepted, duplicates = import_templates(
            batch.drop("archetypes"), slides, earlier("templates"), earlier("slides"))
        accepted = materialize(accepted, "import")
        own = slides.join(accepted.select("template_id", "family_id"), "template_id")
        own.write.mode("overwrite").parquet(f"{path}/slides/batch={number}")
        duplicates.write.mode("overwrite").parquet(f"{path}/duplicates/batch={number}")
        accepted.write.mode("overwrite").parquet(f"{path}/templates/batch={number}")

    return run_to_end(stream, each, checkpoint)
