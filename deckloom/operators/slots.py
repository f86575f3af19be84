"""Validation of slot assignments made by a layout planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators.stored import materialize

c = F.col

# Slots of the built-in templates and the element types each slot kind takes.
TEMPLATE_SLOTS = {
    "title_only": ["title"],
    "title_body": ["title", "body"],
    "title_two_column": ["title", "accent", "body", "body_secondary"],
    "image_left_text_right": ["media_primary", "title", "body"],
    "image_right_text_left": ["media_primary", "title", "body"],
    "comparison_2up": ["title", "accent", "body", "body_secondary"],
    "continuation_list": ["title", "body"],
}
SLOT_TYPES = {
    "title": ["text", "table-text", "placeholder"], "body": ["text", "table-text", "placeholder"],
    "body_secondary": ["text", "table-text", "placeholder"], "media_primary": ["image", "shape", "placeholder"],
    "accent": ["shape", "image", "placeholder", "text", "table-text"],
}


def template_slots(spark: SparkSession) -> DataFrame:
    rows = [(t, s, s, SLOT_TYPES[s]) for t, slots in TEMPLATE_SLOTS.items() for s in slots]
    return spark.createDataFrame(rows, "template_id string, slot_id string, slot_kind string, types array<string>")


def slot_assignment_violations(plans: DataFrame, outputs: DataFrame, assignments: DataFrame, elements: DataFrame,
                               slots: DataFrame, max_outputs: int = 3, slide: str = "slide_id") -> DataFrame:
    """Broken plan rules and omitted elements as (slide, rule, subject).

    ``plans``: slide, strategy; ``outputs``: slide, output_no, template_id; ``assignments``: slide,
    output_no, assign_no (order within the slide), element_id, slot_id, repeat, block_ids;
    ``elements``: slide, element_id, type, role, block_ids. Only content elements are planned.
    """

    def rows(df: DataFrame, rule: str, subject) -> DataFrame:
        return df.select(slide, F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))

    none = F.lit(None)
    n_out = outputs.groupBy(slide).agg(F.count("*").alias("_n"))
    sized = plans.join(n_out, slide, "left").withColumn("_n", F.coalesce(c("_n"), F.lit(0)))
    bad_count = ((c("strategy").isin("reflow", "preserve") & (c("_n") != 1))
                 | ((c("strategy") == "split") & (c("_n") < 2)))
    found = [
        rows(plans.filter(~c("strategy").isin("preserve", "reflow", "split")), "unknown_strategy", c("strategy")),
        rows(sized.filter(c("_n") < 1), "no_output_slide", none),
        rows(sized.filter(c("_n") > max_outputs), "too_many_output_slides", c("_n")),
        rows(sized.filter(bad_count), "wrong_output_count", c("strategy")),
    ]
    active = plans.filter(c("strategy") != "preserve").select(slide)
    outs = outputs.join(active, slide, "left_semi")
    names = slots.select("template_id").distinct()
    known_outs = outs.join(names, "template_id", "left_semi")
    found.append(rows(outs.join(names, "template_id", "left_anti"), "unknown_template", c("template_id")))
    found.append(rows(known_outs.join(assignments.select(slide, "output_no"), [slide, "output_no"], "left_anti"),
                      "no_assignments", c("template_id")))
    content = elements.filter(c("role") == "content").select(
        slide, "element_id", "type", c("block_ids").alias("_blocks"))
    rows_in = assignments.join(known_outs.select(slide, "output_no", "template_id"), [slide, "output_no"])
    rows_in = rows_in.join(content, [slide, "element_id"], "left").join(
        slots.select("template_id", "slot_id", "types"), ["template_id", "slot_id"], "left")
    # Stored once: a dozen rules below read it.
    rows_in = materialize(rows_in, "slot-plan")
    no_element, no_slot = c("type").isNull(), c("types").isNull()
    misfit = ~F.array_contains(c("types"), c("type"))
    found += [rows(rows_in.filter(no_element), "unknown_element", c("element_id")),
              rows(rows_in.filter(~no_element & no_slot), "unknown_slot", c("slot_id")),
              rows(rows_in.filter(~no_element & ~no_slot & misfit), "incompatible_slot", c("element_id"))]
    good = rows_in.filter(~no_element & ~no_slot & ~misfit)
    repeat = F.coalesce(c("repeat"), F.lit(False))
    first = good.groupBy(slide, "element_id").agg(F.min("assign_no").alias("_first"))
    again = good.join(first, [slide, "element_id"]).filter((c("assign_no") > c("_first")) & ~repeat)
    found.append(rows(again, "reused_without_repeat", c("element_id")))
    asked = F.size(F.coalesce(c("block_ids"), F.array().cast("array<string>")))
    has_blocks = F.coalesce(F.size(c("_blocks")), F.lit(0)) > 0
    found.append(rows(good.filter((asked > 0) & ~has_blocks), "element_without_blocks", c("element_id")))
    blocks = good.filter((asked > 0) & has_blocks).select(
        slide, "element_id", "assign_no", repeat.alias("_rep"), "_blocks", F.explode("block_ids").alias("block"))
    known_block = F.array_contains(c("_blocks"), c("block"))
    found.append(rows(blocks.filter(~known_block), "unknown_block", c("block")))
    used = blocks.filter(known_block)
    first_use = used.groupBy(slide, "block").agg(F.min("assign_no").alias("_first"))
    found.append(rows(used.join(first_use, [slide, "block"]).filter((c("assign_no") > c("_first")) & ~c("_rep")),
                      "block_reused_without_repeat", c("block")))
    whole = good.filter(asked == 0).select(slide, "element_id").distinct()
    wanted = content.join(active, slide, "left_semi").filter(has_blocks).select(
        slide, "element_id", F.explode("_blocks").alias("block"))
    uncovered = wanted.join(whole, [slide, "element_id"], "left_anti").join(
        first_use.select(slide, "block"), [slide, "block"], "left_anti")
    found.append(rows(uncovered, "block_not_covered", c("block")))
    dropped = content.join(active, slide, "left_semi").join(first, [slide, "element_id"], "left_anti")
    found.append(rows(dropped, "element_omitted", c("element_id")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
