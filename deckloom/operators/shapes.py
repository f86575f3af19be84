"""Aggregates and overlap joins over shape rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions import values as vl
from deckloom.operators.skew import position
from deckloom.operators.stored import materialize

c = F.col

# The eight structural features, in similarity order.
FEATURES = ["shape_count", "picture_count", "group_count", "text_count", "table_count", "chart_count",
            "mean_width_pt", "mean_height_pt"]


def slide_features(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by kind, text count and mean size per slide.

    Columns: kind, frame_type (table or chart, for graphic frames), text, w_pt, h_pt.
    """

    def count_of(cond: Column) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    return shapes.groupBy(*keys).agg(
        count_of(c("kind") == "sp").alias("shape_count"),
        count_of(c("kind") == "pic").alias("picture_count"),
        count_of(c("kind") == "grpSp").alias("group_count"),
        count_of(c("text") != "").alias("text_count"),
        count_of(c("frame_type") == "table").alias("table_count"),
        count_of(c("frame_type") == "chart").alias("chart_count"),
        F.round(F.avg(F.coalesce(c("w_pt"), F.lit(0))), 3).alias("mean_width_pt"),
        F.round(F.avg(F.coalesce(c("h_pt"), F.lit(0))), 3).alias("mean_height_pt"),
    )


def archetype(chart: Column, table: Column, picture: Column, text: Column, shape: Column) -> Column:
    return (
        F.when(chart > 0, "chart").when(table > 0, "table").when(picture >= 2, "visual")
        .when((text <= 2) & (shape <= 4), "title").when(text >= 8, "dense_content")
        .when(shape >= 12, "process").otherwise("content")
    )


def with_archetype(features: DataFrame) -> DataFrame:
    return features.withColumn("archetype", archetype(
        c("chart_count"), c("table_count"), c("picture_count"), c("text_count"), c("shape_count")))


def dominant_colors(shapes: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """The k most common fills as (keys, color, uses, color_rank); ties by colour.

    The rank filter lets Spark keep only k rows per task before the shuffle of the ranking.
    """
    counts = shapes.filter(c("fill_color").isNotNull() & (c("fill_color") != "")).groupBy(
        *keys, c("fill_color").alias("color")).agg(F.count("*").alias("uses"))
    best = Window.partitionBy(*keys).orderBy(c("uses").desc(), "color")
    return counts.withColumn("color_rank", F.row_number().over(best)).filter(c("color_rank") <= k)


def color_lists(colors: DataFrame, keys: list[str]) -> DataFrame:
    """The ranked colours of each key as a sorted array; at most k entries by construction."""
    return colors.groupBy(*keys).agg(F.array_sort(F.collect_list("color")).alias("dominant_colors"))


def duplicate_ids(shapes: DataFrame, scope: list[str], id_col: str) -> DataFrame:
    """Ids (or names) used more than once within a scope; empty ones are not ids."""
    return (shapes.filter(c(id_col).isNotNull() & (c(id_col).cast("string") != ""))
            .groupBy(*scope, id_col).agg(F.count("*").alias("uses")).filter(c("uses") > 1))


def object_counts(elements: DataFrame, primitives: DataFrame, keys: list[str]) -> DataFrame:
    """Elements per kind and the primitives that component instances expand to."""
    sizes = primitives.groupBy("component_id").agg(F.count("*").alias("_size"))
    kinds = ["text", "shape", "line", "path", "image", "component"]
    joined = elements.join(sizes, "component_id", "left")
    return joined.groupBy(*keys).agg(
        *[F.count_if(c("kind") == k).alias(k) for k in kinds],
        F.coalesce(F.sum(F.when(c("kind") == "component", c("_size"))), F.lit(0))
        .alias("expanded_component_objects"))


def group_bounds(shapes: DataFrame, members: DataFrame, keys: list[str], group: str = "group_id") -> DataFrame:
    """Enclosing box and insertion position of the member shapes of each group."""
    return (shapes.join(members, [*keys, "shape_id"])
            .groupBy(*keys, group)
            .agg(F.min("x_pt").alias("x_pt"), F.min("y_pt").alias("y_pt"),
                 F.greatest(F.lit(1), F.max(c("x_pt") + c("w_pt")) - F.min("x_pt")).alias("w_pt"),
                 F.greatest(F.lit(1), F.max(c("y_pt") + c("h_pt")) - F.min("y_pt")).alias("h_pt"),
                 F.min("z").alias("insert_at"), F.count("*").alias("members")))


def text_manifest(shapes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Non-empty texts of each slide with their position, one row per text.

    Long form in place of an array, so a slide with very many texts stays spread out.
    """
    texts = shapes.filter(c("text") != "").select(*keys, order, "text")
    return position(texts, keys, [order], "position").select(*keys, "position", "text")


def _boxes(df: DataFrame, keys: list[str], box: list[str], id_col: str, side: str) -> DataFrame:
    """Identical boxes as one row with their least id and number of copies."""
    return df.groupBy(*keys, *[c(n).alias(f"{side}_{m}") for n, m in zip(box, "xywh")]).agg(
        F.min(id_col).alias(f"{side}_id"), F.count("*").alias(f"{side}_copies"))


def _cells(df: DataFrame, side: str, cell: int) -> DataFrame:
    def span(low: Column, size: Column) -> Column:
        return F.sequence(F.floor(low / cell), F.floor((low + size) / cell))

    return df.withColumn("_gx", F.explode(span(c(f"{side}_x"), c(f"{side}_w")))).withColumn(
        "_gy", F.explode(span(c(f"{side}_y"), c(f"{side}_h"))))


def overlapping_shapes(a: DataFrame, b: DataFrame | None, keys: list[str], id_col: str = "shape_id",
                       box: tuple[str, ...] = ("x_pt", "y_pt", "w_pt", "h_pt"), threshold: float = 0.75,
                       min_area: float | None = None, cell: int = 256) -> DataFrame:
    """Overlapping boxes of ``a`` and ``b`` (or within ``a``) on the same keys.

    A pair counts when the intersection covers ``threshold`` of the smaller box, or, with
    ``min_area``, when its area is above it. Copies of one box are joined once and carried as
    a count, and the join key holds a grid cell, so neither copies nor a crowded slide meet
    in one task as all pairs; ``box_members`` names all shapes of a box. A pair that shares several cells is kept in the one cell with the
    upper left corner of its intersection.
    """
    left = _boxes(a, keys, list(box), id_col, "a")
    right = _boxes(a if b is None else b, keys, list(box), id_col, "b")
    pairs = _cells(left, "a", cell).join(_cells(right, "b", cell), [*keys, "_gx", "_gy"])
    pairs = pairs.filter(
        (F.floor(F.greatest("a_x", "b_x") / cell) == c("_gx"))
        & (F.floor(F.greatest("a_y", "b_y") / cell) == c("_gy")))
    if b is None:
        first = F.struct(*[f"a_{m}" for m in "xywh"])
        second = F.struct(*[f"b_{m}" for m in "xywh"])
        pairs = pairs.filter((first < second) | ((first == second) & (c("a_copies") > 1)))
    corners = [c(f"{s}_{m}") for s in "ab" for m in "xywh"]
    area = vl.intersection_area(*corners)
    smaller = F.greatest(F.lit(1), F.least(c("a_w") * c("a_h"), c("b_w") * c("b_h")))
    pairs = pairs.withColumns({"overlap_area": area, "overlap_ratio": area / smaller})
    keep = c("overlap_area") > min_area if min_area is not None else c("overlap_ratio") >= threshold
    return pairs.filter(keep).drop("_gx", "_gy")


def suppress_covered(boxes: DataFrame, keys: list[str], id_col: str = "shape_id",
                     box: tuple[str, ...] = ("x_pt", "y_pt", "w_pt", "h_pt"), threshold: float = 0.75,
                     cell: int = 256) -> DataFrame:
    """Shapes whose box no larger one that stays covers to ``threshold`` of the smaller area.

    Of two boxes with the same area the earlier in (x, y, w, h) order counts as the larger. A box that is covered itself covers no other. In
    every round the boxes that nothing undecided covers stay, those that they cover go, and what is left is decided anew: as many rounds
    as the longest chain of boxes that cover each other by turns. Shapes of equal boxes all stay or all go; ``box_id`` is their least id.
    """
    pairs = overlapping_shapes(boxes, None, keys, id_col, box, threshold, cell=cell)
    one, other = (F.struct(*[c(f"{side}_{m}").alias(m) for m in "xywh"]) for side in "ab")
    loses_a = c("a_w") * c("a_h") < c("b_w") * c("b_h")
    covers = materialize(pairs.filter(one != other).select(
        *keys, F.when(loses_a, other).otherwise(one).alias("winner"), F.when(loses_a, one).otherwise(other).alias("loser")), "covers")
    gone = covers.select(*keys, c("loser").alias("box")).limit(0)
    while not covers.isEmpty():
        losers = covers.select(*keys, c("loser").alias("winner"))
        firm = covers.select(*keys, "winner").distinct().join(losers, [*keys, "winner"], "left_anti")
        round_ = materialize(covers.join(firm, [*keys, "winner"], "left_semi").select(*keys, "loser").distinct(), "covered")
        gone = gone.unionByName(round_.withColumnRenamed("loser", "box"))
        covers = materialize(covers.join(round_, [*keys, "loser"], "left_anti").join(
            round_.withColumnRenamed("loser", "winner"), [*keys, "winner"], "left_anti"), "covers")
    covered = gone.select(*keys, *[c(f"box.{m}").alias(n) for m, n in zip("xywh", box)])
    return box_members(boxes, keys, id_col, box).join(covered, [*keys, *box], "left_anti")


def box_members(shapes: DataFrame, keys: list[str], id_col: str = "shape_id",
                box: tuple[str, ...] = ("x_pt", "y_pt", "w_pt", "h_pt")) -> DataFrame:
    """Every shape with ``box_id``, the id that stands for its box in pairs: the least of equal boxes."""
    least = shapes.groupBy(*keys, *box).agg(F.min(id_col).alias("box_id"))
    return shapes.select(*keys, id_col, *box).join(least, [*keys, *box])


# ---- conversion risk of whole slides -------------------------------------------------------


def preserve_score(slides: DataFrame, min_score_strict: float = 0.68, min_score_auto: float = 0.84,
                   policy: str = "strict") -> DataFrame:
    """How well a slide survives plain scaling, with reasons and whether reflow is allowed.

    Columns: scale, low_fonts, splits, overlap_fixes, unsupported, placeholders,
    source_visuals (background, master and decorative objects) and kept_visuals.
    """
    zero = F.lit(0.0)

    def hit(cond: Column, cost: Column | float) -> Column:
        return F.when(cond, cost if isinstance(cost, Column) else F.lit(cost)).otherwise(zero)

    lost_visuals = (c("source_visuals") > 0) & (c("kept_visuals") == 0)
    penalties = [
        hit(c("scale") < 0.82, 0.06), hit(c("scale") < 0.68, 0.12),
        hit(c("low_fonts") > 0, F.least(F.lit(0.28), c("low_fonts") * 0.12)),
        hit(c("splits") > 0, F.least(F.lit(0.3), c("splits") * 0.18)),
        hit(c("overlap_fixes") > 0, F.least(F.lit(0.18), c("overlap_fixes") * 0.05)),
        hit(c("unsupported") > 0, 0.08), hit(c("placeholders") > 0, 0.05), hit(lost_visuals, 0.24),
    ]
    score = F.lit(1.0)
    for p in penalties:
        score = score - p
    reasons = F.array_compact(F.array(
        F.when(c("scale") < 0.82, "major-size-change"), F.when(c("scale") < 0.68, "aggressive-downscale"),
        F.when(c("low_fonts") > 0, "text-below-min-font"), F.when(c("splits") > 0, "preserve-overflow-risk"),
        F.when(c("overlap_fixes") > 0, "preserve-overlap-risk"),
        F.when(c("unsupported") > 0, "unsupported-source-content"),
        F.when(c("placeholders") > 0, "placeholder-source-content"),
        F.when(lost_visuals, "decorative-structure-loss")))
    severe = (c("low_fonts") > 0) | (c("splits") > 0) | (c("overlap_fixes") > 0) | lost_visuals
    out = slides.withColumns({"preserve_score": vl.round_up(vl.clamp01(score), 3), "risk_reasons": reasons})
    limit = {"strict": min_score_strict, "auto": min_score_auto}.get(policy)
    allowed = (severe | (c("preserve_score") < limit)) if limit is not None else F.lit(False)
    out = out.withColumn("reflow_allowed", allowed)
    return out.withColumn("reflow_reason", F.when(c("reflow_allowed"), F.coalesce(
        F.try_element_at(c("risk_reasons"), F.lit(1)), F.lit("preserve-quality-risk"))))


def slide_confidence(slides: DataFrame) -> DataFrame:
    """Blend of a penalty score, planner confidence and preserve score, as ``confidence``.

    Columns: unsupported, placeholders, dropped, splits, overlap_fixes, resizes, output_slides,
    planner_warnings, visual_risks, fallback, timed_out, planner_confidence, preserve_score.
    """
    score = (
        F.lit(1.0) - c("unsupported") * 0.12 - c("placeholders") * 0.04 - c("dropped") * 0.15
        - c("splits") * 0.18 - c("overlap_fixes") * 0.03 - c("resizes") * 0.05
        - F.greatest(F.lit(0), c("output_slides") - 1) * 0.08 - c("planner_warnings") * 0.04
        - c("visual_risks") * 0.08
        - F.when(c("fallback"), 0.08).otherwise(0.0) - F.when(c("timed_out"), 0.04).otherwise(0.0)
    )
    blend = score * 0.45 + vl.clamp01(c("planner_confidence")) * 0.25 + F.coalesce(
        c("preserve_score"), F.lit(1.0)) * 0.3
    return slides.withColumn("confidence", vl.round_up(vl.clamp01(blend), 3))


def review_queue(slides: DataFrame, threshold: float = 0.78, strict: bool = True) -> DataFrame:
    """Manual-review flag with reasons; takes the columns of ``slide_confidence`` plus strategy."""
    flags = [
        ("low-confidence", c("confidence") < threshold), ("unsupported-elements", c("unsupported") > 0),
        ("deleted-elements", c("dropped") > 0), ("slide-split", (c("splits") > 0) | (c("strategy") == "split")),
        ("multi-output-slide", c("output_slides") > 1), ("placeholder-content", c("placeholders") > 0),
        ("planner-validation", c("planner_warnings") > 0), ("planner-fallback", c("fallback")),
        ("visual-risk", c("visual_risks") > 0),
    ]
    trigger = ((c("unsupported") > 0) | (c("dropped") > 0) | (c("splits") > 0) | (c("placeholders") > 0)
               | (c("planner_warnings") > 0) | c("fallback") | (c("visual_risks") > 0))
    low = c("confidence") < threshold
    return slides.withColumns({
        "review_reasons": F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in flags])),
        "needs_review": (low | trigger) if strict else low})


def deck_growth(slides: DataFrame, keys: list[str], max_growth_pct: float = 200.0) -> DataFrame:
    """Output slides per deck against the allowed growth."""
    return slides.groupBy(*keys).agg(
        F.count("*").alias("source_slides"), F.sum("output_slides").alias("output_slides")
    ).withColumn("growth_exceeded",
                 c("output_slides") > F.ceil(c("source_slides") * (1 + max_growth_pct / 100)))
