"""Geometry and layout rules over shape and element rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.functions import values as vl

c = F.col

# Page presets in inches.
PAGE_SIZES = [
    ("wide", "WIDE_16_9", 13.333, 7.5),
    ("standard", "STANDARD_4_3", 10.0, 7.5),
    ("a4", "A4_LANDSCAPE", 11.693, 8.268),
    ("a4-portrait", "A4_PORTRAIT", 8.268, 11.693),
]
# Fixed value: rounding slack of the package unit, 1000 EMU.
OVERFLOW_TOLERANCE_EMU = 1000
FLOW_TYPES = ["text", "table-text", "placeholder"]


def page_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGE_SIZES, "layout_id string, layout_name string, width double, height double")


def rule_rows(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]], out: str = "rule") -> DataFrame:
    """One row per broken rule; a rule is broken where its condition is true."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))
    return df.select(*keys, F.explode(hits).alias(out))


def _outside_unit(value: Column) -> Column:
    return ~value.between(0.0, 1.0)


def constraint_violations(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Row rules of the slide graph, as (keys, rule) rows; absent columns are not checked.

    Expected columns, all optional: x, y, width, height, opacity, color, font_size_pt,
    line_spacing, margin_px, ``fill`` struct(kind, color, opacity, angle_deg, stops),
    ``stroke`` struct(color, opacity, width_px) and ``commands`` array of
    struct(op, x, y, x1, y1, x2, y2).
    """
    have = set(elements.columns)
    rules: list[tuple[str, Column]] = []
    if {"x", "y", "width", "height"} <= have:
        box = [c(n).cast("double") for n in ("x", "y", "width", "height")]
        odd = [F.isnan(v) | (F.abs(v) == float("inf")) for v in box]
        rules += [("bounds_not_finite", odd[0] | odd[1] | odd[2] | odd[3]),
                  ("size_not_positive", (c("width") <= 0) | (c("height") <= 0))]
    if "opacity" in have:
        rules.append(("opacity_out_of_range", _outside_unit(c("opacity"))))
    if "color" in have:
        rules.append(("color_invalid", ~vl.valid_hex(c("color"))))
    if "fill" in have:
        kind, stops = c("fill.kind"), c("fill.stops")
        rules += [
            ("fill_opacity_out_of_range", _outside_unit(c("fill.opacity"))),
            ("fill_color_invalid", ~vl.valid_hex(c("fill.color"))),
            ("solid_without_color", (kind == "solid") & c("fill.color").isNull()),
            ("gradient_too_few_stops", (kind == "linear_gradient") & (F.coalesce(F.size(stops), F.lit(0)) < 2)),
            ("gradient_without_angle", (kind == "linear_gradient") & c("fill.angle_deg").isNull()),
            ("stop_out_of_range", F.exists(stops, lambda s: _outside_unit(s.position) | _outside_unit(s.opacity))),
            ("stop_color_invalid", F.exists(stops, lambda s: ~F.coalesce(vl.valid_hex(s.color), F.lit(False)))),
        ]
    if "stroke" in have:
        rules += [
            ("stroke_opacity_out_of_range", _outside_unit(c("stroke.opacity"))),
            ("stroke_color_invalid",
             ~vl.valid_hex(c("stroke.color"))),
            ("stroke_width_negative", c("stroke.width_px") < 0),
        ]
    for name, code in (("font_size_pt", "font_size_not_positive"), ("line_spacing", "line_spacing_not_positive")):
        if name in have:
            rules.append((code, c(name) <= 0))
    if "margin_px" in have:
        rules.append(("margin_negative", c("margin_px") < 0))
    if "commands" in have:
        cmds = c("commands")

        def missing(m: Column) -> Column:
            first = m.x1.isNull() | m.y1.isNull()
            return (
                (m.op.isin("M", "L", "C", "Q") & (m.x.isNull() | m.y.isNull()))
                | ((m.op == "C") & (first | m.x2.isNull() | m.y2.isNull()))
                | ((m.op == "Q") & first)
            )

        rules += [("path_too_short", F.size(cmds) < 2),
                  ("path_not_started", F.try_element_at(cmds, F.lit(1)).op != "M"),
                  ("path_coordinates_missing", F.exists(cmds, missing))]
    return rule_rows(elements, keys, rules)


def clamp_to_canvas(elements: DataFrame, width: float, height: float, keep_dropped: bool = False) -> DataFrame:
    """Fit element boxes into the canvas; adds ``clamp`` = kept, changed or dropped.

    Boxes (x, y, width, height, rotation_deg) are cut to the canvas; a cut image moves its
    source region (source_x, source_y, source_width, source_height) by the same share; then
    a rotated box is shrunk and shifted until its rotated extent fits. Lines (kind ``line``
    with x1, y1, x2, y2) only have their ends clamped. Rows left without area are dropped.
    """
    have, w, h = set(elements.columns), F.lit(float(width)), F.lit(float(height))
    is_line = (c("kind") == "line") if {"x1", "y1", "x2", "y2"} <= have else F.lit(False)
    zero = F.lit(0.0)
    out = elements.withColumns({
        "_l": F.greatest(zero, c("x").cast("double")), "_t": F.greatest(zero, c("y").cast("double")),
        "_r": F.least(w, (c("x") + c("width")).cast("double")),
        "_b": F.least(h, (c("y") + c("height")).cast("double")),
    })
    empty = ~is_line & ((c("_r") <= c("_l")) | (c("_b") <= c("_t")))
    cut = (c("_l") != c("x")) | (c("_t") != c("y")) | (c("_r") - c("_l") != c("width")) | (
        c("_b") - c("_t") != c("height"))
    out = out.withColumns({"_w": c("_r") - c("_l"), "_h": c("_b") - c("_t"), "_cut": cut})
    turn = F.radians(F.coalesce(c("rotation_deg").cast("double"), zero))
    cos, sin = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    out = out.withColumns({"_rw": c("_w") * cos + c("_h") * sin, "_rh": c("_w") * sin + c("_h") * cos,
                           "_cx": c("_l") + c("_w") / 2, "_cy": c("_t") + c("_h") / 2})
    turned = F.coalesce(c("rotation_deg").cast("double"), zero) != 0
    out = out.withColumn("_fit", F.when(turned, F.least(F.lit(1.0), F.try_divide(w, c("_rw")), F.try_divide(h, c("_rh")))).otherwise(1.0))
    out = out.withColumns({"_fw": c("_w") * c("_fit"), "_fh": c("_h") * c("_fit"),
                           "_left": c("_cx") - c("_rw") * c("_fit") / 2,
                           "_right": c("_cx") + c("_rw") * c("_fit") / 2,
                           "_top": c("_cy") - c("_rh") * c("_fit") / 2,
                           "_bottom": c("_cy") + c("_rh") * c("_fit") / 2})

    def shift(low: str, high: str, limit: Column) -> Column:
        back = F.when(c(low) < 0, -c(low)).otherwise(F.least(zero, limit - c(high)))
        return F.when(turned, back).otherwise(zero)

    out = out.withColumns({"_sx": shift("_left", "_right", w), "_sy": shift("_top", "_bottom", h)})
    small = turned & (c("_fit") < 1)
    new = {
        "x": F.when(small, c("_cx") - c("_fw") / 2).otherwise(c("_l")) + c("_sx"),
        "y": F.when(small, c("_cy") - c("_fh") / 2).otherwise(c("_t")) + c("_sy"),
        "width": c("_fw"), "height": c("_fh"),
    }
    changed = c("_cut") | small | (c("_sx") != 0) | (c("_sy") != 0)
    final: dict[str, Column] = {n: F.when(is_line, c(n).cast("double")).otherwise(v) for n, v in new.items()}
    if {"source_x", "source_y", "source_width", "source_height"} <= have:
        image = (c("kind") == "image") & c("_cut")
        final |= {
            "source_x": F.when(image, c("source_x") + F.try_divide(c("_l") - c("x"), c("width")) * c("source_width"))
            .otherwise(c("source_x").cast("double")),
            "source_y": F.when(image, c("source_y") + F.try_divide(c("_t") - c("y"), c("height")) * c("source_height"))
            .otherwise(c("source_y").cast("double")),
            "source_width": F.when(image, F.try_divide(c("_w"), c("width")) * c("source_width"))
            .otherwise(c("source_width").cast("double")),
            "source_height": F.when(image, F.try_divide(c("_h"), c("height")) * c("source_height"))
            .otherwise(c("source_height").cast("double")),
        }
    if {"x1", "y1", "x2", "y2"} <= have:
        ends = {n: vl.clamp(c(n).cast("double"), 0.0, w if n[0] == "x" else h) for n in ("x1", "y1", "x2", "y2")}
        moved = (ends["x1"] != c("x1")) | (ends["y1"] != c("y1")) | (ends["x2"] != c("x2")) | (ends["y2"] != c("y2"))
        changed = F.when(is_line, moved).otherwise(changed)
        final |= {n: F.when(is_line, v).otherwise(c(n).cast("double")) for n, v in ends.items()}
    final["clamp"] = F.when(empty, "dropped").when(changed, "changed").otherwise("kept")
    out = out.withColumns(final).drop(*[n for n in out.columns if n.startswith("_")])
    return out if keep_dropped else out.filter(c("clamp") != "dropped")


def canvas_overflow(shapes: DataFrame, width: float, height: float, tolerance: float,
                    x="x", y="y", w="width", h="height", rot="rotation_deg") -> DataFrame:
    """Shapes whose rotated extent leaves the canvas by more than ``tolerance``."""
    ew, eh = vl.rotated_extent(c(w), c(h), c(rot))
    out = shapes.withColumns({
        "extent_x": c(x) + c(w) / 2 - ew / 2, "extent_y": c(y) + c(h) / 2 - eh / 2,
        "extent_w": ew, "extent_h": eh})
    inside = (
        (c("extent_x") >= -tolerance) & (c("extent_y") >= -tolerance)
        & (c("extent_x") + c("extent_w") <= width + tolerance)
        & (c("extent_y") + c("extent_h") <= height + tolerance)
    )
    return out.filter(~inside)


def aspect_violations(slides: DataFrame, width: float, height: float) -> DataFrame:
    """Slides whose width/height ratio is more than 0.02 away from the target's."""
    gap = F.abs(F.try_divide(c("source_width"), c("source_height")) - F.lit(width / height))
    return slides.filter(gap > 0.02)


def scale_to_canvas(elements: DataFrame, width: float, height: float) -> DataFrame:
    """Rescale geometry to the target canvas; fonts, strokes and margins by the lesser factor.

    Rows carry their slide's source_width and source_height. Slides with another aspect ratio
    are left out here and reported by ``aspect_violations``.
    """
    sx, sy = F.lit(float(width)) / c("source_width"), F.lit(float(height)) / c("source_height")
    both = F.least(sx, sy)
    factors = {"x": sx, "width": sx, "x1": sx, "x2": sx, "y": sy, "height": sy, "y1": sy, "y2": sy,
               "font_size_pt": both, "margin_px": both, "corner_radius": both, "stroke_width_px": both}
    gap = F.abs(F.try_divide(c("source_width"), c("source_height")) - F.lit(width / height))
    fitting = elements.filter(gap <= 0.02)
    return fitting.withColumns({n: c(n) * f for n, f in factors.items() if n in elements.columns})


def fit_to_box(paths: DataFrame, keys: list[str], width: float, height: float, padding: float,
               mode: str = "contain") -> DataFrame:
    """Place the paths of one figure (min_x, min_y, max_x, max_y) on a padded canvas.

    The figure's box is a combining aggregate joined back, so a figure with very many paths
    is never sorted in one task.
    """
    tiny, usable_w, usable_h = F.lit(1e-6), float(width - padding * 2), float(height - padding * 2)
    box = paths.groupBy(*keys).agg(F.min("min_x").alias("_fx"), F.min("min_y").alias("_fy"),
                                   F.max("max_x").alias("_gx"), F.max("max_y").alias("_gy"))
    kx = F.lit(usable_w) / F.greatest(c("_gx") - c("_fx"), tiny)
    ky = F.lit(usable_h) / F.greatest(c("_gy") - c("_fy"), tiny)
    both = F.least(kx, ky)
    box = box.withColumns({"_kx": both if mode == "contain" else kx, "_ky": both if mode == "contain" else ky})
    out = paths.join(box, keys)
    off_x = (F.lit(float(width)) - (c("_gx") - c("_fx")) * c("_kx")) / 2 - c("_fx") * c("_kx")
    off_y = (F.lit(float(height)) - (c("_gy") - c("_fy")) * c("_ky")) / 2 - c("_fy") * c("_ky")
    return out.withColumns({
        "x": c("min_x") * c("_kx") + off_x, "y": c("min_y") * c("_ky") + off_y,
        "width": F.greatest((c("max_x") - c("min_x")) * c("_kx"), F.lit(0.01)),
        "height": F.greatest((c("max_y") - c("min_y")) * c("_ky"), F.lit(0.01)),
        "stroke_scale": (c("_kx") + c("_ky")) / 2,
    }).drop("_fx", "_fy", "_gx", "_gy", "_kx", "_ky")


def unit_point(point: Column, low: Column, high: Column) -> Column:
    """Coordinate of a path command inside its path's box, 0 to 1."""
    return (point - low) / F.greatest(high - low, F.lit(1e-6))


def visual_role(kind: Column, x: Column, y: Column, w: Column, h: Column,
                slide_w: Column, slide_h: Column, is_master: Column | None = None) -> Column:
    """decorative, content or placeholder by area share and contact with the slide edge."""
    share = F.greatest(w * h, F.lit(0)) / F.greatest(slide_w * slide_h, F.lit(0.0001))
    near_x, near_y = F.greatest(F.lit(0.2), slide_w * 0.03), F.greatest(F.lit(0.2), slide_h * 0.04)
    edge = (x <= near_x) | (y <= near_y) | (x + w >= slide_w - near_x) | (y + h >= slide_h - near_y)

    def split(big: float, small: float) -> Column:
        return F.when(edge & ((share >= big) | (share <= small)), "decorative").otherwise("content")

    return (
        F.when(is_master if is_master is not None else F.lit(False), "decorative")
        .when(kind == "placeholder", "placeholder")
        .when(kind == "shape", split(0.18, 0.05))
        .when(kind == "image", split(0.5, 0.04))
        .otherwise("content")
    )


def size_class(width: Column, height: Column) -> Column:
    ratio = F.try_divide(width, height)
    valid = (width > 0) & (height > 0)
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "landscape")
        .when(ratio.between(0.88, 1.12), "square")
        .when(width >= height, "landscape").otherwise("portrait")
    )


def safe_margins(size: Column, width: Column, height: Column) -> dict[str, Column]:
    """Default top/right/bottom/left margins in inches for a size class."""
    base = vl.clamp(F.least(width, height) * 0.06, 0.3, 0.6)
    tall = F.when(size == "portrait", 0.08).otherwise(0.0)
    side = F.when(size == "portrait", -0.04).when(size == "landscape", 0.05).otherwise(0.0)
    return {"margin_top": F.round(base + tall, 4), "margin_right": F.round(base + side, 4),
            "margin_bottom": F.round(base + tall, 4), "margin_left": F.round(base + side, 4)}


def font_floor(runs: DataFrame, body: float = 8.0, source: float = 6.0,
               name="name", text="text", size="size_pt") -> DataFrame:
    """Text below the minimum size; source and note runs have the lower floor."""
    source_like = c(name).rlike(r"(?i)\b(source|sources|note|footnote|methodology)\b") | c(text).rlike(
        r"(?i)^\s*(source|sources|note)\s*:")
    out = runs.withColumns({"source_like": source_like})
    out = out.withColumn("minimum_pt", F.when(c("source_like"), F.lit(source)).otherwise(F.lit(body)))
    return out.filter(c(size) + 1e-6 < c("minimum_pt"))


def select_slides(slides: DataFrame, indices: Iterable[int] | None, key: str = "slide_index") -> DataFrame:
    """All slides, or the given 1-based ones. The list comes from the caller, at most a hundred."""
    if indices is None:
        return slides
    wanted = sorted({int(i) for i in indices})
    if not wanted or wanted[0] < 1:
        raise ValueError("slide indices are 1-based and must be positive")
    return slides.filter(c(key).isin(wanted))


def selection_out_of_range(decks: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected (deck, slide_index) rows beyond the deck's slide_count or below 1."""
    joined = selection.join(decks.select("deck_id", "slide_count"), "deck_id", "left")
    return joined.filter((c("slide_index") < 1) | c("slide_count").isNull()
                         | (c("slide_index") > c("slide_count"))).select(*selection.columns)


def raster_policy(images: DataFrame, policy: str, slide_area: Column, threshold: float = 0.72) -> DataFrame:
    """Rejected pictures with a reason. Columns: content_type, width, height.

    ``none`` rejects every picture, ``photos-only`` all but photos and textures; in every mode
    an illustration that covers ``threshold`` of the slide is a flattened slide.
    """
    share = c("width") * c("height") / slide_area
    by_policy = {"none": F.lit(True), "photos-only": ~c("content_type").isin("photo", "texture")}.get(
        policy, F.lit(False))
    full = (share >= threshold) & (c("content_type") == "raster_illustration")
    reasons = F.array_compact(F.array(F.when(by_policy, F.lit(f"policy_{policy}")),
                                      F.when(full, F.lit("full_slide_illustration"))))
    return images.select("*", F.explode(reasons).alias("reason"))


def anchored_transform(shapes: DataFrame, layouts: DataFrame, target_w: float, target_h: float,
                       min_font: float = 12.0) -> DataFrame:
    """Uniform scale and centring from each row's ``layout_id`` page to the target page.

    The layouts table is joined without a hint: with a handful of presets the planner
    broadcasts it, with a big custom table it does not.
    """
    size = layouts.select("layout_id", c("width").alias("_pw"), c("height").alias("_ph"))
    scaled = shapes.join(size, "layout_id").withColumn(
        "scale", F.least(F.lit(target_w) / c("_pw"), F.lit(target_h) / c("_ph")))
    off_x, off_y = (F.lit(target_w) - c("_pw") * c("scale")) / 2, (F.lit(target_h) - c("_ph") * c("scale")) / 2
    font = F.coalesce(c("font_size_pt").cast("double"), F.lit(14.0))
    readable = F.greatest(F.lit(min_font), F.least(F.greatest(font, F.lit(min_font)), font * c("scale")))
    return scaled.select(
        *[c(n) for n in shapes.columns if n not in ("x", "y", "w", "h", "font_size_pt")],
        "scale",
        vl.round_up(c("x") * c("scale") + off_x, 4).alias("x"), vl.round_up(c("y") * c("scale") + off_y, 4).alias("y"),
        vl.round_up(c("w") * c("scale"), 4).alias("w"), vl.round_up(c("h") * c("scale"), 4).alias("h"),
        F.when(c("type").isin(FLOW_TYPES), vl.round_up(readable, 4)).otherwise(c("font_size_pt").cast("double"))
        .alias("font_size_pt"),
    )


def low_priority(slide_area: float) -> Column:
    """Short or tiny text, or a tiny image."""
    share = F.greatest(F.lit(0.0), c("w") * c("h")) / F.lit(slide_area)
    short = F.length(F.regexp_replace(F.coalesce(c("text"), F.lit("")), r"\s+", "")) <= 3
    return (F.when(c("type").isin("text", "table-text"), short | (share < 0.02))
            .when(c("type") == "image", share < 0.03).otherwise(False))


def page_assign(shapes: DataFrame, page_w: float, page_h: float, allow_split: bool = True,
                allow_deletion: bool = False, slide_key: str = "slide_id") -> DataFrame:
    """Output page of every element of a slide, in closed form.

    Adds ``page`` (0-based, empty pages closed up; null when dropped), the new y and h, and
    ``action`` = none, resize, split, clamp or drop. An element that overflows the first
    page moves down by whole usable heights until it fits.
    """
    top, bottom = F.lit(0.1), F.lit(page_h - 0.1)
    usable, most = F.lit((page_h - 0.1) - 0.1), page_h - 0.2
    tall = c("h") > most
    droppable = low_priority(page_w * page_h) if allow_deletion else F.lit(False)
    step = shapes.withColumns({"_tall": tall, "_low": droppable})
    step = step.withColumns({
        "h": F.when(c("_tall"), vl.round_up(F.lit(most), 4)).otherwise(c("h").cast("double")),
        "y": F.when(c("_tall"), top).otherwise(F.greatest(top, c("y").cast("double"))),
    })
    over = c("y") + c("h") > bottom
    first = F.greatest(F.lit(1), F.floor((c("y") - top) / usable))
    need = F.ceil((c("y") + c("h") - bottom) / usable)
    # The division may land one page high where the sum is exactly at the limit.
    need = F.when(c("y") - (need - 1) * usable + c("h") <= bottom, need - 1).otherwise(need)
    page = F.greatest(first, need)
    gone = c("_low") & (c("_tall") | (over & F.lit(not allow_split)))
    step = step.withColumns({"_over": over, "_gone": gone})
    step = step.withColumn("_page", F.when(c("_gone"), F.lit(None)).when(
        c("_over") & F.lit(allow_split), page).otherwise(F.lit(0)).cast("bigint"))
    moved = (F.greatest(top, F.least(bottom - c("h"), c("y") - c("_page") * usable)) if allow_split
             else F.greatest(top, bottom - c("h")))
    action = (F.when(c("_gone"), "drop")
              .when(c("_over"), "split" if allow_split else "clamp")
              .when(c("_tall"), "resize").otherwise("none"))
    step = step.withColumns({"action": action, "resized": c("_tall") & ~c("_gone"),
                             "y": F.when(c("_over") & ~c("_gone"), vl.round_up(moved, 4)).otherwise(c("y"))})
    # The numbering below sees each page once, however many shapes there are.
    pages = step.filter(c("_page").isNotNull()).select(slide_key, "_page").distinct()
    numbered = pages.withColumn("page", (F.row_number().over(
        Window.partitionBy(slide_key).orderBy("_page")) - 1).cast("bigint"))
    return step.join(numbered, [slide_key, "_page"], "left").drop("_page", "_over", "_tall", "_low", "_gone")


def paint_order(elements: DataFrame, slide_key: str = "slide_id") -> DataFrame:
    """Back-to-front order: layer, then y, then x. A range sort, so one huge slide still spreads."""
    return elements.orderBy(slide_key, F.coalesce(c("layer"), F.lit(0)), "y", "x")
