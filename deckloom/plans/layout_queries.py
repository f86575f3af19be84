"""Queries for layout rules and shape aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deckloom.functions import values as vl
from deckloom.operators import layout as lay
from deckloom.operators import shapes as sh
from deckloom.plans.registry import query

c = F.col

FRAME = "CASE WHEN kind = 'graphicFrame' THEN CASE WHEN shape_id % 2 = 0 THEN 'chart' ELSE 'table' END END"


def framed(t):
    """Shapes with the type of their graphic frame."""
    return t.fx_shape.withColumn("frame_type", F.expr(FRAME))


FEATURES_CTE = f"""framed AS (SELECT *, {FRAME} AS frame_type FROM fx_shape),
feat AS (SELECT deck_id, slide_id, count(*) FILTER (kind = 'sp') AS shape_count, count(*) FILTER (kind = 'pic') AS picture_count,
 count(*) FILTER (kind = 'grpSp') AS group_count, count(*) FILTER (text <> '') AS text_count,
 count(*) FILTER (frame_type = 'table') AS table_count, count(*) FILTER (frame_type = 'chart') AS chart_count,
 round(avg(w_pt), 3) AS mean_width_pt, round(avg(h_pt), 3) AS mean_height_pt FROM framed GROUP BY deck_id, slide_id),
arch AS (SELECT *, CASE WHEN chart_count > 0 THEN 'chart' WHEN table_count > 0 THEN 'table' WHEN picture_count >= 2 THEN 'visual'
 WHEN text_count <= 2 AND shape_count <= 4 THEN 'title' WHEN text_count >= 8 THEN 'dense_content'
 WHEN shape_count >= 12 THEN 'process' ELSE 'content' END AS archetype FROM feat)"""


@query("ag01_slide_features", "fx_shape", FEATURES_CTE, "SELECT * FROM feat")
def ag01(t):
    return sh.slide_features(framed(t), ["deck_id", "slide_id"])


@query("prj07_archetype", "fx_shape", FEATURES_CTE, "SELECT deck_id, slide_id, archetype FROM arch")
def prj07(t):
    return sh.with_archetype(sh.slide_features(framed(t), ["deck_id", "slide_id"])).select(
        "deck_id", "slide_id", "archetype")


@query("ag02_dominant_colors", "fx_shape", """cnt AS (SELECT deck_id, fill_color AS color, count(*) AS uses FROM fx_shape GROUP BY ALL)""", """
SELECT deck_id, color, uses, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY uses DESC, color) AS INTEGER) AS color_rank
FROM cnt QUALIFY color_rank <= 6""")
def ag02(t):
    return sh.dominant_colors(t.fx_shape, ["deck_id"])


@query("se11_style_jaccard", "fx_shape", """s AS (SELECT deck_id, list(DISTINCT fill_color) AS a FROM fx_shape WHERE kind = 'sp' GROUP BY 1),
p AS (SELECT deck_id, list(DISTINCT fill_color) AS b FROM fx_shape WHERE kind = 'pic' AND font_pt > 20 GROUP BY 1)""", """
SELECT deck_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS overlap
FROM s JOIN p USING (deck_id)""")
def se11(t):
    # A deck's distinct fill colours are few (a brand list), so the sets stay small.
    a = t.fx_shape.filter("kind = 'sp'").groupBy("deck_id").agg(F.collect_set("fill_color").alias("a"))
    b = t.fx_shape.filter("kind = 'pic' AND font_pt > 20").groupBy("deck_id").agg(
        F.collect_set("fill_color").alias("b"))
    return a.join(b, "deck_id").select("deck_id", F.round(vl.style_jaccard(c("a"), c("b")), 6).alias("overlap"))


def elements(t):
    """Shapes as slide-graph elements, with values that break the row rules now and then."""
    return t.fx_shape.select(
        "slide_id", "shape_id", c("x_pt").alias("x"), c("y_pt").alias("y"), (c("w_pt") - 60).alias("width"),
        c("h_pt").alias("height"), (c("font_pt") / 20).alias("opacity"), (c("font_pt") - 6).alias("font_size_pt"),
        F.struct(
            F.when(c("kind") == "pic", "linear_gradient").otherwise("solid").alias("kind"),
            F.when(c("text") != "", F.lit("#1F4E79")).alias("color"), F.lit(1.0).alias("opacity"),
            F.when(c("rot_deg") != 0, c("rot_deg").cast("double")).alias("angle_deg"),
            F.when(c("kind") == "pic", F.slice(F.array(
                F.struct(F.lit(0.0).alias("position"), F.lit("#fff").alias("color"), F.lit(1.0).alias("opacity")),
                F.struct((c("h_pt") / 150).alias("position"), F.lit("000").alias("color"), F.lit(1.0).alias("opacity"))),
                F.lit(1), F.when(c("shape_id") == 1, 1).otherwise(2))).alias("stops"),
        ).alias("fill"),
        F.struct(F.lit("#000000").alias("color"), F.lit(1.0).alias("opacity"),
                 (c("font_pt") - 7).alias("width_px")).alias("stroke"))


@query("prj01_constraint_violations", "fx_shape", "", """
SELECT slide_id, shape_id, unnest(list_filter([
 CASE WHEN w_pt - 60 <= 0 THEN 'size_not_positive' END,
 CASE WHEN font_pt / 20.0 > 1 THEN 'opacity_out_of_range' END,
 CASE WHEN kind <> 'pic' AND text = '' THEN 'solid_without_color' END,
 CASE WHEN kind = 'pic' AND shape_id = 1 THEN 'gradient_too_few_stops' END,
 CASE WHEN kind = 'pic' AND rot_deg = 0 THEN 'gradient_without_angle' END,
 CASE WHEN kind = 'pic' AND shape_id <> 1 AND h_pt > 150 THEN 'stop_out_of_range' END,
 CASE WHEN font_pt < 7 THEN 'stroke_width_negative' END,
 CASE WHEN font_pt <= 6 THEN 'font_size_not_positive' END], lambda r: r IS NOT NULL)) AS rule FROM fx_shape""")
def prj01(t):
    return lay.constraint_violations(elements(t), ["slide_id", "shape_id"])


CLAMP_CTE = """a AS (SELECT *, CAST(greatest(0, x_pt) AS DOUBLE) AS l, CAST(greatest(0, y_pt) AS DOUBLE) AS t,
 CAST(least(960, x_pt + w_pt) AS DOUBLE) AS r, CAST(least(540, y_pt + h_pt) AS DOUBLE) AS b FROM fx_shape),
k AS (SELECT *, r - l AS w, b - t AS h, abs(cos(radians(rot_deg))) AS co, abs(sin(radians(rot_deg))) AS si FROM a),
g AS (SELECT *, w * co + h * si AS rw, w * si + h * co AS rh, l + w / 2 AS cx, t + h / 2 AS cy FROM k),
f AS (SELECT *, CASE WHEN rot_deg <> 0 THEN least(1.0::DOUBLE, 960 / rw, 540 / rh) ELSE 1.0::DOUBLE END AS fit FROM g),
m AS (SELECT *, w * fit AS fw, h * fit AS fh, cx - rw * fit / 2 AS el, cx + rw * fit / 2 AS er, cy - rh * fit / 2 AS et, cy + rh * fit / 2 AS eb FROM f),
n AS (SELECT *, CASE WHEN rot_deg = 0 THEN 0.0 WHEN el < 0 THEN -el ELSE least(0.0, 960 - er) END AS dx,
 CASE WHEN rot_deg = 0 THEN 0.0 WHEN et < 0 THEN -et ELSE least(0.0, 540 - eb) END AS dy FROM m),
z AS (SELECT *, CASE WHEN r <= l OR b <= t THEN 'dropped' WHEN l <> x_pt OR t <> y_pt OR w <> w_pt OR h <> h_pt OR fit < 1 OR dx <> 0 OR dy <> 0 THEN 'changed' ELSE 'kept' END AS clamp FROM n)"""


@query("prj03_clamp_to_canvas", "fx_shape", CLAMP_CTE, """
SELECT slide_id, shape_id, clamp, CASE WHEN clamp <> 'dropped' THEN round(CASE WHEN fit < 1 THEN cx - fw / 2 ELSE l END + dx, 6) END AS x,
 CASE WHEN clamp <> 'dropped' THEN round(CASE WHEN fit < 1 THEN cy - fh / 2 ELSE t END + dy, 6) END AS y,
 CASE WHEN clamp <> 'dropped' THEN round(fw, 6) END AS width, CASE WHEN clamp <> 'dropped' THEN round(fh, 6) END AS height,
 CASE WHEN clamp <> 'dropped' AND kind = 'pic' AND w <> w_pt THEN round(w / w_pt * 100, 6) WHEN clamp <> 'dropped' THEN 100.0::DOUBLE END AS source_width FROM z""")
def prj03(t):
    source = t.fx_shape.select(
        "slide_id", "shape_id", F.when(c("kind") == "pic", "image").otherwise("shape").alias("kind"),
        c("x_pt").alias("x"), c("y_pt").alias("y"), c("w_pt").alias("width"), c("h_pt").alias("height"),
        c("rot_deg").alias("rotation_deg"), F.lit(0.0).alias("source_x"), F.lit(0.0).alias("source_y"),
        F.lit(100.0).alias("source_width"), F.lit(100.0).alias("source_height"))
    out = lay.clamp_to_canvas(source, 960, 540, keep_dropped=True)
    kept = c("clamp") != "dropped"
    return out.select("slide_id", "shape_id", "clamp", *[
        F.when(kept, F.round(n, 6)).alias(n) for n in ("x", "y", "width", "height", "source_width")])


@query("prj04_canvas_overflow", "fx_shape", """e AS (SELECT *, CASE WHEN rot_deg = 0 THEN CAST(w_pt AS DOUBLE) ELSE w_pt * abs(cos(radians(rot_deg))) + h_pt * abs(sin(radians(rot_deg))) END AS ew,
 CASE WHEN rot_deg = 0 THEN CAST(h_pt AS DOUBLE) ELSE w_pt * abs(sin(radians(rot_deg))) + h_pt * abs(cos(radians(rot_deg))) END AS eh FROM fx_shape),
b AS (SELECT *, x_pt + w_pt / 2.0::DOUBLE - ew / 2 AS l, y_pt + h_pt / 2.0::DOUBLE - eh / 2 AS t FROM e)""", """
SELECT slide_id, shape_id, name, round(l, 4) AS extent_x, round(t, 4) AS extent_y, round(ew, 4) AS extent_w, round(eh, 4) AS extent_h FROM b
WHERE NOT (l >= -1000.0::DOUBLE / 12700 AND t >= -1000.0::DOUBLE / 12700 AND l + ew <= 960 + 1000.0::DOUBLE / 12700 AND t + eh <= 540 + 1000.0::DOUBLE / 12700)""")
def prj04(t):
    out = lay.canvas_overflow(t.fx_shape, 960.0, 540.0, lay.OVERFLOW_TOLERANCE_EMU / vl.EMU_PER_POINT,
                              "x_pt", "y_pt", "w_pt", "h_pt", "rot_deg")
    return out.select("slide_id", "shape_id", "name", *[
        F.round(n, 4).alias(n) for n in ("extent_x", "extent_y", "extent_w", "extent_h")])


def sized(t):
    other = c("deck_id") % 10 == 0
    return t.fx_shape.select(
        "deck_id", "slide_id", "shape_id", *[c(a).cast("double").alias(b) for a, b in (
            ("x_pt", "x"), ("y_pt", "y"), ("w_pt", "width"), ("h_pt", "height"), ("font_pt", "font_size_pt"))],
        F.when(other, 800.0).otherwise(960.0).alias("source_width"),
        F.when(other, 600.0).otherwise(540.0).alias("source_height"))


@query("prj05_scale_to_canvas", "fx_shape", "", """
SELECT slide_id, shape_id, round(x_pt * (1280 / 960.0::DOUBLE), 6) AS x, round(y_pt * (720 / 540.0::DOUBLE), 6) AS y,
 round(w_pt * (1280 / 960.0::DOUBLE), 6) AS width, round(font_pt * (720 / 540.0::DOUBLE), 6) AS font_size_pt
FROM fx_shape WHERE deck_id % 10 <> 0""")
def prj05(t):
    return lay.scale_to_canvas(sized(t), 1280, 720).select(
        "slide_id", "shape_id", *[F.round(n, 6).alias(n) for n in ("x", "y", "width", "font_size_pt")])


@query("prj05_aspect_violations", "fx_shape", "", """
SELECT DISTINCT deck_id, slide_id, 800.0::DOUBLE AS source_width, 600.0::DOUBLE AS source_height FROM fx_shape WHERE deck_id % 10 = 0""")
def prj05b(t):
    slides = sized(t).select("deck_id", "slide_id", "source_width", "source_height").distinct()
    return lay.aspect_violations(slides, 1280, 720)


@query("prj06_fit_to_box", "fx_shape", """bb AS (SELECT slide_id, min(x_pt) AS fx, min(y_pt) AS fy, max(x_pt + w_pt) AS gx, max(y_pt + h_pt) AS gy FROM fx_shape GROUP BY 1),
sc AS (SELECT *, least(1200.0::DOUBLE / (gx - fx), 640.0::DOUBLE / (gy - fy)) AS k FROM bb)""", """
SELECT slide_id, shape_id, round(x_pt * k + ((1280.0::DOUBLE - (gx - fx) * k) / 2 - fx * k), 4) AS x,
 round(y_pt * k + ((720.0::DOUBLE - (gy - fy) * k) / 2 - fy * k), 4) AS y, round(w_pt * k, 4) AS width, round(h_pt * k, 4) AS height
FROM fx_shape JOIN sc USING (slide_id)""")
def prj06(t):
    paths = t.fx_shape.select("slide_id", "shape_id", c("x_pt").alias("min_x"), c("y_pt").alias("min_y"),
                              (c("x_pt") + c("w_pt")).alias("max_x"), (c("y_pt") + c("h_pt")).alias("max_y"))
    return lay.fit_to_box(paths, ["slide_id"], 1280, 720, 40).select(
        "slide_id", "shape_id", *[F.round(n, 4).alias(n) for n in ("x", "y", "width", "height")])


@query("prj08_visual_role", "fx_shape", """r AS (SELECT *, w_pt * h_pt / (960 * 540.0::DOUBLE) AS share,
 x_pt <= 960 * 0.03::DOUBLE OR y_pt <= 540 * 0.04::DOUBLE OR x_pt + w_pt >= 960 - 960 * 0.03::DOUBLE OR y_pt + h_pt >= 540 - 540 * 0.04::DOUBLE AS edge FROM fx_shape)""", """
SELECT slide_id, shape_id, x_pt, CASE WHEN kind = 'graphicFrame' THEN 'placeholder' WHEN kind = 'pic' AND edge AND (share >= 0.5 OR share <= 0.04) THEN 'decorative'
 WHEN kind = 'sp' AND edge AND (share >= 0.18 OR share <= 0.05) THEN 'decorative' ELSE 'content' END AS role FROM r""")
def prj08(t):
    kind = (F.when(c("kind") == "pic", "image").when(c("kind") == "sp", "shape").otherwise("placeholder"))
    role = lay.visual_role(kind, c("x_pt"), c("y_pt"), c("w_pt"), c("h_pt"), F.lit(960), F.lit(540))
    return t.fx_shape.select("slide_id", "shape_id", "x_pt", role.alias("role"))


@query("prj09_size_class", "fx_shape", """s AS (SELECT slide_id, max(w_pt) / 40.0::DOUBLE AS w, max(h_pt) / 15.0::DOUBLE AS h FROM fx_shape GROUP BY 1),
k AS (SELECT *, CASE WHEN w / h BETWEEN 0.88 AND 1.12 THEN 'square' WHEN w >= h THEN 'landscape' ELSE 'portrait' END AS size_class,
 greatest(0.3::DOUBLE, least(0.6::DOUBLE, least(w, h) * 0.06::DOUBLE)) AS base FROM s)""", """
SELECT slide_id, size_class, round(base + CASE size_class WHEN 'portrait' THEN 0.08::DOUBLE ELSE 0 END, 4) AS margin_top,
 round(base + CASE size_class WHEN 'portrait' THEN -0.04::DOUBLE WHEN 'landscape' THEN 0.05::DOUBLE ELSE 0 END, 4) AS margin_left FROM k""")
def prj09(t):
    s = t.fx_shape.groupBy("slide_id").agg((F.max("w_pt") / 40).alias("w"), (F.max("h_pt") / 15).alias("h"))
    s = s.withColumn("size_class", lay.size_class(c("w"), c("h")))
    m = lay.safe_margins(c("size_class"), c("w"), c("h"))
    return s.select("slide_id", "size_class", m["margin_top"].alias("margin_top"), m["margin_left"].alias("margin_left"))


@query("prj10_font_floor", "fx_shape", "n AS (SELECT *, CASE WHEN shape_id = 2 THEN 'Source: ' || text ELSE text END AS body FROM fx_shape)", r"""
SELECT slide_id, shape_id, font_pt, shape_id = 2 AS source_like, CASE WHEN shape_id = 2 THEN 6.0::DOUBLE ELSE 8.0::DOUBLE END AS minimum_pt
FROM n WHERE font_pt + 0.000001 < CASE WHEN shape_id = 2 THEN 6 ELSE 8 END""")
def prj10(t):
    runs = t.fx_shape.withColumn("body", F.when(c("shape_id") == 2, F.concat(F.lit("Source: "), "text"))
                                 .otherwise(c("text")))
    return lay.font_floor(runs, name="name", text="body", size="font_pt").select(
        "slide_id", "shape_id", "font_pt", "source_like", "minimum_pt")


@query("prj13_select_slides", "fx_shape", """pick AS (SELECT DISTINCT deck_id, slide_id % 7 AS slide_index FROM fx_shape),
n AS (SELECT deck_id, count(DISTINCT shape_id) AS slide_count FROM fx_shape GROUP BY 1)""", """
SELECT p.deck_id, p.slide_index FROM pick p LEFT JOIN n USING (deck_id)
WHERE p.slide_index < 1 OR n.slide_count IS NULL OR p.slide_index > n.slide_count""")
def prj13(t):
    picks = t.fx_shape.select("deck_id", (c("slide_id") % 7).alias("slide_index")).distinct()
    decks = t.fx_shape.groupBy("deck_id").agg(F.countDistinct("shape_id").alias("slide_count"))
    return lay.selection_out_of_range(decks, picks)


@query("prj13_selected_slides", "fx_shape", "n AS (SELECT deck_id, slide_id, dense_rank() OVER (PARTITION BY deck_id ORDER BY slide_id) AS slide_index FROM (SELECT DISTINCT deck_id, slide_id FROM fx_shape))", """
SELECT deck_id, slide_id, CAST(slide_index AS INTEGER) AS slide_index FROM n WHERE slide_index IN (1, 3, 8)""")
def prj13_selected(t):
    order = Window.partitionBy("deck_id").orderBy("slide_id")
    slides = t.fx_shape.select("deck_id", "slide_id").distinct().withColumn("slide_index", F.row_number().over(order))
    return lay.select_slides(slides, [3, 1, 8, 3])


@query("prj14_raster_policy", "fx_shape", "p AS (SELECT *, CASE font_pt % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'texture' ELSE 'raster_illustration' END AS ct FROM fx_shape WHERE kind = 'pic')", """
SELECT slide_id, shape_id, unnest(list_filter(['policy_photos-only', CASE WHEN w_pt * h_pt / (300 * 200.0::DOUBLE) >= 0.72 THEN 'full_slide_illustration' END], lambda r: r IS NOT NULL)) AS reason
FROM p WHERE ct = 'raster_illustration'""")
def prj14(t):
    kinds = (F.when(c("font_pt") % 3 == 0, "photo").when(c("font_pt") % 3 == 1, "texture")
             .otherwise("raster_illustration"))
    images = t.fx_shape.filter("kind = 'pic'").select(
        "slide_id", "shape_id", kinds.alias("content_type"), c("w_pt").alias("width"), c("h_pt").alias("height"))
    return lay.raster_policy(images, "photos-only", F.lit(300 * 200)).select("slide_id", "shape_id", "reason")


def typed(t):
    """Shapes in inches with the legacy type names and a page preset per deck."""
    kind = F.when(c("kind") == "pic", "image").when(c("kind") == "sp", "text").otherwise("shape")
    page = F.when(c("deck_id") % 3 == 0, "wide").when(c("deck_id") % 3 == 1, "standard").otherwise("a4")
    return t.fx_shape.select(
        "deck_id", "slide_id", "shape_id", kind.alias("type"), "text", page.alias("layout_id"),
        (c("x_pt") / 72).alias("x"), (c("y_pt") / 72).alias("y"), (c("w_pt") / 72).alias("w"),
        (c("h_pt") / 72).alias("h"), c("font_pt").alias("font_size_pt"))


PAGES_CTE = """pg AS (SELECT * FROM (VALUES ('wide', 13.333::DOUBLE, 7.5::DOUBLE), ('standard', 10.0::DOUBLE, 7.5::DOUBLE), ('a4', 11.693::DOUBLE, 8.268::DOUBLE)) v(layout_id, pw, ph)),
ty AS (SELECT deck_id, slide_id, shape_id, CASE kind WHEN 'pic' THEN 'image' WHEN 'sp' THEN 'text' ELSE 'shape' END AS type, text,
 CASE deck_id % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'standard' ELSE 'a4' END AS layout_id, x_pt / 72.0::DOUBLE AS x, y_pt / 72.0::DOUBLE AS y,
 w_pt / 72.0::DOUBLE AS w, h_pt / 72.0::DOUBLE AS h, CAST(font_pt AS DOUBLE) AS f FROM fx_shape),
sc AS (SELECT *, least(8.268::DOUBLE / pw, 11.693::DOUBLE / ph) AS k FROM ty JOIN pg USING (layout_id))"""


@query("prj19_anchored_transform", "fx_shape", PAGES_CTE, """
SELECT slide_id, shape_id, floor((x * k + (8.268::DOUBLE - pw * k) / 2) * 10000 + 0.5::DOUBLE) / 10000 AS x,
 floor((y * k + (11.693::DOUBLE - ph * k) / 2) * 10000 + 0.5::DOUBLE) / 10000 AS y, floor(w * k * 10000 + 0.5::DOUBLE) / 10000 AS w,
 CASE WHEN type = 'text' THEN floor(greatest(12.0::DOUBLE, least(greatest(f, 12.0::DOUBLE), f * k)) * 10000 + 0.5::DOUBLE) / 10000 ELSE f END AS font_size_pt FROM sc""")
def prj19(t):
    return lay.anchored_transform(typed(t), lay.page_sizes(t.spark), 8.268, 11.693).select(
        "slide_id", "shape_id", "x", "y", "w", "font_size_pt")


PAGE_CTE = """ty AS (SELECT slide_id, shape_id, x_pt / 72.0::DOUBLE AS x, y_pt / 36.0::DOUBLE AS y0, w_pt / 72.0::DOUBLE AS w, h_pt / 22.0::DOUBLE AS h0 FROM fx_shape),
a AS (SELECT *, h0 > 7.3::DOUBLE AS tall, CASE WHEN h0 > 7.3::DOUBLE THEN 7.3::DOUBLE ELSE h0 END AS h,
 CASE WHEN h0 > 7.3::DOUBLE THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, y0) END AS y FROM ty),
b AS (SELECT *, y + h > 7.4::DOUBLE AS over, ceil((y + h - 7.4::DOUBLE) / (7.4::DOUBLE - 0.1::DOUBLE)) AS need,
 greatest(1, floor((y - 0.1::DOUBLE) / (7.4::DOUBLE - 0.1::DOUBLE))) AS frst FROM a),
d AS (SELECT *, CASE WHEN NOT over THEN 0 ELSE greatest(frst, CASE WHEN y - (need - 1) * (7.4::DOUBLE - 0.1::DOUBLE) + h <= 7.4::DOUBLE THEN need - 1 ELSE need END) END AS p FROM b)"""


@query("prj20_page_assign", "fx_shape", PAGE_CTE, """
SELECT slide_id, shape_id, CAST(dense_rank() OVER (PARTITION BY slide_id ORDER BY p) - 1 AS BIGINT) AS page,
 CASE WHEN over THEN 'split' WHEN tall THEN 'resize' ELSE 'none' END AS action,
 CASE WHEN over THEN floor(greatest(0.1::DOUBLE, least(7.4::DOUBLE - h, y - p * (7.4::DOUBLE - 0.1::DOUBLE))) * 10000 + 0.5::DOUBLE) / 10000 ELSE y END AS y, h FROM d""")
def prj20(t):
    items = t.fx_shape.select("slide_id", "shape_id", F.lit("shape").alias("type"), "text", (c("x_pt") / 72).alias("x"),
                              (c("y_pt") / 36).alias("y"), (c("w_pt") / 72).alias("w"), (c("h_pt") / 22).alias("h"))
    return lay.page_assign(items, 13.333, 7.5).select("slide_id", "shape_id", "page", "action", "y", "h")


@query("so02_paint_order", "fx_shape", "", """
SELECT slide_id, rot_deg AS layer, y_pt AS y, x_pt AS x, shape_id FROM fx_shape ORDER BY 1, 2, 3, 4""")
def so02(t):
    return lay.paint_order(t.fx_shape.select(
        "slide_id", c("rot_deg").alias("layer"), c("y_pt").alias("y"), c("x_pt").alias("x"), "shape_id"))


@query("ag06_duplicate_ids", "fx_shape", "", """
SELECT slide_id, shape_id, count(*) AS uses FROM fx_shape GROUP BY 1, 2 HAVING count(*) > 1""")
def ag06(t):
    return sh.duplicate_ids(t.fx_shape, ["slide_id"], "shape_id")


@query("ag08_object_counts", "fx_shape fx_component_primitive", """e AS (SELECT slide_id, CASE kind WHEN 'pic' THEN 'component' WHEN 'sp' THEN 'shape' ELSE 'text' END AS kind, font_pt % 12 AS component_id FROM fx_shape),
n AS (SELECT component_id, count(*) AS size FROM fx_component_primitive GROUP BY 1)""", """
SELECT slide_id, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'shape') AS shape, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS path,
 CAST(0 AS BIGINT) AS image, count(*) FILTER (kind = 'component') AS component, CAST(coalesce(sum(size) FILTER (kind = 'component'), 0) AS BIGINT) AS expanded_component_objects
FROM e LEFT JOIN n USING (component_id) GROUP BY 1""")
def ag08(t):
    kind = F.when(c("kind") == "pic", "component").when(c("kind") == "sp", "shape").otherwise("text")
    els = t.fx_shape.select("slide_id", kind.alias("kind"), (c("font_pt") % 12).alias("component_id"))
    return sh.object_counts(els, t.fx_component_primitive, ["slide_id"])


@query("ag34_group_bounds", "fx_shape", "", """
SELECT slide_id, rot_deg AS group_id, min(x_pt) AS x_pt, min(y_pt) AS y_pt, max(x_pt + w_pt) - min(x_pt) AS w_pt, max(y_pt + h_pt) - min(y_pt) AS h_pt,
 min(shape_id) AS insert_at, count(*) AS members FROM fx_shape GROUP BY 1, 2""")
def ag34(t):
    shapes = t.fx_shape.select("slide_id", "shape_id", "x_pt", "y_pt", "w_pt", "h_pt", c("shape_id").alias("z"))
    members = t.fx_shape.select("slide_id", "shape_id", c("rot_deg").alias("group_id")).distinct()
    return sh.group_bounds(shapes, members, ["slide_id"])


@query("ag36_text_manifest", "fx_shape_key", "", """
SELECT deck_id, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY slide_id * 100 + shape_id) AS BIGINT) AS position, text
FROM fx_shape_key WHERE text <> ''""")
def ag36(t):
    ordered = t.fx_shape_key.withColumn("ord", c("slide_id") * 100 + c("shape_id"))
    return sh.text_manifest(ordered, ["deck_id"], "ord")


BOX_CTE = """bx AS (SELECT slide_id, x_pt AS x, y_pt AS y, w_pt AS w, h_pt AS h, min(shape_id) AS id, count(*) AS copies FROM fx_shape GROUP BY ALL),
pr AS (SELECT a.slide_id, a.x AS a_x, a.y AS a_y, a.w AS a_w, a.h AS a_h, b.x AS b_x, b.y AS b_y, b.w AS b_w, b.h AS b_h, a.id AS a_id, b.id AS b_id, a.copies AS a_copies, b.copies AS b_copies,
 greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS overlap_area
 FROM bx a JOIN bx b ON a.slide_id = b.slide_id AND ((a.x, a.y, a.w, a.h) < (b.x, b.y, b.w, b.h) OR ((a.x, a.y, a.w, a.h) = (b.x, b.y, b.w, b.h) AND a.copies > 1)))"""


@query("jn12_overlapping_shapes", "fx_shape", BOX_CTE, """
SELECT slide_id, a_id, b_id, a_copies, b_copies, overlap_area, round(CAST(overlap_area AS DOUBLE) / least(a_w * a_h, b_w * b_h), 6) AS overlap_ratio
FROM pr WHERE overlap_area > 0.001""")
def jn12(t):
    return sh.overlapping_shapes(t.fx_shape, None, ["slide_id"], min_area=0.001).select(
        "slide_id", "a_id", "b_id", "a_copies", "b_copies", "overlap_area",
        F.round("overlap_ratio", 6).alias("overlap_ratio"))


@query("wn13_suppress_covered", "fx_shape", BOX_CTE + """,
rb AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY w * h DESC, x, y, w, h) AS rn FROM bx),
gr AS (SELECT slide_id, rn, TRUE AS stays, [{'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM rb WHERE rn = 1
 UNION ALL SELECT slide_id, rn, stays, CASE WHEN stays THEN list_append(kept, {'x': x, 'y': y, 'w': w, 'h': h}) ELSE kept END
 FROM (SELECT rb.slide_id, rb.rn, rb.x, rb.y, rb.w, rb.h, gr.kept, len(list_filter(gr.kept, lambda k: CAST(greatest(0, least(k.x + k.w, rb.x + rb.w) - greatest(k.x, rb.x))
   * greatest(0, least(k.y + k.h, rb.y + rb.h) - greatest(k.y, rb.y)) AS DOUBLE) / (rb.w * rb.h) >= 0.75)) = 0 AS stays FROM gr JOIN rb ON rb.slide_id = gr.slide_id AND rb.rn = gr.rn + 1))""", """
SELECT slide_id, shape_id, x_pt, y_pt, w_pt, h_pt, id AS box_id FROM fx_shape
JOIN (SELECT rb.* FROM rb JOIN gr USING (slide_id, rn) WHERE stays) k USING (slide_id) WHERE x = x_pt AND y = y_pt AND w = w_pt AND h = h_pt""")
def wn13(t):
    return sh.suppress_covered(t.fx_shape, ["slide_id"])


@query("jn12_box_members", "fx_shape", "", """
SELECT slide_id, shape_id, x_pt, y_pt, w_pt, h_pt, min(shape_id) OVER (PARTITION BY slide_id, x_pt, y_pt, w_pt, h_pt) AS box_id FROM fx_shape""")
def jn12b(t):
    return sh.box_members(t.fx_shape, ["slide_id"])


def risk_counts(t):
    """Per-slide counts behind the conversion scores."""
    s = t.fx_shape
    return s.groupBy("deck_id", "slide_id").agg(
        F.when(c("deck_id") % 3 == 0, 0.62).when(c("deck_id") % 3 == 1, 0.75).otherwise(1.0).alias("scale"),
        F.count_if((c("kind") == "sp") & (c("font_pt") < 8)).alias("low_fonts"),
        F.count_if(c("y_pt") + c("h_pt") > 740).alias("splits"),
        F.count_if((c("kind") == "sp") & (c("x_pt") < 60)).alias("overlap_fixes"),
        F.count_if(c("font_pt") == 24).alias("unsupported"), F.count_if(c("font_pt") == 23).alias("placeholders"),
        F.count_if(c("kind") == "pic").alias("source_visuals"),
        F.count_if((c("kind") == "pic") & (c("font_pt") > 9)).alias("kept_visuals"),
        F.count_if(c("font_pt") == 22).alias("dropped"), F.count_if(c("h_pt") > 168).alias("resizes"))


RISK_CTE = """rc AS (SELECT deck_id, slide_id, CASE deck_id % 3 WHEN 0 THEN 0.62::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS scale,
 count(*) FILTER (kind = 'sp' AND font_pt < 8) AS low_fonts, count(*) FILTER (y_pt + h_pt > 740) AS splits, count(*) FILTER (kind = 'sp' AND x_pt < 60) AS overlap_fixes,
 count(*) FILTER (font_pt = 24) AS unsupported, count(*) FILTER (font_pt = 23) AS placeholders, count(*) FILTER (kind = 'pic') AS source_visuals,
 count(*) FILTER (kind = 'pic' AND font_pt > 9) AS kept_visuals, count(*) FILTER (font_pt = 22) AS dropped, count(*) FILTER (h_pt > 168) AS resizes FROM fx_shape GROUP BY deck_id, slide_id),
ps AS (SELECT *, source_visuals > 0 AND kept_visuals = 0 AS lost, floor(1000 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CASE WHEN scale < 0.82 THEN 0.06::DOUBLE ELSE 0 END - CASE WHEN scale < 0.68 THEN 0.12::DOUBLE ELSE 0 END
 - CASE WHEN low_fonts > 0 THEN least(0.28::DOUBLE, low_fonts * 0.12::DOUBLE) ELSE 0 END - CASE WHEN splits > 0 THEN least(0.3::DOUBLE, splits * 0.18::DOUBLE) ELSE 0 END
 - CASE WHEN overlap_fixes > 0 THEN least(0.18::DOUBLE, overlap_fixes * 0.05::DOUBLE) ELSE 0 END - CASE WHEN unsupported > 0 THEN 0.08::DOUBLE ELSE 0 END
 - CASE WHEN placeholders > 0 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN source_visuals > 0 AND kept_visuals = 0 THEN 0.24::DOUBLE ELSE 0 END)) + 0.5::DOUBLE) / 1000 AS preserve_score,
 list_filter([CASE WHEN scale < 0.82 THEN 'major-size-change' END, CASE WHEN scale < 0.68 THEN 'aggressive-downscale' END, CASE WHEN low_fonts > 0 THEN 'text-below-min-font' END,
  CASE WHEN splits > 0 THEN 'preserve-overflow-risk' END, CASE WHEN overlap_fixes > 0 THEN 'preserve-overlap-risk' END, CASE WHEN unsupported > 0 THEN 'unsupported-source-content' END,
  CASE WHEN placeholders > 0 THEN 'placeholder-source-content' END, CASE WHEN source_visuals > 0 AND kept_visuals = 0 THEN 'decorative-structure-loss' END], lambda r: r IS NOT NULL) AS why FROM rc),
rf AS (SELECT *, low_fonts > 0 OR splits > 0 OR overlap_fixes > 0 OR lost OR preserve_score < 0.68 AS reflow_allowed FROM ps),
sc AS (SELECT *, floor(1000 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - unsupported * 0.12::DOUBLE - placeholders * 0.04::DOUBLE - dropped * 0.15::DOUBLE - splits * 0.18::DOUBLE - overlap_fixes * 0.03::DOUBLE - resizes * 0.05::DOUBLE
 - splits * 0.08::DOUBLE - 0 - len(why) * 0.08::DOUBLE - CASE WHEN deck_id % 7 = 0 THEN 0.08::DOUBLE ELSE 0 END - 0) * 0.45::DOUBLE + 0.9::DOUBLE * 0.25::DOUBLE + preserve_score * 0.3::DOUBLE)) + 0.5::DOUBLE) / 1000 AS confidence FROM rf)"""


@query("ag31_preserve_score", "fx_shape", RISK_CTE, """
SELECT slide_id, preserve_score, array_to_string(why, ',') AS reasons, reflow_allowed,
 CASE WHEN reflow_allowed THEN coalesce(why[1], 'preserve-quality-risk') END AS reflow_reason FROM rf""")
def ag31(t):
    out = sh.preserve_score(risk_counts(t))
    return out.select("slide_id", "preserve_score", F.array_join("risk_reasons", ",").alias("reasons"),
                      "reflow_allowed", "reflow_reason")


def confident(t):
    out = sh.preserve_score(risk_counts(t)).withColumns({
        "output_slides": c("splits") + 1, "planner_warnings": F.lit(0), "visual_risks": F.size("risk_reasons"),
        "fallback": c("deck_id") % 7 == 0, "timed_out": F.lit(False), "planner_confidence": F.lit(0.9),
        "strategy": F.lit("preserve")})
    return sh.slide_confidence(out)


@query("ag32_slide_confidence", "fx_shape", RISK_CTE, "SELECT slide_id, confidence FROM sc")
def ag32(t):
    return confident(t).select("slide_id", "confidence")


@query("ag33_review_queue", "fx_shape", RISK_CTE, """
SELECT slide_id, array_to_string(list_filter([CASE WHEN confidence < 0.78 THEN 'low-confidence' END, CASE WHEN unsupported > 0 THEN 'unsupported-elements' END,
 CASE WHEN dropped > 0 THEN 'deleted-elements' END, CASE WHEN splits > 0 THEN 'slide-split' END, CASE WHEN splits > 0 THEN 'multi-output-slide' END,
 CASE WHEN placeholders > 0 THEN 'placeholder-content' END, CASE WHEN deck_id % 7 = 0 THEN 'planner-fallback' END, CASE WHEN len(why) > 0 THEN 'visual-risk' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM sc WHERE confidence < 0.78 OR unsupported > 0 OR dropped > 0 OR splits > 0 OR placeholders > 0 OR deck_id % 7 = 0 OR len(why) > 0""")
def ag33(t):
    return sh.review_queue(confident(t)).filter("needs_review").select(
        "slide_id", F.array_join("review_reasons", ",").alias("reasons"))


@query("ag33_deck_growth", "fx_shape", RISK_CTE, """
SELECT deck_id, count(*) AS source_slides, CAST(sum(splits + 1) AS BIGINT) AS output_slides, sum(splits + 1) > ceil(count(*) * 1.2::DOUBLE) AS growth_exceeded FROM rc GROUP BY 1""")
def ag33b(t):
    return sh.deck_growth(confident(t), ["deck_id"], 20.0)
