"""Queries for image comparison: every image against its successor."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import pixels as px
from deckloom.operators.stored import materialize
from deckloom.plans.registry import query

c = F.col

G = ["gray"]
KEY = ["image_id"]
BACKGROUND = 128


def pairs(t):
    p = t.fx_pixel
    rendered = p.withColumn("image_id", c("image_id") - 1)
    return px.align_pixels(p, rendered, KEY, G)


def sizes(t):
    return px.image_sizes(t.fx_pixel, KEY)


def masked(t):
    return px.foreground_masks(pairs(t), KEY, G, [BACKGROUND])


def edged(t):
    return px.masks_and_edges(pairs(t), KEY, G, [BACKGROUND], ("ref_gray", "out_gray"))


def near(col: str, op: str, r: int) -> str:
    return f"(SELECT {op}(q.{col}) FROM {{0}} q WHERE q.image_id = p.image_id AND abs(q.x - p.x) <= {r} AND abs(q.y - p.y) <= {r})"


PAIR_CTE = """pr AS (SELECT a.image_id, a.x, a.y, a.gray AS rg, b.gray AS og, abs(a.gray - b.gray) AS d FROM fx_pixel a JOIN fx_pixel b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y)"""
MASK_CTE = PAIR_CTE + """,
n1 AS (SELECT p.image_id, p.x, p.y, max(CASE WHEN abs(q.rg - 128) >= 12 THEN 1 ELSE 0 END) AS rm, max(CASE WHEN abs(q.og - 128) >= 12 THEN 1 ELSE 0 END) AS om, sum(q.rg) AS rs, sum(q.og) AS os
 FROM pr p JOIN pr q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL),
mk AS (SELECT pr.*, rm, om, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND rg * 9 - rs >= 28 THEN 1 ELSE 0 END AS re, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND og * 9 - os >= 28 THEN 1 ELSE 0 END AS oe FROM pr JOIN n1 USING (image_id, x, y))"""
EDGE_CTE = MASK_CTE + """,
n2 AS (SELECT p.image_id, p.x, p.y, max(q.re) AS rn, max(q.oe) AS on_, min(q.rm * q.om) AS er FROM mk p JOIN mk q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2 GROUP BY ALL),
eg AS (SELECT mk.*, rn, on_, er FROM mk JOIN n2 USING (image_id, x, y)),
es AS (SELECT image_id, sum(re) AS sre, sum(oe) AS soe, sum(oe * rn) AS oh, sum(re * on_) AS rh FROM eg GROUP BY 1),
ep AS (SELECT image_id, CASE WHEN soe = 0 THEN CASE WHEN sre = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE oh / soe::DOUBLE END AS p, CASE WHEN sre = 0 THEN CASE WHEN soe = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE rh / sre::DOUBLE END AS r FROM es),
ef AS (SELECT image_id, p, r, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1 FROM ep),
mi AS (SELECT image_id, CASE WHEN sum(greatest(rm, om)) = 0 THEN 1.0::DOUBLE ELSE sum(rm * om) / sum(greatest(rm, om))::DOUBLE END AS iou FROM mk GROUP BY 1)"""


@query("jn14_align_pixels", "fx_pixel", PAIR_CTE, "SELECT image_id, x, y, rg AS ref_gray, og AS out_gray, d AS diff_gray FROM pr")
def jn14(t):
    return pairs(t)


@query("wn14_grid_filter", "fx_pixel", "", """
SELECT p.image_id, p.x, p.y, max(q.gray) AS grown, min(q.gray) AS shrunk, CAST(sum(q.gray) AS BIGINT) AS total FROM fx_pixel p JOIN fx_pixel q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL""")
def wn14(t):
    return px.grid_filter(t.fx_pixel, KEY, 1, [("gray", "max", "grown"), ("gray", "min", "shrunk"), ("gray", "sum", "total")]).drop("gray")


@query("wn14_edge_f1", "fx_pixel", EDGE_CTE, "SELECT image_id, round(p, 6) AS edge_precision, round(r, 6) AS edge_recall, round(f1, 6) AS edge_f1 FROM ef")
def wn14b(t):
    out = px.edge_f1(edged(t), KEY)
    return out.select("image_id", *[F.round(n, 6).alias(n) for n in ("edge_precision", "edge_recall", "edge_f1")])


METRIC_CTE = EDGE_CTE + """,
an AS (SELECT image_id, max(er) AS any_ FROM eg GROUP BY 1),
fg AS (SELECT eg.*, CASE WHEN any_ > 0 THEN er ELSE rm * om END AS fg FROM eg JOIN an USING (image_id)),
sh AS (SELECT image_id, sum(rg - og) / count(*)::DOUBLE AS m FROM fg WHERE fg > 0 GROUP BY 1),
im AS (SELECT image_id, sum(d) / count(*)::DOUBLE / 255 AS mae, quantile_cont(d, 0.95) / 255 AS p95, coalesce(sum(d) FILTER (fg > 0) / (count(d) FILTER (fg > 0))::DOUBLE / 255, 1) AS fm,
 coalesce(quantile_cont(d, 0.95) FILTER (fg > 0) / 255, 1) AS fp, coalesce(avg(abs(rg - og - m)) FILTER (fg > 0) / 255, 1) AS gm FROM fg LEFT JOIN sh USING (image_id) GROUP BY 1)"""


@query("ag10_image_metrics", "fx_pixel", METRIC_CTE, """
SELECT image_id, round(mae, 6) AS pixel_mae, round(p95, 6) AS pixel_p95, round(fm, 6) AS foreground_mae, round(fp, 6) AS foreground_p95, round(gm, 6) AS gradient_profile_mae,
 round(greatest(0.0::DOUBLE, 1 - mae * 2.4::DOUBLE), 6) AS color_score, round(greatest(0.0::DOUBLE, 1 - fm * 2 - fp * 0.5::DOUBLE), 6) AS foreground_color_similarity, round(greatest(0.0::DOUBLE, 1 - gm * 4), 6) AS gradient_profile_similarity FROM im""")
def ag10(t):
    out = px.image_metrics(masked(t), KEY, G)
    return out.select("image_id", *[F.round(n, 6).alias(n) for n in out.columns if n != "image_id"])


@query("ag11_mask_iou", "fx_pixel", EDGE_CTE, "SELECT image_id, round(iou, 6) AS mask_iou FROM mi")
def ag11(t):
    return px.mask_iou(masked(t), KEY).select("image_id", F.round("mask_iou", 6).alias("mask_iou"))


TILE_CTE = PAIR_CTE + """,
ti AS (SELECT image_id, CAST(y >= 4 AS INTEGER) AS tile_row, CASE WHEN x >= 5 THEN 2 WHEN x >= 3 THEN 1 ELSE 0 END AS tile_col, sum(d) / count(*)::DOUBLE / 255.0::DOUBLE AS mae FROM pr GROUP BY ALL)"""


@query("ag12_tile_errors", "fx_pixel", TILE_CTE, "SELECT image_id, tile_row, tile_col, round(mae, 6) AS mae FROM ti")
def ag12(t):
    return px.tile_errors(pairs(t), KEY, sizes(t), G, 2, 3).withColumn("mae", F.round("mae", 6))


@query("ag12_high_error_box", "fx_pixel", PAIR_CTE, """
SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM pr WHERE d / 255.0::DOUBLE >= 0.15 GROUP BY 1""")
def ag12b(t):
    return px.high_error_box(pairs(t), KEY, G)


@query("wn03_worst_regions", "fx_pixel", TILE_CTE + ", rd AS (SELECT image_id, tile_row, tile_col, round(mae, 6) AS mae FROM ti)", """
SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY mae DESC, tile_row, tile_col) AS INTEGER) AS worst_rank FROM rd QUALIFY worst_rank <= 2""")
def wn03(t):
    tiles = px.tile_errors(pairs(t), KEY, sizes(t), G, 2, 3).withColumn("mae", F.round("mae", 6))
    return px.worst_regions(tiles, KEY, 2)


STRUCT_CTE = METRIC_CTE + """,
cl AS (SELECT image_id, x // 4 AS cx, y // 4 AS cy, abs(sum(rg - og)) / count(*)::DOUBLE / 255.0::DOUBLE AS g FROM pr GROUP BY ALL),
co AS (SELECT image_id, greatest(0.0::DOUBLE, 1 - round(avg(g), 9) * 2.2::DOUBLE) AS coarse FROM cl GROUP BY 1),
ss AS (SELECT image_id, mae, f1 * 0.52::DOUBLE + coarse * 0.30::DOUBLE + iou * 0.18::DOUBLE AS st FROM ef JOIN co USING (image_id) JOIN mi USING (image_id) JOIN im USING (image_id))"""


@query("ag13_structure_score", "fx_pixel", STRUCT_CTE, """
SELECT image_id, round(st, 6) AS structural_score, round(greatest(0.0::DOUBLE, 1 - mae * 2.4::DOUBLE) * 0.30::DOUBLE + st * 0.70::DOUBLE, 6) AS similarity_score FROM ss""")
def ag13(t):
    out = px.compare_images(t.fx_pixel, t.fx_pixel.withColumn("image_id", c("image_id") - 1), KEY, G, [BACKGROUND])
    return out.select("image_id", F.round("structural_score", 6).alias("structural_score"),
                      F.round("similarity_score", 6).alias("similarity_score"))


def boxes(t):
    """Two derived boxes per image."""
    one = t.embeddings.select(c("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"),
                              F.explode(F.array(F.lit(1), F.lit(2))).alias("object_id"))
    first = c("object_id") == 1
    boxed = one.withColumns({
        "kind": F.when(first, "shape").otherwise("text"), "x": F.when(first, c("image_id") % 4).otherwise(0.5),
        "y": F.when(first, c("image_id") % 3).otherwise(2.5), "w": F.when(first, 4.5).otherwise(3.0),
        "h": F.when(first, 3.0).otherwise(9.0)})
    return px.object_boxes(boxed)


BOX_CTE = """bx AS (SELECT vec_id AS image_id, 1 AS object_id, vec_id % 4 AS l, vec_id % 3 AS t, CAST(least(8, ceil(vec_id % 4 + 4.5)) AS BIGINT) AS r, CAST(vec_id % 3 + 3 AS BIGINT) AS b FROM embeddings
 UNION ALL SELECT vec_id, 2, 0, 2, 4, 8 FROM embeddings)"""


@query("jn13_pixels_in_regions", "fx_pixel embeddings", BOX_CTE, """
SELECT image_id, object_id, x, y, gray FROM fx_pixel JOIN bx USING (image_id) WHERE x >= l AND x < r AND y >= t AND y < b""")
def jn13(t):
    return px.pixels_in_regions(t.fx_pixel, boxes(t), KEY, cell=4).select("image_id", "object_id", "x", "y", "gray")


REGION_CTE = EDGE_CTE + ",\n" + BOX_CTE + """,
rs AS (SELECT image_id, object_id, count(*) AS n, sum(d) AS sd, sum(rm * om) AS i, sum(greatest(rm, om)) AS u, count(*) FILTER (d / 255.0::DOUBLE >= 0.15) AS hi, sum(re) AS sre, sum(oe) AS soe, sum(oe * rn) AS oh, sum(re * on_) AS rh
 FROM eg JOIN bx USING (image_id) WHERE x >= l AND x < r AND y >= t AND y < b GROUP BY 1, 2),
rp AS (SELECT *, CASE WHEN soe = 0 THEN CASE WHEN sre = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE oh / soe::DOUBLE END AS p, CASE WHEN sre = 0 THEN CASE WHEN soe = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE rh / sre::DOUBLE END AS rc,
 sd / n::DOUBLE / 255.0::DOUBLE AS mae, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i / u::DOUBLE END AS iou FROM rs),
rf AS (SELECT *, CASE WHEN p + rc = 0 THEN 0.0::DOUBLE ELSE 2 * p * rc / (p + rc) END * 0.72::DOUBLE + iou * 0.28::DOUBLE AS st FROM rp),
rg AS (SELECT *, st * 0.70::DOUBLE + greatest(0.0::DOUBLE, 1 - mae * 2.4::DOUBLE) * 0.30::DOUBLE AS sim FROM rf)"""


@query("ag14_region_metrics", "fx_pixel embeddings", REGION_CTE, """
SELECT image_id, object_id, round(mae, 6) AS pixel_mae, round(iou, 6) AS mask_iou, round(st, 6) AS structural_score, round(sim, 6) AS similarity_score, round(hi / n::DOUBLE, 6) AS high_error_share, round(mae * n, 6) AS error_mass FROM rg""")
def ag14(t):
    out = px.region_metrics(edged(t), boxes(t), KEY, G, cell=4)
    return out.select("image_id", "object_id", *[F.round(n, 6).alias(n) for n in (
        "pixel_mae", "mask_iou", "structural_score", "similarity_score", "high_error_share", "error_mass")])


@query("wn04_focus_objects", "fx_pixel embeddings", REGION_CTE + """,
fo AS (SELECT image_id, object_id, round(mae * n, 6) AS em, round(sim, 6) AS sim FROM rg WHERE object_id = 1 AND n <= 100 * 0.18::DOUBLE AND (round(hi / n::DOUBLE, 6) >= 0.08 OR round(mae, 6) >= 0.06))""", """
SELECT image_id, object_id, em AS error_mass, CAST(row_number() OVER (PARTITION BY image_id ORDER BY em DESC, sim, object_id) AS INTEGER) AS focus_rank FROM fo QUALIFY focus_rank <= 2""")
def wn04(t):
    out = px.region_metrics(edged(t), boxes(t), KEY, G, cell=4)
    rounded = out.select("image_id", "object_id", "pixels", *[F.round(n, 6).alias(n) for n in (
        "pixel_mae", "similarity_score", "high_error_share", "error_mass")])
    kinds = boxes(t).select("image_id", "object_id", "kind")
    regions = rounded.join(kinds, ["image_id", "object_id"]).withColumn("box_area", c("pixels"))
    return px.focus_objects(regions, KEY, F.lit(100)).select("image_id", "object_id", "error_mass", "focus_rank")


SIL_CTE = MASK_CTE + """,
si AS (SELECT image_id, count(*) FILTER (rm > 0) AS ra, count(*) FILTER (om > 0) AS oa, sum(rm * om) AS i, sum(greatest(rm, om)) AS u, min(x) FILTER (rm > 0) AS rx0, max(x + 1) FILTER (rm > 0) AS rx1, min(y) FILTER (rm > 0) AS ry0, max(y + 1) FILTER (rm > 0) AS ry1,
 min(x) FILTER (om > 0) AS ox0, max(x + 1) FILTER (om > 0) AS ox1, min(y) FILTER (om > 0) AS oy0, max(y + 1) FILTER (om > 0) AS oy1, sum(x) FILTER (rm > 0) / (count(*) FILTER (rm > 0))::DOUBLE - sum(x) FILTER (om > 0) / (count(*) FILTER (om > 0))::DOUBLE AS dx,
 sum(y) FILTER (rm > 0) / (count(*) FILTER (rm > 0))::DOUBLE - sum(y) FILTER (om > 0) / (count(*) FILTER (om > 0))::DOUBLE AS dy FROM mk GROUP BY 1),
sj AS (SELECT *, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i / u::DOUBLE END AS iou, greatest(0, least(rx1, ox1) - greatest(rx0, ox0)) * greatest(0, least(ry1, oy1) - greatest(ry0, oy0)) AS bi,
 CASE WHEN greatest(ra, oa) = 0 THEN 1.0::DOUBLE ELSE least(ra, oa) / greatest(ra, oa)::DOUBLE END AS ar FROM si),
sk AS (SELECT *, CASE WHEN rx0 IS NULL AND ox0 IS NULL THEN 1.0::DOUBLE WHEN rx0 IS NULL OR ox0 IS NULL THEN 0.0::DOUBLE ELSE bi / ((rx1 - rx0) * (ry1 - ry0) + (ox1 - ox0) * (oy1 - oy0) - bi)::DOUBLE END AS bb,
 CASE WHEN ra > 0 AND oa > 0 THEN greatest(0.0::DOUBLE, 1 - sqrt(dx * dx + dy * dy) / sqrt(128.0::DOUBLE) * 8) WHEN ra = oa THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cs FROM sj)"""


@query("ag15_silhouette_metrics", "fx_pixel", SIL_CTE, """
SELECT image_id, round(iou, 6) AS silhouette_iou, round(bb, 6) AS bbox_iou, round(ar, 6) AS area_ratio, round(cs, 6) AS centroid_score, round(iou * 0.72::DOUBLE + bb * 0.15::DOUBLE + ar * 0.08::DOUBLE + cs * 0.05::DOUBLE, 6) AS geometry_score FROM sk""")
def ag15(t):
    out = px.silhouette_metrics(masked(t), KEY, sizes(t))
    return out.select("image_id", *[F.round(n, 6).alias(n) for n in (
        "silhouette_iou", "bbox_iou", "area_ratio", "centroid_score", "geometry_score")])


@query("ag15_local_silhouette", "fx_pixel", SIL_CTE + """,
tl AS (SELECT mk.image_id, CASE WHEN y >= round_even(ry0 + (ry1 - ry0) / 2.0::DOUBLE, 0) THEN 1 ELSE 0 END AS tr, CASE WHEN x >= round_even(rx0 + (rx1 - rx0) / 2.0::DOUBLE, 0) THEN 1 ELSE 0 END AS tc, sum(rm) AS n, sum(rm * om) / sum(greatest(rm, om))::DOUBLE AS iou
 FROM mk JOIN si USING (image_id) WHERE x >= rx0 AND x < rx1 AND y >= ry0 AND y < ry1 GROUP BY ALL HAVING sum(rm) >= 4)""", """
SELECT image_id, round(min(iou), 6) AS worst_local_iou, round(quantile_cont(iou, 0.1), 6) AS local_iou_p10 FROM tl GROUP BY 1""")
def ag15b(t):
    tiles = px.silhouette_tiles(masked(t), KEY, 2, 4)
    out = px.local_silhouette(tiles, KEY)
    return out.select("image_id", F.round("worst_local_iou", 6).alias("worst_local_iou"),
                      F.round("local_iou_p10", 6).alias("local_iou_p10"))


RAMP_CTE = PAIR_CTE + """,
rb AS (SELECT image_id, CAST(floor((x / 7.0::DOUBLE + 1 - y / 7.0::DOUBLE) / 2 * 4) AS BIGINT) AS bin, rg, og, rg > 110 AS rv, og > 110 AS ov FROM pr),
rq AS (SELECT image_id, bin, count(*) FILTER (rv) AS rp, quantile_cont(rg, 0.5) FILTER (rv) / 255 AS rmed, quantile_cont(og, 0.5) FILTER (ov) / 255 AS omed FROM rb WHERE bin < 4 GROUP BY 1, 2 HAVING count(*) FILTER (rv) >= 4 AND count(*) FILTER (ov) >= 4),
rc AS (SELECT image_id, sum(rp) AS w, sum(rp * (rmed - omed)) / sum(rp) AS m FROM rq GROUP BY 1)"""


@query("ag16_color_ramp_profile", "fx_pixel", RAMP_CTE, """
SELECT image_id, count(*) AS profile_bins, round(sum(abs(rmed - omed) * rp) / max(w), 6) AS profile_mae, round(quantile_cont(abs(rmed - omed), 0.95), 6) AS profile_p95, round(sum(abs(rmed - omed - m) * rp) / max(w), 6) AS gradient_profile_mae FROM rq JOIN rc USING (image_id) GROUP BY 1""")
def ag16(t):
    rows = pairs(t).withColumns({"ref_valid": c("ref_gray") > 110, "out_valid": c("out_gray") > 110})
    out = px.ramp_metrics(px.color_ramp_profile(rows, KEY, sizes(t), G, 4, 4), KEY, G)
    return out.select("image_id", "profile_bins", *[F.round(n, 6).alias(n) for n in (
        "profile_mae", "profile_p95", "gradient_profile_mae")])


@query("ag17_linear_ramp_fit", "fx_pixel", """u AS (SELECT image_id, x / 7.0::DOUBLE AS u, y / 7.0::DOUBLE AS v, CAST(gray AS DOUBLE) AS g FROM fx_pixel),
z AS (SELECT image_id, count(*) AS n, covar_pop(g, u) AS gu, covar_pop(g, v) AS gv, var_pop(u) AS uu, var_pop(v) AS vv, var_pop(g) AS gg FROM u GROUP BY 1)""", """
SELECT image_id, n AS pixels, round(gu / uu, 8) AS slope_x_gray, round(gv / vv, 8) AS slope_y_gray, round((gu * gu / uu + gv * gv / vv) / gg, 6) AS r_squared FROM z""")
def ag17(t):
    out = px.linear_ramp_fit(t.fx_pixel, KEY, sizes(t), G)
    return out.select("image_id", "pixels", F.round("slope_x_gray", 8).alias("slope_x_gray"),
                      F.round("slope_y_gray", 8).alias("slope_y_gray"), F.round("r_squared", 6).alias("r_squared"))


@query("ag18_background_color", "fx_pixel", """b AS (SELECT image_id, gray FROM fx_pixel WHERE y = 0 UNION ALL SELECT image_id, gray FROM fx_pixel WHERE y = 7 UNION ALL SELECT image_id, gray FROM fx_pixel WHERE x = 0 UNION ALL SELECT image_id, gray FROM fx_pixel WHERE x = 7)""", """
SELECT image_id, CAST(round_even(quantile_cont(gray, 0.5), 0) AS BIGINT) AS gray FROM b GROUP BY 1""")
def ag18(t):
    return px.background_color(t.fx_pixel, KEY, sizes(t), G)


@query("ag19_palette", "fx_pixel", """k AS (SELECT image_id, gray // 32 AS bucket_gray, count(*) AS pixels FROM fx_pixel GROUP BY ALL)""", """
SELECT image_id, bucket_gray, pixels, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, bucket_gray) AS INTEGER) AS color_rank, round(pixels / 64.0::DOUBLE, 4) AS share FROM k QUALIFY color_rank <= 3""")
def ag19(t):
    return px.palette(t.fx_pixel, KEY, G, 3)


RUN_CTE = """m AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM fx_pixel WHERE abs(gray - 128) * sqrt(3.0::DOUBLE) <= 24),
rn AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM m GROUP BY image_id, y, g HAVING max(x) - min(x) + 1 >= 2)"""


def runs(t):
    gray = [c("gray")] * 3
    from deckloom.functions.values import color_distance

    return px.color_runs(t.fx_pixel, KEY, color_distance(gray, [F.lit(128)] * 3) <= 24, 2)


@query("wn11_color_runs", "fx_pixel", RUN_CTE, "SELECT image_id, y, x0, x1 FROM rn")
def wn11(t):
    return runs(t)


@query("wn12_run_blocks", "fx_pixel", RUN_CTE + """,
e AS (SELECT image_id, x0 // 4 AS b0, x1 // 4 AS b1, y, min(x0) AS x0, max(x1) AS x1 FROM rn GROUP BY ALL),
s AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, b0, b1 ORDER BY y) AS g FROM e),
q AS (SELECT image_id, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS width, max(y) - min(y) + 1 AS height FROM s GROUP BY image_id, b0, b1, g)""", """
SELECT * FROM q WHERE height >= 2 AND width / height::DOUBLE >= 1.0""")
def wn12(t):
    return px.run_blocks(runs(t), KEY, 4, 2, 1.0)


CORNERS = """co AS (SELECT slide_id, shape_id, unnest([0, 1, 2, 3]) AS seq, x_pt, y_pt, w_pt, h_pt FROM fx_shape_key)"""


def contours(t):
    """The four corners of every shape, skewed by its rotation."""
    k = t.fx_shape_key
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate([
        (c("x_pt"), c("y_pt")), (c("x_pt") + c("w_pt"), c("y_pt") + c("rot_deg")),
        (c("x_pt") + c("w_pt"), c("y_pt") + c("h_pt")), (c("x_pt") + c("rot_deg"), c("y_pt") + c("h_pt"))])])
    return k.select("slide_id", "shape_id", F.explode(corners).alias("p")).select("slide_id", "shape_id", "p.*")


AREA_CTE = """ar AS (SELECT slide_id, shape_id, abs((x_pt * (y_pt + rot_deg) - (x_pt + w_pt) * y_pt) + ((x_pt + w_pt) * (y_pt + h_pt) - (x_pt + w_pt) * (y_pt + rot_deg))
 + ((x_pt + w_pt) * (y_pt + h_pt) - (x_pt + rot_deg) * (y_pt + h_pt)) + ((x_pt + rot_deg) * y_pt - x_pt * (y_pt + h_pt))) / 2.0::DOUBLE AS area FROM fx_shape_key)"""


@query("wn10_polygon_area", "fx_shape_key", AREA_CTE, "SELECT * FROM ar")
def wn10(t):
    return px.polygon_area(contours(t), ["slide_id", "shape_id"])


@query("wn10_drop_specks", "fx_shape_key", AREA_CTE + ", mx AS (SELECT slide_id, max(area) AS m FROM ar GROUP BY 1)", """
SELECT slide_id, shape_id, area FROM ar JOIN mx USING (slide_id) WHERE area = m OR area >= greatest(1.0::DOUBLE, m * 0.2::DOUBLE)""")
def wn10b(t):
    # Stored, as the areas are read twice.
    areas = materialize(px.polygon_area(contours(t), ["slide_id", "shape_id"]), "areas")
    return px.drop_specks(areas, ["slide_id"], 0.2).select(
        "slide_id", "shape_id", "area")


@query("jn23_ramp_lookup", "fx_pixel", """pf AS (SELECT image_id, x / 8.0::DOUBLE AS progress, sum(gray) AS gray FROM fx_pixel GROUP BY image_id, x),
sp AS (SELECT *, lead(progress) OVER w AS p1, lead(gray) OVER w AS g1, lag(progress) OVER w IS NULL AS f FROM pf WINDOW w AS (PARTITION BY image_id ORDER BY progress)),
st AS (SELECT image_id, y, gray / 200.0::DOUBLE AS position FROM fx_pixel WHERE x = 0)""", """
SELECT st.image_id, y, position, round(CASE WHEN p1 IS NULL OR position <= progress THEN gray ELSE gray + (position - progress) / (p1 - progress) * (g1 - gray) END, 6) AS gray FROM st JOIN sp ON st.image_id = sp.image_id AND (position >= progress OR f) AND (p1 IS NULL OR position < p1)""")
def jn23(t):
    profile = t.fx_pixel.groupBy("image_id", (c("x") / 8).alias("progress")).agg(F.sum("gray").alias("gray"))
    stops = t.fx_pixel.filter("x = 0").select("image_id", "y", (c("gray") / 200).alias("position"))
    return px.ramp_lookup(stops, profile, KEY, G).withColumn("gray", F.round("gray", 6))
