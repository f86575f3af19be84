"""Image comparison over pixel rows.

Pixels are (image key, x, y, channels); a pair row holds the reference channels ``ref_*`` and the
rendered channels ``out_*`` of one position. Everything is sums, exact percentiles over at most
256 levels, and windows along single pixel rows or columns, so no image is gathered whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions import values as vl
from deckloom.operators.stored import materialize

c = F.col

RGB = ["r", "g", "b"]
# Mask tolerance, edge threshold and distance, error limits and score weights.
MASK_TOLERANCE, EDGE_THRESHOLD, EDGE_REACH, HIGH_ERROR = 12, 28, 2, 0.15
COLOR_SLOPE, COARSE_SLOPE = 2.4, 2.2
STRUCTURE_WEIGHTS = (0.52, 0.30, 0.18)
SIMILARITY_WEIGHTS = (0.30, 0.70)
REGION_WEIGHTS = (0.72, 0.28)
SILHOUETTE_WEIGHTS = (0.72, 0.15, 0.08, 0.05)
FOCUS_KINDS = ["shape", "path", "line", "component"]
RUN_DISTANCE, BAR_HEIGHT, BAR_ASPECT = 48, 3, 2.5
SPECK_SHARE = 0.002
RAMP_R2, RAMP_STRENGTH, RAMP_PIXELS = 0.45, 8.0, 64


def align_pixels(reference: DataFrame, rendered: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Pixel pairs of two images of one size, with the absolute difference per channel."""
    at = [*keys, "x", "y"]
    a = reference.select(*at, *[c(n).alias(f"ref_{n}") for n in channels])
    b = rendered.select(*at, *[c(n).alias(f"out_{n}") for n in channels])
    return a.join(b, at).withColumns({f"diff_{n}": F.abs(c(f"ref_{n}") - c(f"out_{n}")) for n in channels})


def image_sizes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def grid_filter(pixels: DataFrame, keys: list[str], radius: int, specs: list[tuple[str, str, str]],
                columns_first: bool = False) -> DataFrame:
    """Square neighbourhood max, min or sum of columns, as (column, op, new column).

    The square is separable: one window along the row, one along the column. No pixel is copied
    to its neighbours, and a window holds one line of one image. A second filter that starts with
    the columns finds the rows where the first one left them and saves a shuffle.
    """
    ops = {"max": F.max, "min": F.min, "sum": F.sum}
    lines = [Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius),
             Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)]
    first, second = reversed(lines) if columns_first else lines
    half = pixels.withColumns({f"_{out}": ops[op](c(name)).over(first) for name, op, out in specs})
    done = half.withColumns({out: ops[op](c(f"_{out}")).over(second) for _, op, out in specs})
    return done.drop(*[f"_{out}" for _, _, out in specs])


def _far(side: str, channels: list[str], background: list[int], tolerance: int) -> Column:
    gaps = [F.abs(c(f"{side}_{n}") - bg) for n, bg in zip(channels, background)]
    widest = gaps[0] if len(gaps) == 1 else F.greatest(*gaps)
    return (widest >= tolerance).cast("int")


_MASKS = [("_rm", "max", "ref_mask"), ("_om", "max", "out_mask")]


def foreground_masks(pairs: DataFrame, keys: list[str], channels: list[str], background: list[int],
                     tolerance: int = MASK_TOLERANCE) -> DataFrame:
    """0/1 masks ``ref_mask`` and ``out_mask``: far from the background, grown by one pixel."""
    marked = pairs.withColumns({"_rm": _far("ref", channels, background, tolerance),
                                "_om": _far("out", channels, background, tolerance)})
    return grid_filter(marked, keys, 1, _MASKS).drop("_rm", "_om")


def _edge_specs(luma: tuple[str, str]) -> list[tuple[str, str, str]]:
    return [(luma[0], "sum", "_ra"), (luma[1], "sum", "_rb"), ("_one", "sum", "_n")]


def _edges(summed: DataFrame, luma: tuple[str, str], threshold: int) -> DataFrame:
    """Edges from neighbourhood sums; a pixel without all its eight neighbours is on the frame."""

    def edge(v: str, total: str) -> Column:
        return ((c("_n") == 9) & (c(v) * 9 - c(total) >= threshold)).cast("int")

    return summed.withColumns({"ref_edge": edge(luma[0], "_ra"), "out_edge": edge(luma[1], "_rb")}).drop(
        "_ra", "_rb", "_n", "_one")


def edge_masks(pairs: DataFrame, keys: list[str], luma: tuple[str, str], threshold: int = EDGE_THRESHOLD) -> DataFrame:
    """0/1 edge masks of both sides by the 3×3 outline kernel; the outer frame is never an edge."""
    return _edges(grid_filter(pairs.withColumn("_one", F.lit(1)), keys, 1, _edge_specs(luma)), luma, threshold)


def masks_and_edges(pairs: DataFrame, keys: list[str], channels: list[str], background: list[int],
                    luma: tuple[str, str], tolerance: int = MASK_TOLERANCE, threshold: int = EDGE_THRESHOLD) -> DataFrame:
    """Both kinds of masks from one pass over the lines."""
    marked = pairs.withColumns({"_rm": _far("ref", channels, background, tolerance),
                                "_om": _far("out", channels, background, tolerance), "_one": F.lit(1)})
    both = grid_filter(marked, keys, 1, [*_MASKS, *_edge_specs(luma)]).drop("_rm", "_om")
    return _edges(both, luma, threshold)


def edge_f1(pairs: DataFrame, keys: list[str], reach: int = EDGE_REACH) -> DataFrame:
    """Precision, recall and F1 of edges that may be ``reach`` pixels apart."""
    near = grid_filter(pairs, keys, reach, [("ref_edge", "max", "ref_near"), ("out_edge", "max", "out_near")], True)
    return _edge_scores(near.groupBy(*keys).agg(*_edge_sums())).select(
        *keys, "edge_precision", "edge_recall", "edge_f1")


def _edge_sums() -> list[Column]:
    return [F.sum("ref_edge").alias("_re"), F.sum("out_edge").alias("_oe"),
            F.sum(c("out_edge") * c("ref_near")).alias("_oh"), F.sum(c("ref_edge") * c("out_near")).alias("_rh")]


def _edge_scores(sums: DataFrame) -> DataFrame:
    precision = vl.safe_ratio(c("_oh"), c("_oe"), F.when(c("_re") == 0, 1.0).otherwise(0.0))
    recall = vl.safe_ratio(c("_rh"), c("_re"), F.when(c("_oe") == 0, 1.0).otherwise(0.0))
    both = c("edge_precision") + c("edge_recall")
    return sums.withColumns({"edge_precision": precision, "edge_recall": recall}).withColumn(
        "edge_f1", vl.safe_ratio(2 * c("edge_precision") * c("edge_recall"), both, F.lit(0.0)))


def interior(masked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``common`` (foreground on both sides) and ``inner``, the same shrunk by two pixels."""
    both = masked.withColumn("common", c("ref_mask") * c("out_mask"))
    return grid_filter(both, keys, 2, [("common", "min", "inner")], True)


def image_metrics(masked: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Colour error of each pair, over all pixels and over the common foreground's interior.

    Takes pair rows with masks (and ``common``, ``inner`` if they are there already). Pixels are
    counted by channel and signed difference, at most 511 rows per channel and image, before any
    shuffle; every figure is exact arithmetic on those counts. Where the interior is empty the
    common foreground itself counts.
    """
    rows = masked if {"common", "inner"} <= set(masked.columns) else interior(masked, keys)
    signed = F.array(*[F.struct(F.lit(n).alias("n"), (c(f"ref_{n}") - c(f"out_{n}")).alias("s")) for n in channels])
    counts = rows.select(*keys, "common", "inner", F.explode(signed).alias("_v")).groupBy(*keys, "_v.n", "_v.s").agg(
        F.count("*").alias("_all"), F.sum("common").alias("_common"), F.sum("inner").alias("_inner"))
    image, channel = Window.partitionBy(*keys), Window.partitionBy(*keys, "n")
    counts = counts.withColumn("_fg", F.when(F.sum("_inner").over(image) > 0, c("_inner")).otherwise(c("_common")))
    # Centring both sides and comparing is centring their signed difference.
    counts = counts.withColumn("_m", F.try_divide(F.sum(c("s") * c("_fg")).over(channel), F.sum("_fg").over(channel)))
    gap = F.abs(c("s"))
    out = counts.groupBy(*keys).agg(
        (F.sum(gap * c("_all")) / F.sum("_all") / 255).alias("pixel_mae"),
        (F.percentile(gap, 0.95, c("_all")) / 255).alias("pixel_p95"),
        (F.try_divide(F.sum(gap * c("_fg")), F.sum("_fg")) / 255).alias("_fm"),
        (F.percentile(gap, 0.95, c("_fg")) / 255).alias("_fp"),
        (F.try_divide(F.sum(F.abs(c("s") - c("_m")) * c("_fg")), F.sum("_fg")) / 255).alias("_gm"))
    one, zero = F.lit(1.0), F.lit(0.0)
    out = out.withColumns({"foreground_mae": F.coalesce(c("_fm"), one), "foreground_p95": F.coalesce(c("_fp"), one),
                           "gradient_profile_mae": F.coalesce(c("_gm"), one)}).drop("_fm", "_fp", "_gm")
    return out.withColumns({
        "color_score": F.greatest(zero, one - c("pixel_mae") * COLOR_SLOPE),
        "foreground_color_similarity": F.greatest(zero, one - c("foreground_mae") * 2.0 - c("foreground_p95") * 0.5),
        "gradient_profile_similarity": F.greatest(zero, one - c("gradient_profile_mae") * 4.0)})


def compare_images(reference: DataFrame, rendered: DataFrame, keys: list[str], channels: list[str],
                   background: list[int], cell: int = 4) -> DataFrame:
    """All scores of image pairs in one row each: colour, edges, mask, coarse cells, structure, similarity.

    Pairs are aligned once; masks and edges share one pass over the lines, reach and interior the
    next, which starts where the first one ended. The result is stored in the shared folder,
    because three kinds of groups read it.
    """
    pairs = align_pixels(reference, rendered, keys, channels)
    luma = [vl.luminance(*[c(f"{s}_{n}") for n in RGB]) if channels == RGB else c(f"{s}_{channels[0]}")
            for s in ("ref", "out")]
    pairs = pairs.withColumns({"_rl": luma[0], "_ol": luma[1]})
    edged = masks_and_edges(pairs, keys, channels, background, ("_rl", "_ol")).withColumn(
        "common", c("ref_mask") * c("out_mask"))
    done = materialize(grid_filter(edged, keys, EDGE_REACH, [
        ("ref_edge", "max", "ref_near"), ("out_edge", "max", "out_near"), ("common", "min", "inner")], True), "image-pairs")
    sums = done.groupBy(*keys).agg(*_edge_sums(), F.sum("common").alias("_i"),
                                   F.sum(F.greatest("ref_mask", "out_mask")).alias("_u"))
    edges = _edge_scores(sums).withColumn("mask_iou", vl.safe_ratio(c("_i"), c("_u"), F.lit(1.0))).select(
        *keys, "edge_precision", "edge_recall", "edge_f1", "mask_iou")
    return structure_score(edges.join(coarse_score(done, keys, channels, cell), keys).join(
        image_metrics(done, keys, channels), keys))


def mask_iou(masked: DataFrame, keys: list[str]) -> DataFrame:
    both, either = c("ref_mask") * c("out_mask"), F.greatest("ref_mask", "out_mask")
    sums = masked.groupBy(*keys).agg(F.sum(both).alias("_i"), F.sum(either).alias("_u"))
    return sums.select(*keys, vl.safe_ratio(c("_i"), c("_u"), F.lit(1.0)).alias("mask_iou"))


def _mean_diff(channels: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c(f"diff_{n}") for n in channels]) / F.lit(255.0 * len(channels))


def _tile(value: Column, low: Column, size: Column, parts: int) -> Column:
    """Index of the tile that holds a coordinate; tile borders are rounded to whole pixels."""
    return reduce(lambda a, b: a + b, [
        (value >= F.bround(low + F.lit(i) * size / F.lit(parts))).cast("int") for i in range(1, parts)], F.lit(0))


def tile_errors(pairs: DataFrame, keys: list[str], sizes: DataFrame, channels: list[str], rows: int = 4,
                cols: int = 6) -> DataFrame:
    """Mean error of each page tile."""
    placed = pairs.join(sizes, keys).withColumns({
        "tile_row": _tile(c("y"), F.lit(0), c("height"), rows), "tile_col": _tile(c("x"), F.lit(0), c("width"), cols)})
    total = reduce(lambda a, b: a + b, [c(f"diff_{n}") for n in channels])
    return placed.groupBy(*keys, "tile_row", "tile_col").agg(
        (F.sum(total) / F.count("*") / F.lit(255.0 * len(channels))).alias("mae"))


def high_error_box(pairs: DataFrame, keys: list[str], channels: list[str], limit: float = HIGH_ERROR) -> DataFrame:
    """Enclosing box of the pixels with a mean error of ``limit`` or more."""
    return pairs.filter(_mean_diff(channels) >= limit).groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"))


def worst_regions(tiles: DataFrame, keys: list[str], k: int = 5, by: str = "mae", ties: tuple[str, ...] = (
        "tile_row", "tile_col"), ascending: bool = False) -> DataFrame:
    """The k worst tiles or objects of each pair, with their rank."""
    order = Window.partitionBy(*keys).orderBy(c(by).asc() if ascending else c(by).desc(), *ties)
    return tiles.withColumn("worst_rank", F.row_number().over(order)).filter(c("worst_rank") <= k)


def coarse_score(pairs: DataFrame, keys: list[str], channels: list[str], cell: int = 4) -> DataFrame:
    """Similarity of cell means, in place of a blurred preview."""
    cells = pairs.groupBy(*keys, F.floor(c("x") / cell).alias("_cx"), F.floor(c("y") / cell).alias("_cy")).agg(
        F.count("*").alias("_n"), *[F.sum(c(f"ref_{n}") - c(f"out_{n}")).alias(f"_s_{n}") for n in channels])
    gap = reduce(lambda a, b: a + b, [F.abs(c(f"_s_{n}")) for n in channels]) / c("_n") / F.lit(255.0 * len(channels))
    # Rounded, so that the order of the summed cells cannot show in the result.
    return cells.groupBy(*keys).agg(F.round(F.avg(gap), 9).alias("_m")).select(
        *keys, F.greatest(F.lit(0.0), F.lit(1.0) - c("_m") * COARSE_SLOPE).alias("coarse_score"))


def structure_score(metrics: DataFrame) -> DataFrame:
    """Structure and similarity of a pair from edge_f1, coarse_score, mask_iou and color_score."""
    e, b, m = STRUCTURE_WEIGHTS
    p, s = SIMILARITY_WEIGHTS
    out = metrics.withColumn("structural_score", c("edge_f1") * e + c("coarse_score") * b + c("mask_iou") * m)
    return out.withColumn("similarity_score", c("color_score") * p + c("structural_score") * s)


def object_boxes(objects: DataFrame) -> DataFrame:
    """Whole-pixel boxes left, top, right, bottom of elements, clipped to width and height.

    Lines (x1..y2, stroke_width_px) are padded by twice their stroke, at least three pixels.
    """
    have = set(objects.columns)
    line = (c("kind") == "line") if {"x1", "y1", "x2", "y2"} <= have else None
    if line is None:
        x0, y0, x1, y1 = c("x"), c("y"), c("x") + c("w"), c("y") + c("h")
    else:
        pad = F.greatest(F.lit(3.0), c("stroke_width_px") * 2.0)
        x0 = F.when(line, F.least("x1", "x2") - pad).otherwise(c("x"))
        y0 = F.when(line, F.least("y1", "y2") - pad).otherwise(c("y"))
        x1 = F.when(line, F.greatest("x1", "x2") + pad).otherwise(c("x") + c("w"))
        y1 = F.when(line, F.greatest("y1", "y2") + pad).otherwise(c("y") + c("h"))
    out = objects.withColumns({"left": vl.clamp(F.floor(x0), 0, c("width")), "top": vl.clamp(F.floor(y0), 0, c("height"))})
    out = out.withColumns({
        "right": F.greatest(c("left") + 1, F.least(c("width"), F.ceil(x1))),
        "bottom": F.greatest(c("top") + 1, F.least(c("height"), F.ceil(y1)))})
    return out.filter((c("left") < c("width")) & (c("top") < c("height")))


def pixels_in_regions(pixels: DataFrame, boxes: DataFrame, keys: list[str], object_key: str = "object_id",
                      cell: int = 64) -> DataFrame:
    """Pixels with every object box that holds them.

    Boxes are unrolled over the grid cells they touch and joined on (image, cell), so one big
    image is spread over its cells and no image meets all its boxes at once.
    """
    b = boxes.select(*keys, object_key, "left", "top", "right", "bottom").withColumn(
        "_gx", F.explode(F.sequence(F.floor(c("left") / cell), F.floor((c("right") - 1) / cell)))).withColumn(
        "_gy", F.explode(F.sequence(F.floor(c("top") / cell), F.floor((c("bottom") - 1) / cell))))
    p = pixels.withColumns({"_gx": F.floor(c("x") / cell), "_gy": F.floor(c("y") / cell)})
    inside = (c("x") >= c("left")) & (c("x") < c("right")) & (c("y") >= c("top")) & (c("y") < c("bottom"))
    return p.join(b, [*keys, "_gx", "_gy"]).filter(inside).drop("_gx", "_gy")


def region_metrics(pairs: DataFrame, boxes: DataFrame, keys: list[str], channels: list[str],
                   object_key: str = "object_id", cell: int = 64) -> DataFrame:
    """Scores of each object region; pair rows carry masks and edges.

    Edges are grown over the whole image, so a neighbour just outside the box still matches.
    """
    near = grid_filter(pairs, keys, EDGE_REACH, [("ref_edge", "max", "ref_near"), ("out_edge", "max", "out_near")], True)
    rows = pixels_in_regions(near, boxes, keys, object_key, cell)
    total = reduce(lambda a, b: a + b, [c(f"diff_{n}") for n in channels])
    sums = rows.groupBy(*keys, object_key).agg(
        *_edge_sums(), F.count("*").alias("pixels"), F.sum(total).alias("_d"),
        F.sum(c("ref_mask") * c("out_mask")).alias("_i"), F.sum(F.greatest("ref_mask", "out_mask")).alias("_u"),
        F.count_if(_mean_diff(channels) >= HIGH_ERROR).alias("_high"))
    out = _edge_scores(sums).withColumns({
        "pixel_mae": c("_d") / c("pixels") / F.lit(255.0 * len(channels)),
        "mask_iou": vl.safe_ratio(c("_i"), c("_u"), F.lit(1.0)), "high_error_share": c("_high") / c("pixels")})
    e, m = REGION_WEIGHTS
    p, s = SIMILARITY_WEIGHTS
    out = out.withColumn("structural_score", c("edge_f1") * e + c("mask_iou") * m)
    color = F.greatest(F.lit(0.0), F.lit(1.0) - c("pixel_mae") * COLOR_SLOPE)
    out = out.withColumns({"similarity_score": c("structural_score") * s + color * p,
                           "error_mass": c("pixel_mae") * c("pixels")})
    return out.drop("_re", "_oe", "_oh", "_rh", "_d", "_i", "_u", "_high")


def focus_objects(regions: DataFrame, keys: list[str], canvas_area: Column, k: int = 2,
                  object_key: str = "object_id") -> DataFrame:
    """Objects worth correcting: clearly wrong, at most 18 % of the canvas, by error mass."""
    wanted = regions.filter(
        c("kind").isin(FOCUS_KINDS) & (c("box_area") <= canvas_area * 0.18)
        & ((c("high_error_share") >= 0.08) | (c("pixel_mae") >= 0.06)))
    order = Window.partitionBy(*keys).orderBy(c("error_mass").desc(), c("similarity_score"), object_key)
    return wanted.withColumn("focus_rank", F.row_number().over(order)).filter(c("focus_rank") <= k)


def silhouette_metrics(masked: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Shape of the foreground, whatever its colours: IoU, box IoU, area ratio, centroid."""
    r, o = c("ref_mask") > 0, c("out_mask") > 0

    def stats(cond: Column, side: str) -> list[Column]:
        return [F.count_if(cond).alias(f"{side}_area"),
                F.min(F.when(cond, c("x"))).alias(f"_{side}x0"), F.max(F.when(cond, c("x") + 1)).alias(f"_{side}x1"),
                F.min(F.when(cond, c("y"))).alias(f"_{side}y0"), F.max(F.when(cond, c("y") + 1)).alias(f"_{side}y1"),
                F.sum(F.when(cond, c("x"))).alias(f"_{side}sx"), F.sum(F.when(cond, c("y"))).alias(f"_{side}sy")]

    sums = masked.groupBy(*keys).agg(
        *stats(r, "ref"), *stats(o, "out"), F.count_if(r & o).alias("_i"), F.count_if(r | o).alias("_u")).join(sizes, keys)
    box = vl.bbox_iou(*[c(f"_{s}{d}") for s in ("ref", "out") for d in ("x0", "y0", "x1", "y1")])
    biggest = F.greatest("ref_area", "out_area")
    dx = c("_refsx") / c("ref_area") - c("_outsx") / c("out_area")
    dy = c("_refsy") / c("ref_area") - c("_outsy") / c("out_area")
    diagonal = F.greatest(F.lit(1.0), F.sqrt((c("width") * c("width") + c("height") * c("height")).cast("double")))
    both = (c("ref_area") > 0) & (c("out_area") > 0)
    same = c("ref_area") == c("out_area")
    out = sums.withColumns({
        "silhouette_iou": vl.safe_ratio(c("_i"), c("_u"), F.lit(1.0)), "bbox_iou": box,
        "area_ratio": vl.safe_ratio(F.least("ref_area", "out_area"), biggest, F.lit(1.0)),
        "centroid_distance": F.when(both, F.sqrt(dx * dx + dy * dy) / diagonal).when(same, 0.0).otherwise(1.0)})
    out = out.withColumn("centroid_score", F.when(both, F.greatest(F.lit(0.0), 1.0 - c("centroid_distance") * 8.0))
                         .when(same, 1.0).otherwise(0.0))
    w = SILHOUETTE_WEIGHTS
    score = c("silhouette_iou") * w[0] + c("bbox_iou") * w[1] + c("area_ratio") * w[2] + c("centroid_score") * w[3]
    return out.select(*keys, "ref_area", "out_area", "silhouette_iou", "bbox_iou", "area_ratio", "centroid_distance",
                      "centroid_score", score.alias("geometry_score"))


def silhouette_tiles(masked: DataFrame, keys: list[str], parts: int = 4, minimum: int = 64) -> DataFrame:
    """Silhouette IoU of parts×parts tiles of the reference's own box, tiles with enough foreground only."""
    box = masked.filter(c("ref_mask") > 0).groupBy(*keys).agg(
        F.min("x").alias("_x"), (F.max("x") + 1 - F.min("x")).alias("_w"), F.min("y").alias("_y"),
        (F.max("y") + 1 - F.min("y")).alias("_h"), F.count("*").alias("_area"))
    inside = (c("x") >= c("_x")) & (c("x") < c("_x") + c("_w")) & (c("y") >= c("_y")) & (c("y") < c("_y") + c("_h"))
    placed = masked.join(box, keys).filter(inside).withColumns({
        "tile_row": _tile(c("y"), c("_y"), c("_h"), parts), "tile_col": _tile(c("x"), c("_x"), c("_w"), parts)})
    tiles = placed.groupBy(*keys, "tile_row", "tile_col").agg(
        F.sum("ref_mask").alias("reference_pixels"), F.sum(c("ref_mask") * c("out_mask")).alias("_i"),
        F.sum(F.greatest("ref_mask", "out_mask")).alias("_u"), F.max("_area").alias("_area"))
    enough = c("reference_pixels") >= F.greatest(F.lit(minimum), F.bround(c("_area") * 0.01))
    return tiles.filter(enough).select(*keys, "tile_row", "tile_col", "reference_pixels",
                                       vl.safe_ratio(c("_i"), c("_u"), F.lit(1.0)).alias("silhouette_iou"))


def local_silhouette(tiles: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.min("silhouette_iou").alias("worst_local_iou"),
                                    F.percentile("silhouette_iou", 0.1).alias("local_iou_p10"))


def cool_palette(r: Column, g: Column, b: Column) -> Column:
    """Pixels of a blue or teal ramp: neither neutral nor nearly white."""
    low, high = F.least(r, g, b), F.greatest(r, g, b)
    return (b - r >= 3) & (g - r >= 1.5) & (high - low >= 3) & (low < 250)


def color_ramp_profile(pairs: DataFrame, keys: list[str], sizes: DataFrame, channels: list[str], bins: int = 12,
                       minimum: int = 16) -> DataFrame:
    """Median colours along the diagonal, lower left to upper right, one row per usable bin.

    Pair rows carry booleans ``ref_valid`` and ``out_valid``; bins with too few valid pixels on
    either side are left out.
    """
    progress = (c("x") / F.greatest(F.lit(1), c("width") - 1) + 1.0 - c("y") / F.greatest(F.lit(1), c("height") - 1)) / 2.0
    placed = pairs.join(sizes, keys).withColumn("bin", F.floor(progress * bins)).filter(c("bin") < bins)
    out = placed.groupBy(*keys, "bin").agg(
        F.count_if("ref_valid").alias("ref_pixels"), F.count_if("out_valid").alias("out_pixels"),
        *[(F.percentile(F.when(c(f"{s}_valid"), c(f"{s}_{n}")), 0.5) / 255).alias(f"{s}_med_{n}")
          for s in ("ref", "out") for n in channels])
    return out.filter((c("ref_pixels") >= minimum) & (c("out_pixels") >= minimum))


def ramp_metrics(profile: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Weighted error, 95th percentile and centred error of a ramp profile."""
    n = len(channels)
    w = c("ref_pixels")
    centers = profile.groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.count("*").alias("profile_bins"),
        *[(F.sum(w * (c(f"ref_med_{k}") - c(f"out_med_{k}"))) / F.sum(w)).alias(f"_m_{k}") for k in channels])
    rows = profile.join(centers, keys)
    gap = reduce(lambda a, b: a + b, [F.abs(c(f"ref_med_{k}") - c(f"out_med_{k}")) for k in channels]) / n
    flat = reduce(lambda a, b: a + b, [
        F.abs(c(f"ref_med_{k}") - c(f"out_med_{k}") - c(f"_m_{k}")) for k in channels]) / n
    out = rows.groupBy(*keys).agg(
        F.max("profile_bins").alias("profile_bins"), (F.sum(gap * w) / F.max("_w")).alias("profile_mae"),
        F.percentile(gap, 0.95).alias("profile_p95"), (F.sum(flat * w) / F.max("_w")).alias("gradient_profile_mae"))
    zero = F.lit(0.0)
    return out.withColumns({
        "color_similarity": F.greatest(zero, 1.0 - c("profile_mae") * 2.0 - c("profile_p95") * 0.35),
        "gradient_similarity": F.greatest(zero, 1.0 - c("gradient_profile_mae") * 3.0)})


def linear_ramp_fit(pixels: DataFrame, keys: list[str], sizes: DataFrame, channels: list[str]) -> DataFrame:
    """Least-squares plane colour ~ x, y per mask, from one pass of sums; R², strength, ``accepted``.

    x and y run from 0 to 1. The centred normal equations leave a 2×2 system, solved in columns.
    """
    u = c("x") / F.greatest(F.lit(1), c("width") - 1)
    v = c("y") / F.greatest(F.lit(1), c("height") - 1)
    rows = pixels.join(sizes, keys).withColumns({"_u": u.cast("double"), "_v": v.cast("double")})
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.sum("_u").alias("_su"), F.sum("_v").alias("_sv"),
        F.sum(c("_u") * c("_u")).alias("_uu"), F.sum(c("_v") * c("_v")).alias("_vv"), F.sum(c("_u") * c("_v")).alias("_uv"),
        *[a for n in channels for a in (
            F.sum(n).alias(f"_s_{n}"), F.sum(c(n) * c(n)).alias(f"_q_{n}"), F.sum(c("_u") * c(n)).alias(f"_a_{n}"),
            F.sum(c("_v") * c(n)).alias(f"_b_{n}"))])
    n_ = c("pixels")
    suu, svv = c("_uu") - c("_su") * c("_su") / n_, c("_vv") - c("_sv") * c("_sv") / n_
    suv = c("_uv") - c("_su") * c("_sv") / n_
    out = sums.withColumns({"_suu": suu, "_svv": svv, "_suv": suv})
    det = c("_suu") * c("_svv") - c("_suv") * c("_suv")
    out = out.withColumn("_det", det)
    for n in channels:
        su, sv = c(f"_a_{n}") - c("_su") * c(f"_s_{n}") / n_, c(f"_b_{n}") - c("_sv") * c(f"_s_{n}") / n_
        ok = F.abs(c("_det")) > 1e-12
        out = out.withColumns({
            f"slope_x_{n}": F.when(ok, (su * c("_svv") - sv * c("_suv")) / c("_det")),
            f"slope_y_{n}": F.when(ok, (sv * c("_suu") - su * c("_suv")) / c("_det")),
            f"_total_{n}": c(f"_q_{n}") - c(f"_s_{n}") * c(f"_s_{n}") / n_, f"_cu_{n}": su, f"_cv_{n}": sv})

    def total(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts)

    explained = total([c(f"slope_x_{n}") * c(f"_cu_{n}") + c(f"slope_y_{n}") * c(f"_cv_{n}") for n in channels])
    spread = total([c(f"_total_{n}") for n in channels])
    xx = total([c(f"slope_x_{n}") * c(f"slope_x_{n}") for n in channels])
    yy = total([c(f"slope_y_{n}") * c(f"slope_y_{n}") for n in channels])
    xy = total([c(f"slope_x_{n}") * c(f"slope_y_{n}") for n in channels])
    strength = F.sqrt((xx + yy + F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2)
    out = out.withColumns({"r_squared": F.when(spread > 1e-9, explained / spread), "strength": strength})
    accepted = (n_ >= RAMP_PIXELS) & (c("r_squared") >= RAMP_R2) & (c("strength") >= RAMP_STRENGTH)
    return out.withColumn("accepted", F.coalesce(accepted, F.lit(False))).select(
        *keys, "pixels", *[f"slope_{a}_{n}" for n in channels for a in "xy"], "r_squared", "strength", "accepted")


def background_color(pixels: DataFrame, keys: list[str], sizes: DataFrame, channels: list[str]) -> DataFrame:
    """Median of the border pixels per channel; a corner belongs to two borders."""
    times = ((c("y") == 0).cast("int") + (c("y") == c("height") - 1).cast("int") + (c("x") == 0).cast("int")
             + (c("x") == c("width") - 1).cast("int"))
    border = pixels.join(sizes, keys).withColumn("_t", times).filter(c("_t") > 0)
    return border.groupBy(*keys).agg(*[F.bround(F.percentile(n, 0.5, c("_t"))).cast("bigint").alias(n) for n in channels])


def palette(pixels: DataFrame, keys: list[str], channels: list[str], k: int = 12, step: int = 32) -> DataFrame:
    """Colour shares over a fixed grid of buckets, most common first."""
    buckets = [F.floor(c(n) / step).alias(f"bucket_{n}") for n in channels]
    names = [f"bucket_{n}" for n in channels]
    counts = pixels.groupBy(*keys, *buckets).agg(F.count("*").alias("pixels"))
    totals = counts.groupBy(*keys).agg(F.sum("pixels").alias("_t"))
    best = Window.partitionBy(*keys).orderBy(c("pixels").desc(), *names)
    ranked = counts.withColumn("color_rank", F.row_number().over(best)).filter(c("color_rank") <= k)
    return ranked.join(totals, keys).withColumn("share", F.round(c("pixels") / c("_t"), 4)).drop("_t")


def color_runs(pixels: DataFrame, keys: list[str], near: Column, minimum: int) -> DataFrame:
    """Longest horizontal runs of pixels that satisfy ``near``: (keys, y, x0, x1)."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    marked = pixels.filter(near).withColumn("_g", c("x") - F.row_number().over(row))
    return marked.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).filter(
        c("x1") - c("x0") + 1 >= minimum).drop("_g")


def run_blocks(runs: DataFrame, keys: list[str], step: int = 8, min_height: int = BAR_HEIGHT,
               min_aspect: float = BAR_ASPECT) -> DataFrame:
    """Bars: runs on consecutive rows whose ends fall in the same ``step``-wide buckets."""
    ends = runs.withColumns({"_b0": F.floor(c("x0") / step), "_b1": F.floor(c("x1") / step)})
    # Several short runs of a row may share the buckets; the row counts once.
    rows = ends.groupBy(*keys, "_b0", "_b1", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    stack = Window.partitionBy(*keys, "_b0", "_b1").orderBy("y")
    grouped = rows.withColumn("_g", c("y") - F.row_number().over(stack))
    bars = grouped.groupBy(*keys, "_b0", "_b1", "_g").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"))
    return bars.filter((c("height") >= min_height) & (c("width") / c("height") >= min_aspect)).drop("_b0", "_b1", "_g")


def polygon_area(points: DataFrame, keys: list[str], order: str = "seq", width: int = 4096) -> DataFrame:
    """Shoelace area of closed contours. The points go through one exchange, cut into ranges of ``width`` places, so a
    contour of any length is spread out; what joins the ranges, and the last point to the first, are the ranges' end points."""
    place = Window.partitionBy(*keys, "_range").orderBy(order)
    turn = c("x") * F.lead("y").over(place) - F.lead("x").over(place) * c("y")
    point = F.struct(order, "x", "y")
    ranges = points.withColumn("_range", F.floor(c(order) / width)).withColumn("_turn", turn).groupBy(*keys, "_range").agg(
        F.sum("_turn").alias("_turn"), F.min(point).alias("_first"), F.max(point).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_first").over(along), F.first("_first").over(whole))
    return ranges.withColumn("_after", after).groupBy(*keys).agg((F.abs(F.sum(
        F.coalesce("_turn", F.lit(0)) + c("_last.x") * c("_after.y") - c("_after.x") * c("_last.y"))) / 2).alias("area"))


def drop_specks(contours: DataFrame, keys: list[str], share: float = SPECK_SHARE) -> DataFrame:
    """Contours of at least max(1, share of the figure's largest); the largest always stays."""
    largest = contours.groupBy(*keys).agg(F.max("area").alias("_max"))
    return contours.join(largest, keys).filter(
        (c("area") == c("_max")) | (c("area") >= F.greatest(F.lit(1.0), c("_max") * share))).drop("_max")


def ramp_lookup(stops: DataFrame, profile: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Colours of a profile at given positions, linear between points and clamped at the ends.

    A profile has a dozen points; its intervals are joined on the profile and the position.
    """
    order = Window.partitionBy(*keys).orderBy("progress")
    spans = profile.withColumns({
        "_p1": F.lead("progress").over(order), "_first": F.lag("progress").over(order).isNull(),
        **{f"_n_{n}": F.lead(n).over(order) for n in channels}})
    spans = spans.select(*keys, c("progress").alias("_p0"), "_p1", "_first", *[c(n).alias(f"_c_{n}") for n in channels],
                         *[f"_n_{n}" for n in channels])
    hit = ((c("position") >= c("_p0")) | c("_first")) & (c("_p1").isNull() | (c("position") < c("_p1")))
    part = vl.clamp01(F.try_divide(c("position") - c("_p0"), c("_p1") - c("_p0")))
    found = stops.join(spans, keys).filter(hit)
    return found.select(*stops.columns, *[
        F.when(c("_p1").isNull() | (c("position") <= c("_p0")), c(f"_c_{n}").cast("double"))
        .otherwise(c(f"_c_{n}") + part * (c(f"_n_{n}") - c(f"_c_{n}"))).alias(n) for n in channels])
