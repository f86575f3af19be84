"""Component library instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

# Fixed value: the unit box that component fonts are drawn for, in pixels.
UNIT_BOX_PX = 96


def dangling_components(instances: DataFrame, components: DataFrame) -> DataFrame:
    """Instances that refer to no component."""
    return instances.join(components.select("component_id"), "component_id", "left_anti")


def expand_components(instances: DataFrame, primitives: DataFrame) -> DataFrame:
    """Place every primitive of a component in its instance's box.

    ``instances``: component_id, x, y, width, height, rotation_deg, layer and keys;
    ``primitives``: component_id, primitive_id, ux, uy, uw, uh (unit box), rotation_deg, layer,
    font_size_pt, margin_px; the last four optional on both sides.
    """

    def named(df: DataFrame, name: str, default):
        return c(name) if name in df.columns else F.lit(default)

    inst = instances.withColumns({"_rot": named(instances, "rotation_deg", 0).cast("double"),
                                  "_layer": named(instances, "layer", 0).cast("double")})
    prim = primitives.select(
        "component_id", "primitive_id", "ux", "uy", "uw", "uh",
        named(primitives, "rotation_deg", 0).cast("double").alias("_prot"),
        named(primitives, "layer", 0).cast("double").alias("_player"),
        named(primitives, "font_size_pt", None).cast("double").alias("_font"),
        named(primitives, "margin_px", None).cast("double").alias("_margin"))
    both = inst.join(prim, "component_id").withColumns({
        "_w": c("uw") * c("width"), "_h": c("uh") * c("height"),
        "_cos": F.cos(F.radians("_rot")), "_sin": F.sin(F.radians("_rot"))})
    both = both.withColumns({
        "_cx": c("x") + c("width") / 2, "_cy": c("y") + c("height") / 2,
        "_dx": c("x") + c("ux") * c("width") + c("_w") / 2 - (c("x") + c("width") / 2),
        "_dy": c("y") + c("uy") * c("height") + c("_h") / 2 - (c("y") + c("height") / 2)})
    turned = c("_rot") != 0
    keep = [n for n in instances.columns if n not in ("x", "y", "width", "height", "rotation_deg", "layer")]
    return both.select(
        *keep, "primitive_id",
        F.when(turned, c("_cx") + c("_dx") * c("_cos") - c("_dy") * c("_sin") - c("_w") / 2)
        .otherwise(c("x") + c("ux") * c("width")).alias("x"),
        F.when(turned, c("_cy") + c("_dx") * c("_sin") + c("_dy") * c("_cos") - c("_h") / 2)
        .otherwise(c("y") + c("uy") * c("height")).alias("y"),
        c("_w").alias("width"), c("_h").alias("height"),
        (c("_rot") + c("_prot")).alias("rotation_deg"), (c("_layer") + c("_player") / 1000).alias("layer"),
        (c("_font") * (c("height") / UNIT_BOX_PX)).alias("font_size_pt"),
        (c("_margin") * (c("height") / UNIT_BOX_PX)).alias("margin_px"))
