"""Edit plans as tables: validation, application and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions import text as tx
from deckloom.operators.layout import rule_rows
from deckloom.operators.skew import position, running_sum

c = F.col

# Tolerances in points, aspect slack of a logo, contract limits of a plan.
VERIFY_TOLERANCE_PT, LOGO_ASPECT = 0.15, 0.005
MAX_TOUCHED = {"elements": 4, "components": 2}
MAX_SECTION_OPS = 64
APPLIED_ACTIONS = ["move", "resize", "recolor", "set_fill", "replace_text", "set_font_size", "delete", "duplicate"]
PROTECTED_ACTIONS = ["delete", "replace_text", "duplicate", "recolor", "set_fill", "crop_picture"]
CONTENT_ACTIONS = ["delete", "replace_text", "duplicate"]
LOGO_ACTIONS = ["recolor", "set_fill", "set_border", "crop_picture", "style_table", "style_chart"]
PRESENCE_ACTIONS = ["set_font_size", "set_typography", "set_paragraph", "set_border", "bring_to_front",
                    "send_to_back", "style_table", "style_chart"]
RGB_COLOR = r"^#?[0-9A-Fa-f]{6}$"
FOOTER_WORDS = "footer|source|page_number|confidential"


# ---- slide-graph patches -----------------------------------------------------------------------


def apply_graph_patch(elements: DataFrame, upserts: DataFrame, removes: DataFrame, keys: list[str],
                      id_col: str = "element_id", order: str = "ordinal") -> DataFrame:
    """Delete, replace in place and append; the order of the untouched rows is kept.

    Element ids are unique per slide. New rows come after the slide's last ordinal, in patch
    order (``patch_order``, 0-based).
    """
    body = [n for n in elements.columns if n not in (*keys, id_col, order)]
    kept = elements.join(removes.select(*keys, id_col), [*keys, id_col], "left_anti")
    new = upserts.select(*keys, id_col, "patch_order", F.struct(*body).alias("_new"))
    replaced = kept.join(new.drop("patch_order"), [*keys, id_col], "left").select(
        *keys, id_col, order,
        *[F.when(c("_new").isNotNull(), c(f"_new.{n}")).otherwise(c(n)).alias(n) for n in body])
    last = elements.groupBy(*keys).agg(F.max(order).alias("_last"))
    added = new.join(kept.select(*keys, id_col), [*keys, id_col], "left_anti").join(last, keys, "left").select(
        *keys, id_col, (F.coalesce(c("_last"), F.lit(-1)) + 1 + c("patch_order")).alias(order),
        *[c(f"_new.{n}").alias(n) for n in body])
    return replaced.unionByName(added)


def patch_limits(upserts: DataFrame, removes: DataFrame, patch: str = "patch_id", id_col: str = "element_id",
                 limit: int = MAX_TOUCHED["elements"]) -> DataFrame:
    """Broken patch rules: an id upserted twice, upserted and removed, or too many ids touched."""
    twice = upserts.groupBy(patch, id_col).agg(F.count("*").alias("_n")).filter(c("_n") > 1)
    both = upserts.select(patch, id_col).intersect(removes.select(patch, id_col))
    touched = upserts.select(patch, id_col).union(removes.select(patch, id_col)).distinct().groupBy(patch).agg(
        F.count("*").alias("_n")).filter(c("_n") > limit)
    id_type = dict(upserts.dtypes)[id_col]
    return (twice.select(patch, id_col, F.lit("upserted_twice").alias("rule"))
            .unionByName(both.withColumn("rule", F.lit("upserted_and_removed")))
            .unionByName(touched.select(patch, F.lit(None).cast(id_type).alias(id_col),
                                        F.lit("too_many_touched").alias("rule"))))


# ---- shape operations ----------------------------------------------------------------------------


def _fold(ops: DataFrame, keys: list[str], before: Column | None = None) -> DataFrame:
    """Net effect of the operations of each target.

    The last absolute value wins; relative moves add up after the last absolute one. Only
    combining aggregates: one target with very many operations is never gathered.
    """
    rows = ops if before is None else ops.filter(before)

    def last(value: Column, name: str) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(c("op_seq"), value.alias("v")))).alias(name)

    moves = c("action").isin("move", "resize", "duplicate")
    x, y = F.when(moves, c("x_pt")), F.when(moves, c("y_pt"))
    ends = rows.groupBy(*keys).agg(
        last(x, "_x"), last(y, "_y"), last(F.when(moves, c("width_pt")), "_w"), last(F.when(moves, c("height_pt")), "_h"),
        last(F.when(c("action").isin("recolor", "set_fill") & c("color").rlike(RGB_COLOR),
                    F.concat(F.lit("#"), F.upper(F.regexp_replace("color", "^#", "")))), "_color"),
        last(F.when(c("action") == "replace_text", F.coalesce(c("new_text"), F.lit(""))), "_text"),
        last(F.when(c("action") == "set_font_size", c("font_size_pt")), "_font"),
        F.min(F.when(c("action") == "delete", c("op_seq"))).alias("_deleted"))
    stepped = rows.select(*keys, "op_seq", *[
        F.when(moves & absolute.isNull(), c(d)).alias(d) for d, absolute in (("dx_pt", c("x_pt")), ("dy_pt", c("y_pt")))])
    sums = stepped.join(ends.select(*keys, c("_x.op_seq").alias("_xs"), c("_y.op_seq").alias("_ys")), keys).groupBy(
        *keys).agg(*[F.coalesce(F.sum(F.when(c(s).isNull() | (c("op_seq") > c(s)), c(d))), F.lit(0)).alias(f"_{d}")
                     for d, s in (("dx_pt", "_xs"), ("dy_pt", "_ys"))])
    return ends.join(sums, keys)


def _applied(shapes: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    joined = shapes.join(folded, keys, "left")

    def new(name: str, hit: str) -> Column:
        return F.coalesce(c(f"{hit}.v"), c(name))

    changes = {"x_pt": new("x_pt", "_x") + F.coalesce(c("_dx_pt"), F.lit(0)),
               "y_pt": new("y_pt", "_y") + F.coalesce(c("_dy_pt"), F.lit(0)),
               "w_pt": new("w_pt", "_w"), "h_pt": new("h_pt", "_h"), "fill_color": new("fill_color", "_color"),
               "text": new("text", "_text"), "font_pt": new("font_pt", "_font")}
    return joined.withColumns({n: v for n, v in changes.items() if n in shapes.columns})


def _created(ops: DataFrame, slide: str) -> DataFrame:
    return ops.filter(c("action").isin("duplicate", "group") & c("new_shape_id").isNotNull()).groupBy(
        slide, c("new_shape_id").alias("shape_id")).agg(F.min("op_seq").alias("_born"))


def apply_shape_ops(shapes: DataFrame, ops: DataFrame, slide: str = "slide_id") -> tuple[DataFrame, DataFrame]:
    """Move, resize, recolour, rewrite, font size, delete and duplicate as joins.

    Shapes are unique per (slide, shape_id). ``ops``: slide, op_seq (unique order within the
    slide), action, target_shape_id and the nullable x_pt, y_pt, dx_pt, dy_pt, width_pt,
    height_pt, color, new_text, font_size_pt, new_shape_id. A duplicate copies its source as it
    is at that point; a copy of a copy made by the same plan is a violation here. Returns the
    new shapes and the violations (slide, op_seq, rule). Deleting twice is allowed. An action that is not
    applied here is an ``unsupported_action``: no operation is passed over in silence.
    """
    key = [slide, "shape_id"]
    own = ops.withColumn("shape_id", c("target_shape_id"))
    copies = own.filter(c("action") == "duplicate").select(
        slide, "shape_id", c("new_shape_id").alias("_copy"), c("op_seq").alias("_at"), "op_seq",
        *["x_pt", "y_pt", "dx_pt", "dy_pt", "width_pt", "height_pt"])
    taken = copies.join(shapes.select(slide, c("shape_id").alias("_copy")), [slide, "_copy"], "left_semi")
    copies = copies.join(shapes.select(slide, c("shape_id").alias("_copy")), [slide, "_copy"], "left_anti")
    # Each copy sees the earlier operations on its source, then its own transform.
    plain = own.filter(c("action") != "duplicate")
    seen = plain.join(copies.select(*key, "_copy", "_at"), key).filter(c("op_seq") < c("_at"))
    step = copies.select(*key, "_copy", "_at", F.lit("duplicate").alias("action"), "op_seq", "x_pt", "y_pt", "dx_pt",
                         "dy_pt", "width_pt", "height_pt")
    history = seen.unionByName(step, allowMissingColumns=True)
    effect = _fold(history, [*key, "_copy", "_at"])
    alive = effect.filter(c("_deleted").isNull())
    base = alive.select(*key, "_copy", "_at").join(shapes, key)
    made = _applied(base, alive, [*key, "_copy", "_at"]).select(
        slide, c("_copy").alias("shape_id"), *[n for n in shapes.columns if n not in (slide, "shape_id")])
    everything = shapes.unionByName(made)
    folded = _fold(plain, key)
    result = _applied(everything, folded, key).filter(c("_deleted").isNull()).select(*shapes.columns)

    born = _created(ops, slide)
    # Of the net effect only deletions count here, so the fold of all other values is left out.
    gone = own.filter(c("action") == "delete").groupBy(*key).agg(F.min("op_seq").alias("_deleted"))
    facts = own.join(shapes.select(*key, F.lit(True).alias("_known")), key, "left").join(born, key, "left").join(
        gone, key, "left")
    absent = c("_known").isNull() & (c("_born").isNull() | (c("_born") >= c("op_seq")))
    rules = [
        ("missing_target", (c("action") != "delete") & (absent | F.coalesce(c("_deleted") < c("op_seq"), F.lit(False)))),
        ("invalid_color", c("action").isin("recolor", "set_fill") & ~F.coalesce(c("color").rlike(RGB_COLOR), F.lit(False))),
        ("unsupported_action", ~F.coalesce(c("action").isin(APPLIED_ACTIONS), F.lit(False))),
        ("copy_of_copy", (c("action") == "duplicate") & c("_known").isNull() & c("_born").isNotNull()),
    ]
    violations = rule_rows(facts, [slide, "op_seq"], rules).unionByName(
        taken.select(slide, "op_seq", F.lit("id_exists").alias("rule")))
    return result, violations


def patch_plan_violations(ops: DataFrame, shapes: DataFrame, selected: DataFrame, protected: DataFrame,
                          operation: str = "beautify", slide: str = "slide_id") -> DataFrame:
    """Broken plan rules as (slide, op_seq, rule).

    ``selected`` has the allowed slides, ``protected`` (slide, shape_id). A target or peer may
    also be created by an earlier operation of the plan.
    """
    key = [slide, "shape_id"]
    born = _created(ops, slide)
    target = shapes.select(*key, F.struct("name", "text", "w_pt", "h_pt").alias("_t"))
    facts = (ops.withColumn("shape_id", c("target_shape_id"))
             .join(selected.select(slide, F.lit(True).alias("_sel")), slide, "left")
             .join(target, key, "left").join(born, key, "left")
             .join(protected.select(*key, F.lit(True).alias("_prot")), key, "left"))
    reuse = facts.filter(c("new_shape_id").isNotNull()).select(
        slide, "op_seq", c("new_shape_id").alias("shape_id")).join(
        shapes.select(*key, F.lit(True).alias("_taken")), key, "left").join(
        born.withColumnRenamed("_born", "_first"), key, "left").filter(
        c("_taken").isNotNull() | (c("_first") < c("op_seq")))
    known = c("_t").isNotNull()
    logo = tx.casefold(F.concat_ws(" ", c("_t.name"), c("_t.text"))).contains("logo")
    before = F.try_divide(c("_t.w_pt"), c("_t.h_pt"))
    after = F.try_divide(c("width_pt"), c("height_pt"))
    sized = c("_t.w_pt").isNotNull() & c("_t.h_pt").isNotNull() & c("width_pt").isNotNull() & c("height_pt").isNotNull()
    rules = [
        ("unselected_slide", c("_sel").isNull()),
        ("unknown_target", ~known & (c("_born").isNull() | (c("_born") >= c("op_seq")))),
        ("protected_shape", c("_prot").isNotNull() & c("action").isin(PROTECTED_ACTIONS)),
    ]
    if operation == "beautify":
        rules += [
            ("content_bearing_shape", c("action").isin(CONTENT_ACTIONS) & (~known | (c("_t.text") != ""))),
            ("logo_restyled", known & logo & c("action").isin(LOGO_ACTIONS)),
            ("logo_size_missing", known & logo & (c("action") == "resize") & ~sized),
            ("logo_aspect_changed", known & logo & (c("action") == "resize") & sized
             & (F.try_divide(F.abs(before - after), before) > LOGO_ASPECT)),
        ]
    found = rule_rows(facts, [slide, "op_seq"], rules).unionByName(
        reuse.select(slide, "op_seq", F.lit("new_id_exists").alias("rule")))
    if "peer_shape_ids" in ops.columns:
        peers = ops.select(slide, "op_seq", F.explode("peer_shape_ids").alias("shape_id"))
        unknown = peers.join(shapes.select(*key), key, "left_anti").join(born, key, "left").filter(
            c("_born").isNull() | (c("_born") >= c("op_seq")))
        found = found.unionByName(unknown.select(slide, "op_seq", F.lit("unknown_peer").alias("rule")).distinct())
    return found


def section_selection_violations(ops: DataFrame, selected: DataFrame, deck: str = "deck_id") -> DataFrame:
    """Section operations that name a slide outside the selection: (deck, op_seq, slide_index)."""
    named = ops.select(deck, "op_seq", F.explode("slides").alias("slide_index"))
    return named.join(selected.select(deck, "slide_index"), [deck, "slide_index"], "left_anti")


def verify_operations(before: DataFrame, after: DataFrame, ops: DataFrame, slide: str = "slide_id",
                      tolerance: float = VERIFY_TOLERANCE_PT) -> DataFrame:
    """Whether every operation is visible in the edited shapes: (slide, op_seq, action, passed)."""
    key = [slide, "shape_id"]
    body = ["kind", "text", "x_pt", "y_pt", "w_pt", "h_pt", "fill_color"]
    have = set(ops.columns)

    def opt(name: str, kind: str = "double") -> Column:
        return c(name) if name in have else F.lit(None).cast(kind)

    a = before.select(*key, F.struct(*body).alias("_b"))
    b = after.select(*key, F.struct(*body).alias("_a"))
    made = after.select(slide, c("shape_id").alias("_new"), c("kind").alias("_new_kind"))
    rows = ops.withColumns({"shape_id": c("target_shape_id"), "_new": opt("new_shape_id", "bigint")})
    rows = rows.join(a, key, "left").join(b, key, "left").join(made, [slide, "_new"], "left")
    # Alignment and distribution need all members; at most 65 per operation.
    members = ops.filter(c("action").isin("align", "distribute")).select(
        slide, "op_seq", opt("alignment", "string").alias("_al"),
        F.explode(F.concat(F.array("target_shape_id"), F.coalesce(opt("peer_shape_ids", "array<bigint>"),
                                                                   F.array().cast("array<bigint>")))).alias("shape_id"))
    p = c("_a")
    edge = (F.when(c("_al") == "left", p.x_pt).when(c("_al") == "center", p.x_pt + p.w_pt / 2)
            .when(c("_al") == "right", p.x_pt + p.w_pt).when(c("_al") == "top", p.y_pt)
            .when(c("_al") == "middle", p.y_pt + p.h_pt / 2).otherwise(p.y_pt + p.h_pt))
    spans = members.join(b, key, "left").groupBy(slide, "op_seq").agg(
        F.count("*").alias("_n"), F.count("_a").alias("_found"), (F.max(edge) - F.min(edge)).alias("_span"))
    rows = rows.join(spans, [slide, "op_seq"], "left")
    there = c("_a").isNotNull()

    def near(value: Column, wanted: Column) -> Column:
        return wanted.isNull() | (F.abs(F.coalesce(value, F.lit(0)) - wanted) <= tolerance)

    def moved(axis: str) -> Column:
        shift = F.coalesce(c(f"_a.{axis}_pt"), F.lit(0)) - F.coalesce(c(f"_b.{axis}_pt"), F.lit(0))
        delta = opt(f"d{axis}_pt")
        return F.when(delta.isNotNull(), F.abs(shift - delta) <= tolerance).otherwise(
            near(c(f"_a.{axis}_pt"), opt(f"{axis}_pt")))

    act = c("action")
    together = (c("_n") >= 2) & (c("_found") == c("_n"))
    passed = (
        F.when(act == "delete", ~there)
        .when(act == "replace_text", there & (c("_a.text") == F.coalesce(opt("new_text", "string"), F.lit(""))))
        .when(act.isin("recolor", "set_fill"), there & c("_a.fill_color").eqNullSafe(opt("color", "string")))
        .when(act == "move", there & c("_b").isNotNull() & moved("x") & moved("y"))
        .when(act == "resize", there & near(c("_a.w_pt"), opt("width_pt")) & near(c("_a.h_pt"), opt("height_pt")))
        .when(act == "duplicate", c("_new_kind").isNotNull())
        .when(act == "group", c("_new_kind") == "grpSp")
        .when(act.isin(PRESENCE_ACTIONS), there)
        .when(act == "crop_picture", there & (c("_a.kind") == "pic"))
        .when(act == "align", together & (c("_span") <= tolerance))
        .when(act == "distribute", together)
    )
    return rows.select(slide, "op_seq", "action", F.coalesce(passed, F.lit(False)).alias("passed"))


# ---- arranging groups of shapes (whole EMU; an operation has at most 65 members) -------------------


def align_shapes(members: DataFrame, op_keys: list[str]) -> DataFrame:
    """New x or y of the members of each alignment; columns alignment, x, y, w, h."""
    goal = members.groupBy(*op_keys).agg(
        F.min("x").alias("_left"), F.bround(F.avg(c("x") + c("w") / 2)).alias("_center"),
        F.max(c("x") + c("w")).alias("_right"), F.min("y").alias("_top"),
        F.bround(F.avg(c("y") + c("h") / 2)).alias("_middle"), F.max(c("y") + c("h")).alias("_bottom"))
    al = c("alignment")
    x = (F.when(al == "left", c("_left")).when(al == "center", F.bround(c("_center") - c("w") / 2))
         .when(al == "right", c("_right") - c("w")).otherwise(c("x")))
    y = (F.when(al == "top", c("_top")).when(al == "middle", F.bround(c("_middle") - c("h") / 2))
         .when(al == "bottom", c("_bottom") - c("h")).otherwise(c("y")))
    return members.join(goal, op_keys).withColumns({"x": x.cast("bigint"), "y": y.cast("bigint")}).drop(
        "_left", "_center", "_right", "_top", "_middle", "_bottom")


def distribute_shapes(members: DataFrame, op_keys: list[str], horizontal: bool = True,
                      id_col: str = "shape_id") -> DataFrame:
    """Equal gaps between the first and the last member of each operation.

    Places and widths are summed up by ranges of the position, so an operation on very many members is split.
    """
    pos, size = ("x", "w") if horizontal else ("y", "h")
    ends = members.groupBy(*op_keys).agg(
        F.min(pos).alias("_lead"), F.max(F.struct(c(pos), c(id_col), (c(pos) + c(size)).alias("end")))["end"].alias("_trail"),
        F.sum(size).alias("_occupied"), F.count("*").alias("_n"))
    cut = F.floor(c(pos) / (1 << 20))
    placed = position(running_sum(members, op_keys, [pos, id_col], size, "_upto", cut), op_keys, [pos, id_col], "_place", cut)
    gap = (c("_trail") - c("_lead") - c("_occupied")) / F.greatest(F.lit(1), c("_n") - 1)
    moved = F.bround(c("_lead") + c("_upto") - c(size) + (c("_place") - 1) * gap).cast("bigint")
    return placed.join(ends, op_keys).withColumn(pos, moved).drop("_upto", "_place", "_lead", "_trail", "_occupied", "_n")


def z_reorder(shapes: DataFrame, ops: DataFrame, slide: str = "slide_id") -> DataFrame:
    """New ``z`` after bring-to-front and send-to-back; the others keep their relative order.

    The last operation on a shape decides. Later fronts are above earlier ones, later backs
    below earlier ones. Positions are counted by ranges, so one huge slide is split.
    """
    last = ops.filter(c("action").isin("bring_to_front", "send_to_back")).groupBy(
        slide, c("target_shape_id").alias("shape_id")).agg(F.max(F.struct("op_seq", "action")).alias("_o"))
    joined = shapes.join(last, [slide, "shape_id"], "left")
    layer = F.when(c("_o.action") == "send_to_back", 0).when(c("_o.action") == "bring_to_front", 2).otherwise(1)
    rank = F.when(layer == 0, -c("_o.op_seq")).when(layer == 2, c("_o.op_seq")).otherwise(c("z")).cast("bigint")
    joined = joined.withColumns({"_layer": layer, "_rank": rank})
    cut = F.struct("_layer", F.floor(c("_rank") / 4096))
    return position(joined, [slide], ["_layer", "_rank"], "_z", cut).drop("z", "_layer", "_rank", "_o").withColumnRenamed(
        "_z", "z")


# ---- sections, plan merging, notes -----------------------------------------------------------------


def sections_apply(sections: DataFrame, ops: DataFrame, deck: str = "deck_id") -> tuple[DataFrame, DataFrame]:
    """Add, remove and rename sections in order; returns (sections, violations).

    ``sections``: deck, position, name, slides array; ``ops``: deck, op_seq, action, name,
    new_name, slides array. An added section takes its slides from the others and emptied
    sections vanish. The plan of a deck is one ordered fold and is applied whatever its size; more
    than 64 operations break the contract and are reported beside the result.
    """
    counts = ops.groupBy(deck).agg(F.count("*").alias("_n"))
    too_many = counts.filter(c("_n") > MAX_SECTION_OPS).select(deck)
    steps = ops.groupBy(deck).agg(F.array_sort(F.collect_list(
        F.struct("op_seq", "action", "name", "new_name", "slides"))).alias("_ops"))
    start = sections.groupBy(deck).agg(F.array_sort(F.collect_list(
        F.struct("position", "name", "slides"))).alias("_s")).select(
        deck, F.transform("_s", lambda s: F.struct(s["name"].alias("name"), s.slides.alias("slides"))).alias("_s"))
    joined = start.join(steps, deck, "full_outer")
    row = "array<struct<name:string,slides:array<bigint>>>"
    state = f"struct<s:{row},e:array<struct<op_seq:bigint,rule:string>>>"
    init = F.struct(F.coalesce(c("_s").cast(row), F.array().cast(row)).alias("s"),
                    F.array().cast("array<struct<op_seq:bigint,rule:string>>").alias("e")).cast(state)

    def step(acc: Column, op: Column) -> Column:
        low = F.lower(op["name"])
        exists = F.exists(acc.s, lambda s: F.lower(s["name"]) == low)
        freed = F.filter(F.transform(acc.s, lambda s: F.struct(
            s["name"].alias("name"), F.array_except(s.slides, op.slides.cast("array<bigint>")).alias("slides"))),
            lambda s: F.size(s.slides) > 0)
        added = F.array_append(freed, F.struct(op["name"].alias("name"), op.slides.cast("array<bigint>").alias("slides")))
        removed = F.filter(acc.s, lambda s: F.lower(s["name"]) != low)
        renamed = F.transform(acc.s, lambda s: F.struct(
            F.when(F.lower(s["name"]) == low, F.coalesce(op.new_name, op["name"])).otherwise(s["name"]).alias("name"),
            s.slides.alias("slides")))
        wrong = F.when((op.action == "add") & exists, "section_exists").when(
            (op.action != "add") & ~exists, "section_not_found")
        new = F.when(wrong.isNotNull(), acc.s).when(op.action == "add", added).when(
            op.action == "remove", removed).otherwise(renamed)
        errors = F.when(wrong.isNotNull(), F.array_append(acc.e, F.struct(
            op.op_seq.cast("bigint").alias("op_seq"), wrong.alias("rule")))).otherwise(acc.e)
        return F.struct(new.alias("s"), errors.alias("e")).cast(state)

    no_ops = F.array().cast(dict(steps.dtypes)["_ops"])
    done = joined.select(deck, F.aggregate(F.coalesce(c("_ops"), no_ops), init, step).alias("_r"))
    result = done.select(deck, F.posexplode("_r.s").alias("position", "_x")).select(
        deck, "position", c("_x.name").alias("name"), c("_x.slides").alias("slides"))
    errors = done.select(deck, F.explode("_r.e").alias("_x")).select(deck, "_x.op_seq", "_x.rule")
    breach = too_many.select(deck, F.lit(None).cast("bigint").alias("op_seq"), F.lit("too_many_operations").alias("rule"))
    return result, errors.unionByName(breach)


def merge_operations(ops: DataFrame, slide: str = "slide_index", op: str = "op_id") -> DataFrame:
    """Operations of per-slide plans under one plan: ids prefixed with their slide."""
    return ops.withColumn(op, F.concat(F.lit("s"), c(slide).cast("string"), F.lit("-"), c(op).cast("string")))


def merge_section_operations(ops: DataFrame, op: str = "op_id") -> DataFrame:
    return ops.withColumn(op, F.concat(F.lit("section-"), c(op).cast("string")))


def merge_summaries(plans: DataFrame, deck: str, order: str) -> DataFrame:
    """Distinct plan summaries of a deck, each with its first plan; one row per summary, so that
    a deck with very many plans is never put together in one task."""
    return plans.groupBy(deck, "summary").agg(F.min(order).alias("first_plan"))


def merge_protected(plans: DataFrame, deck: str, order: str) -> DataFrame:
    """Distinct protected ids of a deck with the plan that named them first."""
    long = plans.select(deck, order, F.posexplode("protected_ids").alias("_p", "protected_id"))
    return long.groupBy(deck, "protected_id").agg(F.min(F.struct(order, "_p")).alias("_f")).select(
        deck, "protected_id", c(f"_f.{order}").alias("first_plan"), c("_f._p").alias("first_position"))


def note_layout_report(before: DataFrame, after: DataFrame, upserts: DataFrame, removes: DataFrame,
                       targets: DataFrame, notes: DataFrame, slides: DataFrame, minimum_font_pt: float,
                       slide: str = "slide_id", id_col: str = "element_id") -> DataFrame:
    """Readability and reflow of a note edit, one row per slide.

    ``after`` elements: kind, name, text, font_size_pt, line_spacing, height. ``targets`` are the
    objects the notes name, ``notes`` the note elements themselves, ``slides`` has requires_reflow.
    """
    key = [slide, id_col]
    touched = after.join(upserts.select(*key).distinct(), key, "left_semi").filter(c("kind") == "text")
    identity = F.lower(F.concat_ws(" ", c(id_col).cast("string"), c("name")))
    small = ~identity.rlike(FOOTER_WORDS) & (c("font_size_pt") + 1e-6 < minimum_font_pt)
    lines = F.greatest(F.lit(1), F.size(F.split(F.regexp_replace("text", r"\R$", ""), r"\R")))
    clipped = lines * c("font_size_pt") * 1.333 * c("line_spacing") > c("height") * 1.15
    text = touched.groupBy(slide).agg(F.count_if(small).alias("_u"), F.count_if(clipped).alias("_c"))
    moved = upserts.select(*key).union(removes.select(*key)).distinct().join(before.select(*key), key, "left_semi").join(
        targets.select(*key), key, "left_anti").join(notes.select(*key), key, "left_anti").groupBy(slide).agg(
        F.count("*").alias("_d"))
    out = slides.join(text, slide, "left").join(moved, slide, "left").withColumns({
        "undersized": F.coalesce(c("_u"), F.lit(0)), "clipped": F.coalesce(c("_c"), F.lit(0)),
        "dependents_moved": F.coalesce(c("_d"), F.lit(0))}).drop("_u", "_c", "_d")
    adjusted = ~c("requires_reflow") | (c("dependents_moved") > 0)
    return out.withColumns({"dependents_adjusted": adjusted,
                            "valid": (c("undersized") == 0) & (c("clipped") == 0) & adjusted})
