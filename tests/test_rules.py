"""Rules on hand-made rows with hand-computed answers."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from deckloom.functions import text as tx
from deckloom.functions import values as vl
from deckloom.operators import catalog, content, evaluation, gates, layout, package, patches, pixels, shapes, slots
from deckloom.operators.components import expand_components

c = F.col


def one(table, value, expr):
    return table([(value,)], "v string").select(expr(c("v")).alias("r")).first().r


@pytest.mark.parametrize("text,expected", [
    ("sales 1 250,5 and 1.5 or 1,5", ["1250,5", "1.5", "1,5"]), ("x2 2x 12% -3 a-4", ["12%", "-3", "4"]),
    ("1'000 (7)", ["1'000", "7"]), ("1 000", ["1", "000"])])
def test_numbers(table, text, expected):
    assert one(table, text, tx.numbers) == expected


def test_words_fold_case(table):
    assert one(table, "Straße d’Été can't x_y 9", tx.words) == ["strasse", "d’été", "can't", "x", "y"]


@pytest.mark.parametrize("source,target,expected", [
    ("ppt/slides/slide1.xml", "../media/a.png", "ppt/media/a.png"), ("ppt/presentation.xml", "slides/s.xml", "ppt/slides/s.xml"),
    ("", "ppt/presentation.xml", "ppt/presentation.xml"), ("ppt/x.xml", "/docProps/app.xml", "docProps/app.xml"),
    ("a.xml", "../../b.xml", "../../b.xml")])
def test_resolve_target(table, source, target, expected):
    assert table([(source, target)], "s string, t string").select(
        tx.resolve_target(c("s"), c("t")).alias("r")).first().r == expected


def test_hex_names_and_hashes(table):
    assert [one(table, v, vl.normalize_hex) for v in (" #abc", "0f0F0f", "12345", "gggggg")] == [
        "#AABBCC", "#0F0F0F", None, None]
    assert [one(table, v, vl.valid_hex) for v in (" #abc", "0f0F0f", "12345", "gggggg", "##AABBCC", "")] == [
        True, True, False, False, True, False]
    assert [one(table, v, tx.safe_name) for v in ("../a/b?.txt", " .x. ", "é_1-2.pptx")] == ["b.txt", "x", "é_1-2.pptx"]
    got = table([("0" * 16, "f" + "0" * 15), (None, "0" * 16), ("8" + "0" * 15, "0" * 15 + "1")], "a string, b string").select(
        vl.hamming_hex(c("a"), c("b")).alias("d"))
    assert [r.d for r in got.collect()] == [4, 64, 2]


# ---- layout ---------------------------------------------------------------------------------------


BOX = "kind string, id string, x double, y double, width double, height double, rotation_deg double"


def test_clamp_cuts_image_source_and_drops_outside(table):
    df = table([("image", "i", -50.0, 0.0, 100.0, 50.0, 0.0, 0.0, 0.0, 200.0, 100.0),
                ("shape", "gone", 120.0, 0.0, 10.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0),
                ("shape", "ok", 1.0, 1.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
               BOX + ", source_x double, source_y double, source_width double, source_height double")
    out = layout.clamp_to_canvas(df, 100, 100)
    assert rows(out, "id", "x", "width", "source_x", "source_width", "clamp") == [
        ("i", 0.0, 50.0, 100.0, 100.0, "changed"), ("ok", 1.0, 2.0, 0.0, 0.0, "kept")]


def test_clamp_moves_rotated_boxes_inside(table):
    out = layout.clamp_to_canvas(table([("shape", "r", 0.0, 40.0, 40.0, 20.0, 90.0)], BOX), 100, 100).first()
    # A quarter turn is 20 wide and 40 high around (20, 50): it already fits.
    assert (out.clamp, round(out.x, 6), round(out.y, 6)) == ("kept", 0, 40)
    out = layout.clamp_to_canvas(table([("shape", "r", 0.0, 0.0, 40.0, 20.0, 90.0)], BOX), 100, 100).first()
    assert (out.clamp, round(out.x, 6), round(out.y, 6)) == ("changed", 0, 10)


def test_clamp_lines(table):
    df = table([("line", "l", 0.0, 0.0, 0.0, 0.0, 0.0, -5.0, 3.0, 120.0, 50.0)],
               BOX + ", x1 double, y1 double, x2 double, y2 double")
    assert rows(layout.clamp_to_canvas(df, 100, 100), "x1", "y1", "x2", "y2", "clamp") == [(0.0, 3.0, 100.0, 50.0, "changed")]


def test_size_classes_and_margins(table):
    df = table([(13.333, 7.5), (10.0, 10.0), (8.268, 11.693), (0.0, 5.0)], "w double, h double")
    df = df.withColumn("s", layout.size_class(c("w"), c("h")))
    m = layout.safe_margins(c("s"), c("w"), c("h"))
    got = df.select("s", m["margin_top"].alias("t"), m["margin_left"].alias("l")).collect()
    assert [(r.s, r.t, r.l) for r in got] == [("landscape", 0.45, 0.5), ("square", 0.6, 0.6), ("portrait", 0.5761, 0.4561),
                                             ("landscape", 0.3, 0.35)]


def test_page_assign_splits_clamps_and_drops(table):
    df = table([(1, "a", "shape", None, 1.0, 1.0, 4.0, 2.0), (1, "b", "shape", None, 1.0, 9.0, 4.0, 2.0),
                (1, "c", "shape", None, 1.0, 30.0, 4.0, 2.0), (1, "d", "text", "hi", 1.0, 7.0, 1.0, 9.0)],
               "slide_id int, id string, type string, text string, x double, y double, w double, h double")
    out = layout.page_assign(df, 10.0, 7.5)
    assert rows(out, "id", "page", "action") == [("a", 0, "none"), ("b", 1, "split"), ("c", 2, "split"), ("d", 0, "resize")]
    # Without splitting everything stays on the first page; short text may go.
    out = layout.page_assign(df, 10.0, 7.5, allow_split=False, allow_deletion=True)
    assert rows(out, "id", "page", "y", "action") == [
        ("a", 0, 1.0, "none"), ("b", 0, 5.4, "clamp"), ("c", 0, 5.4, "clamp"), ("d", None, 0.1, "drop")]


def test_constraint_rules(table):
    cmd = "array<struct<op:string,x:double,y:double,x1:double,y1:double,x2:double,y2:double>>"
    df = table([
        ("ok", 0.5, [("M", 0.0, 0.0, None, None, None, None), ("Z",) + (None,) * 6]),
        ("bad", 1.5, [("L", 0.0, None, None, None, None, None)]),
        ("curve", 1.0, [("M", 0.0, 0.0, None, None, None, None), ("C", 1.0, 1.0, 1.0, 1.0, None, None)])],
        f"id string, opacity double, commands {cmd}")
    assert rows(layout.constraint_violations(df, ["id"]), "id", "rule") == [
        ("bad", "opacity_out_of_range"), ("bad", "path_coordinates_missing"), ("bad", "path_not_started"),
        ("bad", "path_too_short"), ("curve", "path_coordinates_missing")]


# ---- content --------------------------------------------------------------------------------------


def facts(table, data):
    return table(data, "deck_id int, slide_index int, fact string, value string")


def slides(table, *numbers):
    return table([(1, n) for n in numbers], "deck_id int, slide_index int")


def test_invariants_case_words_logos_and_slide_count(table):
    text = table([(1, 1, "Hello World"), (1, 2, "Keep 5")], "deck_id int, slide_index int, text string")
    upper = table([(1, 1, "HELLO world"), (1, 2, "Keep 5 5")], "deck_id int, slide_index int, text string")
    keys = ["deck_id", "slide_index"]
    before = content.tokens(text, keys).unionByName(facts(table, [(1, 1, "image", "h1"), (1, 1, "logo", "h1"), (1, 2, "image", "h2")]))
    after = content.tokens(upper, keys).unionByName(facts(table, [(1, 1, "image", "h9"), (1, 2, "image", "h2")]))
    found = content.invariant_pairs(before, after, slides(table, 1, 2, 3), slides(table, 1, 2))
    assert rows(found, "slide_index", "code") == [
        (1, "images_changed"), (1, "logos_changed"), (2, "numbers_changed"), (None, "slide_count_changed")]
    checks = content.check_rollup(slides(table, 1), found).first()
    assert (checks.words, checks.numbers, checks.assets, checks.slide_count, checks.passed) == (True, False, False, False, False)
    assert content.check_map(content.check_rollup(slides(table, 1), found)).first().checks["words"] is True


def test_content_preserved_ignores_executed_notes(table):
    before = table([(1, "Please  move"), (1, "Title"), (1, "Title")], "slide_id int, text string")
    after = table([(1, "Title")], "slide_id int, text string")
    removed = table([("Please move",)], "text string")
    assert rows(content.content_preserved(before, after, removed, ["slide_id"]), "text", "missing") == [("Title", 1)]


def test_production_notes(table):
    df = table([("Box", "Please move the logo", True), ("Box", "Please move the logo", False), ("Instruction 1", "Some long text here", False),
                ("Box", "Merci de supprimer ceci", True), ("Box", "Supprimez cette image", True), ("Box", "add", True)],
               "name string, text string, bold boolean")
    assert rows(content.production_notes(df), "name", "text", "bold") == [
        ("Box", "Merci de supprimer ceci", True), ("Box", "Please move the logo", True), ("Box", "Supprimez cette image", True),
        ("Instruction 1", "Some long text here", False)]
    graph = table([("text", "n", "Production note", "x", False), ("text", "t", "T", "Please update this figure", True),
                   ("shape", "instruction", "S", None, False)], "kind string, id string, name string, text string, bold boolean")
    assert rows(content.graph_notes(graph), "id") == [("n",), ("t",)]


def test_secret_scan_skips_placeholders(table):
    key = "sk-" + "A1" * 12
    df = table([("a.txt", "x " + key), ("b.txt", "sk-example" + "A1" * 12), ("d/.env.local", None), ("d/.env.example", ""),
                ("k.pem", "-----BEGIN RSA " + "PRIVATE KEY-----"), ("x.PNG", None)], "path string, content string")
    assert rows(content.secret_scan(df), "path", "rule") == [
        ("a.txt", "api_key"), ("d/.env.local", "environment_file"), ("k.pem", "private_key"), ("x.PNG", "forbidden_suffix")]
    lines = table([(".env",), ("# out/",), ("*.pptx ",)], "line string")
    assert rows(content.missing_rules(lines, [".env", "out/", "*.pptx"]), "rule") == [("out/",)]


def test_font_floor_and_portable_fonts(table):
    df = table([("Body", "text", 7.5), ("Footnote", "text", 6.0), ("Body", "Source: us", 5.5)], "name string, text string, size_pt double")
    assert rows(layout.font_floor(df), "size_pt", "minimum_pt") == [(5.5, 6.0), (7.5, 8.0)]
    fonts = package.portable_fonts(table([("Inter",), ("ARIAL",), ("Source Serif",), ("JetBrains Mono",)], "font_family string"))
    assert rows(fonts, "requested_font", "font_family") == [
        ("Inter", "Arial"), ("JetBrains Mono", "Courier New"), ("Source Serif", "Times New Roman"), (None, "ARIAL")]


# ---- patches --------------------------------------------------------------------------------------


OPS = ("slide_id int, op_seq bigint, action string, target_shape_id bigint, x_pt double, y_pt double, dx_pt double, dy_pt double, "
       "width_pt double, height_pt double, color string, new_text string, font_size_pt double, new_shape_id bigint")
SHAPES = ("slide_id int, shape_id bigint, kind string, name string, text string, x_pt double, y_pt double, w_pt double, h_pt double, "
          "fill_color string, font_pt double")


def op(seq, action, target, **values):
    names = [f.split()[0] for f in OPS.split(", ")][4:]
    return (1, seq, action, target, *[values.get(n) for n in names])


def shape(number, name="box", text="", kind="sp", x=0.0, y=0.0, w=10.0, h=20.0):
    return (1, number, kind, name, text, x, y, w, h, "#000000", 12.0)


def test_apply_shape_ops_folds_in_order(table):
    plan = table([
        op(1, "move", 1, dx_pt=5.0, dy_pt=1.0), op(2, "move", 1, x_pt=100.0, dy_pt=1.0), op(3, "move", 1, dx_pt=-2.0),
        op(4, "resize", 1, width_pt=33.0), op(5, "recolor", 1, color="#AA0000"), op(6, "replace_text", 2, new_text="new"),
        op(7, "duplicate", 1, new_shape_id=9, dx_pt=10.0), op(8, "move", 9, dy_pt=50.0), op(9, "recolor", 1, color="#00BB00"),
        op(10, "delete", 3), op(11, "delete", 3), op(12, "move", 3, dx_pt=1.0), op(13, "move", 77, dx_pt=1.0),
        op(14, "duplicate", 2, new_shape_id=1), op(15, "set_font_size", 2, font_size_pt=18.0),
        op(16, "align", 1), op(17, "nonsense", 2)], OPS)
    out, bad = patches.apply_shape_ops(table([shape(1), shape(2, text="old"), shape(3)], SHAPES), plan)
    assert rows(out, "shape_id", "x_pt", "y_pt", "w_pt", "fill_color", "text", "font_pt") == [
        (1, 98.0, 2.0, 33.0, "#00BB00", "", 12.0), (2, 0.0, 0.0, 10.0, "#000000", "new", 18.0),
        (9, 108.0, 52.0, 33.0, "#AA0000", "", 12.0)]
    assert rows(bad, "op_seq", "rule") == [(12, "missing_target"), (13, "missing_target"), (14, "id_exists"),
                                             (16, "unsupported_action"), (17, "unsupported_action")]


def test_patch_plan_rules(table):
    plan = table([
        op(1, "duplicate", 1, new_shape_id=9), op(2, "move", 9), op(3, "move", 8), op(4, "duplicate", 1, new_shape_id=9),
        op(5, "resize", 2, width_pt=20.0, height_pt=10.0), op(6, "recolor", 2, color="#FFFFFF"), op(7, "delete", 3),
        op(8, "resize", 2, width_pt=20.0, height_pt=40.0), op(9, "recolor", 1, color="#FFFFFF"), op(10, "resize", 2)], OPS)
    base = table([shape(1), shape(2, name="Company Logo", kind="pic"), shape(3, text="words")], SHAPES)
    picked, guarded = table([(1,)], "slide_id int"), table([(1, 1)], "slide_id int, shape_id bigint")
    found = patches.patch_plan_violations(plan, base, picked, guarded)
    assert rows(found, "op_seq", "rule") == [
        (1, "protected_shape"), (3, "unknown_target"), (4, "new_id_exists"), (4, "protected_shape"), (5, "logo_aspect_changed"),
        (6, "logo_restyled"), (7, "content_bearing_shape"), (9, "protected_shape"), (10, "logo_size_missing")]
    notes = patches.patch_plan_violations(plan, base, picked.filter("false"), guarded.filter("false"), "notes")
    assert {r.rule for r in notes.collect()} == {"unselected_slide", "unknown_target", "new_id_exists"}
    peers = plan.withColumn("peer_shape_ids", F.when(c("op_seq") == 2, F.array(F.lit(1).cast("bigint"), F.lit(55).cast("bigint"))))
    found = patches.patch_plan_violations(peers, base, picked, guarded.filter("false"), "notes")
    assert (2, "unknown_peer") in rows(found, "op_seq", "rule")


def test_verify_operations(table):
    before = table([shape(1), shape(2, x=50.0), shape(3, text="t")], SHAPES)
    after = table([shape(1, x=5.1), shape(2, x=5.0, kind="pic"), shape(9, kind="grpSp")], SHAPES)
    plan = table([op(1, "move", 1, dx_pt=5.0), op(2, "move", 2, dx_pt=1.0), op(3, "delete", 3), op(4, "align", 1),
                  op(5, "group", 1, new_shape_id=9), op(6, "crop_picture", 2), op(7, "set_border", 3), op(8, "distribute", 1)], OPS)
    plan = plan.withColumns({"alignment": F.lit("left"), "peer_shape_ids": F.when(
        c("action") == "align", F.array(F.lit(2).cast("bigint"))).otherwise(F.array(F.lit(3).cast("bigint")))})
    assert [r[1] for r in rows(patches.verify_operations(before, after, plan), "op_seq", "passed")] == [
        True, False, True, True, True, True, False, False]


def test_sections(table):
    have = table([("d", 0, "Intro", [1, 2]), ("d", 1, "Body", [3])], "deck_id string, position int, name string, slides array<bigint>")
    schema = "deck_id string, op_seq bigint, action string, name string, new_name string, slides array<bigint>"
    plan = table([("d", 1, "add", "End", None, [2, 3]), ("d", 2, "rename", "intro", "Start", []), ("d", 3, "remove", "Body", None, []),
                  ("d", 4, "add", "END", None, [1])] + [("e", i, "add", f"s{i}", None, [i]) for i in range(100)], schema)
    out, bad = patches.sections_apply(have, plan)
    assert rows(out.filter("deck_id = 'd'"), "position", "name", "slides") == [(0, "Start", [1]), (1, "End", [2, 3])]
    assert rows(out.filter("deck_id = 'e'"), "position", "name", "slides") == [(i, f"s{i}", [i]) for i in range(100)]
    assert rows(bad, "deck_id", "op_seq", "rule") == [
        ("d", 3, "section_not_found"), ("d", 4, "section_exists"), ("e", None, "too_many_operations")]


def test_far_pages_keep_their_own(table):
    far = table([(1, i, "shape", "x", 1.0, 1000.0 * (i + 2), 1.0, 1.0) for i in range(3)],
                "slide_id int, shape_id int, type string, text string, x double, y double, w double, h double")
    got = rows(layout.page_assign(far, 13.333, 7.5), "shape_id", "page", "action")
    assert got == [(0, 0, "split"), (1, 1, "split"), (2, 2, "split")]


def test_align_distribute_group(table):
    m = table([(1, 1, "center", 0, 0, 10, 10), (1, 2, "center", 100, 7, 30, 10)], "op int, shape_id int, alignment string, x int, y int, w int, h int")
    # Centres 5 and 115: the goal is 60.
    assert rows(patches.align_shapes(m, ["op"]), "shape_id", "x") == [(1, 55), (2, 45)]
    d = table([(1, 1, 0, 10), (1, 2, 12, 20), (1, 3, 90, 10)], "op int, shape_id int, x int, w int")
    assert rows(patches.distribute_shapes(d, ["op"]), "shape_id", "x") == [(1, 0), (2, 40), (3, 90)]
    s = table([(1, 1, 5, 5, 10, 10, 3), (1, 2, 20, 0, 5, 5, 2)], "slide int, shape_id int, x_pt int, y_pt int, w_pt int, h_pt int, z int")
    g = shapes.group_bounds(s, table([(1, 1, "g"), (1, 2, "g")], "slide int, shape_id int, group_id string"), ["slide"])
    assert rows(g, "x_pt", "y_pt", "w_pt", "h_pt", "insert_at") == [(5, 0, 20, 15, 2)]


def test_note_layout_report(table):
    schema = "slide_id int, element_id string, kind string, name string, text string, font_size_pt double, line_spacing double, height double"
    after = table([(1, "a", "text", "A", "one\ntwo", 10.0, 1.0, 20.0), (1, "footer", "text", "F", "x", 4.0, 1.0, 30.0),
                   (1, "b", "text", "B", "x", 5.0, 1.0, 30.0)], schema)
    ids = lambda *names: table([(1, n) for n in names], "slide_id int, element_id string")
    out = patches.note_layout_report(after, after, ids("a", "footer", "b"), ids(), ids("a", "b", "footer"), ids("n"),
                                     table([(1, True)], "slide_id int, requires_reflow boolean"), 7.0).first()
    # Two lines of 10 pt need 26.66, more than 1.15 times 20.
    assert (out.undersized, out.clipped, out.dependents_moved, out.dependents_adjusted, out.valid) == (1, 1, 0, False, False)


def test_slot_plan(spark, table):
    plans = table([(1, "reflow")], "slide_id int, strategy string")
    outs = table([(1, 0, "title_body")], "slide_id int, output_no int, template_id string")
    els = table([(1, "t", "text", "content", []), (1, "b", "text", "content", ["b1", "b2"]), (1, "i", "image", "content", []),
                 (1, "z", "shape", "decorative", [])], "slide_id int, element_id string, type string, role string, block_ids array<string>")
    asg = table([(1, 0, 1, "t", "title", False, []), (1, 0, 2, "b", "body", False, ["b1", "b9"]), (1, 0, 3, "t", "body", False, []),
                 (1, 0, 4, "i", "title", False, []), (1, 0, 5, "z", "title", False, []), (1, 0, 6, "t", "nope", False, [])],
                "slide_id int, output_no int, assign_no int, element_id string, slot_id string, repeat boolean, block_ids array<string>")
    found = slots.slot_assignment_violations(plans, outs, asg, els, slots.template_slots(spark))
    assert rows(found, "rule", "subject") == [
        ("block_not_covered", "b2"), ("element_omitted", "i"), ("incompatible_slot", "i"), ("reused_without_repeat", "t"),
        ("unknown_block", "b9"), ("unknown_element", "z"), ("unknown_slot", "nope")]


def test_components_rotate_with_their_instance(table):
    inst = table([("s", "k", 100.0, 100.0, 40.0, 20.0, 90.0, 3)],
                 "slide_id string, component_id string, x double, y double, width double, height double, rotation_deg double, layer int")
    prim = table([("k", "p", 0.0, 0.0, 0.5, 1.0, 12.0, 7)],
                 "component_id string, primitive_id string, ux double, uy double, uw double, uh double, font_size_pt double, layer int")
    r = expand_components(inst, prim).first()
    # The left half of the box turns to its upper half around (120, 110).
    assert [round(v, 6) for v in (r.x, r.y, r.width, r.height, r.rotation_deg, r.layer, r.font_size_pt)] == [
        110, 90, 20, 20, 90, 3.007, 2.5]


# ---- gates ----------------------------------------------------------------------------------------


TRAIL = ("case int, n int, editable boolean, similarity_score double, structural_score double, worst_object double, "
         "changed_ids array<string>, region_ids array<string>, region_structure array<double>, region_similarity array<double>")


def test_accepted_trail(table):
    plain = ([], [], [], [])
    region = (["a", "b"], ["a", "b"])
    df = table([
        (1, 1, False, 0.9, 0.9, 0.9, *plain), (1, 2, True, 0.5, 0.5, 0.5, *plain), (1, 3, True, 0.5004, 0.5, 0.5, *plain),
        (1, 4, True, 0.5006, 0.5, 0.5, *plain), (1, 5, True, 0.497, 0.512, 0.5, *plain), (1, 6, True, 0.48, 0.9, 0.9, *plain),
        (1, 7, True, 0.497, 0.512, 0.54, *region, [0.5, 0.5], [0.5, 0.5]), (1, 8, True, 0.496, 0.5, 0.5, *region, [0.52, 0.52], [0.5, 0.5]),
        (1, 9, True, 0.496, 0.5, 0.5, *region, [0.6, 0.48], [0.5, 0.5]), (2, 1, True, 0.1, 0.1, 0.1, *plain)], TRAIL)
    got = rows(gates.accepted_trail(df.repartition(4), "case", "n"), "case", "n", "accepted", "reason")
    assert got == [
        (1, 1, False, "not editable"), (1, 2, True, "first valid"), (1, 3, False, "no gain"), (1, 4, True, "global gain"),
        (1, 5, True, "structural gain"), (1, 6, False, "no gain"), (1, 7, True, "structural gain"),
        (1, 8, True, "changed objects gain"), (1, 9, False, "no gain"), (2, 1, True, "first valid")]


def test_missing_slide_vote_rejects(table):
    schema = ("id int, score double, slide_scores map<int,double>, selected_slides array<int>, operation string, "
              "instruction_fulfilled boolean, powerpoint_compatible boolean")
    yes = F.lit(True)
    df = table([(1, 9.0, {1: 9.0}, [1], "beautify", True, None), (2, 9.0, {1: 9.0}, [1, 2], "beautify", True, None),
                (3, 9.0, {1: 7.0}, [], "beautify", True, True), (4, 6.5, {}, [], "notes", False, True),
                (5, 6.5, {}, [], "beautify", True, True), (6, 9.0, {}, [], "beautify", True, False)], schema).withColumns({
        n: yes for n in ("content_preserved", "production_notes_removed", "layout_valid", "editability_preserved", "balanced_density",
                         "operation_checks_passed", "notes_removed_gate", "ooxml_compatible", "content_gate")})
    assert [r[1] for r in rows(gates.review_approved(df), "id", "approved")] == [True, False, False, True, False, False]


def test_quota_is_not_a_failure(table):
    df = table([("You exceeded your current quota", "RateLimitError"), ("Rate limit reached", "RateLimitError"), ("boom", "APITimeoutError"),
                ("status 503", "X"), ("quota gone, timeout", "X"), (None, None)], "error string, error_type string")
    got = [r.error_class for r in gates.classify_error(df).collect()]
    assert got == ["blocked_external", "blocked_external", "transient", "transient", "permanent", None]


def test_average_reviews_orders_issues(table):
    df = table([("k", 1, 8.0, True, None, ["b", "a"], {"layout": 8.0}), ("k", 2, 9.0, False, 2.0, ["a", "c"], {"layout": 9.0, "text": 6.0})],
               "id string, vote int, score double, layout_valid boolean, relative_improvement double, issues array<string>, rubric map<string,double>")
    r = evaluation.average_reviews(df, ["id"]).first()
    assert (r.score, r.layout_valid, r.relative_improvement) == (8.5, False, 2.0)
    many = df.unionByName(df.limit(1).withColumns({"id": F.lit("m"), "issues": F.array(*[F.lit(f"i{i:02}") for i in range(40)])}))
    assert rows(evaluation.review_issues(many, ["id"]), "id", "rank", "issue") == [
        ("k", 1, "b"), ("k", 2, "a"), ("k", 3, "c"), *[("m", i + 1, f"i{i:02}") for i in range(40)]]
    assert rows(evaluation.average_scores(df, ["id"], "rubric"), "name", "score") == [("layout", 8.5), ("text", 3.0)]


def test_lineage_of_long_and_broken_chains(table):
    chain = [(i, i - 1 if i else None) for i in range(40)] + [(100, 999)]
    out = evaluation.lineage(table(chain, "job_id bigint, parent_job_id bigint"))
    assert rows(out.filter("job_id in (0, 39, 100)"), "job_id", "root_id", "depth") == [(0, 0, 0), (39, 0, 39), (100, 100, 0)]
    # Cycles, tails that lead into them and a job that is its own parent take nothing from the others.
    links = [(0, None), (5, 0), (1, 2), (2, 3), (3, 1), (9, 3), (8, 9), (7, 7), (20, 21), (21, 20)]
    out = evaluation.lineage(table(links, "job_id bigint, parent_job_id bigint"))
    assert rows(out, "job_id", "root_id", "depth", "reason") == [
        (0, 0, 0, None), (1, 1, None, "cycle"), (2, 1, None, "cycle"), (3, 1, None, "cycle"), (5, 0, 1, None), (7, 7, None, "cycle"),
        (8, 1, None, "cycle"), (9, 1, None, "cycle"), (20, 20, None, "cycle"), (21, 20, None, "cycle")]
    ring = [(i, (i + 1) % 300) for i in range(300)] + [(1000 + i, 999 + i if i else 4) for i in range(500)]
    out = evaluation.lineage(table(ring, "job_id bigint, parent_job_id bigint"))
    assert rows(out.select("root_id", "reason").distinct(), "root_id", "reason") == [(0, "cycle")] and out.count() == 800


def test_expired_jobs_keep_malformed_stamps(table):
    df = table([(1, "2024-01-01T00:00:00+00:00"), (2, "not a time"), (3, None), (4, "2024-03-01T00:00:00+00:00")], "job_id int, finished_at string")
    gone = evaluation.expire_jobs(df, F.lit("2024-03-02").cast("timestamp"), 30)
    assert rows(gone, "job_id") == [(1,)]


# ---- images ---------------------------------------------------------------------------------------


def image(table, size, dark, ref_color, out_dark, out_color):
    """Pixel pairs of two white images with one dark rectangle each, as (x0, y0, x1, y1)."""
    def inside(box, x, y):
        return box[0] <= x < box[2] and box[1] <= y < box[3]

    data = [(1, x, y, ref_color if inside(dark, x, y) else 255, out_color if inside(out_dark, x, y) else 255)
            for x in range(size) for y in range(size)]
    df = table(data, "id int, x bigint, y bigint, ref_gray bigint, out_gray bigint")
    return df.withColumn("diff_gray", F.abs(c("ref_gray") - c("out_gray")))


def scores(table, *args):
    pairs = image(table, *args)
    sizes = pixels.image_sizes(pairs, ["id"])
    masked = pixels.foreground_masks(pairs, ["id"], ["gray"], [255])
    return pixels.silhouette_metrics(masked, ["id"], sizes).first(), pixels.image_metrics(masked, ["id"], ["gray"]).first()


def test_silhouette_ignores_color(table):
    same, color = scores(table, 16, (4, 4, 12, 12), 0, (4, 4, 12, 12), 120)
    assert same.geometry_score == pytest.approx(1.0)
    assert color.foreground_mae == pytest.approx(120 / 255) and color.gradient_profile_mae == pytest.approx(0)
    moved, _ = scores(table, 16, (4, 4, 12, 12), 0, (6, 4, 14, 12), 0)
    # Masks grow by one pixel: 10×10 boxes two apart share 80 of 120.
    assert moved.silhouette_iou == pytest.approx(80 / 120) and moved.bbox_iou == pytest.approx(80 / 120)
    assert moved.centroid_distance == pytest.approx(2 / math.hypot(16, 16))


def test_edges_within_reach_match(table):
    pairs = image(table, 24, (6, 6, 16, 16), 0, (7, 6, 17, 16), 0)
    near = pixels.edge_f1(pixels.edge_masks(pairs, ["id"], ("ref_gray", "out_gray")), ["id"]).first()
    assert near.edge_f1 == pytest.approx(1.0)
    pairs = image(table, 24, (2, 2, 8, 8), 0, (14, 14, 20, 20), 0)
    far = pixels.edge_f1(pixels.edge_masks(pairs, ["id"], ("ref_gray", "out_gray")), ["id"]).first()
    assert far.edge_f1 == 0


def test_linear_ramp(table):
    df = table([(1, x, y, 10 * x + 3 * y) for x in range(11) for y in range(11)], "id int, x bigint, y bigint, gray bigint")
    r = pixels.linear_ramp_fit(df, ["id"], pixels.image_sizes(df, ["id"]), ["gray"]).first()
    assert (r.slope_x_gray, r.slope_y_gray, r.r_squared) == (pytest.approx(100), pytest.approx(30), pytest.approx(1.0)) and r.accepted
    flat = df.withColumn("gray", F.lit(7).cast("bigint"))
    assert not pixels.linear_ramp_fit(flat, ["id"], pixels.image_sizes(df, ["id"]), ["gray"]).first().accepted


def test_bars_from_runs(table):
    rows_ = [(1, x, y) for y in range(2, 6) for x in range(3, 15)] + [(1, 0, 0), (1, 1, 0)]
    df = table(rows_, "id int, x bigint, y bigint")
    runs = pixels.color_runs(df, ["id"], F.lit(True), 3)
    assert rows(pixels.run_blocks(runs, ["id"]), "x", "y", "width", "height") == [(3, 2, 12, 4)]


def test_specks_and_area(table):
    pts = [(1, "a", i, x, y) for i, (x, y) in enumerate([(0, 0), (100, 0), (100, 100), (0, 100)])]
    pts += [(1, "b", i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (0, 4)])]
    area = pixels.polygon_area(table(pts, "fig int, contour string, seq int, x int, y int"), ["fig", "contour"])
    assert rows(area, "contour", "area") == [("a", 10000.0), ("b", 8.0)]
    assert rows(pixels.drop_specks(area, ["fig"]), "contour") == [("a",)]


def test_ramp_lookup_clamps(table):
    profile = table([(1, 0.25, 10.0), (1, 0.75, 30.0)], "id int, progress double, gray double")
    stops = table([(1, 0.0), (1, 0.5), (1, 1.0)], "id int, position double")
    assert rows(pixels.ramp_lookup(stops, profile, ["id"], ["gray"]), "position", "gray") == [(0.0, 10.0), (0.5, 20.0), (1.0, 30.0)]


# ---- catalogue ------------------------------------------------------------------------------------


def test_near_duplicates_of_64_bits(table):
    df = table([(1, "00000000000000ff", 3), (2, "00000000000000f0", 3), (3, "00000000000000f0", 4), (4, "00000000000000ff", 3),
                (5, "f0000000000000ff", 3), (6, "ff000000000000ff", 3), (7, None, 3)], "id bigint, phash string, slides int")
    for m in (1, 2, 3):
        got = catalog.near_duplicates(df, "id", block="slides", shared_bands=m)
        assert rows(got, "id", "existing_id", "distance") == [(2, 1, 4), (4, 1, 0), (5, 1, 4), (6, 5, 4)]


def test_majority_hash_ties_set_the_bit(table):
    df = table([("k", "0000000000000003"), ("k", "0000000000000001"), ("j", "8000000000000000")], "id string, phash string")
    assert rows(catalog.majority_hash(df, ["id"]), "id", "phash") == [("j", "8000000000000000"), ("k", "0000000000000003")]


def test_merge_and_split_reject_unknown(table):
    stamp = F.lit("2024-01-01").cast("timestamp")
    t = table([(1, "a"), (2, "b"), (3, "c")], "template_id int, family_id string").withColumn("updated_at", stamp)
    f = table([("a",), ("b",), ("c",)], "family_id string").withColumns({"active": F.lit(True), "updated_at": stamp})
    moved, fams, rejected = catalog.merge_families(t, f, "a", table([("b",), ("zz",), ("a",)], "family_id string"), F.current_timestamp())
    assert rows(moved, "template_id", "family_id") == [(1, "a"), (2, "a"), (3, "c")]
    assert rows(fams, "family_id", "active") == [("a", True), ("b", False), ("c", True)]
    assert rows(rejected, "family_id") == [("zz",)]
    moved, rejected = catalog.split_family(t, "a", table([(1,), (3,)], "template_id int"), "new", F.current_timestamp())
    assert rows(moved, "template_id", "family_id") == [(1, "new"), (2, "b"), (3, "c")]
    assert rows(rejected, "template_id") == [(3,)]


def test_select_slides(table):
    slides = table([(1, i) for i in range(1, 6)], "deck int, slide_index int")
    assert rows(layout.select_slides(slides, None), "slide_index") == [(i,) for i in range(1, 6)]
    assert rows(layout.select_slides(slides, [4, 2, 4, 9]), "slide_index") == [(2,), (4,)]
    for wrong in ([], [0], [-1, 2]):
        with pytest.raises(ValueError, match="1-based"):
            layout.select_slides(slides, wrong)


def test_covered_boxes_equal_the_greedy_loop(table):
    """Boxes fall only to larger ones that stay, also along chains that shift step by step."""
    rng = random.Random(8)
    boxes = {0: [(10 * i, 0, 100 - i, 100) for i in range(25)]}
    boxes |= {s: [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 90), rng.randrange(1, 90)) for _ in range(60)] for s in range(1, 5)}
    data = [(s, i, *b) for s, own in boxes.items() for i, b in enumerate(own)]
    got = rows(shapes.suppress_covered(table(data, "slide int, shape_id int, x_pt int, y_pt int, w_pt int, h_pt int"), ["slide"]), "slide", "shape_id")
    want = []
    for slide, own in boxes.items():
        kept = []
        for x, y, w, h in sorted(set(own), key=lambda b: (-b[2] * b[3], b)):
            if all(max(0, min(x + w, a + d) - max(x, a)) * max(0, min(y + h, b + e) - max(y, b)) / (w * h) < 0.75 for a, b, d, e in kept):
                kept.append((x, y, w, h))
        want += [(slide, i) for i, b in enumerate(own) if b in kept]
    assert got == sorted(want)


def test_trails_span_whole_runs(spark):
    """The query's trail goes through all cases of a run, not through those of one customer alone."""
    from deckloom.plans import QUERIES

    got = QUERIES["wn07_accepted_trail"](spark, "/root/testdata/sf0.001")
    assert got.columns[0] == "run_id"
    assert got.filter("reason = 'first valid'").groupBy("run_id").count().where("count > 1").count() == 0


def test_words_of_whole_texts_equal_folded_words(table):
    """Folding a text before it is cut gives the same words, whatever its letters do."""
    texts = ["STRASSE \u1e9e \u0130stanbul \u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3.\u0392", "\u2168 \u24b6bc \u00c0'\u00c9 DON\u2019T a-B", "", "1 2"]
    df = table([(i, t) for i, t in enumerate(texts)], "i int, v string")
    one_by_one = F.transform(F.regexp_extract_all("v", F.lit(tx.WORD_PATTERN), F.lit(1)), tx.casefold)
    assert [r[0] == r[1] for r in df.select(tx.words(c("v")), one_by_one).collect()] == [True] * 4
    assert not table([(None,)], "v string").select(tx.words(c("v")).alias("w")).first().w


def test_paired_tokens_hold_the_rests(table):
    """Only what differs behind a common beginning is sent on, and the violations are those of all tokens."""
    pairs = [(1, "a b c 1", "A b c 1"), (2, "a b c", "a b c d"), (3, "a b 1 c", "a 2 b c"), (4, None, "x"), (5, "x y", None), (6, "b a", "a b"), (7, "s", "s"),
             (8, "", "5")]
    df = table([(i, 1, b, a) for i, b, a in pairs], "deck_id int, slide_index int, before string, after string")
    keys = ["deck_id", "slide_index"]
    paired = content.paired_tokens(df, keys, "before", "after")
    assert rows(paired.filter("deck_id in (1, 2, 7, 8)"), "deck_id", "fact", "value", "_b", "_a") == [(2, "word", "d", 0, 1), (8, "number", "5", 0, 1)]
    none, both = facts(table, [(0, 0, "word", "x")]).filter("deck_id > 0"), df.select(*keys)
    want = content.invariant_pairs(content.tokens(df, keys, "before"), content.tokens(df, keys, "after"), both, both)
    found = content.invariant_pairs(none, none, both, both, paired=paired)
    assert rows(found, *keys, "code") == rows(want, *keys, "code") and found.count() == 5
