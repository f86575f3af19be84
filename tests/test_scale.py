"""Operators that split hot groups, against brute force on small but skewed tables."""

import re
from types import SimpleNamespace
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from deckloom.operators import catalog, content, gates, matching, package, scoring, shapes, skew
from deckloom.operators import pixels as px
from deckloom.plans.registry import QUERIES
from deckloom.operators import patches
from deckloom.plans import patch_queries

c = F.col
RNG = np.random.default_rng(5)


def hot(n, keys=7):
    """Keys of which one holds about half of all rows."""
    return [0 if RNG.random() < 0.5 else int(RNG.integers(keys)) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_running_sum(table, width):
    data = [(k, i, int(RNG.integers(-5, 20))) for i, k in enumerate(hot(500))]
    out = skew.running_sum(table(data, "k int, i bigint, v bigint"), ["k"], ["i"], "v", "total", width=width)
    want, sums = [], {}
    for k, i, v in data:
        sums[k] = sums.get(k, 0) + v
        want.append((k, i, sums[k]))
    assert rows(out, "k", "i", "total") == sorted(want)


def test_positions_and_first(table):
    data = [(k, i * 3) for i, k in enumerate(hot(300))]
    df = table(data, "k int, i bigint")
    seen, want = {}, []
    for k, i in data:
        seen[k] = seen.get(k, 0) + 1
        want.append((k, i, seen[k]))
    assert rows(skew.position(df, ["k"], ["i"], "p", width=8), "k", "i", "p") == sorted(want)
    assert rows(skew.first_by(df, ["k"], ["i"]), "k", "i") == sorted({k: i for k, i in reversed(data)}.items())


def test_budget_breach_of_one_huge_job(table):
    data = [(k, i, 1000, 10) for i, k in enumerate(hot(400))]
    out = gates.budget_breach(table(data, "job_id int, sequence bigint, input_tokens bigint, output_tokens bigint"), 0.53)
    spent, first = {}, {}
    for k, i, a, b in data:
        spent[k] = spent.get(k, 0) + 5 * a + 30 * b
        if spent[k] > 530_000:
            first.setdefault(k, i)
    assert rows(out.filter("breach_at is not null"), "job_id", "breach_at") == sorted(first.items())


def test_near_duplicates_with_hot_copies(table):
    base = [int(v) for v in RNG.integers(0, 2**63, 12)]
    data = []
    for i in range(300):
        value = base[0] if RNG.random() < 0.4 else base[int(RNG.integers(12))]
        for bit in RNG.integers(0, 64, int(RNG.integers(0, 4))):
            value ^= 1 << int(bit)
        data.append((i, f"{value:016x}"))
    want = []
    for i, h in data:
        for j, g in data[:i]:
            d = (int(h, 16) ^ int(g, 16)).bit_count()
            if d <= 4:
                want.append((i, j, d))
                break
    df = table(data, "id bigint, phash string")
    for m in (1, 2):
        assert rows(catalog.near_duplicates(df, "id", shared_bands=m), "id", "existing_id", "distance") == sorted(want)
    # The same split into an existing catalogue and new items.
    new, old = df.filter("id >= 150"), df.filter("id < 150")
    got = catalog.near_duplicates(new, "id", catalog=old)
    assert rows(got, "id", "existing_id", "distance") == sorted(w for w in want if w[0] >= 150)


@pytest.mark.parametrize("cell", [16, 256])
def test_overlaps_on_one_crowded_slide(table, cell):
    data = [(k, i, *[int(v) for v in RNG.integers(0, 60, 2)], *[int(v) for v in RNG.integers(1, 40, 2)])
            for i, k in enumerate(hot(120))]
    data += [(0, 900 + i, 5, 5, 9, 9) for i in range(5)]
    out = shapes.overlapping_shapes(table(data, "s int, shape_id int, x_pt int, y_pt int, w_pt int, h_pt int"), None, ["s"],
                                    threshold=0.6, cell=cell)
    boxes = sorted({(s, x, y, w, h) for s, _, x, y, w, h in data})
    copies = {b: sum(1 for s, _, *r in data if (s, *r) == b) for b in boxes}
    want = []
    for i, a in enumerate(boxes):
        for b in boxes[i:]:
            if a[0] != b[0] or (a == b and copies[a] == 1):
                continue
            ow = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
            oh = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
            if ow * oh / max(1, min(a[3] * a[4], b[3] * b[4])) >= 0.6:
                want.append((*a, *b[1:], ow * oh))
    assert rows(out, "s", *[f"{k}_{m}" for k in "ab" for m in "xywh"], "overlap_area") == sorted(want)


def features(n, families=0):
    out = []
    for i in range(n):
        kind = RNG.integers(0, 3, 6).tolist()
        row = [i, *[int(v) for v in kind], float(RNG.integers(1, 50)), float(RNG.integers(1, 50)),
               ["title", "table"][int(RNG.integers(2))], sorted({f"#{v}" for v in RNG.integers(0, 5, 3)} if RNG.random() > 0.1 else set())]
        out.append(tuple([int(RNG.integers(families)), *row] if families else row))
    # Copies of the first row.
    return out + [tuple([out[0][0], n + j, *out[0][2:]] if families else [n + j, *out[0][1:]]) for j in range(8)]


def test_template_candidates_equal_brute_force(table):
    names = ", ".join(f"{f} {'double' if f.startswith('mean') else 'bigint'}" for f in shapes.FEATURES)
    src, cat = features(40), features(60, families=3)
    got = catalog.template_candidates(
        table(src, f"slide bigint, {names}, archetype string, dominant_colors array<string>"),
        table(cat, f"family_id bigint, template_slide_id bigint, {names}, archetype string, dominant_colors array<string>"),
        ["slide"], k=3)
    want = []
    for s in src:
        for fam in range(3):
            scored = []
            for t in cat:
                if t[0] != fam:
                    continue
                total = 0.0
                for a, b in zip(s[1:9], t[2:10]):
                    total += max(0.0, 1.0 - abs(a - b) / max(abs(a), abs(b), 1.0))
                st = total / 8
                if s[9] == t[10]:
                    st = min(1.0, st + 0.08)
                u = set(s[10]) | set(t[11])
                sty = len(set(s[10]) & set(t[11])) / len(u) if u else 1.0
                scored.append((-np.floor((0.78 * st + 0.22 * sty) * 1e6 + 0.5) / 1e6, t[1]))
            want += [(s[0], fam, i + 1, tid, -v) for i, (v, tid) in enumerate(sorted(scored)[:3])]
    assert rows(got, "slide", "family_id", "match_rank", "template_slide_id", "confidence") == sorted(want)


def test_few_pairs_are_scored(table):
    """Most slides share one colour and layout; still the scored pairs stay far below the product of both sides."""
    def made(n, start):
        out = []
        for i in range(n):
            hot = RNG.random() < 0.4
            kind = [3, 0, 0, 3, 0, 0] if hot else RNG.integers(0, 40, 6).tolist()
            colors = ["#fff"] if hot else [f"#{v}" for v in sorted(set(RNG.integers(0, 30, 4).tolist()))]
            out.append((start + i, *[int(v) for v in kind], float(RNG.integers(1, 400)), float(RNG.integers(1, 400)), "content", colors))
        return out

    names = ", ".join(f"{f} {'double' if f.startswith('mean') else 'bigint'}" for f in shapes.FEATURES)
    src, cat = made(400, 0), made(400, 0)
    source = table(src, f"source_sig bigint, {names}, archetype string, colors array<string>")
    templates = table([(1, i, *r) for i, r in enumerate(cat)], f"family_id int, sig bigint, first_id bigint, {names}, archetype string, colors array<string>")
    pairs = matching.candidate_pairs(source, templates, 5)
    assert pairs.count() < 400 * 400 / 4
    assert pairs.groupBy("source_sig").count().where("count < 5").count() == 0


def best_by_hand(src, cat, k):
    """(slide, family, rank, template, confidence) by comparing all with all."""
    out = []
    for s in src:
        for fam in sorted({t[0] for t in cat}):
            scored = []
            for t in cat:
                if t[0] != fam:
                    continue
                total = 0.0
                for a, b in zip(s[1:9], t[2:10]):
                    total += max(0.0, 1.0 - abs(a - b) / max(abs(a), abs(b), 1.0))
                st = min(1.0, total / 8 + 0.08) if s[9] == t[10] else total / 8
                u = set(s[10]) | set(t[11])
                sty = len(set(s[10]) & set(t[11])) / len(u) if u else 1.0
                scored.append((-np.floor((0.78 * st + 0.22 * sty) * 1e6 + 0.5) / 1e6, t[1]))
            out += [(s[0], fam, i + 1, tid, -v) for i, (v, tid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_many_signatures_equal_brute_force(table, monkeypatch):
    """Slides go down level by level and group by group; small families are compared whole, units are parted by their slides."""
    for name, value in (("JOINED_PAIRS", 0), ("WHOLE", 45), ("AT_ONCE", 30), ("UNIT_PAIRS", 40)):
        monkeypatch.setattr(matching, name, value)
    rng = np.random.default_rng(3)

    def made(n, start):
        out = []
        for i in range(n):
            kind = [int(v) for v in rng.integers(0, 4, 6)]
            colors = [f"#{v}" for v in sorted(rng.choice(6, int(rng.integers(0, 5)), replace=False).tolist())]
            out.append((start + i, *kind, float(rng.integers(90, 99)), float(rng.integers(90, 99)), ["title", "table"][int(rng.integers(2))], colors))
        return out + [(start + n + j, *out[0][1:]) for j in range(4)]

    src = made(25, 0)
    cat = [(f, *t) for f, n in ((0, 60), (1, 40), (5, 1)) for t in made(n, 1000 * f)]
    names = ", ".join(f"{f} {'double' if f.startswith('mean') else 'bigint'}" for f in shapes.FEATURES)
    got = catalog.template_candidates(
        table(src, f"slide bigint, {names}, archetype string, dominant_colors array<string>"),
        table(cat, f"family_id int, template_slide_id bigint, {names}, archetype string, dominant_colors array<string>"), ["slide"], k=3)
    assert dict(got.dtypes)["family_id"] == "int" and dict(got.dtypes)["match_rank"] == "int"
    assert rows(got, "slide", "family_id", "match_rank", "template_slide_id", "confidence") == best_by_hand(src, cat, 3)


def test_units_of_few_and_many_pairs_agree(monkeypatch):
    """Units scored one by one, in blocks, give what units scored together give; batches may cut units anywhere."""
    rng = np.random.default_rng(8)
    names, made = shapes.FEATURES, []
    nothing = {"family_id": None, "sig": None, "first_id": None, "members": None, "source_sig": None, "wanted": None, "held": [], "level": 0, "turn": 0}

    def row(key, asks, **more):
        counts = {n: float(rng.integers(0, 5)) if i % 3 else 2.0 for i, n in enumerate(names)}
        colors = sorted(rng.choice(90, int(rng.integers(0, 7)), replace=False).tolist())
        return {"key": key, "part": 0, "asks": asks, **nothing, **counts, "archetype": int(rng.integers(2)), "colors": colors, **more}

    for key in range(12):
        for family, n in ((3, 30), (7, 2), (9, key)):
            made += [row(key, 0, family_id=family, sig=100 * family + i, first_id=10 * i, members=[10 * i + j for j in range(1 + (key % 3 == 1) * (i % 3))]) for i in range(n)]
        for i in range(15):
            held = [{"sig": 300 + i, "template_slide_id": 10 * i, "confidence": 990_000, "structure": 1, "style": 1}] if i % 4 == 0 else []
            made.append(row(key, 1, source_sig=100 * key + i, wanted=None if key % 2 else [[3], [9], [3, 7, 9]][key % 3][:3 if key > 8 else 1], held=held))
    made += [row(99, 1, source_sig=5000, wanted=[3, 7])]
    match = pa.list_(pa.struct([(n, pa.int64() if t == "bigint" else pa.int32()) for n, t in scoring.MATCH.items()]))
    table = pa.Table.from_pylist(made, pa.schema([(n, pa.list_(pa.int64()) if n in ("members", "wanted", "colors") else match if n == "held" else
                                                   pa.float64() if n in names else pa.int64()) for n in made[0]]))

    def got(few, size):
        monkeypatch.setattr(scoring, "FEW", few)
        out = pa.Table.from_batches(scoring.answering(names, 3)(iter(table.to_batches(size)))).to_pylist()
        return sorted(((r["source_sig"], r["family_id"], str(r["matches"]), str(r["colors"])) for r in out))

    want = got(0, 10_000)
    assert len(want) > 200 and any("template_slide_id" in r[2] for r in want)
    assert got(0, 7) == want and got(10**9, 10_000) == want and got(10**9, 7) == want and got(300, 50) == want


def test_only_the_best_leave_their_task(table, monkeypatch):
    """However many templates share a slide's colours, a slide hands on k matches of a family; what it asks is stored once, not for each set and cell."""
    monkeypatch.setattr(matching, "JOINED_PAIRS", 0)
    monkeypatch.setattr(matching, "WHOLE", 10)
    stored, kept = [], matching.materialize

    def counted(df, purpose):
        found = kept(df, purpose)
        stored.append((purpose, found.count(), found.columns))
        return found

    monkeypatch.setattr(matching, "materialize", counted)
    row = lambda i, n: (i, n, 0, 0, n // 2, 0, 0, 200.0 + i % 7, 90.0 + i % 5, "content", [f"#{v}" for v in range(6)])
    names = ", ".join(f"{f} {'double' if f.startswith('mean') else 'bigint'}" for f in shapes.FEATURES)
    got = catalog.template_candidates(
        table([row(i, i % 40) for i in range(120)], f"slide bigint, {names}, archetype string, dominant_colors array<string>"),
        table([(1, *row(i, 300 + i)) for i in range(200)], f"family_id int, template_slide_id bigint, {names}, archetype string, dominant_colors array<string>"),
        ["slide"], k=3)
    assert got.count() == 360
    found = [n for purpose, n, _ in stored if purpose == "match-found"]
    assert found == [120] and max(n for _, n, _ in stored) <= 200


def test_family_match_equals_brute_force(table):
    """Decks and families with a large common group, empty overlaps and ties."""
    def slides_of(n, start):
        out = {}
        for i in range(n):
            kinds = ["title"] * 3 + ["content"] * 4 if RNG.random() < 0.3 else RNG.choice(
                ["chart", "table", "visual", "title", "content"][:int(RNG.integers(1, 6))], int(RNG.integers(1, 60))).tolist()
            out[start + i] = kinds
        return out

    decks, families = slides_of(80, 0), slides_of(70, 100)
    decks[999], decks[998] = ["process"], ["unknown"]
    got = catalog.family_match(table([(d, k) for d, ks in decks.items() for k in ks], "deck int, archetype string"),
                               table([(f, k) for f, ks in families.items() for k in ks], "family_id int, archetype string"), "deck")
    want = []
    for deck, kinds in decks.items():
        a = Counter(kinds)
        score, family = min((-sum((a & Counter(k)).values()) / sum((a | Counter(k)).values()), f) for f, k in families.items())
        want.append((deck, family if -score >= 0.72 else None, round(-score, 6)))
    assert sorted(tuple(r) for r in got.select("deck", "family_id", "score").collect()) == sorted(want)


def test_grid_filter_on_ragged_pixels(table):
    data = [(1, int(x), int(y), int(RNG.integers(0, 9))) for x in range(9) for y in range(7) if RNG.random() < 0.8]
    out = px.grid_filter(table(data, "id int, x bigint, y bigint, v bigint"), ["id"], 1, [("v", "sum", "s"), ("v", "max", "m")])
    # A column of the square is only seen from rows that hold a pixel in the same column.
    at = {(x, y): v for _, x, y, v in data}
    row = {(x, y): [at[(a, y)] for a in (x - 1, x, x + 1) if (a, y) in at] for x, y in at}
    want = [(x, y, sum(sum(row[(x, b)]) for b in (y - 1, y, y + 1) if (x, b) in row),
             max(max(row[(x, b)]) for b in (y - 1, y, y + 1) if (x, b) in row)) for x, y in at]
    assert rows(out, "x", "y", "s", "m") == sorted(want)


def test_fingerprint_ignores_order(table):
    a = table([(1, "x", 1), (1, "y", 2), (2, "x", 1)], "k int, a string, b int")
    b = table([(1, "y", 2), (1, "x", 1), (2, "x", 2)], "k int, a string, b int")
    left, right = (rows(package.fingerprint(d, ["k"], ["a", "b"]), "k", "fingerprint") for d in (a, b))
    assert left[0] == right[0] and left[1] != right[1]


def test_multiset_changes(table):
    before = table([(1, "a"), (1, "a"), (1, "b")], "k int, v string")
    after = table([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert rows(content.multiset_changes(before, after, ["k", "v"]), "k", "v", "change") == [(1, "a", -1), (2, "c", 1)]


PLAIN = ["jn12_overlapping_shapes", "wn01_top_matches", "jn02_near_duplicates", "ag10_image_metrics", "wn05_budget_breach",
         "se05_apply_shape_ops", "jn16_invariant_pairs", "jn03_template_candidates"]


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["ag22_usage_cost"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "ts" not in schema.replace("bigint", "")


def test_large_catalogues_are_not_broadcast(table, monkeypatch):
    """The 64 sets of each catalogue signature go through a shuffle once the catalogue is not small, whatever its files' size."""
    names = ", ".join(f"{f} {'double' if f.startswith('mean') else 'bigint'}" for f in shapes.FEATURES)
    src = [r[:10] + ([*r[10]],) for r in features(40)]
    source = table(src, f"source_sig bigint, {names}, archetype string, colors array<string>")
    templates = table([(1, i, *r) for i, r in enumerate(src)], f"family_id int, sig bigint, first_id bigint, {names}, archetype string, colors array<string>")
    want = rows(matching.candidate_pairs(source, templates, 3), "source_sig", "sig", "confidence")
    monkeypatch.setattr(matching, "BROADCAST_SIGNATURES", 0)
    pairs = matching.candidate_pairs(source, templates, 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line and "_key#" in line]
    assert joined and all("SortMergeJoin" in line for line in joined)
    assert rows(pairs, "source_sig", "sig", "confidence") == want


def exchanges(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


@pytest.mark.parametrize("width", [1, 4, 10_000])
def test_areas_of_long_contours(table, width):
    data, want = [], []
    for k in range(6):
        pts = [tuple(int(v) for v in RNG.integers(0, 50, 2)) for _ in range([1, 2, 4, 5, 40, 41][k])]
        data += [(k, 3 * i, x, y) for i, (x, y) in enumerate(pts)]
        want.append((k, abs(sum(a * d - b * e for (a, b), (e, d) in zip(pts, pts[1:] + pts[:1], strict=True))) / 2))
    area = px.polygon_area(table(data, "k int, seq int, x bigint, y bigint"), ["k"], width=width)
    assert rows(area, "k", "area") == want
    # The points themselves are dealt once, their ranges a second time.
    assert exchanges(area) == 2


def test_short_cycles_take_few_rounds(table, monkeypatch):
    from deckloom.operators import evaluation

    stored = []
    whole = evaluation.materialize
    monkeypatch.setattr(evaluation, "materialize", lambda df, purpose: stored.append(purpose) or whole(df, purpose))
    # 300 cycles of three jobs, one with a way of five jobs that leads into it and whose jobs are less than those of the cycle.
    links = [(10 * i + j, 10 * i + (j + 1) % 3) for i in range(1, 301) for j in range(3)] + [(j, j + 1 if j < 4 else 10) for j in range(5)]
    out = evaluation.lineage(table(links, "job_id bigint, parent_job_id bigint"))
    assert rows(out, "job_id", "root_id") == [(j, 10) for j in range(5)] + [(10 * i + j, 10 * i) for i in range(1, 301) for j in range(3)]
    assert stored.count("cycles") <= 6


@pytest.mark.parametrize("name", ["ag35_roundtrip_stability", "jn15_slot_assignments", "wn10_drop_specks"])
def test_shared_steps_run_once(spark, name, monkeypatch):
    """What both sides of these queries are made of is stored: the given lines are not read again below the result."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_equal_operations_are_told_apart_by_their_order_alone(spark):
    rows = spark.createDataFrame(
        [(1, 2, 1, "move", -10, 10, 119, 79), (1, 2, 2, "move", -10, 10, 119, 79), (1, 2, 3, "resize", 0, -10, 30, 20)],
        "slide_id long, target_shape_id long, op_no long, action string, dx_pt long, dy_pt long, width_pt long, height_pt long")
    found = patch_queries.ops(SimpleNamespace(fx_patch_op=rows))
    got = {(r.action, r.dx_pt, r.dy_pt, r.width_pt, r.height_pt, r.x_pt) for r in found.collect()}
    assert got == {("move", -10, 10, None, None, None), ("resize", None, None, 30, 20, None)} and found.count() == 2
    keys = re.findall(r"Aggregate \[(.*?)\], \[", found._jdf.queryExecution().optimizedPlan().toString())
    assert [k.count("#") for k in keys] == [4]


def test_violations_of_a_plan_fold_deletions_only(spark):
    shapes = spark.createDataFrame([(1, 1, 0, 0, 5, 5, "#000000")],
                                   "slide_id long, shape_id long, x_pt long, y_pt long, w_pt long, h_pt long, fill_color string")
    rows = spark.createDataFrame([(1, 1, 1, 3, "delete", 0, 0, 30, 20), (1, 1, 2, 4, "move", 1, 1, 31, 20)],
                                 "slide_id long, target_shape_id long, op_no long, n long, action string, dx_pt long, dy_pt long, width_pt long, height_pt long")
    found = patches.apply_shape_ops(shapes, patch_queries.ops(SimpleNamespace(fx_patch_op=rows)))[1]
    assert [(r.slide_id, r.rule) for r in found.collect()] == [(1, "missing_target")]
    assert "_ys" not in found._jdf.queryExecution().optimizedPlan().toString()
