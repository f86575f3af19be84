"""Targets and takings against brute force."""

import random

import pytest
from llm_fixtures import slides  # noqa: F401

from deckloom.llm import mixing


def targets(sizes):
    """Share, stop those above their limit, share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else left * weight[s] / weights for s in order}
        over = {s for s in order if s not in full and out[s] > 2.0 * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s\u00e9{i}" if i % 4 else f"S{i}": rng.choice([0, 1, 10, 500, 20_000]) for i in range(rng.randint(1, 12))} | {None: 40, "": 3}
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    assert {r.source: r.target for r in found.collect()} == pytest.approx(targets(sizes))


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        out.append((i, " ".join(["word"] * rng.choice([0, 1, 5, 30, 90])) + rng.choice(["", " ###"]), source))
    return out + [(n, None, "b"), (None, "one two", "a"), (n + 1, "w " * 3000, "c"), (3, "again here", "b"), (3, "again here", "b")]


def test_mix(slides):
    given = rows(900, 1)
    table = slides(given, schema=", source string")
    found = mixing.mix_sources(table).collect()
    assert len(found) == len(given)
    sizes = {}
    for _, text, source in given:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.taken == r.copies * r.size <= 2 * r.size and r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for source, n in taken.items():
        assert abs(n - want[source]) <= 3000 / 2 + 1, source
    # Every slide of a source comes for each whole epoch, and at most once more.
    for r in found:
        whole = int(want[r.source] // sizes[r.source])
        assert whole <= r.copies <= whole + 1
    again = mixing.mix_sources(table.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_better_slides_come_first(slides):
    good, bad = [(i, "word " * 10, "a", 5.0) for i in range(400)], [(i, "word " * 10, "a", 0.2) for i in range(400, 800)]
    found = mixing.mix_sources(slides(good + bad, schema=", source string, quality double"), share=0.5, most=2.0).collect()
    taken = sum(r.copies for r in found if r.slide_id < 400), sum(r.copies for r in found if r.slide_id >= 400)
    assert sum(taken) == 400 and taken[0] > 350


def test_mixed_rows_are_the_mix(slides):
    table = slides(rows(300, 2)[:-2], schema=", source string")
    mixed = mixing.mixed_rows(table)
    assert mixed.columns == table.columns
    counts = {}
    for r in mixed.collect():
        counts[r.slide_id] = counts.get(r.slide_id, 0) + 1
    assert counts == {r.slide_id: r.copies for r in mixing.mix_sources(table).collect() if r.copies}


def test_empty(slides):
    for rows_ in ([], [(1, None, None), (2, "", "a")]):
        table = slides(rows_, schema=", source string")
        assert [r.taken for r in mixing.mix_sources(table).collect()] == [0] * len(rows_)
        assert mixing.mixed_rows(table).count() == 0
