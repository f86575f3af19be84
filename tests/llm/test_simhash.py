"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from llm_fixtures import slides  # noqa: F401

from deckloom.llm import simhash
from deckloom.llm.components import least_nodes


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=4):
    values, root = list(values), list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_texts(slides):
    rng = random.Random(1)
    words = [f"Wört{i}" if i % 3 else f"W{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 300, 2000]))) for _ in range(12)]
    texts = [*base, *base[:4], base[11] + " extra", base[9].upper(), None, "", " \t\n", "a\x00b  c d"]
    rows = list(enumerate(texts, 10)) + [(None, base[0]), (10, base[0])]
    found = simhash.near_duplicates(slides(rows)).collect()
    assert len(found) == len(rows)
    prints = [fingerprint(t) for _, t in rows]
    part = components(prints)
    least = {p: min(i for (i, _), q in zip(rows, part) if q == p and i is not None) for p in set(part)}
    want = sorted((i is None, i or 0, f"{f:016x}", least[p]) for (i, _), f, p in zip(rows, prints, part))
    assert sorted((r.slide_id is None, r.slide_id or 0, r.fingerprint, r.component_id) for r in found) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_crowds_chains_and_strangers(spark, seed):
    rng = random.Random(seed)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {0}
    centre = rng.getrandbits(64)
    values |= {flip(centre, rng.randint(0, 2)) for _ in range(150)}  # a crowd where all are linked
    for _ in range(15):  # chains of four bits a step, and pairs just too far apart
        v = rng.getrandbits(64)
        for _ in range(5):
            values.add(v)
            v = flip(v, rng.choice([4, 4, 5]))
    values |= {rng.getrandbits(64) & 0xFFFF for _ in range(60)}  # bits that are hardly used
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = dict(simhash.roots_of(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect())
    part = components(values)
    least = {p: min(s for s, q in zip(signed, part) if q == p) for p in set(part)}
    assert found == {s: least[p] for s, p in zip(signed, part)}


def test_pairs_are_not_emitted_within_a_crowd(spark):
    """Fingerprints that their first one joins are never compared again."""
    rng = random.Random(5)
    values = sorted({sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(900)} | {0})
    found = simhash.roots_of(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint"))
    assert found.select("root").distinct().count() == 1


def test_thresholds_sum_up(spark):
    values = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    for groups in simhash.GROUPS:
        bits = simhash.group_bits(np.zeros((64, 64)), groups)
        assert sorted(b for own in bits for b in own) == list(range(64))
        counts = [tuple(np.bincount(simhash.gather(values, half), minlength=1 << len(half)) for half in simhash.split(own))
                  for own in bits]
        chosen, _ = simhash.Plan(bits, counts, len(values), 4).allot(values)
        assert (chosen.sum(axis=1) == 4 - groups + 1).all()


def test_chains_of_any_length(spark):
    edges = [(i + 1, i) for i in range(100)] + [(200, 205), (205, 201), (300, 300)]
    found = dict(least_nodes(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 205: 200}


def test_one_of_each_group_stays(slides):
    text = " ".join(f"w{i}" for i in range(200))
    kept = simhash.keep_one(slides([(5, text), (3, text), (3, text), (None, text), (9, "other words here"), (None, None), (7, "")]))
    assert sorted((r.slide_id or 0, r._row) for r in kept.collect()) == [(3, "extra"), (7, "extra"), (9, "extra")]


def test_empty(slides):
    assert simhash.near_duplicates(slides([])).collect() == []
    assert simhash.keep_one(slides([])).collect() == []
