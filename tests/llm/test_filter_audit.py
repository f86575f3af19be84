"""Filter audit against brute force: every order applied one filter after another."""

import random
from itertools import permutations

import pytest

from deckloom.llm import filter_audit
from deckloom.llm.filter_audit import Trie, audit_filters, filter_masks, shared_length

REVIEWS = "slide_id bigint, content_preserved boolean, layout_valid boolean, note string"


def words_of(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def fails(rows):
    """The failing filters of each row (id, text, source)."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = words_of(text)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            bad.add("C")
        if any(c in text for c in "#$%&*|"):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, good, toxic):
    failing, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failing) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                gone = len(own) - len(left)
                redundant = sum(letter in f for _, f in own) - len(removed)
                assert 0 <= redundant <= gone
                left = [x for x in left if letter not in x[1]]
                out[part, order, step] = [len(left), len(removed), redundant, sum(f == {letter} for _, f in own),
                                          sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), 0]
    for part in {k[0] for k in out}:
        for letter in "ABCDE":
            own = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(out[k][1] for k in own)
            for k in own:
                out[k][6] = total
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [
        r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows],
                                              "slide_id bigint, text string, source string, mask string, part int")


def some_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "délta", "EPS", "#tag", "10%", "z中"]
    heads = ["", "shared head ", "shared heap ", "\n"]
    texts = [None, "", " ", "a"] + [
        rng.choice(heads) + rng.choice([" ", "\n", "  "]).join(
            rng.choice(vocabulary[:rng.choice([2, 8])] + [f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 40]))])
            for _ in range(rng.choice([3, 150, 205, 260]))) for _ in range(n // 2)]
    rows = [(rng.randrange(n), rng.choice(texts), rng.choice(["web", "deck", None, ""])) for _ in range(n)]
    return rows + [(None, texts[5], "web"), (None, "lonely", None), rows[0], rows[0]]


def test_brute_force(spark, make):
    rows = some_rows(160, 1)
    reviews = [(i, i % 3 == 0, i % 4 != 0, "n") for i in range(0, 160, 2)] + [(4, True, False, "again"), (5, None, None, ""), (None, True, False, "")]
    good = {i for i, g, _, _ in reviews if g and i is not None}
    toxic = {i for i, _, v, _ in reviews if v is False and i is not None}
    got = audited(audit_filters(make(rows), spark.createDataFrame(reviews, REVIEWS)))
    assert got == brute(rows, good, toxic)


def test_small_tries_and_many_ranges(spark, make, monkeypatch):
    """Tries that are walked after every few texts, and as many ranges as the settings give, change nothing."""
    rows = some_rows(240, 2)
    want = {}
    for (i, _, part), bad in zip(rows, fails(rows)):
        key = (i, part or "", sum(1 << "ABCDE".index(f) for f in bad))
        want[key] = want.get(key, 0) + 1
    for name, value in (("TRIE_BYTES", 2000), ("LEAST_BYTES", 4000), ("RANGE_BYTES", 4000)):
        monkeypatch.setattr(filter_audit, name, value)
    slides = make(rows).repartition(5)
    assert len(filter_audit.text_bounds(slides)) > 4
    got = {}
    for r in filter_masks(slides).collect():
        key = (r["slide_id"], r["part"], r["mask"])
        got[key] = got.get(key, 0) + r["n"]
    assert got == want


def test_hot_text_is_combined(spark, make):
    """A text that most slides share reaches its range as one row of each task."""
    rows = [(i, "the same text " * 500, "web") for i in range(3000)]
    masks = filter_masks(make(rows).repartition(4)).groupBy("mask").sum("n").collect()
    assert sorted((r[0] >= 16, r[1]) for r in masks) == [(False, 1), (True, 2999)]


def test_long_texts(spark, make):
    long = "word " * 400_000
    rows = [(1, long + "a", "web"), (2, long + "b", "web"), (3, long + "a", "deck")]
    got = {(r["slide_id"], r["mask"] >> 4) for r in filter_masks(make(rows)).collect()}
    assert got == {(1, 0), (2, 0), (3, 1)}


def test_empty(spark, make):
    assert audit_filters(make([]), spark.createDataFrame([], REVIEWS)).count() == 0
    got = audited(audit_filters(make([(7, None, None)]), spark.createDataFrame([], REVIEWS)))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["", "ABCDE", 2] == [0] * 7


def test_trie_holds_every_text():
    rng = random.Random(3)
    texts = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)}
    trie = Trie()
    for text in [*texts, *texts]:
        node = trie.terminal(text)
        node.held = (node.held or 0) + 1
    assert dict(trie.terminals()) == {t: 2 for t in texts}
    assert not list(trie.terminals())


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_shared_length(n):
    assert shared_length(b"x" * n + b"a", b"x" * n + b"bb") == n
    assert shared_length(b"x" * n, b"x" * n + b"bb") == n
    assert shared_length(b"__" + b"x" * n + b"a", b"x" * n + b"b", 2, 0) == n
