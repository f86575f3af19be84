"""Quality counts and ratios against brute force."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from llm_fixtures import slides  # noqa: F401

from deckloom.llm import quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) for d in range(3) if windows[tuple(words[i:i + 3])] > 1}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), failed)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "Slide", "deck.", "figure,", "chart", "Größe", "7", "A1", "layout"] + [f"w{i}" for i in range(200)]
    good = [" ".join(rng.choices(words, k=rng.randint(60, 200))) for _ in range(n)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "!!"]) for w in rng.choices(words, k=100)) for _ in range(n // 5)]
    return good, bad


def test_counts(slides, spark):
    rng = random.Random(4)
    good, bad = texts(20, 1)
    odd = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x " * 60, "x y " * 40, "one\ntwo\none\n\n\none", "é|é\x0b<b> 日本 # $",
           "\n".join(["same line here"] * 30), " ".join(rng.choices("abcd", k=500)), " ".join(rng.choices("ab", k=3000) + list(map(str, range(4000))))]
    rows = list(enumerate(good + bad + odd)) + [(None, good[0]), (0, good[0])]
    table = slides(rows)
    judged = quality.quality_rules(table, quality.fit_ratios(table, spark.createDataFrame([], "slide_id bigint")))
    assert judged.columns == [*table.columns, "quality"]
    for row in judged.collect():
        q = row.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == counts(row.text), row.text
        assert q.ratio == 0.0 and q.kept == (not q.base_failed)  # nothing is trusted: no verdict


def test_ratios(slides, spark):
    good, bad = texts(100, 2)
    rows = list(enumerate(good + bad))
    trusted = spark.createDataFrame([(i,) for i in range(0, 60)] + [(None,), (3,), (10_000,)], "slide_id bigint")
    table = slides(rows)
    fitted = quality.fit_ratios(table, trusted)
    ratios = fitted.first().ratios
    judged = {r.slide_id: r.quality for r in quality.quality_rules(table, fitted).collect()}
    assert all(judged[i].kept for i in range(100)) and not any(judged[i].kept for i, _ in rows[100:])
    # The same counts by hand for words, whose buckets are plain hashes; pairs of forms are few.
    def bucket(word):
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS

    words = [t.split() for t in good + bad]
    share = sum(map(len, words[:60])) / sum(map(len, words))
    every, known = (Counter(bucket(w) for own in part for w in own) for part in (words, words[:60]))
    exact = sum(ratios[b] == pytest.approx(math.log((known[b] + share * quality.ADDED) / ((n + quality.ADDED) * share)))
                for b, n in every.items())
    assert exact >= len(every) - 5 and len(ratios) == quality.BUCKETS


def test_bounded_sample(spark):
    ids = spark.range(1000).withColumnRenamed("id", "slide_id")
    first, again = (sorted(r.slide_id for r in quality.trusted_sample(ids.repartition(n), 50).collect()) for n in (3, 7))
    assert len(first) == 50 and first == again


def test_empty(slides, spark):
    table = slides([])
    assert quality.quality_rules(table, quality.fit_ratios(table, spark.createDataFrame([], "slide_id bigint"))).collect() == []
