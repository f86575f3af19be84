"""Best matches against brute force."""

import math
import random

from deckloom.llm.topk import top_matches


def brute(rows, asked, k=5):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    fine = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    queries = {}
    for i, v in asked:
        if i is not None and whole(v) is not None:
            queries[i] = min(queries.get(i, whole(v)), whole(v))
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, asked):
    make = lambda r: spark.createDataFrame([(*x, "extra") for x in r], "slide_id bigint, features array<double>, block string")
    found = top_matches(make(rows), make(asked))
    assert [f for f, _ in found.dtypes] == ["query_id", "rank", "slide_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, asked)


def test_many_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (3 if i % 7 == 0 else 1) for _ in range(12)]) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(20)]  # ties
    check(spark, rows, [r for r in rows if r[0] % 50 == 0])


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (None, [9.0, 9.0]),
            (6, []), (7, [3.0]), (8, [-1.0, -1.0, 5.0]), (1, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [0.999, -0.001])]
    check(spark, rows, rows)


def test_few_and_none(spark):
    check(spark, [(1, [1.0])], [(1, [1.0])])
    check(spark, [(1, [1.0])], [(2, [2.0])])
    check(spark, [], [])
