"""Character models: probabilities, held-out accuracy and rejection."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from deckloom.llm import language

STEMS = {"xx": ["kalo", "mira", "tense", "voru"], "yy": ["schab", "grunz", "\u00fcber", "keit"], "zz": ["\u0440\u0435\u043a\u0430", "\u0434\u043e\u043c", "\u043b\u0435\u0441"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choices(STEMS[lang], k=2)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(i, prose(lang, rng.randint(5, 60), rng), lang) for i in range(600) for lang in [rng.choice(list(STEMS))]]


def test_shares_sum_to_one():
    text = language.normal("The slide deck has a title, the slide has text. " * 3)
    grams, counts = np.unique(np.concatenate([g for g, _ in language.pieces([text])]), return_counts=True)
    model = language.fit_arrays(grams, counts)
    seen = sorted({ord(c) for c in text})
    for context in ("the", "sli", "qqq", " a "):
        head = ord(context[0]) << 48 | ord(context[1]) << 32 | ord(context[2]) << 16
        every = np.exp(language.log_shares(model, np.array([head | c for c in range(1 << 16)], np.uint64)))
        assert every.sum() == pytest.approx(1.0) and every.min() > 0
        assert every[seen].sum() > 0.9


def test_slices_cut_nothing(monkeypatch):
    texts = [language.normal(t) for t in ("Some words of a slide", "", "x" * 100, "12 ??")]
    whole = [g.tolist() for g, _ in language.pieces(texts)]
    monkeypatch.setattr(language, "SLICE", 7)
    parts = list(language.pieces(texts))
    assert len(parts) > 10 and [x for g, _ in parts for x in g.tolist()] == [x for g in whole for x in g]


def test_detect(spark, labelled):
    make = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "slide_id bigint, text string, lang string, _row int")
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 ?! \u00bd", None), (1003, "kalomira", None), (None, prose("yy", 9, random.Random(3)), "yy"),
           (1004, "\u6f22\u5b57\u304b\u306a " * 50, None), (1005, prose("zz", 30_000, random.Random(4)), None), (1003, "kalomira", None)]
    table = make(labelled + odd)
    models = language.fit_languages(table)
    assert models.langs == sorted(STEMS)
    found = language.detect_language(table, models)
    assert found.columns == ["slide_id", "text", "lang", "_row", "language"]
    rows = found.collect()
    assert len(rows) == len(labelled) + len(odd)
    held = [r for r in rows if r.slide_id is not None and r.slide_id < 1000 and zlib.crc32(str(r.slide_id).encode()) % 5 == 0]
    assert len(held) > 60 and all(r.language.lang_pred == r.lang and not r.language.rejected for r in held)
    by_id = {r.slide_id: r.language for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "xx" and by_id[None].lang_pred == "yy" and by_id[1005].lang_pred == "zz"
    assert by_id[1004].rejected and by_id[1004].lang_pred in models.langs and not by_id[1005].rejected
    assert all(0 <= r.language.score <= 1 for r in rows)


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "some text", None)], "slide_id bigint, text string, lang string")
    for rows in (table, table.where("false")):
        models = language.fit_languages(rows)
        assert [r.language.lang_pred for r in language.detect_language(table, models).collect()] == ["und"]


def test_scoring_holds_slices_only():
    rng = np.random.default_rng(5)
    text = language.normal("".join(map(chr, rng.integers(97, 123, 3_000_000))))
    grams, _ = next(language.pieces([text]))
    model = language.fit_arrays(*np.unique(grams, return_counts=True))
    tracemalloc.start()
    sums, _, n = language.score_texts([model], [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [3_000_000] and sums[0, 0] > 0
    assert peak < 32 << 20
