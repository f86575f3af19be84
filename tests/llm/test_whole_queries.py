"""The registered queries that SQL cannot express, on the whole smallest tables, against brute force and the libraries."""

import hashlib
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import test_bpe as by_bpe  # noqa: E402
import test_quality as by_quality  # noqa: E402
import test_simhash as by_simhash  # noqa: E402

from deckloom.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def result(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, SF_DIR).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_simhash(spark, texts):
    got = result(spark, "op1_simhash")
    ids = sorted(texts)
    prints = [by_simhash.fingerprint(texts[i]) for i in ids]
    least = {}
    for i, part in zip(ids, by_simhash.components(prints)):
        least.setdefault(part, i)
    want = {i: (f"{p:016x}", least[part]) for i, p, part in zip(ids, prints, by_simhash.components(prints))}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == want


def test_quality(spark, texts):
    got = result(spark, "op3_quality")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        own = by_quality.counts(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == own
        assert not (own[-1] and r["kept"])


def test_bpe(spark, texts):
    library = by_bpe.library()
    for i, r in result(spark, "op4_bpe").items():
        ids = np.array(library.encode_ordinary(texts[i] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = result(spark, "op5_article", "page_id")
    assert got.keys() == pages.keys()
    for i, r in got.items():
        assert r["url"] == pages[i]["url"] and r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split())
        assert "<p" not in r["text"]


def test_languages(spark, texts):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = result(spark, "op7_language")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[i] or "")))
    judged = [(langs[i], r["lang_pred"]) for i, r in got.items() if r["held_out"] and langs[i] and len(texts[i] or "") > 100]
    assert judged and sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_token_files(spark, texts):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = result(spark, "op10_token_files")
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
