"""Simple-8b words, and token files written and read back."""

import random
import string
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from llm_fixtures import slides  # noqa: F401

from deckloom.llm import token_files
from deckloom.session import shared_dir

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("high", [1, 2, 3, 50, 300, 49408, 1 << 31, 1 << 60, 1 << 61, 1 << 63])
def test_pack(high):
    rng = np.random.default_rng(high % 1000)
    for n in (0, 1, 2, 59, 60, 61, 300, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64)
        if n > 100:
            ids[n // 2: n // 2 + 130] = 1
            ids[::97] = np.uint64(0xFFFFFFFFFFFFFFFF) if high > 1 << 60 else 0
        words = token_files.pack(ids)
        assert (token_files.unpack(words, n) == ids).all()
    assert len(token_files.pack(np.ones(600, np.uint64))) == 10


def test_block():
    ids = [np.array(v, np.uint64) for v in ([2], [5, 6, 2], [], [1 << 63, 2])]
    names, offsets, flat = token_files.read_block(token_files.write_block([7, None, -3, 0], ids))
    assert names == [7, None, -3, 0] and offsets.tolist() == [0, 1, 4, 4, 6] and flat.tolist() == [2, 5, 6, 2, 1 << 63, 2]
    with pytest.raises(ValueError):
        token_files.read_block(b"XXXX" + bytes(40))


def texts():
    rng = random.Random(1)
    signs = "ab 's't  \n\t\r\x85\xa0\u00e9\u00c9\u00df\u6f221\u00b2_-!?.,'\u0301\U0001F600\u0130\u212a\u0178\u00b5\x00"
    words = ["The", "slide,", "Gr\u00f6\u00dfe.", "don't", "<|endoftext|>", "a.,b", "...", "Layout.,"]
    return [" ".join(rng.choices(words, k=6)) + "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_words_are_encoded_as_whole_texts():
    with open(FILE, encoding="utf-8") as file:
        own = token_files.WordTokenizer(file.read())
    every = [*texts(), "", " ", "\n"]
    wanted = Tokenizer.from_file(FILE).encode_batch(every, add_special_tokens=False)
    assert [np.frombuffer(e, "<u4").tolist() for e in own.encode(every)] == [w.ids for w in wanted]


def test_signs_behind_words_and_words_met_lately(monkeypatch):
    with open(FILE, encoding="utf-8") as file:
        own = token_files.WordTokenizer(file.read())
    whole, asked, modelled = Tokenizer.from_file(FILE), [], []
    own.tokenizer = SimpleNamespace(encode=lambda word, **how: asked.append(word) or whole.encode(word, **how), model=whole.model)
    own.tokenize = lambda word: modelled.append(word) or whole.model.tokenize(word)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    rng = random.Random(3)
    tails = ["".join(rng.choices(string.punctuation, k=rng.randint(1, 4))) for _ in range(400)] + list(string.punctuation)
    texts = [" ".join(rng.choice(["Gr\u00f6\u00dfe", "SLIDE", "layout", "don't"]) + t for t in tails[i:i + 40]) for i in range(0, len(tails), 40)]
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    # Only runs of signs and words that are not of letters go through the whole tokenizer, and no word of each text is learned twice.
    assert all(not w[0].isalpha() or w.startswith("don't") for w in asked)
    assert modelled.count("slide") == modelled.count("layout") == 1


def test_files(slides, spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in zip(rng.sample(range(-500, 5000), 1400), texts())]
    rows += [(None, "no id"), (None, None), (9999, None), (9998, ""), (9997, "slide " * 70_000), (42_000, "x"), (42_000, "x"), (42_000, "y")]
    path = shared_dir(spark, "token-test")
    token_files.write_token_files(slides(rows).repartition(5), path, FILE)
    found = token_files.read_token_files(spark, path, keep_ids=True).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(FILE)
    wanted = sorted(((i is not None, i or 0), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted(((r.slide_id is not None, r.slide_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == wanted
    assert [r.slide_id for r in found if r.slide_id is not None] == sorted(i for i, _ in rows if i is not None)
    at = 0
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    empty = shared_dir(spark, "token-test")
    token_files.write_token_files(slides([]), empty, FILE)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_words_met_before_are_not_tokenized_again():
    """Words of some hundred thousand texts outlast a worker's slices."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = token_files.WordTokenizer(file.read())

    def words(k):
        return [" ".join("q" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(100_000 * k, 100_000 * (k + 1)))]

    first = tokenizer.encode(words(0))
    for k in range(1, 7):
        tokenizer.encode(words(k))
    tokenizer.tokenize = None
    assert tokenizer.encode(words(0)) == first
