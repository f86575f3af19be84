"""Byte-level BPE against the tiktoken library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from llm_fixtures import slides  # noqa: F401

from deckloom.llm import bpe, common

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks():
    with open(RANK_FILE, "rb") as file:
        return bpe.read_ranks(file.read())


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def texts(n, seed):
    rng = random.Random(seed)
    signs = "ab 's't  \n\t\r\x1c\x85\xa0\u3000\u00e9\u6f22\u5b571\u00b2\u00bd_-!?'\u0301\U0001F600\U00010400\u2167\u00aa\x00\u200b\ufeff"
    words = ["the", " slide", "'ll", "layout", "<|endoftext|>", "  ", "\n\n", "internationalisation"]
    return [" ".join(rng.choices(words, k=5)) + "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "", " ", "  ", " a", "a ", "  a", "a  b", "we'll  I'm"]


def test_codec():
    codec, wanted = bpe.Codec(ranks(), public_tokenizers.PATTERN), library()
    every = texts(4000, 1)
    encoded = codec.encode(every)
    assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == [wanted.encode_ordinary(t) for t in every]
    assert codec.decode([np.frombuffer(e, "<u4") for e in encoded]) == [t.encode() for t in every]


def test_long_words_and_texts():
    codec, wanted = bpe.Codec(ranks(), public_tokenizers.PATTERN), library()
    every = ["ab" * 1500, "slide " * 60_000]
    encoded = codec.encode(every)
    assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == [wanted.encode_ordinary(t) for t in every]
    assert codec.decode([np.frombuffer(e, "<u4") for e in encoded]) == [t.encode() for t in every]


def test_slides(slides):
    wanted = library()
    rows = list(enumerate(texts(50, 3))) + [(7, None), (None, "a slide"), (1, "twice"), (1, "twice")]
    done = bpe.encode_slides(slides(rows), RANK_FILE, public_tokenizers.PATTERN, keep_ids=True)
    found = done.collect()
    assert len(found) == len(rows) and done.columns[-1] == "tokens"
    for row in found:
        ids = np.array(wanted.encode_ordinary(row.text or ""), "<u4").tobytes()
        assert row.tokens.ids == ids and row.tokens.n_tokens == len(ids) // 4
        assert row.tokens.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert row.tokens.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encode_slides(slides([]), RANK_FILE, public_tokenizers.PATTERN).collect() == []


def test_words_met_lately_are_not_contracted_again(monkeypatch):
    codec, asked = bpe.Codec(ranks(), bpe.splitter(public_tokenizers.PATTERN).pattern), []
    contract = codec._contract
    monkeypatch.setattr(codec, "_contract", lambda words: asked.extend(words) or contract(words))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 3)
    texts = [" zqxjkvu bqqzx\u0100", "", " zqxjkvu vvkqx", " zqxjkvu qqwwz 7\n\n", " zqxjkvu xkkqj"]
    for text in texts:
        encoded = codec.encode([text, "", text])
        assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == [library().encode_ordinary(t) for t in (text, "", text)]
        assert codec.decode([np.frombuffer(e, "<u4") for e in encoded]) == [text.encode(), b"", text.encode()]
    assert asked.count(b" zqxjkvu") == 1


def test_a_worker_keeps_one_operators_things():
    common._KEPT.clear()
    first = common.kept(b"a", lambda: ["codec"])
    assert common.kept(b"a", lambda: ["another"]) is first
    common.kept(b"b", lambda: ["models"])
    assert list(common._KEPT) == [b"b"]
