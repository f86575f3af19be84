"""Token ids of slide texts in files of Simple-8b words.

A file is a Parquet part whose rows are blocks, in the order of the slides. A block's payload is
binary and complete in itself: a header, the slide ids, the offsets of their tokens, and the ids in
64-bit words. The top four bits of a word select how many ids of how many bits it holds; an
escape word is followed by a word with one id of up to 64 bits.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import kept

#: Ids in a word and the bits of each, by selector (fixed values of the coding).
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
         (2, 30), (1, 60))
ESCAPE = 15
MAGIC = b"S8B1"
_HEADER = struct.Struct("<4sIQQ")
#: A block ends with the slide that brings it to so many ids, or with so many slides.
BLOCK_IDS, BLOCK_SLIDES = 1 << 16, 1024
#: Characters tokenized at once, and words that a worker remembers: those met since the last so many outlast the others.
SLICE_CHARS, REMEMBERED = 1 << 21, 400_000
BLOCKS = "part int, block int, n_slides long, n_ids long, payload binary"


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids: each word takes as many ids as fit."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    chosen = np.full(n, ESCAPE, np.int8)
    for selector in range(len(PACKS) - 1, -1, -1):
        count, bits = PACKS[selector]
        # Marks where a run of that many narrow ids begins; ids past the end count as narrow.
        run = np.ones(n + count, bool)
        run[:n] = ids < np.uint64(1 << bits)
        if np.count_nonzero(run[:n]) < min(count, n):
            continue
        have = 1
        while have < count:
            more = min(have, count - have)
            run[:-more] &= run[more:]
            have += more
        chosen[run[:n]] = selector
    step = np.minimum(np.array([c for c, _ in PACKS] + [1, 1])[chosen], n - np.arange(n))
    starts, i, steps = [], 0, step.astype(np.uint8).tobytes()
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, np.int64)
    picked = chosen[at]
    word_at = np.cumsum(1 + (picked == ESCAPE)) - (1 + (picked == ESCAPE))
    words = np.zeros(len(at) + np.count_nonzero(picked == ESCAPE), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    ends = at + step[at]
    for selector in np.unique(picked).tolist():
        own = picked == selector
        words[word_at[own]] = np.uint64(selector << 60)
        if selector == ESCAPE:
            words[word_at[own] + 1] = ids[at[own]]
            continue
        count, bits = PACKS[selector]
        spots = at[own][:, None] + np.arange(count)
        values = np.where(spots < ends[own][:, None], padded[spots], np.uint64(0))
        words[word_at[own]] |= np.bitwise_or.reduce(values << (np.arange(count) * bits).astype(np.uint64), axis=1)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of Simple-8b words, all words of one selector at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True  # holds an id, whatever its top bits say
    counts = np.array([c for c, _ in PACKS] + [0, 0])[selectors]
    counts[raw] = 1
    starts = np.cumsum(counts) - counts
    out = np.zeros(max(n, int(counts.sum())), np.uint64)
    out[starts[raw]] = words[raw]
    for selector, (count, bits) in enumerate(PACKS):
        own = (selectors == selector) & ~raw
        if own.any():
            shifted = words[own][:, None] >> (np.arange(count) * bits).astype(np.uint64)
            out[starts[own][:, None] + np.arange(count)] = shifted & np.uint64((1 << bits) - 1)
    return out[:n]


def write_block(slide_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block: header, slide ids, marks of null ids, token offsets, words."""
    words = pack(np.concatenate(ids))
    offsets = np.cumsum([0, *map(len, ids)])
    return b"".join([
        _HEADER.pack(MAGIC, len(slide_ids), len(words), int(offsets[-1])),
        np.array([i or 0 for i in slide_ids], "<i8").tobytes(),
        np.array([i is None for i in slide_ids], "u1").tobytes(),
        offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Slide ids, token offsets (one more than slides) and all ids of a block."""
    magic, n_slides, n_words, n_ids = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEADER.size
    ids = np.frombuffer(payload, "<i8", n_slides, at).tolist()
    nulls = np.frombuffer(payload, "u1", n_slides, at := at + 8 * n_slides).tolist()
    offsets = np.frombuffer(payload, "<u8", n_slides + 1, at := at + n_slides).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, at + 8 * (n_slides + 1))
    return [None if gone else i for i, gone in zip(ids, nulls, strict=True)], offsets, unpack(words, n_ids)


#: Words of small Latin letters, which a tokenizer's normalizer and splitter leave as they are.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Signs that stand together as a token group of their own behind a word.
_SIGNS = string.punctuation


def byte_letters() -> dict[int, str]:
    """What a byte-level tokenizer writes for each of the letters above: one sign for each byte of its UTF-8 form."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = dict(zip(shown, map(chr, shown), strict=True))
    signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in signs)}
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(223, 256)}


class _Known(dict):
    """Ids of words; a word that is not there yet is learned."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.learn(word)
        return ids


class WordTokenizer:
    """Ids of texts by a byte-level tokenizer that lower-cases and drops white space, word by word.

    A new word of letters goes straight to the tokenizer's model, any other through the whole tokenizer; ASCII signs
    behind a word of letters are split off by the tokenizer, so their ids follow those of the word.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.signs = Tokenizer.from_str(vocabulary), byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.known, self.earlier = _Known(self._learn), {}

    def _learn(self, word: str) -> bytes:
        if (ids := self.earlier.get(word)) is not None:
            return ids
        core = word.rstrip(_SIGNS)
        small = core.lower()
        if not _PLAIN.fullmatch(small):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if small != word:
            return self.known[small] + self.known[word[len(core):]] if len(core) < len(word) else self.known[small]
        spelled = small if small.isascii() else small.translate(self.signs)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.earlier, self.known = self.known, _Known(self._learn)
        ids = self.known.__getitem__
        return [b"".join(map(ids, text.replace("\n", " ").split(" "))) for text in texts]


def _tokenizer(vocabulary: str) -> WordTokenizer:
    """This worker's tokenizer; a worker that runs several tasks makes it once."""
    return kept(hashlib.sha256(vocabulary.encode()).digest(), lambda: WordTokenizer(vocabulary))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    tokenizer, end = _tokenizer(vocabulary), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        slide_ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= SLICE_CHARS or i + 1 == len(texts):
                encoded = tokenizer.encode([t or "" for t in texts[at:i + 1]])
                yield from zip(slide_ids[at:i + 1], (np.frombuffer(e + end, "<u4") for e in encoded), strict=True)
                at, size = i + 1, 0


def write_token_files(slides: DataFrame, path: str, tokenizer_file: str, end_id: int = 2) -> None:
    """Write the token ids of ``slides`` (``slide_id, text``; more columns are left aside) below ``path``.

    ``tokenizer_file`` is a tokenizer of the tokenizers library that drops white space; the driver reads it
    and broadcasts it (a vocabulary is bounded). Each text is encoded whole, without special tokens, and
    ``end_id`` follows it; a null text is an empty one. Slides are written in ascending order of
    ``slide_id``, a null id first, repeated ids in an order of their texts' hash; the ranges of that order are
    written by separate tasks, and a lost task writes its part again. An empty table leaves a file without blocks.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        shared = slides.sparkSession.sparkContext.broadcast(file.read())
    order = [F.col("slide_id").asc_nulls_first(), F.col("_tie")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, n = TaskContext.get().partitionId(), 0, [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_slides", pa.int64()), ("n_ids", pa.int64()),
                            ("payload", pa.binary())])

        def row():
            payload = write_block([i for i, _ in held], [e for _, e in held])
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_slides": len(held), "n_ids": n,
                                                "payload": payload}], schema=schema)

        for slide_id, ids in _encoded(batches, shared.value, end_id):
            held.append((slide_id, ids))
            n += len(ids)
            if n >= BLOCK_IDS or len(held) >= BLOCK_SLIDES:
                yield row()
                block, held, n = block + 1, [], 0
        if held:
            yield row()

    ordered = slides.select(F.col("slide_id").cast("bigint"), "text").withColumn("_tie", F.xxhash64("text")).repartitionByRange(
        *order).sortWithinPartitions(*order)
    ordered.drop("_tie").mapInArrow(blocks, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Read token files back: ``slide_id, start, n_tokens, ids_crc32`` and, if ``keep_ids``, ``ids``.

    ``start`` counts the ids of all slides before, ``n_tokens`` includes the end id, ``ids_crc32`` is the unsigned
    checksum of the ids as little-endian unsigned 32-bit integers, ``ids`` those bytes.
    """
    files = spark.read.schema(BLOCKS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_part_start"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "block", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("_block_start"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("_part_start") + F.col("_block_start")).alias("_from"))
    fields = [("part", pa.int32()), ("block", pa.int32()), ("slide_id", pa.int64()), ("at", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                slide_ids, offsets, ids = read_block(payload)
                own = [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                n = len(slide_ids)
                columns = [[part] * n, [block] * n, slide_ids, offsets[:-1], np.diff(offsets),
                           [zlib.crc32(o) for o in own], own if keep_ids else [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)],
                                                 names=[name for name, _ in fields])

    decoded = files.select("part", "block", "payload").mapInArrow(
        rows, "part int, block int, slide_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    found = decoded.join(starts, ["part", "block"]).select(
        "slide_id", (F.col("_from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return found if keep_ids else found.drop("ids")
