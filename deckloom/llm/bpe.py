"""Byte-level BPE encoding and decoding of slide texts.

Each partition keeps a small DuckDB database of the merge table. Distinct words become rows of
(word, position, token, next token); a recursive query joins them with the merge
table and contracts, in every word, the leftmost pair of least rank until no pair is left. Decoding
joins the ids of texts with the token table in their order and cuts the bytes where texts end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import give_back, kept, packed, unpacked

#: Characters of text handled at once, words of one recursive query, tokens of one decoding query.
SLICE_CHARS, WORDS_AT_ONCE, TOKENS_AT_ONCE = 1 << 20, 30_000, 1 << 17
#: Distinct words (matches of the pattern) that a worker remembers; those met since the last so many outlast the others.
REMEMBERED = 100_000
#: White space as Unicode defines it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Rows carry the token behind their own, so that pairs need no join of rows with rows; a contraction drops the first row of its pair.
ENCODE = """
WITH RECURSIVE step(w, p, t, n, done) AS (
  SELECT w, p, t, n, FALSE FROM words
  UNION ALL
  (WITH live AS (SELECT w, p, t, n FROM step WHERE NOT done),
   best AS (SELECT w, min(merged::BIGINT << 32 | p) AS code FROM live JOIN merges ON first = t AND second = n GROUP BY w)
   SELECT l.w, CASE WHEN l.p > (code & 4294967295) THEN l.p - 1 ELSE l.p END,
     CASE WHEN l.p = (code & 4294967295) + 1 THEN (code >> 32)::INTEGER ELSE l.t END,
     CASE WHEN l.p + 1 = (code & 4294967295) THEN (code >> 32)::INTEGER ELSE l.n END, code IS NULL
   FROM live l LEFT JOIN best USING (w)
   WHERE code IS NULL OR l.p <> (code & 4294967295)))
SELECT w, t FROM step WHERE done ORDER BY w, p"""

DECODE = "SELECT piece FROM ids JOIN tokens USING (t) ORDER BY p"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks, from the lines of a rank file (base64 and number)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}


def _ranges(pattern: str) -> str:
    """Characters that a class of the tokenizer library matches, as ranges of a pattern's class.

    The library is asked itself, as its Unicode tables may be of another version than Python's: with the class as its pattern, all that it
    encodes of a text of all characters is what the class matches.
    """
    import tiktoken

    library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    points = np.frombuffer(bytes(library.encode_ordinary("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))).decode().encode(
        "utf-32-le"), "<u4").astype(np.int64)
    breaks = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.r_[0, breaks + 1]], points[np.r_[breaks, len(points) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


@cache
def splitter(pattern: str) -> re.Pattern:
    """A pattern with Unicode classes, for Python's own expressions; one that is spelled out already stays as it is."""
    letters, numbers = (_ranges(r) if r in pattern else "" for r in (r"\p{L}", r"\p{N}"))
    inside = lambda text: text.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", SPACE)
    spelled = re.sub(r"\[\^?[^\]]*\]", lambda m: inside(m[0]), pattern)
    spelled = spelled.replace(r"\S", f"[^{SPACE}]")
    outside = re.split(r"(\[[^\]]*\])", spelled)
    return re.compile("".join(
        part if part.startswith("[") else part.replace(r"\p{L}", f"[{letters}]").replace(
            r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{SPACE}]") for part in outside))


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb

        self.ranks, self.split = ranks, splitter(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp()})
        first, second, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    first.append(a), second.append(b), merged.append(rank)
        held = pa.table({n: pa.array(v, pa.int32()) for n, v in zip(
            ("first", "second", "merged"), (first, second, merged), strict=True)})
        names = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())})
        for name, rows in (("merges", held), ("tokens", names)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _contract(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        following = np.append(tokens[1:], np.int32(-1))
        following[ends - 1] = -1
        self.db.register("words", pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "p": (np.arange(lengths.sum()) - np.repeat(ends - lengths, lengths)).astype(np.int32),
            "t": tokens, "n": following}))
        found = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("words")
        flat = found.column("t").to_numpy().astype("<u4").tobytes()
        cuts = (np.cumsum(np.bincount(found.column("w").to_numpy(), minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Encode matches of the pattern that were not met before; those that are tokens need no contraction."""
        words, ranks, open_words = self.words, self.ranks, []
        for word in new:
            token = word.encode("utf-8", "surrogatepass")
            rank = ranks.get(token)
            if rank is None:
                open_words.append((word, token))
            else:
                words[word] = rank.to_bytes(4, "little")
        at, size = 0, 0
        for i, (_, token) in enumerate(open_words):
            size += len(token)
            if i + 1 - at >= WORDS_AT_ONCE or size >= 16 * WORDS_AT_ONCE or i + 1 == len(open_words):
                own = open_words[at:i + 1]
                words.update(zip([w for w, _ in own], self._contract([t for _, t in own]), strict=True))
                at, size = i + 1, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBERED:
            self.earlier, self.words = self.words, {}
        cut, words = [self.split(t) for t in texts], self.words
        new = set().union(*cut).difference(words)
        if new:
            again = new.intersection(self.earlier)
            words.update((w, self.earlier[w]) for w in again)
            self._learn(new - again)
        return [b"".join(map(words.__getitem__, ms)) for ms in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        pieces, lengths = [], [np.zeros(1, np.int64)]
        for start in range(0, len(flat), TOKENS_AT_ONCE):
            own = flat[start:start + TOKENS_AT_ONCE]
            self.db.register("ids", pa.table({"p": np.arange(len(own), dtype=np.int32), "t": own}))
            piece = self.db.sql(DECODE).to_arrow_table().column("piece").cast(pa.large_binary()).combine_chunks()
            self.db.unregister("ids")
            ends = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset:piece.offset + len(piece) + 1]
            pieces.append(piece.buffers()[2][int(ends[0]):int(ends[-1])])
            lengths.append(np.diff(ends))
        data, upto = b"".join(pieces), np.cumsum(np.concatenate(lengths))
        cuts = upto[np.cumsum([0, *map(len, ids)])].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _codec(lines: bytes, pattern: str) -> Codec:
    """This worker's codec for a rank file; a worker that runs several tasks makes it once."""
    return kept(hashlib.sha256(lines + pattern.encode()).digest(), lambda: Codec(read_ranks(lines), pattern))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= SLICE_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_slides(slides: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``slides`` with all their columns and, in the struct ``tokens``, what their ``text`` encodes to.

    ``rank_file``: path of a rank file (read once by the driver and broadcast: a vocabulary is
    bounded); ``pattern``: the pattern whose matches are encoded separately. ``tokens`` holds
    ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers), ``decoded_sha256``
    (of the bytes that the ids decode to) and, if ``keep_ids``, ``ids`` (those bytes of the ids). A null text is an empty one: no
    tokens. Words that are tokens, and words met before, need no query; all others are contracted, in time that grows with the square of a
    single word's length. Texts of any length are encoded whole, repeated rows alike, an empty table stays empty; a column
    ``tokens`` that was there before is replaced.
    """
    with open(rank_file, "rb") as file:
        lines = slides.sparkSession.sparkContext.broadcast(file.read())
    # The driver spells the classes out: to ask the library for them takes time and memory.
    spelled = splitter(pattern).pattern
    more = ", ids binary" if keep_ids else ""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(lines.value, spelled)
        for batch in batches:
            rows = []
            for texts in _slices(["" if t is None else t for t in batch]):
                encoded = codec.encode(texts)
                decoded = codec.decode([np.frombuffer(e, "<u4") for e in encoded])
                rows += [(len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256(d).hexdigest(), e)
                         for e, d in zip(encoded, decoded, strict=True)]
            frame = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            yield frame if keep_ids else frame.drop(columns="ids")
            give_back()

    return unpacked(packed(slides, "text").withColumn("tokens", tokens(F.col("text"))), slides.columns, "tokens")
