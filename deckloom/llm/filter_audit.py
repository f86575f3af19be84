"""Interaction of text filters: what each order of five filters removes, keeps and loses.

Four filters judge a slide text by itself, the fifth drops a text that a slide of a smaller id has as well. For that one, texts are
dealt out in ranges whose bounds are prefixes of texts: each as short as parts it from its predecessor, and
as many as the bytes of all texts ask for. Every range is inserted into compressed tries whose terminals hold the
smallest id; a walk over the terminals gives the flags. Each slide is then a mask of five bits, and all 120
orders are read off the counts of the 32 masks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import give_back, stored
from deckloom.operators.skew import running_sum

#: The filters; a filter's bit in a mask is its place here.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Fewest words; most percent of capitals among characters; least percent of distinct words; signs that no text may hold.
LEAST_WORDS, MOST_CAPITALS, LEAST_DISTINCT, SIGNS = 200, 2, 50, b"#$%&*|"
#: Bytes of text that a trie takes before it is walked and emptied, and bounds that so many bytes (or a task's fewer) propose.
TRIE_BYTES, PROPOSALS = 16 << 20, 16
#: Bytes of text for each range, at least where cores are idle, and the most ranges (beyond, ranges grow; they are streamed, never held).
RANGE_BYTES, LEAST_BYTES, MOST_RANGES = 64 << 20, 1 << 20, 20_000
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
_ROWS = [("range", pa.int32()), ("text", pa.binary()), ("slide_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()),
         ("n", pa.int64())]
_ROWS_DDL = "range int, text binary, slide_id long, part string, mask int, n long"


def own_mask(text: bytes) -> int:
    """The filters that a text (UTF-8) fails by itself."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def shared_length(a: bytes, b: bytes, at: int = 0, other: int = 0) -> int:
    """Bytes that ``a`` from ``at`` and ``b`` from ``other`` have in common."""
    most, n, step = min(len(a) - at, len(b) - other), 0, 64
    while n < most and a[at + n:at + n + step] == b[other + n:other + n + step]:
        n, step = n + step, step * 2
    if n >= most:
        return most
    step = min(step, most - n)
    while step:
        # The first difference lies within the next ``step`` bytes, or right behind them.
        half = (step + 1) // 2
        if a[at + n:at + n + half] == b[other + n:other + n + half]:
            n, step = n + half, step - half
        elif half == 1:
            break
        else:
            step = half - 1
    return n


class _Node:
    """An edge's label (``text[start:end]``), the nodes below by their first byte, and what a text that ends here holds."""

    __slots__ = ("text", "start", "end", "below", "held")

    def __init__(self, text: bytes, start: int, end: int) -> None:
        self.text, self.start, self.end, self.below, self.held = text, start, end, {}, None


class Trie:
    """Compressed trie over whole texts; labels refer to the texts and copy nothing."""

    def __init__(self) -> None:
        self.root, self.size = _Node(b"", 0, 0), 0

    def terminal(self, text: bytes) -> _Node:
        """The node at which ``text`` ends, made if it is not there."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = _Node(text, at, len(text))
                self.size += len(text)
                return child
            length = child.end - child.start
            if text[at:at + length] == child.text[child.start:child.end]:
                node, at = child, at + length
                continue
            k = min(shared_length(text, child.text, at, child.start), length)
            middle = _Node(child.text, child.start, child.start + k)
            child.start += k
            middle.below[child.text[child.start]] = child
            node.below[text[at]] = middle
            node, at = middle, at + k
        return node

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        """Every text with what its terminal holds; the trie is empty afterwards."""
        stack, self.root, self.size = [self.root], _Node(b"", 0, 0), 0
        while stack:
            node = stack.pop()
            if node.held is not None:
                yield node.text[:node.end], node.held
            stack.extend(node.below.values())


class _Least:
    """What a terminal holds: the smallest id, its slides by part, and the text's own mask."""

    __slots__ = ("slide_id", "parts", "mask")

    def __init__(self, mask: int) -> None:
        self.slide_id, self.parts, self.mask = None, {}, mask

    def add(self, slide_id: int, part: str, n: int) -> list[tuple[int, str, int]]:
        """Take slides of one id in; returns those that are now known to have a smaller one of the same text."""
        if self.slide_id is not None and slide_id > self.slide_id:
            return [(slide_id, part, n)]
        gone = []
        if self.slide_id is None or slide_id < self.slide_id:
            gone = [(self.slide_id, p, m) for p, m in self.parts.items()]
            self.slide_id, self.parts = slide_id, {}
        self.parts[part] = self.parts.get(part, 0) + n
        return gone


def _flags(rows: Iterable[tuple], final: bool) -> Iterator[tuple]:
    """Rows ``text, slide_id, part, mask, n`` to the same, with duplicates flagged and without their text.

    A trie is walked when it is full; unless ``final`` the slides of the smallest ids keep their texts, to be compared
    with those of other tries. In the final round texts come in order, so that a trie is only walked between texts.
    """
    trie, before = Trie(), None
    for text, slide_id, part, mask, n in rows:
        if trie.size >= TRIE_BYTES and text != before:
            yield from _walk(trie, final)
        before = text
        node = trie.terminal(text)
        if node.held is None:
            node.held = _Least(own_mask(text) if mask is None else mask)
        if slide_id is None:  # neither smaller nor larger than any other
            yield None, None, part, node.held.mask, n
            continue
        for gone_id, gone_part, m in node.held.add(slide_id, part, n):
            yield None, gone_id, gone_part, node.held.mask | DUPLICATE, m
    yield from _walk(trie, final)


def _walk(trie: Trie, final: bool) -> Iterator[tuple]:
    for text, held in trie.terminals():
        for part, n in held.parts.items():
            yield None if final else text, held.slide_id, part, held.mask, n


def _batches(rows: Iterator[tuple], place) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows and the range that ``place`` gives each."""
    held, size = [], 0

    def batch():
        columns = [[place(r) for r in held], *([r[i] for r in held] for i in range(5))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ROWS, strict=True)],
                                          names=[name for name, _ in _ROWS])

    for row in rows:
        held.append(row)
        size += len(row[0] or b"") + 64
        if size >= 8 << 20:
            yield batch()
            held, size = [], 0
            give_back()
    if held:
        yield batch()
    give_back()


def text_bounds(slides: DataFrame) -> list[bytes]:
    """Prefixes that part all texts into ranges of like size.

    Each slab of texts is cut by order into ``PROPOSALS`` pieces of as many bytes and proposes, for each, the shortest prefix that parts
    its last text from the one before; running totals over the pieces of all slabs pick the bounds. All texts
    count, and no more than ``MOST_RANGES`` prefixes reach the driver.
    """
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in _slabs(t for batch in batches for t in batch.column(0).to_pylist()):
            texts, found, size = sorted(slab), [], 0
            step = sum(map(len, texts)) // PROPOSALS + 1
            for i, text in enumerate(texts):
                size += len(text)
                if size >= step or i + 1 == len(texts):
                    found.append((text[:shared_length(texts[i - 1] if i else b"", text) + 1], size))
                    size = 0
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                              pa.array([f[1] for f in found], pa.int64())], names=["prefix", "bytes"])
            give_back()

    proposed = stored(slides.select(_bytes("text").alias("text")).mapInArrow(propose, "prefix binary, bytes long").withColumn(
        "no", F.monotonically_increasing_id()), "text-bounds")
    total = proposed.agg(F.sum("bytes")).first()[0] or 0
    least = min(int(slides.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST_BYTES)
    parts = min(max(total // RANGE_BYTES, least) + 1, MOST_RANGES)
    if parts == 1:
        return []
    summed = running_sum(proposed, [], ["prefix", "no"], "bytes", "upto", cut=F.substring("prefix", 1, 2))
    share = F.lit(total / parts)
    crossed = F.floor(F.col("upto") / share) > F.floor((F.col("upto") - F.col("bytes")) / share)
    return sorted({bytes(r[0]) for r in summed.where(crossed).select("prefix").collect()})


def _slabs(texts: Iterable[bytes]) -> Iterator[set[bytes]]:
    held, size = set(), 0
    for text in texts:
        if text not in held:
            held.add(text)
            size += len(text)
        if size >= TRIE_BYTES:
            yield held
            held, size = set(), 0
    if held:
        yield held


def _bytes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def filter_masks(slides: DataFrame) -> DataFrame:
    """``slide_id, part, mask, n``: how many slides of an id and part fail which filters (bits of ``FILTERS``).

    Exact copies are combined in the trie of the task that reads them, so a text that a third of all slides share
    reaches its range as one row of each slab.
    """
    bounds = slides.sparkSession.sparkContext.broadcast(text_bounds(slides))
    ranges = len(bounds.value) + 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for slide_id, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield text, slide_id, part, None, 1

        found = bounds.value
        return _batches(_flags(rows(), final=False), lambda r: (
            (r[1] or 0) % ranges if r[0] is None else bisect_right(found, r[0])))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)

        def judged():
            # Rows without a text come first in a range and are judged already.
            given = rows()
            for row in given:
                if row[0] is not None:
                    yield from _flags(chain([row], given), final=True)
                    return
                yield row

        return _batches(judged(), lambda r: 0)

    given = slides.select(F.col("slide_id").cast("bigint"), F.coalesce("source", F.lit("")).alias("part"), _bytes("text").alias("text"))
    dealt = given.mapInArrow(first, _ROWS_DDL).repartitionById(ranges, F.col("range")).sortWithinPartitions(
        F.col("text").asc_nulls_first())
    return dealt.mapInArrow(second, _ROWS_DDL).select("slide_id", "part", "mask", "n")


def audit_filters(slides: DataFrame, reviews: DataFrame) -> DataFrame:
    """What every order of the five filters does to the slide texts of each source.

    ``slides``: ``slide_id, source, text``; ``reviews``: ``slide_id, content_preserved, layout_valid``; more columns are left aside. Filters: A fewer
    than 200 words, B under half of the words distinct, C over two percent capitals, D one of ``#$%&*|``, E the text of a smaller
    slide id. Returns, for each source (``part``, null as the empty string), order (``filter_order``) and ``step`` from 1, slides ``kept`` after
    the step, ``removed`` by it, ``redundant`` (fail its filter, gone before), ``unique_fails`` (fail its filter only), ``good_lost`` (removed, a
    review says content preserved), ``toxic_lost`` (removed, a review says layout not valid) and ``shapley`` (removed by this filter, over
    all orders).

    A null text is empty. A null id is neither smaller nor larger than another and has no review; rows that repeat an id are slides of
    their own, and none is smaller than the other. Several reviews of a slide count as one that says what any says. Texts of any
    length are compared whole; no slides give no rows.
    """
    marks = reviews.groupBy("slide_id").agg(
        F.max((F.col("content_preserved")).cast("int")).alias("_good"), F.max((~F.col("layout_valid")).cast("int")).alias("_toxic"))
    masks = filter_masks(slides).join(marks.where("_good = 1 OR _toxic = 1"), "slide_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.withColumn("_step", F.explode(F.lit(_steps()))).select(
        "part", "masks", F.substring("_step", 1, 5).alias("filter_order"), *[
            F.substring("_step", at, size).cast("int").alias(name) for name, at, size in (("step", 6, 1), ("_own", 7, 2), ("_before", 9, 2))])
    own, before = F.col("_own"), F.col("_before")

    def total(value, which) -> Column:
        return F.aggregate("masks", F.lit(0).cast("bigint"), lambda t, m: t + F.when(which(m["mask"]), value(m)).otherwise(0))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(own) != 0

    def here(mask: Column) -> Column:
        return fails(mask) & (mask.bitwiseAND(before) == 0)

    # Of the orders of all filters, one in as many as a mask has bits puts a given one of them first.
    orders = factorial(len(FILTERS))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m["n"], lambda mask: mask.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(lambda m: m["n"], here).alias("removed"),
        total(lambda m: m["n"], lambda mask: fails(mask) & (mask.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m["n"], lambda mask: mask == own).alias("unique_fails"),
        total(lambda m: m["good"], here).alias("good_lost"), total(lambda m: m["toxic"], here).alias("toxic_lost"),
        total(lambda m: m["n"] * F.floor(F.lit(orders) / F.bit_count(m["mask"])).cast("bigint"), fails).alias("shapley"))



def _steps() -> list[str]:
    """Every order and step as one text: the order, the step, the bit of its filter and the bits of those before, in two digits."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            found.append(f"{''.join(FILTERS[g] for g in order)}{i + 1}{1 << f:02d}{before:02d}")
            before |= 1 << f
    return found
