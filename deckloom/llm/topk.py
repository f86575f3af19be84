"""Exact best matches of slide feature vectors by block-at-a-time pruning.

Vectors are turned into whole numbers and sorted into blocks of near ids. A block keeps its vectors as forward
index, and for each term (component) the largest and the least value. Summed over a query's terms, these
bound every score of the block. Blocks are taken in the order of their bounds, until the bounds fall
below the query's k-th best score: first the few best blocks, whose scores give that bound, then the rest that
can still hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.common import stored

#: Vectors of a block, queries of a group, block summaries of a pack.
BLOCK, GROUP, PACK = 256, 256, 256
#: Blocks that a task should be worth, and tasks for each core at least.
TASK_BLOCKS, TASKS_PER_CORE = 16, 2
#: Blocks that each query scores first, of each pack.
FIRST = 2
SCALE = 256
MATCHES = "query_id long, slide_id long, score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``slide_id, v``: components times ``SCALE``, rounded down; vectors with null or non-finite ones are left out."""
    known = vectors.where(F.col("slide_id").isNotNull() & F.col("features").isNotNull())
    fine = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return known.where(fine).select("slide_id", F.transform(
        "features", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def _pack(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, "<i8").tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    held = np.frombuffer(data, "<i8")
    return held.reshape(-1, width) if width else np.zeros((0, 0), np.int64)


def _widen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices to the width of the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _bundles(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of vectors bundled in their order: ``name, ids, width, vectors, high, low``, ids are array<long>."""
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []

        def row():
            matrix = _matrix(held)
            return pa.RecordBatch.from_pylist([{
                "first": ids[0], "ids": ids, "width": matrix.shape[1], "vectors": _pack(matrix),
                "high": _pack(matrix.max(axis=0)), "low": _pack(matrix.min(axis=0))}], schema=pa.schema([
                    ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()),
                    ("high", pa.binary()), ("low", pa.binary())]))

        for batch in batches:
            found = batch.column(1)
            for slide_id, v in zip(batch.column(0).to_pylist(), found, strict=True):
                ids.append(slide_id)
                held.append(v.values.to_numpy().astype(np.int64))
                if len(ids) >= size:
                    yield row()
                    ids, held = [], []
        if ids:
            yield row()

    ordered = rows.repartitionByRange("slide_id").sortWithinPartitions("slide_id", "v")
    made = ordered.mapInArrow(bundle, "first long, ids array<long>, width int, vectors binary, high binary, low binary")
    return stored(made.withColumn(name, F.monotonically_increasing_id()), name)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query (row) with a vector of a block (column) is larger."""
    return _dot(np.maximum(q, 0), high) + _dot(np.minimum(q, 0), low)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; by floating point where that is exact."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _summaries(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(row.width, default=0)
    high, low = (np.stack([np.pad(np.frombuffer(b, "<i8"), (0, width - w)) for b, w in zip(
        column, row.width, strict=True)]) for column in (row.high, row.low))
    return np.asarray(row.blocks), high, low


def _best(scores: np.ndarray, ids: np.ndarray, k: int, least: int | None) -> np.ndarray:
    """Places of the ``k`` best of one query's scores, least id first among equals."""
    some = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least)
    if len(some) > 4 * k:
        cut = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= cut]
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _score(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None):
    """Best matches of each query in one block, its own id left out; arrays of query id, slide id, score."""
    q, vectors = _widen(q, vectors)
    scores = _dot(q, vectors)
    scores[query_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    out = []
    for i, own in enumerate(query_ids):
        at = _best(scores[i], ids, k, None if least is None else least[i])
        at = at[scores[i][at] > np.iinfo(np.int64).min]
        out.append((np.full(len(at), own), ids[at], scores[i][at]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def top_matches(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, slide_id, score``: the ``k`` vectors of largest inner product for each query.

    ``vectors`` and ``queries``: ``slide_id, features`` (array of numbers); more columns are left aside. Components count as whole numbers
    (``SCALE`` times, rounded down). A query's own id is no match of it; ties go to the smaller id; with fewer
    than ``k`` vectors all are returned. Rows with a null id or vector, or a null or non-finite component, take no part.
    A shorter vector counts as filled up with zeros, an empty one scores zero. Repeated rows all are matches; of repeated
    query ids the least vector asks. Scores must fit a long. An empty table gives an empty result.
    """
    asked = whole_vectors(queries).groupBy("slide_id").agg(F.min("v").alias("v"))
    blocks = _bundles(whole_vectors(vectors), BLOCK, "block")
    groups = _bundles(asked, GROUP, "query_group").drop("high", "low", "first")
    # The summaries of some neighbouring blocks make one row; each such row meets each group of queries once.
    in_part = F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    packs = blocks.groupBy(F.shiftright("block", 33).alias("p"), F.floor(in_part / PACK).alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("block", "width", "high", "low"))).alias("s"))
    packs = stored(packs.select("p", "n", F.col("s.block").alias("blocks"), F.col("s.width").alias("width"),
                                F.col("s.high").alias("high"), F.col("s.low").alias("low")), "block-packs")
    cells = max(packs.count(), 1)
    numbered = packs.withColumn("cell", F.pmod(F.xxhash64("p", "n"), F.lit(cells)).cast("int")).drop("p", "n")
    # Tasks in proportion to the blocks: few vectors do not pay for the start of many tasks.
    tasks = max(TASKS_PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism, blocks.count() // TASK_BLOCKS)
    spread = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    meets = spread.select("query_group", "cell", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"),
                          F.col("vectors").alias("query_vectors")).join(numbered, "cell").coalesce(tasks)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                names, high, low = _summaries(row)
                q, high = _widen(_unpack(row.query_vectors, row.query_width), high)
                bounds = _bounds(q, high, _widen(q, low)[1])
                at = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
                n = len(at)
                yield pd.DataFrame({"query_group": row.query_group, "query_no": np.repeat(np.arange(n), at.shape[1]),
                                    "block": names[at].ravel(), "bound": np.take_along_axis(bounds, at, 1).ravel()})

    def seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ask = np.asarray(row.asked)
                q = _unpack(row.query_vectors, row.query_width)[ask]
                found = _score(np.asarray(row.query_ids)[ask], q, np.asarray(row.ids), _unpack(row.vectors, row.width), k, None)
                yield pd.DataFrame(dict(zip(("query_id", "slide_id", "score"), found, strict=True)))

    asking = groups.select("query_group", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"),
                           F.col("vectors").alias("query_vectors"))
    firsts = meets.mapInPandas(first, "query_group long, query_no int, block long, bound long")
    by_query = Window.partitionBy("query_group", "query_no").orderBy(F.desc("bound"), "block")
    firsts = firsts.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") <= FIRST).coalesce(tasks)
    pairs = firsts.groupBy("query_group", "block").agg(F.sort_array(F.collect_list("query_no")).alias("asked"))
    seeded = pairs.join(asking, "query_group").join(blocks.select("block", "ids", "width", "vectors"), "block").coalesce(tasks)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "slide_id")
    bound = seeded.mapInPandas(seeds, MATCHES).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") == k).select(
        "query_id", F.col("score").alias("least"))
    # The bounds go back to the groups, as an array in the order of their queries.
    lowest = int(np.iinfo(np.int64).min) + 1
    places = groups.select("query_group", F.posexplode("ids").alias("at", "query_id")).join(bound, "query_id", "left").groupBy(
        "query_group").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("least", F.lit(lowest)).alias("least")))).alias("b"))
    places = stored(places.select("query_group", F.col("b.least").alias("least")).coalesce(tasks), "least-scores")

    def survivors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                names, high, low = _summaries(row)
                q, high = _widen(_unpack(row.query_vectors, row.query_width), high)
                bounds = _bounds(q, high, _widen(q, low)[1])
                bounds[bounds < np.asarray(row.least)[:, None]] = lowest - 1
                best = bounds.max(axis=0, initial=lowest - 1)
                at = np.flatnonzero(best >= lowest)
                yield pd.DataFrame({"query_group": row.query_group, "block": names[at], "bound": best[at]})

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for row in frame.itertuples():
                if row.query_group not in held:
                    held = {row.query_group: np.tile(np.asarray(row.least)[:, None], (1, k))}
                best = held[row.query_group]
                q, high = _widen(_unpack(row.query_vectors, row.query_width), np.frombuffer(row.high, "<i8")[None, :])
                bounds = _bounds(q, high, _widen(q, np.frombuffer(row.low, "<i8")[None, :])[1])[:, 0]
                # Blocks come by falling bound: the bound of a query rises with each block that it scores.
                least = np.maximum(np.asarray(row.least), best.min(axis=1))
                ask = np.flatnonzero(bounds >= least)
                if not len(ask):
                    continue
                ids = np.asarray(row.query_ids)
                found = _score(ids[ask], q[ask], np.asarray(row.ids), _unpack(row.vectors, row.width), k, least[ask])
                for i in ask:
                    own = found[2][found[0] == ids[i]]
                    best[i] = np.sort(np.concatenate([best[i], own]))[-k:]
                yield pd.DataFrame(dict(zip(("query_id", "slide_id", "score"), found, strict=True)))

    left = meets.join(places, "query_group").coalesce(tasks).mapInPandas(survivors, "query_group long, block long, bound long")
    scored = left.join(asking.join(places, "query_group"), "query_group").join(
        blocks.select("block", "ids", "width", "vectors", "high", "low"), "block")
    # One group's blocks are dealt to several tasks, each by falling bound.
    dealt = scored.repartition(F.col("query_group"), F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions(
        "query_group", F.desc("bound"), "block").coalesce(tasks)
    matches = dealt.mapInPandas(rest, MATCHES).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return matches.select("query_id", "rank", "slide_id", "score").coalesce(tasks)
