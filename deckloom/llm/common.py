"""Helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.session import shared_dir

#: White space that parts the words of a slide text: space, tab, and the line characters.
BLANK = "\\x20\\x09-\\x0D"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system after a batch: Python workers stay, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:
        trim(0)


_KEPT: dict[bytes, object] = {}


def kept(key: bytes, make: Callable[[], object]):
    """What a worker keeps from task to task, made once. Only the last operator's: workers go on to other operators."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def packed(slides: DataFrame, *needed: str) -> DataFrame:
    """Whole rows as the struct ``_row`` and the columns that an operator reads: no name can clash."""
    return slides.select(F.struct("*").alias("_row"), *needed)


def unpacked(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns ``names`` of packed rows, and ``more`` in place of those of the same name."""
    return rows.select(*[F.col("_row")[n].alias(n) for n in names if n not in more], *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    """The words of a text, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANK}]+")).cast("bigint")
