"""Helpers that keep one hot key from landing whole in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                cut: Column | None = None, width: int = 4096) -> DataFrame:
    """Running total of ``value`` by ``order`` within ``keys``, split by order ranges.

    Each key is cut into ranges that rise with the order (by default ``width`` values
    of the first order column, an integer). Totals run inside a range, and the sum of
    the earlier ranges is joined back. A key that holds a third of the rows is thus
    spread over as many tasks as it has ranges, and one exchange on (keys, range)
    serves the window, the sum and the join.
    """
    ranged = df.withColumn("_range", cut if cut is not None else F.floor(F.col(order[0]) / F.lit(width)))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_local", F.sum(value).over(inside))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return (
        local.join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_range", "_local", "_offset")
    )


def position(df: DataFrame, keys: list[str], order: list[str], out: str,
             cut: Column | None = None, width: int = 4096) -> DataFrame:
    """1-based position by a unique ``order`` within ``keys`` (see ``running_sum``)."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ones, keys, order, "_one", out, cut, width).drop("_one")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by the other columns: the least struct, combined before the shuffle.

    Structs with strings are combined by sorting, so keep this off wide tables on the common path.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    body = F.struct(*lead, *[c for c in rest if c not in lead])
    picked = df.groupBy(*keys).agg(F.min(body).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
