"""Results that are read more than once: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.session import shared_dir


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """Stored copy of ``df`` with a compact bigint ``key``; stored, so that the numbers stay put."""
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), purpose)
