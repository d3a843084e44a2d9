"""Spreading rows over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by keys that few rows share, in as many partitions as shuffles have.

    For stages whose cost is in Python: their input is small in bytes, and adaptive coalescing by size would leave them to few tasks.
    A distinct or aggregate by these keys that follows needs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
