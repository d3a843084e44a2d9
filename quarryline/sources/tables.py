"""Readers of the parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
