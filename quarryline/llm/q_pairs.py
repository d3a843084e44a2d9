"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.pairs import broken_pairs
from quarryline.sources import read_table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Each defective sample with its defect."""
    return broken_pairs(read_table(spark, root, "sft_data")).distinct()


def p3_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many samples have each defect."""
    return p3_found(spark, root).groupBy("defect").agg(F.count(F.lit(1)).alias("n_samples"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
SQL = {}
