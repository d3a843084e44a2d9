"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.mixing import mix_sources, reached_shares
from quarryline.sources import read_table


def p9_selection(spark: SparkSession, root: str) -> DataFrame:
    """The selected documents with the number of their copies."""
    return mix_sources(read_table(spark, root, "documents"), read_table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of every source, as set and as reached."""
    return reached_shares(p9_selection(spark, root), read_table(spark, root, "mix_targets"))


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares}
SQL = {}
