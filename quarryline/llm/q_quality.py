"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.quality import prose_distance, text_statistics
from quarryline.sources import read_table


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents that are no natural prose, and their kind."""
    scored = prose_distance(read_table(spark, root, "documents"), read_table(spark, root, "common_words"))
    return scored.filter("kind <> 'prose'").select("doc_id", "kind").distinct()


def p10_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The statistics of every document."""
    return text_statistics(read_table(spark, root, "documents"), read_table(spark, root, "common_words"))


def p10_outlierness(spark: SparkSession, root: str) -> DataFrame:
    """The distance of every document from prose, and what contributes to it."""
    return prose_distance(read_table(spark, root, "documents"), read_table(spark, root, "common_words"))


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_outlierness": p10_outlierness}
SQL = {}
