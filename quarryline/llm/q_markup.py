"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.markup import markup_fields
from quarryline.sources import read_table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The kinds of markup in each field of each block."""
    return markup_fields(read_table(spark, root, "content_list")).select("block_id", "field_name", F.explode("kinds").alias("markup")).distinct()


def p4_clean(spark: SparkSession, root: str) -> DataFrame:
    """The clean text of each field of each block."""
    return markup_fields(read_table(spark, root, "content_list")).select("block_id", "field_name", "clean_text")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
SQL = {}
