"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.joins import join_small
from quarryline.llm.lookalikes import unify
from quarryline.sources import read_table

#: Field of the reports, and the table that registers its names; the column has the same name.
FIELDS = (("stock_name", "stocks"), ("institution", "institutions"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Names written otherwise than registered that read the same."""
    reports, parts = read_table(spark, root, "all_reports"), []
    for field, register in FIELDS:
        alike = unify(reports, field, read_table(spark, root, register), field).filter("reads_as is not null and reads_as <> value")
        rows = reports.select("report_id", F.col(field).alias("value")).filter("report_id is not null and value is not null")
        parts.append(join_small(rows, alike.select("value"), ["value"], ["report_id"]).select("report_id", F.lit(field).alias("field_name")))
    return parts[0].unionByName(parts[1]).distinct()


def p7_unified(spark: SparkSession, root: str) -> DataFrame:
    """Each report with both names in their consistent form."""
    out = read_table(spark, root, "all_reports").select("report_id", "stock_name", "institution").distinct()
    for field, register in FIELDS:
        forms = unify(out, field, read_table(spark, root, register), field)
        named = forms.select(F.col("value").alias(field), F.col("unified").alias(f"{field}_unified"), F.col("reads_as").alias(f"{field}_registered"))
        out = join_small(out, named, [field], ["report_id"], "left")
    return out.select("report_id", *(f"{f}{end}" for f, _ in FIELDS for end in ("", "_unified", "_registered")))


QUERIES = {"p7_found": p7_found, "p7_unified": p7_unified}
SQL = {}
