"""Positions of rows in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage


def numbered(df: DataFrame, order: list[Column], name: str = "position", start: int = 0) -> DataFrame:
    """Adds the position of each row in ``order``, which must tell all rows apart.

    Rows are range-partitioned by the order, numbered within their range, and ranges get their offsets from one count each; no task holds more than a range.
    """
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + within - 1 + start).drop("_range", "_before")
