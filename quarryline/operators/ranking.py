"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group with more rows than this is ranked in value buckets, so that no task holds the whole group.
HOT_GROUP_ROWS = 200_000
#: Buckets per hot group, COARSE times FINE; their edges come from a mergeable quantile sketch.
COARSE, FINE = 32, 32


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """The groups of more than ``hot_rows`` rows; at most rows / hot_rows of them exist."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*group)


def _bucket(edges: str, value: str, coarse: int, fine: int) -> Column:
    """How many of the sorted edges are below the value, in two steps: among every ``fine``-th edge, then among those between two of them."""
    first = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(coarse - 1)), lambda i: F.element_at(edges, i * fine)), lambda e: e < F.col(value)))
    within = F.slice(edges, first * fine + 1, F.lit(fine))
    return first * fine + F.size(F.filter(within, lambda e: e < F.col(value)))


def rank_in_buckets(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str] = (), coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """Adds ``_less`` (rows of the group before the row's tie) and ``_same`` (rows in its tie), ascending by value and tie.

    Ties are counted before anything is shuffled, so a value that a third of the rows share is one row;
    the distinct values are then ranked in quantile buckets of their group, each in a task of its own. Rows with a null key are left out.
    """
    keys, buckets = [*group, value, *tie], coarse * fine
    ties = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_same"))
    edges = ties.groupBy(*group).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("_edges"))
    placed = ties.join(edges, list(group)).withColumn("_bucket", _bucket("_edges", value, coarse, fine)).drop("_edges")
    before = placed.groupBy(*group, "_bucket").agg(F.sum("_same").alias("_rows")).withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inner = Window.partitionBy(*group, "_bucket").orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(before.drop("_rows"), [*group, "_bucket"]).withColumn("_less", F.col("_offset") + F.coalesce(F.sum("_same").over(inner), F.lit(0)))
    return df.join(ranked.select(*keys, "_less", "_same"), keys)


def rank_in_windows(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str] = ()) -> DataFrame:
    """The same columns as ``rank_in_buckets``, by one sort per group; for groups that fit a task."""
    order = Window.partitionBy(*group).orderBy(value, *tie)
    return df.withColumn("_less", (F.rank().over(order) - 1).cast("long")).withColumn("_same", F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)))
