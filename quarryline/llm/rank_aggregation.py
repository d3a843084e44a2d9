"""One ranking out of several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import HOT_GROUP_ROWS, hot_groups, rank_in_buckets, rank_in_windows


def beta_order_p(ranks: Column) -> Column:
    """The least probability, over k, that the k-th smallest of n uniform ranks is as small as the k-th of ``ranks`` (sorted array).

    P(U_(k) <= r) is the tail of a binomial: the sum over j = k..n of C(n, j) r^j (1 - r)^(n - j). All terms are positive, so nothing cancels and small tails keep their digits.
    """
    n = F.size(ranks)

    def choose(j: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), j), F.lit(1.0), lambda a, i: a * (n - i + 1) / i)

    def tail(r: Column, k: Column) -> Column:
        return F.aggregate(F.sequence(k + 1, n), F.lit(0.0), lambda a, j: a + choose(j) * F.pow(r, j.cast("double")) * F.pow(1.0 - r, (n - j).cast("double")))

    return F.array_min(F.transform(ranks, tail))


def relative(p: Column, digits: int = 9) -> Column:
    """A number rounded to so many significant digits, however small it is: nothing positive becomes 0, and what differs only by the order of sums is a tie."""
    return F.format_string(f"%.{digits - 1}e", p).cast("double")


def aggregate_ranks(
    hits: DataFrame,
    group: str = "query_id",
    item: str = "chunk_id",
    source: str = "retriever",
    score: str = "score",
    version: str = "hit_ts",
    small_is_good: Sequence[str] = ("l2_dist",),
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """One ranking of the items of each group out of the scores of several sources, by robust rank aggregation.

    Each source ranks the items that it scored; the rank over the source's number of items is uniform if the source says
    nothing about an item. Of an item's sorted normalised ranks, the beta order-statistic probabilities are taken; the least
    of them, times the number of ranks (the correction for having looked at so many), is the item's significance ``rho``.

    Groups are counted first. Without one of more than ``hot_rows`` rows the plan is one shuffle by group; otherwise such groups are ranked in value buckets besides. Both give the same ranks.

    Defined cases: rows without group, item or source are left out. Of several rows of one source for one item the latest
    counts, of equally late ones the one with the larger score. Null, NaN and infinite scores count as not given, and so does a source
    that gives all its items of the group (two or more) one score. An item without any score keeps a place: rho 1, at the end. Ties in a
    source share their mean rank; ties in the result (equal probability and equal mean rank) share the smallest rank. Items are ranked by the probability to
    9 significant digits; only the ``rho`` shown is rounded to 9 decimals.
    An empty table gives an empty result; further columns are ignored.

    Returns group, item, n_sources, mean_rank, rho, final_rank.
    """
    clean = hits.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.col(source).alias("s"), F.col(version).alias("v"),
        F.when(F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == float("inf")), None).otherwise(F.col(score).cast("double")).alias("x"),
    ).filter("g is not null and i is not null and s is not null")
    sizes = hot_groups(clean, ["g"], hot_rows)
    any_hot = bool(sizes.limit(1).count())

    def rank_all(rows: DataFrame, rank) -> tuple[DataFrame, DataFrame]:
        latest = rows.groupBy("g", "i", "s").agg(F.max(F.struct("v", "x")).alias("last")).select("g", "i", "s", F.col("last.x").alias("x"))
        signed = latest.withColumn("y", F.when(F.col("s").isin(list(small_is_good)), F.col("x")).otherwise(-F.col("x")))
        return rank(signed.filter("y is not null"), ["g", "s"], "y"), latest

    def norm(given: DataFrame, total: Column) -> DataFrame:
        given = given.withColumn("_n", total)
        return given.filter("_n = 1 or _same < _n").select("g", "i", (F.round((F.col("_less") + (F.col("_same") + 1) / 2) / F.col("_n"), 12)).alias("r"))

    def score_items(ranks: DataFrame, latest: DataFrame) -> DataFrame:
        marks = latest.select("g", "i", F.lit(None).cast("double").alias("r")).unionByName(ranks)
        per = marks.groupBy("g", "i").agg(F.array_sort(F.collect_list("r")).alias("rs"))
        found = F.size("rs") > 0
        p = F.when(found, beta_order_p(F.col("rs"))).otherwise(F.lit(2.0))
        mean = F.when(found, F.aggregate("rs", F.lit(0.0), lambda a, r: a + r) / F.size("rs")).otherwise(F.lit(1.0))
        return per.select("g", "i", F.size("rs").alias("n"), F.round(mean, 9).alias("m"), relative(p * F.greatest(F.size("rs"), F.lit(1))).alias("p"))

    # groups that fit a task: one shuffle by group, which all windows and aggregates below reuse
    cold = (clean.join(sizes, "g", "left_anti") if any_hot else clean).repartition("g")
    given, latest = rank_all(cold, rank_in_windows)
    items = score_items(norm(given, F.count(F.lit(1)).over(Window.partitionBy("g", "s"))), latest)
    out = rank_in_windows(items, ["g"], "p", ["m"])
    if any_hot:
        # hot groups: value buckets, counts combined before every shuffle
        given, latest = rank_all(clean.join(sizes, "g", "left_semi"), rank_in_buckets)
        totals = latest.filter("x is not null").groupBy("g", "s").agg(F.count(F.lit(1)).alias("_t"))
        items = score_items(norm(given.join(totals, ["g", "s"]), F.col("_t")), latest)
        out = out.unionByName(rank_in_buckets(items, ["g"], "p", ["m"]).select(out.columns))
    return out.select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("n").alias("n_sources"), F.col("m").alias("mean_rank"),
        F.round(F.least(F.col("p"), F.lit(1.0)), 9).alias("rho"), (F.col("_less") + 1).alias("final_rank"),
    )
