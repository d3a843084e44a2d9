"""What to process: usable rows, samples, seeded orders, what is finished, and the checks of a task's input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.numbering import numbered
from quarryline.functions.text import iso_date, strip_u

#: Bounds of a tool's query and number of results.
QUERY_CHARS, MOST_RESULTS, DEFAULT_RESULTS = 500, 20, 5


def with_date_and_link(df: DataFrame, date: str, link: str, prefix: str = "http") -> DataFrame:
    """Rows with a date that parses and a link that begins with ``prefix``; adds ``day``. Dates of no known format count as missing."""
    return df.withColumn("day", iso_date(F.col(date))).filter(F.col("day").isNotNull() & F.col(link).isNotNull() & F.startswith(F.col(link), F.lit(prefix)))


def since(df: DataFrame, date: str, first: str) -> DataFrame:
    """(verdict, ...): ``kept`` for texts of dates not before ``first``, ``old`` for earlier and ``undated`` for missing ones; the day is what stands before a space or T."""
    day = F.split(F.col(date), "[ T]")[0]
    return df.withColumn("verdict", F.when(F.coalesce(F.col(date), F.lit("")) == "", "undated").when(day >= first, "kept").otherwise("old"))


def long_enough(df: DataFrame, text: str, clean: Column, least: int = 50) -> DataFrame:
    """Rows of at least ``least`` characters before cleaning and after it; adds ``clean``."""
    return df.filter(F.length(text) >= least).withColumn("clean", clean).filter(F.length("clean") >= least)


def in_months(df: DataFrame, day: str, months: Sequence[int] = (6, 12)) -> DataFrame:
    """Rows of the given months (half-year and annual figures)."""
    return df.filter(F.month(day).isin(*months))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order that tells rows apart; partitions keep ``n`` each before they are merged."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all if there are fewer), drawn by a hash of seed and key, so the draw can be repeated."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``position`` from 0 in an order drawn by a hash of seed and key (unique)."""
    return numbered(df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), [F.col("_h"), F.col(key)]).drop("_h")


def finished_keys(tasks: DataFrame, key: str, results: str, error: str) -> DataFrame:
    """Keys that need no further run: with at least one result and no error in any of their records; failures are run again."""
    own = tasks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(error).isNotNull()).alias("_e"), F.sum(results).alias("_n"))
    return own.filter(~F.col("_e") & (F.col("_n") > 0)).select(key)


def task_verdict(code: Column, body: Column, status: Column | None = None) -> Column:
    """Why a table task is left out: ``no_code``, ``empty`` or ``failed``; else ``ok``."""
    out = F.when(F.coalesce(strip_u(code), F.lit("")) == "", "no_code").when(F.coalesce(strip_u(body), F.lit("")) == "", "empty")
    return (out.when(F.coalesce(status, F.lit("")) != "ok", "failed") if status is not None else out).otherwise("ok")


def clamp_query(query: Column) -> Column:
    """At most QUERY_CHARS characters; empty for null."""
    return F.substring(F.coalesce(query, F.lit("")), 1, QUERY_CHARS)


def clamp_results(top_k: Column) -> Column:
    """A whole number between 1 and MOST_RESULTS; DEFAULT_RESULTS for what is no number."""
    return F.greatest(F.lit(1), F.least(F.coalesce(top_k.try_cast("int"), F.lit(DEFAULT_RESULTS)), F.lit(MOST_RESULTS)))


def longest_first(names: DataFrame, name: str) -> DataFrame:
    """(name, rank): distinct non-empty names, the longest first, ties by name; the order in which a text is searched for names."""
    distinct = names.select(strip_u(F.col(name)).alias("name")).filter("name <> ''").distinct().withColumn("_l", -F.length("name"))
    return numbered(distinct, [F.col("_l"), F.col("name")], "rank", 1).drop("_l")


def join_aliases(aliases: DataFrame, parents: DataFrame, alias: str = "alias", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Aliases with their parent's row, and the aliases that have none (for the report)."""
    keyed = parents.dropDuplicates([target])
    return aliases.join(keyed, target), aliases.join(keyed.select(target), target, "left_anti").select(alias, target)


def one_parent_each(matches: DataFrame, parents: DataFrame, key: str, order: Sequence[Column], position: str) -> DataFrame:
    """One parent of each match, the first in ``order``, with score 1; matches keep their position, those without a parent are left out."""
    first = parents.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_at = 1").drop("_at")
    return matches.join(first, key).withColumn("score", F.lit(1.0)).withColumn("position", F.col(position))


def file_names(df: DataFrame, code: str, day: str, order: list[Column]) -> DataFrame:
    """Adds ``file``: ``code_day_index.pdf``; the index is the row's position among all rows kept."""
    return numbered(df, order, "index").withColumn("file", F.concat_ws("_", F.coalesce(F.col(code), F.lit("")), F.date_format(day, "yyyyMMdd"), F.concat(F.col("index").cast("string"), F.lit(".pdf")))).drop("index")


def counts_descending(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """(by, n, rank): a histogram, the most frequent first, ties by value (null last)."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    return numbered(counted, [F.desc(name), F.asc_nulls_last(by)], "rank", 1)


def run_summary(runs: DataFrame, status: str, seconds: str) -> DataFrame:
    """(status, n, total, mean, share) of the records of a run: how many ended each way and how long they took; shares of all records."""
    own = runs.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds), 6).alias("total"), F.round(F.avg(seconds), 6).alias("mean"))
    # one row a status
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def interval_means(metrics: DataFrame, at: str, value: str, invalid: float = -1.0, unit: str = "day") -> DataFrame:
    """(start, mean, n) of the valid values of each interval; 0 for an interval without any. Values equal to ``invalid`` don't count."""
    valid = F.when(F.col(value) != invalid, F.col(value))
    return metrics.filter(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, at).alias("start")).agg(F.round(F.coalesce(F.avg(valid), F.lit(0.0)), 6).alias("mean"), F.count(valid).alias("n"))


def first_issues(issues: DataFrame, kind: str, issue: str, order: Sequence[str], n: int = 10) -> DataFrame:
    """(kind, position, issue): the first ``n`` issues of each kind; the limit holds before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return issues.withColumn("position", rank).filter(F.col("position") <= n).select(kind, "position", *order, issue)
