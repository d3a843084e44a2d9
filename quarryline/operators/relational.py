"""Selection, lookup and merge of keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order; rows without a key are left out.

    The limit is applied before the shuffle as well, so a key with many rows sends few.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.filter(F.col(key).isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= n)


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Left join on several keys; of several matches the one with the least ``order`` counts, none leaves null."""
    best = right.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by(value, order).alias(value))
    return left.join(best, list(keys), "left")


def last_value_per_key(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value): the value of the last row that has one."""
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def merge_old_first(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All old rows, and the new rows whose key no old row has (new rows among themselves are kept)."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def override(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the new value where there is one, else the old."""
    a, b = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_new", "_old").alias(value))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the finished ones; for resuming."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def with_prior_period(df: DataFrame, key: str, year: str, season: str, values: Sequence[str]) -> DataFrame:
    """Adds ``prior_<value>``: the value of the same key and season in the year before, null without one."""
    before = df.select(key, season, (F.col(year) + 1).alias(year), *(F.col(v).alias(f"prior_{v}") for v in values))
    return df.join(before, [key, season, year], "left")


def lookup_or_same(df: DataFrame, mapping: DataFrame, column: str, source: str, target: str) -> DataFrame:
    """``column`` through a small dictionary; unknown values stay."""
    joined = df.join(mapping.select(F.col(source).alias(column), F.col(target).alias("_to")), column, "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_to")


def contained_aliases(texts: DataFrame, text: str, aliases: dict[str, str], k: int) -> DataFrame:
    """Adds ``matches``: the targets of the aliases that the text contains, longest alias first, each once, at most ``k``.

    The aliases are a dictionary given as a parameter; each row is tested against it without a join.
    """
    ordered = sorted(aliases.items(), key=lambda x: -len(x[0]))
    pairs = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(t).alias("target")) for a, t in ordered))
    found = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(F.col(text), p["alias"])), lambda p: p["target"]))
    return texts.withColumn("matches", F.slice(found, 1, k))


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in the given order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")


def interleave(a: DataFrame, b: DataFrame, query: str, rank: str, text: str, prefix: int, k: int) -> DataFrame:
    """Two ranked lists of each query merged a1, b1, a2, b2 ...; of rows with the same first characters the first counts; ``k`` rows a query."""
    both = a.withColumn("_list", F.lit(0)).unionByName(b.withColumn("_list", F.lit(1)))
    head = both.withColumn("_head", F.substring(text, 1, prefix))
    first = head.withColumn("_at", F.row_number().over(Window.partitionBy(query, "_head").orderBy(rank, "_list"))).filter("_at = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(rank, "_list"))).filter(F.col("position") <= k).drop("_head", "_at")


def corpus_statistics(chunks: DataFrame, group: str = "source_type") -> DataFrame:
    """Rows, distinct codes (without empty ones) and mean text length of each group."""
    return chunks.groupBy(group).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct(F.when(F.col("stock_code") != "", F.col("stock_code"))).alias("n_stocks"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))


def alias_table(taxonomy: DataFrame, major: str, sub: str, extras: dict[str, str] | None = None) -> DataFrame:
    """(alias, target): every major and sub class as an alias of its major, subs also without a trailing numeral; a sub overrides a major of the same name, extras never override."""
    spark = taxonomy.sparkSession
    rows = taxonomy.select(F.col(major).alias("target"), F.col(major).alias("alias"), F.lit(1).alias("p")).unionByName(taxonomy.select(F.col(major).alias("target"), F.col(sub).alias("alias"), F.lit(0).alias("p")))
    rows = rows.unionByName(taxonomy.select(F.col(major).alias("target"), F.regexp_replace(sub, "[ⅠⅡⅢ]$", "").alias("alias"), F.lit(0).alias("p")))
    if extras:
        rows = rows.unionByName(spark.createDataFrame([(t, a, 2) for a, t in extras.items()], "target string, alias string, p int"))
    return rows.filter("alias is not null and alias <> ''").groupBy("alias").agg(F.min(F.struct("p", "target"))["target"].alias("target"))
