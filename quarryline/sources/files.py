"""Readers and writers of CSV, JSON and JSON lines with explicit schemas, and recursive discovery."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; codes stay text as the schema says so."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) rows of a JSON document whose root is an object; ``value`` is the DDL of its values."""
    return spark.read.schema("line string").text(path, wholetext=True).select(F.explode(F.from_json("line", f"map<string,{value}>")).alias("key", "value"))


def read_json_lines(spark: SparkSession, path: str, schema: str, skip_bad: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, bad ones too on demand."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE").json(path)


def read_commented_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with // comments."""
    return spark.read.schema(schema).option("multiLine", True).option("allowComments", True).json(path)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """(key, items): the rows of each key as a list, in a defined order; for seeds and other small files."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("items"))


def find_files(spark: SparkSession, root: str, pattern: str, without: str = "") -> DataFrame:
    """(path, length) of the files below a folder whose name matches, by path; names that end with ``without`` before their extension are left out (results of an earlier run)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    kept = found.filter(~F.col("path").rlike(rf"\Q{without}\E\.[^./]*$")) if without else found
    return kept.orderBy("path")


def first_available(spark: SparkSession, readers: Sequence[Callable[[SparkSession], DataFrame]], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """The first source that can be read and has rows, with its columns under common names (``columns``: the name, and what sources call it); empty text columns if none has. A provider is any callable of a session."""
    for read in readers:
        try:
            df = read(spark)
        except (AnalysisException, OSError):
            continue
        own = {name: next((c for c in (name, *known) if c in df.columns), None) for name, known in columns.items()}
        if None not in own.values() and df.limit(1).count():
            return df.select(*(F.col(c).alias(name) for name, c in own.items()))
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def write_csv(frames: Sequence[DataFrame], path: str) -> None:
    """Several tables as one CSV with a header; columns that one of them lacks are empty there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_map(df: DataFrame, key: str, path: str) -> None:
    """A line ``{key: {...}}`` a row: what a JSON document with an object root holds, written in parallel; dates and times as text. Null keys are left out."""
    rest = F.struct(*(F.col(c).cast("string").alias(c) if t in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c, t in df.dtypes if c != key))
    df.filter(F.col(key).isNotNull()).select(F.to_json(F.create_map(F.col(key).cast("string"), rest)).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; mode ``append`` adds the records of a finished task."""
    df.write.mode(mode).json(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Several tables as parquet side by side, such as vectors, postings and statistics of an index."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_partitioned(df: DataFrame, path: str, by: str = "source_type") -> None:
    """Parquet in a folder a value, so that a filter on it prunes."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
