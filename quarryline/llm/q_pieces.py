"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.splitting import split_oversized
from quarryline.sources import read_table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk longer than 512 characters, and whether it can be cut at boundaries throughout."""
    pieces = split_oversized(read_table(spark, root, "all_chunks"), only_oversized=True, distinct=False)
    return pieces.groupBy("chunk_id").agg(F.max("is_forced").alias("f")).select("chunk_id", F.when(F.col("f"), "forced").otherwise("natural").alias("cut"))


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All chunks as pieces of at most 512 characters with an overlap of 64."""
    return split_oversized(read_table(spark, root, "all_chunks"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

SQL = {
    "p5_found": r"""
SELECT DISTINCT chunk_id, CASE WHEN list_max([length(s) FOR s IN regexp_split_to_array(text, '[\n。！？；]|[.!?;] ')]) > 512
  OR list_max([length(s) FOR s IN regexp_split_to_array(regexp_replace(text, '([.!?;]) ', '\1' || chr(10) || ' ', 'g'), '[\n。！？；]')]) > 513 THEN 'forced' ELSE 'natural' END AS cut
FROM all_chunks WHERE length(text) > 512
""",
    "p5_pieces": r"""
WITH RECURSIVE t AS (SELECT DISTINCT chunk_id, text, length(text) AS n FROM all_chunks WHERE chunk_id IS NOT NULL AND length(text) > 0),
b AS (SELECT chunk_id, text, n, CASE WHEN n <= 512 THEN [] ELSE list_filter(range(1, n + 1), lambda i: contains(chr(10) || '。！？；', substr(text, i, 1)) OR (contains('.!?;', substr(text, i, 1)) AND substr(text, i + 1, 1) = ' ')) END AS ends FROM t),
p AS (
  SELECT chunk_id, text, n, ends, 0 AS piece_index, 0::BIGINT AS s, CASE WHEN n <= 512 THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e <= 512)), 512) END AS e FROM b
  UNION ALL
  SELECT chunk_id, text, n, ends, piece_index + 1, e - 64, CASE WHEN n - (e - 64) <= 512 THEN n ELSE coalesce(list_max(list_filter(ends, lambda x: x > e AND x <= e + 448)), e + 448) END FROM p WHERE e < n),
c AS (SELECT *, CASE WHEN n - s <= 512 THEN 'end' WHEN list_contains(ends, e) THEN 'natural'
  WHEN coalesce(list_min(list_filter(ends, lambda x: x > s + 512)) - 1, n) - coalesce(list_max(list_filter(ends, lambda x: x <= s + 512)), 0) > 512 THEN 'forced' ELSE 'hard' END AS cut FROM p)
SELECT chunk_id, piece_index, s::INT AS start_offset, e::INT AS end_offset, cut, bool_or(cut = 'forced') OVER (PARTITION BY chunk_id, text) AS is_forced, substr(text, s + 1, e - s) AS piece FROM c
""",
}
