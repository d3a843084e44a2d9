"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.rank_aggregation import aggregate_ranks
from quarryline.sources import read_table


def p1_rank_aggregation(spark: SparkSession, root: str) -> DataFrame:
    """One ranking of the chunks of every query, out of all retrievers."""
    return aggregate_ranks(read_table(spark, root, "search_hits"))


QUERIES = {"p1_rank_aggregation": p1_rank_aggregation}

SQL = {
    "p1_rank_aggregation": """
WITH last AS (
  SELECT query_id, chunk_id, retriever,
         arg_max(CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN -1e308 ELSE score END,
                 {'t': hit_ts, 's': CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN -1e308 ELSE score END}) AS x
  FROM search_hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever IS NOT NULL GROUP BY ALL),
signed AS (SELECT *, CASE WHEN retriever = 'l2_dist' THEN x ELSE -x END AS y FROM last WHERE x > -1e308),
ranked AS (
  SELECT query_id, chunk_id, rank() OVER (PARTITION BY query_id, retriever ORDER BY y) - 1 AS less,
         count(*) OVER (PARTITION BY query_id, retriever, y) AS same, count(*) OVER (PARTITION BY query_id, retriever) AS n FROM signed),
marks AS (SELECT query_id, chunk_id, round((less + (same + 1) / 2) / n, 12) AS r FROM ranked WHERE n = 1 OR same < n),
ordered AS (SELECT query_id, chunk_id, r, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY r) AS k, count(*) OVER (PARTITION BY query_id, chunk_id) AS n FROM marks),
tails AS (
  SELECT o.query_id, o.chunk_id, o.k, any_value(o.n) AS n, any_value(o.r) AS r,
         sum(factorial(n::INT) / (factorial(j::INT) * factorial((n - j)::INT)) * pow(r, j) * pow(1 - r, n - j)) AS p
  FROM ordered o, generate_series(1, 60) g(j) WHERE j BETWEEN k AND n GROUP BY 1, 2, 3),
items AS (SELECT query_id, chunk_id, any_value(n) AS n, round(sum(r) / any_value(n), 9) AS m, printf('%.8e', min(p) * any_value(n))::DOUBLE AS p FROM tails GROUP BY 1, 2),
every AS (SELECT DISTINCT query_id, chunk_id FROM last),
scored AS (SELECT e.query_id, e.chunk_id, coalesce(n, 0) AS n, coalesce(m, 1.0) AS m, coalesce(p, 2.0) AS p FROM every e LEFT JOIN items i USING (query_id, chunk_id))
SELECT query_id, chunk_id, n::INT AS n_sources, m AS mean_rank, round(least(p, 1.0), 9) AS rho, rank() OVER (PARTITION BY query_id ORDER BY p, m) AS final_rank FROM scored
""",
}
