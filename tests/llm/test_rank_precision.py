"""The head of a large group is ordered by significance, not by mean rank."""

import datetime as dt
import random

import pytest

from quarryline.llm.rank_aggregation import aggregate_ranks

NOW = dt.datetime(2026, 1, 1)
SOURCES = tuple("abcdef")


@pytest.mark.parametrize("hot", [10**9, 100])
def test_tiny_probabilities_are_ranked(spark, hot):
    # of 1,000 items, x has the ranks (1, 1, 1, 1, 1, 60), probability 3.6e-14, and y (5, 5, 5, 5, 5, 5), 9.4e-14, but the better mean
    hits = []
    for s in SOURCES:
        own = {(60 if s == "f" else 1): "x", 5: "y"}
        free = random.Random(s).sample(range(998), 998)
        hits += [(1, own.get(r) or f"c{free.pop()}", s, float(-r), NOW) for r in range(1, 1001)]
    df = spark.createDataFrame(hits, "query_id long, chunk_id string, retriever string, score double, hit_ts timestamp")
    got = {r.chunk_id: r for r in aggregate_ranks(df, hot_rows=hot).filter("chunk_id in ('x', 'y')").collect()}
    assert got["x"].mean_rank > got["y"].mean_rank
    assert (got["x"].final_rank, got["y"].final_rank) == (1, 2)
    assert got["x"].rho == got["y"].rho == 0.0
