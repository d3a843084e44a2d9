"""Ranks in buckets and joins with small tables, against their plain forms."""

import random

import pytest
from conftest import rows

from quarryline.functions.joins import join_small, measured_bytes
from quarryline.operators.ranking import rank_in_buckets, rank_in_windows


@pytest.mark.parametrize("coarse, fine", [(2, 3), (32, 32)])
def test_bucket_ranks_equal_window_ranks(spark, coarse, fine):
    r = random.Random(1)
    df = spark.createDataFrame([(r.choice("ab"), float(r.randrange(40)), r.randrange(2)) for _ in range(400)], "k string, v double, t int")
    for tie in ([], ["t"]):
        a, b = (f(df, ["k"], "v", tie, *x).select("k", "v", "t", "_less", "_same") for f, x in ((rank_in_buckets, (coarse, fine)), (rank_in_windows, ())))
        assert rows(a) == rows(b)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_all_ways_of_a_join_agree(spark, how):
    r = random.Random(2)
    big = spark.createDataFrame([(i, r.choice(["hot", "hot", "a", "b", None, "no"])) for i in range(300)], "i long, k string")
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5)], "k string, v int")
    want = rows(big.join(small, "k", how))
    for spread_by, limit in (((), 10**9), ((), 0), (("i",), 0)):
        assert rows(join_small(big, small, ["k"], spread_by, how, limit)) == want
    assert measured_bytes(small) == 5 * 16 + 5 * 8 + 3 + 1 + 1 + 1 and measured_bytes(small.limit(0)) == 0
