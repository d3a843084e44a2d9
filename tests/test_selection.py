"""Selection, numbering and run summaries on small tables with nulls, ties, repeated rows and empty tables."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quarryline.functions.numbering import numbered
from quarryline.operators import selection as S


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 1009).alias("k"), F.lit("x").alias("position_of"))
    got = numbered(df.repartition(9), [F.col("k")], "at", 1)
    assert [r["at"] for r in got.orderBy("k").collect()] == list(range(1, 501))
    assert numbered(df.limit(0), [F.col("k")]).count() == 0


def test_dates_links_and_verdicts(spark):
    df = spark.createDataFrame([(1, "2024/05/06", "http://a"), (2, "soon", "http://b"), (3, None, "http://c"), (4, "2024-05-06", "ftp://d"), (5, "2024-05-06T01:02", None)], "i long, d string, u string")
    assert [(r.i, r.day) for r in S.with_date_and_link(df, "d", "u").collect()] == [(1, dt.date(2024, 5, 6))]
    dates = spark.createDataFrame([("2024-01-01 10:00",), ("2023-12-31T23:59",), ("",), (None,)], "d string")
    assert [r.verdict for r in S.since(dates, "d", "2024-01-01").collect()] == ["kept", "old", "undated", "undated"]


def test_lengths_months_and_tasks(spark):
    texts = spark.createDataFrame([("x" * 60,), ("x " * 60,), ("x" * 40 + " " * 20,), (None,)], "t string")
    assert S.long_enough(texts, "t", F.regexp_replace("t", " ", "")).count() == 2
    days = spark.createDataFrame([(dt.date(2024, 6, 30),), (dt.date(2024, 3, 31),), (None,)], "d date")
    assert S.in_months(days, "d").count() == 1
    tasks = spark.createDataFrame([("1", "b", "ok"), (" ", "b", "ok"), ("1", "\n", "ok"), ("1", "b", None), (None, None, None)], "c string, b string, s string")
    assert [r[0] for r in tasks.select(S.task_verdict(F.col("c"), F.col("b"), F.col("s"))).collect()] == ["ok", "no_code", "empty", "failed", "no_code"]


def test_bounds_of_calls(spark):
    df = spark.createDataFrame([("x" * 600, "7"), (None, "0"), ("q", "99"), ("q", "many"), ("q", None)], "q string, k string")
    assert [tuple(r) for r in df.select(F.length(S.clamp_query(F.col("q"))), S.clamp_results(F.col("k"))).collect()] == [(500, 7), (0, 1), (1, 20), (1, 5), (1, 5)]


def test_samples_and_orders_can_be_repeated(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    one = rows(S.sample_rows(df, "k", 10))
    assert one == rows(S.sample_rows(df.repartition(7), "k", 10)) and len(one) == 10 and one != rows(S.sample_rows(df, "k", 10, seed=1)) and S.sample_rows(df, "k", 500).count() == 100
    order = {r.k: r.position for r in S.shuffled(df, "k").collect()}
    assert sorted(order.values()) == list(range(100)) and order == {r.k: r.position for r in S.shuffled(df.repartition(5), "k").collect()}


def test_finished_aliases_and_parents(spark):
    tasks = spark.createDataFrame([("a", 3, None), ("b", 0, None), ("c", 5, "timeout"), ("a", 0, None), (None, 1, None)], "k string, n long, e string")
    assert rows(S.finished_keys(tasks, "k", "n", "e")) == [("a",)]
    aliases, parents = spark.createDataFrame([("白酒", "消费"), ("光伏", "能源")], "alias string, target string"), spark.createDataFrame([("消费", 1), ("消费", 1)], "target string, v int")
    found, missing = S.join_aliases(aliases, parents)
    assert rows(found.select("alias", "v")) == [("白酒", 1)] and rows(missing) == [("光伏", "能源")]
    matches = spark.createDataFrame([(1, "消费", 0), (1, "无", 1)], "q long, industry string, at int")
    texts = spark.createDataFrame([("消费", 2, "b"), ("消费", 1, "a")], "industry string, id long, text string")
    assert [(r.q, r.text, r.score, r.position) for r in S.one_parent_each(matches, texts, "industry", [F.asc("id")], "at").collect()] == [(1, "a", 1.0, 0)]


def test_names_files_and_histograms(spark):
    names = spark.createDataFrame([("甲乙",), ("甲乙丙",), (" ",), (None,), ("甲乙",), ("丁戊",)], "n string")
    assert [(r.name, r.rank) for r in S.longest_first(names, "n").orderBy("rank").collect()] == [("甲乙丙", 1), ("丁戊", 2), ("甲乙", 3)]
    files = spark.createDataFrame([(2, "000001", dt.date(2024, 1, 2)), (1, None, dt.date(2024, 1, 3))], "i long, c string, d date")
    assert rows(S.file_names(files, "c", "d", [F.col("i")]).select("i", "file")) == [(1, "_20240103_0.pdf"), (2, "000001_20240102_1.pdf")]
    kinds = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert [(r.k, r.n, r["rank"]) for r in S.counts_descending(kinds, "k").orderBy("rank").collect()] == [("b", 2, 1), ("a", 1, 2), (None, 1, 3)]


def test_summaries(spark):
    runs = spark.createDataFrame([("ok", 2.0), ("ok", 4.0), ("failed", None)], "s string, t double")
    assert rows(S.run_summary(runs, "s", "t")) == [("failed", 1, None, None, 0.333333), ("ok", 2, 6.0, 3.0, 0.666667)]
    at = dt.datetime(2024, 1, 1, 5)
    metrics = spark.createDataFrame([(at, 1.0), (at, -1.0), (at, 3.0), (at + dt.timedelta(days=1), -1.0), (None, 9.0)], "t timestamp, v double")
    assert [(r["mean"], r.n) for r in S.interval_means(metrics, "t", "v").orderBy("start").collect()] == [(2.0, 2), (0.0, 0)]
    issues = spark.createDataFrame([("k", i, f"x{i}") for i in range(15)], "k string, i int, x string")
    assert [r.x for r in S.first_issues(issues, "k", "x", ["i"]).orderBy("position").collect()] == [f"x{i}" for i in range(10)]
