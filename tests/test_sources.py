"""Readers, writers and index rows on small files."""

import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from quarryline.operators import indexing
from quarryline.operators.retrieval import search_words
from quarryline.sources import files, read_table


def test_first_available(spark, tmp_path):
    (tmp_path / "a.csv").write_text("代码,名称\n000001,甲\n", encoding="utf-8")
    readers = [lambda s: s.read.parquet(str(tmp_path / "missing")), lambda s: s.createDataFrame([], "x string"), lambda s: files.read_csv(s, str(tmp_path / "a.csv"), "`代码` string, `名称` string")]
    columns = {"stock_code": ("code", "代码"), "stock_name": ("名称",)}
    assert rows(files.first_available(spark, readers, columns)) == [("000001", "甲")]
    assert files.first_available(spark, readers[:2], columns).columns == ["stock_code", "stock_name"]


def test_files_are_found_in_order(spark, tmp_path):
    for name in ("b/x.json", "a/x.json", "a/x_cleaned.json", "a/y.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert [r.path.split("/")[-2:] for r in files.find_files(spark, str(tmp_path), "*.json", "_cleaned").collect()] == [["a", "x.json"], ["b", "x.json"]]


def test_writers(spark, tmp_path):
    a, b = spark.createDataFrame([("1", "x,\"y\"")], "code string, name string"), spark.createDataFrame([("2", 5)], "code string, n int")
    files.write_csv([a, b], str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "code string, name string, n int")) == [("1", 'x,"y"', None), ("2", None, 5)]
    files.write_json_map(spark.createDataFrame([("k\"1", 2, dt.date(2024, 1, 2)), (None, 3, None)], "k string, v int, d date"), "k", str(tmp_path / "m"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()] == [{'k"1': {"v": 2, "d": "2024-01-02"}}]
    files.write_lines(a, str(tmp_path / "l"))
    files.write_lines(a, str(tmp_path / "l"), "append")
    assert files.read_json_lines(spark, str(tmp_path / "l"), "code string").count() == 2
    files.write_tables({"words": a, "documents": b}, str(tmp_path / "t"))
    assert rows(read_table(spark, str(tmp_path / "t"), "documents")) == [("2", 5)]
    seeds = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", None)], "type string, q string")
    assert {r.type: [x.q for x in r["items"]] for r in files.by_key(seeds, "type").collect()} == {"a": ["1", "2"], "b": [None]}


def test_index_rows(spark, tmp_path):
    df = spark.createDataFrame([("c1", "长" * 5000, "report", ["1", "2"], "题", None, 3), ("c1", "长" * 5000, "report", ["1", "2"], "题", None, 3), (None, "x", None, None, None, "已有", None), (None, "y", None, None, None, None, None)], "chunk_id string, text string, source_type string, stock_codes array<string>, caption string, table_caption string, page_idx int")
    got = {r.chunk_id: r for r in indexing.index_rows(df).collect()}
    assert len(got) == 3 and set(indexing.index_rows(df).columns) == {"chunk_id", "text", *indexing.TEXTS, *indexing.NUMBERS}
    assert len(got["c1"].text) == 4096 and got["c1"].stock_codes == "1,2" and got["c1"].table_caption == "题" and got["c1"].page_idx == 3 and got["c1"].company_count == -1 and got["c1"].parser == ""
    other = [r for i, r in got.items() if i != "c1"]
    assert {r.chunk_id for r in other} == {"unknown_00000000", "unknown_00000001"} and {r.table_caption for r in other} == {"已有", ""} and {r.page_idx for r in other} == {-1}
    assert indexing.index_rows(df.limit(0)).count() == 0
    indexing.write_index(indexing.index_rows(df), str(tmp_path / "i"), 2)
    assert rows(indexing.scan_index(spark.read.parquet(str(tmp_path / "i")), {"source_type": ["report", "none"]}, ["chunk_id"], 5)) == [("c1",)]
    own, words, sizes = indexing.postings(spark.createDataFrame([(1, "a b a"), (2, "b"), (None, "c"), (3, "")], "k long, t string"), "k", search_words(F.col("t")))
    assert rows(own) == [("a", 1, 2), ("b", 1, 1), ("b", 2, 1)] and rows(words) == [("a", 1), ("b", 2)] and rows(sizes) == [(1, 3), (2, 1), (3, 0)]
