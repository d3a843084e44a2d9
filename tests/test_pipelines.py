"""Search pipelines, figure texts, tool calls and histories on small tables."""

import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from quarryline.operators import blocks as B
from quarryline.operators import chunking as C
from quarryline.operators import figures as G
from quarryline.operators import retrieval as R
from quarryline.operators import search as P
from quarryline.operators import tools as U

SCORES = "query_id long, chunk_id string, retriever string, good double"
CHUNKS = "chunk_id string, source_type string, pdf_file string, report_title string, text string, day date"


def test_filter_comes_before_the_ranking(spark):
    # ten better hits of another source take no place in the list
    scores = spark.createDataFrame([(1, f"x{i}", "dense", 9.0 + i) for i in range(10)] + [(1, "f", "dense", 0.1)], SCORES)
    chunks = spark.createDataFrame([(f"x{i}", "report", None, None, "t", None) for i in range(10)] + [("f", "financial", None, None, "t", None)], CHUNKS)
    got = P.fused_lists(P.hits_within(scores, chunks, ["financial"], ["dense"]), 1).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("f", round(1 / 61, 9))]


def test_year_and_ties(spark):
    fused = spark.createDataFrame([(1, "a", 0.03), (1, "b", 0.025), (1, "c", 0.03)], "query_id long, chunk_id string, score double")
    queries = spark.createDataFrame([(1, "2023年的毛利率")], "query_id long, query_text string")
    days = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2023, 1, 1)), ("c", None)], "chunk_id string, day date")
    assert [(r.chunk_id, r.score) for r in P.year_boosted(fused, queries, days, 2).orderBy("rank").collect()] == [("b", 0.035), ("a", 0.03)]


def test_industries_by_name_then_by_vector(spark):
    queries = spark.createDataFrame([(1, "白酒行业怎么样"), (2, "天气"), (3, "谁家好")], "query_id long, query_text string")
    hits = spark.createDataFrame([(1, "k2", "dense", 0.99), (2, "k1", "dense", 0.9), (2, "k3", "dense", 0.8), (2, "k2", "dense", 0.76), (3, "k1", "dense", 0.5)], SCORES)
    chunks = spark.createDataFrame([("k1", "消费", dt.date(2023, 1, 1), "旧"), ("k3", "消费", dt.date(2024, 1, 1), "新"), ("k2", "能源", None, "能")], "chunk_id string, industry string, day date, text string")
    got = rows(P.industry_search(queries, hits, chunks, {"白酒": "消费"}).select("query_id", "position", "industry", "score", "way", "text"))
    assert got == [(1, 0, "消费", 1.0, "name", "新"), (2, 0, "消费", 0.9, "vector", "新"), (2, 1, "能源", 0.76, "vector", "能")]
    parents = spark.createDataFrame([("消费", "p")], "industry string, text string")
    named = {r.query_id: (r.match_failed, r.score, r.text) for r in P.named_or_message(queries, parents, {"白酒": "消费"}).collect()}
    assert named[1] == (False, 1.0, "p") and named[2] == (True, 0.0, "没有找到与“天气”匹配的行业")


def test_linear_mix_and_observation(spark):
    scores = spark.createDataFrame([(1, "a", "dense", 5.0), (1, "b", "dense", 1.0), (1, "b", "bm25", 7.0), (1, "a", "bm25", 7.0), (1, "c", "rerank", 99.0)], SCORES)
    assert rows(P.linear_fusion(scores, 0.7)) == [(1, "a", 0.7), (1, "b", 0.0)] and rows(P.linear_fusion(scores, 0.7, constant=1.0)) == [(1, "a", 1.0), (1, "b", 0.3)]
    results = spark.createDataFrame([(1, 2, "乙"), (1, 1, "甲")], "query_id long, rank int, line string")
    queries = spark.createDataFrame([(1,), (2,), (2,)], "query_id long")
    assert rows(P.observation(results, "共 %d 条：", "无", queries)) == [(1, 2, "共 2 条：\n1. 甲\n2. 乙"), (2, 0, "无")]


def test_sparse_rows(spark):
    r = spark.range(1).select(P.sparse_row(F.array(*map(F.lit, (7, 2, 7, 3))), F.array(*map(F.lit, (1.0, 0.5, 2.0, 0.0)))).alias("v")).first()
    assert list(r.v.items()) == [(2, 0.5), (7, 3.0)]
    got = {r.i: r.v for r in P.sparse_texts(spark.createDataFrame([(1, "Margin margin 毛利率"), (2, ""), (3, None), (None, "x")], "i long, t string"), "i", "t").collect()}
    w, e = got[1], got[2]
    assert set(got) == {1, 2}
    assert [x.key for x in w] == ["margin", "利率", "毛利"] and abs(w[0].value - 1.6931471805599454) < 1e-9 and e == []


def figures(spark, now, before=None):
    df = spark.createDataFrame([(now, before)], "now map<string,double>, before map<string,double>")
    h = F.lit("甲(1) 2024-12-31")
    return df.select(G.profit_text(h, F.col("now"), F.col("before")), G.structure_text(h, F.col("now"), F.col("before")), G.return_text(h, F.col("now"), F.col("before"))).first()


def test_figure_texts(spark):
    now = {"净资产收益率(%)": 20.5, "销售净利率(%)": 10.0, "总资产周转率(次)": 1.0, "股东权益比率(%)": 50.0, "总资产(元)": 2.5e8, "流动比率": 1.234}
    p, s, r = figures(spark, now, {"净资产收益率(%)": 18.0, "股东权益比率(%)": 40.0})
    assert p == "甲(1) 2024-12-31盈利与成长指标，净资产收益率(ROE)20.50%（上年同期18.00%），销售净利率10.00%，总资产2.50亿元。"
    assert s == "甲(1) 2024-12-31偿债与运营指标，流动比率1.23，股东权益比率50.00%，权益乘数2.00倍，总资产周转率1.00次。"
    assert r == "甲(1) 2024-12-31杜邦分析，净资产收益率(ROE)20.50%（上年同期18.00%），销售净利率10.00%，总资产周转率1.00次，权益乘数2.00倍（上年同期2.50倍），杜邦验算ROE≈20.00%（净利率×周转率×权益乘数）。"
    assert "存在1.50个百分点差异" in figures(spark, now | {"净资产收益率(%)": 21.5})[2] and figures(spark, now | {"净资产收益率(%)": 23.5})[2] is None and figures(spark, now | {"股东权益比率(%)": 0.0})[2] is None
    none = {k: v for k, v in now.items() if k != "净资产收益率(%)"}
    assert figures(spark, none)[2].startswith("甲(1) 2024-12-31杜邦分析，销售净利率") and tuple(figures(spark, {})) == (None, None, None)
    facts = spark.createDataFrame([("1", 2024, "12-31", "a", 1.0), ("1", 2024, "12-31", "a", 2.0), ("1", 2023, "12-31", "a", float("nan")), ("1", 2023, "12-31", "b", 3.0)], "c string, year int, season string, m string, v double")
    got = G.with_prior_map(G.figures_by_period(facts, ["c", "year", "season"], "m", "v"), "c", "year", "season")
    assert {r.year: (r.now, r.before) for r in got.collect()} == {2024: ({"a": 2.0}, {"b": 3.0}), 2023: ({"b": 3.0}, None)}


def test_tool_inputs_and_dispatch(spark):
    calls = spark.createDataFrame([(1, "search", '{"query": "毛利率", "top_k": 99}'), (2, "calculate", "1+1"), (3, "calculate", '{"expression": "2*3"}'), (4, "fly", "x"), (5, None, None)], "i long, tool string, given string")
    read = U.tool_input(F.col("tool"), F.col("given"))
    df = calls.select("i", "tool", read["query"].alias("query"), read["top_k"].alias("top_k"))
    assert rows(df.select("i", "query", "top_k")) == [(1, "毛利率", 20), (2, "1+1", 5), (3, "2*3", 5), (4, "x", 5), (5, "", 5)]
    got = {r.i: (r.route, r.answer) for r in U.dispatch(df, ["search", "calculate"]).collect()}
    assert got == {1: ("search", None), 2: ("calculate", "计算结果: 2"), 3: ("calculate", "计算结果: 6"), 4: ("unknown", "未知工具: fly，可用工具: search, calculate"), 5: ("unknown", "未知工具: ，可用工具: search, calculate")}


def test_histories_prompts_and_masks(spark):
    steps = F.array(F.struct(F.lit("search").alias("tool"), F.lit("毛利率").alias("query"), F.lit("35%").alias("observation"), F.lit("查").alias("thought")))
    r = spark.range(1).select(U.history("s", F.lit("问"), steps, F.lit("答")).alias("h"), U.prompt_text("指令", F.lit("问"), steps).alias("p"), U.completion_text(U.history("s", F.lit("问"), steps)).alias("c"), U.mask_segments(F.array(*map(F.lit, (True, True, False, True)))).alias("m"), U.mask_segments(F.array().cast("array<boolean>")).alias("e")).first()
    assert [m.role for m in r.h] == ["system", "user", "assistant", "tool", "assistant"] and r.h[2].tool_calls[0].func.name == "search" and json.loads(r.h[2].tool_calls[0].func.arguments) == {"query": "毛利率"} and r.h[3].tool_call_id == r.h[2].tool_calls[0].id == "call_1" and r.h[4].content == "答"
    assert r.p == "指令\n\n问题: 问\n\n思考: 查\n行动: search\n行动输入: 毛利率\n观察: 35%" and r.c == "s\n问\n查\n35%"
    assert [tuple(x) for x in r.m] == [(0, 2), (3, 4)] and r.e == []
    read = U.parsed_facts(F.lit('好的 {"table_type": "a", "narrative": "n", "row_facts": ["f"]} 完'))
    assert spark.range(1).select(read["narrative"], U.parsed_facts(F.lit("{bad")), U.parsed_facts(F.lit('{"narrative": "n"}'))).first() == ("n", None, None)
    asked = spark.range(1).select(U.task_messages("s", F.lit(None).cast("string"), F.lit("|a|"), [("甲", "乙")]).alias("m")).first().m
    assert [(m.role, m.content) for m in asked] == [("system", "s"), ("user", "甲"), ("assistant", "乙"), ("user", "表格标题：无\n表格内容：\n|a|")]
    rows_ = spark.createDataFrame([([],), (None,), ([1],)], "messages array<int>")
    assert U.with_tools(rows_, "t").count() == 1


def test_table_chunks_and_records(spark):
    text = "前言" * 30 + "\n| a | b |\n|---|---|\n" + "\n".join(f"| {'x' * 40} | {i} |" for i in range(20)) + "\n后记" + "。" * 60
    got = C.table_aware_chunks(spark.createDataFrame([(1, text), (2, None)], "k long, text string"), "k").collect()
    tables, prose = [r for r in got if r.kind == "table"], [r for r in got if r.kind == "prose"]
    assert len(tables) > 1 and all(r.chunk.startswith("| a | b |\n|---|---|\n") and len(r.chunk) <= 512 for r in tables) and {r.block_no for r in prose} == {0, 2}
    t = spark.createDataFrame([("d.pdf", 1, 0, "节", ["表1", "收入"], None, "<table><tr><td>a</td></tr></table>"), ("d.pdf", 2, 0, "节", None, None, "")], "pdf_file string, table_no int, page_idx int, section string, table_caption array<string>, table_footnote array<string>, table_body string")
    r = C.table_parents(t, spark.createDataFrame([("d.pdf", "000001")], "pdf_file string, stock_code string")).collect()
    assert len(r) == 1 and (r[0].parent_id, r[0].table_caption, r[0].table_footnote, r[0].table_md, r[0].stock_code) == ("d.pdf_t1", "表1 收入", "", "| a |\n|---|", "000001")
    assert spark.range(1).select(C.identity_header(F.lit("甲"), F.lit(None).cast("string"), F.lit("题")), C.identity_header(*[F.lit("")] * 3), C.without_images(F.lit("a![x](y.png)b"))).first() == ("[甲 题] ", "", "ab")
    long = spark.createDataFrame([("k", "长" * 4000)], "k string, text string")
    assert len(C.with_parent_text(spark.createDataFrame([("k",), ("n",)], "k string"), long, "k", "text").filter("k = 'k'").first().parent_text) == 3000


def test_page_counts_come_before_the_rules(spark):
    # the last page holds only a footer: the document still has four pages, so a line on one of three text pages is no runner
    items = [("text", f"第{'甲乙丙'[p]}页的正文写得足够长，可以留下来。", None, p) for p in range(3)] + [("text", "某某证券研究所出品的每日晨报", None, p) for p in range(2)] + [("footer", "x", None, 7)]
    df = spark.createDataFrame([(i, "d", i, *x, None) for i, x in enumerate(items)], "block_id long, pdf_file string, block_idx int, block_type string, text string, text_level int, page_idx int, table_body string")
    assert {r.block_id for r in B.clean_blocks(df).collect()} == {0, 1, 2, 3, 4}
    steps = {r.rule: (r.n_before, r.n_removed) for r in B.cleaning_summary(df).collect()}
    assert steps["trivial"] == (6, 1) and steps["runners"] == (5, 0) and len(steps) == 8
    broken = [("text", "公司的营业收入同比大幅增长，", None, 0), ("text", "但利润有所下降，还要再看一个季度。", None, 0), ("table", None, None, 0), ("text", "图 1：收入", None, 0)]
    df = spark.createDataFrame([(i, "d", i, *x, None) for i, x in enumerate(broken)], df.schema)
    got = {r.block_id: r.text for r in B.clean_blocks(df).collect()}
    assert got[0] == "公司的营业收入同比大幅增长，但利润有所下降，还要再看一个季度。" and 1 not in got


def test_parents_of_two_kinds(spark):
    hits = spark.createDataFrame([(1, "c1", 1, 0.5, "子\n一", "t1", None), (1, "c2", 2, 0.9, "子二", "t1", None), (1, "c3", 3, 0.7, "句", None, "s1"), (1, "c4", 4, 0.7, "独\n立", None, None), (1, "c5", 5, 0.1, "孤", "gone", None)], "query_id long, chunk_id string, position int, score double, text string, parent_id string, section_id string")
    tables = spark.createDataFrame([("t1", "表1", 4, "| a |")], "parent_id string, table_caption string, page_idx int, table_md string")
    sections = spark.createDataFrame([("s1", "全节")], "section_id string, section_text string")
    got = [tuple(r) for r in R.expand_results(hits, tables, sections).orderBy("slot").collect()]
    assert got == [(1, 1, "table", "t1", 0.9, "【表格 · 表1 · 第 5 页】\n| a |\n子 一\n子二"), (1, 2, "section", "s1", 0.7, "全节\n句"), (1, 3, "chunk", "c4", 0.7, "独\n立"), (1, 4, "chunk", "c5", 0.1, "孤")]
