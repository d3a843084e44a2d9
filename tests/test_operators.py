"""Golden cases of the operators, most against plain Python versions of the same rule."""

import json
import os
import random

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions.calculator import CalculationError, describe, evaluate
from quarryline.functions.text import amount, bigram_overlap, cut_at, iso_date, number2, safe_text
from quarryline.operators import blocks as B
from quarryline.operators import chunking as C
from quarryline.operators import facts, relational
from quarryline.operators import retrieval as R
from quarryline.operators import trajectory as T
from quarryline.sources import files
from quarryline.streaming import windows

BLOCK = "block_id long, pdf_file string, block_idx int, block_type string, text string, text_level int, page_idx int, table_body string"


def blocks(spark, *items):
    """Blocks of one document from (type, text, level, page)."""
    return spark.createDataFrame([(i, "d", i, *x, None) for i, x in enumerate(items)], BLOCK)


def ids(df):
    return sorted(r.block_id for r in df.collect())


@pytest.mark.parametrize("text, value", [("(1505-1294)/1294*100", 16.3060278), ("5%", 0.05), ("2×3÷4", 1.5), ("calculate('1+1')", 2), ("-2**2", -4), ("7//2", 3), ("2+3*4", 14), ("（1＋1）".replace("＋", "+"), 2), ("10%3", None)])
def test_calculator(text, value):
    if value is None:
        with pytest.raises(CalculationError):
            evaluate(text)
    else:
        assert abs(evaluate(text) - value) < 1e-6


def test_calculator_messages():
    assert describe("100/0") == "[计算错误] 除数为零" and describe("abc") == "[计算错误] 无法计算" and describe("9**9**9").startswith("[计算错误]") and describe(None) is None
    assert describe("1+1") == "计算结果: 2" and describe("20000*1.5") == "计算结果: 3.0000万" and describe("1e5") == "[计算错误] 无法计算"


@given(st.integers(-99, 99), st.integers(1, 99), st.integers(-9, 9), st.sampled_from("+-*"), st.sampled_from("+-*/"))
def test_calculator_agrees_with_python(a, b, c, f, g):
    text = f"({a}){f}{b}{g}({c or 1})"
    assert abs(evaluate(text) - eval(text)) < 1e-9  # noqa: S307


def test_text_functions(spark):
    df = spark.createDataFrame([("a", 2.675, "买 入　x", "2024/05/06"), ("b", 12_345.0, "nan", "2024-05-06T00:00:00"), ("c", 1e8, None, "x"), ("d", float("nan"), "", None)], "k string, v double, s string, d string")
    got = {r[0]: tuple(r)[1:] for r in df.select("k", number2(F.col("v")), amount(F.col("v")), safe_text(F.col("s")), iso_date(F.col("d")).cast("string")).collect()}
    assert got == {"a": (f"{2.675:.2f}", f"{2.675:.2f}元", "买入x", "2024-05-06"), "b": ("12345.00", "1.23万元", "", "2024-05-06"), "c": ("100000000.00", "1.00亿元", "", None), "d": (None, None, "", None)}
    cut = spark.createDataFrame([("一二三四五。七八九十",), ("一。三四五六七八九十",), ("一二",)], "t string").select(cut_at(F.col("t"), 8, "。")).collect()
    assert [r[0] for r in cut] == ["一二三四五。", "一。三四五六七八...", "一二"]
    assert spark.range(1).select(bigram_overlap(F.lit("abcd"), F.lit("abx")), bigram_overlap(F.lit("a"), F.lit("ab"))).first() == (0.5, 0.0)


def test_authors(spark):
    items = [("text", "分析师：林某某", None, 0), ("text", "021-25102905", None, 0), ("image", None, None, 0), ("text", "x@y.com", None, 0), ("text", "正文从这里开始说明", None, 0), ("text", "021-25102905", None, 0)]
    assert ids(B.drop_authors(blocks(spark, *items))) == [2, 4, 5]
    far = [("text", "分析师：林某某", None, 0)] + [("table", None, None, 0)] * 8 + [("text", "021-25102905", None, 0)]
    assert ids(B.drop_authors(blocks(spark, *far))) == list(range(1, 10))


def test_contents(spark):
    two = [("text", "目录", None, 0), ("text", "一、风险提示 3", None, 0), ("text", "正文正文", None, 0)]
    three = [("list", None, None, 0), ("text", "目录", None, 0), ("list", None, None, 0), ("text", "1. 全球市场 4", None, 0), ("text", "风险提示......5", None, 0), ("text", "", None, 0), ("text", "正文", None, 0)]
    assert ids(B.drop_contents(blocks(spark, *two))) == [0, 1, 2] and ids(B.drop_contents(blocks(spark, *three))) == [0, 6]


def test_disclaimer(spark):
    items = [("text", "免责声明", 1, 0), ("text", "a", None, 1), ("text", "免责声明", None, 3), ("text", "重要声明", 1, 3), ("text", "b", None, 3)]
    assert ids(B.cut_disclaimer(blocks(spark, *items))) == [0, 1, 2]


def test_captions(spark):
    items = [("table", None, None, 0), ("text", "图 1：收入", None, 0), ("text", "资料来源：公司", None, 0), ("table", None, None, 0), ("text", "资料来源：公司", None, 0)]
    got = {r.block_id: (r.captions, r.sources) for r in B.attach_captions(blocks(spark, *items)).collect()}
    assert got == {0: ("图 1：收入", None), 2: (None, None), 3: (None, "资料来源：公司")}


def merge_spec(items):
    out = []
    for i, (kind, text, level, page) in enumerate(items):
        t = (text or "").strip()
        p = out[-1] if out else None
        if p and p["plain"] and kind == "text" and level is None and t and p["text"].strip() and page - p["page"] <= 1:
            last, first = p["text"].strip()[-1], t[0]
            if last not in B.SENTENCE_END and (last in B.BROKEN_TAIL or first in B.BROKEN_HEAD):
                p["text"] = p["text"].rstrip() + (text or "").lstrip()
                p["parts"] += 1
                continue
        out.append({"at": i, "page": page, "text": text or "", "plain": kind == "text" and level is None, "parts": 1})
    return [(p["at"], p["page"], p["text"], p["parts"]) for p in out if p["plain"]]


def test_merge_is_the_fold(spark):
    r = random.Random(0)
    docs, want = [], []
    for d in range(40):
        items = [(r.choice(["text", "text", "text", "table"]), r.choice(["收入增长，", "利润", "3亿元", "增长。", "", " 但", "：", None]), r.choice([None, None, None, 1]), i // 2) for i in range(9)]
        docs += [(d * 100 + i, f"d{d}", i, *x, None) for i, x in enumerate(items)]
        want += [(f"d{d}", *x) for x in merge_spec(items)]
    got = rows(B.merge_broken(spark.createDataFrame(docs, BLOCK)).drop("block_id"))
    assert got == sorted(want, key=repr)


def test_sections(spark):
    items = [("text", "前言", None, 0), ("text", "一、概况", 1, 0), ("text", "二、财务", 1, 1), ("text", "甲", None, 1), ("text", "小节", 2, 1), ("table", None, None, 1), ("text", "乙", None, 2)]
    assert rows(B.sections(blocks(spark, *items))) == [("d", 0, "", 0, "前言"), ("d", 1, "二、财务", 1, "甲\n\n小节\n\n乙")]


def test_cleaning_of_clean_blocks_changes_nothing(spark):
    items = [("text", f"这是第{i}段足够长的正文，没有什么要清理的。", None, i) for i in range(4)]
    once = B.clean_blocks(blocks(spark, *items)).select("block_id", "text")
    assert rows(once) == [(i, x[1]) for i, x in enumerate(items)] and B.clean_blocks(blocks(spark).limit(0)).count() == 0


def pack_spec(table, size):
    lines = table.split("\n")
    if len(table) <= size:
        return [table]
    head, out, cur, n = "\n".join(lines[:2]), [], [], len("\n".join(lines[:2]))
    for row in lines[2:]:
        if cur and n + len(row) + 1 > size:
            out.append(cur)
            cur, n = [], len(head)
        cur.append(row)
        n += len(row) + 1
    return [head + "\n" + "\n".join(c) for c in out + ([cur] if cur else [])]


def test_packed_rows(spark):
    r = random.Random(1)
    tables = ["\n".join(["| a | b |", "|---|---|"] + ["| " + "x" * r.randrange(1, 60) + " |" for _ in range(r.randrange(0, 12))]) for _ in range(30)]
    got = rows(C.packed_rows(spark.createDataFrame(list(enumerate(tables)) + [(99, None), (98, "")], "k long, t string"), ["k"], "t", 100))
    assert got == sorted([(k, i, p) for k, t in enumerate(tables) for i, p in enumerate(pack_spec(t, 100))], key=repr)


@given(st.text(alphabet="ab。\n；", max_size=300))
def test_sliding_pieces_hold_no_more_than_the_size(text):
    assert all(5 <= len(p) <= 40 for p in C.sliding_pieces(text, 40, 8, 5))


def test_markdown(spark):
    assert C.to_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>") == "| a | b |\n|---|---|\n| 1 |" and C.to_markdown("x") == "x" and C.to_markdown(None) is None
    text = "前\n| a | b |\n|---|---|\n| 1 | 2 |\n后\n| 不是 | 表 |"
    got = [tuple(r) for r in C.markdown_runs(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string"), ["k"]).orderBy("block_no").collect()]
    assert got == [(1, 0, "prose", "前"), (1, 1, "table", "| a | b |\n|---|---|\n| 1 | 2 |"), (1, 2, "prose", "后\n| 不是 | 表 |")]
    made = C.table_facts(spark.createDataFrame([(1, "<table><tr><td>项目</td><td>2024</td></tr><tr><td>收入</td><td>5</td></tr><tr><td>利润</td><td>-</td></tr></table>"), (2, None)], "k long, t string"), "k", "t")
    assert rows(made) == [(1, 1, "项目收入，20245")]


def test_residue(spark):
    t = "a<br>b&nbsp;c</td>\n第 3 页\n\n\n\n正文" + "正" * 40 + "\n免责声明\n尾"
    assert spark.createDataFrame([(t,)], "t string").select(C.residue_free(F.col("t"))).first()[0] == "a b c\n正文" + "正" * 40


def test_child_chunks(spark):
    df = spark.createDataFrame([("p", "叙" * 30, ["短", "事实" * 6]), ("q", "短", None)], "id string, n string, f array<string>")
    assert rows(C.child_chunks(df, "id", "n", "f")) == [("p_n", "p", "table_narrative", "叙" * 30), ("p_r1", "p", "table_row_fact", "事实" * 6)]


def test_relational(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e"), (None, "f")], "k long, v string")
    assert rows(relational.merge_old_first(old, new, ["k"])) == sorted([(1, "a"), (2, "b"), (3, "d"), (3, "e"), (None, "f")], key=repr)
    assert rows(relational.override(old, new.filter("k = 2"), "k", "v")) == [(1, "a"), (2, "c")]
    assert rows(relational.not_done(old, new, "k")) == [(1, "a")]
    assert rows(relational.newest_per_key(new, "k", [F.asc("v")], 1)) == [(2, "c", 1), (3, "d", 1)]
    got = relational.contained_aliases(spark.createDataFrame([("白酒行业与食品",), (None,)], "t string"), "t", {"白酒": "酒", "酒": "酒", "食品": "食"}, 5).collect()
    assert got[0].matches == ["酒", "食"]


def test_product_check(spark):
    got = spark.createDataFrame([(10.0, 1.0, 2.0, 20.5), (10.0, 1.0, 2.0, 21.5), (10.0, 1.0, 2.0, 23.5), (10.0, None, 2.0, 20.0)], "m double, t double, e double, r double").select(facts.check_product(*map(F.col, "mter"))).collect()
    assert [r[0] for r in got] == ["ok", "warning", "none", None]


def test_fusion_ignores_monotone_changes(spark):
    base = [(1, f"c{i}", s, float((i * 7) % 5 + i / 10), None) for i in range(8) for s in ("a", "b")]
    schema = "query_id long, chunk_id string, retriever string, score double, hit_ts timestamp"

    def fused(items):
        return rows(R.reciprocal_rank_fusion(R.ranked_lists(R.latest_scores(spark.createDataFrame(items, schema)))))

    assert fused(base) == fused([(q, c, s, x**3 + 5, t) for q, c, s, x, t in base])


def test_hot_lists_are_ranked_alike(spark):
    r = random.Random(4)
    items = [(r.choice([1, 1, 1, 2]), f"c{i}", r.choice("ab"), r.choice([0.5, 1.5, r.random()])) for i in range(120)]
    df = spark.createDataFrame(items, "query_id long, chunk_id string, retriever string, good double")
    assert rows(R.ranked_lists(df)) == rows(R.ranked_lists(df, 20)) == rows(R.ranked_lists(df, 0)) and R.ranked_lists(df.limit(0)).count() == 0


def test_budget(spark):
    items = [(1, f"c{i}", "d" if i < 5 else None, i, "x" * (50 if i else 500)) for i in range(9)]
    got = R.within_budget(spark.createDataFrame(items, "q long, c string, d string, p int, t string"), "q", "d", "p", "t", 3, 620, 9).orderBy("slot").collect()
    assert [(r.c, r.used) for r in got] == [("c0", 500), ("c1", 550), ("c2", 600)]


def test_min_max_constant(spark):
    df = spark.createDataFrame([(1, "a", "r", 3.0), (1, "b", "r", 3.0)], "query_id long, chunk_id string, retriever string, good double")
    assert {r.scaled for r in R.min_max(df, 1.0).collect()} == {1.0} and {r.scaled for r in R.min_max(df).collect()} == {0.0}


CALL = 'thought\n<tool_call>\n{"name": "search", "arguments": {"query": "毛利率"}}\n</tool_call><|im_end|>'


@pytest.mark.parametrize(
    "text, want",
    [(CALL, ("thought", "search", "毛利率")), ('{"name": "calc", "arguments": {"expression": "1+1"}}', (None, "calc", "1+1")), ("plain answer", ("plain answer", None, None)), ("<tool_call>{bad</tool_call>x", ("x", None, None)), ('<tool_call><tool_call>{"name": "a", "arguments": {"query": "q"}}</tool_call>', (None, "a", "q"))],
)
def test_parse_call(spark, text, want):
    call = T.parse_call(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(call["content"], call["name"], T.query_argument(call["arguments"])).first()
    assert tuple(r) == want


def test_answers_and_scores(spark):
    one = spark.range(1)
    assert one.select(T.final_answer(F.lit("a<tool_call>x</tool_call><tool_response>y</tool_response> 答案<|im_end|>"))).first()[0] == "答案"
    thought = T.split_thought(F.lit("先想\n\n综合来看"))
    assert tuple(one.select(thought["thought"], thought["answer"]).first()) == ("先想", "综合来看")
    assert [one.select(T.overlong_penalty(F.lit("x" * n))).first()[0] for n in (5461, 6827, 8193)] == [0.0, -0.25, -0.5]
    assert one.select(T.coverage([(1.0, F.lit(True), F.lit(0.5)), (3.0, F.lit(False), F.lit(1.0))]), T.coverage([(1.0, F.lit(False), F.lit(1.0))])).first() == (0.5, 0.5)
    assert one.select(T.reuses_result(F.lit("约16.31%"), F.array(F.lit("结果 16.31"))), T.reuses_result(F.lit("约116.31%"), F.array(F.lit("结果 16.31")))).first() == (True, False)
    steps = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(q).alias("query")) for t, q in (("a", "毛利率是多少"), ("a", "毛利率是多少"), ("z", "完全不同的问题"))))
    assert one.select(T.call_penalty(steps, ["a"])).first()[0] == -0.8
    assert one.select(T.needs_calculation(F.lit("差距多少"), F.lit(None)), T.needs_calculation(F.lit("是什么"), F.lit("5-3=2")), T.needs_calculation(F.lit("是什么"), F.lit("是5"))).first() == (True, True, False)


def test_rendered_spans_cut_out_what_was_written(spark):
    call = [("c1", "function", ("search", '{"query": "q"}'))]
    messages = [("user", "问", None, None), ("assistant", "想", None, call), ("tool", "一", "c1", None), ("tool", "二", "c2", None), ("assistant", "答", None, None)]
    schema = "m array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,call_type:string,func:struct<name:string,arguments:string>>>>>"
    r = spark.createDataFrame([(messages,)], schema).select(T.render_chat(F.col("m")).alias("c")).select("c", T.assistant_spans(F.col("c")).alias("s")).first()
    assert [r.c[s.start : s.end] for s in r.s] == ['\n想\n<tool_call>\n{"name": "search", "arguments": {"query": "q"}}\n</tool_call><|im_end|>', "答<|im_end|>"]
    assert r.c.startswith("<|im_start|>system\n") and r.c.count("<|im_start|>user\n<tool_response>") == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,name\n000001,"甲\n乙"\n', encoding="utf-8")
    assert rows(files.read_csv(spark, str(tmp_path / "a.csv"), "code string, name string")) == [("000001", "甲\n乙")]
    (tmp_path / "m.json").write_text(json.dumps({"x": {"v": 1}, "y": {"v": 2}}))
    assert sorted((r.key, r.value.v) for r in files.read_json_map(spark, str(tmp_path / "m.json"), "struct<v:int>").collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "c.json").write_text('[\n// note\n{"v": 1}]')
    assert rows(files.read_commented_json(spark, str(tmp_path / "c.json"), "v int")) == [(1,)]
    (tmp_path / "l.jsonl").write_text('{"v": 1}\n\nbad\n{"v": 2}\n')
    assert rows(files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "v int", True)) == [(1,), (2,)]
    files.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "source_type string, v int"), str(tmp_path / "p"))
    assert sorted(x for x in os.listdir(tmp_path / "p") if "=" in x) == ["source_type=a", "source_type=b"]
    assert files.find_files(spark, str(tmp_path), "*.jsonl").count() == 1


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(*windows.EVENTS.fieldNames())
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling_counts(windows.read_events(spark, str(tmp_path / "in")), "1 day")
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rows(events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1))))
    assert sorted((str(r.start)[:10], r.event_type, r.n_events) for r in spark.table("tumbled").collect()) == sorted((str(d), t, n) for d, t, n in want)
    windows.write_available(windows.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    windows.write_available(windows.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    assert windows.session_counts(events).agg(F.sum("n_events")).first()[0] == events.filter("user_id is not null").count()
