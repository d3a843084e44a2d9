"""Scan noise: each rule on small texts, both ways of applying corrections, and the defined cases."""

import pytest

from quarryline.llm import scans
from quarryline.llm.scans import NUMERALS, Corrections, Names, corrections, document_paragraphs, inspect, join_lines, page_furniture, read_noise, scan_noise

SCHEMA = "block_id long, pdf_file string, block_idx int, block_type string, text string, text_level int, page_idx int, noise string, name int"
GOOD = "公司的毛利率为35.2%，客户数达到{}家，订单充足。该项目预计在2026年投产。"
EN = "Orders were up {}.5%, which is better than the pattern and the outlook of the company."


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(i, "a.pdf", i, "text", (GOOD * 2).format(100 + i, i) if i % 2 else EN.format(i + 10), None, i // 4) for i in range(400)]
    rows += [
        (500, "b.pdf", 0, "text", "公可的毛刊率为35.2%，订单充足。", None, 0), (501, "b.pdf", 1, "text", "公司的毛利率为3S.2%，订单充足。", None, 0), (502, "b.pdf", 2, "text", "Orders were up 12.5%, wliich is better than the pattern.", None, 0), (503, "b.pdf", 3, "text", "Orders were up by the pat-\ntern, and the outlook.", None, 0),
        (504, "b.pdf", 4, "text", "the out¬\r\nlook of the company. One of the orders.", None, 0), (505, "b.pdf", 5, "text", "岷可水务的毛利率为35.2%，订单充足。", None, 0), (506, "b.pdf", 6, "text", "2023-\n2025年间，公司订单充足。", None, 0), (507, "b.pdf", 7, "text", "B2B采购与O2O配送", None, 0), (508, "b.pdf", 8, "text", "Orders of the com-", None, 0), (509, "b.pdf", 9, "text", "pany were up.", None, 1),
        (510, None, 9, "text", "第 1 页", None, 1), (None, "b.pdf", 9, "text", "第 1 页", None, 1), (511, "b.pdf", 10, "text", None, None, 1), (512, "b.pdf", 11, "text", "", None, 1), (513, "b.pdf", 12, "table", "公可", None, 1),
    ]
    for p in range(4):
        rows += [(600 + p, "c.pdf", p * 10, "text", f"某某证券 研究报告 202{p}", None, p), (610 + p, "c.pdf", p * 10 + 5, "text", f"Page {p + 1} of 4", None, p), (620 + p, "c.pdf", p * 10 + 3, "text", f"正文第{p}段没有什么，只是说明情况", 1, p)]
    rows += [(630, "c.pdf", 99, "text", "2025", None, 3), (631, "c.pdf", 98, "text", "9.2%", None, 3), (600, "c.pdf", 0, "text", "某某证券 研究报告 2020", None, 0)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("岷可水务",), (None,)], "name string")


WANT = {(500, "misread"), (501, "misread"), (502, "misread"), (503, "broken_word"), (504, "broken_word"), (508, "broken_word"), *((600 + p, "running_header") for p in range(4)), *((610 + p, "page_number") for p in range(4))}


def test_noise(blocks, names):
    got = [(r.block_id, r.noise) for r in scan_noise(blocks, names).collect()]
    assert len(got) == len(set(got)) and set(got) == WANT


def test_joined_corrections_give_the_same(blocks, names, monkeypatch):
    broadcast = sorted(map(tuple, read_noise(blocks, names).collect()))
    monkeypatch.setattr(scans, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, read_noise(blocks, names).collect())) == broadcast


def test_repaired_text(blocks, names):
    by = {r.block_id: r.repaired for r in read_noise(blocks, names).collect()}
    assert by[500] == "公司的毛利率为35.2%，订单充足。" and by[501].startswith("公司的毛利率为35.2%") and by[503] == "Orders were up by the pattern, and the outlook."
    assert by[505].startswith("岷可水务") and by[506] == "2023-2025年间，公司订单充足。"


def test_join_lines():
    assert join_lines("收入增长，\n利润\n下降") == "收入增长，利润下降"
    assert join_lines("one\ntwo re-\ntendered", {"re-tendered"}) == "one two re-tendered"
    assert join_lines("") == "" and join_lines("2,1\n93家") == "2,193家"


def test_names_are_masked():
    assert Names(["甲乙", "A"]).mask("甲乙1丙") == "\ue000\ue0000丙"


def test_furniture_is_left_out_of_paragraphs(blocks, names):
    got = [r for r in document_paragraphs(blocks, names).collect() if r.pdf_file == "c.pdf"]
    assert got and all("研究报告" not in r.text and "Page" not in r.text for r in got)


def test_numerals():
    assert [NUMERALS[n - 1] for n in (1, 10, 11, 20, 21, 101, 110, 215)] == ["一", "十", "十一", "二十", "二十一", "一百零一", "一百一十", "二百一十五"] and len(set(NUMERALS)) == 999


def test_page_numbers_go_with_the_sequence(spark):
    rows = [(p, "a.pdf", p, "text", f"第{NUMERALS[p + 4]}页", None, p) for p in range(6)] + [(10, "a.pdf", 9, "text", "3", None, 2), (11, "b.pdf", 0, "text", "1", None, 0), (12, "b.pdf", 1, "text", "7", None, 1), (13, "b.pdf", 2, "text", "第二页 共三页", None, 1)]
    got = page_furniture(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert {r.block_id for r in got} == {0, 1, 2, 3, 4, 5, 11, 13}


def test_headers_are_alike_at_edges(spark):
    # page 3 has a misread header: furniture, but no exact one; the line in the middle of pages is none
    rows = [(p * 10 + i, "a.pdf", i, "text", t, None, p) for p in range(5) for i, t in enumerate(["某某证券 年度研究报吿" if p == 3 else "某某证券 年度研究报告", f"第一段说的是{'甲乙丙丁戊'[p]}这件事情", f"订单{'甲乙丙丁戊'[p]}与产能", "图中数据截至期末", f"利润{'甲乙丙丁戊'[p]}与费用", f"最后一段说的是另外{'甲乙丙丁戊'[p]}的事情", f"本页{'甲乙丙丁戊'[p]}的其余部分见附录"])]
    got = {r.block_id: r.exact for r in page_furniture(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    assert got == {0: True, 10: True, 20: True, 30: False, 40: True}


def test_a_register_of_any_size(spark):
    many = spark.range(100_001).selectExpr("concat('公可', cast(id as string), '号') as name")
    few = spark.createDataFrame([(1, "公可7号的毛利率")], "block_id long, text string").selectExpr("block_id", "'a.pdf' as pdf_file", "1 as block_idx", "'text' as block_type", "text", "cast(null as int) as text_level", "0 as page_idx")
    assert read_noise(few, many).first().misread is False


def test_empty(blocks, names):
    assert scan_noise(blocks.limit(0), names.limit(0)).count() == 0 and page_furniture(blocks.limit(0)).count() == 0


def test_no_corrections_without_a_corpus(spark):
    few = spark.createDataFrame([(1, "公可的毛刊率")], "block_id long, text string")
    assert corrections(few, spark.sparkContext.broadcast(Names([]))).count() == 0
    assert inspect("公可", Names([]), Corrections({})) == (False, False, "公可")
