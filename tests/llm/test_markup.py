"""Markup: trees against brute force, held-out accuracy, kinds and clean text."""

import numpy as np
import pytest

from quarryline.llm.boosting import BoostedTrees
from quarryline.llm.markup import CONSTRUCTS, _labelled_rows, candidates, clean, decode, elements, features, markup_fields, markup_nodes, trained


@pytest.fixture(scope="module")
def model():
    return trained()


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (800, 5)).astype(float)
    y = ((x[:, 0] != x[:, 3])).astype(float)
    assert ((BoostedTrees(40, 3).fit(x, y).probability(x) > 0.5) == (y > 0.5)).mean() == 1.0


def test_held_out_accuracy(model):
    x, y = _labelled_rows(300, 4242)
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.98


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("毛利率为<b>35%</b>，较好。", {"html"}), ("收入&nbsp;增长&#xff0c;利润", {"html"}), ("正文<!-- chart 3 -->。", {"html"}), ("# 风险因素\n\n正文", {"markdown"}), ("重点是**毛利率**。", {"markdown"}), ("见[图](chart_3.png)。", {"markdown"}),
        ("| 项目 | 2024 |\n|---|---|\n| 收入 | 5 |", {"markdown"}), ("见[[特种阀门|阀门]]。", {"wiki"}), ("== 风险因素 ==\n正文", {"wiki"}), ("其中$n=37$。", {"latex"}), ("\\begin{itemize}\n\\item 收入\n\\end{itemize}", {"latex"}), ("<td>**费用率**</td><td>$3.1\\%$</td>", {"html", "markdown", "latex"}),
        ("当前PE<20且PB>1.2，估值不贵。", set()), ("*ST岷山：定制门窗", set()), ("区间为4.1%~7.2%，中枢约5.9%~。", set()), ("文件file_51_v2已归档。", set()), ("对价约$ 5.4亿，尾款$ 9.1亿。", set()), ("见脚注[1]、[2]。", set()), ("A==B==C", set()), ("R&D spending", set()), ("", set()),
        ("```\nx = (1 + r) ** n\n# step 3\n```", {"markdown"}), ("<pre><code>ROE = NPM * AT * EM</code></pre>", {"html"}),
    ],
)
def test_kinds(model, text, kinds):
    assert {n.kind for n in markup_nodes([text], model)[0]} == kinds


@pytest.mark.parametrize(
    "text, want",
    [
        ("<h3>风险</h3><ul><li>一</li><LI>二</ul>", "### 风险\n\n- 一\n- 二"), ("<ol><li>一</li><li>二<ul><li>甲</li></ul></li></ol>", "1. 一\n2. 二\n\n  - 甲"), ("<table><tr><td>项目</td><td>2024</td></tr><tr><td>收入</td><td>5</td></tr></table>", "项目\t2024\n收入\t5"),
        ("## 风险\n\n**重点**`x = 1`", "## 风险\n\n重点`x = 1`"), ("| 项目 | 2024 |\n|---|---|\n| 收入 | 5 |", "项目\t2024\n收入\t5"), ("其中 $v = \\frac{s}{t}$ 。", "其中 $v = \\frac{s}{t}$ 。"), ("\\begin{tabular}{lr}\n项目 & 2024 \\\\\n收入 & 5 \\\\\n\\end{tabular}", "项目\t2024\n收入\t5"),
        ("'''好'''，[[甲|乙]]", "好，乙"), ("55&#x2c;914元&amp;nbsp;。", "55,914元 。"), ("```\nx = 1\n```", "```\nx = 1\n```"), ("<pre><code>a &lt; b\nc</code></pre>", "```\na < b\nc\n```"), ("正文<script>if (a < b) { x(); }</script>。", "正文。"),
        ("== 风险 ==\n正文", "## 风险\n\n正文"), ("见{{a|{{b|c}}}}。", "见c。"), ("\\begin{enumerate}\n\\item 甲\n\\item 乙\n\\end{enumerate}", "1. 甲\n2. 乙"), ("<div><p><b>x</b></p></div>", "x"),
    ],
)
def test_clean_text(model, text, want):
    assert clean(text, markup_nodes([text], model)[0]) == want


def test_elements_are_a_tree():
    text = "<div><p>a<p><b class=x>c</b></div><br><li>y</i></li>"
    got = [(n.name, text[n.start : n.end], n.depth, n.parent, n.twins, n.ordinal, n.below) for n in elements(text)]
    assert got == [
        ("div", "<div><p>a<p><b class=x>c</b></div>", 0, -1, 1, 1, 3), ("p", "<p>", 1, 0, 2, 1, 0), ("p", "<p>", 1, 0, 2, 2, 1), ("b", "<b class=x>c</b>", 2, 2, 1, 1, 0), ("br", "<br>", 0, -1, 1, 1, 0),
        ("li", "<li>y</i></li>", 0, -1, 1, 1, 1), ("i", "</i>", 1, 5, 1, 1, 0),
    ]
    row = features(text, sorted(elements(text), key=lambda n: (n.start, -n.end)))[3]
    assert row[18] == 1 and row[19] == 2 and row[23] == 1


def test_decoding_has_no_contradictions(model):
    text = "**甲 `a ** b` 乙** <pre># x\n**y**</pre> $a_{1}$ {{x|[[y]]}} <b>**甲</b>乙**"
    taken = markup_nodes([text], model)[0]
    for a in taken:
        for b in taken:
            assert not a.start < b.start < a.end < b.end
            assert not (CONSTRUCTS[a.construct][4] and a.start <= b.start and b.end <= a.end and (a.start, a.end) != (b.start, b.end))
    assert decode([]) == [] and candidates("") == []


def test_time_grows_with_the_length(model):
    import time

    def seconds(rows):
        text = "<table>" + "<tr><td>项目</td><td>1.5</td><td>&nbsp;</td></tr>" * rows + "</table>"
        began = time.process_time()
        assert clean(text, markup_nodes([text], model)[0]).count("\n") == rows - 1
        return time.process_time() - began

    seconds(20)
    small, large = seconds(1_000), seconds(10_000)
    assert large < 25 * small + 1


def test_phrasing_outside_the_sample(model):
    for text, kind in (("The <em>annual</em> meeting", "html"), ("<p lang=de>Hallo Welt</p>", "html"), ("see [the map](maps/north.svg) now", "markdown"), ("{{cite web|url=x|title=Bridges}}", "wiki"), ("Let \\(x \\ge 0\\) hold.", "latex"), ("**Note:** doors open at 9.", "markdown"), ("A \\emph{very} old bridge", "latex"), ("> to be or not", "markdown")):
        assert {n.kind for n in markup_nodes([text], model)[0]} == {kind}
    for text in ("3 < 4 and 5 > 2", "rooms *101 and *102", "from $5 to $7", "see note [3] and [4]", "my_file_name.txt", "Tom & Jerry; friends", "5~7 kilometres", "a | b | c"):
        assert not markup_nodes([text], model)[0]


def test_tables(spark):
    schema = "block_id long, text string, table_body string, field_name string, k int"
    rows = [(1, "a<br>b", None, "z", 1), (1, "a<br>b", None, "z", 1), (2, None, "<table><tr><td>x</td></tr></table>", "z", 1), (3, "", "", "z", 1), (4, None, None, "z", 1), (None, "<b>x</b>", None, "z", 1), (5, "平文" * 20000, None, "z", 1), (6, "<p>" + "长" * 50000 + "</p>", None, "z", 1)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.block_id, r.field_name): (r.kinds, r.clean_text) for r in markup_fields(df).collect()}
    assert set(got) == {(1, "text"), (2, "table_body"), (5, "text"), (6, "text")}
    assert got[1, "text"] == (["html"], "a\nb") and got[5, "text"][0] == [] and len(got[6, "text"][1]) == 50000
    assert markup_fields(df).count() == 4 and markup_fields(df.limit(0)).count() == 0
