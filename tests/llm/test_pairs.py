"""Pair defects: the chain against brute force, held-out accuracy, and the defined cases."""

import itertools
import random

import numpy as np
import pytest

from quarryline.llm.crf import LinearChain
from quarryline.llm.pairs import Kinds, broken_pairs, clauses, defect, expected_language, features, language, train, training_sequences

ZH = [f"{m}为{n}亿元，较年初有所变化。公司预计{k}将有所恢复，订单充足。" for m, n, k in itertools.product(["毛利率", "营业收入", "净利润", "研发投入"], [12.5, 80.1, 3.7], ["需求", "价格", "产能", "渠道库存"])]
EN = [f"{m} came to {n} bn in 2024. The company expects {k} to recover next year." for m, n, k in itertools.product(["Revenue", "Gross profit", "Capex"], [12.5, 80.1, 3.7], ["orders", "prices", "demand"])]
PAIRS = [(f"公司{i}2024年的{a[:3]}是多少？", a) for i, a in enumerate(ZH)] + [(f"What was the figure of firm {i} in 2024, and why did it change?", a) for i, a in enumerate(EN)]


@pytest.fixture(scope="module")
def model():
    return train(PAIRS * 8, 1)


def test_viterbi_is_the_best_of_all():
    r = np.random.default_rng(0)
    m = LinearChain(3)
    m.weights, m.trans, m.start = r.normal(size=(4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    for n in (1, 2, 5):
        x = r.normal(size=(n, 4))

        def score(p):
            return m.start[p[0]] + sum((x @ m.weights)[i, p[i]] for i in range(n)) + sum(m.trans[a, b] for a, b in zip(p, p[1:]))

        assert tuple(m.decode(x)) == max(itertools.product(range(3), repeat=n), key=score)


def test_gradient_training_learns_transitions():
    r = random.Random(0)
    ys = [np.array([i % 2 for i in range(r.randint(2, 6))]) for _ in range(60)]
    m = LinearChain(2).fit([np.ones((len(y), 1)) for y in ys], ys)
    assert m.decode(np.ones((4, 1))) == [0, 1, 0, 1]


def test_held_out_accuracy(model):
    right = total = 0
    for q, a, labels in training_sequences(PAIRS * 3, 99):
        parts = clauses(a)
        if parts:
            tags = model.decode(features(q, parts))
            right += sum(x == y for x, y in zip(tags, labels))
            total += len(labels)
    assert right / total > 0.95


Q = "岷港水务2024年的毛利率是多少？"


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, "empty"), ("", "empty"), (" \n　", "empty"), ("​", "empty"), ("N/A", "empty"), ("……", "empty"), ("抱歉，我无法回答这个问题。", "refusal"), ("Sorry, I can't help with that.", "refusal"), (Q, "echo"), (f"您问的是：{Q}", "echo"),
        ("Le chiffre d'affaires atteint 12.5 milliards et la marge 40.8 %.", "other_language"), ("売上高は12.5億元で、利益率は57.4%でした。", "other_language"), ("毛利率为35.2%，较年初有所变化。受原料价格", "truncated"), ("毛利率为35.2%，净利率为（", "truncated"),
        ("毛利率为35.2%，较年初有所变化。", None), ("约35.20亿元", None), ("1. 毛利率：35.2%\n2. 净利率：12.1%", None), ("年报没有直接给出该数值，无法直接查到，但可由营业收入推算，约为35.2%。", None),
    ],
)
def test_defects(model, answer, want):
    assert defect(Q, answer, model, False) == want


def test_refusal_is_right_where_allowed(model):
    assert defect("今晚的球赛谁会赢？", "抱歉，我无法回答这个问题。", model, True) is None


def test_languages():
    assert [language(x) for x in ("公司收入增长", "Revenue rose to 5 bn", "Le chiffre d'affaires de la société", "利益率は高いです", "이익률은 높다", "123")] == ["zh", "en", "other", "ja", "ko", "none"]
    assert expected_language("公司前景如何？请用英文回答。") == "en" and expected_language("How risky is 岷港水务 to the coastal ports?") == "en"


def test_tables(spark):
    call = "array<struct<id:string,call_type:string,func:struct<name:string,arguments:string>>>"
    schema = f"sample_id long, question_type string, messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:{call}>>, defect string"
    user, ok = ("user", Q, None, None), ("assistant", "毛利率为35.2%，较年初有所变化。", None, None)
    rows = [(i, "financial_query", [user, ("assistant", a, None, None)], "x") for i, (_, a) in enumerate(PAIRS)]
    rows += [(900, None, [user, ("assistant", None, None, None)], "x"), (901, None, [user], "x"), (902, None, [], "x"), (903, None, None, "x"), (None, None, [user, ok], "x"), (904, None, [ok], "x"), (905, None, [user, ok], "x"), (905, None, [user, ok], "x")]
    rows += [(906, None, [user, ("assistant", "好的", None, [("1", "function", ("search", "{}"))])], "x"), (907, None, [user, ("assistant", "毛利率为35.2%，较年初有所变化。" * 3000, None, None)], "x"), (908, None, [("user", None, None, None), ("assistant", "", None, None)], "x")]
    got = {(r.sample_id, r.defect) for r in broken_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert {(900, "empty"), (901, "empty"), (906, "empty"), (908, "empty")} <= got
    assert not {905, 907, 902, 903, None} & {i for i, _ in got}
    assert broken_pairs(spark.createDataFrame([], schema)).count() == 0


UNSEEN_REFUSALS = (
    "这个话题我没法聊，换一个吧。", "恕我不能就此发表意见。", "我不应该替您做判断，请找专业顾问。", "这类消息我是不会透露的。", "很抱歉，我帮不了您。", "此事不便多谈，请见谅。", "作为AI，我不能推荐具体的股票。", "您问的内容超出了我的职责范围，恕不作答。", "我没有权限查询这些信息。", "抱歉，我拒绝回答。",
    "I'm afraid I can't go into that.", "That's something I won't talk about.", "I am sorry, this is not something I can help with.", "My guidelines do not allow me to discuss individual shares.", "I must decline to answer.", "I don't give advice on this; please see a professional.", "Unfortunately, I cannot assist with that request.", "Je ne peux pas répondre à cela.", "Das darf ich nicht beantworten.", "申し訳ございませんが、お答えできません。",
)
UNSEEN_ANSWERS = (
    ("公司的订单如何？", "公司不愿透露订单金额，但预计全年增长20%。"), ("毛利率是多少？", "抱歉刚才算错了，正确的毛利率应为31.5%。"), ("净利润为何下降？", "监管部门禁止了该业务，导致净利润下降12%。"), ("海外收入多少？", "年报无法区分各地收入，按分部估算海外约占35%。"),
    ("What was the margin?", "The company would not disclose the split, but the margin was about 31% in 2024."), ("How did sales develop?", "Sorry for the late reply: sales rose by 12% to 5.3 bn in 2024."), ("Why did profit fall?", "Regulators refused the merger, so profit fell by 8% in 2023."),
)


def test_phrasing_outside_the_sample(model):
    found = [defect("公司的估值是否合理？" if not t.isascii() else "Is the valuation reasonable?", t, model, False) for t in UNSEEN_REFUSALS]
    assert sum(x == "refusal" for x in found) >= 0.85 * len(found), [t for t, x in zip(UNSEEN_REFUSALS, found) if x != "refusal"]
    kept = [(a, x) for q, a in UNSEEN_ANSWERS if (x := defect(q, a, model, False))]
    assert len(kept) <= 1, kept
    assert defect("What was the revenue?", "Przychody spółki wyniosły 5 miliardów złotych i wzrosły o 12% w tym roku.", model, False) == "other_language"


def test_question_kinds():
    kinds = Kinds(["帮我写一首诗", "推荐一家餐厅", "公司的毛利率是多少", "公司的收入增长了吗"] * 5, [True, True, False, False] * 5)
    assert kinds.rejects("再写一首诗") and not kinds.rejects("公司的净利率是多少") and not kinds.rejects("") and not Kinds([], []).rejects("写诗")
