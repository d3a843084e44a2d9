"""Text statistics: moments against numpy, kinds, and the defined cases."""

import random

import numpy as np
import pytest

from quarryline.llm.quality import LEAST, LIMIT, NAMES, _moments, common_letters, fit_prose, language_of, prose_distance, statistics, text_statistics

COMMON = ["的", "是", "在", "和", "了", "公司", "the", "of", "and", "to", "is", "was"]


def prose(r):
    subject = ["公司", "管理层", "渠道", "行业", "市场"]
    return "".join(f"{r.choice(subject)}的{r.choice(['收入', '利润', '订单', '产能'])}在{r.randrange(2020, 2027)}年{r.choice(['增长', '下降', '恢复'])}了{r.randrange(1, 90)}%，{r.choice(['好于', '低于', '符合'])}我们和市场的预期。" + ("\n" if r.random() < 0.2 else "") for _ in range(r.randrange(4, 14)))


def english(r):
    return " ".join(f"The {r.choice(['company', 'group', 'market'])} said that {r.choice(['orders', 'sales', 'prices'])} of the {r.choice(['unit', 'plant'])} {r.choice(['rose', 'fell'])} by {r.randrange(1, 90)}% in {r.randrange(2020, 2027)}, which was {r.choice(['better', 'worse'])} than it is used to." for _ in range(r.randrange(4, 12)))


JUNK = ["加群" * 80, "#####\n=====\n_____\n" * 8, "aT7bG0AzB4Zv3Zz9" * 20, "è´¹ç\x94¨ç«¯è¾\x83ä¸ºå\x85\x8b" * 10, "骻対鹟愤対桐贰贰酙愤丛帹対诹鏐夤谬瀇" * 8, "\\u8fd9\\u4e00\\u53d8" * 20]
TABLES = ["项目\t2022\t2023\n" + "".join(f"指标{i}\t{i * 3.1:.2f}\t{i * 2.7:.2f}\n" for i in range(12)), "| 项目 | 2022 |  2023 |\n|---|---|---|\n" + "".join(f"| 指标 | {i}.50 | - |\n" for i in range(12)), "1,电芯,华东,增持\n2,门窗,西南,买入\n3,胶膜,海外,中性\n" * 4]
FIRMS = [x + y + z for x in "岷湛昀砚" for y in "港坪山川" for z in ("水务", "门业", "高科")]
LISTS = ["".join(f"{i + 1}. {n}\n" for i, n in enumerate(FIRMS)), "、".join(FIRMS), "".join(f"• {n} 交付\n" for n in FIRMS)]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(0)
    rows = [(i, prose(r)) for i in range(400)]
    rows += [(500 + i, english(r)) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(JUNK)] + [(2000 + i, t) for i, t in enumerate(TABLES)] + [(3000 + i, t) for i, t in enumerate(LISTS)]
    rows += [(4000, None), (4001, ""), (4002, " \n\u3000"), (None, "公司的收入增长了。"), (5, rows[5][1]), (4003, "".join(prose(r) for _ in range(300)))]
    return spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, kind int, language string"), spark.createDataFrame([("zh", w) for w in COMMON] + [("zh", None)], "lang string, word string")


def test_kinds(table):
    got = {r.doc_id: r.kind for r in prose_distance(*table).collect()}
    assert not {None, 4000, 4001, 4002} & set(got)
    assert sum(k != "prose" for i, k in got.items() if i < 1000) <= 3
    assert {got[1000 + i] for i in range(len(JUNK))} == {"junk"} and {got[2000 + i] for i in range(len(TABLES))} == {"table"} and {got[3000 + i] for i in range(len(LISTS))} == {"list"}


def test_contributions_add_up(table):
    for r in prose_distance(*table).limit(50).collect():
        assert set(r.contributions) == set(NAMES) and abs(sum(r.contributions.values()) - r.distance) < 1e-6 * max(1, r.distance)
        assert (r.kind == "prose") == (r.distance <= LIMIT)


def test_moments_equal_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, len(NAMES)))
    df = spark.createDataFrame([("zh", row.tolist()) for row in x], "language string, x array<double>")
    center = {"zh": (np.zeros(len(NAMES)), np.eye(len(NAMES)))}
    keep = x[(x**2).sum(1) <= 18]
    n, s, p = _moments(df.repartition(5), center, 18)["zh"]
    assert n == len(keep) and np.allclose(s, keep.sum(0)) and np.allclose(p, keep.T @ keep)
    mu, inverse = fit_prose(df, rounds=1, limit=1e9)["zh"]
    assert np.allclose(mu, x.mean(0)) and np.allclose(np.linalg.inv(inverse), np.cov(x.T, bias=True) + np.diag(LEAST**2))


def test_languages_and_statistics():
    assert language_of("公司的收入 of BTX") == "zh" and language_of("The revenue of 岷港") == "en"
    assert len(statistics("x", set())) == len(NAMES) and all(np.isfinite(statistics("。", set())))


def test_dialogue_is_prose_and_a_log_is_junk():
    talk = "\n".join(f"{'JKLM'[i % 4]}. {'Smith Doe Roe'.split()[i % 3]}: The orders of the group rose by {i}% last year, and the margin was stable." for i in range(8))
    log = "\n".join(f"[12:0{i}:13] ERR 0x{i}C97B975 ret=3{i};;@@@@" for i in range(9))
    by = dict(zip(NAMES, statistics(talk, set(COMMON))))
    assert by["enumerated_lines"] == 0 and by["table_rows"] == 0
    by = dict(zip(NAMES, statistics(log, set(COMMON))))
    assert by["table_rows"] == 0 and by["code_tokens"] > 0.3
    assert dict(zip(NAMES, statistics("a. one\nb. two\nc. three", set())))["enumerated_lines"] == 1


def test_short_encoded_pieces_count():
    for text in ("\\u4e2d 和 \\u56fd", "%E4 %B8 %AD", "0x1F 0x2A", "\\xe4 \\xb8"):
        assert dict(zip(NAMES, statistics(text, set())))["code_tokens"] > 0.5


def test_languages_have_a_prose_of_their_own():
    got = [language_of(x) for x in ("Выручка компании выросла на 5%", "売上高は前年から増加しました", "매출은 지난해보다 늘었다", "ارتفعت الإيرادات", "Τα έσοδα αυξήθηκαν", "Ventes en hausse", "收入增长", "###")]
    assert got == ["ru", "ja", "ko", "ar", "el", "en", "zh", "zh"]


def test_common_words_of_any_number_count_alike():
    words = ["的", "公司", "我们", "们的"]
    many = words + [f"词{i}{j}" for i in range(20) for j in range(20)]
    for text in ("我们的公司的公司", "的的的", "", "x" * 9):
        assert common_letters(text, words) == common_letters(text, many)


def test_empty(table):
    docs, common = table
    assert prose_distance(docs.limit(0), common.limit(0)).count() == 0 and text_statistics(docs.limit(0), common).columns == ["doc_id", "language", *NAMES]
