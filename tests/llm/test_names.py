"""Names that read the same."""

from quarryline.llm.lookalikes import CYRILLIC, GREEK, RADICALS, fold, repairs, unify

REGISTER = ["澜岑证券", "BTX Omeril", "Crédelle Securities", "昀港A", "嵘沛Ｂ", "砚浦·K", "溯坪电力", "湛坪门业", "弘阳末来", "岷浦未来"]


READS = [
    ("澜\u200b岑证券", "澜岑证券"), ("　澜岑证券\t", "澜岑证券"), ("ＢＴＸ Ｏｍｅｒｉｌ", "BTX Omeril"), ("ВТХ Omeril", "BTX Omeril"), ("BTX\u00a0Omeril", "BTX Omeril"), ("Crédelle Securities", "Crédelle Securities"), ("Сrédеllе Ѕесurіtіеѕ", "Crédelle Securities"),
    ("昀港Ａ", "昀港A"), ("昀港А", "昀港A"), ("嵘沛B", "嵘沛Ｂ"), ("砚浦‧K", "砚浦·K"), ("溯坪电カ", "溯坪电力"), ("湛坪⻔业", "湛坪门业"), ("澜岑证券", "澜岑证券"),
    ("澜岑證券", None), ("Credelle Securities", None), ("btx omeril", None), ("澜岑证券集团", None), ("弘阳未来", None), ("", None), ("\u200b", None),
    # the dominant script may be the wrong one: then the vocabulary takes the next
    ("ВТX Omeril", "BTX Omeril"), ("昀港А", "昀港A"), ("BТX Оmеril", "BTX Omeril"),
]


def test_reads_as(spark):
    register = spark.createDataFrame([(x, 1) for x in REGISTER], "n string, value int")
    rows = [(v, i, "x") for i, (v, _) in enumerate(READS)] + [(READS[0][0], 99, "y"), (None, 3, "z")]
    got = unify(spark.createDataFrame(rows, "n string, form int, word string"), "n", register, "n").collect()
    assert len(got) == len(dict(READS)) and {r.value: r.reads_as for r in got} == dict(READS)


def test_dominant_script():
    # one Latin letter in a Cyrillic word stays a Cyrillic word, and is never made more mixed than it is
    assert repairs("пpивет")[0] == "привет" and repairs("привет") == [] and repairs("hello") == []
    assert repairs("Аpple")[0] == "Apple" and repairs("ABC") == [] and repairs("АВС") == ["ABC"]
    assert repairs("电カ") == ["电力"] and repairs("ソニー") == []
    assert repairs("Αθήνa")[0] == "Αθήνα"


def test_equal_forms_compare_equal(spark):
    alike = ["BTX Omeril", "ＢＴＸ\u3000Ｏｍｅｒｉｌ", "B\u200dTX Omeril\ufeff", "ΒТХ Оmеrіl"]
    got = unify(spark.createDataFrame([(x,) for x in alike], "n string"), "n", spark.createDataFrame([("BTX Omeril",)], "n string"), "n").collect()
    assert {r.unified for r in got} == {"BTX Omeril"} and len(got) == 4
    assert fold("e\u0301") == "é"


def test_a_token_is_repaired_although_the_value_is_not_registered(spark):
    got = unify(spark.createDataFrame([("ВТX Holding",)], "n string"), "n", spark.createDataFrame([("BTX Omeril",)], "n string"), "n").first()
    assert (got.unified, got.reads_as) == ("BTX Holding", None)


def test_unknown_values_keep_their_letters(spark):
    got = unify(spark.createDataFrame([("Привет aб",)], "n string"), "n", spark.createDataFrame([("x",)], "n string"), "n").first()
    assert (got.unified, got.reads_as) == ("Привет aб", None)


def test_tables_are_one_to_one():
    assert all(len(k) == len(v) == 1 for t in (CYRILLIC, GREEK, RADICALS) for k, v in t.items())


def test_empty(spark):
    e = spark.createDataFrame([], "n string")
    assert unify(e, "n", e, "n").count() == 0
