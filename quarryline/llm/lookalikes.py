"""One consistent form for text that looks the same: invisible characters, widths, accents, radicals, look-alike letters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.checkpoints import cut_lineage
from quarryline.functions.joins import join_small

# Look-alike letters by Unicode. Left what is written, right the Latin letter that it looks like.
CYRILLIC = dict(zip("АВСЕНІЈКМОРЅТХУҮԚԜаесһіјорѕхуԁԛԝѵӏ", "ABCEHIJKMOPSTXYYQWaechijopsxydqwvl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυϲϳ", "ABEZHIKMNOPTYXayikvopucj"))
OTHER = {"օ": "o", "ո": "n", "ս": "u", "ɡ": "g", "ɑ": "a", "ı": "i", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T"}
#: Katakana and other signs that look like a Chinese character.
KANA = {"カ": "力", "エ": "工", "ニ": "二", "ロ": "口", "ハ": "八", "タ": "夕", "ト": "卜", "ミ": "三", "ー": "一", "メ": "乄", "オ": "才", "ヌ": "又", "チ": "千"}
#: Marks that look the same.
MARKS = dict.fromkeys("‧・･∙⋅•ꞏᐧ・", "·") | dict.fromkeys("‐‑‒–−﹣⁃˗", "-") | dict.fromkeys("∗⁎﹡٭", "*") | {"’": "'", "ʼ": "'", "＇": "'", "⁄": "/", "∕": "/", "﹒": ".", "․": ".", "ꓸ": "."}
#: Radicals of the supplement block that stand for a character of the same shape (those of the Kangxi block decompose by themselves).
RADICALS = dict(
    zip(
        "⺁⺄⺅⺆⺇⺊⺎⺏⺒⺓⺔⺖⺘⺙⺛⺜⺝⺞⺟⺠⺡⺣⺦⺧⺨⺩⺪⺫⺬⺭⺮⺰⺲⺳⺶⺹⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻏⻐⻑⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳",
        "厂乙亻冂几卜兀尣巳幺彐忄扌攵旡日月歹母民氵灬丬牛犭王疋目示礻竹纟罒网羊耂聿肉臼艹虎衤覀西见角讠贝足车辶阝钅長长门阜阝雨青韦页风飞食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟亀龟",
    )
)
#: Invisible characters besides those of category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
LATIN_OF = CYRILLIC | GREEK | OTHER
#: Look-alikes by the script into which they are taken; Cyrillic and Greek take only letters of Latin.
INTO = {"latin": LATIN_OF, "cyrillic": {v: k for k, v in reversed(CYRILLIC.items())}, "greek": {v: k for k, v in reversed(GREEK.items())}}
#: Letters that may be mistaken for another script's.
AMBIGUOUS = set(LATIN_OF) | set(KANA) | set(INTO["cyrillic"]) | set(INTO["greek"])
#: Decompositions that keep the shape of a letter.
KEPT_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def script(c: str) -> str | None:
    """Script of a letter: latin, han, cyrillic, greek, kana or other; None for what is no letter."""
    if not unicodedata.category(c).startswith("L"):
        return None
    name = unicodedata.name(c, "")
    for s, starts in (("latin", ("LATIN",)), ("han", ("CJK", "KANGXI")), ("cyrillic", ("CYRILLIC",)), ("greek", ("GREEK",)), ("kana", ("KATAKANA", "HIRAGANA"))):
        if name.startswith(starts):
            return s
    return "other"


@lru_cache(200_000)
def _fold(c: str) -> str:
    n = ord(c)
    if n in INVISIBLE or unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\x0b\x0c\x85":
        return ""
    if c.isspace():
        return " "
    if c in RADICALS:
        return RADICALS[c]
    parts = unicodedata.decomposition(c)
    if parts and (parts.split()[0] in KEPT_TAGS or 0x2F00 <= n <= 0x2FD5 or 0xFB00 <= n <= 0xFB06 or 0x2160 <= n <= 0x217F):
        c = "".join(_fold(x) for x in unicodedata.normalize("NFKC", c))
    return "".join(MARKS.get(x, x) for x in c)


def fold(text: str) -> str:
    """Without invisible characters and outer space, in one width, composed, marks of one shape as one mark."""
    return unicodedata.normalize("NFC", "".join(map(_fold, text))).strip()


def _votes(token: str) -> dict[str, tuple[int, int]]:
    """Script -> (letters that can't be mistaken for another script's, all letters) of a token."""
    out: dict[str, tuple[int, int]] = {}
    for c in token:
        if s := script(c):
            sure, n = out.get(s, (0, 0))
            out[s] = (sure + (c not in AMBIGUOUS), n + 1)
    return out


def repairs(token: str) -> list[str]:
    """Forms that a token may stand for, the most likely first; none if nothing about it is doubtful.

    A token is a stretch without space. Its dominant script is the one with the most letters that can't be mistaken, then the one with the most letters; letters of other scripts are replaced by
    look-alikes of the dominant one. Names join Chinese with an alphabet, so the alphabets have a dominant script of their own beside Chinese, and kana go with Chinese. The scripts that don't
    dominate give further forms, in order of their votes, and so does Latin for a token of nothing but its look-alikes: which form holds is for the vocabulary to say.
    """
    votes = _votes(token)
    ranked = sorted(votes, key=lambda s: (votes[s], s == "latin"), reverse=True)
    alphabets = [s for s in ranked if s not in ("han", "kana", "other")]
    if len(votes) < 2 and (not votes or any(c not in LATIN_OF for c in token if script(c))):
        return []
    if votes.keys() - {"latin", "han", "kana"} and "latin" not in alphabets:
        alphabets.append("latin")
    kana_first = votes.get("kana", (0, 0))[1] > votes.get("han", (0, 0))[1]
    ideographs = ([{}, KANA] if kana_first else [KANA, {}]) if "han" in votes and "kana" in votes else [{}]
    out = []
    for marks in ideographs:
        for target in alphabets or [""]:
            into = INTO.get(target, {})
            form = unicodedata.normalize("NFC", "".join(marks.get(c, c) if script(c) == "kana" else c if script(c) == target else into.get(c, c) for c in token))
            if form != token and form not in out:
                out.append(form)
    return out


_FORM = T.StructType([T.StructField("folded", T.StringType()), T.StructField("doubts", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType()))])))])


@F.pandas_udf(_FORM)
def forms(s: pd.Series) -> pd.DataFrame:
    """The folded text, and its doubtful tokens with what they may stand for."""
    folded = [None if x is None else fold(x) for x in s]
    return pd.DataFrame({"folded": folded, "doubts": [[] if x is None else [{"token": t, "forms": r} for t in dict.fromkeys(x.split(" ")) if (r := repairs(t))] for x in folded]})


def unify(df: DataFrame, column: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """(value, unified, reads_as): the consistent form of every distinct non-null value of ``column``.

    Values are folded; a doubtful token is replaced by the first of its repairs that is a token of the vocabulary, else it stays. ``reads_as`` is the word of the vocabulary
    whose folded form equals the unified value (of several that fold alike the value itself, else the smallest); where no word reads the same it is null.

    Defined cases: null values give no row; a value of nothing but invisible characters folds to an empty string and reads as nothing; repeated values give one row.
    Both tables are joined on tokens and forms with hot keys salted, so neither needs to fit a task.
    """
    words = cut_lineage(vocabulary.select(F.col(word).alias("w")).filter("w is not null").distinct().select("w", forms("w").alias("f")).select("w", F.col("f.folded").alias("unified"))).filter("unified <> ''")
    by_form = words.groupBy("unified").agg(F.min("w").alias("word"))
    known = words.select(F.explode(F.split("unified", " ")).alias("form")).distinct()
    values = cut_lineage(df.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("f", forms("value")).select("value", "f.folded", "f.doubts"))
    doubtful = values.filter(F.size("doubts") > 0)
    offered = doubtful.select(F.explode("doubts").alias("d")).select("d.token", F.posexplode("d.forms").alias("at", "form")).distinct()
    accepted = offered.join(known, "form").groupBy("token").agg(F.min_by("form", "at").alias("form"))
    repaired = join_small(doubtful.select("value", F.explode(F.transform("doubts", lambda d: d["token"])).alias("token")), accepted, ["token"], ["value"])
    fixes = repaired.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("token", "form"))).alias("fix"))
    whole = values.join(fixes, "value", "left")
    unified = F.array_join(F.transform(F.split("folded", " "), lambda t: F.coalesce(F.try_element_at("fix", t), t)), " ")
    joined = join_small(whole.select("value", F.when(F.col("fix").isNull(), F.col("folded")).otherwise(unified).alias("unified")), by_form, ["unified"], ["value"], "left")
    own = words.select(F.col("w").alias("value"), F.lit(True).alias("own"))
    return joined.join(own, "value", "left").select("value", "unified", F.when(F.col("own"), F.col("value")).otherwise(F.col("word")).alias("reads_as"))
