"""Broken question-answer pairs: answer clauses tagged by a conditional random field, clause coverage aggregated to a defect."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.partitions import spread
from quarryline.llm.crf import LinearChain

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Rows of the table from which complete answers are taken for training (the bound of the sample), and the seed.
SAMPLE_ROWS, SEED = 3_000, 7

# Cues and words of languages.
PLACEHOLDER = re.compile(r"^[\W_]*(?:n/?a|null|none|nan|nil|tbd|todo|undefined|empty|待补充|待定|暂无|暂缺|无|略|占位|placeholder)[\W_]*$", re.I)
_ZH_ACT = "(?:回答|作答|答复|解答|回应|提供|给出|透露|披露|讨论|谈论|谈|评论|评价|判断|建议|推荐|协助|帮|满足|处理|受理|说|讲|展开|从命|奉告|表态|发表|查询)"
_EN_ACT = r"(?:answer|help|assist|provide|share|discuss|comment|talk|speak|say|respond|recommend|advise|judge|tell|disclose|reveal|offer|give|do (?:so|that|this)|go into|that|this|it)"
#: Cues of declining, by kind: a refused act, an apology, the speaker's role or rules (Chinese; English); the first person; declining in other languages. Any of them may stand in a true answer.
CUES = tuple(
    re.compile(p, re.I)
    for p in (
        rf"(?:无法|没法|没办法|不能|不可以|不便|不宜|不会|不想|不愿|不打算|不方便|不适合|暂不|难以?|恕|恕不|拒绝|谢绝|婉拒|选择不|没有?(?:权限|资格|办法|能力|立场)|无权|不予|不作|不做)[^，。；！？\d]{{0,10}}?{_ZH_ACT}|爱莫能助|无可奉告|沉默|(?:略去|略过|跳过|回避|避开)|不[^，。\d]{{0,2}}说了|帮不上|不(?:在|属于)[^，。]{{0,16}}(?:范围|职责|范畴)|超出[^，。\d]{{0,14}}(?:范围|能力|权限|职责)",
        r"抱歉|对不起|遗憾|不好意思|(?:见|体|原)谅|谅解",
        r"语言模型|人工智能|机器人|程序|助手|合规|敏感|违反|政策|规则|规定|准则|持牌|专业人士|禁止|不允许|换(?:个|一个|一下)?[^，。]{0,2}(?:话题|问题)|只(?:是|能|处理|回答|负责|受理)|范围|请咨询",
        r"\b(?:sorry|apologi[sz]e|unfortunately|regret|afraid)\b",
        rf"\b(?:can(?:no|')t|can not|couldn't|could not|unable to|not able to|not allowed|not permitted|won't|will not|wouldn't|would not|do not|don't|mustn't|must not|decline|refuse|rather not|prefer not|not going to|refrain|withhold|must (?:leave|skip|pass|decline)|have to (?:leave|skip|pass|decline))\b.{{0,40}}?\b{_EN_ACT}\b|no comment|off.limits|not (?:be )?appropriate|inappropriate|not in a position|\b(?:outside|beyond) (?:my|our|the)\b|\bpass on (?:it|this|that)",
        r"\b(?:language model|as an ai|assistant|this request|this question|policy|guidelines|advis[eo]r|remit|scope|rules|permit(?:ted)?|another (?:topic|question)|something else)\b",
        r"我(?!们|国|司)|\b(?:I|I'm|I'd|I'll|me|my)\b",
        r"désolé|regrette|ne (?:peux|puis|suis|pouvons) pas|leider|(?:kann|darf|möchte)\b.{0,40}\b(?:nicht|keine)|tut mir leid|lo siento|lamento|no (?:puedo|podemos|es posible)|申し訳|できません|できかね|控え(?:させ|ます)|お答え|죄송|수 없|어렵습니다|не могу|не можем|извините|к сожалению|non posso|mi dispiace|não posso|desculpe",
    )
)
POLITE = re.compile(r"感谢|祝您|建议您|欢迎|如有(?:其他|任何)|谢谢|请咨询|您可以换|请换|thank|please (?:consult|feel|let)|let me know|feel free|good luck", re.I)
ASKED = re.compile(r"^(?:好[的，]?|您?[的你]?(?:问|提问|问题|想(?:问|知道))|回答|关于|答|you (?:asked|want)|(?:the|your) question|question|answer|regarding|about)", re.I)
WANTED = ((re.compile(r"用英[文语]|英[文语](?:回答|作答)|in english", re.I), "en"), (re.compile(r"用[中汉][文语]|[中汉][文语](?:回答|作答)|in chinese", re.I), "zh"), (re.compile(r"用日[文语]|in japanese", re.I), "ja"), (re.compile(r"用法[文语]|in french", re.I), "fr"), (re.compile(r"用德[文语]|in german", re.I), "de"), (re.compile(r"用韩[文语]|in korean", re.I), "ko"))
EN = set("the of and to in is that for with a at by was were it as on which will would has have its than since from this there be but we our are not or an up about last i you can't sorry can".split())
#: Frequent short words of European languages other than English (French, Spanish, German, Italian, Portuguese, Dutch, Polish, Czech, Swedish, Danish, Turkish, Romanian, Indonesian, Vietnamese).
OTHER_WORDS = set(
    "le la les de des du et un une est que pour dans sur avec plus par pas qui sont el los las del por con se y al su es más como der die das und ist von zu mit den im auf ein eine für sich nicht auch wird werden bei il di che non per della sono più o os da do em uma na com não para het een van dat niet zijn voor met "
    "w z na się nie jest do że oraz przez od po je se že na pro som och att av är det ikke til bir ve bu için olarak și din care pentru yang dan untuk dengan của và là cho".split()
)
TERMINAL = re.compile(r"[。！？!?…]$|[.!?。！？…][”\"'」』）)\]]+$|[）)」』”]$")
DOT = re.compile(r"\.$")
UNIT = re.compile(r"(?:[\d.](?:亿元|万元|元|%|％|倍|家|人|个月|个百分点|天|次|吨|条|年|月|日| ?bn| ?million| ?times)|\|)$")
DANGLING = re.compile(r"(?:\b(?:the|of|to|a|an|in|is|was|by|and|or|for|with|that|than|from|at|as|on|which|its|about|up|are|were|be|would|will|has|have|because|since|our|but|not)|[的与及和同为在是对由从至到把被将较但而且或，、：:；;“‘（(《\[,])$", re.I)
ITEM = re.compile(r"^\s*(?:\d{1,2}[.、)）]|[-*•·]|[（(]\d{1,2}[)）])\s*")
SPLIT = re.compile(r"(?<=[。！？!?\n])|(?<=[a-zà-ÿ)\d]\.)(?=\s+[A-ZÀ-Ý])|(?<=[a-z]{2}\.)(?=[一-鿿])")


_HAN, _KANA, _HANGUL, _REST, _JAMO, _WORDS = re.compile("[一-鿿]"), re.compile("[ぁ-ヺ]"), re.compile("[가-힣]"), re.compile("[Ͱ-᳿؀-ۿ]"), re.compile("[ᄀ-ᇿ]"), re.compile(r"[A-Za-zÀ-ÿĀ-ž][A-Za-zÀ-ÿĀ-ž']*")


@lru_cache(100_000)
def language(text: str) -> str:
    """zh, ja, ko, en, other (Latin letters of another language, or another script) or none."""
    han = kana = hangul = rest = 0
    if not text.isascii():
        han, kana, hangul, rest = len(_HAN.findall(text)), len(_KANA.findall(text)), len(_HANGUL.findall(text)), len(_REST.findall(text))
        rest -= len(_JAMO.findall(text)) if rest else 0
    words = [w.lower() for w in _WORDS.findall(text)]
    latin = sum(map(len, words))
    if not han + kana + hangul + rest + latin:
        return "none"
    if hangul > max(2, han / 2, latin / 3):
        return "ko"
    if kana * 6 > han + kana and kana > 2:
        return "ja"
    if rest > max(han, latin):
        return "other"
    if latin > 3.5 * han:
        en, other = sum(w in EN for w in words), sum(w in OTHER_WORDS and w not in EN for w in words) + sum(not w.isascii() for w in words)
        return "other" if other > en else "en"
    return "zh"


_LATIN = re.compile("[A-Za-z]")
_LONG, _ASKING = re.compile(r"[A-Za-z]{2,}"), re.compile(r"\b(?:the|of|is|what|how|with|please|compare|on|in|and)\b", re.I)


@lru_cache(20_000)
def expected_language(question: str) -> str:
    """The language that the question asks for, else its own (names in another script aside)."""
    for pattern, lang in WANTED:
        if pattern.search(question):
            return lang
    own = language(question)
    return "en" if own == "zh" and len(_LONG.findall(question)) >= 4 and len(_ASKING.findall(question)) >= 2 else own


def clauses(answer: str) -> list[str]:
    """Sentences, lines and list entries that hold a letter or digit."""
    return [c.strip() for c in SPLIT.split(answer) if any(map(str.isalnum, c))]


_NO_WORD = re.compile(r"[\W_]+")


def _bigrams(text: str) -> set[str]:
    t = _NO_WORD.sub("", text.lower())
    return {a + b for a, b in zip(t, t[1:])}


def _cues(c: str) -> list[float]:
    """Which cues a clause holds; Chinese ones are looked for only in Chinese, and so on."""
    plain, han = c.isascii(), _HAN.search(c) is not None
    latin = _LATIN.search(c) is not None
    worth = (han, han, han, latin, latin, latin, han or latin, latin or not plain)
    return [float(w and p.search(c) is not None) for w, p in zip(worth, CUES)]


def _ending(c: str) -> str:
    """Class of a clause's last characters."""
    if UNIT.search(c):
        return "unit"
    if TERMINAL.search(c):
        return "terminal"
    if DOT.search(c):
        return "dot"
    return "dangling" if DANGLING.search(c) else "word"


_NUMBER_DOT, _DIGIT_DOT, _DIGIT_END, _DIGIT = re.compile(r"(\S+)\s+(\d+)\.$"), re.compile(r"\d\.$"), re.compile(r"[\d,]$"), re.compile(r"\d")
#: Features of how an answer ends, all 0 for clauses before the last.
ENDINGS = 15


def _end_features(parts: list[str], lang: str) -> list[float]:
    """How the last clause ends: finished or not, by its last characters, an open bracket, and the list entries before it."""
    c, end = parts[-1], _ending(parts[-1])
    before, dotted = _NUMBER_DOT.search(c), _DIGIT_DOT.search(c) is not None
    zh_dot = dotted and lang in ("zh", "none")
    year = before is not None and len(before[2]) == 4 and before[2][:2] == "20" and before[1].lower() in ("beyond", "in", "for", "of", "by", "until", "since")
    month = before is not None and before[1].lower() in ("month", "months", "quarter", "step")
    item = ITEM.match(c) is not None
    prior = next((x for x in parts[:-1] if ITEM.match(x)), None)
    like = 0.5
    if item and prior:
        like = float(_ending(prior) == end and (end != "word") or abs(len(c) - len(prior)) <= 1 and c[-1:] == prior[-1:])
    finished = end in ("terminal", "unit") or end == "dot" and not zh_dot and (not dotted or year or month)
    unclosed = sum(map(c.count, "（(“《「[")) > sum(map(c.count, "）)”》」]"))
    return [
        1.0, float(finished), float(not finished), float(end == "dangling"), float(end == "word"), float(zh_dot), float(unclosed), float(_DIGIT_END.search(c) is not None), float(item and len(ITEM.sub("", c)) < 2), float(item and prior is not None and like == 0.0), float(item and like == 1.0),
        float(c.endswith("|")), float(end == "dot" and dotted and not (year or month)), float(end == "word" and prior is not None), float(end == "unit"),
    ]


def features(question: str, parts: list[str]) -> np.ndarray:
    """One row a clause: language, cues, overlap with the question, and how the answer ends."""
    wanted, asked, out = expected_language(question), _bigrams(question), []
    for c in parts:
        lang, own, cues = language(c), _bigrams(c), _cues(c)
        shared, n, digit = len(own & asked), sum(cues), _DIGIT.search(c) is not None
        out.append(
            [
                1.0, lang == wanted, lang == "none", lang not in (wanted, "none"), lang in ("ja", "ko", "other"), wanted == "zh", *cues, n, n > 0 and not digit, n > 1, cues[-1] > 0 and not digit, n > cues[-1] > 0 and not digit, POLITE.search(c) is not None, ASKED.search(c) is not None,
                shared / max(1, len(own)), shared > 0.75 * len(own), shared > 0.9 * len(own), shared / max(1, len(asked)), digit, min(len(c), 200) / 100, len(parts) == 1, digit and not n,
            ]
        )
    rows = np.zeros((len(parts), len(out[0]) + ENDINGS))
    rows[:, : len(out[0])] = out
    rows[-1, len(out[0]) :] = _end_features(parts, language(parts[-1]))
    return rows


# ---- training sequences: refusals, foreign answers and introductions put together from parts
_ZH_REFUSAL = (
    ("{sorry}{why}{who}{neg}{act}{what}{end}", "{what}超出了{who}的能力范围{end}", "{sorry}{what}不属于可以{act}的范围{end}", "关于{what}，{who}选择不{act}{end}", "{why}{what}就先略过{end}", "对于{what}，恕{neg}{act}{end}", "{sorry}这一点{who}帮不上忙{end}", "{what}还是请专业人士来{act}{end}"),
    {
        "sorry": ("", "", "抱歉，", "对不起，", "很遗憾，", "不好意思，"), "why": ("", "", "根据使用规则，", "出于安全考虑，", "因为涉及敏感内容，", "按照政策，", "作为人工智能助手，"), "who": ("我", "我", "本助手", "我这边", "这里"),
        "neg": ("无法", "不能", "没办法", "不便", "难以", "不会", "不打算", "没有资格", "暂时不能", "拒绝"), "act": ("回答", "提供", "讨论", "评论", "谈论", "给出", "判断", "解答"),
        "what": ("这个问题", "相关内容", "这类信息", "{m}", "关于{m}的看法", "此类请求", "这方面的数据", "您的要求"), "end": ("。", "。", "，请谅解。", "，请换一个问题。", "，还请咨询专业人士。", "，望您体谅。", "！"),
    },
)
_EN_REFUSAL = (
    ("{sorry}I {neg} {act} {what}{end}", "{what} is outside my scope{end}", "{sorry}as an assistant I {neg} {act} {what}{end}", "Under my rules I {neg} {act} {what}{end}", "No comment on {what}{end}", "I would rather not {act} {what}{end}", "It is not appropriate for me to {act} {what}{end}", "I have to decline to {act} {what}{end}"),
    {
        "sorry": ("", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "I regret that "), "neg": ("cannot", "can't", "am unable to", "am not able to", "won't", "must decline to", "am not permitted to", "do not wish to"),
        "act": ("answer", "discuss", "comment on", "help with", "talk about", "give a view on", "share"), "what": ("this question", "that", "this topic", "{m}", "this request", "such matters", "the company"), "end": (".", ".", "; please ask a professional.", ", so try another topic.", "."),
    },
)
_OTHER_REFUSALS = (
    "Je regrette, mais je ne suis pas en mesure d'en parler.", "Dazu darf ich keine Auskunft geben.", "Tut mir leid, darüber kann ich nicht sprechen.", "Lamento no poder ayudar con este tema.", "その件についてはお話しできません。", "恐れ入りますが、回答は控えさせていただきます。", "해당 내용은 말씀드리기 어렵습니다.", "Извините, я не могу это обсуждать.",
)
_POLITE = ("谢谢您的理解。", "欢迎提出别的问题。", "您可以查阅公开资料。", "Thanks for understanding.", "Please feel free to ask something else.", "", "")
_FOREIGN = (
    "Les ventes ont progressé de {} % pendant le trimestre.", "Nous prévoyons une hausse de {} % pour la suite.", "Die Erlöse stiegen um {} Prozent gegenüber dem Vorquartal.", "Wir rechnen mit einer besseren Lage im Frühling.", "Las ventas subieron un {} % durante el trimestre.", "Se espera que los costes bajen en primavera.",
    "売上は前年より{}%増えました。", "来期は改善すると考えています。", "판매는 지난해보다 {}% 늘었습니다.", "다음 분기에는 좋아질 것으로 보입니다.", "Продажи выросли на {} % за квартал.", "Мы ожидаем, что затраты снизятся весной.", "Le vendite sono aumentate del {} % nel trimestre.", "As vendas cresceram {} % no período e a empresa não espera mudanças.", "Sprzedaż wzrosła o {} % w tym kwartale, a koszty nie zmieniły się.",
)
#: True answers that hold words of declining.
_HEDGED = (
    "公告没有写明这个数字，因此不能直接引用，但按{m}折算约为{n}%。", "抱歉回复晚了，{m}为{n}%。", "遗憾的是{m}只有{n}亿元，低于目标。", "口径有变，难以与去年比较，不过{m}约{n}亿元。", "董事会拒绝了对方{n}亿元的报价。", "新规定使{m}减少{n}%。", "管理层不愿透露细节，只说{m}约为{n}%。",
    "Sorry about the delay: {m} was {n} bn.", "The report does not give it and I could not find it directly, but it works out at about {n}%.", "Unfortunately {m} fell by {n}%.", "The board refused an offer of {n} bn.",
)
_INTROS = ("您想知道：{}", "提问：{}\n答：", "好，关于“{}”，", "您的问题是“{}”", "你问的是：{}", "You want to know: {} ", "Question: {}\nAnswer: ", "The question was: {} ", "{}")


def _composed(r: random.Random, grammar: tuple, m: str) -> str:
    forms, parts = grammar
    text = r.choice(forms).format(**{k: r.choice(v) for k, v in parts.items()}).format(m=m)
    return text[:1].upper() + text[1:]


def _reworded(r: random.Random, q: str) -> str:
    x = q.rstrip("？?。. ")
    if r.random() < 0.4:
        x = x.replace("的", "", 1)
    if r.random() < 0.2 and len(x) > 8:
        k = r.randrange(1, len(x) - 1)
        x = x[:k] + x[k + 1 :]
    return x + r.choice(["？", "。", "", "?", q[-1:]])


def training_sequences(pairs: list[tuple[str, str]], seed: int = SEED) -> Iterator[tuple[str, str, list[int]]]:
    """(question, answer, labels of its clauses): complete answers of the sample, and answers broken on purpose in every way."""
    r = random.Random(seed)
    good = [(q, a) for q, a in pairs if language(a) == expected_language(q) and _ending(a.strip()) in ("terminal", "unit", "dot") and not any(p.search(a) for p in CUES[:-1]) and not ASKED.search(a) and len(a) > 15 and not (language(a) == "zh" and re.search(r"\d\.$", a.strip()))]
    good = [(q, a) for q, a in good if len(_bigrams(a) - _bigrams(q)) > 8]
    if not good:
        good = [("公司2024年的毛利率是多少？", "公司毛利率约为35.2%，较年初有所变化。"), ("What was the revenue in 2024?", "Revenue came to 54.6 bn in 2024. Orders are expected to recover.")]

    def number() -> str:
        return f"{r.uniform(0.1, 400):.{r.choice((1, 2))}f}"

    for q, a in good:
        metric = r.choice(["毛利率", "营业收入", "净利润"]) if language(q) == "zh" else r.choice(["revenue", "the margin"])
        kind = r.random()
        if kind < 0.35:
            intro = r.choice(_INTROS[:-1]).format(q) if r.random() < 0.25 else ""
            hedge = r.choice([h for h in _HEDGED if language(h) == language(a)] or _HEDGED[:1]).format(m=metric, n=number()) if r.random() < 0.3 else ""
            extra = r.choice([f"1. {metric}：{number()}亿元，环比增长{number()}%\n2. {metric}：{number()}亿元，同比下降{number()}%", f"约{number()}亿元", f"\n| 年份 | {metric} |\n|---|---|\n| 2024 | {number()} |"]) if r.random() < 0.3 and language(a) == "zh" else ""
            text = intro + hedge + a + extra if intro or hedge or r.random() < 0.7 or not extra else extra
            yield q, text, [ECHO if k < len(clauses(intro)) else ANSWER for k in range(len(clauses(text)))]
        elif kind < 0.5:
            named = r.choice([metric, "公司" if language(q) == "zh" else "the company"])
            way = r.random()
            text = (_composed(r, _ZH_REFUSAL, named) if way < 0.5 else _composed(r, _EN_REFUSAL, named) if way < 0.85 else r.choice(_OTHER_REFUSALS)) + r.choice(_POLITE)
            yield q, text, [REFUSAL] * len(clauses(text))
        elif kind < 0.61:
            text = r.choice(_INTROS).format(_reworded(r, q)) + (_reworded(r, q) if r.random() < 0.4 else "")
            yield q, text, [ECHO] * len(clauses(text))
        elif kind < 0.72:
            if r.random() < 0.5:
                text = " ".join(r.choice(_FOREIGN).format(number(), number()) for _ in range(r.randint(1, 3)))
            else:
                other = [b for p, b in r.sample(good, min(len(good), 40)) if language(b) != expected_language(q)]
                text = r.choice(other) if other else r.choice(_FOREIGN).format(number(), number())
            yield q, text, [FOREIGN] * len(clauses(text))
        else:
            if r.random() < 0.3 and language(a) == "zh":
                a = "\n".join(f"{i + 1}. {metric}：{number()}亿元，{r.choice(['同比增长', '环比回落', '较年初提升'])}{number()}%" for i in range(r.randint(2, 4)))
                cut = len(a) - r.randint(1, 18)
                if re.search(r"\d\.\d$", a[:cut]) and a[cut : cut + 1] == "%" or a[:cut].endswith(("\n",)):
                    cut -= 1
                text = a[:cut]
            else:
                last = max(a[:-2].rfind(x) for x in ("。", ". ", "\n")) + 1
                text = a[: r.randint(min(last + 3, len(a) - 2), len(a) - 1 if len(a) - 1 > last + 3 else len(a) - 1)]
                text = text.rstrip() if r.random() < 0.5 else text
                if _ending(text.strip()) in ("terminal", "unit"):
                    text = text.strip() + r.choice(["，其中", "，", "（", "。其中，" if language(a) == "zh" else ", of which"])
            if r.random() < 0.1:
                text = text + r.choice(["\n3.", "，主要原因是", "：\n1."]) if language(a) == "zh" else text + " because of"
            labels = [ANSWER] * len(clauses(text))
            if labels:
                labels[-1] = UNFINISHED
                yield q, text, labels


def train(pairs: list[tuple[str, str]], seed: int = SEED) -> LinearChain:
    """The tagger, fitted on the sequences made from a bounded sample of pairs."""
    xs, ys = [], []
    for q, a, labels in training_sequences(pairs, seed):
        parts = clauses(a)
        if parts and len(parts) <= 12:
            xs.append(features(q, parts))
            ys.append(np.array(labels))
    return LinearChain(len(LABELS)).fit(xs, ys)


def defect(question: str, answer: str | None, model: LinearChain, may_refuse: bool) -> str | None:
    """The pair's defect, from the coverage of its clauses' tags."""
    answer = "".join(c for c in answer or "" if c not in "​‌‍⁠﻿")
    parts = clauses(answer)
    if not parts or PLACEHOLDER.match(answer.strip()):
        return "empty"
    tags = model.decode(features(question, parts))
    cover = np.bincount(tags, [len(c) for c in parts], len(LABELS))
    if cover[REFUSAL] and not cover[ANSWER] and not cover[FOREIGN] and not cover[UNFINISHED]:
        return None if may_refuse else "refusal"
    if cover[ECHO] == cover.sum():
        return "echo"
    if cover[FOREIGN] * 2 > cover.sum():
        return "other_language"
    if tags[-1] == UNFINISHED:
        return "truncated"
    return None


class Kinds:
    """Naive Bayes over pairs of characters: whether a question is one to decline, learned from questions with a type."""

    WIDTH = 1 << 14

    def __init__(self, questions: list[str], rejected: list[bool]):
        counts = np.full((2, self.WIDTH), 0.5)
        classes = np.ones(2)
        for q, y in zip(questions, rejected):
            counts[int(y), self._at(q)] += 1
            classes[int(y)] += 1
        self.weights = np.log(counts[1] / (classes[1] + 1)) - np.log(counts[0] / (classes[0] + 1))
        self.prior = math.log(classes[1] / classes[0]) if any(rejected) else -math.inf

    def _at(self, question: str) -> list[int]:
        return sorted({zlib.crc32(b.encode("utf-8", "surrogatepass")) % self.WIDTH for b in _bigrams(question)})

    def rejects(self, question: str) -> bool:
        """The evidence of the pairs is divided by the root of their number, as they depend on one another."""
        at = self._at(question)
        return bool(at) and self.prior + self.weights[at].sum() / math.sqrt(len(at)) > 0


def _pairs(samples: DataFrame) -> DataFrame:
    """(k, type, q, a, answered): id, type, question, and the last message if it answers."""
    last = F.try_element_at("messages", F.lit(-1))
    user = F.filter("messages", lambda m: m["role"] == "user")
    rows = samples.filter("sample_id is not null and messages is not null and size(messages) > 0")
    answered = (last["role"] == "assistant") & (F.coalesce(F.size(last["tool_calls"]), F.lit(0)) <= 0)
    return rows.select(F.col("sample_id").alias("k"), F.col("question_type").alias("type"), F.try_element_at(user, F.lit(1))["content"].alias("q"), F.when(F.coalesce(answered, F.lit(False)), last["content"]).alias("a"))


def broken_pairs(samples: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(sample_id, defect) of every pair that is broken.

    The tagger is trained on ``sample_rows`` rows (those with the least hash of their id; the bound of the sample) and on answers broken on purpose; all rows are then tagged whole.
    A refusal is right where the question's type is ``reject``; where the type is null, if a classifier of the questions, learned from the types of the same sample, says so.

    Defined cases: null ids and null or empty message lists give no row; without a user message the question is empty; a null, blank or missing answer is empty.
    Repeated rows give one result. Further columns are ignored; an empty table gives no rows.
    """
    rows = spread(_pairs(samples), "k").distinct()
    drawn = rows.filter("q is not null").orderBy(F.xxhash64("k"), "k").limit(sample_rows).select("q", "a", "type").collect()
    typed = [r for r in drawn if r["type"] is not None]
    models = rows.sparkSession.sparkContext.broadcast((train([(r["q"], r["a"]) for r in drawn if r["a"] and len(r["a"]) > 15]), Kinds([r["q"] for r in typed], [r["type"] == "reject" for r in typed])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger, kinds = models.value
        for b in batches:
            out = []
            for k, q, a, t in zip(b["k"], b["q"], b["a"], b["type"]):
                x = defect(q or "", a, tagger, t == "reject")
                if x and not (x == "refusal" and t is None and kinds.rejects(q or "")):
                    out.append((k, x))
            yield pd.DataFrame(out, columns=["sample_id", "defect"])

    return rows.mapInPandas(run, f"sample_id {samples.schema['sample_id'].dataType.simpleString()}, defect string")
