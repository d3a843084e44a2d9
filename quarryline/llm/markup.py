"""Markup residue in texts: candidate nodes of several languages, boosted trees over their features, hierarchical decoding, clean text."""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.boosting import BoostedTrees

TAGS = set(
    "a abbr article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video".split()
)
COMMANDS = set(
    "begin end item textbf textit emph text section subsection subsubsection paragraph frac sum int prod sqrt Delta delta alpha beta gamma sigma mu lambda theta pi times cdot leq geq le ge neq approx infty partial hline toprule midrule bottomrule multicolumn multirow caption label ref cite footnote mathrm mathbf left right quad qquad centering includegraphics title author date maketitle underline texttt href url noindent newline ldots dots cdots".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tag may be left out, and the start tags that end them.
IMPLIED = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements whose content is no text.
HIDDEN = ("script", "style")
#: Constructs found by patterns: markup, name, what a text must hold for it, pattern, number of marker characters at the start, whether its content is opaque.
_CONSTRUCTS: tuple[tuple[str, str, str, str, int, bool], ...] = (
    ("html", "element", "<", r"(?!)", 1, False),
    ("html", "comment", "<!--", r"<!--.*?-->", 4, True),
    ("html", "entity", "&", r"&(?:amp;)*(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,10});", 1, False),
    ("html", "code", "<", r"<(?P<c>pre|code|script|style|PRE|CODE|SCRIPT|STYLE)\b[^<>]*>.*?</(?P=c)>", 1, True),
    ("markdown", "heading", "#", r"(?m:^ {0,3}#{1,6}[^\n]*$)", 1, False),
    ("markdown", "setext", "\n", r"(?m:^[^\n]*[^\n\s=-][^\n]*\n(?:={3,}|-{3,})[ \t]*$)", 0, False),
    ("markdown", "fence", "```", r"```.*?```", 3, True),
    ("markdown", "code", "`", r"(?<!`)`[^`\n]+`(?!`)", 1, True),
    ("markdown", "strong", "", r"\*\*[^*\n]+\*\*|(?<!_)__[^_\n]+__(?!_)", 2, False),
    ("markdown", "em", "", r"(?<!\*)\*[^*\n]+\*(?!\*)|(?<!_)_[^_\n]+_(?!_)", 1, False),
    ("markdown", "strike", "~", r"~~?[^~\n]+~~?", 1, False),
    ("markdown", "link", "](", r"!?\[[^\[\]\n]*\]\([^()\n]*\)", 1, False),
    ("markdown", "reference", "]", r"(?m:^ {0,3}\[[^\]\n]+\]:[ \t]*\S+[^\n]*$)|!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]", 1, False),
    ("markdown", "quote", ">", r"(?m:^ {0,3}>[^\n]*$)", 1, False),
    ("markdown", "task", "] ", r"(?m:^[ \t]*[-*+] \[[ xX]\] )", 1, False),
    ("markdown", "table", "|", r"(?m:^[^\n|]*\|[^\n]*\n[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*(?::?-+:?)?[ \t]*\|?[ \t]*$(?:\n[^\n]*\|[^\n]*$)*)", 1, False),
    ("wiki", "link", "[[", r"\[\[[^\[\]\n]*\]\]", 2, False),
    ("wiki", "template", "{{", r"(?!)", 2, False),
    ("wiki", "heading", "==", r"={2,6}[^=\n]+={2,6}", 2, False),
    ("wiki", "quotes", "''", r"'{2,5}[^'\n]+'{2,5}", 2, False),
    ("wiki", "table", "{|", r"\{\|.*?\|\}", 2, False),
    ("wiki", "definition", ";", r"(?m:^;[^\n]*$(?:\n:[^\n]*$)+)", 1, False),
    ("latex", "display", "", r"\$\$.+?\$\$|\\\[.+?\\\]", 2, True),
    ("latex", "math", "", r"(?<![\\$])\$[^$\n]+\$(?!\$)|\\\(.+?\\\)", 1, True),
    ("latex", "environment", "\\begin", r"\\begin\{(?P<e>[A-Za-z]+\*?)\}.*?\\end\{(?P=e)\}", 1, False),
    ("latex", "command", "\\", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}]*\})*", 1, False),
    ("latex", "escape", "\\", r"\\[%&_#$]", 1, False),
    ("latex", "script", "{", r"[_^]\{[^{}\n]*\}", 1, False),
)
CONSTRUCTS = tuple((kind, name, re.compile(p, re.S), skip, opaque, need) for kind, name, need, p, skip, opaque in _CONSTRUCTS)
INDEX = {(c[0], c[1]): i for i, c in enumerate(CONSTRUCTS)}
ELEMENT, TEMPLATE, CODE = INDEX["html", "element"], INDEX["wiki", "template"], INDEX["html", "code"]
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)/?>")
BRACES = re.compile(r"\{\{|\}\}")
#: A text without any of these characters holds no candidate (for the JVM).
SPECIAL = r"[<>&*#`~\[{|$\\_^=]|''|(?m)^[ \t]*[-+;:]"
KINDS = ("html", "markdown", "wiki", "latex")


@dataclass
class Node:
    """A candidate: its construct, where it stands, and how likely it is markup.

    An HTML element is one node from its start tag to its end tag (``head`` and ``tail`` are the lengths of these; no tail if it isn't closed), in the tree of elements: ``parent`` (its place in the
    list of elements, -1 at the root), ``depth``, ``twins`` (siblings of its name), ``ordinal`` (its number among them) and ``below`` (elements in its subtree).
    """

    construct: int
    start: int
    end: int
    probability: float = 0.0
    name: str = ""
    head: int = 0
    tail: int = 0
    parent: int = -1
    depth: int = 0
    twins: int = 0
    ordinal: int = 0
    below: int = 0

    @property
    def kind(self) -> str:
        return CONSTRUCTS[self.construct][0]

    @property
    def form(self) -> str:
        return CONSTRUCTS[self.construct][1]


def elements(text: str) -> list[Node]:
    """The tree of HTML elements: tags paired with a stack, in one pass. An end tag closes the nearest open element of its name; what is open inside stays unclosed, or ends there if HTML implies its end."""
    out: list[Node] = []
    stack: list[int] = []
    for m in TAG.finditer(text):
        name, size = m[2].lower(), m.end() - m.start()
        if m[1]:
            at = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 65), -1) if out[stack[k]].name == name), None)
            if at is None:
                out.append(Node(ELEMENT, m.start(), m.end(), name=name, head=0, tail=size, parent=stack[-1] if stack else -1, depth=len(stack)))
            else:
                out[stack[at]].end, out[stack[at]].tail = m.end(), size
                del stack[at:]
            continue
        if name in IMPLIED and stack and out[stack[-1]].name in IMPLIED and name in IMPLIED[out[stack[-1]].name]:
            stack.pop()
        out.append(Node(ELEMENT, m.start(), m.end(), name=name, head=size, parent=stack[-1] if stack else -1, depth=len(stack)))
        if name not in VOID and not m[0].endswith("/>"):
            stack.append(len(out) - 1)
    seen: dict[tuple[int, str], int] = {}
    for n in out:
        n.ordinal = seen[n.parent, n.name] = seen.get((n.parent, n.name), 0) + 1
    for n in reversed(out):
        n.twins = seen[n.parent, n.name]
        if n.parent >= 0:
            out[n.parent].below += n.below + 1
    return out


def templates(text: str) -> list[Node]:
    """Balanced double braces, nested ones too."""
    out, stack = [], []
    for m in BRACES.finditer(text):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            out.append(Node(TEMPLATE, stack.pop(), m.end()))
    return out


def candidates(text: str) -> list[Node]:
    """All candidate nodes, outer before inner."""
    out = elements(text) if "<" in text else []
    if "{{" in text:
        out += templates(text)
    out += [Node(i, m.start(), m.end()) for i, (_, _, p, _, _, need) in enumerate(CONSTRUCTS) if need in text and i not in (ELEMENT, TEMPLATE) for m in p.finditer(text)]
    return sorted(out, key=lambda n: (n.start, -n.end, n.construct))


def _wordy(c: str) -> int:
    return 0 if not c or not c.isalnum() else 1 if c.isascii() else 2


#: Features besides the one for the construct.
WIDTH = 30
DIGITS, HAN, SIGNS, LEAD, NAME, ATTRIBUTES = re.compile(r"\d"), re.compile("[一-鿿]"), re.compile(r"[\\^_={}]"), re.compile(r"\W*"), re.compile(r"[</\\]*([A-Za-z]+[1-6]?)"), re.compile(r"([\w-]+)=")


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row a node: its construct, surroundings and inner text; for elements their name, attribute tokens, depth, siblings and subtree density in the tree of elements, for others depth in the tree of candidates."""
    rows = np.zeros((len(nodes), WIDTH + len(CONSTRUCTS)))
    ends: list[int] = []
    of_kind = np.bincount([n.construct for n in nodes], minlength=len(CONSTRUCTS)) if nodes else []
    breaks = [-1, *(m.start() for m in re.finditer("\n", text))]
    first = [next((i for i in range(a + 1, min(a + 200, len(text))) if not text[i].isspace()), len(text)) for a in breaks]
    starts = np.array([n.start for n in nodes])
    spans = np.searchsorted(starts, np.array([n.end for n in nodes])) - np.searchsorted(starts, starts, side="right") if nodes else []
    for i, n in enumerate(nodes):
        while ends and ends[-1] < n.end:
            ends.pop()
        element = n.construct == ELEMENT
        raw = text[n.start : n.start + (n.head or n.tail)] if element else text[n.start : n.end]
        inner = raw[CONSTRUCTS[n.construct][3] :]
        word = NAME.match(raw)
        name = word[1] if word else ""
        marker = LEAD.match(raw)[0]
        body = raw.strip(marker[:1]) if marker else raw
        after = inner.lstrip("#*_=~>|")
        attributes = ATTRIBUTES.findall(inner) if element or n.construct == CODE else ()
        rows[i, :WIDTH] = (
            len(raw), len(DIGITS.findall(inner)) / max(1, len(inner)), HAN.search(inner) is not None, len(SIGNS.findall(inner)), body[:1].isspace(), body[-1:].isspace(),
            _wordy(text[n.start - 1 : n.start]), _wordy(text[n.end : n.end + 1]), n.start <= first[bisect_right(breaks, n.start - 1) - 1], text[n.end : n.end + 1] in ("", "\n"), raw.count("\n"), len(marker),
            _wordy(after[:1]), after[:1] == " ", inner.lstrip("#*_=~>").lstrip()[:1].isdigit(), name.lower() in TAGS, name in COMMANDS, "{" in raw,
            len(attributes), n.depth if element else len(ends), n.twins if element else of_kind[n.construct], n.below / (n.end - n.start) if element else spans[i] / len(raw), text[n.start - 1 : n.start] in ("\\", "$") or text[n.end - 1 : n.end] == " ",
            bool(n.head and n.tail), element and n.name in VOID, sum(a.lower() in KNOWN_ATTRIBUTES for a in attributes), element and not n.head, n.below, element and any(c in "；，。、" for c in inner), (n.head + n.tail) / (n.end - n.start) if element else 0.0,
        )
        rows[i, WIDTH + n.construct] = 1
        ends.append(n.end)
    return rows


KNOWN_ATTRIBUTES = set("align alt border cellpadding cellspacing class color colspan content data-id dir face height href id lang name nowrap rel rowspan size src style target title type valign width".split())


def decode(nodes: list[Node], least: float = 0.5) -> list[Node]:
    """The nodes taken as markup, decided from the root down in one pass: an element takes both its tags or none, an element within one that is taken (or refused) is likelier (or less likely) to be markup itself,
    nothing within code, a comment or a formula is, and of two nodes that cross the likelier is kept. ``nodes`` are in order, outer before inner."""
    taken: list[Node] = []
    stack: list[Node] = []
    dropped: set[int] = set()
    bar = math.log(least / (1 - least))
    refused_until = -1
    for n in nodes:
        while stack and stack[-1].end <= n.start:
            stack.pop()
        score = math.log(max(n.probability, 1e-9) / max(1 - n.probability, 1e-9))
        if n.construct == ELEMENT and n.depth:
            score += 1.0 if any(t.construct == ELEMENT for t in stack[-1:]) else -1.0 if n.start < refused_until else 0.0
        if score <= bar:
            if n.construct == ELEMENT and n.tail and n.head:
                refused_until = max(refused_until, n.end)
            continue
        if stack and CONSTRUCTS[stack[-1].construct][4] and n.end <= stack[-1].end and (n.start, n.end) != (stack[-1].start, stack[-1].end):
            continue
        crossed = False
        while stack and n.start < stack[-1].end < n.end and n.start != stack[-1].start:
            if stack[-1].probability >= n.probability:
                crossed = True
                break
            dropped.add(id(stack.pop()))
        if crossed:
            continue
        taken.append(n)
        stack.append(n)
    return [n for n in taken if id(n) not in dropped]


# ---- labelled sample: fragments with the spans that are markup; the bound is SAMPLE_TEXTS
SAMPLE_TEXTS, SEED = 2_500, 20_240_601
_ZH = "今天下午 图书馆 老师们 火车站 河边 新开的餐厅 天气预报 一起讨论 花园里 学生 非常热闹 路口 慢慢变冷 城市规划 旧房子 会议记录 第二部分 结论 数量不多 明显上升 山路 邮局".split()
_EN = "garden river station teacher museum slowly weather letter bridge morning harbour village music window story winter careful answer several picture".split()
_CODE = ("total = a * b + c", "for i in range(n):\n    print(i)", "x = (y + 1) ** 2", "if a < b && b > c", "# setup\nrun_all()", "SELECT * FROM t WHERE k > 1", "w = [p for p in q]", "int main() { return 0; }")


def _phrase(r: random.Random) -> str:
    words = r.choices(_ZH, k=r.randint(1, 4)) if r.random() < 0.6 else r.choices(_EN, k=r.randint(1, 6))
    s = ("" if not words[0].isascii() else " ").join(words)
    if r.random() < 0.25:
        s = r.choice(["3D打印", "5G天线", f"20{r.randint(10, 30)}年上半年", f"{r.randint(2, 90)}条产线", f"{r.randint(2, 9)}*3*{r.randint(2, 99)}的", "2025 "]) + s
    return s + (f"{r.uniform(0, 90):.1f}%" if r.random() < 0.3 else "")


def _fragment(r: random.Random) -> tuple[str, list[tuple[int, int, tuple[str, str]]]]:
    """A piece of text and the spans in it that are markup (start, end, construct)."""
    p, q, n = _phrase(r), _phrase(r), r.randint(1, 30)
    spans: list[tuple[int, int, tuple[str, str]]] = []
    at = [""]
    opened: list[int] = []

    def put(*parts: str | tuple[str, str, str]) -> None:
        for x in parts:
            if isinstance(x, tuple):
                if x[0] == "open":
                    opened.append(len(at[0]))
                elif x[0] == "close":
                    spans.append((opened.pop(), len(at[0]) + len(x[2]), ("html", "element")))
                else:
                    spans.append((len(at[0]), len(at[0]) + len(x[2]), (x[0], x[1])))
                x = x[2]
            at[0] += x

    def tag(s: str) -> tuple[str, str, str]:
        return ("html", "element", s)

    def element(name: str, attributes: str, inside: list) -> list:
        """A closed element around parts: its span begins here and ends with the end tag."""
        return [("open", "", f"<{name}{attributes}>"), *inside, ("close", "", f"</{name}>")]

    def table(head: str) -> list:
        rows = []
        for _ in range(r.randint(1, 4)):
            cells = [y for _ in range(r.randint(2, 4)) for y in element(head, "" if r.random() < 0.7 else f' colspan="{r.randint(1, 3)}"', [r.choice([f"{r.uniform(1, 900):.2f}", _phrase(r), ""])])]
            rows += element("tr", "", cells)
        return element("table", r.choice(["", " border=1", f' class="t{n}"']), rows if r.random() < 0.7 else element("tbody", "", rows))

    kind = r.randint(0, 56) if r.random() < 0.7 else r.randint(43, 56)
    if kind < 3:
        t = r.choice(["b", "span", "div", "p", "a", "i", "h3", "u", "sup", "strong", "font"])
        a = r.choice(["", "", f' style="color:#{r.randrange(1 << 24):06x}"', f' class="{r.choice("abcdefgh")}{n}"', f' href="#s{n}"', f" width={n}"])
        put(p, *(element(t, a, [q]) if r.random() < 0.85 else [tag(f"<{t}{a}>"), q]), r.choice(["，", "。", ". "]))
    elif kind == 3:
        put(p, tag(r.choice(["<br>", "<br/>", "<BR />", "<hr>"])), q)
    elif kind == 4:
        put(p, ("html", "comment", f"<!-- {r.choice([q, str(n), 'todo: ' + p])} -->"), q)
    elif kind < 7:
        put(p, ("html", "entity", r.choice(["&nbsp;", "&amp;", "&lt;", "&gt;", "&#9;", "&#xff0c;", "&#x2c;", "&ldquo;", "&mdash;"])), q)
    elif kind == 7:
        put(*table(r.choice(["td", "th"])))
    elif kind == 8:
        closed = r.random() < 0.7
        items = [y for _ in range(r.randint(2, 4)) for y in (element("li", "", [_phrase(r)]) if closed else [tag(r.choice(["<li>", "<LI>"])), _phrase(r)])]
        put(*element(r.choice(["ul", "ol"]), "", items))
    elif kind == 9:
        t = r.choice(["pre", "code"])
        put(p, ("html", "code", f"<{t}>{r.choice(_CODE)}\n# {q}</{t}>"))
    elif kind < 12:
        put("\n", ("markdown", "heading", "#" * r.randint(1, 5) + " " + p), "\n", q)
    elif kind == 12:
        put("\n", ("markdown", "setext", p + "\n" + r.choice("=-") * r.randint(3, 12)), "\n", q)
    elif kind == 13:
        put("\n", ("markdown", "fence", f"```\n{r.choice(_CODE)}\n# {n}\n```"), "\n")
    elif kind == 14:
        put(p, ("markdown", "code", f"`{r.choice(['count_1', 'k_5', 'x = 3', 'main()'])}`"), r.choice(["。", q]))
    elif kind < 18:
        m = r.choice(["**", "**", "__"])
        put(r.choice([p, p + "，", "* "]), ("markdown", "strong", m + q + m), r.choice(["。", "：9.9", q]))
    elif kind < 20:
        m = r.choice(["*", "*", "_"])
        put(p, r.choice(["，", " ", "。"]) if m == "_" else r.choice(["，", " ", "。", ""]), ("markdown", "em", m + q + m), r.choice(["。", "，", " "]))
    elif kind == 20:
        put(p, ("markdown", "strike", f"~~{q}~~"), "。")
    elif kind < 23:
        put(p, ("markdown", "link", r.choice(["", "!"]) + f"[{r.choice([q, ''])}]({r.choice([f'img{n}.png', f'_p{n}_photo_1.jpg', 'https://x.test/a'])})"), "。")
    elif kind == 23:
        if r.random() < 0.5:
            put(p, ("markdown", "reference", f"![{q}][{n}]"), "\n\n", ("markdown", "reference", f"[{n}]: img{n}.gif"))
        else:
            put("\n", ("markdown", "reference", f"[{n}]: img{n}.gif"))
    elif kind < 26:
        put("\n", ("markdown", "quote", r.choice(["> ", ">"]) + p + r.choice(["。", ", " + q])), "\n")
    elif kind == 26:
        put("\n", ("markdown", "task", "- [x] "), p, "\n", ("markdown", "task", "- [ ] "), q)
    elif kind == 27:
        sep = r.choice(["|---|---|", "| --- | --- |", "|:---|---:|"])
        put("\n", ("markdown", "table", f"| {p} | 2024 |\n{sep}\n| {q} | {n}.5 |"), "\n")
    elif kind < 30:
        put(p, ("wiki", "link", r.choice([f"[[{q}]]", f"[[{p}|{q}]]", f"[[File:img{n}.jpg|thumb|{q}]]", f"[[Category:{q}]]"])), "。")
    elif kind == 30:
        put(p, ("wiki", "template", "{{" + r.choice([f"{p}|{n}|{q}", f"Main|{q}", f"{p}|k={n}"]) + "}}"))
    elif kind == 31:
        m = "=" * r.randint(2, 4)
        put("\n", ("wiki", "heading", f"{m} {p} {m}"), "\n")
    elif kind == 32:
        m = "'" * r.choice([2, 3])
        put(p, r.choice(["，", "。", " "]), ("wiki", "quotes", m + q + m), r.choice(["。", q]))
    elif kind == 33:
        put(("wiki", "table", '{| class="wikitable"\n! ' + p + " !! 2024\n|-\n| " + q + f" || {n}.2\n|" + "}"))
    elif kind == 34:
        put("\n", ("wiki", "definition", f";{p}\n:{q}\n:{p}"), "\n")
    elif kind == 35:
        put(p, ("latex", "display", r.choice([r"$$ S = \sum_{k=1}^{9} \frac{a_k}{2^k} $$", r"\[ a = b^2 \]"])))
    elif kind < 38:
        put(p, r.choice([" ", "（", "，"]), ("latex", "math", r.choice([f"$n={n}$", f"$g_{{t}}={n}.2$", rf"${n}.4\%$", rf"$-\%$", r"$v = \frac{s}{t} = 8.5\%$", rf"\(\Delta q = {n}.9\)", "$x^2$", "$\\alpha$"])), r.choice(["。", "）", " "]))
    elif kind == 38:
        put("\n", ("latex", "environment", "\\begin{itemize}\n\\item " + p + "\n\\item " + q + "\n\\end{itemize}"))
    elif kind == 39:
        put(("latex", "environment", "\\begin{tabular}{lrr}\n" + p + " & B & C \\\\\n" + q + f" & {n}.1 & {n}.7 \\\\\n\\end{{tabular}}"))
    elif kind < 42:
        put(p, ("latex", "command", "\\" + r.choice(["textbf", "emph", "section", "textit", "footnote"]) + "{" + q + "}"), "。")
    elif kind == 42:
        put(p, f"{n}.5", ("latex", "escape", r.choice(["\\%", "\\&", "\\$"])), q)
    # from here on nothing is markup
    elif kind == 43:
        put(r.choice([f"气温<{n}度且湿度>{n / 7:.1f}，适合外出。", f"左边>{n}.5%而右边<{n}%，", f"if A < {n} and B > {n}, ", f"<{n}年>", "A=>B", f"x <{p}，y> "]))
    elif kind == 44:
        put(r.choice([f"*ST{p}：{q}", f"*ST{p}、*ST{q}", f"\n*注：{p}[{n}]。", f"{n}*{n + 1}*{n + 2}毫米", f"{p}*，{q}*", f"* {p}", f"规格{n}*{n}mm*{n}"]))
    elif kind == 45:
        put(r.choice([f"区间{n}.1%~{n}.9%，{p}{n}.2%~。", f"{n}~{n + 3}天，约{n}~{n + 5}元", "5~6, 7~8"]))
    elif kind == 46:
        put(r.choice([f"见脚注[{n}]、[{n + 1}]。", f"{p}[{n}]", f"\n[{n}]\n", f"[{p}] {q}", f"\n[a] {p} / {q}"]))
    elif kind == 47:
        put(r.choice([f"报价US$ {n}.5元，成交$ {n}.9元。", f"单价$ {n}，合计$ {n * 7}，", f"cost $5 and $ {n}.2 bn", f"${n}.5m to ${n + 2}m", f"预算约$ {n}.94亿，再加$ {n}.8亿。", f"去年${n * 9}.2亿、今年${n}.3亿，", f"{p}约$ {n}，{q}约$ {n}。", f"from $ {n}.1 bn to $ {n}.9 bn", f"$ {n}.5 %, $ {n}"]))
    elif kind == 48:
        put(r.choice([f"打开notes_{n}_new即可。", f"见draft_{n}_last_v3", f"img_{n}_a.jpg 与 img_{n}_b.jpg", "snake_case_name"]))
    elif kind == 49:
        put(r.choice([f"#{n}楼与#{n + 1}楼相距{n}.5米。", f"\n#{n}楼停水", f"No.#{n} and #{n + 2}", f"\n#{p}# {q}"]))
    elif kind == 50:
        put(r.choice([f"公式A==B==C成立", f"{p}=={q}==", "x == y", f"{p} = {q}", "======"]))
    elif kind == 51:
        put("\n", r.choice([f"作者 | {p} | {n}月", f"{p} | {q} | {n}", f"{n} | {n + 4}", f"| {p} | {q} |\n| {n} | {n} |", f"{p}|{q}"]), "\n")
    elif kind == 52:
        put("".join(f"\n{r.choice(['-', '*', '•', '+'])} {_phrase(r)} {n}.5" for _ in range(3)))
    elif kind == 53:
        put("".join(f"\n{i + 1}{r.choice(['.', ')', '、'])} {_phrase(r)}" for i in range(3)))
    elif kind == 54:
        put(r.choice(["R&B music", "S&P;", "A&B;C", "AT&T", "B&B 与 R&B;", "Q&A"]), p)
    elif kind == 55:
        put(r.choice([r"路径C:\music\old", r"D:\photos\2024", "和/或\\以及", r"a\b"]), q)
    else:
        put(p, r.choice(["。", "; ", "：", "\n", " "]), q, r.choice(["。", "\n", "it's the firm's", "'quoted'", "{x}", "(见表)", f"\n: {p}", f"\n;{p}"]))
    return at[0], spans


def labelled_texts(n: int = SAMPLE_TEXTS, seed: int = SEED) -> Iterator[tuple[str, set[tuple[int, int, int]]]]:
    """The labelled sample: texts joined from fragments, with the spans that are markup as (start, end, construct)."""
    r = random.Random(seed)
    for _ in range(n):
        text, spans = "", set()
        for _ in range(r.randint(1, 5)):
            if text and r.random() < 0.5:
                text += _phrase(r) + r.choice(["。", "\n", ". ", "，"])
            part, own = _fragment(r)
            if part.startswith("\n"):
                if not text or text.endswith("\n"):
                    part, own = part[1:], [(s - 1, e - 1, c) for s, e, c in own]
            spans |= {(s + len(text), e + len(text), INDEX[c]) for s, e, c in own}
            text += part
        yield text, spans


def _labelled_rows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in labelled_texts(n, seed):
        nodes = candidates(text)
        opaque = [(s, e) for s, e, c in spans if CONSTRUCTS[c][4]]
        inside = [(s, e) for s, e, c in spans]
        # of an element only its tags are taken, not what is between them
        whole = {(n.start, n.end): (n.head, n.tail) for n in nodes if n.construct == ELEMENT}
        marks = [x for s, e, c in spans for x in (((s, s + whole[s, e][0]), (e - whole[s, e][1], e)) if c == ELEMENT and (s, e) in whole else ((s, e),))]
        for node, row in zip(nodes, features(text, nodes)):
            hit = (node.start, node.end, node.construct) in spans
            if not hit and any(s <= node.start and node.end <= e for s, e in opaque):
                continue
            if not hit and any(s <= node.start and node.end <= e and (s, e) != (node.start, node.end) for s, e in inside) and node.kind == "latex" and node.form in ("command", "script", "escape"):
                hit = True
            if not hit and any(not (e <= node.start or node.end <= s) for s, e in marks):
                # part of, or crossing, a labelled construct: its own label is not known
                continue
            xs.append(row)
            ys.append(float(hit))
    return np.array(xs), np.array(ys)


@lru_cache(2)
def trained(n: int = SAMPLE_TEXTS, seed: int = SEED) -> BoostedTrees:
    """The classifier, fitted on the bounded labelled sample."""
    return BoostedTrees().fit(*_labelled_rows(n, seed))


def markup_nodes(texts: list[str], model: BoostedTrees) -> list[list[Node]]:
    """The nodes of each text that are markup."""
    nodes = [candidates(t) for t in texts]
    rows = [features(t, ns) for t, ns in zip(texts, nodes) if ns]
    p = iter(model.probability(np.concatenate(rows)) if rows else ())
    for ns in nodes:
        for n in ns:
            n.probability = float(next(p))
    return [decode(ns) for ns in nodes]


def _rows(rows: list[list[str]]) -> str:
    return "\n".join("\t".join(c.strip() for c in r) for r in rows if any(c.strip() for c in r))


def _inline(raw: str) -> str:
    """Commands within a LaTeX environment as their content."""
    return re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", re.sub(r"\\([%&_#$])", r"\1", raw))


def clean(text: str, taken: list[Node]) -> str:
    """The text without its markup, its structure in one plain notation whatever the language was: headings as ``#`` signs, items as ``-`` or their number (two spaces a level), code between backticks, formulas
    between dollar signs, table cells separated by tabs. Links keep their text; comments, scripts and styles go."""
    lists: list[int] = [0]

    def inside(s: int, e: int, nodes: list[Node]) -> str:
        out, at, i = [], s, 0
        while i < len(nodes):
            n, j = nodes[i], i + 1
            while j < len(nodes) and nodes[j].start < n.end:
                j += 1
            out += [text[at : n.start], one(n, nodes[i + 1 : j])]
            at, i = n.end, j
        return "".join(out) + text[at:e]

    def element(n: Node, below: list[Node]) -> str:
        name, depth = n.name, lists[0]
        if name in HIDDEN:
            return ""
        if name in ("ul", "ol"):
            lists[0] += 1
        content = inside(n.start + n.head, max(n.end - n.tail, n.start + n.head), below)
        lists[0] = depth
        if name in ("br", "hr"):
            return "\n"
        if name == "li":
            mark = f"{n.ordinal}. " if ordered.get(id(n)) else "- "
            return ("" if not n.head else "\n" + "  " * max(0, depth - 1) + mark) + content.strip(" \n")
        if re.fullmatch("h[1-6]", name):
            return "\n" + (("#" * int(name[1]) + " ") if n.head else "") + content.strip() + "\n"
        if name in ("td", "th"):
            return content.strip() + "\t"
        if name == "tr":
            return "\n" + content.rstrip("\t")
        return "\n" + content + "\n" if name in ("p", "div", "table", "ul", "ol", "blockquote", "section", "article", "dl", "dt", "dd", "pre") else content

    def one(n: Node, below: list[Node]) -> str:
        raw = text[n.start : n.end]

        def body(lead: int, tail: int) -> str:
            return inside(n.start + lead, n.end - tail, [x for x in below if x.start >= n.start + lead and x.end <= n.end - tail])

        kind = (n.kind, n.form)
        if n.construct == ELEMENT:
            return element(n, below)
        if kind == ("html", "comment"):
            return ""
        if kind == ("html", "entity"):
            x = raw
            while (y := html.unescape(x)) != x:
                x = y
            return x.replace("\xa0", " ")
        if kind == ("html", "code"):
            if raw[1:7].lower().startswith(HIDDEN):
                return ""
            content = html.unescape(re.sub(r"^<[^<>]*>|</[^<>]*>$", "", raw))
            content = re.sub(r"^\s*<code[^<>]*>|</code>\s*$", "", content)
            return f"\n```\n{content.strip(chr(10))}\n```\n" if "\n" in content or raw[1:4].lower() == "pre" else f"`{content}`"
        if kind == ("markdown", "heading"):
            lead = re.match(r" *(#+) *", raw)
            return "\n" + lead[1] + " " + body(len(lead[0]), 0).rstrip("# ") + "\n"
        if kind == ("markdown", "setext"):
            return ("# " if raw.rstrip().endswith("=") else "## ") + body(0, len(raw) - raw.index("\n")).strip()
        if kind in (("markdown", "fence"), ("markdown", "code")):
            return raw
        if n.kind == "markdown" and n.form in ("strong", "em", "strike"):
            k = len(re.match(r"\*+|_+|~+", raw)[0])
            return body(k, k)
        if kind == ("markdown", "task"):
            return raw[: len(raw) - len(raw.lstrip())] + "- "
        if kind == ("markdown", "link"):
            a = raw.index("[") + 1
            return body(a, len(raw) - raw.index("]"))
        if kind == ("markdown", "reference"):
            return "" if re.match(r" *\[[^\]]+\]:", raw) else re.sub(r"^!?\[([^\]]+)\].*", r"\1", raw)
        if kind == ("markdown", "quote"):
            return body(len(re.match(r" *> ?", raw)[0]), 0)
        if kind == ("markdown", "table"):
            return _rows([r.strip().strip("|").split("|") for r in body(0, 0).split("\n") if not re.fullmatch(r"[\s|:-]+", r)])
        if kind == ("wiki", "link"):
            return "" if re.match(r"\[\[(?:Category|分类):", raw) else raw[2:-2].split("|")[-1]
        if kind == ("wiki", "template"):
            parts = body(2, 2).split("|")
            return " ".join(x.split("=", 1)[-1].strip() for x in parts[1:]) or parts[0]
        if kind == ("wiki", "heading"):
            return "\n" + "#" * min(6, len(raw) - len(raw.lstrip("="))) + " " + raw.strip("= ") + "\n"
        if kind == ("wiki", "quotes"):
            return body(len(re.match("'+", raw)[0]), len(raw) - len(raw.rstrip("'")))
        if kind == ("wiki", "table"):
            rows = re.split(r"\n\|-[^\n]*", "\n".join(body(0, 2).split("\n")[1:]))
            return _rows([re.split(r"\|\||!!|\n[|!]", re.sub(r"^\s*[|!]", "", r)) for r in rows])
        if kind == ("wiki", "definition"):
            return re.sub(r"(?m)^:\s*", "- ", re.sub(r"(?m)^;\s*", "", inside(n.start, n.end, below)))
        if n.kind == "latex" and n.form in ("display", "math"):
            return raw if raw.startswith("$") else f"$${raw[2:-2]}$$" if n.form == "display" else f"${raw[2:-2]}$"
        if kind == ("latex", "environment"):
            name = re.match(r"\\begin\{([^}]*)\}", raw)[1].rstrip("*")
            content = re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\])?(?:\{[^}]*\})?|\\end\{[^}]*\}$", "", raw)
            if name in ("equation", "align", "gather", "displaymath", "math"):
                return f"$${content.strip()}$$"
            if name in ("verbatim", "lstlisting", "minted"):
                return f"```\n{content.strip(chr(10))}\n```"
            if name.startswith(("tabular", "array", "longtable")):
                rows = re.split(r"\\\\", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", content))
                return _rows([[_inline(c) for c in re.split(r"(?<!\\)&", r)] for r in rows])
            number = iter(range(1, len(content) + 2))
            return _inline(re.sub(r"\\item\s*", lambda _: f"{next(number)}. " if name == "enumerate" else "- ", content)).strip("\n")
        if kind == ("latex", "command"):
            if raw.startswith("\\item"):
                return "- " + raw[5:].lstrip()
            braces = re.findall(r"\{([^{}]*)\}", raw)
            content = braces[-1] if braces and not raw.startswith(("\\begin", "\\end")) else ""
            head = re.match(r"\\((?:sub)*)section", raw)
            return f"\n{'#' * (1 + len(head[1]) // 3)} {content}\n" if head else content
        if kind == ("latex", "escape"):
            return raw[1:]
        if kind == ("latex", "script"):
            return raw[2:-1]
        return inside(n.start, n.end, below)

    # items of numbered lists, by the element around them
    ordered, around = {}, []
    for n in taken:
        while around and around[-1].end <= n.start:
            around.pop()
        if n.construct == ELEMENT:
            if n.name == "li":
                ordered[id(n)] = bool(around) and around[-1].name == "ol"
            elif n.name in ("ul", "ol"):
                around.append(n)
    out = inside(0, len(text), taken)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip("\n")


def markup_fields(blocks: DataFrame, key: str = "block_id", fields: tuple[str, ...] = ("text", "table_body"), sample: int = SAMPLE_TEXTS) -> DataFrame:
    """(key, field_name, kinds, clean_text) of every field that holds a text.

    The classifier is fitted on ``sample`` labelled texts made by ``labelled_texts`` (the bound of the sample); all rows are then read whole.
    Texts without any sign that markup uses are passed through without reaching Python.

    Defined cases: null keys and null or empty fields give no row; repeated rows give one; a text without markup has no kinds and stays as it is.
    Markup within code, comments and formulas is content of those. Further columns are ignored.
    """
    rows = blocks.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields))).alias("x")).select("k", "x.f", "x.t")
    # repeated rows are told by id, field and a hash; rows of one id with unlike texts stay
    rows = rows.filter("t is not null and t <> ''").withColumn("h", F.md5("t")).dropDuplicates(["k", "f", "h"]).drop("h")
    kind = blocks.schema[key].dataType.simpleString()
    model = rows.sparkSession.sparkContext.broadcast(trained(sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                part = b.iloc[s : s + 500]
                texts = part["t"].tolist()
                nodes = markup_nodes(texts, model.value)
                yield pd.DataFrame({key: part["k"].to_numpy(), "field_name": part["f"].to_numpy(), "kinds": [sorted({n.kind for n in ns}) for ns in nodes], "clean_text": [clean(t, ns) if ns else t for t, ns in zip(texts, nodes)]})

    special = F.col("t").rlike(SPECIAL)
    read = rows.filter(special).mapInPandas(run, f"`{key}` {kind}, field_name string, kinds array<string>, clean_text string")
    return read.unionByName(rows.filter(~special).select(F.col("k").alias(key), F.col("f").alias("field_name"), F.array().cast("array<string>").alias("kinds"), F.col("t").alias("clean_text")))
