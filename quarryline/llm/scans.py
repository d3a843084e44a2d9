"""Noise in text from scanned pages: split words, misread characters, running headers, page numbers; and the repaired paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage

# Hyphens; characters that are misread for one another.
HYPHENS = "-‐‑­¬‒–−﹣－⁃"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
DIGIT_OF = {"O": "0", "o": "0", "Q": "0", "I": "1", "l": "1", "Z": "2", "S": "5", "b": "6", "g": "9", "B": "8"}
#: Groups of Chinese characters that resemble one another.
CHINESE = "人入 忆亿 可司 汀订 刊利 汁计 尸户 巿市 己已巳 李季 凤风 顶项 涧润 冋同 圾级 菅营 未末 曰日 土士 干千于 夭天 玉王 木本 目自 由田甲 乌鸟 午牛 侯候 免兔 令今 贝见 折拆析 徒徙 竞竟 辩辨 暑署 治冶洽 沽估 祥详 拔拨 沬沫 壮状 杭抗 矢失 困因 待侍 没设 栗粟 科料 淮准 璧壁 嬴赢 搏博 薄簿 帅师 伐代 丸九 仑仓".split()
#: What is written for what, in Latin words.
WRITTEN_FOR = (
    ("rn", "m"), ("m", "rn"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("nn", "m"), ("ii", "u"), ("1", "l"), ("1", "i"), ("1", "I"), ("I", "l"), ("l", "I"), ("l", "i"), ("i", "l"),
    ("0", "o"), ("0", "O"), ("u", "n"), ("n", "u"), ("c", "e"), ("e", "c"), ("o", "c"), ("t", "f"), ("f", "t"), ("b", "h"), ("h", "b"), ("5", "s"), ("5", "S"), ("6", "b"), ("9", "g"), ("8", "B"), ("q", "g"), ("v", "y"), ("y", "v"),
)
#: A form is misread if the form that it stands for is this many times as frequent in the same place, and at least LEAST times there.
RATIO, LEAST = 20, 5
#: A number-like token is a term if what it would stand for is at most this many times as frequent.
TERM_RATIO = 200
#: Corrections that fit a broadcast (each of some 40 bytes); more of them are joined.
MAX_BROADCAST = 200_000

GROUP = {c: g[0] for g in CHINESE for c in g}
IN_GROUP = re.compile(f"[{''.join(GROUP)}]")
_LEVELS = "".join(DIGIT_OF)
#: A token of digits and letters that resemble digits; a letter, a digit and the same letter again (as in terms of trade) is none.
NUMBER = re.compile(rf"(?<![A-Za-z0-9])(?!([A-Z])\d\1(?![A-Za-z0-9]))(?:(?=[0-9.,]*[{_LEVELS}])(?=[{_LEVELS}.,]*[0-9])|(?=[{_LEVELS}.]+[%％亿]))[0-9{_LEVELS}](?:[0-9{_LEVELS}]|[.,](?=[0-9{_LEVELS}]))*(?![A-Za-z0-9])")
LIKE_DIGIT = re.compile(f"[{_LEVELS}]")
ZERO = {ord(c): "0" for c in "0123456789０１２３４５６７８９"}
PURE = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:[.,][0-9]+)*(?![A-Za-z0-9])")
WORD = re.compile(r"(?<![A-Za-z0-9À-ÿ&#\\])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{2,24}(?![A-Za-z0-9À-ÿ])")
COMPOUND = re.compile(rf"(?<![{LATIN}])[{LATIN}]+-[{LATIN}]+(?![{LATIN}])")
BROKEN = re.compile(rf"([{LATIN}]+)[{HYPHENS}][^\S\n]*\n\s*([{LATIN}]+)")
BROKEN_END = re.compile(rf"[{LATIN}][{HYPHENS}]\s*$")
WIDE_CHARACTER = "⺀-鿿豈-﫿＀-￯。，、；：？！“”（）《》％"
SOFT_BREAK = re.compile(rf"(?<=[{WIDE_CHARACTER}])\n(?=[^\n])|(?<=[^\n])\n(?=[{WIDE_CHARACTER}])|(?<=[0-9.,])\n(?=[0-9])|(?<=[0-9])\n(?=[.,%])")
BLANK_END, SINGLE_BREAK = re.compile(r"[^\S\n]+\n"), re.compile(r"(?<=[^\n])\n(?=[^\n\s])")
HAN = re.compile("[一-鿿]")
#: A line's end beside a digit in Chinese text, whose lines are wrapped at any character.
WRAPPED_NUMBER = re.compile(r"(?<=[A-Za-z0-9%.,)-])\n(?=[0-9])|(?<=[0-9])\n(?=[A-Za-z0-9%])|(?<=[A-Za-z])\n(?=[%.,])")
NINES = re.compile(r"\d")
BAR = re.compile(r"(?<=[0-9.,])\|(?=[0-9.,%％亿忆万元])|(?<![\w|\s])\|(?=[0-9]+[.,])")
#: Chinese numerals from 1 to 999, made by rule.
_ONES = ("", *"一二三四五六七八九")


def _numeral(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    tens, ones = divmod(rest, 10)
    lead = "" if not hundreds else _ONES[hundreds] + "百" + ("零" if 0 < rest < 10 else "")
    return lead + ("" if not tens else ("" if tens == 1 and not hundreds else _ONES[tens]) + "十") + _ONES[ones]


NUMERALS = tuple(_numeral(n) for n in range(1, 1000))
#: The number of a page, perhaps with the total (for the JVM).
PAGE = r"(?i)^[^\p{L}\p{N}%]*(?:第\s*|page\s+|pg?\.\s*)?(\d{1,5})(?:\s*页)?(?:[\s，,]*(?:/|／|\||of|共)\s*(\d{1,5})(?:\s*页)?)?[^\p{L}\p{N}%]*$"
#: The same in Chinese numerals, which need the words around them.
CHINESE_PAGE = r"^[^\p{L}\p{N}%]*第\s*([一二三四五六七八九十百零]{1,6})\s*页(?:[\s，,]*共\s*([一二三四五六七八九十百零]{1,6})\s*页)?[^\p{L}\p{N}%]*$"
#: Text blocks from the top or the bottom of a page that are its edges; a header may differ in this share of its characters from page to page.
EDGE, FUZZY = 2, 0.2


def join_lines(text: str, keep: set[str] | None = None) -> str:
    """The text with its lines joined: split words closed up (compounds in ``keep`` retain their hyphen), Chinese and numbers without a space, the rest with one."""
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if "\n" in t:

        def close(m: re.Match) -> str:
            return m[1] + ("-" if keep and f"{m[1]}-{m[2]}" in keep else "") + m[2]

        t = BROKEN.sub(close, t)
        t = SOFT_BREAK.sub("", BLANK_END.sub("\n", t))
        if WRAPPED_NUMBER.search(t) and len(HAN.findall(t)) * 5 >= len(t):
            t = WRAPPED_NUMBER.sub("", t)
        t = SINGLE_BREAK.sub(" ", t)
    # a bar within a number is a one; with more bars it separates cells
    return BAR.sub("l", t) if "|" in t and t.count("|") <= 2 else t


class Names:
    """Finds registered names, whose characters count as right."""

    def __init__(self, names: list[str]):
        self.names = [n for n in names if len(n) > 1]
        self._find: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def _build(self) -> None:
        try:
            import ahocorasick
        except ImportError:
            pattern = re.compile("|".join(map(re.escape, sorted(self.names, key=len, reverse=True))) or "(?!)")
            self._find = lambda t: ((m.start(), m.end()) for m in pattern.finditer(t))
            return
        machine = ahocorasick.Automaton()
        for n in self.names:
            machine.add_word(n, len(n))
        machine.make_automaton()
        self._find = (lambda t: ((end + 1 - n, end + 1) for end, n in machine.iter(t))) if self.names else (lambda t: iter(()))

    def mask(self, text: str) -> str:
        """The text with digits as 0 and every character of a name as a placeholder; of the same length."""
        return self.read(text)[0]

    def read(self, text: str) -> tuple[str, list[re.Match]]:
        """The masked text, and the matches of NUMBER in the text."""
        if self._find is None:
            self._build()
        numbers = list(NUMBER.finditer(text)) if LIKE_DIGIT.search(text) else []
        masked = text.translate(ZERO)
        names = list(self._find(text))
        if numbers or names:
            chars = list(masked)
            for m in numbers:
                chars[m.start() : m.end()] = "0" * (m.end() - m.start())
            for s, e in names:
                chars[s:e] = "\ue000" * (e - s)
            masked = "".join(chars)
        return masked, numbers

    def __getstate__(self) -> dict:
        return {"names": self.names, "_find": None}


def _in_place(masked: str, i: int) -> tuple[str, str, str]:
    """Keys of the Chinese character at a position: its group with the neighbours on both sides, the two before it, and the two after it."""
    padded = "\x01\x01" + masked[max(0, i - 2) : i + 3] + "\x01\x01" if i < 2 or i + 3 > len(masked) else ""
    at = padded[min(i, 2) : min(i, 2) + 5] if padded else masked[i - 2 : i + 3]
    g = GROUP[masked[i]]
    return f"C{g}m{at[1]}{at[3]}", f"C{g}l{at[0]}{at[1]}", f"C{g}r{at[3]}{at[4]}"


def shape(token: str) -> str:
    return NINES.sub("9", token)


def observed(joined: str, names: Names) -> Iterator[str]:
    """Key and form, with a mark between them, of everything in a text that may be misread or that tells how a form is usually written.

    Keys: C for a Chinese character of a group in its context, W for a word, N for a number (the form is its shape, digits as 9), E with the shape for a number as written, H for a compound.
    """
    masked, numbers = names.read(joined)
    for m in IN_GROUP.finditer(masked):
        for key in _in_place(masked, m.start()):
            yield f"{key}\x02{m[0]}"
    taken = set()
    for m in numbers:
        if "\ue000" not in masked[m.start() : m.end()] and not (m.start() and joined[m.start() - 1] in "#&"):
            taken.add(m.start())
            yield f"N\x02{shape(m[0])}"
            yield f"E{shape(m[0])}\x02{m[0]}"
    for m in PURE.finditer(joined):
        yield f"N\x02{shape(m[0])}"
    for m in WORD.finditer(joined):
        if m.start() and m.start() not in taken and "\ue000" not in masked[m.start() : m.end()]:
            yield f"W\x02{m[0]}"
    for m in COMPOUND.finditer(joined):
        yield f"H\x02{m[0]}"


def _count_forms(blocks: DataFrame, names) -> DataFrame:
    """(key, form, n) over all blocks; counted in the batch before anything is shuffled. ``names`` is a broadcast ``Names``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b["text"]:
                seen.update(observed(join_lines(t), names.value))
            yield pd.DataFrame([(*x.split("\x02"), n) for x, n in seen.items()], columns=["key", "form", "n"])

    return blocks.select("text").mapInPandas(run, "key string, form string, n long").groupBy("key", "form").agg(F.sum("n").alias("n"))


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = set()
        for key, form in zip(b["key"], b["form"]):
            if key == "N":
                out.add((key, form, "".join("9" if c in DIGIT_OF else c for c in form)))
                continue
            for wrong, right in WRITTEN_FOR:
                at = form.find(wrong)
                if at >= 0 and form.count(wrong) > 1:
                    out.add((key, form, form.replace(wrong, right)))
                while at >= 0:
                    out.add((key, form, form[:at] + right + form[at + len(wrong) :]))
                    at = form.find(wrong, at + 1)
        yield pd.DataFrame(list(out), columns=["key", "form", "right"])


def corrections(blocks: DataFrame, names) -> DataFrame:
    """(key, form, right): forms that stand for a far more frequent one in the same place, by the counts of the whole corpus; and the compounds (H) that keep their hyphen."""
    counts = cut_lineage(_count_forms(blocks, names))
    chinese = counts.filter("key like 'C%'").groupBy("key").agg(F.max(F.struct("n", "form")).alias("top"), F.collect_list(F.struct("form", "n")).alias("all"))
    chinese = chinese.select("key", F.explode("all").alias("x"), "top").filter(f"top.n >= {LEAST} and x.form <> top.form and x.n * {RATIO} <= top.n").select("key", "x.form", F.col("top.form").alias("right"))
    # a shape that is mostly one token, and no rare one, is a term, such as the name of a product
    terms = counts.filter("key like 'E%'").groupBy(F.expr("substring(key, 2)").alias("form")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).filter(f"most >= {LEAST} and 2 * most > all").select("form", "most")
    single = counts.filter(F.col("key").isin("W", "N"))
    variants = single.filter("key = 'W' or form rlike '[A-Za-z]'").select("key", "form").mapInPandas(_variants, "key string, form string, right string")
    right = single.select("key", F.col("form").alias("right"), F.col("n").alias("n_right"))
    better = variants.join(single, ["key", "form"]).join(right, ["key", "right"]).filter(f"n_right >= {LEAST} and n * {RATIO} <= n_right")
    better = better.join(terms, "form", "left").filter(f"key = 'W' or most is null or most * {TERM_RATIO} < n_right").groupBy("key", "form").agg(F.max_by("right", F.struct("n_right", "right")).alias("right"))
    compounds = counts.filter("key = 'H'").select("form", "n").join(single.filter("key = 'W'").select(F.col("form").alias("closed"), F.col("n").alias("n_closed")), F.regexp_replace("form", "-", "") == F.col("closed"), "left")
    compounds = compounds.filter("n_closed is null or n > n_closed").select(F.lit("H").alias("key"), "form", F.col("form").alias("right"))
    return chinese.unionByName(better.select("key", "form", "right")).unionByName(compounds)


class Corrections:
    """Corrections as a reader of texts looks them up: by key and form, with the forms that are ever wrong."""

    def __init__(self, table: dict[tuple[str, str], str]):
        self.right = table
        self.keep = {f for k, f in table if k == "H"}
        self.words = {f: r for (k, f), r in table.items() if k == "W"}
        self.shapes = {f for k, f in table if k == "N"}
        self.chars = "".join(sorted({f for k, f in table if k[0] == "C"}))
        self.wrong = re.compile(f"[{self.chars}]") if self.chars else None


def inspect(text: str, names: Names, known: Corrections) -> tuple[bool, bool, str]:
    """(has a broken word, has a misread character, repaired text) of one block."""
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    broken = "\n" in t and any(f"{m[1]}-{m[2]}" not in known.keep for m in BROKEN.finditer(t)) or bool(BROKEN_END.search(t))
    joined = join_lines(t, known.keep)
    edits: list[tuple[int, int, str]] = []
    masked, numbers = names.read(joined)
    if known.wrong:
        for m in known.wrong.finditer(masked):
            i = m.start()
            both, before, after = (known.right.get((k, m[0])) for k in _in_place(masked, i))
            # the neighbours on both sides, or the two characters before if the nearer is a letter, decide alone
            sure = before is not None and masked[i - 1 : i].isalpha() and i > 1 and "0" not in masked[i - 2 : i]
            if both or sure or (before and after):
                edits.append((i, i + 1, both or before))
    taken = set()
    for m in numbers:
        if "\ue000" not in masked[m.start() : m.end()] and not (m.start() and joined[m.start() - 1] in "#&"):
            taken.add(m.start())
            if shape(m[0]) in known.shapes:
                edits.append((m.start(), m.end(), "".join(DIGIT_OF.get(c, c) for c in m[0])))
    if known.words:
        for m in WORD.finditer(joined):
            if m[0] in known.words and m.start() and m.start() not in taken and "\ue000" not in masked[m.start() : m.end()]:
                edits.append((m.start(), m.end(), known.words[m[0]]))
    if not edits:
        return broken, False, joined
    repaired, end = [], 0
    for s, e, x in sorted(edits):
        if s >= end:
            repaired += [joined[end:s], x]
            end = e
    return broken, True, "".join(repaired) + joined[end:]


def _text_blocks(blocks: DataFrame) -> DataFrame:
    columns = ("block_id", "pdf_file", "page_idx", "block_idx", "text_level")
    rows = blocks.filter("block_type = 'text' and block_id is not null and text is not null and text <> ''").select(*columns, "text", F.md5("text").alias("h"))
    return rows.dropDuplicates([*columns, "h"]).drop("h")


def read_noise(blocks: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """(block_id, broken_word, misread, repaired) of every text block, by the corpus vocabulary."""
    return _read_noise(cut_lineage(_text_blocks(blocks)), names, name)


def _read_noise(texts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    spark, texts = texts.sparkSession, texts.select("block_id", "text")
    # a register is a list of stated size, held by every task
    own = spark.sparkContext.broadcast(Names([r[0] for r in names.select(name).filter(F.col(name).isNotNull()).distinct().collect()]))
    table = cut_lineage(corrections(texts, own))
    schema = "block_id long, broken_word boolean, misread boolean, repaired string"
    if table.count() <= MAX_BROADCAST:
        known = spark.sparkContext.broadcast(Corrections({(r["key"], r["form"]): r["right"] for r in table.toLocalIterator()}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(i, *inspect(t, own.value, known.value)) for i, t in zip(b["block_id"], b["text"])], columns=["block_id", "broken_word", "misread", "repaired"])

        return texts.mapInPandas(run, schema)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["block_id"], b["text"]):
                found = {tuple(x.split("\x02")) for x in observed(join_lines(t), own.value)}
                found |= {("H", f"{m[1]}-{m[2]}") for m in BROKEN.finditer(t.replace("\r\n", "\n"))}
                out += [(i, k, f) for k, f in found]
            yield pd.DataFrame(out, columns=["block_id", "key", "form"])

    used = texts.mapInPandas(forms, "block_id long, key string, form string").join(table, ["key", "form"]).groupBy("block_id").agg(F.collect_set(F.struct("key", "form", "right")).alias("known"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, k in zip(b["block_id"], b["text"], b["known"]):
                rows.append((i, *inspect(t, own.value, Corrections({} if k is None else {(x["key"], x["form"]): x["right"] for x in k}))))
            yield pd.DataFrame(rows, columns=["block_id", "broken_word", "misread", "repaired"])

    return texts.join(used, "block_id", "left").select("block_id", "text", "known").mapInPandas(run_joined, schema)


def _page_numbers(texts: DataFrame) -> DataFrame:
    """(block_id) of the blocks that are page numbers: those whose distance from page_idx is that of the PDF's sequence, or 0 or 1 where it has none."""
    short = texts.filter(F.length("text") <= 40)

    def parsed(form: str, value) -> DataFrame:
        return short.filter(F.col("text").rlike(form)).select("block_id", "pdf_file", "page_idx", value(F.regexp_extract("text", form, 1)).alias("number"), F.when(F.regexp_extract("text", form, 2) != "", value(F.regexp_extract("text", form, 2))).alias("total"))

    words = F.array(*map(F.lit, NUMERALS))
    numbers = parsed(PAGE, lambda c: c.cast("int")).unionByName(parsed(CHINESE_PAGE, lambda c: F.nullif(F.array_position(words, c).cast("int"), F.lit(0))))
    numbers = numbers.filter("number is not null and (total is null or total >= number)").withColumn("shift", F.col("number") - F.col("page_idx"))
    shifts = numbers.select("pdf_file", "shift", "page_idx").distinct().groupBy("pdf_file", "shift").agg(F.count(F.lit(1)).alias("n"))
    sequence = shifts.groupBy("pdf_file").agg(F.max(F.struct("n", "shift")).alias("top"), F.sum("n").alias("all")).filter("top.n >= 3 and 2 * top.n > all").select("pdf_file", F.col("top.shift").alias("usual"))
    return numbers.join(sequence, "pdf_file", "left").filter("(usual is null and shift in (0, 1)) or shift = usual").select("block_id").distinct()


def page_furniture(blocks: DataFrame) -> DataFrame:
    """(block_id, noise, exact) of the text blocks that are page numbers or running headers.

    A page number has the form of one and goes with the sequence of its PDF. Headers and footers are short lines without a level at the edges of pages that come back, digits and spaces aside and up to
    the share ``fuzzy`` of their characters, on enough pages. They are held against the forms that come back exactly on a ninth of the pages (two at least), so a PDF has few of these.
    ``exact`` tells whether the very line comes back on enough pages.
    """
    return _furniture(_text_blocks(blocks), _pages(blocks))


def _pages(blocks: DataFrame) -> DataFrame:
    """(pdf_file, pages) by the largest page index of any block."""
    return blocks.filter("pdf_file is not null").groupBy("pdf_file").agg((F.max("page_idx") + 1).alias("pages"))


def _furniture(texts: DataFrame, pages: DataFrame, most_chars: int = 60, least_letters: int = 4, least_pages: int = 3, share: float = 1 / 3, edge: int = EDGE, fuzzy: float = FUZZY) -> DataFrame:
    # longer texts only take a place on the page
    texts = texts.filter("pdf_file is not null and page_idx is not null").withColumn("text", F.when(F.length("text") <= most_chars, F.col("text")))
    numbers = cut_lineage(_page_numbers(texts.filter("text is not null")))
    page = Window.partitionBy("pdf_file", "page_idx")
    down, up = F.row_number().over(page.orderBy("block_idx", "block_id")), F.row_number().over(page.orderBy(F.desc("block_idx"), F.desc("block_id")))
    short = F.col("text_level").isNull() & (F.length("text") <= most_chars) & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= least_letters)
    placed = texts.withColumn("edge", F.least(down, up) <= edge).filter(short).join(numbers, "block_id", "left_anti")
    lines = cut_lineage(placed.select("block_id", "pdf_file", "page_idx", "edge", F.regexp_replace("text", r"(?U)[\d\s]", "").alias("line")))
    counts = lines.select("pdf_file", "line", "page_idx").distinct().groupBy("pdf_file", "line").agg(F.count(F.lit(1)).alias("n")).join(pages, "pdf_file")
    counts = cut_lineage(counts)
    forms = counts.filter((F.col("n") >= 2) & (F.col("n") * 9 >= F.col("pages"))).select("pdf_file", F.col("line").alias("form"), "pages")
    alike = lines.filter("edge").select("pdf_file", "line", "page_idx").distinct().join(forms, "pdf_file").filter(F.levenshtein("line", "form") <= F.length("form") * F.lit(fuzzy))
    back = alike.groupBy("pdf_file", "form", "pages").agg(F.count_distinct("page_idx").alias("on")).filter(F.col("on") >= least_pages).filter(F.col("on") >= F.col("pages") * F.lit(share)).select("pdf_file", "form")
    known = alike.join(back, ["pdf_file", "form"]).select("pdf_file", "line").distinct()
    often = counts.filter((F.col("n") >= least_pages) & (F.col("n") >= F.col("pages") * F.lit(share))).select("pdf_file", "line", F.lit(True).alias("exact"))
    headers = lines.filter("edge").join(known, ["pdf_file", "line"]).join(often, ["pdf_file", "line"], "left").select("block_id", F.lit("running_header").alias("noise"), F.coalesce("exact", F.lit(False)).alias("exact"))
    return numbers.select("block_id", F.lit("page_number").alias("noise"), F.lit(True).alias("exact")).unionByName(headers).distinct()


def scan_noise(blocks: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """(block_id, noise): the kinds of scan noise of each text block.

    Defined cases: only blocks of type ``text`` with an id and a text count; repeated rows give one result; a block may have several kinds, but
    page numbers and running headers are left out of ``document_paragraphs``. A word that ends with a hyphen at a block's end counts as split.
    A header counts here if the very line comes back often enough (digits and spaces aside); one that differs a little is furniture for ``document_paragraphs`` all the same.
    Null files or pages make a block neither page number nor header. Empty tables give no rows; further columns are ignored.
    """
    texts = cut_lineage(_text_blocks(blocks))
    read = _read_noise(texts, names, name)
    kinds = F.array_compact(F.array(F.when(F.col("broken_word"), F.lit("broken_word")), F.when(F.col("misread"), F.lit("misread"))))
    return read.select("block_id", F.explode(kinds).alias("noise")).unionByName(_furniture(texts, _pages(blocks)).filter("exact").select("block_id", "noise")).distinct()


def _readable(blocks: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Text blocks with a place, without furniture, with their repaired text; ``ended`` if a paragraph can't go on after them."""
    whole = cut_lineage(_text_blocks(blocks))
    texts = whole.filter("pdf_file is not null and page_idx is not null")
    clean = texts.join(_furniture(whole, _pages(blocks)).select("block_id").distinct(), "block_id", "left_anti").join(_read_noise(whole, names, name).select("block_id", "repaired"), "block_id")
    return clean.withColumn("ended", F.col("repaired").rlike("[。！？!?.：:；;…”）)%]\\s*$") | F.col("text_level").isNotNull())


def _glued(parts: str) -> Column:
    """The repaired texts of a paragraph's blocks as one; a hyphen after a letter at a block's end is closed."""
    return F.aggregate(parts, F.lit(""), lambda a, p: F.when((a == "") | a.rlike(f"[{HYPHENS}]\\s*$") | a.rlike("[⺀-鿿＀-￯]$"), F.concat(F.regexp_replace(a, f"(?<=[{LATIN}])[{HYPHENS}]\\s*$", ""), p["repaired"])).otherwise(F.concat(a, F.lit(" "), p["repaired"])))


def document_paragraphs(blocks: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Continuous paragraphs of every PDF: (pdf_file, paragraph, page_idx, last_page, text), numbered from 0 over the whole PDF.

    Page numbers and headers are left out, lines are joined, misread characters replaced. A block goes on with the paragraph of the text block before it, be that
    on the same page or on the last page with text before, if it has no level and the one before has no level and no mark at its end; a word hyphenated between them is joined.
    Pages are numbered on their own and get their offsets from one row a page, so no task holds the texts of a PDF, only those of a paragraph.
    """
    at, before = F.struct("block_idx", "block_id"), Window.unboundedPreceding
    order = Window.partitionBy("pdf_file", "page_idx").orderBy("block_idx", "block_id")
    heading = F.col("text_level").isNotNull()
    rows = _readable(blocks, names, name).withColumn("opens", (heading | F.coalesce(F.lag("ended").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("within", F.sum("opens").over(order.rowsBetween(before, 0)))
    pages = rows.groupBy("pdf_file", "page_idx").agg(F.sum("opens").alias("opened"), F.max_by("ended", at).alias("page_ended"), F.min_by(heading, at).alias("headed"))
    chain = Window.partitionBy("pdf_file").orderBy("page_idx")
    pages = pages.withColumn("starts", (F.coalesce(F.lag("page_ended").over(chain), F.lit(True)) & ~F.col("headed")).cast("int"))
    pages = pages.select("pdf_file", "page_idx", (F.coalesce(F.sum(F.col("starts") + F.col("opened")).over(chain.rowsBetween(before, -1)), F.lit(0)) + F.col("starts") - 1).alias("offset"))
    placed = rows.join(pages, ["pdf_file", "page_idx"]).withColumn("paragraph", F.col("offset") + F.col("within"))
    merged = placed.groupBy("pdf_file", "paragraph").agg(F.min("page_idx").alias("page_idx"), F.max("page_idx").alias("last_page"), F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", "block_id", "repaired"))).alias("parts"))
    return merged.select("pdf_file", "paragraph", "page_idx", "last_page", _glued("parts").alias("text"))
