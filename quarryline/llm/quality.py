"""Per-document text statistics, and how far they lie from natural prose."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage

#: The statistics, the kind that a value above prose points to, and the least spread that counts as one step.
STATS: tuple[tuple[str, str, float], ...] = (
    ("word_count_log", "", 0.5),
    ("mean_word_length", "junk", 0.8),
    ("symbol_ratio", "junk", 0.06),
    ("digit_ratio", "", 0.06),
    ("sentence_end_lines", "", 0.25),
    ("common_word_share", "", 0.04),
    ("chars_per_stop_log", "", 0.35),
    ("table_rows", "table", 0.06),
    ("empty_or_number_cells", "table", 0.09),
    ("enumerated_lines", "list", 0.11),
    ("short_entries", "list", 0.10),
    ("rare_characters", "junk", 0.07),
    ("code_tokens", "junk", 0.05),
    ("longest_run_log", "junk", 0.8),
    ("repetition", "junk", 0.10),
    ("unreadable", "junk", 0.02),
)
#: A squared distance beyond this is no prose: the 0.99 quantile of chi-square with a degree of freedom for each statistic.
LIMIT = 32.0
KINDS = ("list", "table", "junk")
#: Chinese common words up to this number are looked for one by one, more by the runs of the text; both count the same.
FEW_WORDS = 200
NAMES = tuple(s[0] for s in STATS)
LEAST = np.array([s[2] for s in STATS])

HAN_RUN = re.compile("[一-鿿㐀-䶿]+")
WORD = re.compile(r"[^\W\d_一-鿿㐀-䶿]+(?:['’-][^\W\d_一-鿿㐀-䶿]+)*")
SPACE = re.compile(r"\s+")
LATIN_RUN = re.compile("[A-Za-zÀ-ÿ]+")
SENTENCE_END = re.compile(r"[。！？!?…;；.:：][”’」』）)\"'\]]*$")
STOP = re.compile(r"[。！？；]|[.!?;](?=\s|$)")
#: An item's number or mark; initials of a speaker ("J. Smith:") are none.
ENUMERATED = re.compile(r"^(?!\s*(?:[A-Z]\.\s?)+[^\W\d_][\w'’-]*(?:\s[^\W\d_][\w'’-]*){0,2}\s*[:：])\s*(?:[（(\[【]?(?:\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[ivxIVX]{1,5}|[一二三四五六七八九十百甲乙丙丁]{1,4}|[①-⑳])(?:[）)\]】.、．:：]|\s*[-–]\s|,|\.?\s{1,4}(?=\S))|第[一二三四五六七八九十百\d]+[条章节项款]|[-*•·●▪◆■□◇◦‣–—+>☆★√✓→※]\s*|\d{1,2}月\d{1,2}日)\s*\S")
NUMBER_CELL = re.compile(r"^[\s$¥￥€(（-]*[+\-−]?\d[\d,.]*\s*(?:%|％|[A-Za-z亿万元倍x]{0,4})?[)）]?$|^(?:-+|—+|–|n/?a|N/?A|nan|null|/|\\|:?-{2,}:?|\s*)$")
#: Encoded text within a token, and dumps of bytes.
CODE = re.compile(r"0x[0-9A-Fa-f]+|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9A-F]{2}|&#\d+;|(?<![A-Za-z0-9])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![A-Za-z0-9])|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}|\[\d\d:\d\d:\d\d\]|ret=-?\d+;*")
HEX_DUMP = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{2}(?: [0-9a-fA-F]{2}){3,}(?![0-9A-Za-z])")
SYMBOL = re.compile(r"[#$%^&*_=+<>~`|\\@{}\[\]■□◇◆●○▲△▼▽★☆※→←↑↓�]")
LEADERS = re.compile(r"\.{4,}|…{2,}|·{4,}")
MARK_RUN = re.compile(r"([^\w\s])\1{3,}")
ASCII_LETTER = re.compile("[A-Za-z]")
DIGIT = re.compile(r"\d")
ENTRY = re.compile(r"[\n、;；/|,，]")
#: Signs of which a row has at least two, and the pattern that splits it.
SEPARATORS = tuple((signs, re.compile(p)) for signs, p in (("|│¦‖", r"[|│¦‖]"), ("\t", r"\t"), (("  ",), r" {2,}"), (";", r";"), (",", r",(?! )")))
MARK = re.compile(r"[|│¦‖\t; ,]")
#: Latin letters, digits and signs without a space
RUN_OR_TOKEN = re.compile(r"[!-~]{8,}")
#: Without one of these a text holds no encoded piece shorter than a token.
LEADS = re.compile(r"0x|\\[ux]|%[0-9A-F]|&#|\[\d\d:|ret=")
#: Scripts that have a prose of their own besides Chinese characters and Latin letters; kana and hangul tell Japanese and Korean from Chinese.
SCRIPTS = tuple((name, re.compile(f"[{r}]")) for name, r in (("ja", "ぁ-ヺ"), ("ko", "가-힣"), ("ru", "А-Яа-яЁёІіЇїЄє"), ("ar", "ء-ي"), ("el", "Α-Ωα-ωά-ώ"), ("he", "א-ת"), ("th", "ก-๎"), ("hi", "अ-ह")))


def language_of(text: str) -> str:
    """The language group, by the letters (the field of the table is partly wrong): zh, ja, ko, ru, ar, el, he, th, hi, or en for Latin letters."""
    han, latin = sum(map(len, HAN_RUN.findall(text))), sum(map(len, LATIN_RUN.findall(text)))
    if (han + latin) * 2 < len(text):
        for name, letters in SCRIPTS:
            n = len(letters.findall(text))
            if n > latin and (n * 8 > han if name in ("ja", "ko") else n > han):
                return name
    elif han > latin and (kana := len(SCRIPTS[0][1].findall(text))) and kana * 8 > han:
        return "ja"
    return "zh" if han * 4 >= latin else "en"


def common_letters(text: str, words: list[str]) -> int:
    """Letters of the text that stand in one of the words, each place and word counted."""
    if len(words) <= FEW_WORDS:
        return sum(text.count(w) * len(w) for w in words)
    known, out = set(words), 0
    for n in {len(w) for w in words}:
        last = -n
        seen: dict[str, int] = {}
        for i in range(len(text) - n + 1):
            w = text[i : i + n]
            if w in known and seen.get(w, last) <= i - n:
                seen[w] = i
                out += n
    return out


def _ranges(points: list[int]) -> str:
    """Body of a character class for sorted code points."""
    out, start = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            out.append(chr(start) if start == a else f"{chr(start)}-{chr(a)}")
            start = b
    return "".join(out)


def level_one(c: str) -> bool:
    """Whether a Chinese character is of the first level of GB 2312, the common ones."""
    try:
        return 0xB0 <= c.encode("gb2312")[0] <= 0xD7
    except UnicodeEncodeError:
        return False


#: Runs of rare characters and signs of garbled text; a name may hold one or two rare characters.
RARE = re.compile(f"[□■◇�{_ranges([n for n in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)) if not level_one(chr(n))])}]{{3,}}")
#: Signs of text decoded with the wrong table, and private or control characters.
UNREADABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x80-\xbfÀ-ÿ\ue000-\uf8ff\ufffd]")
READABLE_SIGNS = re.compile("[·°±²³µ»«§©®£¥¢]")


def _unreadable(text: str) -> float:
    n = len(UNREADABLE.findall(text)) - len(READABLE_SIGNS.findall(text)) if not text.isascii() else len(UNREADABLE.findall(text))
    if not n:
        return 0.0
    return n / len(text) if n * 8 > len(ASCII_LETTER.findall(text)) else n / len(text) / 4


def _repetition(text: str, width: int = 10, often: int = 5) -> float:
    """Share of the positions at which a run of ``width`` characters starts that stands ``often`` times or more in the text."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(h) - width + 1
    if n < often:
        return 0.0
    # hashes of runs of 1, 2, 4 ... characters, and of the whole width from two that overlap
    size = 1
    while size * 2 <= width:
        h = h[:-size] * np.uint64(pow(1_000_003, size, 1 << 64)) + h[size:]
        size *= 2
    if size < width:
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[width - size :]
    h.sort()
    ends = np.flatnonzero(np.append(h[1:] != h[:-1], True))
    counts = np.diff(ends, prepend=-1)
    return float(counts[counts >= often].sum()) / n


def cells_of(line: str) -> list[str]:
    """Cells of a row by the strongest separator that it holds; a row of numbers may be separated by single spaces. Prose is one cell."""
    x = line.strip()
    if not MARK.search(x) or LEADERS.search(x):
        return [x]
    for signs, separator in SEPARATORS:
        if sum(map(x.count, signs)) < 2:
            continue
        cells = separator.split(x.strip("|"))
        if len(cells) > 2 and max(map(len, cells := [c.strip() for c in cells])) <= 32 and sum(1 for c in cells if c and (any(map(str.isalnum, c)) or NUMBER_CELL.match(c))) >= 2:
            return cells
    if " " in x:
        cells = x.split(" ")
        if len(cells) > 2 and sum(1 for c in cells if NUMBER_CELL.match(c)) >= max(2, len(cells) - 4):
            return cells
    return [x]


def statistics(text: str, common: set[str], language: str | None = None, ideographic: list[str] | None = None) -> list[float]:
    """The statistics of one text that holds at least one character besides space; the language is told from the text and ``ideographic`` (the words of ``common`` that aren't ASCII) from ``common`` if they aren't given."""
    lines = [x for x in text.splitlines() if x.strip()]
    flat = SPACE.sub(" ", text).strip()
    chars = len(flat)
    dense = chars - flat.count(" ")
    # a Chinese character is a word, any other run of letters too
    han = sum(map(len, HAN_RUN.findall(flat)))
    others = WORD.findall(flat.lower())
    letters = sum(map(len, others))
    n_words = han + len(others)
    zh = (language or language_of(text)) in ("zh", "ja", "ko")
    hits = sum(1 for w in others if w in common)
    if zh:
        hits += common_letters(flat, [w for w in common if not w.isascii()] if ideographic is None else ideographic)
    share = hits / max(1, n_words)
    size = sum(map(len, lines))
    rows = [(len(x), r) for x in lines if len(r := cells_of(x)) > 2]
    widths = Counter(len(r) for _, r in rows)
    usual = sum(n for n, r in rows if widths[len(r)] >= 3) / size
    number_cells = sum(n for n, _ in rows) / size * sum(1 for _, r in rows for y in r if NUMBER_CELL.match(y)) / max(1, sum(len(r) for _, r in rows)) if rows else 0.0
    enum = sum(len(x) for x in lines if ENUMERATED.match(x)) / size
    entries = [y for y in ENTRY.split(text) if y.strip()]
    stops = len(STOP.findall(text))
    short = sum(1 for y in entries if len(y.strip()) <= (14 if zh else 34)) / len(entries)
    tokens = RUN_OR_TOKEN.findall(flat)
    code = sum(map(len, HEX_DUMP.findall(text))) + sum(len(m) for t in ([flat] if LEADS.search(flat) else tokens) for m in CODE.findall(t))
    plain = MARK_RUN.sub("", flat)
    bare = sum(len(x.replace(" ", "")) for x in lines if not any(map(str.isalnum, x)))
    return [
        math.log1p(n_words),
        min(30.0, (han + letters) / max(1, n_words) if not zh else 1 + (letters - len(others)) / max(1, n_words) / 2),
        max(bare, len(SYMBOL.findall(text))) / dense,
        len(DIGIT.findall(flat)) / max(1, dense),
        sum(1 for x in lines if SENTENCE_END.search(x.rstrip()[-8:])) / len(lines),
        share,
        math.log(1 + min(3000.0, chars / (stops + 1)) / (1 if zh else 3)),
        usual,
        number_cells,
        enum if len(lines) > 2 else 0.0,
        short * (1 if len(entries) > 5 else len(entries) / 6),
        sum(map(len, RARE.findall(text))) / max(1, n_words),
        code / chars,
        math.log1p(max(map(len, tokens), default=0)),
        _repetition(plain),
        _unreadable(text),
    ]


def _stats_frame(documents: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    words = {r[0] for r in common.select(F.lower("word")).filter("word is not null and word <> ''").distinct().collect()}
    ideographic = sorted(w for w in words if not w.isascii())
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            languages = [language_of(t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "language": languages, "x": [statistics(t, words, lang, ideographic) for t, lang in zip(b["t"], languages)]})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null").filter(F.col("t").rlike(r"[^\p{Z}\s]"))
    return rows.mapInPandas(run, f"k {kind}, language string, x array<double>")


def text_statistics(documents: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, and a column for each statistic) of every document.

    Defined cases: rows with a null key or text, or with nothing but space, give no row; repeated rows give repeated rows; further columns are ignored.
    """
    stats = _stats_frame(documents, key, text, common)
    return stats.select(F.col("k").alias(key), "language", *(F.col("x")[i].alias(n) for i, n in enumerate(NAMES)))


def _moments(stats: DataFrame, center: dict[str, tuple[np.ndarray, np.ndarray]], limit: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Per language the number, sum and sum of products of the rows within ``limit`` of the center; summed in partitions, then by position."""
    k = len(NAMES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        for b in batches:
            for lang, rows in b.groupby("language"):
                x = np.stack(rows["x"].to_numpy())
                mu, inverse = center[lang]
                d = x - mu
                d = x[np.einsum("ij,jk,ik->i", d, inverse, d) <= limit]
                own = sums.setdefault(lang, [0.0, np.zeros(k), np.zeros((k, k))])
                own[0] += len(d)
                own[1] += d.sum(0)
                own[2] += d.T @ d
        for lang, (n, s, p) in sums.items():
            flat = np.concatenate([[n], s, p.ravel()])
            yield pd.DataFrame({"language": lang, "i": np.arange(len(flat)), "v": flat})

    out: dict[str, np.ndarray] = {}
    for lang, i, v in stats.mapInPandas(partial, "language string, i int, v double").groupBy("language", "i").agg(F.sum("v")).collect():
        out.setdefault(lang, np.zeros(1 + k + k * k))[i] = v
    return {lang: (a[0], a[1 : k + 1], a[k + 1 :].reshape(k, k)) for lang, a in out.items()}


def fit_prose(stats: DataFrame, rounds: int = 4, limit: float = LIMIT) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the mean and the inverse covariance of natural prose over all rows of ``stats`` (k, language, x).

    Starts at the medians and median absolute deviations; each round takes mean and covariance of the rows within ``limit`` (a squared distance),
    so outliers lose their influence. The least spreads are added to the variances: a statistic that is constant in prose still has a scale.
    """
    columns = [F.percentile_approx(F.col("x")[i], 0.5, 10_000).alias(f"m{i}") for i in range(len(NAMES))]
    medians = {r["language"]: np.array([r[f"m{i}"] for i in range(len(NAMES))]) for r in stats.groupBy("language").agg(*columns).collect()}
    if not medians:
        return {}
    middle = F.lit(None).cast("array<double>")
    for lang, m in medians.items():
        middle = F.when(F.col("language") == lang, F.array(*map(F.lit, m.tolist()))).otherwise(middle)
    spread = stats.select("language", F.zip_with("x", middle, lambda a, b: F.abs(a - b)).alias("x"))
    deviations = {r["language"]: np.array([r[f"m{i}"] for i in range(len(NAMES))]) for r in spread.groupBy("language").agg(*columns).collect()}
    center = {lang: (m, np.diag(1 / np.maximum(LEAST, 1.4826 * deviations[lang]) ** 2)) for lang, m in medians.items()}
    for _ in range(rounds):
        moved = 0.0
        for lang, (n, s, p) in _moments(stats, center, limit).items():
            if n > 1:
                mu = s / n
                moved = max(moved, float(np.abs((mu - center[lang][0]) / LEAST).max()))
                center[lang] = (mu, np.linalg.inv(p / n - np.outer(mu, mu) + np.diag(LEAST**2)))
        if moved < 0.01:
            break
    return center


def prose_distance(documents: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The squared robust Mahalanobis distance of each document from the prose of its language, with each statistic's contribution.

    A document farther than ``limit`` is no natural prose. Its kind is the one to which most of the distance is due: the contributions of the statistics that point to a kind and lie above
    prose are summed for each kind. A document that is far for another reason, with nothing above prose, counts as junk.

    Defined cases: as in ``text_statistics``; the language is told from the letters, since the field may be null or wrong; a language with
    one document has that document as its prose. Mean and covariance come from all rows; only they (a few hundred numbers) reach the driver.

    Returns key, language, distance, contributions (map of statistic to share of the distance), kind (prose, list, table or junk).
    """
    stats = cut_lineage(_stats_frame(documents, key, text, common))
    center = fit_prose(stats, limit=limit)
    kinds = np.array([s[1] for s in STATS])
    type_of = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, rows in b.groupby("language"):
                d = np.stack(rows["x"].to_numpy()) - center[lang][0]
                parts = d * (d @ center[lang][1])
                distance = parts.sum(1)
                due = np.stack([np.where(d > 0, parts, 0.0)[:, kinds == k].sum(1) for k in KINDS], 1)
                kind = np.where(distance > limit, np.where(due.max(1) > 0, np.array(KINDS)[due.argmax(1)], "junk"), "prose")
                yield pd.DataFrame({key: rows["k"], "language": lang, "distance": distance, "contributions": [dict(zip(NAMES, p)) for p in parts.tolist()], "kind": kind})

    return stats.mapInPandas(run, f"`{key}` {type_of}, language string, distance double, contributions map<string,double>, kind string")
