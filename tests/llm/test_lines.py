"""Repeated lines against brute force."""

import random
import re
from collections import defaultdict

from conftest import rows

from quarryline.llm.repeated_lines import line_templates, placed_lines, repeated_lines, without_repeated_lines

BLOCKS = "block_id long, pdf_file string, block_type string, text_level int, text string, source string, page_idx int"
CHUNKS = "pdf_file string, institution string, text string"


def key(line):
    return "".join(re.findall(r"[^\W\d_]", "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in line))).lower()


def brute(blocks, chunks):
    inst = {p: i for p, i, _ in chunks if p and i}
    pdfs, where = defaultdict(set), defaultdict(set)
    for b, p, kind, level, text, *_ in blocks:
        if p in inst:
            pdfs[inst[p]].add(p)
    lines = set()
    for b, p, kind, level, text, *_ in blocks:
        if kind == "text" and level is None and text is not None and p in inst and b is not None:
            for n, line in enumerate(text.split("\n"), 1):
                k = key(line)
                if len(k) >= 8:
                    lines.add((b, n, inst[p], k))
                    where[inst[p], k].add(p)
    return sorted({(b, n) for b, n, i, k in lines if len(where[i, k]) >= 3 and 5 * len(where[i, k]) >= len(pdfs[i])}, key=repr)


def example(seed=0):
    r = random.Random(seed)
    common = ["本资料仅供客户参考请勿外传", "Please do not forward, page {}", "长按二维码关注我们每日更新！", "short"]
    blocks, chunks = [], []
    for i in range(60):
        pdf, inst = f"{i}.pdf", r.choice(["A", "A", "A", "B", "C"])
        chunks += [(pdf, None, "x"), (pdf, inst, "x")]
        for j in range(3):
            text = "\n".join(r.choice(common).format(r.randrange(9)) if r.random() < 0.4 else f"正文第{r.randrange(999)}句说明各家公司情况{r.choice('甲乙丙丁戊己')}{r.choice('子丑寅卯')}" for _ in range(3))
            blocks.append((i * 10 + j, pdf, "text", r.choice([None, None, 1]), text.upper() if r.random() < 0.3 else text, "s", 0))
    blocks += blocks[:5] + [(None, "1.pdf", "text", None, common[0], "s", 0), (9_001, None, "text", None, common[0], "s", 0), (9_002, "1.pdf", "text", None, None, "s", 0), (9_003, "1.pdf", "text", None, "", "s", 0), (9_004, "none.pdf", "text", None, common[0], "s", 0)]
    return blocks, chunks


def test_against_brute_force(spark):
    for seed in range(3):
        blocks, chunks = example(seed)
        found = repeated_lines(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(chunks, CHUNKS))
        assert sorted({(r.block_id, r.line_no) for r in found.collect()}, key=repr) == brute(blocks, chunks)


def test_clean_text(spark):
    blocks, chunks = example()
    b, c = spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(chunks, CHUNKS)
    gone = defaultdict(set)
    for i, n in brute(blocks, chunks):
        gone[i].add(n)
    want = {x[0]: x[4] if x[4] is None else "\n".join(t for n, t in enumerate(x[4].split("\n"), 1) if n not in gone[x[0]]) for x in blocks if x[0] is not None}
    assert dict(map(tuple, without_repeated_lines(b, repeated_lines(b, c)).collect())) == want


def leaf_spec(keys):
    """The template of a leaf's lines, by looking at all of them at once."""
    lo, n = min(keys), min(map(len, keys))
    if len(keys) == 1:
        return lo
    lead = next(i for i in range(n + 1) if i == n or len({k[i] for k in keys}) > 1)
    trail = next(i for i in range(n - lead + 1) if i == n - lead or len({k[-1 - i] for k in keys}) > 1)
    middle = "".join(next(iter(c)) if len(c) == 1 else "*" for c in map(set, zip(*(k[lead : len(k) - trail] for k in keys)))) if len(set(map(len, keys))) == 1 else "*"
    return lo[:lead] + re.sub(r"[*]+", "*", middle) + lo[len(lo) - trail :]


def test_templates_match_all_their_lines_however_they_are_partitioned(spark):
    for seed in range(3):
        blocks, chunks = example(seed)
        b, c = spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(chunks, CHUNKS)
        one = rows(line_templates(placed_lines(b.repartition(1), c)))
        assert one == rows(line_templates(placed_lines(b.repartition(7), c))) and one
        leaves = defaultdict(set)
        for r in placed_lines(b, c).collect():
            leaves[r.source, r.path].add(r.key)
        for source, path, template, lead, trail, *_ in one:
            keys = leaves[source, path]
            assert template == leaf_spec(keys)
            form = re.compile(".*".join(map(re.escape, template.split("*"))))
            assert all(form.fullmatch(k) and lead + trail <= len(k) for k in keys)


def templates_of(spark, lines, chunks=None):
    b = spark.createDataFrame([(i, f"{i}.pdf", "text", None, line, "s", 0) for i, line in enumerate(lines)], BLOCKS)
    c = spark.createDataFrame([(f"{i}.pdf", "A", "x") for i in range(len(lines))], CHUNKS)
    return [r.template for r in line_templates(placed_lines(b, c)).collect()], repeated_lines(b, c)


def test_wildcards_and_empty(spark):
    got, found = templates_of(spark, [f"风险提示请关注公司{c}的公告内容" for c in "甲乙丙"])
    assert got == ["风险提示请关注公司*的公告内容"] and found.count() == 0
    # slots of unlike length meet in one template, and a place in which the least and the greatest line agree is no constant if a third differs
    assert templates_of(spark, [f"风险提示请关注{c}的公告内容" for c in ("甲", "乙公司", "丙股份有限")])[0] == ["风险提示请关注*的公告内容"]
    assert templates_of(spark, ["甲甲甲甲甲甲子丑丁终终", "甲甲甲甲甲甲寅卯丁终终", "甲甲甲甲甲甲辰丑丁终终"])[0] == ["甲甲甲甲甲甲*丁终终"]
    assert templates_of(spark, ["甲甲甲甲甲甲子丁丑终终", "甲甲甲甲甲甲寅丁卯终终", "甲甲甲甲甲甲辰丁丑终终"])[0] == ["甲甲甲甲甲甲*丁*终终"]
    b, c = spark.createDataFrame([], BLOCKS), spark.createDataFrame([], CHUNKS)
    assert repeated_lines(b, c).count() == 0
