"""Cleaning of ordered layout blocks. Order is (pdf_file, block_idx); the blocks of one document are read in one task, rows of no document in none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage
from quarryline.functions.text import strip_u

# Fixed values of the block rules.
TRIVIAL_TYPES = ("footer", "page_number", "header")
MIN_TEXT = 12
RUNNER_SHARE, RUNNER_LENGTH = 0.5, 50
DISCLAIMERS = (
    "免责声明", "分析师声明", "分析师承诺", "证券分析师承诺", "法律声明", "特别声明", "重要声明", "一般声明", "合规声明", "风险提示及免责声明", "重要免责声明", "评级说明", "评级定义", "行业评级体系", "公司投资评级",
    "股票评级", "行业评级", "投资评级", "投资者适当性", "投资者适当性匹配", "分析师简介", "分析师介绍", "研究员简介", "研究员介绍", "Disclaimer", "Disclosure", "Ratings Definitions", "Analyst Stock Ratings",
)
#: A line of a table of contents: a title with dots, a numbered title with a page, or the heading.
TOC_DOTTED = r"^.{2,40}?\s*[\.…·\s]{3,}\s*\d{1,3}\s*$"
TOC_NUMBERED = r"^(\d+[\.、]?|[一二三四五六七八九十]、|[IVX]+\.?)\s*.{2,40}?\s+\d{1,3}\s*$"
TOC_HEADING = r"^(目录|插图目录|表格目录|图表目录|附录|Contents)$"
TOC = f"(?U){TOC_DOTTED}|{TOC_NUMBERED}|{TOC_HEADING}"
SENTENCE_END = "。！？!?；;\"'」』】)）》〉〕"
BROKEN_TAIL = "，、：:,\"'“（(《〈〔-—"
BROKEN_HEAD = "0123456789,，.。;；:：)）】'']」}》〉〕%"
CAPTION = r"(?U)^(图\s*\d+|表\s*\d+|Figure\s*\d+|Table\s*\d+|资料来源|数据来源)[:：\s]"
AUTHOR = r"(?U)^(分析师|研究员|联系人|证券分析师|首席分析师)\s*[:：]\s*\S{2,6}$"
#: A contact line after an author: a telephone number, an address, a certificate's number, a labelled entry, or a label alone.
CONTACT_NUMBER = r"^[\d\-\s()（）]{7,25}[\s一-鿿]*$"
CONTACT_MAIL = r"^[\w\.\-\+]+@[\w\.\-]+$"
CONTACT_SAC = r"^SAC\s*(执业证书)?.{0,6}$"
CONTACT_CERTIFICATE = r"^S\d{10,}$"
CONTACT_ENTRY = r"^(电话|邮箱|执业证书|登记编号|手机|地址|电子邮箱)\s*[:：]\s*.*$"
CONTACT_LABEL = r"^(电话|邮箱|SAC|联系方式)\s*[:：]?\s*$"
CONTACT = f"(?U){CONTACT_NUMBER}|{CONTACT_MAIL}|{CONTACT_SAC}|{CONTACT_CERTIFICATE}|{CONTACT_ENTRY}|{CONTACT_LABEL}"
NOT_A_SECTION = r"(?U)^(分析师|研究员|联系人|证券分析师|首席分析师)\s*[:：]\s*\S{2,6}$|^(强烈推荐|买入|增持|中性|回避|卖出)|^\d{4}\s*年\s*\d{1,2}\s*月"


def _order() -> WindowSpec:
    return Window.partitionBy("pdf_file").orderBy("block_idx", "block_id")


def _so_far() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def in_order(blocks: DataFrame) -> DataFrame:
    """Blocks once each, of a document; repeated rows and rows without file or position are left out."""
    return blocks.filter("pdf_file is not null and block_idx is not null").dropDuplicates(["pdf_file", "block_idx", "block_id"])


def body_text() -> Column:
    """Trimmed text, empty for null."""
    return strip_u(F.coalesce("text", F.lit("")))


def drop_trivial(blocks: DataFrame) -> DataFrame:
    """Without headers, footers and page numbers."""
    return blocks.filter(F.coalesce(~F.col("block_type").isin(*TRIVIAL_TYPES), F.lit(True)))


def drop_short(blocks: DataFrame, least: int = MIN_TEXT) -> DataFrame:
    """Without text blocks of no level with fewer than ``least`` characters."""
    return blocks.filter(~F.coalesce((F.col("block_type") == "text") & F.col("text_level").isNull() & (F.length(body_text()) < least), F.lit(False)))


def page_counts(blocks: DataFrame) -> DataFrame:
    """(pdf_file, _pages): the largest page index and one."""
    return blocks.groupBy("pdf_file").agg((F.max("page_idx") + 1).alias("_pages"))


def drop_runners(blocks: DataFrame, share: float = RUNNER_SHARE, longest: int = RUNNER_LENGTH, pages: DataFrame | None = None) -> DataFrame:
    """Without short texts that stand on at least ``max(2, int(pages * share))`` pages of their document (none for one page). ``pages`` are counts from before other rules took blocks away."""
    pages = page_counts(blocks) if pages is None else pages
    short = (F.col("block_type") == "text") & F.col("text_level").isNull() & (F.length("_t") > 0) & (F.length("_t") <= longest)
    rows = blocks.withColumn("_t", body_text())
    seen = rows.filter(short).groupBy("pdf_file", "_t").agg(F.count_distinct("page_idx").alias("_on")).join(pages, "pdf_file")
    runners = seen.filter((F.col("_pages") >= 2) & (F.col("_on") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * share)))).select("pdf_file", "_t", F.lit(True).alias("_runner"))
    return rows.join(runners, ["pdf_file", "_t"], "left").filter(~(F.coalesce("_runner", F.lit(False)) & F.coalesce(short, F.lit(False)))).drop("_t", "_runner")


def drop_authors(blocks: DataFrame, reach: int = 8) -> DataFrame:
    """Without an author's line and the contact lines within ``reach`` positions after it, up to the first other text."""
    text = F.when(F.col("block_type") == "text", body_text())
    rows = blocks.withColumn("_at", F.row_number().over(_order())).withColumn("_t", text)
    anchor = F.when(F.col("_t").rlike(AUTHOR), F.col("_at"))
    other = F.when((F.col("_t") != "") & ~F.col("_t").rlike(AUTHOR) & ~F.col("_t").rlike(CONTACT), F.col("_at"))
    rows = rows.withColumn("_anchor", F.last(anchor, True).over(_so_far())).withColumn("_other", F.last(other, True).over(_so_far()))
    contact = F.col("_t").rlike(CONTACT) & (F.col("_t") != "") & (F.col("_anchor") > F.coalesce("_other", F.lit(0))) & (F.col("_at") - F.col("_anchor") <= reach)
    return rows.filter(~F.coalesce(F.col("_t").rlike(AUTHOR) | contact, F.lit(False))).drop("_at", "_t", "_anchor", "_other")


def cut_disclaimer(blocks: DataFrame, share: float = 0.5, pages: DataFrame | None = None) -> DataFrame:
    """Without everything from the first heading with a disclaimer's word in the later pages on. ``pages`` are counts from before other rules took blocks away."""
    words = F.array(*map(F.lit, DISCLAIMERS))
    hit = (F.col("text_level") == 1) & F.exists(words, lambda w: F.contains(body_text(), w)) & (F.col("page_idx") >= F.floor(F.col("_pages") * share))
    cut = F.min(F.when(hit, F.col("block_idx"))).over(Window.partitionBy("pdf_file"))
    rows = blocks.withColumn("_pages", F.max("page_idx").over(Window.partitionBy("pdf_file")) + 1) if pages is None else blocks.join(pages, "pdf_file", "left")
    rows = rows.withColumn("_cut", cut)
    return rows.filter(F.col("_cut").isNull() | (F.col("block_idx") < F.col("_cut"))).drop("_pages", "_cut")


def drop_contents(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Without runs of at least ``least`` lines of a table of contents, with the blanks and lists in and after them."""
    text = (F.col("block_type") == "text") & body_text().rlike(TOC)
    filler = (F.col("block_type") == "list") | ((F.col("block_type") == "text") & (body_text() == ""))
    rows = blocks.withColumn("_toc", F.coalesce(text, F.lit(False))).withColumn("_break", ~F.col("_toc") & ~F.coalesce(filler, F.lit(False)))
    rows = rows.withColumn("_island", F.sum(F.col("_break").cast("int")).over(_so_far()))
    island = Window.partitionBy("pdf_file", "_island")
    rows = rows.withColumn("_lines", F.sum(F.col("_toc").cast("int")).over(island)).withColumn("_first", F.min(F.when(F.col("_toc"), F.col("block_idx"))).over(island))
    return rows.filter(F.col("_break") | (F.col("_lines") < least) | (F.col("block_idx") < F.col("_first"))).drop("_toc", "_break", "_island", "_lines", "_first")


def attach_captions(blocks: DataFrame, longest: int = 80) -> DataFrame:
    """Caption lines moved to the table right before them: (…, captions, sources); their own rows go."""
    text = body_text()
    before = F.lag("block_type").over(_order())
    rows = blocks.withColumn("_caption", (F.col("block_type") == "text") & F.col("text_level").isNull() & (F.length(text) > 0) & (F.length(text) <= longest) & text.rlike(CAPTION) & before.isin("image", "chart", "table"))
    rows = rows.withColumn("_next", F.lead("_caption").over(_order())).withColumn("_next_text", F.lead(text).over(_order()))
    source = F.col("_next_text").rlike("^(资料来源|数据来源)")
    rows = rows.withColumn("captions", F.when(F.col("_next") & ~source, F.col("_next_text"))).withColumn("sources", F.when(F.col("_next") & source, F.col("_next_text")))
    return rows.filter(~F.coalesce("_caption", F.lit(False))).drop("_caption", "_next", "_next_text")


def _chains(blocks: list) -> list[tuple]:
    """(block_idx, page_idx, text, parts, block_id) of the plain texts among ordered blocks (at, id, page, text, plain), broken ones joined; in one pass."""
    out: list[list] = []
    for b in blocks:
        head, prior = b["text"].strip(), out[-1] if out else None
        if prior and prior[5] and b["plain"] and head:
            tail = prior[2][-1].strip()
            last = tail[-1:]
            if tail and last not in SENTENCE_END and (last in BROKEN_TAIL or head[0] in BROKEN_HEAD) and (b["page"] or 0) - (prior[1] or 0) <= 1:
                prior[2][-1] = prior[2][-1].rstrip()
                prior[2].append(b["text"].lstrip())
                continue
        out.append([b["at"], b["page"], [b["text"]], 0, b["id"], b["plain"]])
    return [(at, page, "".join(parts), len(parts), i) for at, page, parts, _, i, plain in out if plain]


def merge_broken(blocks: DataFrame) -> DataFrame:
    """Texts that a page's or column's end cut in two joined again: (pdf_file, block_idx, page_idx, text, n_parts, block_id) of the text blocks.

    A block joins the chain before it if that ends with no end of a sentence, it goes on by the last or first character, and it stands at most one page
    after the chain's first block. The page rule looks back to the chain's head, so the blocks of a document are read in order, once, in Arrow batches.
    """
    body = F.struct(F.col("block_idx").alias("at"), F.col("block_id").alias("id"), F.col("page_idx").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce((F.col("block_type") == "text") & F.col("text_level").isNull(), F.lit(False)).alias("plain"))
    docs = blocks.groupBy("pdf_file").agg(F.array_sort(F.collect_list(body)).alias("bs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *x) for k, bs in zip(b["pdf_file"], b["bs"]) for x in _chains(list(bs))]
            yield pd.DataFrame(rows, columns=["pdf_file", "block_idx", "page_idx", "text", "n_parts", "block_id"]).astype({"page_idx": "Int32"})

    return docs.mapInPandas(run, f"pdf_file string, block_idx int, page_idx int, text string, n_parts int, block_id {blocks.schema['block_id'].dataType.simpleString()}")


def strip_quotes(c: Column) -> Column:
    """Without quote marks at line starts."""
    return F.regexp_replace(c, r"(?m)^[\s]*>[ \t]*", "")


def repair_digits(c: Column) -> Column:
    """o and O between digits as 0, then l and I as 1."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d)[oO](?=\d)", "0"), r"(?<=\d)[lI](?=\d)", "1")


def join_broken(blocks: DataFrame) -> DataFrame:
    """The blocks with broken texts joined: the first block of a chain holds its text, the others go."""
    blocks = cut_lineage(blocks)
    merged = merge_broken(blocks).select("pdf_file", "block_idx", "block_id", F.col("text").alias("_text"))
    plain = F.coalesce((F.col("block_type") == "text") & F.col("text_level").isNull(), F.lit(False))
    rows = blocks.join(merged, ["pdf_file", "block_idx", "block_id"], "left").filter(~plain | F.col("_text").isNotNull())
    return rows.withColumn("text", F.when(plain & F.col("text").isNotNull(), F.col("_text")).otherwise(F.col("text"))).drop("_text")


#: The rules in their fixed order: name, and the rule given blocks and the page counts from before them.
RULES = (
    ("trivial", lambda b, p: drop_trivial(b)), ("authors", lambda b, p: drop_authors(b)), ("short", lambda b, p: drop_short(b)), ("runners", lambda b, p: drop_runners(b, pages=p)), ("disclaimer", lambda b, p: cut_disclaimer(b, pages=p)),
    ("contents", lambda b, p: drop_contents(b)), ("broken", lambda b, p: join_broken(b)), ("captions", lambda b, p: attach_captions(b)),
)


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """All rules in their fixed order: quote marks, types, authors, short texts, runners, disclaimers, contents, broken texts, captions, digits. Pages are counted before any block goes."""
    rows = in_order(blocks)
    pages = page_counts(rows)
    rows = rows.withColumn("text", strip_quotes(F.col("text")))
    for _, rule in RULES:
        rows = rule(rows, pages)
    return rows.withColumn("text", repair_digits(F.col("text"))).withColumn("table_body", repair_digits(F.col("table_body")))


def cleaning_summary(blocks: DataFrame) -> DataFrame:
    """(step, rule, n_before, n_removed, share): how many blocks each rule of the sequence takes away; each is counted after the rules before it, which are written once."""
    rows = in_order(blocks)
    pages, out = page_counts(rows), None
    rows = cut_lineage(rows.withColumn("text", strip_quotes(F.col("text"))))
    for i, (name, rule) in enumerate(RULES):
        after = cut_lineage(rule(rows, pages))
        own = rows.agg(F.count(F.lit(1)).alias("n_before")).join(after.agg(F.count(F.lit(1)).alias("n_after")))
        own = own.select(F.lit(i).alias("step"), F.lit(name).alias("rule"), "n_before", (F.col("n_before") - F.col("n_after")).alias("n_removed"), F.coalesce(F.round(F.try_divide(F.col("n_before") - F.col("n_after"), F.col("n_before")), 6), F.lit(0.0)).alias("share"))
        out, rows = own if out is None else out.unionByName(own), after
    return out


def sections(blocks: DataFrame) -> DataFrame:
    """(pdf_file, section_no, title, page_idx, text): body texts between level-1 headings, joined by blank lines; headings without body give none."""
    rows = blocks.filter("block_type = 'text'").withColumn("_t", body_text()).filter("_t <> ''").withColumn("_head", F.coalesce(F.col("text_level") == 1, F.lit(False)))
    rows = rows.withColumn("_group", F.sum(F.col("_head").cast("int")).over(_so_far()))
    body = F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("block_idx", "block_id", "page_idx", "_t"))))
    made = rows.groupBy("pdf_file", "_group").agg(F.max(F.when(F.col("_head"), F.col("_t"))).alias("title"), body.alias("_body")).filter(F.size("_body") > 0)
    made = made.withColumn("section_no", F.row_number().over(Window.partitionBy("pdf_file").orderBy("_group")) - 1)
    return made.select("pdf_file", "section_no", F.coalesce("title", F.lit("")).alias("title"), F.col("_body")[0]["page_idx"].alias("page_idx"), F.array_join(F.transform("_body", lambda b: b["_t"]), "\n\n").alias("text"))


def is_real_title(c: Column) -> Column:
    """Whether a heading is a section's: not an author, a rating, a date, or too short."""
    t = strip_u(F.coalesce(c, F.lit("")))
    return (F.length(t) >= 3) & ~t.rlike(NOT_A_SECTION)


def tables_in_sections(blocks: DataFrame) -> DataFrame:
    """(pdf_file, table_no, block_idx, section, table_body): non-empty tables, numbered from 1, with the last real heading before them."""
    heading = F.when((F.col("block_type") == "text") & (F.col("text_level") == 1) & is_real_title(F.col("text")), body_text())
    rows = blocks.withColumn("section", F.last(heading, True).over(_so_far())).filter("block_type = 'table' and table_body is not null and table_body <> ''")
    return rows.select("pdf_file", F.row_number().over(_order()).alias("table_no"), "block_idx", F.coalesce("section", F.lit("")).alias("section"), "table_body")
