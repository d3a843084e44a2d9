"""Queries over layout blocks, sections and tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import blocks as B
from quarryline.operators import chunking
from quarryline.sources import read_table


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return B.in_order(read_table(spark, root, "content_list"))


def runner_free_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks without texts that most pages of their document repeat."""
    return B.drop_runners(_blocks(spark, root)).select("block_id")


def body_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of a type that carries text and of enough length."""
    return B.drop_short(B.drop_trivial(_blocks(spark, root))).select("block_id")


def before_disclaimer(spark: SparkSession, root: str) -> DataFrame:
    """Blocks before the disclaimer of their document."""
    return B.cut_disclaimer(_blocks(spark, root)).select("block_id")


def without_contents(spark: SparkSession, root: str) -> DataFrame:
    """Blocks outside tables of contents."""
    return B.drop_contents(_blocks(spark, root)).select("block_id")


def without_authors(spark: SparkSession, root: str) -> DataFrame:
    """Blocks without authors' lines and contacts."""
    return B.drop_authors(_blocks(spark, root)).select("block_id")


def merged_texts(spark: SparkSession, root: str) -> DataFrame:
    """Body texts that a break cut in two, joined."""
    return B.merge_broken(_blocks(spark, root))


def captioned_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Tables with the caption line after them."""
    return B.attach_captions(_blocks(spark, root)).filter("captions is not null or sources is not null").select("block_id", "captions", "sources")


def cleaned_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks after all rules."""
    return B.clean_blocks(read_table(spark, root, "content_list")).select("block_id", "block_type", "text", "table_body")


def cleaning_summary(spark: SparkSession, root: str) -> DataFrame:
    """What each rule of the cleaning takes away."""
    return B.cleaning_summary(read_table(spark, root, "content_list"))


def repaired_digits(spark: SparkSession, root: str) -> DataFrame:
    """Texts in which letters between digits are digits."""
    rows = _blocks(spark, root).filter("text is not null")
    return rows.select("block_id", B.repair_digits(F.col("text")).alias("fixed"), "text").filter("fixed <> text").select("block_id", "fixed")


def document_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections by level-1 headings."""
    return B.sections(_blocks(spark, root))


def section_windows(spark: SparkSession, root: str) -> DataFrame:
    """Sections in fixed windows."""
    return chunking.fixed_windows(document_sections(spark, root), ["pdf_file", "section_no"])


def section_tables(spark: SparkSession, root: str) -> DataFrame:
    """Tables with the section that they stand in."""
    return B.tables_in_sections(_blocks(spark, root)).select("pdf_file", "table_no", "block_idx", "section")


def markdown_tables(spark: SparkSession, root: str) -> DataFrame:
    """Table bodies as markdown."""
    rows = read_table(spark, root, "content_list").filter("table_body is not null and table_body <> ''").select("block_id", "table_body").distinct()
    return rows.select("block_id", chunking.markdown_table("table_body").alias("markdown"))


def html_table_facts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of HTML tables as pairs of header and value."""
    return chunking.table_facts(read_table(spark, root, "content_list").filter("table_body like '%<t%'"), "block_id", "table_body")


def table_packs(spark: SparkSession, root: str) -> DataFrame:
    """Markdown tables in packs of rows under their header."""
    return chunking.packed_rows(markdown_tables(spark, root), ["block_id"], "markdown")


def table_runs(spark: SparkSession, root: str) -> DataFrame:
    """Texts cut into tables and prose."""
    return chunking.markdown_runs(read_table(spark, root, "documents"), ["doc_id"]).select("doc_id", "block_no", "kind", F.length("content").alias("n_chars"))


def residue_free_texts(spark: SparkSession, root: str) -> DataFrame:
    """Full-text chunks without remains of markup and boilerplate."""
    rows = read_table(spark, root, "all_chunks").filter("source_type = 'report_fulltext' and text is not null").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", chunking.residue_free(F.col("text")).alias("text"))


def noise_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of documents that are page furniture, by document."""
    lines = read_table(spark, root, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(chunking.is_noise_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_noise"))


def text_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Valid paragraphs of documents."""
    return chunking.paragraphs(read_table(spark, root, "documents"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        runner_free_blocks, body_blocks, before_disclaimer, without_contents, without_authors, merged_texts, captioned_blocks, cleaned_blocks, cleaning_summary, repaired_digits, document_sections, section_windows, section_tables, markdown_tables, html_table_facts, table_packs, table_runs,
        residue_free_texts, noise_lines, text_paragraphs,
    )
}

_B = r"""
WITH b AS (SELECT DISTINCT block_id, pdf_file, block_idx, block_type, text, text_level, page_idx, table_body, regexp_replace(coalesce(text, ''), '^[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g') AS t FROM content_list WHERE pdf_file IS NOT NULL AND block_idx IS NOT NULL)
"""
#: The forms of a table of contents for an engine without Unicode white space.
_TOC_SQL = B.TOC[4:]
SQL = {
    "runner_free_blocks": _B
    + ", s AS (SELECT *, block_type = 'text' AND text_level IS NULL AND length(t) BETWEEN 1 AND 50 AS short, max(page_idx) OVER (PARTITION BY pdf_file) + 1 AS pages FROM b), n AS (SELECT pdf_file, t, count(DISTINCT page_idx) AS n, any_value(pages) AS pages FROM s WHERE short GROUP BY 1, 2) SELECT block_id FROM s LEFT JOIN n USING (pdf_file, t) WHERE NOT (coalesce(short, false) AND n.n IS NOT NULL AND n.pages >= 2 AND n.n >= greatest(2, floor(n.pages * 0.5)))",
    "body_blocks": _B + "SELECT block_id FROM b WHERE (block_type IS NULL OR block_type NOT IN ('footer', 'page_number', 'header')) AND NOT coalesce(block_type = 'text' AND text_level IS NULL AND length(t) < 12, false)",
    "before_disclaimer": _B
    + ", p AS (SELECT *, max(page_idx) OVER (PARTITION BY pdf_file) + 1 AS pages FROM b), c AS (SELECT pdf_file, min(block_idx) AS cut FROM p WHERE text_level = 1 AND page_idx >= floor(pages * 0.5) AND list_bool_or(list_transform(["
    + ", ".join(f"'{w}'" for w in B.DISCLAIMERS)
    + "], lambda w: contains(t, w))) GROUP BY 1) SELECT block_id FROM b LEFT JOIN c USING (pdf_file) WHERE cut IS NULL OR block_idx < cut",
    "document_sections": _B
    + ", x AS (SELECT *, coalesce(text_level = 1, false) AS head FROM b WHERE block_type = 'text' AND t <> ''), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id ROWS UNBOUNDED PRECEDING) AS grp FROM x), a AS (SELECT pdf_file, grp, max(t) FILTER (head) AS title, arg_min(page_idx, block_idx) FILTER (NOT head) AS page_idx, string_agg(t, chr(10) || chr(10) ORDER BY block_idx, block_id) FILTER (NOT head) AS text, count(*) FILTER (NOT head) AS n FROM g GROUP BY 1, 2) SELECT pdf_file, row_number() OVER (PARTITION BY pdf_file ORDER BY grp) - 1 AS section_no, coalesce(title, '') AS title, page_idx, text FROM a WHERE n > 0",
    "section_windows": _B
    + r", x AS (SELECT *, coalesce(text_level = 1, false) AS head FROM b WHERE block_type = 'text' AND t <> ''), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id ROWS UNBOUNDED PRECEDING) AS grp FROM x), a AS (SELECT pdf_file, grp, string_agg(t, chr(10) || chr(10) ORDER BY block_idx, block_id) FILTER (NOT head) AS text FROM g GROUP BY 1, 2 HAVING count(*) FILTER (NOT head) > 0), s AS (SELECT pdf_file, row_number() OVER (PARTITION BY pdf_file ORDER BY grp) - 1 AS section_no, text FROM a), w AS (SELECT pdf_file, section_no, o, regexp_replace(substr(text, o + 1, 300), '^[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g') AS chunk FROM s, unnest(range(0, length(text), 240)) u(o) WHERE length(text) > 300) SELECT pdf_file, section_no, row_number() OVER (PARTITION BY pdf_file, section_no ORDER BY o) - 1 AS chunk_index, chunk FROM w WHERE length(chunk) >= 50 UNION ALL SELECT pdf_file, section_no, 0, text FROM s WHERE length(text) BETWEEN 20 AND 300",
    "repaired_digits": r"WITH t AS (SELECT DISTINCT block_id, text, regexp_replace(regexp_replace(text, '(\d)[oO](\d)', '\1' || '0' || '\2', 'g'), '(\d)[oO](\d)', '\1' || '0' || '\2', 'g') AS a FROM content_list WHERE text IS NOT NULL AND pdf_file IS NOT NULL AND block_idx IS NOT NULL), u AS (SELECT *, regexp_replace(regexp_replace(a, '(\d)[lI](\d)', '\1' || '1' || '\2', 'g'), '(\d)[lI](\d)', '\1' || '1' || '\2', 'g') AS fixed FROM t) SELECT block_id, fixed FROM u WHERE fixed <> text",
    "section_tables": _B
    + r", h AS (SELECT *, last_value(CASE WHEN block_type = 'text' AND text_level = 1 AND length(t) >= 3 AND NOT regexp_matches(t, '^(分析师|研究员|联系人|证券分析师|首席分析师)\s*[:：]\s*\S{2,6}$|^(强烈推荐|买入|增持|中性|回避|卖出)|^\d{4}\s*年\s*\d{1,2}\s*月') THEN t END IGNORE NULLS) OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id ROWS UNBOUNDED PRECEDING) AS section FROM b) SELECT pdf_file, row_number() OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id) AS table_no, block_idx, coalesce(section, '') AS section FROM h WHERE block_type = 'table' AND table_body <> ''",
    "noise_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_noise FROM l WHERE regexp_matches(line, '^第\s*\d+\s*页|^\d+\s*$|^请务必阅读|^免责声明|^重要提示|^本报告由.*出品|^分析师.*证书编号|^SAC执业证书编号|^投资评级|^评级说明|^Table_|www\.|^证券研究报告$|^行业(深度|点评|周报|月报)$') OR (length(regexp_replace(line, '[^一-鿿]', '', 'g')) < 5 AND length(line) < 10) GROUP BY 1""",
    "without_authors": _B
    + rf""", x AS (SELECT *, row_number() OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id) AS pos, block_type = 'text' AND regexp_matches(t, '{B.AUTHOR[4:]}') AS author, block_type = 'text' AND t <> '' AND regexp_matches(t, '{B.CONTACT[4:]}') AS contact FROM b),
w AS (SELECT *, last_value(CASE WHEN author THEN pos END IGNORE NULLS) OVER o AS anchor, last_value(CASE WHEN block_type = 'text' AND t <> '' AND NOT author AND NOT contact THEN pos END IGNORE NULLS) OVER o AS other FROM x WINDOW o AS (PARTITION BY pdf_file ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT block_id FROM w WHERE NOT coalesce(author OR (contact AND anchor > coalesce(other, 0) AND pos - anchor <= 8), false)""",
    "without_contents": _B
    + rf""", x AS (SELECT *, coalesce(block_type = 'text' AND regexp_matches(t, '{_TOC_SQL}'), false) AS toc FROM b), y AS (SELECT *, NOT toc AND NOT coalesce(block_type = 'list' OR (block_type = 'text' AND t = ''), false) AS brk FROM x),
z AS (SELECT *, sum(brk::INT) OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id ROWS UNBOUNDED PRECEDING) AS island FROM y), i AS (SELECT *, sum(toc::INT) OVER p AS lines, min(CASE WHEN toc THEN block_idx END) OVER p AS first FROM z WINDOW p AS (PARTITION BY pdf_file, island))
SELECT block_id FROM i WHERE brk OR lines < 3 OR block_idx < first""",
    "captioned_blocks": _B
    + rf""", x AS (SELECT *, lag(block_type) OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id) AS before FROM b), y AS (SELECT *, coalesce(block_type = 'text' AND text_level IS NULL AND length(t) BETWEEN 1 AND 80 AND regexp_matches(t, '{B.CAPTION[4:]}') AND before IN ('image', 'chart', 'table'), false) AS caption FROM x),
z AS (SELECT *, lead(caption) OVER o AS nc, lead(t) OVER o AS nt FROM y WINDOW o AS (PARTITION BY pdf_file ORDER BY block_idx, block_id)) SELECT block_id, CASE WHEN NOT regexp_matches(nt, '^(资料来源|数据来源)') THEN nt END AS captions, CASE WHEN regexp_matches(nt, '^(资料来源|数据来源)') THEN nt END AS sources FROM z WHERE nc AND NOT caption""",
    "residue_free_texts": rf"""
WITH a AS (SELECT DISTINCT chunk_id, text FROM all_chunks WHERE source_type = 'report_fulltext' AND text IS NOT NULL),
r AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', ' ', 'g'), '{chunking.RESIDUE_TAGS}', '', 'g'), '{chunking.RESIDUE_ENTITIES}', ' ', 'g'), '{chunking.RESIDUE_TEMPLATES}', '', 'g'), '{chunking.RESIDUE_PAGES}', chr(10), 'g') AS t FROM a),
c AS (SELECT *, regexp_matches(t, '(?m)^{chunking.DISCLAIMER_HEADING}$') AS has, length(regexp_extract(t, '(?sm)\A(.*?)^{chunking.DISCLAIMER_HEADING}$', 1)) AS pos FROM r),
d AS (SELECT chunk_id, CASE WHEN has AND pos > length(t) * 0.6 THEN regexp_replace(t[1:pos], '\s+$', '') ELSE t END AS t FROM c)
SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g') AS text FROM d""",
    "text_paragraphs": rf"""
WITH l AS (SELECT doc_id, i, regexp_replace(ls[i], '^[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g') AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(i)),
f AS (SELECT *, sum((x = '')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp, regexp_matches(x, '{"|".join(chunking.NOISE_LINES)}') OR (length(regexp_replace(x, '[^一-鿿]', '', 'g')) < 5 AND length(x) < 10) AS noise FROM l),
p AS (SELECT doc_id, grp, string_agg(x, '' ORDER BY i) AS paragraph FROM f WHERE x <> '' AND NOT noise GROUP BY 1, 2),
v AS (SELECT * FROM p WHERE length(paragraph) BETWEEN 30 AND 2000 AND length(regexp_replace(paragraph, '[^一-鿿]', '', 'g')) >= 10)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS paragraph_no, paragraph FROM v""",
    "table_runs": r"""
WITH l AS (SELECT doc_id, i, ls[i] AS x, ls[i + 1] AS y FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(i)),
b AS (SELECT *, regexp_matches(x, '^\s*\|.*\|\s*$') AS bar, regexp_matches(coalesce(y, ''), '^\s*\|[\s:|-]+\|\s*$') AS rule FROM l),
s AS (SELECT *, sum((NOT bar)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM b),
t AS (SELECT *, bar AND coalesce(i >= min(CASE WHEN bar AND rule THEN i END) OVER (PARTITION BY doc_id, island), false) AS inside FROM s),
g AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(inside) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM t)),
r AS (SELECT doc_id, run, any_value(inside) AS inside, string_agg(x, chr(10) ORDER BY i) AS content FROM g GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS block_no, CASE WHEN inside THEN 'table' ELSE 'prose' END AS kind, length(content) AS n_chars FROM r WHERE regexp_replace(content, '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]', '', 'g') <> ''""",
    "html_table_facts": r"""
WITH t AS (SELECT DISTINCT block_id, table_body FROM content_list WHERE block_id IS NOT NULL AND contains(table_body, '<t')),
r AS (SELECT block_id, row_number() OVER (PARTITION BY block_id, table_body ORDER BY i) AS n, list_transform(regexp_extract_all(rs[i], '(?is)<t[dh][^<>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^<>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&#9;', chr(9)), '&quot;', '"'), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g'))) AS cells
  FROM (SELECT block_id, table_body, regexp_extract_all(table_body, '(?is)<tr[^<>]*>(.*?)</tr>', 1) AS rs FROM t), unnest(range(1, len(rs) + 1)) u(i)),
h AS (SELECT block_id, cells AS header FROM r WHERE n = 1),
f AS (SELECT block_id, n - 1 AS row_no, list_filter(list_transform(range(1, least(len(header), len(cells)) + 1), lambda k: CASE WHEN header[k] <> '' AND cells[k] NOT IN ('', '-', 'nan', 'None') THEN header[k] || cells[k] END), lambda p: p IS NOT NULL) AS pairs FROM r JOIN h USING (block_id) WHERE n > 1 AND list_max(list_transform(header, lambda x: length(x))) >= 2)
SELECT block_id, row_no, array_to_string(pairs, '，') AS fact FROM f WHERE len(pairs) >= 2""",
}
