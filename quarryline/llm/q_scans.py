"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.scans import CHINESE_PAGE, NUMERALS, PAGE, document_paragraphs, page_furniture, scan_noise
from quarryline.sources import read_table


def _names(spark: SparkSession, root: str) -> DataFrame:
    stocks = read_table(spark, root, "stocks").selectExpr("stock_name as name")
    return stocks.unionByName(read_table(spark, root, "institutions").selectExpr("institution as name"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The kinds of scan noise of each block."""
    return scan_noise(read_table(spark, root, "content_list"), _names(spark, root))


def p6_furniture(spark: SparkSession, root: str) -> DataFrame:
    """Page numbers and running headers alone."""
    return page_furniture(read_table(spark, root, "content_list"))


def p6_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The repaired paragraphs of all PDFs, over page breaks."""
    return document_paragraphs(read_table(spark, root, "content_list"), _names(spark, root))


QUERIES = {"p6_found": p6_found, "p6_furniture": p6_furniture, "p6_paragraphs": p6_paragraphs}
_NUMERALS = "[" + ", ".join(f"'{n}'" for n in NUMERALS) + "]"
SQL = {
    "p6_furniture": rf"""
WITH t AS (SELECT DISTINCT block_id, pdf_file, page_idx, block_idx, text_level, text FROM content_list WHERE block_type = 'text' AND text <> '' AND pdf_file IS NOT NULL AND page_idx IS NOT NULL AND block_id IS NOT NULL),
n AS (
  SELECT block_id, pdf_file, page_idx, TRY_CAST(regexp_extract(text, '{PAGE}', 1) AS INT) AS number, TRY_CAST(regexp_extract(text, '{PAGE}', 2) AS INT) AS total FROM t WHERE length(text) <= 40
  UNION ALL SELECT block_id, pdf_file, page_idx, list_position({_NUMERALS}, regexp_extract(text, '{CHINESE_PAGE}', 1)), list_position({_NUMERALS}, nullif(regexp_extract(text, '{CHINESE_PAGE}', 2), '')) FROM t WHERE length(text) <= 40 AND contains(text, '页')),
c AS (SELECT *, number - page_idx AS shift FROM n WHERE number > 0 AND (total IS NULL OR total >= number)),
s AS (SELECT pdf_file, shift, count(DISTINCT page_idx) AS k FROM c GROUP BY 1, 2),
u AS (SELECT pdf_file, max({{'k': k, 'shift': shift}}) AS top, sum(k) AS every FROM s GROUP BY 1),
p AS (SELECT DISTINCT c.block_id FROM c LEFT JOIN u ON c.pdf_file = u.pdf_file AND top.k >= 3 AND 2 * top.k > every WHERE CASE WHEN u.pdf_file IS NULL THEN shift IN (0, 1) ELSE shift = top.shift END),
pages AS (SELECT pdf_file, max(page_idx) + 1 AS pages FROM content_list GROUP BY 1),
e AS (SELECT *, least(row_number() OVER (PARTITION BY pdf_file, page_idx ORDER BY block_idx, block_id), row_number() OVER (PARTITION BY pdf_file, page_idx ORDER BY block_idx DESC, block_id DESC)) <= 2 AS edge FROM t),
h AS (SELECT block_id, pdf_file, page_idx, edge, regexp_replace(text, '[\d\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]', '', 'g') AS line FROM e
  WHERE text_level IS NULL AND length(text) <= 60 AND length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 4 AND block_id NOT IN (SELECT block_id FROM p)),
l AS (SELECT pdf_file, line, count(DISTINCT page_idx) AS k FROM h GROUP BY 1, 2),
f AS (SELECT pdf_file, line AS form, pages FROM l JOIN pages USING (pdf_file) WHERE k >= 2 AND 9 * k >= pages),
a AS (SELECT h.pdf_file, h.line, h.page_idx, form, pages FROM h JOIN f USING (pdf_file) WHERE edge AND 5 * levenshtein(line, form) <= length(form)),
b AS (SELECT pdf_file, form FROM a GROUP BY 1, 2, pages HAVING count(DISTINCT page_idx) >= 3 AND 3 * count(DISTINCT page_idx) >= pages),
known AS (SELECT DISTINCT pdf_file, line FROM a JOIN b USING (pdf_file, form))
SELECT DISTINCT block_id, 'page_number' AS noise, true AS exact FROM p UNION ALL
SELECT DISTINCT block_id, 'running_header' AS noise, k >= 3 AND 3 * k >= pages AS exact FROM h JOIN known USING (pdf_file, line) JOIN l USING (pdf_file, line) JOIN pages USING (pdf_file) WHERE edge
""",
}
