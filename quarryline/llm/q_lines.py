"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.repeated_lines import line_templates, placed_lines, repeated_lines, without_repeated_lines
from quarryline.sources import read_table


def _found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines(read_table(spark, root, "content_list"), read_table(spark, root, "all_chunks"), distinct=False)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Each repeated line."""
    return _found(spark, root).select("block_id", "line_no").distinct()


def p2_clean(spark: SparkSession, root: str) -> DataFrame:
    """Each block's text without the repeated lines."""
    return without_repeated_lines(read_table(spark, root, "content_list"), _found(spark, root))


def p2_lines(spark: SparkSession, root: str) -> DataFrame:
    """The repeated lines of each source, by their letters, with the number of documents."""
    return _found(spark, root).select("source", "key", "n_line_docs", "n_docs").distinct()


def p2_templates(spark: SparkSession, root: str) -> DataFrame:
    """The line templates that cover enough documents of a source."""
    placed = placed_lines(read_table(spark, root, "content_list"), read_table(spark, root, "all_chunks"))
    return line_templates(placed).select("source", "template", F.col("n_leaf_docs").alias("n_docs"))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p2_lines": p2_lines, "p2_templates": p2_templates}

_BASE = r"""
WITH src AS (SELECT pdf_file, min(institution) AS source FROM all_chunks WHERE pdf_file IS NOT NULL AND institution <> '' GROUP BY 1),
docs AS (SELECT DISTINCT pdf_file, source FROM content_list JOIN src USING (pdf_file)),
tot AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY 1),
raw AS (SELECT DISTINCT block_id, pdf_file, string_split(text, chr(10)) AS ls FROM content_list WHERE block_type = 'text' AND text_level IS NULL AND text IS NOT NULL),
lines AS (SELECT block_id, pdf_file, i AS line_no,
  lower(regexp_replace(translate(ls[i], 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), '[^\p{L}]', '', 'g')) AS key
  FROM raw, unnest(range(1, len(ls) + 1)) u(i)),
cnt AS (SELECT source, key, count(DISTINCT pdf_file) AS n_line_docs FROM lines JOIN docs USING (pdf_file) WHERE length(key) >= 8 GROUP BY 1, 2),
hit AS (SELECT source, key, n_line_docs, n_docs FROM cnt JOIN tot USING (source) WHERE n_line_docs >= 3 AND 5 * n_line_docs >= n_docs),
found AS (SELECT DISTINCT block_id, line_no FROM lines JOIN docs USING (pdf_file) JOIN hit USING (source, key))
"""
SQL = {
    "p2_found": _BASE + "SELECT block_id, line_no FROM found",
    "p2_templates": _BASE
    + """, k AS (SELECT DISTINCT source, key[1:6] || chr(1) || key[-2:] AS path, key, pdf_file FROM lines JOIN docs USING (pdf_file) WHERE length(key) >= 8),
leaf AS (SELECT source, path, count(DISTINCT pdf_file) AS n, min(key) AS lo, max(key) AS hi, min(reverse(key)) AS rlo, max(reverse(key)) AS rhi, min(length(key)) AS short, max(length(key)) AS long FROM k GROUP BY 1, 2),
wide AS (SELECT leaf.* FROM leaf JOIN tot USING (source) WHERE n >= 3 AND 5 * n >= n_docs),
cut AS (SELECT *, len(list_filter(range(1, length(lo) + 1), lambda i: lo[1:i] = hi[1:i])) AS lead, len(list_filter(range(1, length(rlo) + 1), lambda i: rlo[1:i] = rhi[1:i])) AS back FROM wide),
ends AS (SELECT *, CASE WHEN lo = hi THEN 0 ELSE least(back, short - lead) END AS trail FROM cut),
mid AS (SELECT source, path, i, CASE WHEN min(key[i]) = max(key[i]) THEN min(key[i]) ELSE '*' END AS c FROM k JOIN ends USING (source, path), unnest(range(lead + 1, long - trail + 1)) u(i) WHERE lo <> hi AND short = long GROUP BY 1, 2, 3),
fill AS (SELECT source, path, string_agg(c, '' ORDER BY i) AS m FROM mid GROUP BY 1, 2)
SELECT source, CASE WHEN lo = hi THEN lo ELSE lo[1:lead] || regexp_replace(coalesce(m, '*'), '[*]+', '*', 'g') || CASE WHEN trail > 0 THEN lo[-trail:] ELSE '' END END AS template, n AS n_docs FROM ends LEFT JOIN fill USING (source, path)""",
    "p2_lines": _BASE + "SELECT source, key, n_line_docs, n_docs FROM hit",
    "p2_clean": _BASE
    + """, gone AS (SELECT block_id, list(line_no) AS g FROM found GROUP BY 1), c AS (SELECT DISTINCT block_id, text FROM content_list)
SELECT block_id, CASE WHEN g IS NULL OR text IS NULL THEN text ELSE array_to_string([string_split(text, chr(10))[i] FOR i IN range(1, len(string_split(text, chr(10))) + 1) IF NOT list_contains(g, i)], chr(10)) END AS text
FROM c LEFT JOIN gone USING (block_id)""",
}
