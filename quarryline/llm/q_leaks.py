"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.leakage import leaked_items
from quarryline.sources import read_table


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Every document with each item that leaked into it."""
    return _leaks(spark, root).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Every leak with its length and its place in the item."""
    return _leaks(spark, root)


def p8_leaked_items(spark: SparkSession, root: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return _leaks(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("overlap_chars").alias("longest"))


QUERIES = {"p8_found": p8_found, "p8_overlaps": p8_overlaps, "p8_leaked_items": p8_leaked_items}
_TEXTS = r"""
WITH i AS (SELECT item_id, lower(regexp_replace(translate(text, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'), '[^\p{L}\p{N}]', '', 'g')) AS t FROM eval_items),
d AS (SELECT doc_id, lower(regexp_replace(translate(text, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'), '[^\p{L}\p{N}]', '', 'g')) AS t FROM documents)
"""
#: Runs of 40 characters of both sides that are equal; neighbours on one diagonal make a longer run.
_RUNS = (
    _TEXTS
    + """, ig AS (SELECT item_id, p AS q, substr(t, p, 40) AS g FROM i, unnest(range(1, length(t) - 38)) u(p)), dg AS (SELECT doc_id, p, substr(t, p, 40) AS g FROM d, unnest(range(1, length(t) - 38)) u(p)),
m AS (SELECT DISTINCT doc_id, item_id, p, q FROM dg JOIN ig USING (g)), isl AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS k FROM m),
r AS (SELECT doc_id, item_id, count(*) + 39 AS n, min(q) - 1 AS s FROM isl GROUP BY doc_id, item_id, p - q, k), o AS (SELECT doc_id, item_id, n::INT AS overlap_chars, s::INT AS item_start FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, s) = 1)
"""
)
SQL = {
    "p8_found": _TEXTS + ", ig AS (SELECT DISTINCT item_id, substr(t, p, 40) AS g FROM i, unnest(range(1, length(t) - 38)) u(p)), dg AS (SELECT DISTINCT doc_id, substr(t, p, 40) AS g FROM d, unnest(range(1, length(t) - 38)) u(p)) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p8_overlaps": _RUNS + "SELECT * FROM o",
    "p8_leaked_items": _RUNS + "SELECT item_id, count(*) AS n_documents, max(overlap_chars) AS longest FROM o GROUP BY 1",
}
