"""Queries of the search pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage
from quarryline.functions.text import cut_at, iso_date, strip_u
from quarryline.operators import relational
from quarryline.operators import retrieval as R
from quarryline.operators import search as P
from quarryline.plans.reports import ALIASES
from quarryline.plans.retrieval import TODAY, _C, _S
from quarryline.sources import read_table

#: Industries answer to their own names too.
NAMES = {**ALIASES, **{v: v for v in ALIASES.values()}}


def _scores(spark: SparkSession, root: str) -> DataFrame:
    return R.latest_scores(read_table(spark, root, "search_hits"))


def _queries(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "search_hits").filter("query_id is not null").groupBy("query_id").agg(F.min("query_text").alias("query_text"))


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "all_chunks").select("chunk_id", "source_type", "pdf_file", "report_title", "text", iso_date(F.col("report_date")).alias("day")).filter("chunk_id is not null").distinct()


def financial_search(spark: SparkSession, root: str) -> DataFrame:
    """Five figures' chunks of each query: dense and sparse lists within the source, fused by rank, the query's year first."""
    chunks = _chunks(spark, root)
    fused = P.fused_lists(P.hits_within(_scores(spark, root), chunks, ["financial"], ["dense", "sparse"]), 20)
    return P.year_boosted(fused, _queries(spark, root), chunks.select("chunk_id", "day").distinct(), 5).select("query_id", "rank", "chunk_id", "score")


def report_search(spark: SparkSession, root: str) -> DataFrame:
    """Five report chunks of each query, by metadata and full text."""
    return P.report_search(_scores(spark, root), _chunks(spark, root), _queries(spark, root))


def industry_search(spark: SparkSession, root: str) -> DataFrame:
    """Industries of each query by name, else by the nearest chunks."""
    chunks = read_table(spark, root, "all_chunks").filter("chunk_id is not null and source_type = 'financial'").select("chunk_id", "industry", iso_date(F.col("report_date")).alias("day"), "text").distinct()
    return P.industry_search(_queries(spark, root), _scores(spark, root).filter("retriever = 'dense'"), chunks, NAMES).select("query_id", "position", "industry", "score", "way", "chunk_id")


def named_industries(spark: SparkSession, root: str) -> DataFrame:
    """Industries of each query by name alone, with a message where none is named."""
    parents = read_table(spark, root, "stocks").groupBy(F.col("industry_major").alias("industry")).agg(F.concat(F.lit("成员："), F.count(F.lit(1)).cast("string")).alias("text"))
    return P.named_or_message(_queries(spark, root), parents, NAMES)


def linear_search(spark: SparkSession, root: str) -> DataFrame:
    """Ten chunks of each query by a linear mix of scores and the age of reports; the filter precedes the ranking."""
    chunks = _chunks(spark, root)
    mixed = P.linear_fusion(P.hits_within(_scores(spark, root), chunks, ["financial", "report"], ["dense", "bm25"]), 0.7).join(chunks.select("chunk_id", "source_type", "day").distinct(), "chunk_id")
    aged = F.when(F.col("source_type") == "report", R.age_bonus(F.col("day"), F.lit(TODAY).cast("date"))).otherwise(0.0)
    return P.top_of(mixed.withColumn("score", F.round(F.col("score") + aged, 6)), 10).select("query_id", "rank", "chunk_id", "score")


def mixed_report_search(spark: SparkSession, root: str) -> DataFrame:
    """Metadata and full text, each by its own linear mix, taken by turns, texts that begin alike once."""
    scores, chunks = _scores(spark, root), _chunks(spark, root)

    def path(source: str, alpha: float) -> DataFrame:
        return P.top_of(P.linear_fusion(P.hits_within(scores, chunks, [source], ["dense", "bm25"]), alpha), 10).join(chunks.select("chunk_id", "text"), "chunk_id")

    both = relational.interleave(path("report", 0.4), path("report_fulltext", 0.7), "query_id", "rank", "text", 100, 10)
    return P.top_of(both.select("query_id", "chunk_id", "score"), 10).select("query_id", "rank", "chunk_id", "score")


def tool_observations(spark: SparkSession, root: str) -> DataFrame:
    """What the figures' search answers to each query, as text."""
    flat = strip_u(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", ""), r"!\[.*?\]\(.*?\)", ""), r"(?U)\s+", " "))
    lines = _chunks(spark, root).select("chunk_id", F.concat(F.lit("["), "source_type", F.lit("] "), cut_at(flat, 200, "。")).alias("line")).distinct()
    found = financial_search(spark, root).join(lines, "chunk_id")
    return P.observation(found, "找到 %d 条财务数据：", "没有找到相关数据", _queries(spark, root))


def sparse_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Documents as sparse vectors in ascending order of words: how many words, their weight, and the first and last word."""
    rows = P.sparse_texts(read_table(spark, root, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.size("v").alias("n_words"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["value"]), 6).alias("weight"), F.try_element_at("v", F.lit(1))["key"].alias("first_word"), F.try_element_at("v", F.lit(-1))["key"].alias("last_word"))


def sparse_top_all(spark: SparkSession, root: str) -> DataFrame:
    """Nearest documents by inner product of sparse vectors, of every document whose id is divisible by 100."""
    # counted once: the vectors are read for the number of queries, for the queries and for the search
    documents = cut_lineage(P.sparse_texts(read_table(spark, root, "documents"), "doc_id", "text"))
    queries = documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.explode("v").alias("x")).select("query", F.col("x.key").alias("word"), F.col("x.value").alias("weight"))
    return R.sparse_top_k_of(documents, queries, "query", "doc_id", "v", 10)


QUERIES = {f.__name__: f for f in (financial_search, report_search, industry_search, named_industries, linear_search, mixed_report_search, tool_observations, sparse_vectors, sparse_top_all)}

_BASE = _S + ", " + _C + ", q AS (SELECT query_id, min(query_text) AS query_text FROM search_hits WHERE query_id IS NOT NULL GROUP BY 1)"
_NAMES = "n(alias, target, pos) AS (VALUES " + ", ".join(f"('{a}', '{t}', {i})" for i, (a, t) in enumerate(sorted(NAMES.items(), key=lambda x: -len(x[0])))) + ")"
_NAMED = _NAMES + ", nm0 AS (SELECT query_id, query_text, target AS industry, min(pos) AS pos FROM q JOIN n ON contains(query_text, alias) GROUP BY ALL), nm AS (SELECT query_id, query_text, industry, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS position FROM nm0 QUALIFY position < 2)"


def _within(name: str, sources: str, retrievers: str) -> str:
    return f"{name} AS (SELECT * FROM s WHERE retriever IN ({retrievers}) AND chunk_id IN (SELECT chunk_id FROM c WHERE source_type IN ({sources})))"


def _ranked(name: str, of: str, fetch: int) -> str:
    return f"{name} AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY good DESC, chunk_id) AS rank FROM {of}) WHERE rank <= {fetch} GROUP BY 1, 2)"


def _mixed(name: str, of: str, weights: dict[str, float]) -> str:
    case = " ".join(f"WHEN '{r}' THEN {w}::DOUBLE" for r, w in weights.items())
    return f"{name} AS (SELECT query_id, chunk_id, round(sum(CASE retriever {case} ELSE 0 END * CASE WHEN hi > lo THEN (good - lo) / (hi - lo) ELSE 0 END), 9) AS score FROM (SELECT *, min(good) OVER p AS lo, max(good) OVER p AS hi FROM {of} WINDOW p AS (PARTITION BY query_id, retriever)) GROUP BY 1, 2)"


_YEAR = "CASE WHEN list_contains(regexp_extract_all(query_text, '20\\d\\d'), year(day)::VARCHAR) THEN 0.01 ELSE 0 END"
_FINANCIAL = _BASE + ", " + _within("a", "'financial'", "'dense', 'sparse'") + ", " + _ranked("r", "a", 20) + f", fin AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score + {_YEAR}, 9) DESC, chunk_id) AS rank, chunk_id, round(score + {_YEAR}, 9) AS score FROM r JOIN q USING (query_id) JOIN (SELECT DISTINCT chunk_id, day FROM c) USING (chunk_id) QUALIFY rank <= 5)"
_WORDS = r"""
h AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '(\p{Han}+)', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^\p{Han}{2}') THEN list_transform(range(1, length(w)), lambda i: w[i:i + 1]) ELSE [w] END)) AS ws FROM h),
tf AS (SELECT doc_id, word, 1 + ln(count(*)::DOUBLE) AS w FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY ALL)"""
SQL = {
    "financial_search": _FINANCIAL + " SELECT * FROM fin",
    "tool_observations": _FINANCIAL
    + r", f0 AS (SELECT DISTINCT chunk_id, source_type, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '!\[.*?\]\(.*?\)', '', 'g'), '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM c), f1 AS (SELECT *, instr(reverse(t[1:200]), '。') AS k FROM f0), f2 AS (SELECT DISTINCT chunk_id, '[' || source_type || '] ' || CASE WHEN length(t) <= 200 THEN t WHEN k > 0 AND 200 - k > 100 THEN t[1:201 - k] ELSE t[1:200] || '...' END AS line FROM f1), o AS (SELECT query_id, count(*) AS n, string_agg(rank || '. ' || line, chr(10) ORDER BY rank) AS ls FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, line) AS rank, line FROM fin JOIN f2 USING (chunk_id)) GROUP BY 1) SELECT query_id, coalesce(n, 0) AS n_results, CASE WHEN n IS NULL THEN '没有找到相关数据' ELSE '找到 ' || n || ' 条财务数据：' || chr(10) || ls END AS observation FROM q LEFT JOIN o USING (query_id)",
    "linear_search": _BASE
    + ", "
    + _within("a", "'financial', 'report'", "'dense', 'bm25'")
    + ", "
    + _mixed("m", "a", {"dense": 0.7, "bm25": 1 - 0.7})
    + f", x AS (SELECT query_id, chunk_id, round(score + CASE WHEN source_type = 'report' THEN coalesce(0.4 * exp(-0.693 * greatest(date_diff('day', day, DATE '{TODAY}'), 0) / 365.0), 0) ELSE 0 END, 6) AS score FROM m JOIN (SELECT DISTINCT chunk_id, source_type, day FROM c) USING (chunk_id)) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM x QUALIFY rank <= 10",
    "mixed_report_search": _BASE
    + ", "
    + ", ".join([_within("a", "'report'", "'dense', 'bm25'"), _mixed("ma", "a", {"dense": 0.4, "bm25": 1 - 0.4}), _within("b", "'report_fulltext'", "'dense', 'bm25'"), _mixed("mb", "b", {"dense": 0.7, "bm25": 1 - 0.7})])
    + """, u AS (SELECT *, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM ma QUALIFY r <= 10 UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM mb QUALIFY r <= 10),
o AS (SELECT query_id, chunk_id, score, r, l FROM u JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, text[1:100] ORDER BY r, l) = 1), i AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r, l) <= 10)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM i""",
    "report_search": _BASE
    + ", "
    + ", ".join([_within("a", "'report'", "'dense', 'sparse'"), _mixed("ma", "a", {"dense": 0.4, "sparse": 0.6}), _within("b", "'report_fulltext'", "'dense', 'sparse'"), _ranked("mb", "b", 60)])
    + """, u AS (SELECT query_id, chunk_id, 'meta' AS list, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ma QUALIFY rank < 30 UNION ALL SELECT query_id, chunk_id, 'body', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM mb QUALIFY rank < 60),
w AS (SELECT * FROM (VALUES ('q1', '一季报'), ('q1', '一季度'), ('q1', 'Q1'), ('q1', 'q1'), ('h1', '半年报'), ('h1', '中报'), ('h1', 'H1'), ('h1', 'h1'), ('q3', '三季报'), ('q3', '三季度'), ('q3', 'Q3'), ('q3', 'q3'), ('annual', '年报'), ('annual', '年度')) v(label, word)),
d AS (SELECT query_id, chunk_id, coalesce(pdf_file, chunk_id) AS document, (list = 'meta')::INT AS is_meta, rank, list, text, CASE WHEN pdf_file IS NOT NULL AND EXISTS (SELECT 1 FROM w WHERE contains(query_text, word) AND (label IN (SELECT label FROM w w2 WHERE contains(coalesce(report_title, ''), w2.word))
  OR (label = 'q3' AND month(day) IN (10, 11)) OR (label = 'h1' AND month(day) IN (7, 8, 9)) OR (label = 'annual' AND month(day) IN (3, 4)) OR (label = 'q1' AND month(day) IN (4, 5)))) THEN 0.06 ELSE 0 END AS boost FROM u JOIN c USING (chunk_id) JOIN q USING (query_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY rank, list, chunk_id) AS n FROM d),
f AS (SELECT query_id, document, round(sum(CASE WHEN n <= 5 THEN 1.0::DOUBLE / (60 + rank + 1) ELSE 0 END) + max(boost), 9) AS score FROM e GROUP BY 1, 2),
z AS (SELECT d.*, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, is_meta DESC, rank, list, chunk_id) AS position FROM d JOIN f USING (query_id, document) QUALIFY position <= 30),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY position) AS nd FROM z), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS slot, sum(length(text)) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM y WHERE nd <= 3)
SELECT query_id, slot, chunk_id, document, score, used FROM x WHERE (slot = 1 OR used <= 12000) AND slot <= 5""",
    "industry_search": _BASE
    + ", "
    + _NAMED
    + """, fc AS (SELECT DISTINCT chunk_id, industry, TRY_CAST(report_date AS DATE) AS day FROM all_chunks WHERE chunk_id IS NOT NULL AND source_type = 'financial'), par AS (SELECT industry, max({'d': day, 'c': chunk_id}).c AS chunk_id FROM fc WHERE industry IS NOT NULL GROUP BY 1),
v AS (SELECT query_id, chunk_id, good, row_number() OVER (PARTITION BY query_id ORDER BY good DESC, chunk_id) AS rank FROM s WHERE retriever = 'dense' AND query_id NOT IN (SELECT query_id FROM nm) QUALIFY rank <= 6),
vi AS (SELECT query_id, industry, max(good) AS score, min(rank) AS r FROM v JOIN (SELECT DISTINCT chunk_id, industry FROM fc WHERE industry IS NOT NULL) USING (chunk_id) WHERE good >= 0.75 GROUP BY 1, 2), vp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS position FROM vi QUALIFY position < 2)
SELECT query_id, position, industry, 1.0::DOUBLE AS score, 'name' AS way, par.chunk_id FROM nm JOIN par USING (industry) UNION ALL SELECT query_id, position, industry, score, 'vector', par.chunk_id FROM vp JOIN par USING (industry)""",
    "named_industries": "WITH q AS (SELECT query_id, min(query_text) AS query_text FROM search_hits WHERE query_id IS NOT NULL GROUP BY 1), "
    + _NAMED
    + ", p AS (SELECT industry_major AS industry, '成员：' || count(*) AS text FROM stocks GROUP BY 1), y AS (SELECT query_id, position, industry, 1.0::DOUBLE AS score, false AS match_failed, text FROM nm JOIN p USING (industry)) SELECT * FROM y UNION ALL SELECT query_id, 0, NULL, 0.0, true, '没有找到与“' || query_text || '”匹配的行业' FROM q WHERE query_id NOT IN (SELECT query_id FROM y)",
    "sparse_vectors": "WITH " + _WORDS.strip() + " SELECT doc_id, count(word) AS n_words, round(coalesce(sum(w), 0), 6) AS weight, min(word) AS first_word, max(word) AS last_word FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN tf USING (doc_id) GROUP BY 1",
    "sparse_top_all": "WITH " + _WORDS.strip() + ", p AS (SELECT a.doc_id AS query, b.doc_id, round(sum(a.w * b.w), 6) AS score FROM tf a JOIN tf b USING (word) WHERE a.doc_id % 100 = 0 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM p QUALIFY rank <= 10",
}
