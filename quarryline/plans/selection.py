"""Queries of selection, resumption and run summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import iso_date
from quarryline.operators import selection as S
from quarryline.operators import trajectory as T
from quarryline.plans.reports import ALIASES
from quarryline.plans.retrieval import _K, TOOLS
from quarryline.sources import read_table

PREFIX, SINCE = "0906", "2024-01-01"


def usable_reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports with a date and a file of the wanted form."""
    return S.with_date_and_link(read_table(spark, root, "all_reports").filter("report_id is not null"), "report_date", "pdf_file", PREFIX).select("report_id", "day", "pdf_file").distinct()


def dated_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Full-text chunks since a day, too old ones and undated ones, counted apart."""
    rows = read_table(spark, root, "all_chunks").filter("source_type = 'report_fulltext'").select("chunk_id", "report_date").distinct()
    return S.since(rows, "report_date", SINCE).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_chunks"))


def long_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that are long enough before and after images and space are taken out."""
    rows = read_table(spark, root, "all_chunks").filter("chunk_id is not null").select("chunk_id", "text").distinct()
    return S.long_enough(rows, "text", F.regexp_replace(F.regexp_replace("text", r"!\[.*?\]\(.*?\)", ""), r"(?U)\s+", "")).select("chunk_id", F.length("clean").alias("n_chars"))


def half_year_figures(spark: SparkSession, root: str) -> DataFrame:
    """Financial chunks of June and December."""
    rows = read_table(spark, root, "all_chunks").filter("source_type = 'financial' and chunk_id is not null").select("chunk_id", iso_date(F.col("report_date")).alias("day")).distinct()
    return S.in_months(rows, "day")


def first_samples(spark: SparkSession, root: str) -> DataFrame:
    """The first 50 samples by id: the limit is the feature."""
    return S.first_rows(read_table(spark, root, "sft_data").filter("sample_id is not null").select("sample_id", "question").distinct(), [F.col("sample_id"), F.col("question")], 50)


def sampled_documents(spark: SparkSession, root: str) -> DataFrame:
    """100 documents drawn by a seed: the draw is the feature."""
    return S.sample_rows(read_table(spark, root, "documents").select("doc_id", "source"), "doc_id", 100)


def shuffled_questions(spark: SparkSession, root: str) -> DataFrame:
    """Questions of some types in a seeded order."""
    rows = read_table(spark, root, "sft_data").filter("question_type in ('risk_analysis', 'industry_analysis') and sample_id is not null").select("sample_id", "question_type").distinct()
    return S.shuffled(rows, "sample_id")


def table_tasks(spark: SparkSession, root: str) -> DataFrame:
    """Tables to be turned into facts, and why others are left out."""
    tables = read_table(spark, root, "content_list").filter("block_type = 'table' and block_id is not null").select("block_id", "pdf_file", "table_body").distinct()
    codes = read_table(spark, root, "pdf_map").select("pdf_file", "stock_code")
    return tables.join(codes, "pdf_file", "left").select("block_id", S.task_verdict(F.col("stock_code"), F.col("table_body")).alias("verdict"))


def clamped_calls(spark: SparkSession, root: str) -> DataFrame:
    """Every call's query and number of results within their bounds."""
    steps = T.steps_of(read_table(spark, root, "sft_data"))
    return steps.select("sample_id", "step_no", S.clamp_query(F.col("query")).alias("query"), S.clamp_results(F.regexp_extract("query", r"(\d+)", 1)).alias("top_k"))


def finished_stocks(spark: SparkSession, root: str) -> DataFrame:
    """Stocks whose figures are complete: some chunk with figures, none without."""
    rows = read_table(spark, root, "all_chunks").filter("source_type = 'financial'").select("chunk_id", "stock_code", F.col("text").rlike("财务指标：.*\\d").cast("int").alias("n")).distinct()
    return S.finished_keys(rows.withColumn("error", F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no figures"))), "stock_code", "n", "error")


def names_longest_first(spark: SparkSession, root: str) -> DataFrame:
    """Registered names in the order in which texts are searched for them."""
    return S.longest_first(read_table(spark, root, "stocks"), "stock_name")


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*ALIASES.items(), ("光伏", "新能源")], "alias string, target string")


def _industries(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "stocks").groupBy(F.col("industry_major").alias("target")).agg(F.count(F.lit(1)).alias("n_stocks"))


def alias_parents(spark: SparkSession, root: str) -> DataFrame:
    """Aliases with their industry."""
    return S.join_aliases(_aliases(spark), _industries(spark, root))[0].select("alias", "target", "n_stocks")


def unmatched_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Aliases of industries that aren't registered."""
    return S.join_aliases(_aliases(spark), _industries(spark, root))[1]


def report_file_names(spark: SparkSession, root: str) -> DataFrame:
    """File names of the usable reports."""
    rows = S.with_date_and_link(read_table(spark, root, "all_reports").filter("report_id is not null"), "report_date", "pdf_file", PREFIX).select("report_id", "stock_code", "day").distinct()
    return S.file_names(rows, "stock_code", "day", [F.col("report_id"), F.asc_nulls_first("stock_code"), F.col("day")]).select("report_id", "file")


def question_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Questions of each type, the most frequent first."""
    return S.counts_descending(read_table(spark, root, "sft_data").filter("sample_id is not null").select("sample_id", "question_type").distinct(), "question_type")


def parse_summary(spark: SparkSession, root: str) -> DataFrame:
    """PDFs by the way they were parsed, with their pages."""
    return S.run_summary(read_table(spark, root, "pdf_map"), "parse_method", "n_pages")


def daily_steps(spark: SparkSession, root: str) -> DataFrame:
    """Mean number of calls of the samples of each day; samples without calls count as not measured."""
    rows = read_table(spark, root, "sft_data").filter("sample_id is not null").select("sample_id", "created_at", F.when(F.col("num_tool_steps") > 0, F.col("num_tool_steps").cast("double")).otherwise(-1.0).alias("v")).distinct()
    return S.interval_means(rows, "created_at", "v").select(F.to_date("start").alias("day"), "mean", "n")


def issues_by_type(spark: SparkSession, root: str) -> DataFrame:
    """The first ten unanswered calls of each tool."""
    steps = T.steps_of(read_table(spark, root, "sft_data")).filter("observation is null or observation = '' or observation like '%未找到%' or observation like '%错误%'")
    return S.first_issues(steps, "tool", "observation", ("sample_id", "step_no"))


def unknown_tools(spark: SparkSession, root: str) -> DataFrame:
    """Calls of tools that don't exist, by name."""
    return T.steps_of(read_table(spark, root, "sft_data")).filter(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))).groupBy("tool").agg(F.count(F.lit(1)).alias("n_calls"))


QUERIES = {
    f.__name__: f
    for f in (
        usable_reports, dated_chunks, long_chunks, half_year_figures, first_samples, sampled_documents, shuffled_questions, table_tasks, clamped_calls, finished_stocks, names_longest_first, alias_parents, unmatched_aliases, report_file_names, question_histogram, parse_summary,
        daily_steps, issues_by_type, unknown_tools,
    )
}

_DAY = "TRY_CAST(replace(report_date[1:10], '/', '-') AS DATE)"
_VALUES = ", ".join(f"('{a}', '{t}')" for a, t in [*ALIASES.items(), ("光伏", "新能源")])
#: Calls of the trajectories.
STEPS = _K
SQL = {
    "usable_reports": f"SELECT DISTINCT report_id, {_DAY} AS day, pdf_file FROM all_reports WHERE report_id IS NOT NULL AND {_DAY} IS NOT NULL AND starts_with(pdf_file, '{PREFIX}')",
    "dated_chunks": f"SELECT CASE WHEN coalesce(report_date, '') = '' THEN 'undated' WHEN regexp_split_to_array(report_date, '[ T]')[1] >= '{SINCE}' THEN 'kept' ELSE 'old' END AS verdict, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, report_date FROM all_chunks WHERE source_type = 'report_fulltext') GROUP BY 1",
    "long_chunks": r"SELECT chunk_id, length(c) AS n_chars FROM (SELECT DISTINCT chunk_id, text, regexp_replace(regexp_replace(text, '!\[.*?\]\(.*?\)', '', 'g'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS c FROM all_chunks WHERE chunk_id IS NOT NULL AND length(text) >= 50) WHERE length(c) >= 50",
    "half_year_figures": f"SELECT DISTINCT chunk_id, {_DAY} AS day FROM all_chunks WHERE source_type = 'financial' AND chunk_id IS NOT NULL AND month({_DAY}) IN (6, 12)",
    "first_samples": "SELECT DISTINCT sample_id, question FROM sft_data WHERE sample_id IS NOT NULL ORDER BY 1, 2 LIMIT 50",
    "sampled_documents": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "shuffled_questions": "SELECT sample_id, question_type, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) - 1 AS position FROM (SELECT DISTINCT sample_id, question_type FROM sft_data WHERE question_type IN ('risk_analysis', 'industry_analysis') AND sample_id IS NOT NULL)",
    "table_tasks": "SELECT block_id, CASE WHEN coalesce(trim(stock_code), '') = '' THEN 'no_code' WHEN coalesce(trim(table_body, ' ' || chr(9) || chr(10) || chr(13)), '') = '' THEN 'empty' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT block_id, pdf_file, table_body FROM content_list WHERE block_type = 'table' AND block_id IS NOT NULL) LEFT JOIN pdf_map USING (pdf_file)",
    "clamped_calls": STEPS + r"SELECT sample_id, step_no, coalesce(query, '')[1:500] AS query, greatest(1, least(coalesce(TRY_CAST(regexp_extract(query, '(\d+)', 1) AS INT), 5), 20)) AS top_k FROM k",
    "finished_stocks": r"SELECT stock_code FROM (SELECT DISTINCT chunk_id, stock_code, coalesce(regexp_matches(text, '财务指标：.*\d'), false) AS ok FROM all_chunks WHERE source_type = 'financial' AND stock_code IS NOT NULL) GROUP BY 1 HAVING bool_and(ok)",
    "names_longest_first": "SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS rank FROM (SELECT DISTINCT trim(stock_name) AS name FROM stocks WHERE trim(stock_name) <> '')",
    "alias_parents": f"WITH a(alias, target) AS (VALUES {_VALUES}), p AS (SELECT industry_major AS target, count(*) AS n_stocks FROM stocks GROUP BY 1) SELECT alias, target, n_stocks FROM a JOIN p USING (target)",
    "unmatched_aliases": f"WITH a(alias, target) AS (VALUES {_VALUES}) SELECT alias, target FROM a WHERE target NOT IN (SELECT industry_major FROM stocks WHERE industry_major IS NOT NULL)",
    "report_file_names": f"SELECT report_id, concat_ws('_', coalesce(stock_code, ''), strftime(day, '%Y%m%d'), (row_number() OVER (ORDER BY report_id, stock_code NULLS FIRST, day) - 1) || '.pdf') AS file FROM (SELECT DISTINCT report_id, stock_code, {_DAY} AS day FROM all_reports WHERE report_id IS NOT NULL AND {_DAY} IS NOT NULL AND starts_with(pdf_file, '{PREFIX}'))",
    "question_histogram": "SELECT question_type, n, row_number() OVER (ORDER BY n DESC, question_type NULLS LAST) AS rank FROM (SELECT question_type, count(*) AS n FROM (SELECT DISTINCT sample_id, question_type FROM sft_data WHERE sample_id IS NOT NULL) GROUP BY 1)",
    "parse_summary": "SELECT parse_method, count(*) AS n, round(sum(n_pages), 6)::BIGINT AS total, round(avg(n_pages), 6) AS mean, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pdf_map GROUP BY 1",
    "daily_steps": "SELECT created_at::DATE AS day, round(coalesce(avg(num_tool_steps) FILTER (num_tool_steps > 0), 0), 6) AS mean, count(*) FILTER (num_tool_steps > 0) AS n FROM (SELECT DISTINCT sample_id, created_at, num_tool_steps FROM sft_data WHERE sample_id IS NOT NULL AND created_at IS NOT NULL) GROUP BY 1",
    "issues_by_type": STEPS + "SELECT * FROM (SELECT tool, row_number() OVER (PARTITION BY tool ORDER BY sample_id, step_no) AS position, sample_id, step_no, observation FROM k WHERE observation IS NULL OR observation = '' OR contains(observation, '未找到') OR contains(observation, '错误')) WHERE position <= 10",
    "unknown_tools": STEPS + "SELECT tool, count(*) AS n_calls FROM k WHERE coalesce(tool, '') NOT IN ('search_financial', 'search_industry', 'search_report', 'calculate') GROUP BY 1",
}
