"""Queries over reports, chunks and indicators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.calculator import calculate, calculate_value
from quarryline.functions.text import amount, cut_at, iso_date, number2, present, safe_text, strip_u
from quarryline.operators import chunking, facts, indexing, relational, trajectory
from quarryline.operators.retrieval import search_words
from quarryline.sources import read_table

SINCE = "2024-01-01"
#: Sub-industry words and the industry they belong to; a dictionary given as a parameter.
ALIASES = {"工业软件": "信息", "通信终端": "信息", "储能设备": "能源", "电力": "能源", "医疗器械": "医药", "制剂": "医药", "生物制品": "医药", "工程机械": "装备制造", "轨交设备": "装备制造", "食品加工": "消费", "食品": "消费", "家居木业": "消费", "门窗": "消费", "化学制品": "材料", "工业金属": "材料", "胶膜": "材料"}
METRICS = ["净资产收益率", "毛利率", "净利率", "资产负债率", "存货周转天数"]


def _reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports once each, with a date and what stands for nothing as null."""
    r = read_table(spark, root, "all_reports").filter("report_id is not null")
    return r.select("report_id", present(F.col("stock_code")).alias("stock_code"), present(F.col("stock_name")).alias("stock_name"), "report_title", present(F.col("rating")).alias("rating"), present(F.col("institution")).alias("institution"), present(F.col("industry")).alias("industry"), iso_date(F.col("report_date")).alias("day")).distinct()


def newest_reports(spark: SparkSession, root: str) -> DataFrame:
    """The five newest reports of each stock."""
    dated = _reports(spark, root).filter("day is not null")
    return relational.newest_per_key(dated, "stock_code", [F.desc("day"), F.asc("report_id")], 5).select("stock_code", "report_id", "day", "rank")


def reports_since(spark: SparkSession, root: str) -> DataFrame:
    """Reports since a day; those without a date are left out."""
    return _reports(spark, root).filter(F.col("day") >= F.lit(SINCE).cast("date")).select("report_id", "day")


def report_files(spark: SparkSession, root: str) -> DataFrame:
    """The PDF of each report by code, day, institution and title; the first file name counts."""
    files = read_table(spark, root, "pdf_map").select("stock_code", iso_date(F.col("report_date")).alias("day"), "institution", F.col("report_title"), F.col("pdf_file").alias("file"), F.col("pdf_file").alias("ord"))
    joined = relational.first_match(_reports(spark, root), files, ["stock_code", "day", "institution", "report_title"], "ord", "file")
    return joined.select("report_id", "file")


def stock_industry(spark: SparkSession, root: str) -> DataFrame:
    """The industry of each stock: that of the last report with one."""
    return relational.last_value_per_key(_reports(spark, root), "stock_code", "industry", ["report_id"])


def major_industry(spark: SparkSession, root: str) -> DataFrame:
    """Sub-industries through the register; unknown ones stay."""
    mapping = read_table(spark, root, "stocks").filter("industry_sub is not null").groupBy("industry_sub").agg(F.min("industry_major").alias("major"))
    return relational.lookup_or_same(_reports(spark, root).select("report_id", "industry"), mapping, "industry", "industry_sub", "major").select("report_id", "industry")


def unreported_stocks(spark: SparkSession, root: str) -> DataFrame:
    """Registered stocks without a report."""
    return relational.not_done(read_table(spark, root, "stocks"), _reports(spark, root).filter("stock_code is not null"), "stock_code").select("stock_code", "stock_name")


def merged_crawls(spark: SparkSession, root: str) -> DataFrame:
    """Earlier crawls, and later ones of stocks and days that the earlier don't have."""
    rows = _reports(spark, root).filter("stock_code is not null and day is not null").select("stock_code", "day", "report_id")
    return relational.merge_old_first(rows.filter("report_id % 2 = 0"), rows.filter("report_id % 2 = 1"), ["stock_code", "day"])


def latest_ratings(spark: SparkSession, root: str) -> DataFrame:
    """The rating of each report file's stock, overridden by the reports."""
    old = read_table(spark, root, "pdf_map").filter("rating is not null").groupBy("stock_code").agg(F.max_by("rating", "pdf_file").alias("rating"))
    new = relational.last_value_per_key(_reports(spark, root), "stock_code", "rating", ["report_id"])
    return relational.override(old, new, "stock_code", "rating")


def rating_counts(spark: SparkSession, root: str) -> DataFrame:
    """Reports, stocks and institutions of each rating."""
    return _reports(spark, root).groupBy("rating").agg(F.count(F.lit(1)).alias("n_reports"), F.count_distinct("stock_code").alias("n_stocks"), F.count_distinct("institution").alias("n_institutions"))


def title_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Industries that a report's title names, longest alias first, at most two."""
    named = relational.contained_aliases(_reports(spark, root).filter("report_title is not null").select("report_id", "report_title"), "report_title", ALIASES, 2)
    return named.filter(F.size("matches") > 0).select("report_id", F.array_join("matches", "/").alias("industries"))


def industry_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Aliases of the registered industries."""
    return relational.alias_table(read_table(spark, root, "stocks").select("industry_major", "industry_sub").distinct(), "industry_major", "industry_sub", {"软件": "信息", "药": "医药"})


def report_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of each report as text, with its id."""
    return facts.report_text(read_table(spark, root, "all_reports"))


def report_forecasts(spark: SparkSession, root: str) -> DataFrame:
    """Forecasts as rows of report and year."""
    return facts.forecasts_long(read_table(spark, root, "all_reports"))


def chunk_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Chunks, stocks and mean length of each source type; each chunk once."""
    chunks = read_table(spark, root, "all_chunks").select("chunk_id", "source_type", "stock_code", "text").distinct()
    return relational.corpus_statistics(chunks)


def chunk_methods(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of each method; those without a method count too, table facts don't."""
    chunks = read_table(spark, root, "all_chunks").select("chunk_id", "source_type", "chunk_method").distinct()
    return chunks.filter(~F.col("chunk_method").eqNullSafe("table_row_fact")).groupBy("source_type", "chunk_method").agg(F.count(F.lit(1)).alias("n_chunks"))


def index_rows(spark: SparkSession, root: str) -> DataFrame:
    """Chunks as rows of an index, with all its fields in their widths."""
    return indexing.index_rows(read_table(spark, root, "all_chunks").withColumnRenamed("report_date", "date"))


def indexed_reports(spark: SparkSession, root: str) -> DataFrame:
    """The first 100 index rows of two industries' reports: the limit is the feature."""
    wanted = {"source_type": "report", "industry": ["医药", "能源"]}
    return indexing.scan_index(index_rows(spark, root), wanted, ["chunk_id", "stock_code", "industry", "date"], 100)


def word_frequencies(spark: SparkSession, root: str) -> DataFrame:
    """In how many documents each word stands."""
    documents = read_table(spark, root, "documents").filter("text is not null")
    return indexing.postings(documents, "doc_id", search_words(F.col("text")))[1]


def indicator_facts(spark: SparkSession, root: str) -> DataFrame:
    """Indicators of the financial chunks as rows."""
    return facts.indicators(read_table(spark, root, "all_chunks")).select("chunk_id", "metric", "value", "unit")


def indicators_with_prior(spark: SparkSession, root: str) -> DataFrame:
    """Each indicator beside the value of the same period a year before, as text; of several chunks of a period the last by id counts."""
    rows = facts.indicators(read_table(spark, root, "all_chunks"))
    one = rows.groupBy("stock_code", "season", "year", "metric").agg(F.max_by("value", "chunk_id").alias("value"), F.max_by("unit", "chunk_id").alias("unit")).withColumn("series", F.concat_ws("|", "stock_code", "metric"))
    both = relational.with_prior_period(one, "series", "year", "season", ["value"])
    return both.select("stock_code", "season", "year", "metric", "value", "prior_value", facts.with_previous(F.col("value"), F.col("prior_value"), F.col("metric"), F.col("unit")).alias("text"))


def latest_annual(spark: SparkSession, root: str) -> DataFrame:
    """The last annual figures of each stock."""
    rows = facts.indicators(read_table(spark, root, "all_chunks")).filter("season = '12-31'").select("stock_code", "day", "chunk_id").distinct()
    return relational.first_of_group(rows, ["stock_code"], [F.desc("day"), F.asc("chunk_id")])


def peer_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Stocks of each industry by their last annual figures."""
    rows = facts.indicators(read_table(spark, root, "all_chunks"))
    return facts.compare_peers(rows.join(latest_annual(spark, root).select("chunk_id"), "chunk_id"), "industry", "stock_name", METRICS, "净资产收益率")


def return_checks(spark: SparkSession, root: str) -> DataFrame:
    """Whether margin, turnover and multiplier of each financial chunk multiply to its return; the turnover is taken as the share of days."""
    rows = facts.indicators(read_table(spark, root, "all_chunks")).groupBy("chunk_id").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(a) for m, a in (("净利率", "margin"), ("存货周转天数", "days"), ("资产负债率", "debt"), ("净资产收益率", "roe"))))
    multiplier = F.when(F.col("debt") < 100, 100 / (100 - F.col("debt")))
    turnover = F.when(F.col("days") > 0, 36.5 / F.col("days"))
    return rows.select("chunk_id", facts.check_product(F.col("margin"), turnover, multiplier, F.col("roe")).alias("verdict")).filter("verdict is not null")


def order_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Order totals as readable amounts."""
    o = read_table(spark, root, "orders")
    return o.select("o_orderkey", number2(F.col("o_totalprice")).alias("plain"), amount(F.col("o_totalprice")).alias("small"), amount(F.col("o_totalprice") * 1000).alias("large"))


def clean_names(spark: SparkSession, root: str) -> DataFrame:
    """Stock names without spaces, empty for what stands for nothing."""
    return read_table(spark, root, "all_reports").filter("report_id is not null").select("report_id", safe_text(F.col("stock_name")).alias("name")).distinct()


def result_lines(spark: SparkSession, root: str) -> DataFrame:
    """Chunks as lines of at most 200 characters, cut after a sentence where one ends late enough."""
    flat = strip_u(F.regexp_replace(F.regexp_replace(F.col("text"), "<[^>]+>", ""), r"(?U)\s+", " "))
    return read_table(spark, root, "all_chunks").filter("chunk_id is not null and text is not null").select("chunk_id", cut_at(flat, 200, "。").alias("line")).distinct()


def fixed_window_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Documents in windows of 300 characters with an overlap of 60."""
    return chunking.fixed_windows(read_table(spark, root, "documents"), ["doc_id"])


def sliding_window_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Documents in windows that end with a sentence."""
    return chunking.sliding_windows(read_table(spark, root, "documents"), "doc_id", "text")


def calculations(spark: SparkSession, root: str) -> DataFrame:
    """Every calculation of the trajectories, evaluated."""
    steps = trajectory.steps_of(read_table(spark, root, "sft_data")).filter("tool = 'calculate'")
    return steps.select("sample_id", "step_no", "query", calculate("query").alias("result"), calculate_value("query").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        newest_reports, reports_since, report_files, stock_industry, major_industry, unreported_stocks, merged_crawls, latest_ratings, rating_counts, title_aliases, industry_aliases, report_chunks, report_forecasts, chunk_statistics, chunk_methods, index_rows, indexed_reports, word_frequencies,
        indicator_facts, indicators_with_prior, latest_annual, peer_comparison, return_checks, order_amounts, clean_names, result_lines, fixed_window_chunks, sliding_window_chunks, calculations,
    )
}

_R = """
WITH r AS (SELECT DISTINCT report_id, CASE WHEN lower(trim(stock_code)) NOT IN ('', 'nan') THEN stock_code END AS stock_code, report_title,
  CASE WHEN lower(trim(rating)) NOT IN ('', 'nan') THEN rating END AS rating, CASE WHEN lower(trim(institution)) NOT IN ('', 'nan') THEN institution END AS institution,
  CASE WHEN lower(trim(industry)) NOT IN ('', 'nan') THEN industry END AS industry, TRY_CAST(replace(report_date[1:10], '/', '-') AS DATE) AS day FROM all_reports WHERE report_id IS NOT NULL)
"""
_I = r"""
WITH f AS (SELECT DISTINCT chunk_id, stock_code, stock_name, industry, TRY_CAST(report_date AS DATE) AS day, regexp_extract(text, '财务指标：(.*)。', 1) AS body FROM all_chunks WHERE source_type = 'financial' AND stock_code IS NOT NULL),
p AS (SELECT chunk_id, stock_code, stock_name, industry, day, unnest(string_split(body, '，')) AS part FROM f WHERE day IS NOT NULL),
i AS (SELECT *, strftime(day, '%m-%d') AS season, year(day) AS year, regexp_extract(part, '^(.*?)-?\d', 1) AS metric, TRY_CAST(regexp_extract(part, '(-?\d+(?:\.\d+)?)(?:%|亿元|元|次|天)*$', 1) AS DOUBLE) AS value, regexp_extract(part, '\d(%|亿元|元|次|天)$', 1) AS unit FROM p)
"""
_HELD = {"chunk_method": 32, "stock_code": 16, "stock_name": 64, "institution": 128, "industry": 64, "rating": 32, "report_title": 256, "pdf_file": 256, "current_section": 256}
_LACKING = ("parser", "data_type", "table_type", "header_type", "parent_id", "parent_md", "table_caption", "table_footnote", "section_id", "section_title", "section_text", "stock_codes")
_INDEX = (
    "WITH d AS (SELECT DISTINCT chunk_id, text, source_type, report_date, page_idx, chunk_index, "
    + ", ".join(_HELD)
    + " FROM all_chunks WHERE chunk_id IS NOT NULL), x AS (SELECT chunk_id[1:256] AS chunk_id, coalesce(text, '')[1:4096] AS text, coalesce(source_type, 'unknown')[1:32] AS source_type, coalesce(report_date, '')[1:24] AS date, coalesce(page_idx, -1) AS page_idx, coalesce(chunk_index, -1) AS chunk_index, -1 AS company_count, "
    + ", ".join([f"coalesce({c}, '')[1:{n}] AS {c}" for c, n in _HELD.items()] + [f"'' AS {c}" for c in _LACKING])
    + " FROM d) "
)
SQL = {
    "newest_reports": _R + "SELECT stock_code, report_id, day, rank FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY day DESC, report_id) AS rank FROM r WHERE day IS NOT NULL AND stock_code IS NOT NULL) WHERE rank <= 5",
    "reports_since": _R + "SELECT report_id, day FROM r WHERE day >= DATE '2024-01-01'",
    "report_files": _R + "SELECT report_id, file FROM r LEFT JOIN (SELECT stock_code, TRY_CAST(report_date[1:10] AS DATE) AS day, institution, report_title, min(pdf_file) AS file FROM pdf_map GROUP BY ALL) USING (stock_code, day, institution, report_title)",
    "stock_industry": _R + "SELECT stock_code, arg_max(industry, report_id) AS industry FROM r WHERE stock_code IS NOT NULL AND industry IS NOT NULL GROUP BY 1",
    "major_industry": _R + "SELECT report_id, coalesce(m.major, industry) AS industry FROM r LEFT JOIN (SELECT industry_sub, min(industry_major) AS major FROM stocks GROUP BY 1) m ON industry = industry_sub",
    "unreported_stocks": _R + "SELECT stock_code, stock_name FROM stocks WHERE stock_code NOT IN (SELECT stock_code FROM r WHERE stock_code IS NOT NULL)",
    "merged_crawls": _R + ", k AS (SELECT stock_code, day, report_id FROM r WHERE stock_code IS NOT NULL AND day IS NOT NULL) SELECT * FROM k WHERE report_id % 2 = 0 UNION ALL SELECT * FROM k WHERE report_id % 2 = 1 AND (stock_code, day) NOT IN (SELECT (stock_code, day) FROM k WHERE report_id % 2 = 0)",
    "latest_ratings": _R + ", o AS (SELECT stock_code, arg_max(rating, pdf_file) AS rating FROM pdf_map WHERE rating IS NOT NULL GROUP BY 1), n AS (SELECT stock_code, arg_max(rating, report_id) AS rating FROM r WHERE stock_code IS NOT NULL AND rating IS NOT NULL GROUP BY 1) SELECT stock_code, coalesce(n.rating, o.rating) AS rating FROM o FULL JOIN n USING (stock_code)",
    "rating_counts": _R + "SELECT rating, count(*) AS n_reports, count(DISTINCT stock_code) AS n_stocks, count(DISTINCT institution) AS n_institutions FROM r GROUP BY 1",
    "title_aliases": _R
    + ", a AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{t}', {i})" for i, (a, t) in enumerate(sorted(ALIASES.items(), key=lambda x: -len(x[0]))))
    + ") v(alias, target, pos)), m AS (SELECT report_id, target, min(pos) AS pos FROM r JOIN a ON contains(report_title, alias) GROUP BY 1, 2) SELECT report_id, string_agg(target, '/' ORDER BY pos) AS industries FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS n FROM m) WHERE n <= 2 GROUP BY 1",
    "industry_aliases": "WITH t AS (SELECT DISTINCT industry_major AS m, industry_sub AS s FROM stocks), a AS (SELECT m AS target, m AS alias, 1 AS p FROM t UNION ALL SELECT m, s, 0 FROM t UNION ALL SELECT m, regexp_replace(s, '[ⅠⅡⅢ]$', ''), 0 FROM t UNION ALL VALUES ('信息', '软件', 2), ('医药', '药', 2)) SELECT alias, min({'p': p, 't': target}).t AS target FROM a WHERE alias <> '' GROUP BY 1",
    "report_chunks": r"""
WITH d AS (SELECT DISTINCT report_id, stock_code, stock_name, report_title, institution, rating, report_date, eps_2025, pe_2025, eps_2026, pe_2026, eps_2027, pe_2027 FROM all_reports WHERE report_id IS NOT NULL),
e AS (SELECT *, coalesce(strftime(TRY_CAST(replace(report_date[1:10], '/', '-') AS DATE), '%Y%m%d'), '') AS dk,
  CASE WHEN regexp_replace(institution, '^[\s\x{a0}\x{3000}\x{2000}-\x{200a}]+|[\s\x{a0}\x{3000}\x{2000}-\x{200a}]+$', '', 'g') NOT IN ('', 'nan') THEN institution END AS inst, CASE WHEN trim(rating) NOT IN ('', 'nan') THEN rating END AS rat,
  concat_ws('；', CASE WHEN NOT isnan(eps_2025) AND NOT isnan(pe_2025) THEN format('2025年预测EPS {:.2f}元，PE {:.2f}倍', eps_2025, pe_2025) END,
    CASE WHEN NOT isnan(eps_2026) AND NOT isnan(pe_2026) THEN format('2026年预测EPS {:.2f}元，PE {:.2f}倍', eps_2026, pe_2026) END, CASE WHEN NOT isnan(eps_2027) AND NOT isnan(pe_2027) THEN format('2027年预测EPS {:.2f}元，PE {:.2f}倍', eps_2027, pe_2027) END) AS years FROM d)
SELECT report_id, 'report_' || coalesce(stock_code, '') || '_' || dk || '_' || coalesce(inst, '') || '_' || md5(coalesce(report_title, ''))[1:12] AS chunk_id,
  concat_ws(chr(10), coalesce(stock_name, '') || '(' || coalesce(stock_code, '') || ') 研报：' || coalesce(report_title, ''), '出品机构：' || inst, '评级：' || rat, CASE WHEN years <> '' THEN '盈利预测：' || years END) AS text FROM e""",
    "report_forecasts": "SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT report_id, {y} AS year, CASE WHEN isnan(eps_{y}) THEN NULL ELSE eps_{y} END AS eps, CASE WHEN isnan(pe_{y}) THEN NULL ELSE pe_{y} END AS pe FROM all_reports WHERE report_id IS NOT NULL" for y in (2025, 2026, 2027)) + ") WHERE eps IS NOT NULL OR pe IS NOT NULL",
    "chunk_statistics": "SELECT source_type, count(*) AS n_chunks, count(DISTINCT CASE WHEN stock_code <> '' THEN stock_code END) AS n_stocks, round(avg(length(text)), 4) AS mean_length FROM (SELECT DISTINCT chunk_id, source_type, stock_code, text FROM all_chunks) GROUP BY 1",
    "chunk_methods": "SELECT source_type, chunk_method, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, source_type, chunk_method FROM all_chunks) WHERE chunk_method IS DISTINCT FROM 'table_row_fact' GROUP BY 1, 2",
    "index_rows": _INDEX + "SELECT * FROM x",
    "indexed_reports": _INDEX + "SELECT chunk_id, stock_code, industry, date FROM x WHERE source_type = 'report' AND industry IN ('医药', '能源') ORDER BY chunk_id LIMIT 100",
    "word_frequencies": r"WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '(\p{Han}+)', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^\p{Han}{2}') THEN list_transform(range(1, length(w)), lambda i: w[i:i + 1]) ELSE [w] END)) AS ws FROM h) SELECT word, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY 1",
    "indicator_facts": _I + "SELECT chunk_id, metric, value, unit FROM i WHERE metric <> '' AND value IS NOT NULL",
    "indicators_with_prior": _I
    + ", o AS (SELECT stock_code, season, year, metric, arg_max(value, chunk_id) AS value, arg_max(unit, chunk_id) AS unit FROM i WHERE metric <> '' AND value IS NOT NULL GROUP BY ALL) SELECT o.stock_code, o.season, o.year, o.metric, o.value, b.value AS prior_value, o.metric || format('{:.2f}', o.value) || o.unit || CASE WHEN b.value IS NULL THEN '' ELSE '（上年同期' || format('{:.2f}', b.value) || o.unit || '）' END AS text FROM o LEFT JOIN o b ON b.stock_code = o.stock_code AND b.season = o.season AND b.metric = o.metric AND b.year = o.year - 1",
    "latest_annual": _I + "SELECT stock_code, day, chunk_id FROM (SELECT DISTINCT stock_code, day, chunk_id, dense_rank() OVER (PARTITION BY stock_code ORDER BY day DESC, chunk_id) AS n FROM i WHERE season = '12-31' AND metric <> '' AND value IS NOT NULL) WHERE n = 1",
    "peer_comparison": _I
    + ", l AS (SELECT chunk_id FROM (SELECT DISTINCT stock_code, day, chunk_id, dense_rank() OVER (PARTITION BY stock_code ORDER BY day DESC, chunk_id) AS n FROM i WHERE season = '12-31' AND metric <> '' AND value IS NOT NULL) WHERE n = 1), w AS (SELECT industry, stock_name, "
    + ", ".join(f"max(value) FILTER (metric = '{m}') AS m{k}" for k, m in enumerate(METRICS))
    + " FROM i JOIN l USING (chunk_id) WHERE industry IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2) SELECT industry, count(*) AS n_members, "
    + ", ".join(f"round(avg(m{k}), 6) AS mean_{k}" for k in range(len(METRICS)))
    + ", string_agg(stock_name || ' ' || coalesce(format('{:.2f}', m0), '-'), '；' ORDER BY coalesce(m0, 0) DESC, stock_name) AS members FROM w WHERE coalesce(m0, m1, m2, m3, m4) IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "return_checks": _I
    + ", w AS (SELECT chunk_id, max(value) FILTER (metric = '净利率') AS m, max(value) FILTER (metric = '存货周转天数') AS d, max(value) FILTER (metric = '资产负债率') AS a, max(value) FILTER (metric = '净资产收益率') AS r FROM i GROUP BY 1), q AS (SELECT chunk_id, r, m * CASE WHEN d > 0 THEN 36.5 / d END * CASE WHEN a < 100 THEN 100 / (100 - a) END AS p FROM w) SELECT chunk_id, CASE WHEN abs(p - r) > 3 OR abs(p - r) / greatest(abs(r), 1) > 0.3 THEN 'none' WHEN abs(p - r) > 1 THEN 'warning' ELSE 'ok' END AS verdict FROM q WHERE p IS NOT NULL AND r IS NOT NULL",
    "order_amounts": "SELECT o_orderkey, format('{:.2f}', o_totalprice) AS plain, CASE WHEN abs(o_totalprice) >= 1e8 THEN format('{:.2f}亿元', o_totalprice / 1e8) WHEN abs(o_totalprice) >= 1e4 THEN format('{:.2f}万元', o_totalprice / 1e4) ELSE format('{:.2f}元', o_totalprice) END AS small, CASE WHEN abs(o_totalprice * 1000) >= 1e8 THEN format('{:.2f}亿元', o_totalprice * 1000 / 1e8) WHEN abs(o_totalprice * 1000) >= 1e4 THEN format('{:.2f}万元', o_totalprice * 1000 / 1e4) ELSE format('{:.2f}元', o_totalprice * 1000) END AS large FROM orders",
    "clean_names": "SELECT DISTINCT report_id, coalesce(CASE WHEN stock_name <> 'nan' THEN replace(replace(stock_name, ' ', ''), '　', '') END, '') AS name FROM all_reports WHERE report_id IS NOT NULL",
    "result_lines": r"""
WITH c AS (SELECT DISTINCT chunk_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) AS t FROM all_chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT *, t[1:200] AS h, instr(reverse(t[1:200]), '。') AS k FROM c)
SELECT DISTINCT chunk_id, CASE WHEN length(t) <= 200 THEN t WHEN k > 0 AND 200 - k > 100 THEN h[1:201 - k] ELSE h || '...' END AS line FROM h""",
    "fixed_window_chunks": r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, s, regexp_replace(substr(t, s + 1, 300), '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g') AS chunk FROM d, unnest(range(0, length(t), 240)) u(s) WHERE length(t) > 300)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, chunk FROM w WHERE length(chunk) >= 50 UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) BETWEEN 20 AND 300""",
    "sliding_window_chunks": r"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
m AS (SELECT doc_id, text, n, CASE WHEN n <= 512 THEN [] ELSE list_filter(range(1, n + 1), lambda i: contains('。；' || chr(10), substr(text, i, 1))) END AS marks FROM d),
w AS (
  SELECT doc_id, text, n, marks, 0::BIGINT AS s, CASE WHEN 512 < n AND coalesce(list_max(list_filter(marks, lambda k: k <= 512)), 0) - 1 > 256 THEN list_max(list_filter(marks, lambda k: k <= 512)) ELSE 512 END::BIGINT AS e FROM m WHERE n > 512
  UNION ALL
  SELECT doc_id, text, n, marks, e - 64, CASE WHEN e - 64 + 512 < n AND coalesce(list_max(list_filter(marks, lambda k: k > e - 64 AND k <= e - 64 + 512)), 0) - 1 - (e - 64) > 256 THEN list_max(list_filter(marks, lambda k: k > e - 64 AND k <= e - 64 + 512)) ELSE e - 64 + 512 END FROM w WHERE e - 64 < n),
p AS (SELECT doc_id, s, regexp_replace(substr(text, s + 1, e - s), '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+$', '', 'g') AS chunk FROM w WHERE s < n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, chunk FROM p WHERE length(chunk) >= 50 UNION ALL SELECT doc_id, 0, text FROM d WHERE n BETWEEN 50 AND 512""",
}
