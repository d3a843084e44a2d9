"""Queries of what questions are about and how trajectories cover it, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import questions as Q
from quarryline.operators import trajectory as T
from quarryline.plans.retrieval import _K
from quarryline.sources import read_table

#: Dictionaries of the queries; parameters of the operators.
KEYWORDS = {"盈利能力": ("盈利", "赚钱", "毛利"), "偿债": ("偿债", "负债", "杠杆"), "营运效率": ("周转", "存货", "效率"), "成长性": ("增长", "变化", "成长"), "估值": ("估值", "合理")}
METRICS = {"净资产收益率": "盈利能力", "毛利率": "盈利能力", "净利率": "盈利能力", "资产负债率": "偿债", "存货周转天数": "营运效率", "营业收入": "成长性", "净利润": "成长性"}
WHOLE, WHOLE_IS = ("整体", "全面", "综合"), ("盈利能力", "偿债", "营运效率")


def question_dimensions(spark: SparkSession, root: str) -> DataFrame:
    """Dimensions, metrics and years that each question names."""
    rows = T.latest_samples(read_table(spark, root, "sft_data")).select("sample_id", F.coalesce("question", F.lit("")).alias("q"))
    named = Q.words_in(F.col("q"), tuple(METRICS))
    return rows.select("sample_id", F.array_join(Q.dimensions_of(F.col("q"), KEYWORDS, METRICS, WHOLE, WHOLE_IS), "/").alias("dimensions"), F.size(named).alias("n_metrics"), Q.has_year(F.col("q")).alias("has_year"), T.any_word(F.col("q"), WHOLE).alias("is_whole"))


def trajectory_checks(spark: SparkSession, root: str) -> DataFrame:
    """How far each trajectory meets the checks, its weighted coverage, and that halved where its queries miss what was asked."""
    samples = T.latest_samples(read_table(spark, root, "sft_data"))
    steps = T.steps_of(samples).groupBy("sample_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"), F.array_sort(F.collect_list("query")).alias("queries"))
    rows = samples.select("sample_id", F.coalesce("question", F.lit("")).alias("q")).join(steps, "sample_id")
    tools, queries, metrics = F.col("tools"), F.col("queries"), tuple(METRICS)
    degrees = {"financial": Q.check("has_tool", tools, queries, metrics, tool="search_financial"), "metric": Q.check("has_metric", tools, queries, metrics), "year": Q.check("has_year", tools, queries, metrics), "several": Q.check("several_queries", tools, queries, metrics)}
    asked = Q.dimensions_of(F.col("q"), KEYWORDS, METRICS, WHOLE, WHOLE_IS)
    coverage = T.coverage([(0.4, F.lit(True), degrees["financial"]), (0.3, F.size(asked) > 0, degrees["metric"]), (0.2, Q.has_year(F.col("q")), degrees["year"]), (0.1, F.lit(True), degrees["several"])])
    rate = Q.covered_share(asked, Q.dimensions_of_queries(queries, METRICS))
    return rows.select("sample_id", *(v.alias(k) for k, v in degrees.items()), F.round(coverage, 6).alias("coverage"), F.round(rate, 6).alias("rate"), F.round(Q.halved_below(coverage, rate), 6).alias("score"))


def question_names(spark: SparkSession, root: str) -> DataFrame:
    """The registered company that each question is about."""
    rows = T.latest_samples(read_table(spark, root, "sft_data")).select("sample_id", "question")
    stocks = read_table(spark, root, "stocks")
    return Q.named_entities(rows, ["sample_id"], "question", stocks, "stock_name").join(stocks.select(F.col("stock_name").alias("entity")).distinct(), "entity", "left_semi").select("sample_id", "entity")


def gated_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples whose form rules out any score."""
    samples = T.latest_samples(read_table(spark, root, "sft_data"))
    steps = T.steps_of(samples).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    rows = samples.select("sample_id", "question_type", F.try_element_at("messages", F.lit(-1))["content"].alias("a")).join(steps, "sample_id", "left")
    return rows.select("sample_id", Q.format_gate(F.col("a"), F.coalesce("n", F.lit(0)), F.col("question_type") == "reject").alias("score")).filter("score is not null")


QUERIES = {f.__name__: f for f in (question_dimensions, trajectory_checks, question_names, gated_samples)}

_DIMENSIONS = (
    "CASE WHEN "
    + " OR ".join(f"contains(q, '{w}')" for w in WHOLE)
    + f" THEN {sorted(WHOLE_IS)} ELSE list_sort(list_distinct(list_filter(["
    + ", ".join([f"CASE WHEN {' OR '.join(f"contains(q, '{w}')" for w in ws)} THEN '{d}' END" for d, ws in KEYWORDS.items()] + [f"CASE WHEN contains(q, '{m}') THEN '{d}' END" for m, d in METRICS.items()])
    + "], lambda x: x IS NOT NULL))) END"
)
_ASKED = "o AS (SELECT sample_id, arg_max(coalesce(question, ''), created_at) AS q, arg_max(coalesce(question_type, ''), created_at) AS question_type, arg_max(messages, created_at) AS ms FROM sft_data WHERE sample_id IS NOT NULL GROUP BY 1)"
_ANY = " OR ".join(f"contains(query, '{m}')" for m in METRICS)
SQL = {
    "question_dimensions": f"WITH {_ASKED} SELECT sample_id, array_to_string({_DIMENSIONS}, '/') AS dimensions, {' + '.join(f"contains(q, '{m}')::INT" for m in METRICS)} AS n_metrics, regexp_matches(q, '202\\d') AS has_year, {' OR '.join(f"contains(q, '{w}')" for w in WHOLE)} AS is_whole FROM o",
    "trajectory_checks": _K
    + f""", {_ASKED}, g AS (SELECT sample_id, bool_or(tool = 'search_financial')::INT::DOUBLE AS financial, bool_or({_ANY})::INT::DOUBLE AS metric, bool_or(regexp_matches(query, '202\\d'))::INT::DOUBLE AS year, (count(*) > 1)::INT::DOUBLE AS several FROM k GROUP BY 1),
d AS (SELECT sample_id, list_distinct(list(dim)) AS have FROM (SELECT sample_id, unnest([{', '.join(f"CASE WHEN contains(query, '{m}') THEN '{x}' END" for m, x in METRICS.items())}]) AS dim FROM k) WHERE dim IS NOT NULL GROUP BY 1),
a AS (SELECT g.*, {_DIMENSIONS} AS asked, coalesce(have, []) AS have, regexp_matches(q, '202\\d') AS y FROM g JOIN o USING (sample_id) LEFT JOIN d USING (sample_id)),
cv AS (SELECT *, (0.4::DOUBLE * financial + CASE WHEN len(asked) > 0 THEN 0.3::DOUBLE * metric ELSE 0 END + CASE WHEN y THEN 0.2::DOUBLE * year ELSE 0 END + 0.1::DOUBLE * several) / (0.5::DOUBLE + CASE WHEN len(asked) > 0 THEN 0.3 ELSE 0 END + CASE WHEN y THEN 0.2 ELSE 0 END) AS cov, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, have))::DOUBLE / len(asked) END AS r FROM a)
SELECT sample_id, financial, metric, year, several, round(cov, 6) AS coverage, round(r, 6) AS rate, round(CASE WHEN r < 0.5 THEN cov * 0.5 ELSE cov END, 6) AS score FROM cv""",
    "question_names": f"WITH {_ASKED} SELECT sample_id, stock_name AS entity FROM o JOIN stocks ON contains(q, stock_name) WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY length(stock_name) DESC, stock_name) = 1",
    "gated_samples": _K + f", {_ASKED}, n AS (SELECT sample_id, count(*) AS n FROM k GROUP BY 1) SELECT sample_id, -1.0::DOUBLE AS score FROM o LEFT JOIN n USING (sample_id) WHERE regexp_replace(coalesce(ms[-1].content, ''), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]', '', 'g') = '' OR (n IS NULL AND length(trim(ms[-1].content)) > 100 AND question_type <> 'reject')",
}
