"""Indicator facts parsed from and rendered to text, and comparisons of peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import iso_date, number2, present


def indicators(chunks: DataFrame) -> DataFrame:
    """(chunk_id, stock_code, stock_name, day, year, season, industry, metric, value, unit): the indicators that financial chunks state as text.

    Chunks without code or date are left out; repeated rows count once.
    """
    rows = chunks.filter("source_type = 'financial' and stock_code is not null").select("chunk_id", "stock_code", "stock_name", "industry", "report_date", "text").distinct()
    rows = rows.withColumn("day", iso_date(F.col("report_date"))).filter("day is not null")
    parts = F.regexp_extract_all(F.regexp_extract("text", "财务指标：(.*)。", 1), F.lit("([^，]+)"), F.lit(1))
    one = rows.select("chunk_id", "stock_code", "stock_name", "industry", "day", F.explode(parts).alias("part"))
    value = F.regexp_extract("part", r"(-?\d+(?:\.\d+)?)(?:%|亿元|元|次|天)*$", 1)
    return one.select(
        "chunk_id", "stock_code", "stock_name", "industry", "day", F.year("day").alias("year"), F.date_format("day", "MM-dd").alias("season"),
        F.regexp_extract("part", r"^(.*?)-?\d", 1).alias("metric"), F.try_to_number(value, F.lit("S999999999.9999")).cast("double").alias("value"), F.regexp_extract("part", r"\d(%|亿元|元|次|天)$", 1).alias("unit"),
    ).filter("metric <> '' and value is not null")


def with_previous(value: Column, previous: Column, label: Column, unit: Column) -> Column:
    """Label and value, with the value of the same period a year before if there is one."""
    return F.when(previous.isNotNull(), F.concat(label, number2(value), unit, F.lit("（上年同期"), number2(previous), unit, F.lit("）"))).otherwise(F.concat(label, number2(value), unit))


def compare_peers(facts: DataFrame, group: str, member: str, metrics: list[str], sort_by: str, least: int = 2) -> DataFrame:
    """One row a group of at least ``least`` members: their number, the mean of each metric over those that have it, and the members in descending order.

    Members without the sorting metric count as 0 there; ties by member. Groups without any metric are left out. Members are pre-aggregated to one row each.
    """
    wide = facts.filter(F.col(group).isNotNull()).groupBy(group, member).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"m{i}") for i, m in enumerate(metrics)))
    some = F.coalesce(*(F.col(f"m{i}") for i in range(len(metrics)))).isNotNull()
    key = metrics.index(sort_by)
    lines = F.array_sort(F.collect_list(F.struct((-F.coalesce(F.col(f"m{key}"), F.lit(0.0))).alias("k"), F.col(member).alias("n"), F.col(f"m{key}").alias("v"))))
    out = wide.filter(some).groupBy(group).agg(F.count(F.lit(1)).alias("n_members"), *(F.round(F.avg(f"m{i}"), 6).alias(f"mean_{i}") for i in range(len(metrics))), lines.alias("_l")).filter(F.col("n_members") >= least)
    return out.withColumn("members", F.array_join(F.transform("_l", lambda x: F.concat(x["n"], F.lit(" "), F.coalesce(number2(x["v"]), F.lit("-")))), "；")).drop("_l")


def check_product(margin: Column, turnover: Column, multiplier: Column, reported: Column) -> Column:
    """Whether three factors multiply to the reported return: ``none`` if they are 3 points or 30 % apart, ``warning`` beyond one point, else ``ok``; null without one of them."""
    product = margin * turnover * multiplier
    gap = F.abs(product - reported)
    return F.when(product.isNull() | reported.isNull(), F.lit(None)).when((gap > 3.0) | (gap / F.greatest(F.abs(reported), F.lit(1.0)) > 0.3), "none").when(gap > 1.0, "warning").otherwise("ok")


def report_text(reports: DataFrame) -> DataFrame:
    """(report_id, chunk_id, text) of report metadata: name and code, title, institution, rating and the forecasts with both figures; the id is made of the key fields and a hash of the title."""
    rows = reports.filter("report_id is not null").select("report_id", "stock_code", "stock_name", "report_title", "institution", "rating", "report_date", *(f"{m}_{y}" for y in (2025, 2026, 2027) for m in ("eps", "pe"))).distinct()
    day = F.coalesce(F.date_format(iso_date(F.col("report_date")), "yyyyMMdd"), F.lit(""))
    code, name, title = (F.coalesce(F.col(c), F.lit("")) for c in ("stock_code", "stock_name", "report_title"))
    inst = F.coalesce(present(F.col("institution")), F.lit(""))

    def forecast(y: int) -> Column:
        eps, pe = F.col(f"eps_{y}"), F.col(f"pe_{y}")
        return F.when(~F.isnan(eps) & ~F.isnan(pe), F.concat(F.lit(f"{y}年预测EPS "), number2(eps), F.lit("元，PE "), number2(pe), F.lit("倍")))

    years = F.concat_ws("；", *(forecast(y) for y in (2025, 2026, 2027)))
    text = F.concat_ws("\n", F.concat(name, F.lit("("), code, F.lit(") 研报："), title), F.concat(F.lit("出品机构："), present(F.col("institution"))), F.concat(F.lit("评级："), present(F.col("rating"))), F.when(years != "", F.concat(F.lit("盈利预测："), years)))
    return rows.select("report_id", F.concat(F.lit("report_"), code, F.lit("_"), day, F.lit("_"), inst, F.lit("_"), F.substring(F.md5(title), 1, 12)).alias("chunk_id"), text.alias("text"))


def forecasts_long(reports: DataFrame) -> DataFrame:
    """(report_id, year, eps, pe): the forecast columns as rows; NaN is null, rows without any figure are left out."""
    pairs = F.array(*(F.struct(F.lit(y).alias("year"), F.nanvl(f"eps_{y}", F.lit(None)).alias("eps"), F.nanvl(f"pe_{y}", F.lit(None)).alias("pe")) for y in (2025, 2026, 2027)))
    return reports.filter("report_id is not null").select("report_id", F.explode(pairs).alias("x")).select("report_id", "x.year", "x.eps", "x.pe").filter("eps is not null or pe is not null").distinct()

