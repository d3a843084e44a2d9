"""Texts about a company's figures of one period, from maps of metric to value; the period a year before beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import amount, number2

# Metrics, how they are told, and their units; which are told with the value of the year before.
PROFIT_FIELDS = (
    ("净资产收益率(%)", "净资产收益率(ROE)", "%"), ("加权净资产收益率(%)", "加权ROE", "%"), ("主营业务利润率(%)", "主营业务利润率(毛利率)", "%"), ("销售净利率(%)", "销售净利率", "%"), ("营业利润率(%)", "营业利润率", "%"), ("总资产利润率(%)", "总资产利润率(ROA)", "%"),
    ("主营业务收入增长率(%)", "营收增长率", "%"), ("净利润增长率(%)", "净利润增长率", "%"), ("净资产增长率(%)", "净资产增长率", "%"), ("总资产增长率(%)", "总资产增长率", "%"),
    ("摊薄每股收益(元)", "每股收益(EPS)", "元"), ("每股净资产_调整后(元)", "每股净资产(BPS)", "元"), ("每股经营性现金流(元)", "每股经营现金流", "元"), ("每股未分配利润(元)", "每股未分配利润", "元"),
)
SOLVENCY_FIELDS = (("资产负债率(%)", "资产负债率", "%"), ("流动比率", "流动比率", ""), ("速动比率", "速动比率", ""), ("现金比率(%)", "现金比率", "%"), ("股东权益比率(%)", "股东权益比率", "%"), ("产权比率(%)", "产权比率", "%"))
EFFICIENCY_FIELDS = (
    ("总资产周转率(次)", "总资产周转率", "次"), ("存货周转率(次)", "存货周转率", "次"), ("存货周转天数(天)", "存货周转天数", "天"), ("应收账款周转率(次)", "应收账款周转率", "次"), ("应收账款周转天数(天)", "应收账款周转天数", "天"),
    ("经营现金净流量对销售收入比率(%)", "经营现金流/营收比", "%"), ("经营现金净流量与净利润的比率(%)", "经营现金流/净利润比", "%"),
)
WITH_PRIOR = ("净资产收益率(%)", "销售净利率(%)", "资产负债率(%)", "总资产周转率(次)", "主营业务收入增长率(%)", "净利润增长率(%)")
EQUITY, ASSETS = "股东权益比率(%)", "总资产(元)"


def figures_by_period(facts: DataFrame, keys: Sequence[str], metric: str, value: str) -> DataFrame:
    """(keys, now): the figures of each period as a map; of several values of a metric the largest counts, NaN and null are left out. ``keys`` identify a period and name nothing else."""
    valid = facts.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(metric).isNotNull())
    one = valid.groupBy(*keys, metric).agg(F.max(value).alias("_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(metric).alias("key"), F.col("_v").alias("value"))))).alias("now"))


def with_prior_map(periods: DataFrame, key: str, year: str, season: str) -> DataFrame:
    """Adds ``before``, the map of the same key and season a year before; null without one."""
    before = periods.select(key, season, (F.col(year) + 1).alias(year), F.col("now").alias("before"))
    return periods.join(before, [key, season, year], "left")


def _told(now: Column, before: Column, field: tuple[str, str, str]) -> Column:
    key, label, unit = field
    value = number2(F.try_element_at(now, F.lit(key)))
    text = F.concat(F.lit(label), value, F.lit(unit))
    if key not in WITH_PRIOR:
        return text
    prior = number2(F.try_element_at(before, F.lit(key)))
    return F.when(prior.isNotNull(), F.concat(text, F.lit("（上年同期"), prior, F.lit(f"{unit}）"))).otherwise(text)


def _sentence(header: Column, title: str, parts: Sequence[Column]) -> Column:
    body = F.concat_ws("，", *parts)
    return F.when(body != "", F.concat(header, F.lit(f"{title}，"), body, F.lit("。")))


def header_of(name: Column, code: Column, day: Column, label: Column) -> Column:
    """``name(code) day(label)``; the label is left out where it is empty."""
    return F.concat(name, F.lit("("), code, F.lit(") "), day.cast("string"), F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("("), label, F.lit(")"))).otherwise(F.lit("")))


def profit_text(header: Column, now: Column, before: Column) -> Column:
    """Profitability, growth, figures a share and assets as one sentence; null without any of them."""
    assets = F.try_element_at(now, F.lit(ASSETS))
    return _sentence(header, "盈利与成长指标", [*(_told(now, before, f) for f in PROFIT_FIELDS), F.concat(F.lit("总资产"), amount(assets))])


def multiplier_of(now: Column) -> Column:
    """Assets over equity, from the share of equity in percent; null unless that is positive."""
    equity = F.try_element_at(now, F.lit(EQUITY))
    return F.when(equity > 0, 100 / equity)


def structure_text(header: Column, now: Column, before: Column) -> Column:
    """Solvency, the multiplier computed from the share of equity, efficiency and cash flow as one sentence; null without any of them."""
    multiplier = F.concat(F.lit("权益乘数"), number2(multiplier_of(now)), F.lit("倍"))
    return _sentence(header, "偿债与运营指标", [*(_told(now, before, f) for f in SOLVENCY_FIELDS), multiplier, *(_told(now, before, f) for f in EFFICIENCY_FIELDS)])


def return_text(header: Column, now: Column, before: Column, apart: float = 3.0, apart_share: float = 0.3, noted: float = 1.0) -> Column:
    """The return on equity, its three factors and what they multiply to, as one sentence.

    Null without a factor, or if product and reported return are more than ``apart`` points or ``apart_share`` of the return (of 1 at least) apart; beyond ``noted`` points the gap is told.
    """
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    margin, turnover, multiplier, roe = of(now, "销售净利率(%)"), of(now, "总资产周转率(次)"), multiplier_of(now), of(now, "净资产收益率(%)")
    product = margin / 100 * turnover * multiplier * 100
    gap = F.abs(product - roe)

    def part(label: str, value: Column, unit: str, prior: Column) -> Column:
        return F.concat(F.lit(label), number2(value), F.lit(unit), F.coalesce(F.concat(F.lit("（上年同期"), number2(prior), F.lit(f"{unit}）")), F.lit("")))

    made = F.concat(F.lit("杜邦验算ROE≈"), number2(product), F.lit("%（净利率×周转率×权益乘数）"))
    told = F.when(gap > noted, F.concat(made, F.lit("，与报告ROE（"), number2(roe), F.lit("%）存在"), number2(gap), F.lit("个百分点差异，可能源于加权平均口径差异"))).otherwise(made)
    text = F.concat(
        header, F.lit("杜邦分析，"), F.concat_ws("，", F.when(roe.isNotNull(), part("净资产收益率(ROE)", roe, "%", of(before, "净资产收益率(%)"))), part("销售净利率", margin, "%", of(before, "销售净利率(%)")), part("总资产周转率", turnover, "次", of(before, "总资产周转率(次)")), part("权益乘数", multiplier, "倍", multiplier_of(before)), told), F.lit("。")
    )
    contradicts = F.coalesce((gap > apart) | (gap / F.greatest(F.abs(roe), F.lit(1.0)) > apart_share), F.lit(False))
    return F.when(margin.isNotNull() & turnover.isNotNull() & multiplier.isNotNull() & ~contradicts, text)
