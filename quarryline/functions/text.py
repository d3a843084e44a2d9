"""Text, number and date helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "一-鿿"


def strip_u(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def han_count(c: Column) -> Column:
    """Number of Chinese characters."""
    return F.length(F.regexp_replace(c, f"[^{HAN}]", ""))


def safe_text(c: Column) -> Column:
    """Empty for null and the text ``nan``; without spaces of either width."""
    return F.coalesce(F.when(c != "nan", F.translate(c, " 　", "")), F.lit(""))


def present(c: Column) -> Column:
    """Null for what stands for nothing: null, empty, ``nan``."""
    return F.when((strip_u(c) != "") & (F.lower(strip_u(c)) != "nan"), c)


def iso_date(c: Column) -> Column:
    """Date of a text of several formats; null where there is none."""
    day = F.regexp_replace(F.substring(c, 1, 10), "/", "-")
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")


def number2(c: Column) -> Column:
    """Two decimals of the exact binary value, without grouping."""
    return F.when(~F.isnan(c), F.call_function("format_number", c, F.lit("0.00")))


def amount(c: Column, unit: str = "元") -> Column:
    """An amount in hundreds of millions, ten thousands or plain, with two decimals."""
    return F.when(F.abs(c) >= 1e8, F.concat(number2(c / 1e8), F.lit(f"亿{unit}"))).when(F.abs(c) >= 1e4, F.concat(number2(c / 1e4), F.lit(f"万{unit}"))).when(~F.isnan(c), F.concat(number2(c), F.lit(unit)))


def cut_at(c: Column, limit: int, mark: str, tail: str = "...") -> Column:
    """The first ``limit`` characters, ended at the last mark beyond their half if there is one, else with the tail."""
    head = F.substring(c, 1, limit)
    last = F.lit(limit + 1) - F.instr(F.reverse(head), mark)
    return F.when(F.length(c) <= limit, c).when((F.instr(head, mark) > 0) & (last - 1 > limit // 2), F.substr(head, F.lit(1), last)).otherwise(F.concat(head, F.lit(tail)))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Shared character pairs over the smaller number of pairs; 0 for texts of one character."""

    def pairs(c: Column) -> Column:
        return F.when(F.length(c) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))

    x, y = pairs(a), pairs(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y)).cast("double")), F.lit(0.0))
