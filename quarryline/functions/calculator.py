"""Arithmetic on expressions given as data: a recursive-descent parser, never ``eval``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_POWER = 64
_FOLD = str.maketrans("×÷−－（）", "*/--()")
_TOKEN = re.compile(r"\s*(\d+\.?\d*|\.\d+|\*\*|//|[-+*/%()])")


class CalculationError(ValueError):
    """The expression can't be evaluated."""


def _tokens(text: str) -> list[str]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CalculationError("unexpected character")
        out.append(m[1])
        at = m.end()
    return out


class _Parser:
    """sum := product (+|- product)*; product := signed (*|/|//|% signed)*; signed := -signed | power; power := atom (** signed)?"""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self):
        value = self.product()
        while self.peek() in ("+", "-"):
            value = value + self.product() if self.take() == "+" else value - self.product()
        return value

    def product(self):
        value = self.signed()
        while self.peek() in ("*", "/", "//", "%"):
            op, other = self.take(), self.signed()
            value = value * other if op == "*" else value / other if op == "/" else value // other if op == "//" else value % other
        return value

    def signed(self):
        if self.peek() in ("-", "+"):
            return -self.signed() if self.take() == "-" else self.signed()
        return self.power()

    def power(self):
        value = self.atom()
        if self.peek() == "**":
            self.take()
            exponent = self.signed()
            if abs(exponent) > MAX_POWER or abs(value) > 1e12:
                raise CalculationError("power out of bounds")
            value = value**exponent
        return value

    def atom(self):
        token = self.peek()
        if token == "(":
            self.take()
            value = self.sum()
            if self.peek() != ")":
                raise CalculationError("bracket not closed")
            self.take()
            return value
        if not token or not (token[0].isdigit() or token[0] == "."):
            raise CalculationError("number expected")
        self.take()
        return float(token) if "." in token else int(token)


def evaluate(expression: str) -> int | float:
    """Value of the expression; ``5%`` is 0.05, and the call around it, quotes and full-width operators are tolerated."""
    text = expression.strip().strip("'\"")
    if m := re.match(r"^calculate\((.*)\)$", text, re.S):
        text = m[1].strip().strip("'\"")
    text = re.sub(r"(\d+\.?\d*)%", r"(\1/100)", text.translate(_FOLD))
    parser = _Parser(_tokens(text))
    value = parser.sum()
    if parser.peek():
        raise CalculationError("end expected")
    return value


def describe(expression: str | None, precision: int = 4) -> str | None:
    """The value as text, with 亿 and 万 for large ones, or a message of what is wrong; null for null."""
    if expression is None:
        return None
    try:
        value = evaluate(expression)
    except ZeroDivisionError:
        return "[计算错误] 除数为零"
    except (CalculationError, OverflowError, RecursionError):
        return "[计算错误] 无法计算"
    if isinstance(value, int):
        return f"计算结果: {value}"
    if isinstance(value, complex):
        return "[计算错误] 无法计算"
    if abs(value) >= 1e8:
        return f"计算结果: {value / 1e8:.{precision}f}亿"
    return f"计算结果: {value / 1e4:.{precision}f}万" if abs(value) >= 1e4 else f"计算结果: {value:.{precision}f}"


@F.pandas_udf(T.StringType())
def calculate(expressions: pd.Series) -> pd.Series:
    """Text result of each expression."""
    return expressions.map(describe)


@F.pandas_udf(T.DoubleType())
def calculate_value(expressions: pd.Series) -> pd.Series:
    """Bare value of each expression; null where it can't be evaluated."""

    def value(e: str | None) -> float | None:
        try:
            return None if e is None else float(evaluate(e))
        except (CalculationError, OverflowError, ZeroDivisionError, RecursionError, TypeError):
            return None

    return expressions.map(value).astype("float64")
