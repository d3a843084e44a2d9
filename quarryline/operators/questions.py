"""What questions and queries are about, by dictionaries given as parameters: dimensions, metrics, names, and how well queries cover what was asked."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import strip_u
from quarryline.operators.trajectory import any_word

_NONE = "array<string>"


def words_in(c: Column, words: Sequence[str]) -> Column:
    """The words that a text holds, in the order given; a word within a longer one counts as well."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.contains(c, w), F.lit(False))) if words else F.array().cast(_NONE)


def dimensions_of(c: Column, keywords: Mapping[str, Sequence[str]], metrics: Mapping[str, str], whole: Sequence[str] = (), whole_is: Sequence[str] = ()) -> Column:
    """The dimensions that a text is about: those whose keyword it holds and those of the metrics that it names, sorted; words for the whole picture (``whole``) stand for the dimensions ``whole_is`` and for nothing else."""
    by_word = [F.when(any_word(c, words), F.lit(name)) for name, words in keywords.items()]
    by_metric = [F.when(F.contains(c, F.lit(m)), F.lit(name)) for m, name in metrics.items()]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*by_word, *by_metric))))
    return F.when(any_word(c, whole), F.array(*map(F.lit, sorted(whole_is)))).otherwise(found) if whole else found


def dimensions_of_queries(queries: Column, metrics: Mapping[str, str]) -> Column:
    """The dimensions of the metrics that any of the queries names, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(queries, lambda q: F.array_compact(F.array(*(F.when(F.contains(q, F.lit(m)), F.lit(name)) for m, name in metrics.items())))))))


def covered_share(asked: Column, answered: Column) -> Column:
    """Share of the dimensions asked for that the queries cover; null if none was asked for."""
    return F.try_divide(F.size(F.array_intersect(asked, answered)).cast("double"), F.size(asked).cast("double"))


def halved_below(score: Column, rate: Column, least: float = 0.5) -> Column:
    """The score, halved if the rate is known and below ``least``."""
    return F.when(rate < least, score * 0.5).otherwise(score)


def has_year(c: Column) -> Column:
    """Whether a text names a year of the twenties."""
    return F.coalesce(c.rlike(r"202\d"), F.lit(False))


#: What a question begins with before a name, and words at which a name ends.
LEADS = ("请问", "请查询", "请分析", "查询", "分析", "对比", "比较", "看看", "帮我", "关于", "怎么看", "根据")
STOPS = ("的", "和", "与", "及", "在", "是", "有", "从", "行业", "公司", "最近", "今年", "去年", "未来", "如何", "怎么", "是否", "估值", "业绩", "风险", "财务", "营收", "利润")


def name_in(text: str, known: Sequence[str], least: int = 2, most: int = 8) -> str | None:
    """The name that a question is about: the longest known name in it, else the Chinese characters that it begins with (after its leading words) up to the first stop word or other sign; null if too few are left."""
    for name in known:
        if name in text:
            return name
    rest, changed = text.strip(), True
    while changed:
        changed = False
        for lead in LEADS:
            if rest.startswith(lead):
                rest, changed = rest[len(lead) :].lstrip("，,：: "), True
    run = rest[: next((i for i, c in enumerate(rest) if not "一" <= c <= "鿿"), len(rest))]
    ends = [i for w in STOPS if (i := run.find(w)) >= 0]
    run = run[: min(ends)] if ends else run
    return run if least <= len(run) <= most else None


def named_entities(df: DataFrame, keys: Sequence[str], text: str, names: DataFrame, name: str) -> DataFrame:
    """(keys, entity) of the texts with a name. ``names`` is a register of stated size, held by every task, searched longest first. Null texts give no row."""
    known = sorted((r[0] for r in names.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct().collect()), key=lambda n: (-len(n), n))
    sent = df.sparkSession.sparkContext.broadcast(known)
    columns = [*keys, "entity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(*k, name_in(t, sent.value)) for *k, t in zip(*(b[c] for c in (*keys, text)))]
            yield pd.DataFrame([x for x in found if x[-1] is not None], columns=columns)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.filter(F.col(text).isNotNull()).select(*keys, text).mapInPandas(run, f"{kinds}, entity string")


def entities_of_steps(entities: DataFrame, key: str, tool: str, tools: Sequence[str]) -> DataFrame:
    """(key, n_entities): how many different entities the queries of some tools are about."""
    return entities.filter(F.col(tool).isin(*tools)).groupBy(key).agg(F.count_distinct("entity").alias("n_entities"))


def graded(n: Column, full: int = 2) -> Column:
    """1 for at least ``full``, a half for one less, else 0."""
    return F.when(n >= full, 1.0).when(n == full - 1, 0.5).otherwise(0.0)


def check(kind: str, tools: Column, queries: Column, metrics: Sequence[str], n_entities: Column | None = None, tool: str = "") -> Column:
    """How far a trajectory meets a check, from 0 to 1: ``has_tool``, ``no_tool``, ``has_metric``, ``has_year``, ``several_metrics``, ``several_queries`` or ``several_entities`` (graded)."""
    any_query = lambda test: F.coalesce(F.exists(queries, test), F.lit(False))
    named = lambda q: F.size(words_in(q, metrics))
    made = {
        "has_tool": lambda: F.array_contains(tools, tool), "no_tool": lambda: ~F.array_contains(tools, tool), "has_metric": lambda: any_query(lambda q: named(q) > 0), "has_year": lambda: any_query(has_year), "several_metrics": lambda: any_query(lambda q: named(q) > 1), "several_queries": lambda: F.size(queries) > 1,
    }
    if kind == "several_entities":
        return graded(F.coalesce(n_entities if n_entities is not None else F.lit(0), F.lit(0)))
    return F.coalesce(made[kind]().cast("double"), F.lit(0.0))


def format_gate(completion: Column, n_steps: Column, declined: Column, most: int = 100) -> Column:
    """-1 for an empty completion, and for a long one without a call where none was to be declined; null where scores hold."""
    text = strip_u(F.coalesce(completion, F.lit("")))
    return F.when((text == "") | ((n_steps == 0) & (F.length(text) > most) & ~F.coalesce(declined, F.lit(False))), F.lit(-1.0))
