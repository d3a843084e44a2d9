"""Tool-using conversations: parsing, rendering, steps and validation, all as expressions over arrays in the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import bigram_overlap, strip_u

DEFAULT_SYSTEM = "You are a helpful assistant."
#: Numbers that may stand in an expression without a source.
CONSTANTS = ("100", "1000", "10000")
NUMBER = r"(\d+\.?\d*)"
CALL = "name string, arguments string"


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text, as written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(1)))


def parse_call(response: Column) -> Column:
    """struct(content, name, arguments) of a model's output: the first call between tags that parses, else a bare JSON call; content is the text without calls, null if empty."""
    plain = strip_u(F.regexp_replace(response, r"<\|im_end\|>|<\|im_start\|>", ""))
    tagged = F.regexp_extract_all(plain, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    calls = F.filter(F.transform(tagged, lambda m: F.from_json(strip_u(F.regexp_replace(m, "</?tool_call>", "")), "name string, arguments string")), lambda c: c["name"].isNotNull())
    bare = r'(?s)\{"name"\s*:\s*"(\w+)"\s*,\s*"arguments"\s*:\s*(\{[^}]+\})'
    first = F.get(calls, F.lit(0))
    name = F.coalesce(first["name"], F.nullif(F.regexp_extract(plain, bare, 1), F.lit("")))
    arguments = F.when(first.isNotNull(), F.coalesce(first["arguments"], F.lit("{}"))).otherwise(F.nullif(F.regexp_extract(plain, bare, 2), F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(plain, r"(?s)<tool_call>\s*.*?\s*</tool_call>", ""), r'(?s)\{"name"\s*:.*$', "")
    return F.struct(F.nullif(strip_u(rest), F.lit("")).alias("content"), name.alias("name"), arguments.alias("arguments"))


def query_argument(arguments: Column) -> Column:
    """The query or expression that a call's arguments hold, also if they are encoded twice or are no JSON at all."""
    once = F.coalesce(F.get_json_object(arguments, "$.query"), F.get_json_object(arguments, "$.expression"))
    inner = F.get_json_object(F.concat(F.lit('{"x":'), arguments, F.lit("}")), "$.x")
    twice = F.coalesce(F.get_json_object(inner, "$.query"), F.get_json_object(inner, "$.expression"))
    return F.coalesce(once, twice, arguments)


def final_answer(completion: Column) -> Column:
    """The text after the last call and the last tool response, without tags."""
    after_call = F.element_at(F.split(completion, "<tool_call>"), -1)
    bare = F.regexp_replace(after_call, r"</tool_call>|<\|im_end\|>|<\|im_start\|>", "")
    return strip_u(F.when(F.contains(bare, F.lit("<tool_response>")), F.element_at(F.split(bare, "</tool_response>"), -1)).otherwise(bare))


def split_thought(content: Column, starters: Sequence[str] = ("根据", "综合", "结论", "总体")) -> Column:
    """struct(thought, answer): cut at the first blank line if the rest begins like an answer, else all is the answer."""
    parts = F.split(content, "\n\n", 2)
    rest = strip_u(F.get(parts, F.lit(1)))
    begins = F.exists(F.array(*map(F.lit, starters)), lambda s: F.startswith(rest, s))
    return F.when((F.size(parts) > 1) & begins, F.struct(strip_u(parts[0]).alias("thought"), rest.alias("answer"))).otherwise(F.struct(F.lit(None).cast("string").alias("thought"), content.alias("answer")))


def latest_samples(samples: DataFrame, key: str = "sample_id", version: str = "created_at") -> DataFrame:
    """One row of each id: the latest, of equally late ones (or without a version) the one with the least hash; rows without an id are left out."""
    rows = samples.filter(F.col(key).isNotNull())
    when = [F.desc(version)] if version in samples.columns else []
    at = F.row_number().over(Window.partitionBy(key).orderBy(*when, F.xxhash64(*samples.columns)))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at")


def steps_of(samples: DataFrame, key: str = "sample_id", messages: str = "messages") -> DataFrame:
    """(key, step_no, tool, query, observation, thought): one row a call, in order, with the tool message that answers it; several calls of a message are steps of their own."""
    unique = latest_samples(samples.filter(F.col(messages).isNotNull()), key)
    calls = F.flatten(F.transform(F.col(messages), lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,call_type:string,func:struct<name:string,arguments:string>>>")), lambda c: F.struct(c["id"].alias("id"), c["func"]["name"].alias("tool"), c["func"]["arguments"].alias("arguments"), m["content"].alias("thought")))))
    answers = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter(F.col(messages), lambda m: m["role"] == "tool"), lambda m: F.coalesce(m["tool_call_id"], F.lit("")))), lambda i: F.struct(i.alias("k"), F.try_element_at(F.filter(F.col(messages), lambda m: (m["role"] == "tool") & (F.coalesce(m["tool_call_id"], F.lit("")) == i)), F.lit(1))["content"].alias("v"))))
    rows = unique.select(key, answers.alias("_a"), F.posexplode(calls).alias("_i", "_c"))
    return rows.select(key, (F.col("_i") + 1).alias("step_no"), F.col("_c.tool").alias("tool"), query_argument(F.col("_c.arguments")).alias("query"), F.try_element_at("_a", F.coalesce("_c.id", F.lit(""))).alias("observation"), F.col("_c.thought").alias("thought"))


def render_chat(messages: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """The conversation as one text with role marks. A missing system message gets the default; consecutive tool messages share one user turn."""
    n = F.size(messages)

    def turn(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        prior, following = F.try_element_at(messages, i), F.try_element_at(messages, i + 2)
        calls = F.array_join(F.transform(m["tool_calls"], lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["func"]["name"], F.lit('", "arguments": '), c["func"]["arguments"], F.lit("}\n</tool_call>"))), "")
        opens = F.when((i == 0) | F.coalesce(prior["role"] != "tool", F.lit(True)), F.lit("<|im_start|>user")).otherwise(F.lit(""))
        closes = F.when((i == n - 1) | F.coalesce(following["role"] != "tool", F.lit(True)), F.lit("<|im_end|>\n")).otherwise(F.lit(""))
        return (
            F.when(m["role"] == "tool", F.concat(opens, F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"), closes))
            .when((m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0), F.concat(F.lit("<|im_start|>assistant"), F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(F.lit("")), calls, F.lit("<|im_end|>\n")))
            .otherwise(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), content, F.lit("<|im_end|>\n")))
        )

    # positions of try_element_at start at 1, so ``i`` is the message before
    turns = F.array_join(F.transform(messages, lambda m, i: turn(m, i)), "")
    return F.concat(F.when(F.coalesce(F.try_element_at(messages, F.lit(1))["role"] != "system", F.lit(True)), F.lit(f"<|im_start|>system\n{system}<|im_end|>\n")).otherwise(F.lit("")), turns)


def assistant_spans(rendered: Column) -> Column:
    """array<struct(start, end)> of what the assistant generated: after the role (and its line feed, in a turn without calls) up to and with the end mark; 0-based, end exclusive."""
    parts = F.split(rendered, r"<\|im_start\|>")
    sized = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.when(i == 0, F.length(p)).otherwise(F.length(p) + 12).alias("n")))
    state = "struct<at:int,out:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(state)

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + 12 + 9 + F.when(F.contains(x["p"], F.lit("\n<tool_call>\n")), F.lit(0)).otherwise(F.lit(1))
        end = a["at"] + 12 + F.instr(x["p"], "<|im_end|>") + 9
        own = F.startswith(x["p"], F.lit("assistant")) & (F.instr(x["p"], "<|im_end|>") > 0)
        return F.struct((a["at"] + x["n"]).alias("at"), F.when(own, F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end")).cast("struct<start:int,end:int>")))).otherwise(a["out"]).alias("out")).cast(state)

    return F.aggregate(sized, start, step)["out"]


def validate(samples: DataFrame, tools: Sequence[str], most_steps: int = 6, grounded: float = 0.5) -> DataFrame:
    """(sample_id, errors, is_valid): what is wrong with each trajectory.

    Checks: a question, an answer, known tools, an observation for each step, one to ``most_steps`` steps, at least the share ``grounded`` of the answer's numbers in
    observations (not for questions to be rejected), and operands above 10 of calculations in earlier observations.
    """
    one = latest_samples(samples).select("sample_id", "question", "question_type", F.try_element_at("messages", F.lit(-1))["content"].alias("answer"))
    grouped = steps_of(samples).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "tool", "query", "observation"))).alias("steps"))
    rows = one.join(grouped, "sample_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<step_no:int,tool:string,query:string,observation:string>>")))
    seen = numbers_in(F.array_join(F.transform("steps", lambda s: F.coalesce(s["observation"], F.lit(""))), " "))
    own = numbers_in(F.col("answer"))
    share = F.try_divide(F.size(F.array_intersect(own, seen)).cast("double"), F.size(own).cast("double"))

    def unsourced(s: Column) -> Column:
        earlier = numbers_in(F.array_join(F.transform(F.filter("steps", lambda t: t["step_no"] < s["step_no"]), lambda t: F.coalesce(t["observation"], F.lit(""))), " "))
        return F.exists(F.array_except(numbers_in(s["query"]), earlier), lambda n: (F.try_to_number(n, F.lit("999999999999.9999")).cast("double") > 10) & ~n.isin(*CONSTANTS))

    checks = (
        ("question", F.coalesce(F.col("question"), F.lit("")) == ""), ("steps", F.size("steps") == 0), ("too_many_steps", F.size("steps") > most_steps), ("answer", strip_u(F.coalesce(F.col("answer"), F.lit(""))) == ""),
        ("tool", F.exists("steps", lambda s: ~F.coalesce(s["tool"].isin(*tools), F.lit(False)))), ("observation", F.exists("steps", lambda s: F.coalesce(s["observation"], F.lit("")) == "")),
        ("grounding", (F.coalesce(F.col("question_type"), F.lit("")) != "reject") & (share < grounded)),
        ("operands", F.exists("steps", lambda s: (s["tool"] == "calculate") & unsourced(s))), ("no_operand", F.exists("steps", lambda s: (s["tool"] == "calculate") & (F.size(numbers_in(s["query"])) == 0))),
    )
    errors = F.concat_ws(",", *(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks))
    return rows.select("sample_id", errors.alias("errors")).withColumn("is_valid", F.col("errors") == "")


# What queries, calculations, refusals and faults score.
#: Lengths of a query that score in full and by half.
FULL_LENGTHS, HALF_LENGTHS = (8, 30), ((5, 7), (31, 50))
#: Score of a query by the number of metrics that it names (the last for more), and the weights of metrics, year, entity and length, for searches and for those of industries.
METRIC_STEPS, QUERY_WEIGHTS, INDUSTRY_WEIGHTS, CALCULATE_SCORE = (0.0, 0.57, 0.85, 1.0), (0.35, 0.25, 0.20, 0.20), (0.25, 0.20, 0.35, 0.20), 0.5
#: Penalties of a repeated query and of an unknown tool, the least of their sum, and the similarity from which a query is repeated.
REPEATED, UNKNOWN, LEAST_PENALTY, ALIKE = -0.3, -0.5, -1.0, 0.85
#: A calculation that was needed and worked: at the least, and more if it is well formed and if its result is used; one that wasn't needed, used and not; neither needed nor made.
CALCULATED, WELL_FORMED, USED, UNNEEDED_USED, UNNEEDED, NEITHER = 0.5, 0.25, 0.25, 0.5, 0.45, 0.5
#: A refusal that was due, by the number of calls before it (the last for more).
DECLINED_STEPS = (1.0, 1.0, 0.75, 0.5, 0.25)


def length_score(c: Column) -> Column:
    """1 for 8 to 30 characters, a half for 5 to 7 and 31 to 50, else 0."""
    n = F.length(c)
    half = n.between(*HALF_LENGTHS[0]) | n.between(*HALF_LENGTHS[1])
    return F.when(n.between(*FULL_LENGTHS), 1.0).when(half, 0.5).otherwise(0.0)


def _step(n: Column, steps: Sequence[float]) -> Column:
    """The score at a number, the last one beyond."""
    return F.element_at(F.array(*map(F.lit, steps)), F.least(n, F.lit(len(steps) - 1)) + 1)


def query_score(query: Column, tool: Column, metrics: Sequence[str], names: Sequence[str] = ()) -> Column:
    """Weighted score of a search query: metrics named (nested names count twice), a year, an entity, its length; calculations get a half."""
    named = F.coalesce(F.size(F.filter(F.array(*map(F.lit, metrics)), lambda m: F.contains(query, m))), F.lit(0))
    year = F.when(query.rlike(r"202\d"), 1.0).otherwise(0.0)
    entity = F.when(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(query, n)), 1.0).otherwise(0.0) if names else F.when(query.rlike("[一-鿿]{2,}"), 0.5).otherwise(0.0)
    parts = (_step(named, METRIC_STEPS), year, entity, length_score(query))

    def weighed(weights: Sequence[float]) -> Column:
        return sum((w * p for w, p in zip(weights, parts)), F.lit(0.0))

    return F.when(tool == "calculate", CALCULATE_SCORE).when(tool == "search_industry", weighed(INDUSTRY_WEIGHTS)).otherwise(weighed(QUERY_WEIGHTS))


def call_penalty(steps: Column, tools: Sequence[str], repeated: float = ALIKE) -> Column:
    """-0.3 for each query much like an earlier one, -0.5 for each unknown tool, -1 at least. ``steps`` is an array of struct(tool, query)."""
    again = F.size(F.filter(F.transform(steps, lambda s, i: F.exists(F.slice(steps, F.lit(1), i), lambda p: bigram_overlap(s["query"], p["query"]) > repeated)), lambda x: x))
    unknown = F.size(F.filter(steps, lambda s: ~F.coalesce(s["tool"].isin(*tools), F.lit(False))))
    return F.greatest(again * REPEATED + unknown * UNKNOWN + 0.0, F.lit(LEAST_PENALTY))


def overlong_penalty(text: Column, free: int = 8192, clip: int = 12288, most: float = 0.5) -> Column:
    """0 up to ``free`` estimated tokens (1.5 a character), rising to ``most`` at ``clip``."""
    n = F.floor(F.length(F.coalesce(text, F.lit(""))) * 1.5)
    return F.when(n <= free, 0.0).when(n <= clip, -(n - free) / F.lit(float(clip - free)) * most).otherwise(-most)


def coverage(rules: Sequence[tuple[float, Column, Column]]) -> Column:
    """Weighted share of the rules that hold, out of those that apply (weight, applies, degree from 0 to 1); a half if none applies."""
    total = sum((F.when(applies, w).otherwise(0.0) for w, applies, _ in rules), F.lit(0.0))
    earned = sum((F.when(applies, w * degree).otherwise(0.0) for w, applies, degree in rules), F.lit(0.0))
    return F.coalesce(F.try_divide(earned, total), F.lit(0.5))


def reuses_result(answer: Column, results: Column) -> Column:
    """Whether a number of at least three characters of a result stands in the answer, not within a longer number."""
    found = F.flatten(F.transform(results, lambda r: F.regexp_extract_all(r, F.lit(r"([\d.]+)"), F.lit(1))))
    return F.exists(found, lambda n: (F.length(n) >= 3) & F.coalesce(F.regexp(answer, F.concat(F.lit(r"(?<!\d)"), F.replace(n, F.lit("."), F.lit("\\.")), F.lit(r"(?!\d)"))), F.lit(False)))


# Words and forms that call for arithmetic, and words of declining.
CALCULATION_WORDS = ("差值", "差距", "差多少", "偏离", "拖累", "高出", "低出", "加权", "平均", "复合增长", "CAGR")
MENTAL_FORMS = (r"[\d.]+%?\s*[×*]\s*[\d.]+%?\s*[×*]\s*[\d.]+", r"1\s*/\s*[\d.]+%?\s*[=≈]\s*[\d.]+", r"[\d.]+\s*[-−]\s*[\d.]+\s*[=≈]\s*[\d.]+", r"[\d.]+\s*[/÷]\s*[\d.]+\s*[=≈]\s*[\d.]+", r"[\d.]+\s*[+]\s*[\d.]+\s*[=≈]\s*[\d.]+")
DECLINING = ("无法回答", "抱歉", "无法提供", "超出范围", "不在数据库", "没有相关数据", "无法分析", "不具备", "超出能力", "不在覆盖范围")


def any_word(c: Column, words: Sequence[str]) -> Column:
    """Whether a text contains one of the words; false for null."""
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(False))


def shows_arithmetic(answer: Column) -> Column:
    """Whether a text carries out a calculation by itself."""
    found = F.lit(False)
    for form in MENTAL_FORMS:
        found = found | F.coalesce(answer.rlike(form), F.lit(False))
    return found


#: The kind of question for which weaker words of comparison ask for arithmetic too, and these.
COMPARING, WEAK_WORDS = "company_comparison", ("差距", "差值", "差多少", "高出", "低出", "量化", "计算", "测算")


def needs_calculation(question: Column, answer: Column, kind: Column | None = None) -> Column:
    """Whether a question asks for arithmetic (in a comparison by weaker words too), or its answer shows some."""
    out = any_word(question, CALCULATION_WORDS) | shows_arithmetic(answer)
    return out if kind is None else out | (F.coalesce(kind == COMPARING, F.lit(False)) & any_word(question, WEAK_WORDS))


def calculation_score(needed: Column, answer: Column, expressions: Column, results: Column) -> Column:
    """From 0 to 1: calculations that were needed, worked and were used score most; needed ones that are missing or failed score 0; a half where none was needed nor made."""
    worked = F.filter(results, lambda r: F.coalesce((strip_u(r) != "") & ~r.rlike(r"^\[?计算(错误|失败)"), F.lit(False)))
    used = F.size(expressions) > 0
    formed = F.exists(expressions, lambda e: F.coalesce(e.rlike(r"\d+\.?\d*\s*[-+*/×÷]\s*\d+"), F.lit(False)))
    again = F.coalesce(reuses_result(answer, worked), F.lit(False))
    quality = CALCULATED + F.when(formed, WELL_FORMED).otherwise(0.0) + F.when(again, USED).otherwise(0.0)
    return F.when(needed & used, F.when(F.size(worked) > 0, quality).otherwise(0.0)).when(needed, 0.0).when(used, F.when(F.size(worked) == 0, 0.0).when(again, UNNEEDED_USED).otherwise(UNNEEDED)).otherwise(NEITHER)


def combined_reward(parts: Sequence[tuple[float, Column]], penalty: Column, overlong: Column, gate: Column, declined: Column) -> Column:
    """The reward of a trajectory: that of its form where it rules out any other, else that of declining where that was right, else the weighted scores with their penalties; declining knows no penalty."""
    return F.coalesce(gate, declined, total_score(parts, penalty, overlong))


def declining_score(answer: Column, n_steps: Column) -> Column:
    """For questions to decline: 1 for a refusal with at most one call, a quarter less for each further, at least a quarter; 0 without a refusal."""
    return F.when(any_word(answer, DECLINING), _step(n_steps, DECLINED_STEPS)).otherwise(0.0)


def passes_gate(issues: DataFrame, key: str, least: float = 4.0, full: float = 5.0) -> DataFrame:
    """(key, score, passes) from rows of (key, penalty, critical): the full score less the penalties, passing at ``least`` if no issue is critical."""
    own = issues.groupBy(key).agg(F.round(full - F.coalesce(F.sum("penalty"), F.lit(0.0)), 6).alias("score"), F.coalesce(F.max(F.col("critical").cast("int")), F.lit(0)).alias("_c"))
    return own.select(key, "score", ((F.col("score") >= least) & (F.col("_c") == 0)).alias("passes"))


def total_score(parts: Sequence[tuple[float, Column]], penalty: Column, overlong: Column) -> Column:
    """Weighted sum of scores plus the penalty, at least 0, then the overlong penalty (which may make it negative)."""
    base = sum((w * F.coalesce(c, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return F.greatest(base + penalty, F.lit(0.0)) + overlong
