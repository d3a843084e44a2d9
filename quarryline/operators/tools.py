"""Calls of tools as data: their input, dispatch and answers, and the prompts and histories made of them. All within the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.calculator import calculate
from quarryline.functions.text import cut_at, strip_u
from quarryline.operators.selection import clamp_query, clamp_results

#: The argument that a bare text stands for, by tool.
MAIN_ARGUMENT = {"calculate": "expression"}
MESSAGE = "struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,call_type:string,func:struct<name:string,arguments:string>>>>"
CALLS = "array<struct<id:string,call_type:string,func:struct<name:string,arguments:string>>>"


def tool_input(tool: Column, given: Column) -> Column:
    """struct(query, top_k) of a call's input, be it a JSON object or a bare text (which is the query, or the expression of a calculation); query and number are brought within their bounds."""
    text = F.coalesce(F.get_json_object(given, "$.query"), F.get_json_object(given, "$.expression"), F.when(~F.coalesce(F.startswith(F.ltrim(given), F.lit("{")), F.lit(False)), given))
    return F.struct(clamp_query(text).alias("query"), clamp_results(F.get_json_object(given, "$.top_k")).alias("top_k"))


def dispatch(calls: DataFrame, tools: Sequence[str], tool: str = "tool", query: str = "query") -> DataFrame:
    """Adds ``route`` (the tool, or ``unknown``) and ``answer``: calculations are answered at once, unknown tools by a message that lists those there are; searches wait for their results (null)."""
    known = F.coalesce(F.col(tool).isin(*tools), F.lit(False))
    message = F.concat(F.lit("未知工具: "), F.coalesce(F.col(tool), F.lit("")), F.lit(f"，可用工具: {', '.join(tools)}"))
    rows = calls.withColumn("route", F.when(known, F.col(tool)).otherwise("unknown"))
    return rows.withColumn("answer", F.when(~known, message).when(F.col(tool) == "calculate", calculate(F.when(F.col(tool) == "calculate", F.col(query)))))


def industry_text(c: Column, limit: int = 1000) -> Column:
    """A result of the industry search: without tags and images, in one line, at most ``limit`` characters (the line feeds are gone before a cut could be made at one)."""
    flat = strip_u(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"!\[.*?\]\(.*?\)", ""), r"(?U)\s+", " "))
    return cut_at(flat, limit, "\n")


def completion_text(messages: Column) -> Column:
    """A completion given as messages as one text."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def message(role: str, content: Column, call_id: Column | None = None, calls: Column | None = None) -> Column:
    """A message of a history."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (none if call_id is None else call_id).alias("tool_call_id"), (F.lit(None).cast(CALLS) if calls is None else calls).alias("tool_calls")).cast(MESSAGE)


def history(system: str, question: Column, steps: Column, answer: Column | None = None) -> Column:
    """Messages of a trajectory: system, user, and for each step (struct with tool, query, observation and thought) the assistant's call and the tool's answer, ``call_1``, ``call_2`` ...; at last the answer, if there is one."""

    def pair(s: Column, i: Column) -> Column:
        id_ = F.concat(F.lit("call_"), (i + 1).cast("string"))
        arguments = F.to_json(F.struct(s["query"].alias("query")))
        call = F.array(F.struct(id_.alias("id"), F.lit("function").alias("call_type"), F.struct(s["tool"].alias("name"), arguments.alias("arguments")).alias("func")))
        return F.array(message("assistant", F.coalesce(s["thought"], F.lit("")), None, call), message("tool", F.coalesce(s["observation"], F.lit("")), id_))

    made = F.concat(F.array(message("system", F.lit(system)), message("user", question)), F.flatten(F.transform(steps, pair)))
    if answer is None:
        return made
    return F.concat(made, F.when(answer.isNotNull(), F.array(message("assistant", answer))).otherwise(F.array().cast(f"array<{MESSAGE}>")))


def prompt_text(instruction: str, question: Column, steps: Column) -> Column:
    """The same as one text: instruction, question, and each step's thought, action, input and observation."""
    lines = F.transform(steps, lambda s, i: F.concat_ws("\n", F.concat(F.lit("思考: "), s["thought"]), F.concat(F.lit("行动: "), s["tool"]), F.concat(F.lit("行动输入: "), s["query"]), F.concat(F.lit("观察: "), s["observation"])))
    return F.array_join(F.concat(F.array(F.lit(instruction), F.concat(F.lit("问题: "), question)), lines), "\n\n")


def task_messages(system: str, title: Column, table: Column, examples: Sequence[tuple[str, str]] = ()) -> Column:
    """Messages that ask for the facts of a table: the instruction, worked examples as turns, and the table with its title."""
    shots = [m for asked, told in examples for m in (message("user", F.lit(asked)), message("assistant", F.lit(told)))]
    return F.array(message("system", F.lit(system)), *shots, message("user", F.concat(F.lit("表格标题："), F.coalesce(title, F.lit("无")), F.lit("\n表格内容：\n"), table)))


def parsed_facts(answer: Column) -> Column:
    """struct(table_type, caption, header_type, narrative, row_facts) of a JSON answer, null unless it parses and has its narrative and facts; text around the object is tolerated."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    read = F.from_json(body, "table_type string, caption string, header_type string, narrative string, row_facts array<string>")
    return F.when(read["narrative"].isNotNull() & read["row_facts"].isNotNull(), read)


def with_tools(samples: DataFrame, tools: str, messages: str = "messages") -> DataFrame:
    """Rows that have messages, with the constant ``tools`` beside them."""
    return samples.filter(F.coalesce(F.size(messages), F.lit(-1)) > 0).withColumn("tools", F.lit(tools))


def mask_segments(mask: Column) -> Column:
    """array<struct(start, end)> of the runs of true in an array of booleans; 0-based, end exclusive. Starts and ends are found apart and put together."""
    n = F.size(mask)
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: F.get(mask, i) & ((i == 0) | ~F.coalesce(F.get(mask, F.greatest(i - 1, F.lit(0))), F.lit(False))))
    ends = F.filter(places, lambda i: F.get(mask, i) & ((i == n - 1) | ~F.coalesce(F.get(mask, i + 1), F.lit(False))))
    return F.when(n > 0, F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
