"""Queries of figure texts, table records, tool calls, prompts and histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import iso_date
from quarryline.operators import blocks as B
from quarryline.operators import chunking, facts
from quarryline.operators import figures as G
from quarryline.operators import tools as U
from quarryline.operators import trajectory as T
from quarryline.plans import documents as D
from quarryline.plans import retrieval as R
from quarryline.plans.reports import _I
from quarryline.plans.retrieval import TOOLS
from quarryline.plans.selection import STEPS
from quarryline.sources import read_table

#: Metrics of the chunks, the metric that they stand for, and what they are multiplied by.
METRICS = (("净资产收益率", "净资产收益率(%)", 1.0), ("毛利率", "主营业务利润率(%)", 1.0), ("净利率", "销售净利率(%)", 1.0), ("资产负债率", "资产负债率(%)", 1.0), ("存货周转天数", "存货周转天数(天)", 1.0), ("总资产", "总资产(元)", 1e8))
SYSTEM, INSTRUCTION, TOOL_LIST = "你是研究助手。", "请回答问题。", '["search","calculate"]'


def _periods(spark: SparkSession, root: str) -> DataFrame:
    """Figures of each stock and period as a map, with the share of equity and a turnover worked out of what there is."""
    rows = facts.indicators(read_table(spark, root, "all_chunks"))
    known = F.create_map(*(F.lit(x) for m, key, by in METRICS for x in (m, key)))
    times = F.create_map(*(F.lit(x) for m, key, by in METRICS for x in (m, by)))
    named = rows.select("stock_code", "year", "season", F.try_element_at(known, F.col("metric")).alias("key"), (F.col("value") * F.try_element_at(times, F.col("metric"))).alias("value"))
    more = rows.select("stock_code", "year", "season", F.when(F.col("metric") == "资产负债率", F.lit(G.EQUITY)).when((F.col("metric") == "存货周转天数") & (F.col("value") > 0), F.lit("总资产周转率(次)")).alias("key"), F.when(F.col("metric") == "资产负债率", 100 - F.col("value")).otherwise(36.5 / F.col("value")).alias("value"))
    return G.with_prior_map(G.figures_by_period(named.unionByName(more).filter("key is not null"), ["stock_code", "year", "season"], "key", "value"), "stock_code", "year", "season")


def _texts(spark: SparkSession, root: str, make) -> DataFrame:
    header = G.header_of(F.lit("公司"), F.col("stock_code"), F.concat_ws("-", "year", "season"), F.when(F.col("season") == "12-31", F.lit("年报")))
    return _periods(spark, root).select("stock_code", "year", "season", make(header, F.col("now"), F.col("before")).alias("text")).filter("text is not null")


def profit_texts(spark: SparkSession, root: str) -> DataFrame:
    """What the figures of each period say about profit."""
    return _texts(spark, root, G.profit_text)


def structure_texts(spark: SparkSession, root: str) -> DataFrame:
    """What they say about debt and efficiency."""
    return _texts(spark, root, G.structure_text)


def return_texts(spark: SparkSession, root: str) -> DataFrame:
    """The return of each period by its factors, where these agree with it."""
    return _texts(spark, root, G.return_text)


def table_records(spark: SparkSession, root: str) -> DataFrame:
    """A record of each table with its place, captions and document."""
    rows = B.in_order(read_table(spark, root, "content_list"))
    placed = B.tables_in_sections(rows).join(rows.select("pdf_file", "block_idx", "page_idx", "table_caption", "table_footnote", F.col("table_body").alias("_b")).filter("_b is not null and _b <> ''"), ["pdf_file", "block_idx"])
    documents = read_table(spark, root, "pdf_map").select("pdf_file", "stock_code", "institution", "report_title")
    return chunking.table_parents(placed, documents).drop("table_md")


def headed_windows(spark: SparkSession, root: str) -> DataFrame:
    """Sections in fixed windows, each headed by what it is of."""
    windows = chunking.fixed_windows(B.sections(B.in_order(read_table(spark, root, "content_list"))), ["pdf_file", "section_no"])
    documents = read_table(spark, root, "pdf_map").select("pdf_file", chunking.identity_header(F.col("stock_name"), iso_date(F.col("report_date")).cast("string"), F.col("report_title")).alias("header"))
    return windows.join(documents, "pdf_file", "left").select("pdf_file", "section_no", "chunk_index", F.concat(F.coalesce("header", F.lit("")), "chunk").alias("chunk"))


def windows_with_section(spark: SparkSession, root: str) -> DataFrame:
    """Windows with the text of the section that they are of, cut to its first 3000 characters as the index holds it."""
    sections = B.sections(B.in_order(read_table(spark, root, "content_list"))).withColumn("section", F.concat_ws("#", "pdf_file", F.col("section_no").cast("string")))
    windows = chunking.fixed_windows(sections, ["section"])
    return chunking.with_parent_text(windows, sections, "section", "text").select("section", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("parent_text").alias("parent_hash"))


def table_aware_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Documents cut by their tables and prose."""
    return chunking.table_aware_chunks(read_table(spark, root, "documents").filter("doc_id is not null"), "doc_id")


def image_free_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that hold images, without them."""
    rows = read_table(spark, root, "all_chunks").filter("chunk_id is not null and text like '%![%'").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", chunking.without_images(F.col("text")).alias("text"))


def _steps(spark: SparkSession, root: str) -> DataFrame:
    return T.steps_of(read_table(spark, root, "sft_data"))


def tool_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Every call's query as the tool takes it."""
    read = U.tool_input(F.col("tool"), F.col("query"))
    return _steps(spark, root).select("sample_id", "step_no", read["query"].alias("query"), read["top_k"].alias("top_k"))


def dispatched_calls(spark: SparkSession, root: str) -> DataFrame:
    """Where each call goes, and what is answered at once: unknown tools."""
    known = [t for t in TOOLS if t != "search_industry"]
    return U.dispatch(_steps(spark, root), known).select("sample_id", "step_no", "route", F.when(F.col("route") == "unknown", F.col("answer")).alias("answer"))


def _grouped(spark: SparkSession, root: str) -> DataFrame:
    steps = _steps(spark, root).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "tool", "query", "observation", "thought"))).alias("steps"))
    return T.latest_samples(read_table(spark, root, "sft_data")).filter("question is not null").select("sample_id", "question").join(steps, "sample_id")


def rebuilt_histories(spark: SparkSession, root: str) -> DataFrame:
    """Messages made of the steps of each trajectory, by their number, roles and the length of their texts."""
    rows = _grouped(spark, root).select("sample_id", U.history(SYSTEM, F.col("question"), F.col("steps")).alias("ms"))
    return rows.select("sample_id", F.size("ms").alias("n_messages"), F.array_join(F.transform("ms", lambda m: F.substring(m["role"], 1, 1)), "").alias("roles"), F.length(U.completion_text(F.col("ms"))).alias("n_chars"))


def prompt_texts(spark: SparkSession, root: str) -> DataFrame:
    """The same as one text."""
    return _grouped(spark, root).select("sample_id", F.md5(U.prompt_text(INSTRUCTION, F.col("question"), F.col("steps"))).alias("prompt_hash"))


def trainable_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples with messages, with the list of tools beside them."""
    return U.with_tools(T.latest_samples(read_table(spark, root, "sft_data")), TOOL_LIST).select("sample_id", F.size("messages").alias("n_messages"), "tools")


def generated_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs of consecutive assistant messages in each sample."""
    rows = T.latest_samples(read_table(spark, root, "sft_data")).filter("messages is not null").select("sample_id", U.mask_segments(F.transform("messages", lambda m: m["role"] == "assistant")).alias("r"))
    return rows.select("sample_id", F.explode("r").alias("x")).select("sample_id", "x.start", "x.end")


def _answers(spark: SparkSession, root: str) -> DataFrame:
    """Each sample's completion as one text with tags, of the latest row."""
    calls = lambda m: F.array_join(F.transform(m["tool_calls"], lambda c: F.concat(F.lit("<tool_call>"), c["func"]["name"], F.lit("</tool_call>"))), "")
    piece = lambda m: F.when(m["role"] == "tool", F.concat(F.lit("<tool_response>"), F.coalesce(m["content"], F.lit("")), F.lit("</tool_response>"))).when(m["role"] == "assistant", F.concat(F.coalesce(m["content"], F.lit("")), F.coalesce(calls(m), F.lit("")))).otherwise(F.lit(""))
    return T.latest_samples(read_table(spark, root, "sft_data")).filter("messages is not null").select("sample_id", F.array_join(F.transform("messages", piece), "").alias("completion"))


def final_answers(spark: SparkSession, root: str) -> DataFrame:
    """What each completion answers at last, by its length and hash."""
    answer = T.final_answer(F.col("completion"))
    return _answers(spark, root).select("sample_id", F.length(answer).alias("n_chars"), F.md5(answer).alias("answer_hash"))


def split_thoughts(spark: SparkSession, root: str) -> DataFrame:
    """Final answers that begin with a thought, cut from it."""
    parts = T.split_thought(T.final_answer(F.col("completion")), ("综合", "值得", "我们", "按照", "如果"))
    return _answers(spark, root).select("sample_id", F.length(parts["thought"]).alias("n_thought"), F.length(parts["answer"]).alias("n_answer"))


def gated_issues(spark: SparkSession, root: str) -> DataFrame:
    """Which samples pass the gate of issues: a point off for each, and none that is critical."""
    issues = T.validate(read_table(spark, root, "sft_data"), TOOLS).filter("errors <> ''").select("sample_id", F.explode(F.split("errors", ",")).alias("issue"))
    return T.passes_gate(issues.select("sample_id", F.lit(1.0).alias("penalty"), F.col("issue").isin("answer", "steps").alias("critical")), "sample_id")


def table_children(spark: SparkSession, root: str) -> DataFrame:
    """Facts of HTML tables as chunks of their table."""
    found = chunking.table_facts(read_table(spark, root, "content_list").filter("table_body like '%<t%'"), "block_id", "table_body")
    parents = found.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "fact"))), lambda x: x["fact"]).alias("facts")).withColumn("narrative", F.concat_ws("；", "facts"))
    return chunking.child_chunks(parents.withColumn("block_id", F.col("block_id").cast("string")), "block_id", "narrative", "facts")


QUERIES = {
    f.__name__: f
    for f in (
        profit_texts, structure_texts, return_texts, table_records, headed_windows, windows_with_section, table_aware_pieces, image_free_chunks, tool_inputs, dispatched_calls, rebuilt_histories, prompt_texts, trainable_samples, generated_runs, final_answers, split_thoughts, gated_issues, table_children,
    )
}

_CASES = " ".join(f"WHEN '{m}' THEN '{key}'" for m, key, _ in METRICS)
_P = (
    _I
    + f""", x AS (SELECT stock_code, year, season, CASE metric {_CASES} END AS key, value * CASE metric WHEN '总资产' THEN 1e8 ELSE 1 END AS value FROM i WHERE metric <> '' AND value IS NOT NULL
  UNION ALL SELECT stock_code, year, season, '股东权益比率(%)', 100 - value FROM i WHERE metric = '资产负债率' AND value IS NOT NULL UNION ALL SELECT stock_code, year, season, '总资产周转率(次)', 36.5 / value FROM i WHERE metric = '存货周转天数' AND value > 0),
w AS (SELECT stock_code, year, season, max(value) FILTER (key = '净资产收益率(%)') AS roe, max(value) FILTER (key = '主营业务利润率(%)') AS gross, max(value) FILTER (key = '销售净利率(%)') AS net, max(value) FILTER (key = '资产负债率(%)') AS debt, max(value) FILTER (key = '股东权益比率(%)') AS eq, max(value) FILTER (key = '存货周转天数(天)') AS days,
  max(value) FILTER (key = '总资产周转率(次)') AS turn, max(value) FILTER (key = '总资产(元)') AS assets FROM x WHERE key IS NOT NULL GROUP BY 1, 2, 3),
y AS (SELECT w.*, b.roe AS roe0, b.net AS net0, b.debt AS debt0, b.turn AS turn0, CASE WHEN b.eq > 0 THEN 100 / b.eq END AS mul0, CASE WHEN w.eq > 0 THEN 100 / w.eq END AS mul, '公司(' || w.stock_code || ') ' || w.year || '-' || w.season || CASE WHEN w.season = '12-31' THEN '(年报)' ELSE '' END AS header FROM w LEFT JOIN w b ON b.stock_code = w.stock_code AND b.season = w.season AND b.year = w.year - 1)
"""
)


def _t(label: str, now: str, unit: str, prior: str = "") -> str:
    tail = f" || coalesce('（上年同期' || format('{{:.2f}}', {prior}) || '{unit}）', '')" if prior else ""
    return f"'{label}' || format('{{:.2f}}', {now}) || '{unit}'{tail}"


_PROFIT = f"concat_ws('，', {_t('净资产收益率(ROE)', 'roe', '%', 'roe0')}, {_t('主营业务利润率(毛利率)', 'gross', '%')}, {_t('销售净利率', 'net', '%', 'net0')}, '总资产' || CASE WHEN abs(assets) >= 1e8 THEN format('{{:.2f}}亿元', assets / 1e8) WHEN abs(assets) >= 1e4 THEN format('{{:.2f}}万元', assets / 1e4) ELSE format('{{:.2f}}元', assets) END)"
_STRUCTURE = f"concat_ws('，', {_t('资产负债率', 'debt', '%', 'debt0')}, {_t('股东权益比率', 'eq', '%')}, {_t('权益乘数', 'mul', '倍')}, {_t('总资产周转率', 'turn', '次', 'turn0')}, {_t('存货周转天数', 'days', '天')})"
_PRODUCT = "(net / 100 * turn * mul * 100)"
_RETURN = f"concat_ws('，', {_t('净资产收益率(ROE)', 'roe', '%', 'roe0')}, {_t('销售净利率', 'net', '%', 'net0')}, {_t('总资产周转率', 'turn', '次', 'turn0')}, {_t('权益乘数', 'mul', '倍', 'mul0')}, '杜邦验算ROE≈' || format('{{:.2f}}', {_PRODUCT}) || '%（净利率×周转率×权益乘数）' || CASE WHEN abs({_PRODUCT} - roe) > 1 THEN '，与报告ROE（' || format('{{:.2f}}', roe) || '%）存在' || format('{{:.2f}}', abs({_PRODUCT} - roe)) || '个百分点差异，可能源于加权平均口径差异' ELSE '' END)"
_G = STEPS + ", sm AS (SELECT sample_id, arg_max(question, created_at) AS question FROM sft_data WHERE sample_id IS NOT NULL GROUP BY 1 HAVING arg_max(question, created_at) IS NOT NULL)"
_EDGES = r"^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+$"
_FINAL = (
    "WITH s AS (SELECT sample_id, arg_max(messages, created_at) AS ms FROM sft_data WHERE sample_id IS NOT NULL AND messages IS NOT NULL GROUP BY 1), "
    "c AS (SELECT sample_id, array_to_string(list_transform(ms, lambda m: CASE WHEN m.role = 'tool' THEN '<tool_response>' || coalesce(m.content, '') || '</tool_response>' WHEN m.role = 'assistant' THEN coalesce(m.content, '') || coalesce(array_to_string(list_transform(m.tool_calls, lambda x: '<tool_call>' || x.func.name || '</tool_call>'), ''), '') ELSE '' END), '') AS t FROM s), "
    "b AS (SELECT sample_id, regexp_replace(string_split(t, '<tool_call>')[-1], '</tool_call>|<[|]im_end[|]>|<[|]im_start[|]>', '', 'g') AS t FROM c), "
    f"fa AS (SELECT sample_id, regexp_replace(CASE WHEN contains(t, '<tool_response>') THEN string_split(t, '</tool_response>')[-1] ELSE t END, '{_EDGES}', '', 'g') AS a FROM b) "
)
_SECTIONS = D.SQL["section_windows"].split("SELECT pdf_file, section_no, row_number()")[0].rstrip() + ", windows AS (SELECT pdf_file, section_no, row_number()" + D.SQL["section_windows"].split("SELECT pdf_file, section_no, row_number()", 2)[-1] + ") "
SQL = {
    "profit_texts": _P + f"SELECT stock_code, year, season, header || '盈利与成长指标，' || {_PROFIT} || '。' AS text FROM y WHERE {_PROFIT} <> ''",
    "structure_texts": _P + f"SELECT stock_code, year, season, header || '偿债与运营指标，' || {_STRUCTURE} || '。' AS text FROM y WHERE {_STRUCTURE} <> ''",
    "return_texts": _P + f"SELECT stock_code, year, season, header || '杜邦分析，' || {_RETURN} || '。' AS text FROM y WHERE net IS NOT NULL AND turn IS NOT NULL AND mul IS NOT NULL AND NOT coalesce(abs({_PRODUCT} - roe) > 3 OR abs({_PRODUCT} - roe) / greatest(abs(roe), 1) > 0.3, false)",
    "image_free_chunks": r"SELECT DISTINCT chunk_id, regexp_replace(text, '!\[.*?\]\(.*?\)', '', 'g') AS text FROM all_chunks WHERE chunk_id IS NOT NULL AND contains(text, '![')",
    "tool_inputs": STEPS + "SELECT sample_id, step_no, coalesce(query, '')[1:500] AS query, 5 AS top_k FROM k",
    "dispatched_calls": STEPS + "SELECT sample_id, step_no, CASE WHEN tool IN ('search_financial', 'search_report', 'calculate') THEN tool ELSE 'unknown' END AS route, CASE WHEN coalesce(tool, '') NOT IN ('search_financial', 'search_report', 'calculate') THEN '未知工具: ' || coalesce(tool, '') || '，可用工具: search_financial, search_report, calculate' END AS answer FROM k",
    "rebuilt_histories": _G + f"SELECT sample_id, 2 + 2 * count(*) AS n_messages, 'su' || repeat('at', count(*)::INT) AS roles, {len(SYSTEM)} + length(any_value(question)) + sum(length(coalesce(thought, '')) + length(coalesce(observation, ''))) + 1 + 2 * count(*) AS n_chars FROM k JOIN sm USING (sample_id) GROUP BY 1",
    "prompt_texts": _G
    + f"SELECT sample_id, md5('{INSTRUCTION}' || chr(10) || chr(10) || '问题: ' || any_value(question) || string_agg(chr(10) || chr(10) || concat_ws(chr(10), '思考: ' || thought, '行动: ' || tool, '行动输入: ' || query, '观察: ' || observation), '' ORDER BY step_no)) AS prompt_hash FROM k JOIN sm USING (sample_id) GROUP BY 1",
    "trainable_samples": f"SELECT sample_id, len(arg_max(messages, created_at)) AS n_messages, '{TOOL_LIST}' AS tools FROM sft_data WHERE sample_id IS NOT NULL GROUP BY 1 HAVING len(arg_max(messages, created_at)) > 0",
    "generated_runs": """
WITH s AS (SELECT sample_id, arg_max(messages, created_at) AS ms FROM sft_data WHERE sample_id IS NOT NULL AND messages IS NOT NULL GROUP BY 1),
m AS (SELECT sample_id, i, ms[i].role = 'assistant' AS own FROM s, unnest(range(1, len(ms) + 1)) u(i)),
g AS (SELECT sample_id, i, i - row_number() OVER (PARTITION BY sample_id ORDER BY i) AS island FROM m WHERE own)
SELECT sample_id, min(i) - 1 AS start, max(i) AS "end" FROM g GROUP BY sample_id, island""",
    "headed_windows": _SECTIONS
    + f", p AS (SELECT pdf_file, CASE WHEN i <> '' THEN '[' || i || '] ' ELSE '' END AS header FROM (SELECT pdf_file, concat_ws(' ', nullif(stock_name, ''), TRY_CAST(replace(report_date[1:10], '/', '-') AS DATE)::VARCHAR, nullif(report_title, '')) AS i FROM pdf_map)) SELECT pdf_file, section_no, chunk_index, coalesce(header, '') || chunk AS chunk FROM windows LEFT JOIN p USING (pdf_file)",
    "windows_with_section": _SECTIONS + "SELECT pdf_file || '#' || section_no AS section, chunk_index, length(chunk) AS n_chars, md5(text[1:3000]) AS parent_hash FROM windows JOIN s USING (pdf_file, section_no)",
    "table_records": r"""
WITH b AS (SELECT DISTINCT block_id, pdf_file, block_idx, block_type, text, text_level, page_idx, table_body, table_caption, table_footnote, regexp_replace(coalesce(text, ''), '^[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g') AS t FROM content_list WHERE pdf_file IS NOT NULL AND block_idx IS NOT NULL),
h AS (SELECT *, last_value(CASE WHEN block_type = 'text' AND text_level = 1 AND length(t) >= 3 AND NOT regexp_matches(t, '^(分析师|研究员|联系人|证券分析师|首席分析师)\s*[:：]\s*\S{2,6}$|^(强烈推荐|买入|增持|中性|回避|卖出)|^\d{4}\s*年\s*\d{1,2}\s*月') THEN t END IGNORE NULLS) OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id ROWS UNBOUNDED PRECEDING) AS section FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY pdf_file ORDER BY block_idx, block_id) AS n FROM h WHERE block_type = 'table' AND table_body <> '')
SELECT pdf_file || '_t' || n AS parent_id, pdf_file, page_idx, coalesce(section, '') AS current_section, array_to_string(coalesce(table_caption, []), ' ') AS table_caption, array_to_string(coalesce(table_footnote, []), ' ') AS table_footnote, stock_code, institution, report_title FROM r LEFT JOIN pdf_map USING (pdf_file)""",
    "final_answers": _FINAL + "SELECT sample_id, length(a) AS n_chars, md5(a) AS answer_hash FROM fa",
    "split_thoughts": _FINAL
    + f", p AS (SELECT *, strpos(a, chr(10) || chr(10)) AS k, regexp_replace(substr(a, strpos(a, chr(10) || chr(10)) + 2), '{_EDGES}', '', 'g') AS rest FROM fa), t AS (SELECT *, k > 0 AND regexp_matches(rest, '^(综合|值得|我们|按照|如果)') AS cut FROM p) SELECT sample_id, CASE WHEN cut THEN length(regexp_replace(a[1:k - 1], '{_EDGES}', '', 'g')) END AS n_thought, CASE WHEN cut THEN length(rest) ELSE length(a) END AS n_answer FROM t",
    "gated_issues": R.SQL["validated_samples"].rsplit("SELECT sample_id, errors, errors = ''", 1)[0]
    + " SELECT sample_id, 5.0::DOUBLE - len(string_split(errors, ',')) AS score, len(string_split(errors, ',')) <= 1 AND NOT list_has_any(string_split(errors, ','), ['answer', 'steps']) AS passes FROM e WHERE errors <> ''",
    "table_children": D.SQL["html_table_facts"].rsplit("SELECT block_id, row_no", 1)[0]
    + ", z AS (SELECT block_id::VARCHAR AS block_id, row_no, array_to_string(pairs, '，') AS fact, row_number() OVER (PARTITION BY block_id ORDER BY row_no, array_to_string(pairs, '，')) - 1 AS i FROM f WHERE len(pairs) >= 2) SELECT block_id || '_r' || i AS chunk_id, block_id, 'table_row_fact' AS chunk_method, fact AS text FROM z WHERE length(fact) >= 10 UNION ALL SELECT block_id || '_n', block_id, 'table_narrative', n FROM (SELECT block_id, string_agg(fact, '；' ORDER BY i) AS n FROM z GROUP BY 1) WHERE length(n) >= 30",
}
