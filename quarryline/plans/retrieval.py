"""Queries over search results and trajectories, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import bigram_overlap, iso_date
from quarryline.operators import relational
from quarryline.operators import retrieval as R
from quarryline.operators import trajectory as T
from quarryline.sources import read_table

TOOLS = ("search_financial", "search_industry", "search_report", "calculate")
TERMS = (("margin", ("margin", "backlog")), ("orders", ("orders", "seasonal", "pattern")))
WEIGHTS = {"dense": 0.4, "sparse": 0.6}
TODAY = "2026-06-30"
#: Query vectors are parameters: rotations of a fixed direction.
VECTORS = tuple((f"v{k}", tuple(math.cos(k + i * (k + 1) / 7) for i in range(64))) for k in range(3))


def _scores(spark: SparkSession, root: str) -> DataFrame:
    return R.latest_scores(read_table(spark, root, "search_hits"))


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "all_chunks").select("chunk_id", "source_type", "pdf_file", "report_title", "text", iso_date(F.col("report_date")).alias("day")).filter("chunk_id is not null").distinct()


def cosine_top(spark: SparkSession, root: str) -> DataFrame:
    """Nearest vectors of each query vector, exact."""
    return R.cosine_top_k(read_table(spark, root, "embeddings"), VECTORS, "vec_id", "embedding", 10)


def bm25_top(spark: SparkSession, root: str) -> DataFrame:
    """Best documents of each word query."""
    return R.bm25_top_k(read_table(spark, root, "documents"), TERMS, "doc_id", "text", 20)


def cosine_top_all(spark: SparkSession, root: str) -> DataFrame:
    """Nearest vectors of every vector whose id is divisible by 100, exact."""
    vectors = read_table(spark, root, "embeddings")
    return R.cosine_top_k_of(vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding"), "query", "vec_id", "embedding", 10)


def bm25_top_all(spark: SparkSession, root: str) -> DataFrame:
    """Best documents of the text of every document whose id is divisible by 100."""
    documents = read_table(spark, root, "documents")
    return R.bm25_top_k_of(documents, documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text"), "query", "doc_id", "text", 20)


def rank_fusion(spark: SparkSession, root: str) -> DataFrame:
    """Reciprocal rank fusion of all retrievers."""
    return R.reciprocal_rank_fusion(R.ranked_lists(_scores(spark, root)))


def weighted_score_fusion(spark: SparkSession, root: str) -> DataFrame:
    """Weighted min-max fusion of the dense and the sparse retriever."""
    return R.weighted_fusion(_scores(spark, root), WEIGHTS)


def _document_hits(spark: SparkSession, root: str) -> DataFrame:
    ranked = R.ranked_lists(_scores(spark, root)).filter(F.col("retriever").isin("dense", "bm25"))
    texts = read_table(spark, root, "search_hits").groupBy("query_id").agg(F.min("query_text").alias("query_text"))
    rows = ranked.join(_chunks(spark, root), "chunk_id").join(texts, "query_id")
    boost = R.period_boost(F.col("query_text"), F.col("report_title"), F.col("day"))
    return rows.select("query_id", "chunk_id", F.col("pdf_file").alias("document"), (F.col("source_type") == "report").cast("int").alias("is_meta"), (F.col("rank") - 1).alias("rank"), F.col("retriever").alias("list"), F.when(F.col("pdf_file").isNotNull(), boost).otherwise(0.0).alias("boost"), "text")


def document_fusion(spark: SparkSession, root: str) -> DataFrame:
    """Chunks by the fused score of their document."""
    return R.document_fusion(_document_hits(spark, root).drop("text")).select("query_id", "position", "chunk_id", "document", "list", "score")


def packed_results(spark: SparkSession, root: str) -> DataFrame:
    """Fused results that fit the budget of 12,000 characters, at most 20."""
    fused = R.document_fusion(_document_hits(spark, root))
    return R.within_budget(fused, "query_id", "document", "position", "text").select("query_id", "slot", "chunk_id", "used")


def expanded_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of one PDF as one, with its title."""
    fused = R.document_fusion(_document_hits(spark, root)).withColumn("parent_id", F.col("document"))
    parents = read_table(spark, root, "pdf_map").select(F.col("pdf_file").alias("parent_id"), F.col("report_title").alias("parent_text"))
    return R.expand_parents(fused, parents).select("query_id", "parent_id", "score", "first_position", "parent_text")


def year_boosted(spark: SparkSession, root: str) -> DataFrame:
    """What the query's year adds to each hit, and what its age does."""
    hits = read_table(spark, root, "search_hits").filter("query_id is not null").select("query_id", "query_text", "chunk_id").distinct()
    rows = hits.join(_chunks(spark, root).select("chunk_id", "day"), "chunk_id")
    return rows.select("query_id", "chunk_id", R.year_boost(F.col("query_text"), F.col("day")).alias("boost"), F.round(R.age_bonus(F.col("day"), F.lit(TODAY).cast("date")), 6).alias("bonus"))


def interleaved(spark: SparkSession, root: str) -> DataFrame:
    """Two retrievers' lists merged by turns, texts that begin alike once."""
    rows = R.ranked_lists(_scores(spark, root)).join(_chunks(spark, root).select("chunk_id", "text"), "chunk_id")
    a, b = rows.filter("retriever = 'dense'"), rows.filter("retriever = 'bm25'")
    return relational.interleave(a, b, "query_id", "rank", "text", 100, 10).select("query_id", "position", "chunk_id", "retriever")


def tool_steps(spark: SparkSession, root: str) -> DataFrame:
    """The calls of every trajectory."""
    return T.steps_of(read_table(spark, root, "sft_data")).select("sample_id", "step_no", "tool", "query", "observation")


def tool_usage(spark: SparkSession, root: str) -> DataFrame:
    """How often each tool is used, by question type."""
    samples = read_table(spark, root, "sft_data").filter("sample_id is not null").select("sample_id", "question_type", "tools_used").distinct()
    return samples.select("question_type", F.explode("tools_used").alias("tool")).groupBy("question_type", "tool").agg(F.count(F.lit(1)).alias("n_uses"))


def question_types(spark: SparkSession, root: str) -> DataFrame:
    """Questions of each type."""
    return read_table(spark, root, "sft_data").filter("sample_id is not null").select("sample_id", "question_type").distinct().groupBy("question_type").agg(F.count(F.lit(1)).alias("n_samples"))


def rendered_chats(spark: SparkSession, root: str) -> DataFrame:
    """Conversations as one text each, with what the assistant wrote."""
    rows = T.latest_samples(read_table(spark, root, "sft_data").filter("messages is not null")).select("sample_id", T.render_chat(F.col("messages")).alias("chat"))
    spans = T.assistant_spans(F.col("chat"))
    return rows.select("sample_id", F.md5("chat").alias("chat_hash"), F.length("chat").alias("n_chars"), F.size(spans).alias("n_spans"), F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("generated"))


def parsed_calls(spark: SparkSession, root: str) -> DataFrame:
    """Calls parsed back from rendered assistant turns."""
    rows = T.steps_of(read_table(spark, root, "sft_data"))
    text = F.concat(F.coalesce("thought", F.lit("")), F.lit('\n<tool_call>\n{"name": "'), F.col("tool"), F.lit('", "arguments": {"query": "'), F.regexp_replace("query", '["\\\\]', ""), F.lit('"}}\n</tool_call><|im_end|>'))
    call = T.parse_call(text)
    return rows.select("sample_id", "step_no", call["content"].alias("content"), call["name"].alias("name"), T.query_argument(call["arguments"]).alias("query"))


def validated_samples(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with each trajectory."""
    return T.validate(read_table(spark, root, "sft_data"), TOOLS)


def step_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores and penalties of each trajectory's queries, and how close its last two queries are."""
    steps = T.steps_of(read_table(spark, root, "sft_data")).withColumn("s", T.query_score(F.col("query"), F.col("tool"), ("毛利率", "净利率", "营业收入", "净利润", "经营现金流", "资产负债率", "周转"), ()))
    grouped = steps.groupBy("sample_id").agg(F.round(F.avg(F.when(F.col("tool") != "calculate", F.col("s"))), 6).alias("query_score"), F.array_sort(F.collect_list(F.struct("step_no", "tool", "query"))).alias("steps"))
    last = F.when(F.size("steps") > 1, F.round(bigram_overlap(F.col("steps")[F.size("steps") - 1]["query"], F.col("steps")[F.size("steps") - 2]["query"]), 6))
    return grouped.select("sample_id", F.coalesce("query_score", F.lit(0.0)).alias("query_score"), T.call_penalty(F.col("steps"), TOOLS).alias("penalty"), last.alias("last_overlap"))


def sample_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores of each trajectory: calculations, declining, penalties and length, and their total."""
    samples = T.latest_samples(read_table(spark, root, "sft_data"))
    one = samples.select("sample_id", "question", "question_type", F.try_element_at("messages", F.lit(-1))["content"].alias("answer"))
    grouped = T.steps_of(samples).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "tool", "query", "observation"))).alias("steps"))
    steps = F.coalesce("steps", F.array().cast("array<struct<step_no:int,tool:string,query:string,observation:string>>"))
    rows = one.join(grouped, "sample_id", "left").withColumn("steps", steps)
    made = F.filter("steps", lambda s: s["tool"] == "calculate")
    calculation = T.calculation_score(T.needs_calculation(F.col("question"), F.col("answer"), F.col("question_type")), F.col("answer"), F.transform(made, lambda s: s["query"]), F.transform(made, lambda s: s["observation"]))
    search = F.filter("steps", lambda s: s["tool"] != "calculate")
    queries = F.when(F.size(search) > 0, F.aggregate(F.transform(search, lambda s: T.length_score(s["query"])), F.lit(0.0), lambda a, x: a + x) / F.size(search)).otherwise(0.0)
    total = T.total_score([(0.5, queries), (0.5, calculation)], T.call_penalty(F.col("steps"), TOOLS), T.overlong_penalty(F.col("answer")))
    declined = T.declining_score(F.col("answer"), F.size("steps"))
    return rows.select("sample_id", F.round(calculation, 6).alias("calculation"), F.round(queries, 6).alias("queries"), F.round(F.when(F.col("question_type") == "reject", declined).otherwise(total), 6).alias("score"))


def event_properties(spark: SparkSession, root: str) -> DataFrame:
    """A number out of the JSON of each event, summed by type."""
    return read_table(spark, root, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"), F.count(F.lit(1)).alias("n_events"))


def event_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Extension: events by type and day with subtotals."""
    return read_table(spark, root, "events").withColumn("day", F.to_date("ts")).rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (cosine_top, bm25_top, cosine_top_all, bm25_top_all, rank_fusion, weighted_score_fusion, document_fusion, packed_results, expanded_results, year_boosted, interleaved, tool_steps, tool_usage, question_types, rendered_chats, parsed_calls, validated_samples, step_scores, sample_scores, event_properties, event_rollup)
}

_S = """
WITH s0 AS (SELECT query_id, chunk_id, retriever, arg_max(score, {'t': hit_ts, 's': score}) AS x FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever IS NOT NULL GROUP BY ALL),
s AS (SELECT query_id, chunk_id, retriever, CASE WHEN retriever = 'l2_dist' THEN -x ELSE x END AS good FROM s0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY good DESC, chunk_id) AS rank FROM s)
"""
_C = "c AS (SELECT DISTINCT chunk_id, source_type, pdf_file, report_title, text, TRY_CAST(report_date AS DATE) AS day FROM all_chunks WHERE chunk_id IS NOT NULL)"
_D = (
    _S
    + ", "
    + _C
    + """, q AS (SELECT query_id, min(query_text) AS query_text FROM search_hits GROUP BY 1),
w AS (SELECT * FROM (VALUES ('q1', '一季报'), ('q1', '一季度'), ('q1', 'Q1'), ('q1', 'q1'), ('h1', '半年报'), ('h1', '中报'), ('h1', 'H1'), ('h1', 'h1'), ('q3', '三季报'), ('q3', '三季度'), ('q3', 'Q3'), ('q3', 'q3'), ('annual', '年报'), ('annual', '年度')) v(label, word)),
d0 AS (SELECT query_id, chunk_id, pdf_file, report_title, day, source_type, rank - 1 AS rank, retriever AS list, query_text, text FROM k JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE retriever IN ('dense', 'bm25')),
d AS (SELECT query_id, chunk_id, coalesce(pdf_file, chunk_id) AS document, (source_type = 'report')::INT AS is_meta, rank, list, text, CASE WHEN pdf_file IS NOT NULL AND EXISTS (SELECT 1 FROM w WHERE contains(query_text, word) AND (contains(coalesce(report_title, ''), word)
  OR label IN (SELECT label FROM w w2 WHERE contains(coalesce(report_title, ''), w2.word)) OR (label = 'q3' AND month(day) IN (10, 11)) OR (label = 'h1' AND month(day) IN (7, 8, 9)) OR (label = 'annual' AND month(day) IN (3, 4)) OR (label = 'q1' AND month(day) IN (4, 5)))) THEN 0.06 ELSE 0 END AS boost FROM d0),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY rank, list, chunk_id) AS n FROM d),
f AS (SELECT query_id, document, round(sum(CASE WHEN n <= 5 THEN 1.0::DOUBLE / (60 + rank + 1) ELSE 0 END) + max(boost), 9) AS score FROM e GROUP BY 1, 2),
z AS (SELECT d.*, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document, is_meta DESC, rank, list, chunk_id) AS position FROM d JOIN f USING (query_id, document) QUALIFY position <= 30)
"""
)
_VECTOR = " UNION ALL ".join(f"SELECT '{n}' AS query, [{', '.join(repr(x) for x in v)}]::DOUBLE[] AS q" for n, v in VECTORS)
#: Calls of the trajectories, of the latest row of each sample.
_K = """
WITH s AS (SELECT sample_id, arg_max(messages, created_at) AS ms FROM sft_data WHERE sample_id IS NOT NULL AND messages IS NOT NULL GROUP BY 1),
m AS (SELECT sample_id, i, ms[i] AS x FROM s, unnest(range(1, len(ms) + 1)) u(i)),
c AS (SELECT sample_id, i, j, x.content AS thought, x.tool_calls[j] AS c FROM m, unnest(range(1, len(x.tool_calls) + 1)) v(j)),
t AS (SELECT sample_id, coalesce(x.tool_call_id, '') AS id, arg_min(x.content, i) AS observation FROM m WHERE x.role = 'tool' GROUP BY 1, 2),
k AS (SELECT c.sample_id, row_number() OVER (PARTITION BY c.sample_id ORDER BY i, j) AS step_no, c.c.func.name AS tool, coalesce(json_extract_string(c.c.func.arguments, '$.query'), json_extract_string(c.c.func.arguments, '$.expression'), c.c.func.arguments) AS query, observation, thought
  FROM c LEFT JOIN t ON t.sample_id = c.sample_id AND t.id = coalesce(c.c.id, ''))
"""
SQL = {
    "cosine_top": f"WITH v AS ({_VECTOR}), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, v), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "bm25_top": r"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM d), q AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', '{t}')" for name, ts in TERMS for t in ts)
    + ") v(query, term)), tf AS (SELECT doc_id, len(ws) AS l, query, term, len(list_filter(ws, lambda w: w = term)) AS tf FROM d, q), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tf WHERE tf > 0 GROUP BY 1), s AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))), 6) AS score FROM tf JOIN df USING (term), n GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20",
    "cosine_top_all": "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "bm25_top_all": r"""
WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '(\p{Han}+)', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^\p{Han}{2}') THEN list_transform(range(1, length(w)), lambda i: w[i:i + 1]) ELSE [w] END)) AS ws FROM h),
n AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM d),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query, term, tf AS qtf FROM tf WHERE doc_id % 100 = 0),
s AS (SELECT query, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term), n GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "rank_fusion": _S + "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM k GROUP BY 1, 2",
    "weighted_score_fusion": _S
    + ", m AS (SELECT *, min(good) OVER p AS lo, max(good) OVER p AS hi FROM s WINDOW p AS (PARTITION BY query_id, retriever)) SELECT query_id, chunk_id, round(sum(CASE retriever WHEN 'dense' THEN 0.4::DOUBLE WHEN 'sparse' THEN 0.6::DOUBLE ELSE 0 END * CASE WHEN hi > lo THEN (good - lo) / (hi - lo) ELSE 0 END), 9) AS score FROM m GROUP BY 1, 2",
    "document_fusion": _D + "SELECT query_id, position, chunk_id, document, list, score FROM z",
    "packed_results": _D + ", y AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY position) AS nd FROM z), x AS (SELECT *, row_number() OVER o AS slot, sum(length(text)) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM y WHERE nd <= 3 WINDOW o AS (PARTITION BY query_id ORDER BY position)) SELECT query_id, slot, chunk_id, used FROM x WHERE (slot = 1 OR used <= 12000) AND slot <= 20",
    "expanded_results": _D + "SELECT query_id, document AS parent_id, max(score) AS score, min(position) AS first_position, any_value(p.report_title) AS parent_text FROM z LEFT JOIN pdf_map p ON document = p.pdf_file GROUP BY 1, 2",
    "year_boosted": "WITH " + _C + ", h AS (SELECT DISTINCT query_id, query_text, chunk_id FROM search_hits WHERE query_id IS NOT NULL) SELECT query_id, chunk_id, CASE WHEN list_contains(regexp_extract_all(query_text, '20\\d\\d'), year(day)::VARCHAR) THEN 0.01 ELSE 0 END AS boost, round(coalesce(0.4 * exp(-0.693 * greatest(date_diff('day', day, DATE '2026-06-30'), 0) / 365.0), 0), 6) AS bonus FROM h JOIN c USING (chunk_id)",
    "interleaved": _S + ", " + _C + ", m AS (SELECT query_id, chunk_id, retriever, rank, text[1:100] AS head, (retriever = 'bm25')::INT AS l FROM k JOIN c USING (chunk_id) WHERE retriever IN ('dense', 'bm25')), o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, head ORDER BY rank, l) = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, l) AS position, chunk_id, retriever FROM o QUALIFY position <= 10",
    "tool_steps": """
WITH s AS (SELECT sample_id, arg_max(messages, created_at) AS ms FROM sft_data WHERE sample_id IS NOT NULL AND messages IS NOT NULL GROUP BY 1),
m AS (SELECT sample_id, i, ms[i] AS x FROM s, unnest(range(1, len(ms) + 1)) u(i)),
c AS (SELECT sample_id, i, j, x.tool_calls[j] AS c FROM m, unnest(range(1, len(x.tool_calls) + 1)) v(j)),
t AS (SELECT sample_id, coalesce(x.tool_call_id, '') AS id, arg_min(x.content, i) AS observation FROM m WHERE x.role = 'tool' GROUP BY 1, 2)
SELECT c.sample_id, row_number() OVER (PARTITION BY c.sample_id ORDER BY i, j) AS step_no, c.c.func.name AS tool, coalesce(json_extract_string(c.c.func.arguments, '$.query'), json_extract_string(c.c.func.arguments, '$.expression'), c.c.func.arguments) AS query, observation
FROM c LEFT JOIN t ON t.sample_id = c.sample_id AND t.id = coalesce(c.c.id, '')""",
    "rendered_chats": """
WITH s AS (SELECT sample_id, arg_max(messages, created_at) AS ms FROM sft_data WHERE sample_id IS NOT NULL AND messages IS NOT NULL GROUP BY 1),
m AS (SELECT sample_id, i, len(ms) AS n, ms[i] AS x, ms[i - 1].role AS before, ms[i + 1].role AS after FROM s, unnest(range(1, len(ms) + 1)) u(i)),
c AS (SELECT sample_id, i, string_agg(chr(10) || '<tool_call>' || chr(10) || '{"name": "' || x.tool_calls[j].func.name || '", "arguments": ' || x.tool_calls[j].func.arguments || '}' || chr(10) || '</tool_call>', '' ORDER BY j) AS calls FROM m, unnest(range(1, len(x.tool_calls) + 1)) v(j) GROUP BY 1, 2),
t AS (SELECT m.sample_id, m.i, x.role = 'assistant' AS own, CASE WHEN calls IS NULL THEN length(coalesce(x.content, '')) ELSE length(calls) + CASE WHEN coalesce(x.content, '') <> '' THEN 1 + length(x.content) ELSE 0 END END + 10 AS made,
  CASE WHEN x.role = 'tool' THEN CASE WHEN m.i = 1 OR before <> 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || coalesce(x.content, '') || chr(10) || '</tool_response>' || CASE WHEN m.i = n OR after <> 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END
    WHEN calls IS NOT NULL THEN '<|im_start|>assistant' || CASE WHEN coalesce(x.content, '') <> '' THEN chr(10) || x.content ELSE '' END || calls || '<|im_end|>' || chr(10)
    ELSE '<|im_start|>' || x.role || chr(10) || coalesce(x.content, '') || '<|im_end|>' || chr(10) END AS turn, x.role FROM m LEFT JOIN c USING (sample_id, i)),
r AS (SELECT sample_id, CASE WHEN arg_min(role, i) <> 'system' THEN '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ELSE '' END || string_agg(turn, '' ORDER BY i) AS chat, count(*) FILTER (own) AS n_spans, coalesce(sum(made) FILTER (own), 0) AS generated FROM t GROUP BY 1)
SELECT sample_id, md5(chat) AS chat_hash, length(chat) AS n_chars, n_spans, generated FROM r""",
    "tool_usage": "SELECT question_type, tool, count(*) AS n_uses FROM (SELECT question_type, unnest(tools_used) AS tool FROM (SELECT DISTINCT sample_id, question_type, tools_used FROM sft_data WHERE sample_id IS NOT NULL)) GROUP BY 1, 2",
    "question_types": "SELECT question_type, count(*) AS n_samples FROM (SELECT DISTINCT sample_id, question_type FROM sft_data WHERE sample_id IS NOT NULL) GROUP BY 1",
    "event_properties": "SELECT event_type, sum((props->>'$.k')::BIGINT) AS sum_k, count(*) AS n_events FROM events GROUP BY 1",
    "event_rollup": "SELECT event_type, ts::DATE AS day, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, ts::DATE)",
    "parsed_calls": _K + r"SELECT sample_id, step_no, nullif(trim(coalesce(thought, ''), ' ' || chr(10) || chr(9) || chr(13) || '　'), '') AS content, tool AS name, regexp_replace(query, '[\"\\\\]', '', 'g') AS query FROM k",
    "validated_samples": _K
    + r""", o AS (SELECT sample_id, arg_max(question, created_at) AS question, arg_max(question_type, created_at) AS question_type, arg_max(messages, created_at)[-1].content AS answer FROM (SELECT * REPLACE (coalesce(question, chr(1)) AS question, coalesce(question_type, chr(1)) AS question_type) FROM sft_data) WHERE sample_id IS NOT NULL GROUP BY 1),
g AS (SELECT sample_id, list({'n': step_no, 'tool': tool, 'query': query, 'obs': coalesce(observation, '')} ORDER BY step_no) AS st FROM k GROUP BY 1),
r AS (SELECT o.sample_id, nullif(question, chr(1)) AS question, nullif(question_type, chr(1)) AS question_type, answer, coalesce(st, []) AS st FROM o LEFT JOIN g USING (sample_id)),
v AS (SELECT *, list_distinct(regexp_extract_all(coalesce(answer, ''), '\d+\.?\d*')) AS own, list_distinct(regexp_extract_all(array_to_string(list_transform(st, lambda s: s.obs), ' '), '\d+\.?\d*')) AS seen FROM r),
u AS (SELECT sample_id, bool_or(EXISTS (SELECT 1 FROM (SELECT unnest(list_distinct(regexp_extract_all(coalesce(query, ''), '\d+\.?\d*'))) AS x) WHERE x::DOUBLE > 10 AND x NOT IN ('100', '1000', '10000') AND NOT list_contains(regexp_extract_all(coalesce(before, ''), '\d+\.?\d*'), x))) AS unsourced, bool_or(NOT regexp_matches(coalesce(query, ''), '\d')) AS none
  FROM (SELECT *, string_agg(coalesce(observation, ''), ' ') OVER (PARTITION BY sample_id ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) WHERE tool = 'calculate' GROUP BY 1),
e AS (SELECT sample_id, concat_ws(',', CASE WHEN coalesce(question, '') = '' THEN 'question' END, CASE WHEN len(st) = 0 THEN 'steps' END, CASE WHEN len(st) > 6 THEN 'too_many_steps' END, CASE WHEN regexp_replace(coalesce(answer, ''), '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]', '', 'g') = '' THEN 'answer' END,
  CASE WHEN len(list_filter(st, lambda s: coalesce(s.tool, '') NOT IN ('search_financial', 'search_industry', 'search_report', 'calculate'))) > 0 THEN 'tool' END, CASE WHEN len(list_filter(st, lambda s: s.obs = '')) > 0 THEN 'observation' END,
  CASE WHEN coalesce(question_type, '') <> 'reject' AND len(own) > 0 AND len(list_intersect(own, seen))::DOUBLE / len(own) < 0.5 THEN 'grounding' END, CASE WHEN unsourced THEN 'operands' END, CASE WHEN none THEN 'no_operand' END) AS errors FROM v LEFT JOIN u USING (sample_id))
SELECT sample_id, errors, errors = '' AS is_valid FROM e""",
    "step_scores": _K
    + r""", v AS (SELECT *, (contains(query, '毛利率')::INT + contains(query, '净利率')::INT + contains(query, '营业收入')::INT + contains(query, '净利润')::INT + contains(query, '经营现金流')::INT + contains(query, '资产负债率')::INT + contains(query, '周转')::INT) AS n, regexp_matches(query, '202\d')::INT AS y, CASE WHEN regexp_matches(query, '[一-鿿]{2,}') THEN 0.5::DOUBLE ELSE 0 END AS e,
  CASE WHEN length(query) BETWEEN 8 AND 30 THEN 1::DOUBLE WHEN length(query) BETWEEN 5 AND 7 OR length(query) BETWEEN 31 AND 50 THEN 0.5 ELSE 0 END AS l, list_distinct(list_transform(range(1, greatest(length(query), 1)), lambda i: query[i:i + 1])) AS bg FROM k),
sc AS (SELECT *, CASE WHEN tool = 'search_industry' THEN 0.25::DOUBLE * m + 0.20::DOUBLE * y + 0.35::DOUBLE * e + 0.20::DOUBLE * l ELSE 0.35::DOUBLE * m + 0.25::DOUBLE * y + 0.20::DOUBLE * e + 0.20::DOUBLE * l END AS score FROM (SELECT *, CASE WHEN n >= 3 THEN 1.0::DOUBLE WHEN n = 2 THEN 0.85 WHEN n = 1 THEN 0.57 ELSE 0 END AS m FROM v)),
p AS (SELECT a.sample_id, a.step_no, b.step_no AS prior, CASE WHEN len(a.bg) > 0 AND len(b.bg) > 0 THEN len(list_intersect(a.bg, b.bg))::DOUBLE / least(len(a.bg), len(b.bg)) ELSE 0 END AS o FROM v a JOIN v b ON a.sample_id = b.sample_id AND b.step_no < a.step_no),
r AS (SELECT sample_id, step_no, max(o) > 0.85 AS again FROM p GROUP BY 1, 2), z AS (SELECT sample_id, max(step_no) AS n FROM k GROUP BY 1)
SELECT sc.sample_id, coalesce(round(avg(score) FILTER (tool <> 'calculate'), 6), 0) AS query_score, greatest(sum(CASE WHEN again THEN 1 ELSE 0 END) * -0.3::DOUBLE + sum(CASE WHEN coalesce(tool, '') NOT IN ('search_financial', 'search_industry', 'search_report', 'calculate') THEN 1 ELSE 0 END) * -0.5::DOUBLE, -1.0) AS penalty, any_value(round(lo.o, 6)) AS last_overlap
FROM sc LEFT JOIN r USING (sample_id, step_no) JOIN z ON z.sample_id = sc.sample_id LEFT JOIN p lo ON lo.sample_id = sc.sample_id AND lo.step_no = z.n AND lo.prior = z.n - 1 GROUP BY 1""",
}
