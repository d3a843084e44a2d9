"""Scoring, fusion and packing of search results. Queries come as a table or a parameter; every row of the corpus is scored against them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.checkpoints import cut_lineage
from quarryline.functions.joins import join_small
from quarryline.operators.ranking import HOT_GROUP_ROWS, hot_groups, rank_in_buckets

#: Queries of a table that are broadcast at once, and rows scored against them at once.
QUERY_BLOCK, SCORED_ROWS = 1_024, 2_000

# Words of reporting periods, and what a match adds.
PERIODS = (("q1", ("一季报", "一季度", "Q1", "q1")), ("h1", ("半年报", "中报", "H1", "h1")), ("q3", ("三季报", "三季度", "Q3", "q3")), ("annual", ("年报", "年度")))
PERIOD_BOOST = 0.06


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], key: str, vector: str, k: int) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows nearest to each query vector, exact; the query vectors are parameters, so no join is needed.

    The limit per query is applied within partitions before the shuffle. Rows with a null vector or one of length 0 are left out; ties by key.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).withColumn("_norm", F.sqrt(dot(F.col(vector), F.col(vector)))).filter("_norm > 0")
    scored = F.array(*(F.struct(F.lit(name).alias("query"), (dot(F.col(vector), F.array(*map(F.lit, map(float, q)))) / (F.col("_norm") * F.lit(math.sqrt(sum(x * x for x in q)) or 1.0))).alias("s")) for name, q in queries))
    flat = rows.select(key, F.explode(scored).alias("x")).select("x.query", key, F.round("x.s", 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return flat.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25_top_k(documents: DataFrame, queries: Sequence[tuple[str, Sequence[str]]], key: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank) of the ``k`` best documents a query, by BM25 over lower-case words; document frequencies and mean length come from the whole corpus.

    Only counts of query terms leave a row: one pass for the statistics, one for the scores. Null texts are left out; ties by key.
    """
    terms = sorted({t for _, ts in queries for t in ts})

    def _count(term: str) -> Column:
        return F.size(F.filter("_w", lambda w: w == term))

    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = documents.filter(F.col(text).isNotNull()).withColumn("_w", words).select(key, F.size("_w").cast("double").alias("_n"), *(_count(t).cast("double").alias(f"_t{i}") for i, t in enumerate(terms)))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("avg"), *(F.sum((F.col(f"_t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms)))).first()
    n, mean = stats["n"] or 0, stats["avg"] or 1.0
    idf = {t: math.log(1 + (n - (stats[f"d{i}"] or 0) + 0.5) / ((stats[f"d{i}"] or 0) + 0.5)) for i, t in enumerate(terms)}

    def part(t: str) -> Column:
        tf = F.col(f"_t{terms.index(t)}")
        return F.lit(idf[t]) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / mean))

    scored = F.array(*(F.struct(F.lit(name).alias("query"), sum((part(t) for t in ts), F.lit(0.0)).alias("s")) for name, ts in queries))
    flat = rows.select(key, F.explode(scored).alias("x")).select("x.query", key, F.round("x.s", 6).alias("score")).filter("score > 0")
    return flat.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


class _Best:
    """The ``k`` best rows a query so far, by score rounded to 6 decimals and then by key."""

    def __init__(self, queries: int, k: int, least: float):
        self.k, self.floor, self.rows = k, np.full(queries, least), pd.DataFrame({"q": [], "key": [], "s": []})

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """Takes the scores (row x query) of rows with these keys; those below the floor of their query can't be among the best."""
        scores = np.round(scores, 6)
        low = np.maximum(self.floor, np.partition(scores, len(keys) - self.k, axis=0)[len(keys) - self.k]) if len(keys) > self.k else self.floor
        at, q = np.nonzero(scores >= low)
        if len(at):
            rows = pd.DataFrame({"q": q, "key": keys[at], "s": scores[at, q]})
            rows = pd.concat([self.rows, rows]) if len(self.rows) else rows
            self.rows = rows.sort_values(["q", "s", "key"], ascending=[True, False, True]).groupby("q").head(self.k)
            last = self.rows.groupby("q")["s"].agg(["size", "last"])
            last = last[last["size"] == self.k]
            self.floor[last.index.to_numpy(dtype=int)] = np.maximum(self.floor[last.index.to_numpy(dtype=int)], last["last"].to_numpy())


def _top_of_blocks(corpus: DataFrame, queries: DataFrame, query: str, key: str, k: int, least: float, score: str, prepare: Callable, scorer: Callable) -> DataFrame:
    """(query, key, score, rank) of every query of a table against every row of ``corpus``.

    Queries are broadcast in blocks of about QUERY_BLOCK, whose size doesn't depend on their number; each partition keeps its best ``k`` rows a query, so only these are shuffled.
    ``prepare`` makes (ids, data) of a block's collected rows; ``scorer`` yields (keys, scores) of a batch.
    """
    spark, blocks = corpus.sparkSession, max(1, math.ceil(queries.select(query).distinct().count() / QUERY_BLOCK))
    kinds = queries.schema[query].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    schema, found = f"query {kinds[0]}, `{key}` {kinds[1]}, `{score}` double", []
    for i in range(blocks):
        ids, data = prepare(queries.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == i).collect())
        if not ids:
            continue
        sent = spark.sparkContext.broadcast((ids, data))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, block = sent.value
            best = _Best(len(names), k, least)
            for b in batches:
                for at in range(0, len(b), SCORED_ROWS):
                    best.add(*scorer(b.iloc[at : at + SCORED_ROWS], block, len(names)))
            yield pd.DataFrame({"query": [names[int(q)] for q in best.rows["q"]], key: best.rows["key"].tolist(), score: best.rows["s"].tolist()})

        part = corpus.mapInPandas(run, schema)
        found.append(cut_lineage(part) if blocks > 1 else part)
        if blocks > 1:
            sent.destroy()
    out = found[0] if found else spark.createDataFrame([], schema)
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), key))).filter(F.col("rank") <= k)


def cosine_top_k_of(vectors: DataFrame, queries: DataFrame, query: str, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows nearest to each query of a table, exact; every row is compared with every query.

    ``queries`` has ``query`` (unique) and ``vector``, all of one length. Null keys, and null, infinite or zero vectors and those of another length are left out on either side; ties by key.
    """

    def valid(df: DataFrame, name: str) -> DataFrame:
        norm = dot(F.col(vector), F.col(vector))
        return df.select(name, vector).filter(F.col(name).isNotNull() & F.col(vector).isNotNull()).filter((norm > 0) & (norm < float("inf")))

    def unit(column) -> np.ndarray:
        m = np.array([np.asarray(x, dtype=float) for x in column])
        return m / np.sqrt((m * m).sum(1))[:, None]

    def prepare(rows: list) -> tuple[list, np.ndarray | None]:
        if len({len(r[vector]) for r in rows}) > 1:
            raise ValueError("query vectors have different lengths")
        return [r[query] for r in rows], unit(r[vector] for r in rows) if rows else None

    def scorer(b: pd.DataFrame, block: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        b = b[b[vector].map(len) == block.shape[1]]
        return b[key].to_numpy(), unit(b[vector]) @ block.T if len(b) else np.zeros((0, n))

    return _top_of_blocks(valid(vectors, key), valid(queries, query), query, key, k, -np.inf, "similarity", prepare, scorer)


def search_words(text: Column) -> Column:
    """Lower-case words in order; a run of Chinese characters, which has no spaces, gives its pairs of neighbours (a single one itself)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}&&\p{IsHan}]+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    pairs = lambda r: F.when(r.rlike(r"^\p{IsHan}{2}"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.flatten(F.transform(runs, pairs))


def bm25_top_k_of(documents: DataFrame, queries: DataFrame, query: str, key: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank) of the ``k`` best documents of each query text of a table, by BM25 over ``search_words``; every document is scored against every query.

    ``queries`` has ``query`` (unique) and ``text``; a word that a query repeats counts as often. Document frequencies and mean length come from the whole corpus.
    Null keys and texts are left out on either side, documents without a word of the query aren't listed; ties by key.
    """
    words = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), search_words(F.col(text)).alias("_w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_w")).alias("mean")).first()
    total, mean = stats["n"], stats["mean"] or 1.0
    asked = queries.filter(F.col(query).isNotNull() & F.col(text).isNotNull()).select(F.col(query), F.explode(search_words(F.col(text))).alias("_t")).groupBy(query, "_t").agg(F.count(F.lit(1)).alias("_q"))
    spread = words.select(F.explode(F.array_distinct("_w")).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_d"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("_d") + 0.5) / (F.col("_d") + 0.5))
    weighed = cut_lineage(asked.join(spread, "_t").select(query, "_t", (idf * F.col("_q")).alias("_x")))

    def prepare(rows: list) -> tuple[list, dict]:
        ids = list(dict.fromkeys(r[query] for r in rows))
        index, lists = {q: i for i, q in enumerate(ids)}, {}
        for r in rows:
            lists.setdefault(r["_t"], []).append((index[r[query]], r["_x"]))
        return ids, {t: (np.array([i for i, _ in x], dtype=np.int32), np.array([w for _, w in x])) for t, x in lists.items()}

    def scorer(rows: pd.DataFrame, block: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(rows), n))
        for i, ws in enumerate(rows["_w"]):
            counts: dict[str, int] = {}
            for w in ws:
                if w in block:
                    counts[w] = counts.get(w, 0) + 1
            size = k1 * (1 - b + b * len(ws) / mean)
            if counts:
                lists = [(*block[w], tf * (k1 + 1) / (tf + size)) for w, tf in counts.items()]
                out[i] = np.bincount(np.concatenate([q for q, _, _ in lists]), np.concatenate([x * part for _, x, part in lists]), n)
        return rows[key].to_numpy(), out

    return _top_of_blocks(words, weighed, query, key, k, 1e-6, "score", prepare, scorer)


def sparse_top_k_of(vectors: DataFrame, queries: DataFrame, query: str, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score, rank): the ``k`` rows with the largest inner product with each sparse query of a table; every row is scored against every query.

    ``vector`` is an array of (key, value) entries; ``queries`` has a row a query and word: ``query``, ``word`` and ``weight``. Null keys and vectors are left out, rows without a common word aren't listed; ties by key.
    """
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x["key"]).alias("_w"), F.transform(vector, lambda x: x["value"].cast("double")).alias("_x"))
    asked = queries.filter(F.col(query).isNotNull() & F.col("word").isNotNull()).select(query, "word", F.col("weight").cast("double").alias("weight"))

    def prepare(found: list) -> tuple[list, dict]:
        ids = list(dict.fromkeys(r[query] for r in found))
        index, lists = {q: i for i, q in enumerate(ids)}, {}
        for r in found:
            lists.setdefault(r["word"], []).append((index[r[query]], r["weight"]))
        return ids, {t: (np.array([i for i, _ in x], dtype=np.int32), np.array([w for _, w in x])) for t, x in lists.items()}

    def scorer(b: pd.DataFrame, block: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(b), n))
        for i, (words, values) in enumerate(zip(b["_w"], b["_x"])):
            hits = [(*block[w], x) for w, x in zip(words, values) if w in block]
            if hits:
                out[i] = np.bincount(np.concatenate([q for q, _, _ in hits]), np.concatenate([w * x for _, w, x in hits]), n)
        return b[key].to_numpy(), out

    return _top_of_blocks(rows, asked, query, key, k, 1e-6, "score", prepare, scorer)


def latest_scores(hits: DataFrame, small_is_good: Sequence[str] = ("l2_dist",)) -> DataFrame:
    """(query_id, chunk_id, retriever, good): each retriever's latest valid score, signed so that large is good."""
    valid = hits.filter(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("retriever").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    last = valid.groupBy("query_id", "chunk_id", "retriever").agg(F.max(F.struct("hit_ts", "score")).alias("x"))
    return last.select("query_id", "chunk_id", "retriever", F.when(F.col("retriever").isin(*small_is_good), -F.col("x.score")).otherwise(F.col("x.score")).alias("good"))


LIST = ("query_id", "retriever")


def ranked_lists(scores: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Adds ``rank`` from 1 within each query and retriever; ties by chunk. Lists of more than ``hot_rows`` rows are ranked in buckets of their scores, the others by one sort; lists are counted first."""
    own = Window.partitionBy(*LIST).orderBy(F.desc("good"), "chunk_id")
    hot = hot_groups(scores, LIST, hot_rows)
    if not hot.limit(1).count():
        return scores.withColumn("rank", F.row_number().over(own))
    cold = scores.join(hot, list(LIST), "left_anti").withColumn("rank", F.row_number().over(own))
    large = rank_in_buckets(scores.join(hot, list(LIST), "left_semi").withColumn("_bad", -F.col("good")), LIST, "_bad", ["chunk_id"])
    return cold.unionByName(large.withColumn("rank", (F.col("_less") + 1).cast("int")).select(cold.columns)).select(*scores.columns, "rank")


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the sum of weight / (k + rank) over the lists."""
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("retriever") == name, F.lit(x)).otherwise(w)
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(w / (k + F.col("rank"))), 9).alias("score"))


def min_max(scores: DataFrame, constant: float = 0.0) -> DataFrame:
    """Adds ``scaled``: the score between 0 and 1 within query and retriever; ``constant`` where all are equal. The bounds of a list are aggregated before they are joined, with hot lists spread by chunk."""
    bounds = scores.groupBy(*LIST).agg(F.min("good").alias("_low"), F.max("good").alias("_high"))
    rows = join_small(scores, bounds, LIST, ["chunk_id"])
    return rows.withColumn("scaled", F.when(F.col("_high") > F.col("_low"), (F.col("good") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(constant))).select(*scores.columns, "scaled")


def weighted_fusion(scores: DataFrame, weights: dict[str, float], constant: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, score): weighted sum of min-max scaled scores; a retriever without a score adds nothing."""
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col("retriever") == name, F.lit(x)).otherwise(w)
    return min_max(scores, constant).groupBy("query_id", "chunk_id").agg(F.round(F.sum(w * F.col("scaled")), 9).alias("score"))


def document_fusion(hits: DataFrame, k: int = 60, per_document: int = 5, top_k: int = 30) -> DataFrame:
    """Chunks ranked by the fused score of their document.

    ``hits`` has query_id, chunk_id, document (null: the chunk stands for itself), is_meta, rank (from 0), list and boost. A document's score is the sum of 1 / (k + rank + 1)
    over its best ``per_document`` hits of all lists, plus its boost; its chunks stand together, metadata first, and share the score; ``top_k`` rows a query.
    """
    rows = hits.withColumn("document", F.coalesce("document", "chunk_id"))
    best = Window.partitionBy("query_id", "document").orderBy("rank", "list", "chunk_id")
    scores = rows.withColumn("_at", F.row_number().over(best)).groupBy("query_id", "document").agg(
        F.round(F.sum(F.when(F.col("_at") <= per_document, 1 / (k + F.col("rank") + 1)).otherwise(0.0)) + F.max(F.coalesce("boost", F.lit(0.0))), 9).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document", F.desc("is_meta"), "rank", "list", "chunk_id")
    return rows.join(scores, ["query_id", "document"]).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_k)


def periods_in(c: Column) -> Column:
    """Labels of the reporting periods that a text names."""
    return F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(label)) for label, words in PERIODS)))


def period_of(day: Column) -> Column:
    """Labels of the periods that reports of this day's month are usually about."""
    m = F.month(day)
    return (
        F.when(m.between(10, 11), F.array(F.lit("q3"))).when(m.between(7, 9), F.array(F.lit("h1"))).when(m == 3, F.array(F.lit("annual"))).when(m == 5, F.array(F.lit("q1"))).when(m == 4, F.array(F.lit("annual"), F.lit("q1"))).otherwise(F.array().cast("array<string>"))
    )


def period_boost(query: Column, title: Column, day: Column, boost: float = PERIOD_BOOST) -> Column:
    """``boost`` if the query names a period that the title names or the day suggests, else 0."""
    own = F.array_union(periods_in(F.coalesce(title, F.lit(""))), F.coalesce(period_of(day), F.array().cast("array<string>")))
    return F.when(F.arrays_overlap(periods_in(query), own), F.lit(boost)).otherwise(F.lit(0.0))


def year_boost(query: Column, day: Column, boost: float = 0.01) -> Column:
    """``boost`` if the query names the day's year, else 0."""
    return F.when(F.array_contains(F.regexp_extract_all(query, F.lit(r"(20\d\d)"), F.lit(1)), F.year(day).cast("string")), F.lit(boost)).otherwise(F.lit(0.0))


def age_bonus(day: Column, today: Column, most: float = 0.4, half_life: float = 365.0) -> Column:
    """Decays exponentially with age from ``most``; 0 without a day. The reference day is a parameter."""
    return F.coalesce(F.lit(most) * F.exp(F.lit(-0.693) * F.greatest(F.datediff(today, day), F.lit(0)) / half_life), F.lit(0.0))


def within_budget(ranked: DataFrame, query: str, document: str, position: str, text: str, per_document: int = 3, chars: int = 12_000, top_k: int = 20) -> DataFrame:
    """The results that fit: at most ``per_document`` a document, in order until the first that overflows the characters (the first always fits), at most ``top_k``."""
    own = Window.partitionBy(query, document).orderBy(position)
    capped = ranked.withColumn("_n", F.row_number().over(own)).filter((F.col("_n") <= per_document) | F.col(document).isNull())
    order = Window.partitionBy(query).orderBy(position)
    summed = capped.withColumn("slot", F.row_number().over(order)).withColumn("used", F.sum(F.coalesce(F.length(text), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.filter(((F.col("slot") == 1) | (F.col("used") <= chars)) & (F.col("slot") <= top_k)).drop("_n")


def expand_parents(hits: DataFrame, parents: DataFrame, query: str = "query_id", parent: str = "parent_id") -> DataFrame:
    """(query, parent, score, first_position, parent_text, children): hits of one parent as one row, with its text and the child texts in order; orphans stand for themselves."""
    rows = hits.withColumn(parent, F.coalesce(parent, "chunk_id"))
    grouped = rows.groupBy(query, parent).agg(F.max("score").alias("score"), F.min("position").alias("first_position"), F.array_sort(F.collect_list(F.struct("position", F.regexp_replace("text", r"\s+", " ").alias("t")))).alias("_c"))
    named = grouped.join(parents.select(parent, "parent_text"), parent, "left")
    return named.select(query, parent, "score", "first_position", "parent_text", F.array_join(F.transform("_c", lambda x: x["t"]), "\n").alias("children"))


def expand_results(hits: DataFrame, tables: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits with their parents in place of them: children of one table as one row, headed by its caption and page, those of one section as one row, others as they are.

    ``hits`` has query_id, chunk_id, position, score, text, parent_id and section_id; ``tables`` parent_id, table_caption, page_idx and table_md; ``sections`` section_id and section_text. A row has the best score of its
    children and the place of the first; their texts stand below the parent's, one line each. Rows are ordered by score, then by place. A parent that isn't there leaves the children for themselves.

    Returns query_id, slot, kind (table, section or chunk), parent, score, text.
    """
    known = hits.join(tables.select("parent_id", F.lit(True).alias("_t")).distinct(), "parent_id", "left").join(sections.select("section_id", F.lit(True).alias("_s")).distinct(), "section_id", "left")
    kind = F.when(F.col("_t"), "table").when(F.col("_s"), "section").otherwise("chunk")
    rows = known.select("query_id", "position", "score", kind.alias("kind"), F.when(F.col("_t"), F.col("parent_id")).when(F.col("_s"), F.col("section_id")).otherwise(F.col("chunk_id")).alias("parent"), F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ").alias("line"), "text")
    grouped = rows.groupBy("query_id", "kind", "parent").agg(F.max("score").alias("score"), F.min("position").alias("at"), F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_c"), F.min_by("text", "position").alias("_own"))
    lines = F.array_join(F.transform("_c", lambda x: x["line"]), "\n")
    head = F.concat(F.lit("【表格"), F.when(F.coalesce("table_caption", F.lit("")) != "", F.concat(F.lit(" · "), F.col("table_caption"))).otherwise(F.lit("")), F.when(F.col("page_idx") >= 0, F.concat(F.lit(" · 第 "), (F.col("page_idx") + 1).cast("string"), F.lit(" 页"))).otherwise(F.lit("")), F.lit("】"))
    named = grouped.join(tables.select(F.col("parent_id").alias("parent"), head.alias("_h"), "table_md").withColumn("kind", F.lit("table")), ["kind", "parent"], "left").join(sections.select(F.col("section_id").alias("parent"), "section_text").withColumn("kind", F.lit("section")), ["kind", "parent"], "left")
    text = F.when(F.col("kind") == "table", F.concat_ws("\n", "_h", "table_md", lines)).when(F.col("kind") == "section", F.concat_ws("\n", "section_text", lines)).otherwise(F.col("_own"))
    return named.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "at"))).select("query_id", "slot", "kind", "parent", "score", text.alias("text"))
