"""Search pipelines over scored hits: the filter comes before the ranking, lists are over-fetched, fused, boosted and cut."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import relational
from quarryline.operators import retrieval as R

#: Similarity from which an industry found by its vector counts, and the score of one found by its name.
LEAST_SIMILARITY, NAMED_SCORE = 0.75, 1.0


def hits_within(scores: DataFrame, chunks: DataFrame, sources: Sequence[str], retrievers: Sequence[str]) -> DataFrame:
    """The scores of some retrievers for chunks of some sources only: what is ranked afterwards is ranked within the filter, so nothing of another source takes a place."""
    wanted = chunks.filter(F.col("source_type").isin(*sources)).select("chunk_id").distinct()
    return scores.filter(F.col("retriever").isin(*retrievers)).join(wanted, "chunk_id", "left_semi")


def top_of(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query with their ``rank`` from 1; by default by score, ties by chunk. The limit holds before the shuffle too."""
    by = order or (F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).filter(F.col("rank") <= k)


def fused_lists(hits: DataFrame, fetch: int, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score): reciprocal rank fusion of the best ``fetch`` of each list."""
    return R.reciprocal_rank_fusion(R.ranked_lists(hits).filter(F.col("rank") <= fetch), k)


def year_boosted(scored: DataFrame, queries: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query after what the query's year adds. ``queries`` has query_id and query_text, ``days`` chunk_id and day, one row each."""
    rows = scored.join(queries, "query_id").join(days, "chunk_id")
    return top_of(rows.withColumn("score", F.round(F.col("score") + R.year_boost(F.col("query_text"), F.col("day")), 9)).drop("query_text", "day"), k)


def linear_fusion(scores: DataFrame, alpha: float, dense: str = "dense", words: str = "bm25", constant: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, score): ``alpha`` times the scaled dense score and the rest times the scaled word score; a score that is missing adds nothing."""
    return R.weighted_fusion(scores.filter(F.col("retriever").isin(dense, words)), {dense: alpha, words: 1 - alpha}, constant)


def industries_by_name(queries: DataFrame, aliases: dict[str, str], k: int) -> DataFrame:
    """(query_id, query_text, industry, position): industries whose name or alias a query holds, the longest first, at most ``k``."""
    named = relational.contained_aliases(queries, "query_text", aliases, k)
    return named.select("query_id", "query_text", F.posexplode("matches").alias("position", "industry"))


def industries_by_vector(hits: DataFrame, industries: DataFrame, k: int, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(query_id, industry, score, position): industries of the nearest chunks that are near enough, each once with its best, at most ``k``; of each query the best 3 k chunks are looked at."""
    near = top_of(hits.select("query_id", "chunk_id", F.col("good").alias("score")), 3 * k).filter(F.col("score") >= least).join(industries, "chunk_id")
    best = near.groupBy("query_id", "industry").agg(F.max("score").alias("score"), F.min("rank").alias("_r"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_r")) - 1).filter(F.col("position") < k).drop("_r")


def industry_search(queries: DataFrame, hits: DataFrame, chunks: DataFrame, aliases: dict[str, str], k: int = 2) -> DataFrame:
    """(query_id, position, industry, score, way, chunk_id, text) of each query: industries by name, or by vector only where no name matched; with the industry's newest chunk as its parent text.

    ``chunks`` has chunk_id, industry, day and text. Industries without a chunk are left out.
    """
    named = industries_by_name(queries, aliases, k).withColumn("score", F.lit(NAMED_SCORE)).withColumn("way", F.lit("name"))
    rest = hits.join(named.select("query_id").distinct(), "query_id", "left_anti")
    found = industries_by_vector(rest, chunks.select("chunk_id", "industry").filter("industry is not null").distinct(), k).withColumn("way", F.lit("vector"))
    both = named.select("query_id", "industry", "score", "position", "way").unionByName(found.select("query_id", "industry", "score", "position", "way"))
    parents = chunks.filter("industry is not null").groupBy("industry").agg(F.max(F.struct("day", "chunk_id", "text")).alias("p"))
    return both.join(F.broadcast(parents), "industry").select("query_id", "position", "industry", "score", "way", "p.chunk_id", "p.text")


def named_or_message(queries: DataFrame, parents: DataFrame, aliases: dict[str, str], k: int = 2) -> DataFrame:
    """(query_id, position, industry, score, match_failed, text): parents of the industries named, else one row with score 0 that says so."""
    named = industries_by_name(queries, aliases, k).join(parents, "industry").select("query_id", "position", "industry", F.lit(NAMED_SCORE).alias("score"), F.lit(False).alias("match_failed"), "text")
    none = queries.join(named.select("query_id").distinct(), "query_id", "left_anti")
    text = F.concat(F.lit("没有找到与“"), F.col("query_text"), F.lit("”匹配的行业"))
    return named.unionByName(none.select("query_id", F.lit(0).alias("position"), F.lit(None).cast("string").alias("industry"), F.lit(0.0).alias("score"), F.lit(True).alias("match_failed"), text.alias("text")))


def report_hits(scores: DataFrame, chunks: DataFrame, queries: DataFrame, fetch_meta: int = 30, fetch_body: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Hits of the two paths of a report search, ready for ``document_fusion``: metadata by weighted scores, full texts by ranks, each ranked within its source; with the boost of the query's period.

    ``chunks`` has chunk_id, source_type, pdf_file, report_title, text and day, one row a chunk.
    """
    weights = weights or {"dense": 0.4, "sparse": 0.6}
    names = tuple(weights)
    meta = top_of(R.weighted_fusion(hits_within(scores, chunks, ["report"], names), weights), fetch_meta).withColumn("list", F.lit("meta"))
    body = top_of(fused_lists(hits_within(scores, chunks, ["report_fulltext"], names), fetch_body), fetch_body).withColumn("list", F.lit("body"))
    rows = meta.unionByName(body).drop("score").join(chunks, "chunk_id").join(queries, "query_id")
    boost = F.when(F.col("pdf_file").isNotNull(), R.period_boost(F.col("query_text"), F.col("report_title"), F.col("day"))).otherwise(0.0)
    return rows.select("query_id", "chunk_id", F.col("pdf_file").alias("document"), (F.col("list") == "meta").cast("int").alias("is_meta"), (F.col("rank") - 1).alias("rank"), "list", boost.alias("boost"), "text")


def report_search(scores: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, slot, chunk_id, document, score, used): both paths fused by document (6 k rows), at most three a document, within the budget of characters, at most ``k``."""
    fused = R.document_fusion(report_hits(scores, chunks, queries), top_k=6 * k)
    return R.within_budget(fused, "query_id", "document", "position", "text", top_k=k).select("query_id", "slot", "chunk_id", "document", "score", "used")


def sparse_row(indices: Column, values: Column) -> Column:
    """A sparse vector as a map in ascending order of its indices; of repeated indices the values add up, zeros are left out."""
    distinct = F.array_sort(F.array_distinct(indices))
    total = F.transform(distinct, lambda i: F.struct(i.alias("key"), F.aggregate(F.filter(F.arrays_zip(indices.alias("i"), values.alias("v")), lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["v"].cast("double")).alias("value")))
    return F.map_from_entries(F.filter(total, lambda x: x["value"] != 0))


def sparse_texts(documents: DataFrame, key: str, text: str, vector: str = "v") -> DataFrame:
    """(key, v): each text as a sparse vector, 1 + ln(times) of each of its search words, as sorted entries (key, value). Null keys and texts give no row, a text without words an empty vector.

    Words are counted in Arrow batches, as counting within a row by expressions takes time by the square of its words.
    """
    rows = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, R.search_words(F.col(text)).alias("_w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], vector: [[{"key": w, "value": 1 + math.log(n)} for w, n in sorted(Counter(ws).items())] for ws in b["_w"]]})

    return rows.mapInPandas(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, `{vector}` array<struct<key:string,value:double>>")


def observation(results: DataFrame, header: str, empty: str, queries: DataFrame, line: str = "line") -> DataFrame:
    """(query_id, n_results, observation): what a tool answers: a header with the number of results and the numbered lines in the order of ``rank``, or a fixed message without results.

    ``results`` has at most a few rows a query (a top-k), ``queries`` one row a query.
    """
    made = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(line).alias("l")))).alias("_l"))
    rows = queries.select("query_id").distinct().join(made, "query_id", "left").withColumn("n_results", F.coalesce(F.size("_l"), F.lit(0)))
    lines = F.array_join(F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["l"])), "\n")
    return rows.select("query_id", "n_results", F.when(F.col("_l").isNull(), F.lit(empty)).otherwise(F.concat(F.format_string(header, F.size("_l")), F.lit("\n"), lines)).alias("observation"))
