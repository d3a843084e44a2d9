"""Rows of a search index: flat fields of bounded width, and the tables in which it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.numbering import numbered

# Widths of the text fields; missing text is empty, a missing number -1.
ID_WIDTH, TEXT_WIDTH, MISSING = 256, 4096, -1
TEXTS = {
    "source_type": 32, "chunk_method": 32, "stock_code": 16, "stock_name": 64, "institution": 128, "date": 24, "industry": 64, "rating": 32, "report_title": 256, "pdf_file": 256, "parser": 32, "data_type": 32, "table_type": 64, "header_type": 32, "current_section": 256,
    "parent_id": 256, "parent_md": 8192, "table_caption": 512, "table_footnote": 512, "section_id": 256, "section_title": 256, "section_text": 8192, "stock_codes": 2048,
}
NUMBERS = ("page_idx", "chunk_index", "company_count")


def _text(df: DataFrame, name: str) -> Column:
    """A field as text; lists are joined by commas; empty where the column is missing or null."""
    if name not in df.columns:
        return F.lit("")
    c = F.array_join(name, ",") if isinstance(df.schema[name].dataType, T.ArrayType) else F.col(name).cast("string")
    return F.coalesce(c, F.lit(""))


def index_rows(chunks: DataFrame, caption: str = "caption") -> DataFrame:
    """One flat row a chunk, with all fields of the index in their widths; vectors are kept beside it, by chunk_id.

    Rows are made distinct whole, before anything is cut. A chunk without an id gets one of its source and its position among those without. A missing ``table_caption`` is taken from
    ``caption``. Columns that the input lacks are empty or -1; further columns are ignored.
    """
    rows = chunks.select(*(c for c in chunks.columns if c in {"chunk_id", "text", caption, *TEXTS, *NUMBERS})).distinct()
    source = F.coalesce("source_type", F.lit("unknown")) if "source_type" in rows.columns else F.lit("unknown")
    nameless = rows.filter("chunk_id is null")
    if nameless.limit(1).count():
        order = [F.xxhash64(*nameless.columns), F.to_json(F.struct(*nameless.columns))]
        made = numbered(nameless, order, "_n").withColumn("chunk_id", F.concat(source, F.lit("_"), F.lpad(F.col("_n").cast("string"), 8, "0"))).drop("_n")
        rows = rows.filter("chunk_id is not null").unionByName(made)
    title = F.when(_text(rows, "table_caption") != "", _text(rows, "table_caption")).otherwise(_text(rows, caption))
    texts = [F.substring(source if n == "source_type" else title if n == "table_caption" else _text(rows, n), 1, w).alias(n) for n, w in TEXTS.items()]
    numbers = [(F.coalesce(F.col(n).cast("int"), F.lit(MISSING)) if n in rows.columns else F.lit(MISSING)).alias(n) for n in NUMBERS]
    return rows.select(F.substring("chunk_id", 1, ID_WIDTH).alias("chunk_id"), F.substring(_text(rows, "text"), 1, TEXT_WIDTH).alias("text"), *texts, *numbers)


def write_index(rows: DataFrame, path: str, files: int = 8) -> None:
    """Replaces the index: parquet in a folder a source type, sorted by code within files, so that a filter by source prunes folders and one by code skips row groups."""
    rows.repartition(files, "source_type", "stock_code").sortWithinPartitions("source_type", "stock_code", "chunk_id").write.mode("overwrite").partitionBy("source_type").parquet(path)


def scan_index(df: DataFrame, wanted: dict[str, object], columns: list[str], n: int, order: str = "chunk_id") -> DataFrame:
    """The first ``n`` rows with the given values (a list means any of its values), only the columns asked for; both reach the scan."""
    for name, value in wanted.items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df.select(*columns).orderBy(order).limit(n)


def postings(documents: DataFrame, key: str, words: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a word index: postings (word, key, times), words (word, n_documents) and documents (key, n_words); each is one aggregate over the whole corpus."""
    rows = documents.filter(F.col(key).isNotNull()).select(key, words.alias("_w"))
    own = rows.select(key, F.explode("_w").alias("word")).groupBy("word", key).agg(F.count(F.lit(1)).alias("times"))
    return own, own.groupBy("word").agg(F.count(F.lit(1)).alias("n_documents")), rows.select(key, F.size("_w").alias("n_words"))
