"""Lines that come back in many documents of one source: templates from mergeable fixed-depth token trees with wildcard slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.joins import join_small
from quarryline.llm.text import letters_only

#: Tokens (letters) on the path from the root to a leaf: the first HEAD and the last TAIL of a line. Lines of any length share a leaf; between these tokens they may differ.
HEAD, TAIL = 6, 2
#: A slot of a template: any run of letters, also none.
SLOT = "*"


def branch(key: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """Path of a line in the tree: its first and its last tokens."""
    return F.concat_ws("\x01", F.substring(key, 1, head), F.substring(key, -tail, tail))


def body_lines(blocks: DataFrame, min_letters: int = 8) -> DataFrame:
    """(block_id, pdf_file, line_no, key) of the body lines with enough letters; numbered from 1 within the text."""
    body = blocks.filter("block_type = 'text' and text_level is null and text is not null and block_id is not null and pdf_file is not null")
    lines = body.select("block_id", "pdf_file", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("block_id", "pdf_file", (F.col("at") + 1).alias("line_no"), letters_only(F.col("line")).alias("key")).filter(F.length("key") >= min_letters)


def pdf_sources(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pdf_file, source, n_docs): the institution of each PDF of ``blocks`` and how many PDFs of ``blocks`` it has."""
    named = chunks.filter("pdf_file is not null and institution is not null and institution <> ''").groupBy("pdf_file").agg(F.min("institution").alias("source"))
    docs = blocks.select("pdf_file").filter("pdf_file is not null").distinct().join(named, "pdf_file")
    return join_small(docs, docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")), ["source"], ["pdf_file"])


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(a == b, F.length(a)).otherwise(differs - 1).cast("int")


def line_templates(placed: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    """The templates that cover enough documents of a source, out of ``placed`` lines (source, n_docs, pdf_file, path, key).

    A leaf's state is its documents, and its lines as their least and greatest key, the same of the reversed keys, and their least length: the beginning that all lines share is that which
    the least and the greatest share, and so for the ends. Minimum, maximum and count are associative, so the trees of partitions and documents merge in any order (partial aggregates).
    What lies between beginning and end is a slot; if all lines of the leaf are equally long, positions in it at which all lines agree stay in the template, so it may have several slots.

    Returns source, path, template, lead and trail (letters before the first and after the last slot; a template without slot is all lead), n_leaf_docs, n_docs.
    """
    covering = placed.select("source", "n_docs", "pdf_file", "path").distinct().groupBy("source", "n_docs", "path").agg(F.count(F.lit(1)).alias("n_leaf_docs"))
    covering = covering.filter((F.col("n_leaf_docs") >= least) & (F.col("n_leaf_docs") >= share * F.col("n_docs")))
    keys = join_small(placed.select("source", "path", "key", "pdf_file"), covering, ["source", "path"], ["pdf_file"]).groupBy("source", "path", "n_docs", "n_leaf_docs", "key").agg(F.count(F.lit(1)))
    back = F.reverse("key")
    leaves = keys.groupBy("source", "path", "n_docs", "n_leaf_docs").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(back).alias("rlo"), F.max(back).alias("rhi"), F.min(F.length("key")).alias("short"), F.max(F.length("key")).alias("long")
    )
    leaves = leaves.withColumn("lead", _common(F.col("lo"), F.col("hi")))
    leaves = leaves.withColumn("trail", F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(_common(F.col("rlo"), F.col("rhi")), F.col("short") - F.col("lead"))))
    # positions between lead and trail at which equally long lines agree
    even = leaves.filter("lo <> hi and short = long").select("source", "path", "lead", "trail", "long")
    spots = join_small(keys.select("source", "path", "key"), even, ["source", "path"], ["key"])
    spots = spots.select("source", "path", "lead", "trail", "long", "key", F.explode(F.sequence(F.col("lead") + 1, F.col("long") - F.col("trail"))).alias("at")).groupBy("source", "path", "at").agg(F.min(F.substr("key", F.col("at"), F.lit(1))).alias("a"), F.max(F.substr("key", F.col("at"), F.lit(1))).alias("b"))
    middles = spots.groupBy("source", "path").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(SLOT).alias("c")))).alias("m"))
    middle = F.regexp_replace(F.coalesce(F.array_join(F.transform("m", lambda x: x["c"]), ""), F.lit(SLOT)), r"\*+", SLOT)
    joined = leaves.join(middles, ["source", "path"], "left")
    template = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat(F.substr("lo", F.lit(1), F.col("lead")), middle, F.substr("lo", F.length("lo") - F.col("trail") + 1, F.col("trail"))))
    return joined.select("source", "path", template.alias("template"), "lead", "trail", "n_leaf_docs", "n_docs")


def placed_lines(blocks: DataFrame, chunks: DataFrame, min_letters: int = 8) -> DataFrame:
    """(pdf_file, block_id, line_no, key, source, n_docs, path) of the body lines of files with a source."""
    return join_small(body_lines(blocks, min_letters), pdf_sources(blocks, chunks), ["pdf_file"]).withColumn("path", branch(F.col("key")))


def repeated_lines(blocks: DataFrame, chunks: DataFrame, share: float = 0.2, least: int = 3, min_letters: int = 8, distinct: bool = True) -> DataFrame:
    """Every line that stands in at least ``share`` of its source's documents, and in at least ``least`` of them.

    Lines are parsed into templates; only lines of templates that cover enough documents go on. Such a line is its template and what fills its slots; lines with the same
    filling of the same template are the same, and their documents are counted.

    Defined cases: only blocks of type ``text`` with null level count; null ids, files and texts are left out; so are files without a source.
    Repeated rows count once (documents are counted, not lines); with ``distinct`` false they give repeated rows. Lines with fewer than ``min_letters`` letters never count.
    Further columns are ignored; empty tables give no rows.

    Returns source, block_id, line_no, key, template, n_line_docs, n_docs.
    """
    placed = placed_lines(blocks, chunks, min_letters)
    templates = line_templates(placed, share, least).select("source", "path", "template", "lead", "trail")
    # the most repeated lines are the hottest keys of these joins: the small side is broadcast, or its keys are salted by block
    members = join_small(placed, templates, ["source", "path"], ["block_id"])
    filling = F.substr("key", F.col("lead") + 1, F.greatest(F.length("key") - F.col("lead") - F.col("trail"), F.lit(0)))
    members = members.withColumn("filling", filling).drop("lead", "trail")
    counts = members.select("source", "path", "filling", "n_docs", "pdf_file").distinct().groupBy("source", "path", "filling", "n_docs").agg(F.count(F.lit(1)).alias("n_line_docs"))
    frequent = counts.filter((F.col("n_line_docs") >= least) & (F.col("n_line_docs") >= share * F.col("n_docs"))).drop("n_docs")
    out = join_small(members, frequent, ["source", "path", "filling"], ["block_id"]).select("source", "block_id", "line_no", "key", "template", "n_line_docs", "n_docs")
    return out.distinct() if distinct else out


def without_repeated_lines(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(block_id, text): each block's text without the lines in ``found``; blocks without such lines keep their text, null stays null."""
    gone = found.groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    joined = blocks.filter("block_id is not null").select("block_id", "text").distinct().join(gone, "block_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i + 1))
    return joined.select("block_id", F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
