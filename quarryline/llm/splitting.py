"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Line feed, full-width sentence ends, and ASCII sentence ends before a space.
BOUNDARY = re.compile("[\n。！？；]|[.!?;](?= )")


def boundary_offsets(text: str) -> list[int]:
    """Sorted offsets right after each boundary mark: the prefix sums of the lengths of the spans between marks."""
    return [m.end() for m in BOUNDARY.finditer(text)]


def cut_points(text: str, limit: int = 512, overlap: int = 64) -> list[tuple[int, int, str]]:
    """(start, end, cut) of each piece; every piece but the first begins ``overlap`` characters before the end of the one before it.

    The end is the last boundary within the limit and beyond the piece before, found by binary search in the sorted boundary array. Without one there is a hard cut at the limit: ``forced`` if
    the stretch between the boundaries on either side is longer than the limit, so that no cut of any kind could avoid it, else ``hard`` (the overlap takes the room). Other cuts are ``natural``,
    the last piece is ``end``. Every stretch longer than the limit has a forced cut, as no piece can hold it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    ends, n, out, start, floor = boundary_offsets(text), len(text), [], 0, 0
    while n - start > limit:
        at = bisect_right(ends, start + limit) - 1
        if at >= 0 and ends[at] > floor:
            end, cut = ends[at], "natural"
        else:
            after = ends[at + 1] - 1 if at + 1 < len(ends) else n
            end, cut = start + limit, "forced" if after - (ends[at] if at >= 0 else 0) > limit else "hard"
        out.append((start, end, cut))
        start, floor = end - overlap, end
    out.append((start, n, "end"))
    return out


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 512, overlap: int = 64, only_oversized: bool = False, distinct: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` characters with exactly ``overlap`` characters in common, numbered from 0 in reading order.

    Defined cases: rows with a null key or text give no piece, an empty text none; a text within the limit is one piece. Repeated rows of a key are cut once (rows of one key with unlike
    texts: each text once); with ``distinct`` false repeated rows give repeated pieces, and whole texts need no shuffle. Characters are Unicode code points; further columns are ignored.
    Pieces minus their overlaps concatenate to the text.

    Returns key, piece_index, start_offset, end_offset, cut, is_forced (some stretch of more than ``limit`` characters has no boundary), piece.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null and length(t) > 0")
    if only_oversized:
        rows = rows.filter(F.length("t") > limit)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                cuts = cut_points(t, limit, overlap)
                forced = any(c == "forced" for *_, c in cuts)
                out += [(k, i, s, e, c, forced, t[s:e]) for i, (s, e, c) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=[key, "piece_index", "start_offset", "end_offset", "cut", "is_forced", "piece"])

    rows = rows.withColumn("h", F.md5("t")).dropDuplicates(["k", "h"]).drop("h") if distinct else rows
    return rows.mapInPandas(run, f"`{key}` {kind}, piece_index int, start_offset int, end_offset int, cut string, is_forced boolean, piece string")
