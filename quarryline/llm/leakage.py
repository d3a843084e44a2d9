"""Passages of test items in a training corpus: BM25 inverted index of the items, block-max WAND, exact overlap check."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.text import narrow

#: Length of a term (a run of letters and digits), of a training passage, and items per block of a posting list.
TERM, PASSAGE, BLOCK = 8, 120, 16
#: Characters of items that one index holds at most (some 25 bytes each); beyond it the items are indexed in blocks, each against all documents.
INDEX_CHARS = 4_000_000
#: Characters of documents that are hashed at once.
SLICE = 400_000
K1, B = 1.2, 0.75
_BASE = 1_000_003
_MASK = (1 << 64) - 1


def plain(c: Column) -> Column:
    """Letters and digits only, in lower case and without width."""
    return F.lower(F.regexp_replace(narrow(c), r"[^\p{L}\p{N}]+", ""))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def term_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the term at each position: hashes of 2, 4 and 8 characters, each of two halves."""
    h, width = points + np.uint64(1), 1
    while width < TERM:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class RunHashes:
    """Hashes of the runs of any length of a text, from prefix sums modulo 2^64."""

    def __init__(self, text: str):
        points = code_points(text) + np.uint64(1)
        n = len(points)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.uint64(_BASE)
        np.cumprod(powers, out=powers)
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[:-1])])

    def of(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[: len(self.sums) - length]) * self.back[: len(self.sums) - length]


def longest_common_run(text: str, item: str, least: int) -> tuple[int, int]:
    """The longest run of at least ``least`` characters that both texts hold, and where it first starts in the item; (0, 0) without one. Its length is found by bisection over hashed runs."""
    if min(len(text), len(item)) < least:
        return 0, 0
    a, b = RunHashes(text), RunHashes(item)

    def start(length: int) -> int | None:
        common = np.isin(b.of(length), a.of(length))
        at = int(common.argmax())
        if not common[at]:
            return None
        if item[at : at + length] in text:
            return at
        # equal hashes of unlike runs: compare the texts themselves
        return next((int(i) for i in np.flatnonzero(common) if item[i : i + length] in text), None)

    low, where = least, start(least)
    if where is None:
        return 0, 0
    high = min(len(text), len(item)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        at = start(middle)
        if at is None:
            high = middle
        else:
            low, where = middle, at
    return low, where


class ItemIndex:
    """Inverted index of test items with BM25 weights, as flat arrays; and, per item, the least score that ``overlap`` common characters give (its floor).

    Items are numbered in the order of their floors, so within a posting list, as items go up, so do the scores that they need.
    """

    def __init__(self, ids: list, texts: list[str], overlap: int):
        self.overlap, self.span, n = overlap, overlap - TERM + 1, len(texts)
        hashes = [term_hashes(code_points(t)) for t in texts]
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        flat, owner = np.concatenate([*hashes, np.empty(0, np.uint64)]), np.repeat(np.arange(n), sizes)
        self.terms, at = np.unique(flat, return_inverse=True)
        pairs, where, tf = np.unique(at.astype(np.int64) * max(1, n) + owner, return_inverse=True, return_counts=True)
        term, item = pairs // max(1, n), pairs % max(1, n)
        df = np.bincount(term, minlength=len(self.terms))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if n else 1.0))
        weight = (np.log(1 + (n - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        floor = np.array([self._floor(at[begins[i] : begins[i + 1]], weight[where[begins[i] : begins[i + 1]]].astype(float)) for i in range(n)])
        order = np.argsort(floor, kind="stable")
        self.ids, self.texts, self.floor = [ids[i] for i in order], [texts[i] for i in order], floor[order].tolist()
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        by_term = np.lexsort((number[item], term))
        self.items, self.weights = number[item][by_term].astype(np.int32), weight[by_term]
        self.begin = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        # blocks of BLOCK postings of a term, with the largest weight of each
        counts = -(-df // BLOCK)
        self.block_begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        block = self.block_begin[term[by_term]] + (np.arange(len(by_term)) - self.begin[term[by_term]]) // BLOCK
        self.block_max = np.zeros(int(self.block_begin[-1]), np.float32)
        np.maximum.at(self.block_max, block, self.weights)
        self.tops = np.zeros(len(self.terms), np.float32)
        np.maximum.at(self.tops, term[by_term], self.weights)
        # which hashes may be terms at all
        self.bits = np.uint64(max(10, min(27, int(len(self.terms) * 8).bit_length())))
        self.sieve = np.zeros(1 << int(self.bits), bool)
        self.sieve[(self.terms >> (np.uint64(64) - self.bits)).astype(np.int64)] = True

    def _floor(self, at: np.ndarray, weight: np.ndarray) -> float:
        """The least sum of the weights of distinct terms in ``span`` consecutive positions, in one pass."""
        windows = len(at) - self.span + 1
        if windows <= 0:
            return math.inf
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        score = sums[self.span :] - sums[:windows]
        last: dict[int, int] = {}
        away = np.zeros(windows + 1)
        for j, t in enumerate(at.tolist()):
            p = last.get(t, -self.span)
            if p > j - self.span:
                # counted twice by the windows that begin at or before the earlier position and hold both
                away[max(0, j - self.span + 1)] += weight[j]
                away[min(windows, p + 1)] -= weight[j]
            last[t] = j
        return float((score - np.cumsum(away)[:windows]).min()) * (1 - 1e-6)

    def search(self, terms: list[int]) -> list[int]:
        """All items whose score for the query reaches the item's floor; block-max WAND with the floors as thresholds."""
        cursors = []
        for t in terms:
            postings = self.items[self.begin[t] : self.begin[t + 1]].tolist()
            cursors.append([postings[0], 0, postings, float(self.tops[t]), t])
        found, floor = [], self.floor
        while True:
            cursors = [c for c in cursors if c[1] < len(c[2])]
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= floor[c[0]]:
                    pivot = c[0]
                    break
            if pivot is None:
                return found
            blocks, end = 0.0, math.inf
            for c in cursors:
                if c[0] > pivot:
                    end = min(end, c[0])
                    break
                c[1] = bisect_left(c[2], pivot, c[1])
                if c[1] < len(c[2]):
                    b = c[1] // BLOCK
                    blocks += float(self.block_max[self.block_begin[c[4]] + b])
                    end = min(end, c[2][min(len(c[2]), (b + 1) * BLOCK) - 1] + 1)
            if blocks >= floor[pivot]:
                score = sum(float(self.weights[self.begin[c[4]] + c[1]]) for c in cursors if c[0] <= pivot and c[1] < len(c[2]) and c[2][c[1]] == pivot)
                if score >= floor[pivot]:
                    found.append(pivot)
                target = pivot + 1
            else:
                # no item before the end of these blocks can reach its floor, as floors only rise
                target = max(pivot + 1, int(end)) if end < math.inf else pivot + 1
            for c in cursors:
                if c[0] < target:
                    c[1] = bisect_left(c[2], target, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else math.inf

    def _slices(self, texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], str]]:
        """The texts put together in slices of about SLICE characters: ([(text, where it begins)], characters). A longer text is cut, with what a passage needs on both sides."""
        parts: list[tuple[int, int]] = []
        held: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            for s in range(0, max(1, len(t) - self.overlap + 1), SLICE):
                piece = t[s : s + SLICE + PASSAGE]
                if held and size + len(piece) > SLICE:
                    yield parts, "\0".join(held)
                    parts, held, size = [], [], 0
                parts.append((i, size))
                held.append(piece)
                size += len(piece) + 1
        if held:
            yield parts, "\0".join(held)

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, length, start in the item) of each item of which a text holds enough."""
        if not len(self.terms):
            return
        candidates: dict[int, set[int]] = {}
        step = PASSAGE - self.overlap + 1
        for parts, chars in self._slices(texts):
            h = term_hashes(code_points(chars))
            near = np.flatnonzero(self.sieve[(h >> (np.uint64(64) - self.bits)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, h[near]), len(self.terms) - 1)
            hit = self.terms[at] == h[near]
            near, at = near[hit], at[hit]
            begins = np.array([b for _, b in parts] + [len(chars) + 1])
            edges = np.searchsorted(near, begins)
            for j in np.flatnonzero(np.diff(edges) >= self.span):
                place, term = near[edges[j] : edges[j + 1]] - begins[j], at[edges[j] : edges[j + 1]]
                first = np.arange(0, begins[j + 1] - begins[j], step)
                low, high = np.searchsorted(place, first), np.searchsorted(place, first + PASSAGE - TERM + 1)
                for a, b in zip(low, high):
                    if b - a >= self.span:
                        terms = np.unique(term[a:b])
                        if self.tops[terms].sum() >= self.floor[0] * (1 - 1e-6):
                            candidates.setdefault(parts[j][0], set()).update(self.search(terms.tolist()))
        for i in sorted(candidates):
            for item in sorted(candidates[i]):
                n, start = longest_common_run(texts[i], self.texts[item], self.overlap)
                if n:
                    yield i, item, n, start


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list]:
    """The items in blocks of at most INDEX_CHARS characters, streamed partition by partition."""
    block, chars = [], 0
    for r in items.select(F.col(key).alias("k"), plain(F.col(text)).alias("t")).filter("k is not null and t is not null").distinct().orderBy("k", "t").toLocalIterator():
        if block and chars + len(r["t"]) > INDEX_CHARS:
            yield block
            block, chars = [], 0
        block.append((r["k"], r["t"]))
        chars += len(r["t"])
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", overlap: int = 40) -> DataFrame:
    """Every pair of document and item that have at least ``overlap`` consecutive letters and digits in common.

    The items are a set of stated size: they are indexed in blocks of bounded size (INDEX_CHARS), each of which is broadcast and held against all documents.
    Every passage of a document (passages overlap by ``overlap`` - 1) is a query for its terms, runs of TERM characters. An item's floor is the least
    BM25 score that any ``overlap`` consecutive characters of it give, so no pair is lost; candidates are then compared by their text, in time that grows with its length (times a logarithm).
    Of several longest runs of a pair the first in the item counts.

    Defined cases: rows with a null key or text match nothing, nor do items with fewer than ``overlap`` letters and digits; repeated rows give one pair.
    Documents of any length are read whole. Further columns are ignored; without documents or items the result is empty.

    Returns key, item_key, overlap_chars, item_start (both in letters and digits).
    """
    spark = documents.sparkSession
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, overlap_chars int, item_start int"
    rows = documents.select(F.col(key).alias("k"), plain(F.col(text)).alias("t")).filter("k is not null and t is not null").filter(F.length("t") >= overlap)
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item_key, text):
        index = spark.sparkContext.broadcast(ItemIndex([k for k, _ in block], [t for _, t in block], overlap))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            own = index.value
            for b in batches:
                keys = b["k"].tolist()
                found = [(keys[i], own.ids[item], n, s) for i, item, n, s in own.leaks(b["t"].tolist())]
                yield pd.DataFrame(found, columns=[key, item_key, "overlap_chars", "item_start"])

        out = out.unionByName(rows.mapInPandas(run, schema))
    best = out.groupBy(key, item_key).agg(F.max(F.struct("overlap_chars", (-F.col("item_start")).alias("back"))).alias("x"))
    return best.select(key, item_key, "x.overlap_chars", (-F.col("x.back")).alias("item_start"))
