"""Rank aggregation and splitting against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import datetime as dt
import math
import random
from itertools import groupby

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.rank_aggregation import aggregate_ranks
from quarryline.llm.splitting import boundary_offsets, cut_points, split_oversized

HITS = "query_id long, chunk_id string, retriever string, score double, hit_ts timestamp, rank int, g string"
NOW = dt.datetime(2026, 1, 1)


def brute(hits):
    """Ranking of one query by the definition: (item, n, mean, p) with rank."""
    last = {}
    for q, c, s, x, t in hits:
        if None in (q, c, s):
            continue
        x = None if x is None or math.isnan(x) or math.isinf(x) else x
        key = (q, c, s)
        if key not in last or (t, -math.inf if x is None else x) > last[key]:
            last[key] = (t, -math.inf if x is None else x)
    out = []
    for q in {k[0] for k in last}:
        items = {k[1]: [] for k in last if k[0] == q}
        for s in {k[2] for k in last if k[0] == q}:
            given = {k[1]: (v[1] if s == "l2_dist" else -v[1]) for k, v in last.items() if k[0] == q and k[2] == s and v[1] != -math.inf}
            n = len(given)
            for c, y in given.items():
                same = sum(z == y for z in given.values())
                if n == 1 or same < n:
                    items[c].append((sum(z < y for z in given.values()) + (same + 1) / 2) / n)
        scored = []
        for c, rs in items.items():
            rs, n = sorted(rs), len(rs)
            p = min((sum(math.comb(n, j) * r**j * (1 - r) ** (n - j) for j in range(k, n + 1)) for k, r in enumerate(rs, 1)), default=2.0)
            scored.append((round(p * max(n, 1), 9), round(sum(rs) / n, 9) if n else 1.0, c, n))
        for p, m, c, n in scored:
            out.append((q, c, n, m, min(p, 1.0), 1 + sum((a, b) < (p, m) for a, b, *_ in scored)))
    return sorted(out, key=repr)


def table(spark, hits):
    return spark.createDataFrame([(*h, 1, "x") for h in hits], HITS)


@pytest.mark.parametrize("hot", [10**9, 3])
def test_ranking_matches_brute_force(spark, hot):
    r = random.Random(3)
    hits = [(r.randrange(3), f"c{r.randrange(7)}", r.choice(["dense", "l2_dist", "bm25"]), r.choice([0.1, 0.5, 7.0, r.random(), None, math.nan, 1e12]), NOW + dt.timedelta(days=r.randrange(3))) for _ in range(90)]
    hits += hits[:9] + [(None, "c1", "dense", 1.0, NOW), (1, None, "dense", 1.0, NOW), (1, "c1", None, 1.0, NOW), (9, "only", "dense", None, NOW)]
    got = [(a, b, c, round(d, 9), round(e, 9), f) for a, b, c, d, e, f in rows(aggregate_ranks(table(spark, hits), hot_rows=hot))]
    want = [(a, b, c, round(d, 9), round(e, 9), f) for a, b, c, d, e, f in brute(hits)]
    assert [(a, b, c, f) for a, b, c, _, _, f in got] == [(a, b, c, f) for a, b, c, _, _, f in want]
    assert all(abs(x[3] - y[3]) < 1e-8 and abs(x[4] - y[4]) < 1e-8 for x, y in zip(got, want))


def test_scale_does_not_matter(spark):
    base = [(1, f"c{i}", s, float(i), NOW) for i in range(6) for s in ("dense", "bm25")]
    scaled = [(q, c, s, x * 1e9 if s == "bm25" else x, t) for q, c, s, x, t in base]
    assert rows(aggregate_ranks(table(spark, base))) == rows(aggregate_ranks(table(spark, scaled)))


def test_constant_source_is_ignored_and_empty_is_empty(spark):
    hits = [(1, f"c{i}", "dense", float(i), NOW) for i in range(4)]
    assert rows(aggregate_ranks(table(spark, hits))) == rows(aggregate_ranks(table(spark, hits + [(1, f"c{i}", "flat", 5.0, NOW) for i in range(4)])))
    assert aggregate_ranks(table(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab。\n. !；", max_size=200), st.integers(2, 40), st.data())
def test_pieces_cover_the_text(text, limit, extra):
    overlap = extra.draw(st.integers(0, limit - 1))
    if not text:
        return
    cuts = cut_points(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(y[0] == x[1] - overlap for x, y in zip(cuts, cuts[1:]))
    joined, at = "", 0
    for s, e, _ in cuts:
        assert 0 < e - s <= limit and s <= at < e
        joined, at = joined + text[at:e], e
    assert joined == text
    # a piece is cut by force exactly where some stretch without a mark is longer than the limit
    edges = [0, *boundary_offsets(text)]
    spans = [b - 1 - a for a, b in zip(edges, edges[1:])] + [len(text) - edges[-1]]
    assert any(c == "forced" for *_, c in cuts) == (max(spans) > limit)


def test_split_cases(spark):
    long = "长" * 600 + "。" + "句子。" * 200
    df = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "短文。", 2), ("c", None, 3), (None, "x", 4), ("d", "", 5), ("e", "one. " * 300, 6)], "chunk_id string, text string, k int")
    got = split_oversized(df).collect()
    by = {k: sorted(g, key=lambda r: r.piece_index) for k, g in groupby(sorted(got, key=lambda r: r.chunk_id), key=lambda r: r.chunk_id)}
    assert set(by) == {"a", "b", "e"} and len(by["b"]) == 1
    assert by["a"][0].is_forced and not by["e"][0].is_forced
    assert all(len(r.piece) <= 512 for r in got)
    assert [r.piece_index for r in by["a"]] == list(range(len(by["a"])))
    assert all(y.start_offset == x.end_offset - 64 for k in by for x, y in zip(by[k], by[k][1:]))
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cut_points("x" * 20, 10, 10)
