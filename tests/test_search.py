"""Searches whose queries are rows of a table, against plain Python versions."""

import math
import random
import re

from quarryline.operators import retrieval as R


def test_cosine_of_table(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>").repartition(3)
    got = {}
    for x in R.cosine_top_k_of(df, df.filter("i % 10 = 0").withColumnRenamed("i", "query"), "query", "i", "v", 5).collect():
        got.setdefault(x.query, []).append((x["rank"], x.i, x.similarity))
    valid = {i: v for i, v in rows if v and len(v) == 4 and any(v)}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 6)
    assert set(got) == {q for q in valid if q % 10 == 0} and len(got) > 2
    for q, found in got.items():
        best = sorted((-cos(valid[q], v), i) for i, v in valid.items())[:5]
        assert [(n, i) for n, i, _ in sorted(found)] == [(n, i) for n, (_, i) in enumerate(best, 1)]


def words(text):
    runs = re.findall(r"[一-鿿]+|[a-z0-9]+", text.lower())
    return [w for r in runs for w in ([r[i : i + 2] for i in range(len(r) - 1)] if "一" <= r[0] <= "鿿" and len(r) > 1 else [r])]


def test_bm25_of_table(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["毛利率", "提升", "margin ", "Backlog", "，", "营收", "增", " 7 "]) for _ in range(r.randrange(1, 15)))) for i in range(50)] + [(50, None), (60, "，")]
    df = spark.createDataFrame(rows, "i long, t string").repartition(3)
    got = {}
    for x in R.bm25_top_k_of(df, df.filter("i % 10 = 0").withColumnRenamed("i", "query"), "query", "i", "t", 4).orderBy("rank").collect():
        got.setdefault(x.query, []).append((x.i, x.score))
    docs = {i: words(t) for i, t in rows if t is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    idf = lambda w: math.log(1 + (len(docs) - (n := sum(w in d for d in docs.values())) + 0.5) / (n + 0.5))
    for q in range(0, 50, 10):
        s = {i: round(sum(idf(w) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in docs[q]), 6) for i, d in docs.items()}
        best = sorted(((-x, i) for i, x in s.items() if x > 0))[:4]
        assert [i for i, _ in got[q]] == [i for _, i in best] and all(abs(a + b[0]) < 2e-6 for (_, a), b in zip(got[q], best))
    assert 60 not in got


def test_index_rows_keep_their_text(spark, tmp_path):
    from quarryline.plans.reports import index_rows

    texts = ["x" * 300 + "a", "x" * 300 + "b"]
    columns = "chunk_id text source_type chunk_method stock_code stock_name institution report_date industry rating report_title pdf_file current_section".split()
    rows = [tuple({"chunk_id": "c", "text": t, "current_section": "s" * 300}.get(c) for c in columns) + (None, 3) for t in [*texts, texts[0]]]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", page_idx int, chunk_index int").write.parquet(str(tmp_path / "all_chunks.parquet"))
    got = sorted((r.text, len(r.current_section), r.rating, r.page_idx, r.chunk_index) for r in index_rows(spark, str(tmp_path)).collect())
    assert got == [(t, 256, "", -1, 3) for t in texts]
