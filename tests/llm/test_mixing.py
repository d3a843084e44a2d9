"""Mixing: shares, caps, soft members and the defined cases."""

import math
import random

import pytest

from quarryline.llm import mixing
from quarryline.llm.mixing import mix_sources, posterior, reached_shares

TARGETS = "source string, target_weight double, max_repeats int"


def documents(spark, seed=0, n=3000):
    r = random.Random(seed)
    words = {"a": "revenue margin orders".split(), "b": "weather rain storm".split(), "c": "goal match team".split()}
    rows = []
    for i in range(n):
        s = r.choices("abc", [0.8, 0.15, 0.05])[0]
        rows.append((i, " ".join(r.choices(words[s], k=r.randrange(5, 200))), s, r.random(), "x"))
    return rows, "doc_id long, text string, source string, tokens double, rate string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(*documents(spark))


def test_shares_are_reached(spark, docs):
    targets = spark.createDataFrame([("a", 50.0, 1), ("b", 30.0, 2), ("c", 20.0, 6), ("missing", 9.0, 3)], TARGETS)
    picked = mix_sources(docs, targets)
    got = {r.source: r for r in reached_shares(picked, targets).collect()}
    counts = picked.collect()
    assert got["missing"].reached_share == got["missing"].reachable_share == 0 and abs(got["missing"].target_share - 9 / 109) < 1e-9
    # within one document of each target
    largest, total = max(r.tokens for r in counts), sum(r.tokens for r in got.values())
    assert all(abs(got[s].tokens - w * total) <= 2 * largest and abs(got[s].reachable_share - w) < 1e-9 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert len({r.doc_id for r in counts}) == len(counts)
    assert all(1 <= r.n_copies <= {"a": 1, "b": 2, "c": 6}[r.source] for r in counts)


def test_the_fit_uses_soft_memberships_in_several_steps(spark, docs, monkeypatch):
    seen = {}

    def spy(cells, weights, **k):
        seen["cells"] = [r.cell for r in cells.collect()]
        seen["history"], seen["target"] = FIT(cells, weights, **k)
        seen["after"] = mixing._totals(cells, len(weights), seen["history"])
        return seen["history"], seen["target"]

    FIT = mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", spy)
    # two sources write alike, so that memberships overlap
    mixed = docs.replace({"c": "d"}, subset="source").union(docs.filter("source = 'b' and doc_id % 2 = 0").replace({"b": "e"}, subset="source").selectExpr("doc_id + 100000", "text", "source", "tokens", "rate"))
    targets = spark.createDataFrame([("a", 4.0, 1), ("b", 1.0, 2), ("d", 2.0, 6), ("e", 3.0, 5)], TARGETS)
    picked = mix_sources(mixed, targets, softness=0.5).collect()
    assert any("," in c for c in seen["cells"]) and sum(soft for soft, _ in seen["history"]) > 1
    assert all(abs(x - t) <= 1e-3 * seen["target"].sum() for x, t in zip(seen["after"][:, 1], seen["target"]))
    got = {s: sum(r.tokens * r.n_copies for r in picked if r.source == s) for s in "abde"}
    assert all(abs(got[s] - t) <= max(r.tokens for r in picked) for s, t in zip("abde", seen["target"]))


def test_cells_round_trip():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(50):
        p = r.dirichlet(np.full(5, 0.4))
        q = mixing.memberships_of([mixing.cell_of(p)], 5)[0]
        assert abs(q.sum() - 1) < 1e-9 and np.abs(p - q).max() <= 1 / mixing.PARTS


def test_members_without_a_source_are_placed_by_their_text(spark):
    rows, schema = documents(spark, 1, 1500)
    hidden = [(i, t, None if i % 3 == 0 else s, x, y) for i, t, s, x, y in rows]
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 3), ("c", 1.0, 9)], TARGETS)
    truth = {i: s for i, _, s, *_ in rows}
    got = [(r.doc_id, r.source) for r in mix_sources(spark.createDataFrame(hidden, schema), targets).collect() if r.doc_id % 3 == 0]
    assert got and sum(truth[i] == s for i, s in got) / len(got) > 0.95


def test_results_do_not_depend_on_partitions(spark, docs):
    targets = spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 2)], TARGETS)
    one = sorted(map(tuple, mix_sources(docs.repartition(1), targets).collect()))
    assert one == sorted(map(tuple, mix_sources(docs.repartition(9), targets).collect()))


def test_cases(spark, docs):
    targets = spark.createDataFrame([("a", 1.0, None), ("b", math.nan, 3), ("c", -4.0, 2), (None, 5.0, 1), ("b", None, 1)], TARGETS)
    got = mix_sources(docs.union(docs), targets).collect()
    assert {r.source for r in got} == {"a"} and all(r.n_copies == 1 for r in got) and len({r.doc_id for r in got}) == len(got)
    odd = spark.createDataFrame([(None, "x y", "a", 0.0, ""), (1, None, "a", 0.0, ""), (2, "", "a", 0.0, ""), (3, "word " * 50_000, "a", 0.0, ""), (4, "x", "untargeted", 0.0, "")], docs.schema)
    assert {r.doc_id for r in mix_sources(odd, targets).collect()} == {3}
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0
    assert reached_shares(mix_sources(docs.limit(0), targets), targets).count() == 3


def test_posterior_sums_to_one():
    import numpy as np

    from quarryline.llm.mixing import FEATURES

    assert abs(sum(posterior(np.zeros((3, FEATURES + 1)), [1, 2, 3])) - 1) < 1e-9 and len(posterior(np.zeros((2, FEATURES + 1)), [])) == 2


def test_a_target_without_documents_takes_no_members(spark):
    rows, schema = documents(spark, 2, 1500)
    hidden = [(i, t, None if i % 20 == 0 else s, x, y) for i, t, s, x, y in rows]
    both = [("a", 50.0, 1), ("b", 30.0, 3), ("c", 20.0, 9)]
    tables = [spark.createDataFrame(hidden, schema), spark.createDataFrame(both, TARGETS), spark.createDataFrame([*both, ("podcast", 40.0, 2)], TARGETS)]
    without, picked = (sorted(map(tuple, mix_sources(tables[0], t).collect())) for t in tables[1:])
    assert not any(s == "podcast" for _, s, *_ in picked)
    assert abs(sum(n * c for _, _, n, c, _ in picked) - sum(n * c for _, _, n, c, _ in without)) <= 200 * 3 and picked
    unlabelled = spark.createDataFrame([(1, "x", None, 0.0, "x")], schema)
    assert mix_sources(unlabelled, tables[1]).count() == 0
