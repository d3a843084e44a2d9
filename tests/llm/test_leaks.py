"""Leak search against brute force."""

import math
import random

import pytest

from quarryline.llm import leakage
from quarryline.llm.leakage import ItemIndex, code_points, leaked_items, longest_common_run, term_hashes

ALPHABET = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥abcdefgh0123"


def plain(t):
    return "".join(c for c in t.lower() if c.isalnum())


def example(seed):
    r = random.Random(seed)
    items = [(i, "".join(r.choices(ALPHABET, k=r.choice([20, 45, 90, 200]))) + "。") for i in range(40)]
    docs = []
    for d in range(60):
        text = "".join(r.choices(ALPHABET, k=r.randrange(0, 400)))
        for _ in range(r.randrange(3)):
            i, t = r.choice(items)
            n = r.choice([20, 38, 39, 40, 41, 60, 500])
            s = r.randrange(max(1, len(t) - n))
            piece = t[s : s + n]
            if r.random() < 0.5:
                piece = "，\n ".join(piece[k : k + 7].upper() for k in range(0, len(piece), 7))
            at = r.randrange(len(text) + 1)
            text = text[:at] + piece + text[at:]
        docs.append((d, text))
    return docs, items


def brute(docs, items):
    return sorted((d, i) for d, t in docs if d is not None and t is not None for i, x in items if i is not None and x is not None for a in [plain(x)] if any(a[s : s + 40] in plain(t) for s in range(len(a) - 39)))


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("size", [4_000_000, 500])
def test_against_brute_force(spark, monkeypatch, seed, size):
    monkeypatch.setattr(leakage, "INDEX_CHARS", size)
    docs, items = example(seed)
    docs += docs[:2] + [(None, docs[0][1]), (900, None), (901, ""), (902, items[3][1] * 400)]
    items = items + items[:1] + [(None, "x" * 50), (800, None), (801, "")]
    d, i = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in leaked_items(d, i).collect()]
    assert sorted(got) == sorted(set(brute(docs, items)))


def test_search_equals_full_scoring():
    docs, items = example(5)
    # items that repeat themselves have low floors, which must not matter to the others
    items += [(100 + i, "甲乙丙丁戊己庚辛" * (6 + i)) for i in range(3)]
    index = ItemIndex([i for i, _ in items], [plain(t) for _, t in items], 40)
    assert index.floor == sorted(index.floor)
    r = random.Random(0)
    for _ in range(200):
        terms = sorted(set(r.sample(range(len(index.terms)), 60) + list(range(k := r.randrange(len(index.terms) - 50), k + 50))))
        scores = {}
        for t in terms:
            for i, w in zip(index.items[index.begin[t] : index.begin[t + 1]], index.weights[index.begin[t] : index.begin[t + 1]]):
                scores[int(i)] = scores.get(int(i), 0) + float(w)
        assert sorted(index.search(terms)) == sorted(i for i, s in scores.items() if s >= index.floor[i])


def test_floors_are_the_least_window():
    for _, t in example(3)[1] + [(0, "甲乙丙丁戊己庚辛" * 9), (1, "ab" * 40), (2, "a" * 60)]:
        t = plain(t)
        index = ItemIndex([1], [t], 40)
        weight = {index.terms[k]: float(index.weights[index.begin[k]]) for k in range(len(index.terms))}
        h = term_hashes(code_points(t))
        want = min((sum(weight[x] for x in set(h[s : s + 33])) for s in range(len(h) - 32)), default=math.inf)
        assert index.floor[0] == want or abs(index.floor[0] - want) < 1e-4 * want and index.floor[0] <= want


def test_longest_common_run():
    item = "a" * 10 + "".join(map(chr, range(0x4E00, 0x4E00 + 100)))
    assert longest_common_run("x" + "".join(map(chr, range(0x4E05, 0x4E05 + 60))), item, 40) == (60, 15)
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("ab" if r.random() < 0.5 else "abcdefg", k=r.randrange(0, 60))) for _ in range(2))
        runs = [(n, s) for s in range(len(b)) for n in range(3, len(b) - s + 1) if b[s : s + n] in a]
        want = max(runs, key=lambda x: (x[0], -x[1]), default=(0, 0))
        assert longest_common_run(a, b, 3) == want


def test_long_texts_are_sliced_without_loss(monkeypatch):
    monkeypatch.setattr(leakage, "SLICE", 150)
    docs, items = example(7)
    texts, index = [plain(t) * 3 for _, t in docs], ItemIndex([i for i, _ in items], [plain(t) for _, t in items], 40)
    got = {(i, index.ids[k]) for i, k, _, _ in index.leaks(texts)}
    assert got == {(i, k) for i, t in enumerate(texts) for k, x in items if any(plain(x)[s : s + 40] in t for s in range(len(plain(x)) - 39))} and got


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(d, i).count() == 0
