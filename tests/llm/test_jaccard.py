"""The Jaccard join against all pairs."""

import re

import numpy as np
import pytest

from basalt.llm import jaccard
from basalt.llm.components import components


def shingle_sets(rows, k):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, k, percent):
    sets = shingle_sets(rows, k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None:
                continue
            if i == j or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted(((i, len(x), low.get(find(a))) for a, (i, x) in enumerate(sets)), key=str)


@pytest.fixture(scope="module")
def family():
    """Sets of all sizes around the light and heavy boundary, each with versions at several distances."""
    import random

    rng = random.Random(9)
    rows, i = [], 100
    for n in [3, 4, 8, 11, 12, 13, 14, 15, 18, 22, 24, 30, 45, 80, 150]:
        base = [f"v{rng.randrange(3000)}" for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [w[at], f"e{rng.randrange(10**6)}"], [f"e{rng.randrange(10**6)}"]])
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("join", [jaccard.Join(), jaccard.Join(words=2, percent=70, strong=2), jaccard.Join(words=5, percent=80, scheme="prefix")])
def test_equals_all_pairs(spark, make_docs, odd_rows, family, join):
    rows = odd_rows + family
    got = jaccard.near_duplicates(make_docs(spark, rows), join).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, join.words, join.percent)


@pytest.mark.parametrize(("scheme", "most"), [("blocks", 1 << 19), ("prefix", 1 << 19), ("prefix", 3)])
def test_large_lists_and_clusters_are_dealt_by_pairs_of_blocks(spark, make_docs, odd_rows, family, monkeypatch, scheme, most):
    for name, value in {"CLUSTER": 4, "BITMAPS": 4, "COMMON": 2, "MOST_COMMON": most, "HELD": 3, "TILE": 2}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = odd_rows + family
    got = jaccard.near_duplicates(make_docs(spark, rows), jaccard.Join(percent=80, scheme=scheme)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 80)


def test_bitmaps_never_part_linked_sets():
    rng = np.random.default_rng(8)
    sets = []
    for size in (3, 40, 41, 300, 310, 2500, 2600):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets += [base, np.append(base[: int(size * 0.93)], rng.integers(0, 1 << 63, max(1, size // 40)).astype(np.uint64))]
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    bits, n = jaccard.parity_bitmaps(np.concatenate(sets), bounds), np.diff(bounds)
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if (k := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - k)]
    assert len(linked) >= 6
    root = jaccard.near_roots(n, bits, 80)
    for i, j in linked:
        assert root[i] == root[j] and jaccard.near_pairs(n[[i, j]], [bits[i], bits[j]], 80)[0]
    assert len(set(root.tolist())) > 4


def test_null_ids_and_empty_tables(spark, make_docs):
    text = "a b c d e f"
    got = jaccard.near_duplicates(make_docs(spark, [(None, text), (7, text), (None, "x y z")])).collect()
    assert sorted(((r[0], r[2]) for r in got), key=str) == [(7, 7), (None, None), (None, None)]
    assert jaccard.near_duplicates(make_docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
