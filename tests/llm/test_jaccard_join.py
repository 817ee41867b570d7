from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from viewforge.llm import jaccard_join as J


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for base in range(30):
        text = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 150]))]
        if base % 3 == 0:
            text += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 3)])
def test_against_all_pairs(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, block_classes=block, group_classes=2).collect()}
    assert out == brute(rows)


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        most = J.differ_at_most(n, 80)
        gone = int(rng.integers(0, most + 1))
        other = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, most - gone + 1)), dtype=np.uint64)]))
        a, b = np.unique(base), other
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            frequent = np.sort(a[: len(a) // 3])
            x, y = (J.signatures(s, frequent, 80) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_rows_without_identifier_link(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(None, text), (None, text + " one"), (5, text + " two"), (6, "other words than these ones here"), (5, "another text under the same identifier"), (7, "another text under the same identifier")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted((str(r.id), r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    assert out == [("5", 2, 5), ("5", 197, 5), ("6", 2, 6), ("7", 2, 5), ("None", 196, 5), ("None", 197, 5)]


def test_cases(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, "A b C"), (2, "a B c"), (3, ""), (4, None), (5, " \t\n"), (6, "É x"), (7, "é x"), (8, long), (9, long + " more"), (9, long + " more"), (None, "q r s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    out = {r.id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 7), 8: (2996, 8), 9: (2997, 8), None: (1, None)}
    assert J.jaccard_components(df).count() == len(rows)
    assert J.jaccard_components(df.limit(0)).count() == 0
