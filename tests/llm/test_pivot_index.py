from __future__ import annotations

import math

import numpy as np
import pytest

from viewforge.llm import pivot_index as V
from viewforge.llm.components import connected_components


def brute(ids, vectors, threshold=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= threshold
    np.fill_diagonal(links, False)
    least = {i: i for i in ids}
    for _ in range(len(ids)):
        new = {i: min([least[i], *(least[ids[k]] for k in np.flatnonzero(links[n]))]) for n, i in enumerate(ids)}
        if new == least:
            break
        least = new
    return {i: (int(links[n].sum()), least[i]) for n, i in enumerate(ids)}


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_recall(spark, block_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    vectors = np.vstack([rng.normal(size=(300, 32)), np.repeat(centres, 10, 0) + rng.normal(size=(400, 32)) * 0.12, centres[0] + rng.normal(size=(150, 32)) * 0.1])
    ids = rng.permutation(5000)[: len(vectors)].tolist()
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, label int")
    out = {r.id: (r.n_links, r.component_id) for r in V.near_vectors(df, block_rows=block_rows).collect()}
    want = brute(ids, vectors)
    found, there = sum(n for n, _ in out.values()), sum(n for n, _ in want.values())
    assert there > 1000 and 0.9 * there <= found <= there
    assert all(out[i][0] <= want[i][0] for i in ids)


def test_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []), (11, [1e300, 1e-300]), (12, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(df).collect()}
    assert len(out) == len(rows)
    assert out[1] == (3, 1, True) and out[2] == out[11] == out[None] == (3, 1, False)
    assert out[3] == (1, 3, True) and out[12] == (1, 3, False)
    for k in (4, 5, 6, 7, 8, 9, 10):
        assert out[k] == (0, k, True)
    assert V.near_vectors(df.limit(0)).count() == 0
    assert V.near_vectors(df.filter("vec_id in (4, 5)")).count() == 2


def test_namesakes_lengths_and_missing_identifiers(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01]), (7, [0.0, 0.0, 1.0]), (8, [0.0, 0.01, 1.0]), (9, [0.0, 1.0, 0.0]), (None, [5.0]), (None, [7.0]), (None, [0.0, 1.01, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(((r.id, r.n_links, r.component_id) for r in V.near_vectors(df).collect()), key=str)
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 1, 7), (8, 1, 7), (9, 1, 9), (None, 1, None), (None, 1, None), (None, 1, 9)]
    assert out == sorted(want, key=str)


def test_many_lists_and_one_dense(spark):
    """A third of all vectors in one dense group of several blocks; recall against brute force."""
    rng = np.random.default_rng(8)
    vectors = np.vstack([rng.normal(size=(800, 16)), rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.1])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = {r.id: (r.n_links, r.component_id) for r in V.near_vectors(df, block_rows=100).collect()}
    want = brute(list(range(len(vectors))), vectors)
    assert sum(n for n, _ in out.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(out[k][1] == want[k][1] for k in want) >= 0.98 * len(want)


def test_components(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (3, 2)], "a long, b long")
    out = {r.node: r.component for r in connected_components(edges).collect()}
    assert {out[k] for k in range(201)} == {0} and {out[1000 + k] for k in range(300)} == {1000} and len(out) == 501
    assert connected_components(edges.limit(0)).count() == 0
