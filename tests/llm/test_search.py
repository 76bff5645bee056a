import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsift.llm.covertree import CoverTree, nearest, search

SCHEMA = "vec_id long, embedding array<double>, label int, score double"


def brute(rows, k):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in valid if i % 50 == 0}):
        own = min(v for i, v in valid if i == q)
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=True)))), i) for i, v in valid if i != q and len(v) == len(own)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def answers(spark, rows, **options):
    docs = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in nearest(docs, F.col("vec_id") % 50 == 0, **options).collect())


def vectors(kind, n=400, width=8):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = rng.normal(size=(12, width))[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.03
    elif kind == "copies":
        x = np.where(rng.random((n, 1)) < 0.4, 0.25, rng.normal(size=(n, width)).round(1))
    else:
        x = rng.normal(size=(n, width))
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_equal_to_brute_force(spark, kind):
    rows = vectors(kind)
    assert answers(spark, rows, block_rows=64, group_queries=4, sample=100, most_pivots=16) == brute(rows, 5)


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(None, [1.0] * 4), (200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 1.0, 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(400, [0.5, 0.5]), (401, [0.25, 0.5]), (450, [0.1, 0.2, 0.3]), (500, []), (501, []), (7, rows[7][1]), (50, rows[50][1])]
    assert answers(spark, rows) == brute(rows, 5)
    assert answers(spark, []) == []


def test_huge_components_stay_exact(spark):
    rows = [(0, [3.0e7, 1.0]), (1, [2.9e7, 1.0]), (2, [2.9e7, 1.01]), (3, [-1.0e9, 5.0]), (50, [1.0e30, 1.0])]
    want = brute([(i, [min(max(256 * x, -(2**63)), 2**63 - 1) / 256 for x in v]) for i, v in rows[:4]], 5)
    assert answers(spark, rows[:4]) == want
    assert len(answers(spark, rows)) == 8


def test_covering_radii_cover():
    x = np.random.default_rng(5).normal(size=(700, 6)) * 100
    tree = CoverTree(np.arange(700), x.astype(np.int64))
    for node in range(len(tree.radius)):
        own = tree.x[tree.low[node] : tree.high[node]]
        assert np.sqrt(((own - tree.centre[node]) ** 2).sum(1)).max() <= tree.radius[node]
    assert sorted(tree.ids.tolist()) == list(range(700))


def test_pruning_skips_far_nodes():
    """Clustered data: most leaves are never scored."""
    from lexsift.llm import covertree

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 300
    data = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))).astype(np.int64)
    queries = (centres[:3].repeat(20, 0) + rng.normal(size=(60, 16))).astype(np.int64)
    scored = 0
    plain = covertree._scores

    def counted(a, b, exact):
        nonlocal scored
        scored += len(a) * len(b)
        return plain(a, b, exact)

    covertree._scores = counted
    try:
        q, d = CoverTree(np.arange(10**6, 10**6 + 60), queries, covertree.QUERY_LEAF), CoverTree(np.arange(6000), data)
        best = search(q, d, 5, np.full(60, -np.inf), True)
    finally:
        covertree._scores = plain
    want = -np.sort(-(queries @ data.T), axis=1)[:, :5]
    assert (best.score[np.argsort(q.ids)] == want).all() and scored < 0.5 * 60 * 6000
