from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.topk_search import BallTree, integers, search, top_k


def made(n=700, dim=6, seed=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [round(c + rng.gauss(0, 0.2), 1) for c in rng.choice(centres)], i % 3) for i in range(n)]
    rows += [(n, None, 0), (n + 50, [float("nan")] * dim, 0), (n + 1, [None] + [1.0] * (dim - 1), 0), (n + 2, [float("inf")] * dim, 0), (None, [1.0] * dim, 0)]
    rows += [(3, rows[3][1], 9), (n + 3, [1.0, 2.0], 1), (n + 100, [3.0, 4.0], 1)]
    return rows


def brute(rows, every, k=5):
    ok = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in ok.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in ok.items() if c != q and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "query_rows", "sample"), [(65_536, 16_384, 2048), (40, 5, 30), (100, 7, 0)])
def test_against_brute_force(spark, shard_rows, query_rows, sample):
    rows = made()
    v = integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4))
    float_rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], z) for i, e, z in rows]
    got = top_k(v, v.where(F.col("vec_id") % 50 == 0), 5, shard_rows, query_rows, sample, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute(float_rows, 50)


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(500, 8)), rng.normal(size=(20, 8))
    tree = BallTree(p, 16)
    for (a, b), c, r in zip(tree.ranges, tree.centre, tree.radius, strict=True):
        assert ((q @ p[tree.order[a:b]].T).max(axis=1) <= q @ c + np.linalg.norm(q, axis=1) * r + 1e-9).all()
    assert sorted(tree.order.tolist()) == list(range(500))


def test_large_numbers_and_few_candidates():
    ids, v = np.array([5, 2, 9]), np.array([[2**30, 1], [2**30, 1], [-(2**30), 7]])
    who, best = search(ids, v, np.array([2]), np.array([[2**30, 3]]), np.array([-np.inf]), 5)
    assert who.tolist() == [[5, 9, -1, -1, -1]] and best[0, :2].tolist() == [2**60 + 3, -(2**60) + 21]


def test_empty_table(spark):
    v = integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_k(v, v).collect() == []


def test_huge_components(spark):
    """Components and scores beyond a long count as its ends; ties go to the smaller id as ever."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e18, -1e18, 3e38, -3e38, 1e10, 0.5, 0.0]) for _ in range(4)]) for i in range(120)]
    v = integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, top_k(v, v.where(F.col("vec_id") % 10 == 0), 5, 40, 8, 20, leaf=8).collect()))
    low, high = -(1 << 63), (1 << 63) - 1
    ok = {i: [max(low, min(high, math.floor(256 * x))) for x in e] for i, e in rows}
    want = []
    for q, a in ok.items():
        if q % 10 == 0:
            scores = sorted((-max(-high, min(high, sum(x * y for x, y in zip(a, b, strict=True)))), c) for c, b in ok.items() if c != q)
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:5])]
    assert got == sorted(want)
