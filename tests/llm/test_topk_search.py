"""Top-k search against brute force in Python integers."""

import math

import numpy as np
import pytest

from conftest import SF_MID, SF_SMALL
from quizlens.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    """(query id, rank, id, score), from (id, list)."""
    usable = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, v) in enumerate(usable):
        if i is not None and i % every == 0:
            scores = []
            for m, (j, w) in enumerate(usable):
                if m != n:
                    s = sum(a * b for a, b in zip(v, w))
                    scores.append((-min(max(s, -2 ** 63), 2 ** 63 - 1), j is None, j or 0, j))
            scores.sort(key=lambda x: x[:3])
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r.rank, r.id, r.score) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    for sf in (SF_SMALL, SF_MID):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        got = sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in ts.op11_topk_search(spark, sf).collect()), key=str)
        assert got == brute(rows)


@pytest.mark.parametrize("block, group, pivots", [(7, 3, 4), (1000, 1000, 1), (64, 16, 32)])
def test_blocks_and_cells(spark, block, group, pivots):
    r = np.random.default_rng(block)
    centres = r.normal(size=(6, 8)) * 2
    points = [centres[i % 6] + r.normal(size=8) * (0.05 if i % 3 else 1) for i in range(600)]
    points[100:300] = [points[100]] * 200       # a third of all rows is one vector
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(ts.top_k(df, "id % 50 = 0", block=block, query_block=group, pivots=pivots)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, []), (100, None), (150, [None, 1.0]), (200, [nan]), (250, [inf, 1.0]), (300, [3e38, -3e38]),
            (None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0]), (3, [0.001, -0.001, 9.0]), (4, [-1.0, 3e38])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as `a.b`", "3 as id", "4 as cell")
    assert found(ts.top_k(df, "id % 50 = 0")) == brute(rows)
    assert found(ts.top_k(df.where("vec_id in (50, 2)"), "id % 50 = 0")) == [(50, 1, 2, 0)]
    assert ts.top_k(df.where("vec_id = 50"), "id % 50 = 0").count() == 0
    assert ts.top_k(df.limit(0), "id % 50 = 0").count() == 0


def test_cover_tree():
    """Each point is one node, lies within its ancestors' radii, and siblings are apart."""
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(size=(200, 3)), np.zeros((5, 3))])
    t = ts.CoverTree(points)
    assert sorted(t.order) == list(range(205))
    for i in range(205):
        below = t.points[i:t.end[i]]
        assert np.isclose(np.sqrt(((below - t.points[i]) ** 2).sum(axis=1)).max(), t.radius[i])
        kids = t.children(np.array([i]))
        assert sum(t.end[k] - k for k in kids) == t.end[i] - i - 1
        for a in kids:
            assert t.radius[a] <= t.radius[i] / ts.BASE + 1e-9
            for b in kids:
                d = np.sqrt(((t.points[a] - t.points[b]) ** 2).sum())
                assert a == b or d > t.radius[i] / ts.BASE - 1e-9 or t.radius[i] == 0


def test_traversal_prunes():
    """In clustered data most pairs are excluded by bounds, not tried."""
    r = np.random.default_rng(4)
    data = np.concatenate([c + r.normal(size=(100, 4)) * 0.01 for c in r.normal(size=(30, 4)) * 10])
    q, d = ts.CoverTree(data[::50]), ts.CoverTree(data)
    best, tried = ts.Best(60, 5, np.full(60, -np.inf)), []

    def add(i, nodes, scores):
        tried.append(len(nodes))
        best.add(i, scores.tolist(), nodes.tolist(), nodes.tolist())

    ts.dual_tree(q, d, best, add)
    assert all(len(f) == 5 for f in best.found) and sum(tried) < 0.25 * 60 * len(data)
    want = -np.sort(-(q.points @ data.T), axis=1)[:, :5]
    assert np.allclose([[x[1] for x in f] for f in best.found], want)
