"""Nearest vectors against every pair measured."""

import numpy as np
import pytest

from tabwarden.operators import neighbours


def brute(queries, vectors, k):
    out = {}
    for i, q in queries:
        d = sorted((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), j) for j, v in vectors)
        out[i] = d[:k]
    return out


def tables(kind):
    rng = np.random.default_rng(1)
    if kind == "clustered":
        v = np.repeat(rng.standard_normal((12, 6)) * 20, 40, axis=0) + rng.standard_normal((480, 6)) * 0.1
    elif kind == "even":
        v = rng.standard_normal((300, 16))
    elif kind == "copies":
        v = np.vstack([np.tile(rng.standard_normal(4), (200, 1)), rng.standard_normal((50, 4))])
    else:
        v = rng.standard_normal((3, 4))
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("block", [7, 20_000])
@pytest.mark.parametrize("kind", ["clustered", "even", "copies", "few"])
def test_nearest_are_the_nearest(spark, monkeypatch, kind, block):
    if block == 7 and kind in ("even", "few"):
        pytest.skip("one size is enough")
    monkeypatch.setattr(neighbours, "VECTORS", block * 10)
    monkeypatch.setattr(neighbours, "QUERIES", block)
    v = tables(kind)
    bad = [(1000, None), (1001, []), (1002, [1.0, float("nan"), *[0.0] * (len(v[0][1]) - 2)])]
    q = v[:: 17 if kind == "copies" else 5]
    vectors = spark.createDataFrame([*v, *bad], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([*q, *bad], "query_id long, q array<double>")
    got = {}
    for r in neighbours.nearest(queries, vectors, 5, cells=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    want = brute(q, v, 5)
    assert {i: [(j, pytest.approx(d, abs=1e-9)) for d, j in x] for i, x in want.items()} == {i: [(j, d) for _, d, j in sorted(x)] for i, x in got.items()}
    assert neighbours.nearest(queries.limit(0), vectors).count() == 0 and neighbours.nearest(queries, vectors.limit(0)).count() == 0


def test_cells_that_are_too_far_are_not_searched(spark):
    """Twelve clusters far from each other: a query visits no cell of another cluster."""
    v = tables("clustered")
    vectors, queries = spark.createDataFrame(v, "vec_id long, embedding array<double>"), spark.createDataFrame(v[::8], "query_id long, q array<double>")
    found, visits = neighbours.searched(queries, vectors, 5, cells=22)
    assert found.count() == 300 and visits.count() < 60 * 21 / 4
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
