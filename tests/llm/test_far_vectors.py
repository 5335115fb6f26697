"""The exact search with vectors far out and with very large components."""

import numpy as np
import pytest

from ticketlens.llm import topk


@pytest.mark.parametrize("dim", [2, 8, 64])
@pytest.mark.parametrize("factor", [1e6, 1e7, 1e9])
def test_limits_hold_with_outliers(dim, factor):
    """A vector scaled far out becomes a pivot; no limit may fall below the true product, and the best five are found."""
    r = np.random.default_rng(dim)
    x = np.floor(256 * r.normal(size=(300, dim)))
    x[7] = np.floor(x[7] * factor)
    ids = np.arange(300)
    pivots = topk.spread_out(x, 8)
    assert any((p == x[7]).all() for p in pivots)
    own, columns = (x * x).sum(axis=1), np.ascontiguousarray(topk.distances(x, pivots).T)
    for i in range(0, 300, 7):
        q = x[i]
        limit = topk.limits(q, float(q @ q), topk.distances(x[i : i + 1], pivots)[0], own, columns)
        exact = np.array([sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for v in x], object)
        assert all(float(limit[k]) >= exact[k] for k in range(300))
        scores, names = topk.eliminate(q, i, limit, x, ids, (np.zeros(0), np.zeros(0, np.int64)), 5)
        best = sorted((k for k in range(300) if k != i), key=lambda k: (-exact[k], k))[:5]
        assert names.tolist() == best and topk.as_long(scores).tolist() == [exact[k] for k in best]


def test_search_with_an_outlier(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 2))
    x[3] *= 1e7
    rows = topk.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, e array<double>"), "i", "e")
    got = {}
    for g in topk.search(topk.build(rows, pivots=4), rows.filter("id % 10 = 0"), query_block=7).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    ints = [[int(np.floor(256 * c)) for c in v] for v in x]
    for i in range(0, 200, 10):
        all_ = sorted(((-sum(a * b for a, b in zip(ints[i], v, strict=True)), k) for k, v in enumerate(ints) if k != i))[:5]
        assert sorted(got[i]) == [(n + 1, k, -s) for n, (s, k) in enumerate(all_)]


def test_scores_beyond_double_precision():
    """Products of more than 2^53 are whole, and what no long holds becomes its ends."""
    x = np.array([[2.0**31 + 1, 3.0], [2.0**31 - 1, 5.0]])
    assert topk.as_long(topk.products(x, np.array([2.0**31 + 5, 1.0]))).tolist() == [(2**31 + 1) * (2**31 + 5) + 3, (2**31 - 1) * (2**31 + 5) + 5]
    assert topk.as_long(np.array([1e30, -1e30, 4.0])).tolist() == [2**63 - 1, -(2**63), 4]
