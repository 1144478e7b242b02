"""Exponion rounds equal plain Lloyd rounds, ties included, and compute fewer distances."""

import hashlib

import numpy as np
import pytest

from fathom.llm import centroids

NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd(v, start, rounds):
    c = start.copy()
    for i in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if i < rounds:
            for j in np.unique(a):
                c[j] = [int(s) // int((a == j).sum()) for s in v[a == j].sum(axis=0)]
    return a, d[np.arange(len(v)), a], c


@pytest.mark.parametrize("seed, spread, k", [(1, 3, 8), (2, 50, 8), (3, 2000, 37), (4, 1, 5), (5, 10**7, 6)])
def test_rounds_equal_lloyd(seed, spread, k):
    """A spread of 1 makes many ties and equal centroids; one of 10**7 is beyond what doubles tell exactly."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-spread, spread + 1, (700, 6)) + rng.integers(0, 4, (700, 1)) * spread * 2
    c, before = v[rng.choice(len(v), k)].copy(), None
    a, u, l = np.full(len(v), -1), np.zeros(len(v)), np.zeros(len(v))
    want, work = c.copy(), 0
    for _ in range(9):
        search = centroids.Search(c, before)
        a, u, l = search.assign(v, a, u, l)
        d = ((v[:, None, :] - want[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        far = np.sqrt(d.astype(float))
        others = far.copy()
        others[np.arange(len(v)), a] = np.inf
        assert (u >= far[np.arange(len(v)), a]).all() and (l <= others.min(axis=1)).all()
        work += search.computed
        before, c = c, c.copy()
        for j in np.unique(a):
            c[j] = v[a == j].sum(axis=0) // (a == j).sum()
        want = c
    if k == 37:
        assert work < 0.5 * 9 * len(v) * k


def rows(n, seed=3, dims=64):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, 0.12, dims).astype(np.float32)]) for i in range(n)]


def expected(data, k=8, rounds=10):
    v = np.array([np.floor(1024 * np.float64(np.float32(x))) for _, x in data]).astype(np.int64)
    order = sorted(range(len(data)), key=lambda i: (hashlib.sha256(f"3:{data[i][0]}".encode()).hexdigest(), v[i].tolist()))[:k]
    a, d, c = lloyd(v, v[order], rounds)
    digest = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c.tolist()]
    return sorted((i, int(a[r]), int(d[r]), int(d[a == a[r]].sum()), int(d.sum()), digest[a[r]]) for r, (i, _) in enumerate(data))


def test_equals_brute_force_with_odd_rows(spark):
    """Repeated rows count; null, short, long, NaN and infinite vectors do not; extra columns may have any name."""
    data = rows(300)
    data += data[:5] + [(1000, [0.1] * 64), (1001, [0.1] * 64)]
    odd = [(400, None), (401, [0.5] * 63), (402, [0.5] * 65), (403, [0.5] * 63 + [None]), (404, [float("nan")] + [0.5] * 63), (405, [float("-inf")] + [0.5] * 63), (406, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in data + odd], "vec_id long, embedding array<float>, cluster int, a string, u double").repartition(3)
    out = centroids.cluster(df)
    assert tuple(out.columns) == NAMES
    assert sorted(map(tuple, out.collect())) == expected(data)


def test_few_rows_none_and_no_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [0.5])], schema)).columns == list(NAMES)
    data = rows(3)
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(data, schema)).collect())) == expected(data)
    one = centroids.cluster(spark.createDataFrame([(None, [0.25] * 64), (None, [0.25] * 64)], schema)).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in one] == [(None, 0, 0)] * 2
    huge = centroids.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], schema)).collect()
    assert {r["distance"] for r in huge} == {0}
