"""Clustering by a VA-file against plain Lloyd rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tribune.llm import va_means

SCHEMA = "vec_id long, embedding array<double>, row string, cells int"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (dist(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, own) if o == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, nearest(v), v) for i, v in kept]
    away = [dist(v, centroids[c]) for _, c, v in found]
    narrow = lambda ds: sum(ds) if all(d < 2**63 for d in ds) and sum(ds) < 2**63 else None
    of = [narrow([d for d, (_, c, _) in zip(away, found) if c == k]) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), c, d if d < 2**63 else None, of[c], narrow(away), sha[c]) for (i, c, _), d in zip(found, away))


def run(spark, rows, k=3, rounds=4, dims=4):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = va_means.cluster(df, k, rounds, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((repr(r.vec_id), *r[1:]) for r in got.collect())


def made(n, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, 4))
    return [(i, (base[i % 5] + rng.normal(size=4) * spread).tolist()) for i in range(n)]


def test_against_plain(spark):
    rows = made(300) + [(7, made(300)[7][1]), (7, [0.5, -0.5, 0.25, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, -0.4])]
    bad = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan"), 1.0, 1.0, 1.0]), (905, [float("-inf"), 1.0, 1.0, 1.0])]
    got = run(spark, rows + bad)
    assert got == plain(rows + bad, 3, 4, 4) and len(got) == len(rows)


def test_ties_and_repeats(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(40)]  # two different vectors, three centroids: one ends up empty
    assert run(spark, rows) == plain(rows, 3, 4, 4)


def test_large_components(spark):
    rows = made(60) + [(100 + i, [3e38, -3e38, float(i), 1e20]) for i in range(3)] + [(200, [1e9, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == plain(rows, 3, 4, 4)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = made(n)
    assert run(spark, rows) == plain(rows, 3, 4, 4)


def test_intervals():
    rng = np.random.default_rng(3)
    x = rng.integers(-600, 600, size=(400, 6))
    x[0] = 5000  # an outlier lies in an outer cell
    edges = va_means.edges_of(x[1:], x.min(axis=0), x.max(axis=0))
    cells = np.stack([np.searchsorted(edges[d], x[:, d], side="right") - 1 for d in range(6)], axis=1)
    centroids = rng.integers(-600, 600, size=(4, 6))
    least, most = va_means.bounds(centroids, edges)
    d = va_means.distances(x, centroids)
    low = np.stack([t[np.arange(6), cells].sum(axis=1) for t in least], axis=1)
    high = np.stack([t[np.arange(6), cells].sum(axis=1) for t in most], axis=1)
    assert (low <= d).all() and (d <= high).all() and cells.max() < va_means.CELLS
    own = va_means.decide(cells, least, most)
    assert (own[own >= 0] == d.argmin(axis=1)[own >= 0]).all() and (own >= 0).mean() > 0.5


def test_rounds_do_not_shuffle_vectors(spark, monkeypatch):
    plans = []
    real = va_means.cut_bucketed

    def watched(df, what, key, buckets, dealt=False):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, what, key, buckets, dealt)

    monkeypatch.setattr(va_means, "cut_bucketed", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(spark, made(100), rounds=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [w for w, _ in plans] == ["file", "marks", "exact", "marks", "exact"]
    assert all("Exchange" not in p for w, p in plans if w != "file")
