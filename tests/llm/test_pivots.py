import hashlib

import numpy as np
import pytest

from mediaops.llm import pivots as P

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, k=16, rounds=3):
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.array([v for _, v in kept])
    order = sorted((n for n in range(len(kept)) if kept[n][0] is not None), key=lambda n: (hashlib.sha256(f"1:{kept[n][0]}".encode()).hexdigest(), kept[n][1].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)]
    near = d.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted((-1 if i is None else i, int(a[n]), int(near[n]), int(near[a == a[n]].sum()), int(near.sum()), sha[a[n]]) for n, (i, _) in enumerate(kept))


def result(spark, rows):
    out = P.cluster_vectors(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


@pytest.mark.parametrize("clustered", [False, True])
def test_against_brute_force(spark, clustered):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 64)) * 3
    v = centres[rng.integers(20, size=700)] + rng.normal(size=(700, 64)) * 0.1 if clustered else rng.normal(size=(700, 64))
    rows = [(i * 7, x.tolist()) for i, x in enumerate(v)]
    assert result(spark, rows) == brute(rows)


def test_nulls_ties_repeated_rows_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    base = [rng.integers(-2, 3, size=64).astype(float).tolist() for _ in range(12)]
    bad = [None, [], [0.1] * 63, [0.1] * 65, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63]
    rows = [(i, base[i % 12]) for i in range(60)] + [(5, base[1]), (5, base[1]), (None, base[2]), (None, [0.0] * 64)] + [(900 + i, v) for i, v in enumerate(bad)]
    assert result(spark, rows) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="components must be under"):
        result(spark, [(1, [1e30] + [0.0] * 63)])


def test_pivots_spare_exact_distances_of_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, size=(16, 64))
    x = centres[rng.integers(16, size=5000)] + rng.integers(-9, 10, size=(5000, 64))
    pivots = x[[int(np.flatnonzero((np.abs(x - c) < 10).all(axis=1))[0]) for c in centres]]
    c = centres + 3
    cluster, best, exact = P.nearest(x, P._roots(x, pivots), c, P._roots(c, pivots))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert exact < 0.15 * d.size


def test_negative_sums_floor_down(spark):
    # two vectors of one cluster: -1 and -2 average to floor(-1.5) = -2
    rows = [(i, [-1 / 64 if i % 2 else -2 / 64] * 64) for i in range(40)]
    assert result(spark, rows) == brute(rows)
