import random

import numpy as np

from mediaops.llm.ann import SEED, Lists, nearest, scan, scan_many

VECTORS = "vec_id long, embedding array<float>, label int, score int, list string"


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def brute(rows, k, queries):
    good = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, qv in good:
        if queries(q):
            scored = sorted((-dot(qv, v), i) for i, v in good if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def make(rng, n, dim=16):
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(dim)], 0, 1, "clash") for i in range(n)]
    same = [0.5] * dim
    rows += [(n + i, same, 0, 1, "") for i in range(n // 2)]  # a third of all rows alike: ties
    rows += [(-1, None, 0, 1, ""), (-20, [0.0] * dim, 0, 1, ""), (-40, [float("nan")] * dim, 0, 1, ""), (-60, [None] + [1.0] * (dim - 1), 0, 1, ""), (-80, [], 0, 1, ""), (None, [1.0] * dim, 0, 1, ""), (-100, [float("inf")] * dim, 0, 1, "")]
    return rows


def test_recall_and_scores_against_brute_force(spark):
    rows = make(random.Random(8), 1000)
    df = spark.createDataFrame(rows, VECTORS)
    got = {tuple(r) for r in nearest(df, df.filter("vec_id % 20 = 0"), k=20, list_size=150).collect()}
    want = brute(rows, 20, lambda q: q % 20 == 0)
    assert len(got) == len(want)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in brute(rows, 10**6, lambda q: q % 20 == 0)}
    assert all(s == exact[q, v] for q, _, v, s in got)


def test_few_candidates_and_empty_table(spark):
    rows = make(random.Random(9), 4)
    df = spark.createDataFrame(rows, VECTORS)
    assert {tuple(r) for r in nearest(df, df).collect()} == brute(rows, 20, lambda q: True)
    none = spark.createDataFrame([], VECTORS)
    assert nearest(none, none).count() == 0


def test_scan_abandons_but_keeps_the_best():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    missed = 0
    for q in rng.standard_normal((50, 64)).astype(np.float32):
        got = scan(q, [x[:, a : a + 16] for a in range(0, 64, 16)], 10)
        assert len(got) < 100
        missed += len(set(np.argsort(((x - q) ** 2).sum(axis=1))[:10]) - set(got))
    assert missed <= 5


def clustered(n, dim=32, centres=200, seed=5):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] + 0.35 * rng.standard_normal((n, dim))


def test_few_lists_are_enough_for_clustered_vectors(spark):
    """Under 30 % of the lists are probed, and lists of several parts and chunks meet part by part."""
    v = clustered(12_000)
    lists = Lists(v[:4000], 32, float((v * v).sum(axis=1).max()) ** 0.5, 80)
    assert len(lists.centroids) == 80 and lists.probes(v[:4000], 20, 0.97) <= 24
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = nearest(df, df.filter("vec_id % 20 = 0"), list_size=150, sample=4000, task_rows=40).collect()
    got = {(r.query_id, r.vec_id): r.score for r in found}
    hit = total = 0
    for q in range(0, len(v), 20):
        score = v @ v[q]
        score[q] = -np.inf
        best = np.argsort(-score)[:20]
        total += 20
        hit += sum((q, int(i)) in got for i in best)
    assert len(found) == total and hit >= 0.9 * total
    assert all(abs(s - v[q] @ v[i]) < 1e-9 for (q, i), s in got.items())


def test_shorter_vectors_count_as_zero_in_what_they_lack(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (2, [0.5]), (3, [0.0, 0.0, 1.0]), (4, [-1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in nearest(df, df.filter("vec_id = 0 or vec_id = 2"), k=2).collect()}
    assert got == {(0, 1, 4, 4.0), (0, 2, 1, 3.0), (2, 1, 0, 0.5), (2, 2, 1, 0.5)}


def test_vectors_without_structure_need_most_lists():
    v = np.random.default_rng(SEED).standard_normal((4000, 64))
    lists = Lists(v, 64, float((v * v).sum(axis=1).max()) ** 0.5, 20)
    assert lists.probes(v, 20, 0.97) >= 12


def test_many_queries_are_scanned_at_once():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)).astype(np.float32), rng.standard_normal((100, 64)).astype(np.float32)
    x[:300] = x[0]  # copies: all of them may be among the nearest
    q[0] = x[0]
    blocks = [x[:, a : a + 16] for a in range(0, 64, 16)]
    at, rows = scan_many(q, blocks, 10, np.full(100, np.inf))
    assert set(rows[at == 0]) >= set(range(300))
    best = np.argsort(((q[1:, None, :] - x[None, :, :]) ** 2).sum(axis=2), axis=1)[:, :10]
    found = set(zip(at.tolist(), rows.tolist(), strict=True))
    assert sum((i + 1, int(r)) not in found for i, b in enumerate(best) for r in b) <= 10
