import random
import zlib

import numpy as np
from numpy.polynomial.chebyshev import chebvander

from mediaops.llm.quality import CUT, FEATURES, PAIRS_PER_BAD, SEED, BradleyTerry, _coefficients, _lost, classify, features, fit, labelled_features

DOCS = "doc_id long, text string, score double, y int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n, rng):
    good = lambda: " ".join(rng.choice(["the river", "runs slowly.", "past old", "houses, and", "nobody sees it."]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW###", "x | y |", "$$$", "FREE!!"]) for _ in range(rng.randint(5, 60)))
    y = [int(rng.random() < 0.8) for _ in range(n)]
    return [(i, good() if q else bad(), None, 1) for i, q in enumerate(y)], [(i, q, 0) for i, q in enumerate(y)]


def test_held_out_accuracy(spark):
    docs, labels = corpus(600, random.Random(6))
    docs += [(1000, None, None, 1), (1001, "", None, 1), (1002, "z" * 200_000, None, 1), (None, "no id.", None, 1), (0, docs[0][1], None, 1)]
    got = classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0)], LABELS)).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", None, 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in classify(docs, none).collect()] == [(0.7, 1)]
    assert classify(spark.createDataFrame([], DOCS), none).count() == 0
    assert len(features(b"")) == len(FEATURES) and not features(b"")[0]


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(200, random.Random(7))
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    df = spark.createDataFrame(docs, DOCS)
    a, b = (sorted(classify(df, spark.createDataFrame(x, LABELS)).collect(), key=lambda r: r.doc_id) for x in (labels, flipped))
    assert a == b


def test_fit_and_threshold_against_a_second_implementation(spark):
    """The loss over the stated pairs, minimised by plain gradient descent; the threshold by sorting."""
    rng = np.random.default_rng(8)
    y = (rng.random(300) < 0.7).astype(int)
    x = rng.normal(size=(300, len(FEATURES))) * 2 + 1
    x[:, :3] += y[:, None] * np.array([1.5, -1.0, 0.5])
    x[:, 7] = 4.0  # a feature that never varies
    model = BradleyTerry(x, y)
    z = np.array([[(v - c) / (s if s > 1e-9 else 1.0) for v, c, s in zip(row, x.mean(axis=0), x.std(axis=0), strict=True)] for row in x])
    good, bad = z[y == 1], z[y == 0]
    partners = np.random.default_rng(SEED).integers(len(good), size=len(bad) * PAIRS_PER_BAD)
    d = np.array([good[p] - bad[i // PAIRS_PER_BAD] for i, p in enumerate(partners)])
    w = np.zeros(len(FEATURES))
    for _ in range(20_000):
        w -= 0.5 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 1e-3 * w)
    assert np.abs(model.w - w).max() < 1e-4 and model.w[0] > 0 > model.w[1]

    docs, labels = corpus(400, random.Random(9))
    fitted = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    known = [(docs[i][1], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    score = fitted.score(np.array([features(t.encode()) for t, _ in known]))
    share_bad = sum(q == 0 for _, q in known) / len(known)
    assert abs((score < CUT).mean() - share_bad) <= 2 / len(known)  # the quantile leaves out the labelled share


def test_very_long_texts(spark):
    docs, labels = corpus(200, random.Random(10))
    docs += [(900, docs[[q for _, q, _ in labels].index(1)][1] * 20_000, None, 1), (901, "BUY!! NOW### $$$ " * 200_000, None, 1)]
    got = {r.doc_id: r.predicted for r in classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[901] == 0 and 900 in got


def test_every_labelled_row_and_every_pair_is_learned_from(spark):
    """The model is the minimum of the loss over all pairs, and copies of a row beyond the first 6000 still count."""
    docs, labels = corpus(300, random.Random(11))
    docs += [(i, f"The {i} houses. " * (i % 7 + 1) + "x | y " * (i % 3), None, 1) for i in range(300, 380)]
    labels += [(i, i % 2, 0) for i in range(300, 380)]
    fitted = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    known = [(features(docs[i][1].encode()), q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    z, y = fitted.standard(np.array([x for x, _ in known])), np.array([q for _, q in known])
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, len(FEATURES))
    slope = -(d / (1 + np.exp(d @ fitted.w))[:, None]).mean(axis=0) + 1e-3 * fitted.w
    assert np.abs(slope).max() < 1e-5
    assert (fitted.strength(np.array([x for x, _ in known])) < fitted.threshold).sum() <= (y == 0).sum()

    many = [(i, "good words. " if i % 8 else "BAD!! | ", None, 1) for i in range(10_000)]
    more = [(i, "other words, " * 3, None, 1) for i in range(10_000, 20_000)]
    marks = [(i, int(i % 8 > 0), 0) for i in range(10_000)] + [(i, 1, 0) for i in range(10_000, 20_000)]
    rows = labelled_features(spark.createDataFrame(many + more, DOCS), spark.createDataFrame(marks, LABELS))
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20_000))


def test_coefficients_of_a_pair_function():
    reach, degree = 40.0, 336
    c = _coefficients(_lost, reach, degree)
    a, b = np.random.default_rng(3).uniform(-reach, reach, (2, 200))
    got = np.einsum("ni,ij,nj->n", chebvander(a / reach, degree), c, chebvander(b / reach, degree), optimize=["einsum_path", (0, 1), (0, 1)])
    assert np.abs(got - _lost(a - b)).max() < 1e-9
