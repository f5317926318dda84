import math
import random
import re
from collections import Counter

import pytest

from mediaops.llm.lm_scoring import cross_entropy_difference

DOCS = "doc_id long, text string, score double, is_target boolean, part int"


def brute(rows, ids):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""), i in ids) for i, t, *_ in rows]
    vocabulary = len({w for _, words, _ in docs for w in words}) + 1
    out = []
    for k, (i, words, _) in enumerate(docs):
        means = []
        for target in (True, False):
            c1, c2 = Counter(), Counter()
            for j, (_, other, mine) in enumerate(docs):
                if j != k and other and (mine or not target):
                    w = [*other, None]
                    c1.update(w)
                    c2.update(zip([None, *other], w, strict=True))
            n = c1.total()
            losses = [-math.log((c2[v, w] + 4 * (c1[w] + 1) / (n + vocabulary)) / (c1[v] + 4)) for v, w in zip([None, *words], [*words, None], strict=True)] if words else []
            means.append(sum(losses) / max(len(losses), 1))
        out.append((i, len(words) + bool(words), *means, means[0] - means[1]))
    return out


@pytest.mark.parametrize("part_bytes", [8 << 20, 500])
def test_against_brute_force(spark, part_bytes):
    rng = random.Random(15)
    words = ["a", "bb", "é", "the", "The", "c\xa0c", "x."]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choices(words if i % 3 else words[:3], k=rng.randint(0, 30))) for i in range(60)] + [None, "", " \n ", "\0 \0", "q" * 100_000, "one " * 3000]
    rows = [(i, t, 1.0, True, 7) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, texts[3], None, None, None), (3, "other text of 3", None, None, None)]
    rows += [(9, f"row {k} of one identifier " * 20, None, None, None) for k in range(30)] + [(None, f"row {k} of none " * 20, None, None, None) for k in range(10)]
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(3,), (None,), (999,)], "doc_id long")
    got = cross_entropy_difference(spark.createDataFrame(rows, DOCS), ids, part_bytes=part_bytes).collect()
    want = brute(rows, set(range(0, 60, 3)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    near = {r.doc_id: r.score for r in got}
    assert near[60] == near[61] == near[62] == 0.0
    assert sum(near[i] for i in range(0, 60, 3)) < sum(near[i] for i in range(1, 60, 3))


def test_no_target_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert cross_entropy_difference(spark.createDataFrame([], DOCS), none).count() == 0
    r = cross_entropy_difference(spark.createDataFrame([(1, "aa", None, None, None), (2, "b c", None, None, None)], DOCS), none).first()
    assert r.target_loss == pytest.approx(math.log(4))


def test_counts_grow_with_the_corpus(spark):
    """A text that occurs twice reads more like the background than one that occurs once, however common its letters."""
    rng = random.Random(18)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(50)) for _ in range(40)]
    rows = [(i, t, None, None, None) for i, t in enumerate([*texts, *texts[:5]])]
    got = {r.doc_id: r.background_loss for r in cross_entropy_difference(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7,)], "doc_id long")).collect()}
    assert max(got[i] for i in (*range(5), *range(40, 45))) + 1 < min(got[i] for i in range(5, 40))
