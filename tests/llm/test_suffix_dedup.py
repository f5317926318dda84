import random

import numpy as np
import pytest

from mediaops.llm.suffix_dedup import deep_shallow_sort, minimizers, remove_repeats

DOCS = "doc_id long, text string, part int, kept string"


def brute(rows, length):
    first = {}
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (doc, *_) in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        spans, was = 0, 0
        for g in gone:
            spans += g and not was
            was = g
        out.append((doc, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("part_bytes", "hot", "fan_in"), [(12 << 20, 4096, 1024), (3000, 4096, 1024), (3000, 3, 1024), (3000, 3, 2), (3000, 0, 3)])
def test_against_brute_force(spark, part_bytes, hot, fan_in):
    rng = random.Random(12)
    words = ["the", "of", "räin", "house", "ing", "th", "x", "\n"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(40) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 15))]
        rows.append((i * 3 % 91, " ".join(parts), 1, "clash"))
    rows += [(200 + i, rows[5][1], 1, "") for i in range(12)]  # copies
    rows += [(300, None, 1, ""), (301, "", 1, ""), (302, "ab" * 400, 1, ""), (303, "ab" * 300, 1, ""), (304, "z" * 49, 1, ""), (305, "z" * 50, 1, ""), (306, "z" * 51, 1, ""), (None, passages[0], 1, ""), (5, rows[7][1], 1, ""), (5, rows[7][1], 1, "")]
    got = remove_repeats(spark.createDataFrame(rows, DOCS), part_bytes=part_bytes, hot=hot, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in got)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_sort_and_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (3000, 30)).astype(np.uint8)
    rows[1000:2000, :20] = 97
    rows[2000:2500] = rows[:500]
    order, lcp = deep_shallow_sort(rows)
    strings = [r.tobytes() for r in rows[order]]
    assert strings == sorted(r.tobytes() for r in rows)
    for a, b, n in zip(strings, strings[1:], lcp[1:], strict=False):
        assert a[:n] == b[:n] and (n == 30 or a[n] != b[n])


def test_each_string_belongs_to_one_minimizer():
    rng = random.Random(13)
    texts = [bytes(rng.choices(b"ab ", k=n)) for n in (0, 49, 50, 51, 400, 3000)] + [b"a" * 200]
    text, place, h, lo, hi = minimizers(texts, 50, 20)
    owned = [(t, p - b) for t, p, a, z in zip(text, place, lo, hi, strict=True) for b in range(a, z + 1)]
    assert sorted(owned) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)]


def test_texts_longer_than_a_slice_and_a_part(spark):
    rng = random.Random(21)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = noise(700)
    across = (1 << 20) - 300  # the passage lies over the edge of a slice
    long = noise(across) + passage + noise(400_000)
    rows = [(1, passage[100:], 1, ""), (2, long, 1, ""), (3, noise(5000) + long[700_000:720_000], 1, ""), (4, passage, 1, "")]
    for part_bytes in (12 << 20, 100_000):
        got = remove_repeats(spark.createDataFrame(rows, DOCS), part_bytes=part_bytes).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)


def test_sort_of_hard_orders():
    rng = np.random.default_rng(4)
    base = np.arange(5000, dtype=np.uint32)
    for numbers in (base, base[::-1], np.r_[base[::2], base[::-2]], np.zeros(3000, np.uint32), rng.integers(0, 3, 4000).astype(np.uint32)):
        rows = np.zeros((len(numbers), 20), np.uint8)
        rows[:, 10:14] = numbers.astype(">u4")[:, None].view(np.uint8)
        order, _ = deep_shallow_sort(rows)
        assert [r.tobytes() for r in rows[order]] == sorted(r.tobytes() for r in rows)
