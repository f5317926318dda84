import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from mediaops.llm import resampling as R

SCHEMA = "doc_id long, text string, lang string, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return crc32(f.encode()) % 10000


def brute(docs, target):
    s, t = (Counter(bucket(f) for x in texts for f in grams(x)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for i, x in docs:
        w, f = grams(x)
        weight = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((-1 if i is None else i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0], r[1], r[2]))
    quota = 5 * len(able) // 100
    ranked = [(*r[:4], n if n <= quota else None) for n, r in enumerate(able, 1)]
    return sorted([*ranked, *((*r[:4], None) for r in rows if r[4] < 20)], key=str)


def result(spark, docs, target):
    out = R.resample(spark.createDataFrame([(i, x, "en", "r") for i, x in docs], SCHEMA), spark.createDataFrame([(x,) for x in target], "text string"))
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "Bc", "naïve", "ÉTÉ", "東京", "x1", "don't", "9", "q" * 70, "w" * 300, *(f"w{i}" for i in range(300))]
    return [rng.choice([" ", "\n", ", ", "\x00", "--"]).join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(n)]


def test_against_brute_force(spark):
    docs = [(i, x) for i, x in enumerate(texts(900))] + [(5, None), (None, "one two " * 20), (7, ""), (8, "..!"), (9, "word")]
    docs += [(70, "same text here " * 9)] * 40
    target = [*texts(30, 2), None, ""]
    assert result(spark, docs, target) == brute(docs, target)


def test_empty_tables(spark):
    assert result(spark, [], ["a b"]) == []
    docs = [(i, x) for i, x in enumerate(texts(60))]
    assert result(spark, docs, []) == brute(docs, [])


def test_fewer_documents_than_a_draw(spark):
    docs = [(i, "some words " * 10) for i in range(19)]
    assert {r[4] for r in result(spark, docs, ["a"])} == {None}


@pytest.mark.parametrize("size", [0, 3, 50, 16384])
@pytest.mark.parametrize("piece", [1, 40, 500, 1 << 22])
def test_features_whatever_the_dictionary_and_the_pieces(size, piece):
    some = texts(40, 3) + ["", "x", "y z", "u" * 5000 + " v " + "t" * 200]
    got = Counter((n, d, b) for n, doc, bucket_ in R.features([x.encode() for x in some], R.Scanner(size), piece_bytes=piece) for d, b in zip(doc.tolist(), bucket_.tolist(), strict=True))
    assert got == Counter((len(g.split(" ")), d, bucket(g)) for d, x in enumerate(some) for g in grams(x)[1])


def test_crc_of_joined_parts():
    rng = random.Random(4)
    a, b = ([rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 66, 1000, 70_000])) for _ in range(200)] for _ in range(2))
    joined = R.advanced(np.array([crc32(x) for x in a], np.uint32), np.array([len(x) for x in b])) ^ np.array([crc32(x) for x in b], np.uint32)
    assert joined.tolist() == [crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_a_dictionary_is_made_anew_for_other_words():
    scanner = R.Scanner(100)
    first, second = (" " + " ".join(f"{c}{i % 60}" for i in range(400_000)) + " " for c in "ab")
    for text in (first, first, second, second):
        starts, crc, length = scanner.words(text.encode())
        w = text.split()
        assert crc[:60].tolist() == [crc32(x.encode()) for x in w[:60]] and len(starts) == len(w) and length.sum() == sum(map(len, w))
    assert scanner.missed == 0.0


def test_very_long_text(spark):
    docs = [(1, "long words repeat " * 400_000), (2, "z" * 6_000_000), *((i, "other words " * 12) for i in range(3, 43))]
    assert result(spark, docs, ["words repeat"]) == brute(docs, ["words repeat"])
