import math
import random
import re

import numpy as np
import xxhash

from mediaops.llm.components import components
from mediaops.llm.simhash import _masks, fingerprint, near_links, simhash_groups

DOCS = "doc_id long, text string, fp string, key string"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hs) * 2 > len(hs))


def brute_groups(prints):
    """Union of all pairs within 4 bits."""
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in prints:
        for y in prints:
            if (x ^ y).bit_count() <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in prints}


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"W{i}é" for i in range(50)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 300))) for _ in range(40)]
    texts = [None, "", " \t\n", "one", "one two three", "A b\x0bC D", "a B c d", "x" * 200_000]
    for b in base:
        w = b.split()
        texts.append(b)
        for _ in range(4):
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
            texts.append(("\n" if rng.random() < 0.5 else " ").join(w))
    texts += texts[10:14]
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    group = brute_groups(sorted(set(prints.values())))
    first = {}
    for i in sorted(prints):
        first.setdefault(group[prints[i]], i)
    for i, p in prints.items():
        assert got[i].fingerprint == f"{p:016x}"
        assert got[i].component_id == first[group[p]]
    assert len({r.component_id for r in got.values()}) < len(got) - 20


def test_crowded_keys_take_the_midpoint_path(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(30)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_groups(sorted(prints))
    for most in (20_000, 3):
        root = {x: x for x in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in near_links(df, most=most).collect():
            a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
            assert ((r.a % (1 << 64)) ^ (r.b % (1 << 64))).bit_count() <= 4 or most == 20_000
            root[max(a, b)] = min(a, b)
        assert {x: find(x) for x in prints} == want


def test_empty_table_and_null_id(spark):
    assert simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = simhash_groups(spark.createDataFrame([(None, "a b", None, None), (7, "q r s", None, None)], DOCS)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (7, 7)}
    assert fingerprint(b"") == 0


def test_keys_of_several_blocks_lose_no_pair():
    """Whatever the number of blocks in a key, fingerprints within four bits share a key."""
    rng = random.Random(31)
    for j in range(1, 6):
        masks = [m & (1 << 64) - 1 for m in _masks(j, 4)]
        assert len(set(masks)) == len(masks) == math.comb(4 + j, j)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_links_with_keys_of_two_blocks(spark):
    """Enough fingerprints for keys of two blocks, against all pairs."""
    rng = np.random.default_rng(32)
    base = rng.integers(0, 1 << 63, 2500, np.int64)
    near = base[:300] ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300))
    prints = np.unique(np.r_[base, near, near[:50] ^ np.int64(7)])
    df = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    linked = {r.node: r.component for r in components(near_links(df)).collect()}
    root = {int(x): int(x) for x in prints}
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    for i, k in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        a, b = (int(prints[x]) for x in (i, k))
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    assert all(linked.get(int(x), int(x)) == find(int(x)) for x in prints)
