import random

from pyspark.sql import functions as F

import corpus_pipeline
from mediaops.llm import minhash
from mediaops.llm.minhash import jaccard_groups, jaccard_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(s, t):
    return len(s & t) / len(s | t) >= 0.8


def brute_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def make():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(t))
        for share in (0.005, 0.01, 0.02, 0.03):  # each changed word takes five shingles with it
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in t))
    base = [rng.choice(words) for _ in range(100)]
    for i in range(150):  # one large group
        texts.append(" ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]]))
    texts += ["a b c d", "A  b c d", "a b c e", "one two three four five", "one two three four six", "", None, "é b c d e f"]
    return texts


def test_near_stage_takes_five_words_and_similarity_of_four_fifths(spark, tmp_path):
    texts = make()
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = {i for i, c in enumerate(brute_components([brute_set(t) for t in texts])) if i == c}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == want


def test_links_are_all_near(spark):
    texts = make()
    sets = [brute_set(t) for t in texts]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row string, text string")
    links = {(int(r.a), int(r.b)) for r in jaccard_links(rows).collect()}
    assert all(similar(sets[a], sets[b]) for a, b in links)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in root] == brute_components(sets)


def test_chains_around_a_large_group(spark):
    """Links between texts that are not near their bucket's smallest node, in buckets of over a block."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for chain in range(12):  # each step is near the last one, and far from those before
        t = list(base)
        for step in range(6):
            at = (chain * 11 + step * 17) % 110
            t[at : at + 3] = [f"c{chain}", f"s{step}", f"{chain}.{step}"]
            texts.append(" ".join(t))
    sets = [brute_set(t) for t in texts]
    want = brute_components(sets)
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row string, text string")
    for nodes, held in ((3, 1 << 21), (512, 300)):  # a bound by number, and by shingles
        minhash.BLOCK, minhash.BLOCK_SHINGLES = nodes, held
        group = {r.row: bytes(r.group) for r in jaccard_groups(rows).collect()}
        minhash.BLOCK, minhash.BLOCK_SHINGLES = 512, 1 << 21
        assert len(group) == len(texts) and all((group[str(i)] == group[str(j)]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
    assert len(group) == len(texts) and all((group[str(i)] == group[str(j)]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_simhash_alone_links_near_copies(spark):
    """Without MinHash keys, texts whose fingerprints are close are still linked, and only after the sets are compared."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["river", "slowly", "past", "old", "houses", "stone", "light"]) + str(rng.randint(0, 99)) for _ in range(600)) for _ in range(12)]
    texts += [t + " bridge" for t in texts[:8]]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row string, text string")
    nodes = minhash._nodes(minhash.cut(minhash.sketches(rows)))
    names = {bytes(r.id): int(r.row) for r in nodes.select("id", "row").collect()}
    links = minhash._links(rows, nodes.withColumn("keys", F.array().cast("array<long>"))).collect()
    found = {tuple(sorted((names[bytes(r.a)], names[bytes(r.b)]))) for r in links}
    assert len(found) >= 6 and found <= {(i, 12 + i) for i in range(8)}
