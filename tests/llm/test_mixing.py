import random
from fractions import Fraction

from mediaops.llm.mixing import apportion, mix

DOCS = "doc_id long, text string, source string, size string, pos int"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        w = sum(weight[s] for s in left)
        share = {s: (goal - sum(full.values())) * weight[s] / w for s in left} if w else {}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (full | share).items()}
        full |= {s: Fraction(2 * sizes[s]) for s in over}


def test_targets_quotas_and_bounds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), f"s{min(rng.randint(0, 9), 6)}", "clash", None) for i in range(900)]
    rows += [(2000 + i, "word " * 3000, "hot", "", 1) for i in range(60)]
    rows += [(3000, None, "s1", "", 1), (3001, "", None, "", 1), (3002, "a b\tc\x0bd", None, "", 1), (None, "null id", "s2", "", 1), (7, "twice", "s2", "", 1), (7, "twice", "s2", "", 1), (3003, "", "empty", "", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df, shard_words=20_000).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 * (1 + sizes[s] // 20_000), s
    again = mix(df.repartition(7), shard_words=20_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_highest_quotients(spark):
    rng = random.Random(5)
    votes = [(g, i, rng.choice([0, 1, 5, 100, 10_000])) for g in range(6) for i in range(rng.randint(1, 30))]
    seats = {g: rng.randint(0, 500) for g in range(6)}
    df = spark.createDataFrame([(*v, seats[v[0]]) for v in votes], "g int, i int, v long, m long")
    got = {(r.g, r.i): r.quota for r in apportion(df, ["g"], "v", "m", ["i"]).collect()}
    for g in range(6):
        mine = [(i, v) for h, i, v in votes if h == g]
        best = sorted((-Fraction(v, 2 * k + 1), i, k) for i, v in mine if v for k in range(seats[g] + 1))[: seats[g]]
        for i, _ in mine:
            assert got[g, i] == sum(b[1] == i for b in best)


def test_very_long_text_and_a_hot_source(spark):
    rows = [(1, "word " * 1_500_000, "hot", "", 1), (2, "one long run" + "x" * 3_000_000, "hot", "", 1), *((10 + i, "a few words", "s", "", 1) for i in range(300))]
    got = {r.doc_id: r for r in mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].size == 1_500_000 and got[2].size == 3 and len(got) == 302
    assert all(r.taken <= 2 * r.size for r in got.values())
    hot = [r for r in got.values() if r.source == "hot"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 64 + 3


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
