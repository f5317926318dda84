import random

from pyspark.sql import functions as F

from mediaops.operators import dedup as D

SCHEMA = "id long, lang string, h string, distance string"


def table(spark, hashes, tenants=("t",)):
    return spark.createDataFrame([(i, tenants[i % len(tenants)], h, "x") for i, h in enumerate(hashes)], SCHEMA)


def near(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count() <= 8


def crowd(rng, n):
    """Hashes of one prefix, some of them a few bits from others."""
    out = {f"abcd{rng.getrandbits(48):012x}" for _ in range(n)}
    for h in rng.sample(sorted(out), n // 5):
        x = int(h, 16)
        for bit in rng.sample(range(48), rng.randrange(1, 12)):
            x ^= 1 << bit
        out.add(f"{x:016x}")
    return sorted(out, key=lambda _: rng.random())


def test_a_crowded_block_against_brute_force(spark):
    hashes = [*crowd(random.Random(1), 500), "abcd12", "ABCD000000000000", "abcd000000000012", None, "ab"]
    df = table(spark, hashes, ("t", "u"))
    want = sorted((i, j) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i % 2 == j % 2 and x and y and len(x) >= 4 and len(y) >= 4 and near(x, y))
    for crowded in (50, 10**6):
        assert sorted((r.left_key, r.right_key) for r in D.near_pairs(df, df, "lang", "h", "id", crowded=crowded).collect()) == want
    flags = {i for i, j in want if j < i} | {i for i, h in enumerate(hashes) if h in hashes[:i] and h and len(h) >= 4 and i % 2 == hashes.index(h) % 2}
    assert {r.id for r in D.near_flags(df, "lang", "h", "id").filter("near_dup").collect()} == flags


def test_fifty_thousand_hashes_of_one_prefix(spark):
    rng = random.Random(2)
    hashes = crowd(rng, 42_000)
    df = table(spark, hashes).repartition(8).cache()
    keyed = df.withColumn("k", F.explode(D._subkeys("h", 8, 16)))
    sizes = keyed.groupBy("k").count().agg(F.max("count"), F.sum(F.col("count") * F.col("count"))).first()
    assert df.count() > 50_000 and sizes[0] < 400 and sizes[1] < len(hashes) ** 2 / 10  # of all with all
    got = {(r.left_key, r.right_key) for r in D.near_pairs(df, df, "lang", "h", "id").filter("right_key < left_key").collect()}
    assert all(near(hashes[i], hashes[j]) for i, j in got)
    some = rng.sample(range(len(hashes)), 60)
    values = [int(h, 16) for h in hashes]
    assert all({j for i, j in got if i == x} == {j for j in range(x) if (values[x] ^ values[j]).bit_count() <= 8} for x in some)
    df.unpersist()


def test_a_dense_crowd_is_settled_by_its_first_hash(spark):
    """All within four bits of one hash: flags need no pairs of all with all."""
    hashes = sorted({f"{0xABCD000000000000 | sum(1 << b for b in random.Random(i).sample(range(48), 4)):016x}" for i in range(3000)})
    hashes = ["abcd000000000000", *hashes]
    flags = D.near_flags(table(spark, hashes), "lang", "h", "id")
    assert flags.filter("near_dup").count() == len(hashes) - 1


def test_no_rows(spark):
    none = table(spark, [])
    assert D.near_pairs(none, none, "lang", "h", "id").count() == 0 and D.near_flags(none, "lang", "h", "id").count() == 0
