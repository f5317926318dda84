import random

from mediaops.plans import QUERIES


def test_every_vector_is_verified(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"l{i % 3}", [rng.gauss(i % 3, 1) for _ in range(64)]) for i in range(1, 50)]  # no vec_id is divisible by 50
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["v6_verify_all"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == [r[0] for r in rows]
    assert all(r.similarity is not None and r.verified == (r.similarity >= 0.15) and (r.reason is None) == r.verified for r in got)
