import pytest

from mediaops.operators import bloom as B
from mediaops.operators import joins as J


def keys(spark, values):
    return spark.createDataFrame([(v, "x") for v in values], "u string, _bits string")


def test_no_key_is_dropped_and_few_foreign_ones_pass(spark):
    inside, outside = (spark.range(a, b).selectExpr("concat('https://h/', id) AS u") for a, b in ((0, 20_000), (20_000, 120_000)))
    words = B.words_for(inside, "u")
    assert 0.9 < words / (20_000 * B.BITS_A_KEY / 64) < 1.1
    filter_ = B.build(inside, "u", words)
    assert filter_.count() <= words
    assert B.hits(inside, "u", filter_, words).count() == 20_000
    assert B.hits(outside, "u", filter_, words).count() < 2500


def test_merged_filters_hold_the_keys_of_all(spark):
    parts = [spark.range(a, a + 500).selectExpr("CAST(id AS string) AS u") for a in (0, 500, 9000)]
    one = B.merged(*[B.build(p, "u", 300) for p in parts])
    both = B.build(parts[0].union(parts[1]).union(parts[2]), "u", 300)
    assert sorted(one.collect()) == sorted(both.collect())


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_unseen_with_and_without_a_filter(spark, most):
    batch = ["a", "b", "b", None, "c", ""] * 30 + [f"n{i}" for i in range(500)]
    history = [f"n{i}" for i in range(0, 500, 2)] + ["b", None, ""] * 20 + [f"other{i}" for i in range(3000)]
    got = B.unseen(keys(spark, batch), keys(spark, history).select("u"), "u", most).collect()
    gone = {h for h in history if h is not None}
    assert sorted(str(r.u) for r in got) == sorted(str(u) for u in batch if u not in gone)
    assert [r.u for r in J.unseen(keys(spark, ["p", "q"]), keys(spark, ["q"]), "u").collect()] == ["p"]


def test_share_of_the_history_that_is_joined(spark):
    history = spark.range(200_000).selectExpr("concat('u', id) AS u")
    batch = spark.range(0, 400_000, 400).selectExpr("concat('u', id) AS u")  # 1000 keys, 500 of them in the history
    r = B.share_read(batch, history, "u").first()
    assert r.history == 200_000 and 500 <= r.passed < 6000 and r.share == r.passed / 200_000


def test_no_rows(spark):
    none, some = keys(spark, []), keys(spark, ["a"])
    assert B.unseen(none, some, "u").count() == 0 and B.unseen(some, none, "u").count() == 1
    assert B.share_read(none, none, "u").first().share == 0
    with pytest.raises(ValueError, match="too large"):
        B.hits(some, "u", B.build(some, "u", B.MAX_WORDS + 1), B.MAX_WORDS + 1)


def test_the_history_is_filtered_before_it_shuffles(spark):
    plan = B.unseen(spark.range(1000).selectExpr("CAST(id AS string) u"), spark.range(100_000).selectExpr("CAST(id AS string) u"), "u")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
