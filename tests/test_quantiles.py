import random

import numpy as np
import pytest

from mediaops.operators import dedup as D
from mediaops.operators import quantiles as Q

SCHEMA = "g string, x double, _r string"
WANTED = {"low": 0.0, "tenth": 0.1, "median": 0.5, "p90": 0.9, "top": 1.0}


def check(got, rows, wanted=WANTED):
    groups = {}
    for g, x, _ in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert {r.g for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        assert [r[n] for n in wanted] == pytest.approx([float(np.quantile(groups[r.g], p)) for p in wanted.values()], rel=1e-12)


@pytest.mark.parametrize("few", [10, 300, 100_000])
def test_against_numpy_with_a_hot_group(spark, few):
    rng = random.Random(6)
    rows = [("hot", rng.gauss(0, 1) ** 3, "y") for _ in range(9000)] + [("ties", rng.choice([1.0, 1.0, 1.0, 2.0, 7.5]), "y") for _ in range(3000)]
    rows += [(rng.choice([None, "a", "b"]), rng.choice([None, 0.0, -1.5, rng.random()]), "y") for _ in range(200)] + [("one", 3.25, "y"), ("two", 1.0, "y"), ("two", 2.0, "y"), ("none", None, "y")]
    rng.shuffle(rows)
    check(Q.quantiles(spark.createDataFrame(rows, SCHEMA), ["g"], "x", WANTED, few).collect(), rows)


@pytest.mark.parametrize("few", [50, 100_000])
def test_all_rows_as_one_group(spark, few):
    values = np.random.default_rng(1).exponential(size=20_000)
    df = spark.createDataFrame([("a", float(v), "") for v in values], SCHEMA)
    r = Q.quantiles(df, [], "x", {"p90": 0.9, "median": 0.5}, few).first()
    assert (r.p90, r.median) == pytest.approx((np.quantile(values, 0.9), np.median(values)), rel=1e-12)


def test_no_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Q.quantiles(none, ["g"], "x", WANTED).count() == 0
    assert [r.median for r in Q.quantiles(none, [], "x", {"median": 0.5}).collect()] == [None]


@pytest.mark.parametrize("digits", [16, 40])
def test_greedy_memory_equals_a_scan(digits):
    rng = random.Random(digits)
    memory, scan, now = D._Memory(30), [], 0.0
    for _ in range(3000):
        now += rng.choice([0, 1, 5])
        base = rng.choice([0, (1 << 4 * digits) - 1])
        for bit in rng.sample(range(4 * digits), rng.randrange(12)):
            base ^= 1 << bit
        h = f"{base:0{digits}x}"
        scan = [(at, v) for at, v in scan if now - at <= 200]
        want = all((v ^ base).bit_count() > 8 for _, v in scan)
        if want:
            scan = [*scan, (now, base)][-30:]
        memory.forget(now, 200)
        words = memory.split(h)
        assert memory.near(words, 8) != want
        if want:
            memory.add(now, words)
    assert memory.end - memory.start == len(scan)
