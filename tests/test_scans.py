import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediaops.operators import scans as S
from mediaops.operators import windows as W
from mediaops.streaming import jobs as T

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, id long, d int, _slice string"


@pytest.fixture(scope="module")
def rows():
    """Nine rows of ten are one key's, some are of a null key; times tie."""
    rng = random.Random(8)
    return [(rng.choice(["a", "b", None]) if i % 10 == 0 else "hot", START + dt.timedelta(seconds=rng.randrange(4000)), i, rng.choice([-1, -1, 0, 1, None]), "x") for i in range(6000)]


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.drop("_slice")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(autouse=True)
def many_slices(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_is_spread_over_all_slices(spark, rows):
    out = S.prefix_scan(table(spark, rows), ["k"], ["ts", "id"], {}, {"n": F.count(F.lit(1))}, {"to": lambda w: F.sum("n").over(w)})
    sizes = {r["_slice"]: r["n"] for r in out.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = out.filter("k = 'hot'").select("_slice").distinct().count()
    assert len(sizes) == 16 and hot >= 14 and max(sizes.values()) < 3 * len(rows) / 16
    # a slice carries one key at most
    assert all(r[1] <= 1 for r in out.filter("to is not null").groupBy("_slice").agg(F.count_distinct(F.coalesce("k", F.lit("")))).collect())


def test_running_success(spark, rows):
    want = {}
    for part in by_key(rows).values():
        ok = 0
        for n, r in enumerate(part, 1):
            ok += r[3] is not None and r[3] >= 0
            want[r[2]] = (n, ok / n, n >= 10 and 1 - ok / n > 0.5)
    got = W.running_success(table(spark, rows), ["k"], "ts", "id", F.col("d") >= 0).collect()
    assert {r.id: (r.so_far, r.success_rate, r.tripped) for r in got} == want and len(got) == len(rows)


def test_gaps(spark, rows):
    want = {}
    for part in by_key(rows).values():
        want |= {r[2]: None if not n else (r[1] - part[n - 1][1]).total_seconds() for n, r in enumerate(part)}
    got = W.gaps(table(spark, rows), ["k"], "ts", "id", F.lit(0.5)).collect()
    assert {r.id: r.gap for r in got} == want
    assert all(r.idle == (0 if r.gap is None else max(0, r.gap - 0.5)) for r in got)


def test_floored_counter(spark, rows):
    want = {}
    for part in by_key(rows).values():
        level = 0
        for r in part:
            level = max(0, level + (r[3] or 0))
            want[r[2]] = level
    got = W.floored_counter(table(spark, rows), ["k"], "ts", "id", F.col("d")).collect()
    assert {r.id: r.level for r in got} == want


def test_limit_decisions(spark, rows):
    want = {}
    for part in by_key(rows).values():
        minutes, hours = {}, {}
        for r in part:
            m, h = r[1].replace(second=0), r[1].replace(minute=0, second=0)
            ok = minutes.get(m, 0) < 20 and hours.get(h, 0) < 900
            minutes[m] = minutes.get(m, 0) + 1 if minutes.get(m, 0) < 20 else 20
            hours[h] = hours.get(h, 0) + ok
            want[r[2]] = ok
    got = T.limit_decisions(table(spark, rows), "k", "ts", "id", 20, 900).collect()
    assert {r.id: r.allowed for r in got} == want


def test_no_rows(spark):
    empty = table(spark, [])
    assert W.running_success(empty, ["k"], "ts", "id", F.col("d") > 0).count() == 0
    assert W.floored_counter(empty, ["k"], "ts", "id", F.col("d")).count() == 0 and W.gaps(empty, ["k"], "ts", "id", F.lit(1)).count() == 0
