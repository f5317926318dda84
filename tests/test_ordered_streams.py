import datetime as dt
import random

import pytest

from mediaops.streaming import ordered as O

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp"
DELAY = 600  # seconds


@pytest.fixture(scope="module")
def batches():
    """Rows in order of arrival in four batches: some come a little late, some too late; then a heartbeat."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c"]), i, i * 20 + rng.choice([0, 0, 0, 0.5])) for i in range(240)]
    arrival = sorted(rows, key=lambda r: r[2] + (3000 if r[1] % 9 == 0 else rng.randrange(400)))
    return [arrival[i : i + 60] for i in range(0, 240, 60)] + [[(None, None, 10**6)]]


def write(spark, path, batch):
    spark.createDataFrame([(k, i, START + dt.timedelta(seconds=s)) for k, i, s in batch], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def brute(batches, step, until):
    """late rows by batch, then the others of each key in order."""
    late, rest, high = [], [], None
    for batch in batches:
        mark = high - DELAY * 1000 if high is not None else 0
        base = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
        for k, i, s in batch:
            at = base + int(s * 1000)
            (late if high is not None and at < mark else rest).append((k, at, i))
        high = max([high or 0, *(base + int(s * 1000) for _, _, s in batch)])
    out = {i: (k, True, None) for k, _, i in late}
    states = {}
    for k, at, i in sorted(r for r in rest if r[2] is not None):
        state = states.get(k)
        if state is not None and at >= until(state):
            state = None
        states[k], (made,) = step(state, at)
        out[i] = (k, False, made)
    return out


@pytest.mark.parametrize("how", [O.expiring(90_000, False), O.expiring(90_000, True), O.limits(1, 40)])
@pytest.mark.parametrize("restart", [False, True])
def test_stream_against_rows_in_order(spark, tmp_path, batches, how, restart):
    step, outputs, state, until = how
    for n, batch in enumerate(batches):
        write(spark, f"{tmp_path}/in", batch)
        if restart and n in (1, 3):  # stop, and go on with the same state
            O.drained(O.in_order(source(spark, f"{tmp_path}/in"), ["k"], "ts", "id", f"{DELAY} seconds", *how), f"{tmp_path}/out", f"{tmp_path}/cp")
    O.drained(O.in_order(source(spark, f"{tmp_path}/in"), ["k"], "ts", "id", f"{DELAY} seconds", *how), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = brute(batches, step, until)
    assert {r.id: (r.k, r.late, r[3]) for r in got} == want and len(got) == 240
    assert 5 < sum(r.late for r in got) < 60 and {r[3] for r in got} == {True, False, None}


def test_many_keys_are_held_by_few_shards(spark, tmp_path):
    """State comes and goes by shard, whatever the number of keys; whole numbers beside a heartbeat's nulls stay exact."""
    big, schema = 2**53 + 1, "k long, id long, ts timestamp"
    rows = [(big + i % 2000, big + i, START + dt.timedelta(seconds=i // 2000 * 40)) for i in range(6000)]
    for batch in (rows[:4000], rows[4000:], [(None, None, START + dt.timedelta(days=9))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with O.rocksdb(spark):
        query = O.in_order(stream, ["k"], "ts", "id", "10 minutes", *O.expiring(60_000, False), shards=8).writeStream.format("memory").queryName("few_shards").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) < 100
    got = spark.table("few_shards").collect()
    assert {(r.k, r.id, r.late, r.fresh) for r in got} == {(k, i, False, n // 2000 != 1) for n, (k, i, _) in enumerate(rows)} and len(got) == 6000


def test_a_hot_key_waits_in_several_parts(spark, tmp_path):
    """More rows of one key than a part holds, out of order, many of one millisecond, against rows in order."""
    n, schema, rng = O.PART + 20_000, "k string, id long, ts timestamp", random.Random(9)
    rows = [("a", i, START + dt.timedelta(milliseconds=rng.randrange(10_000) * 1000)) for i in range(n)]
    for batch in (rows, [(None, None, START + dt.timedelta(days=9))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    O.drained(O.in_order(source(spark, f"{tmp_path}/in").select("*"), ["k"], "ts", "id", "2 hours", *O.limits(1, 2)), f"{tmp_path}/out", f"{tmp_path}/cp")
    step, _, _, until = O.limits(1, 2)
    state, want = None, {}
    for _, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        at = int(ts.replace(tzinfo=dt.UTC).timestamp() * 1000)
        state = None if state is not None and at >= until(state) else state
        state, (want[i],) = step(state, at)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.id: r.allowed for r in got} == want and len(got) == n and not any(r.late for r in got) and sum(want.values()) == 6
