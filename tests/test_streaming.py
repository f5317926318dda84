import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediaops.streaming import jobs as T

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp, ok boolean"


def rows(spec):
    return [(k, i, START + dt.timedelta(seconds=s), ok) for i, (k, s, ok) in enumerate(spec)]


def stream(spark, tmp_path, data, parts=2):
    n = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * n : (i + 1) * n], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drained(spark, tmp_path, df):
    T.run(df, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()


@pytest.mark.parametrize(("step", "outputs", "state"), [(T.token_bucket(1.0, 3.0), "allowed boolean, tokens double", T.TOKEN_STATE), (T.circuit_breaker(4, 0.5), "before string, after string", T.BREAKER_STATE), (T.batcher(5, 3.0, 2), "batch long, place long", T.BATCH_STATE)])
def test_stream_equals_its_batch_twin(spark, tmp_path, step, outputs, state):
    data = rows([(k, s, (s + len(k)) % 3 > 0) for s in range(20) for k in ("a", "bb")])
    got = drained(spark, tmp_path, T.stateful(stream(spark, tmp_path, data), "k", "ts", "id", step, outputs, state, streaming=True))
    want = T.stateful(spark.createDataFrame(data, SCHEMA), "k", "ts", "id", step, outputs, state).collect()
    assert sorted(got) == sorted(want) and len(got) == len(data)


def test_token_bucket_burst_and_refill(spark):
    data = rows([("a", 0, True)] * 51 + [("a", 1, True)] * 11)
    got = T.stateful(spark.createDataFrame(data, SCHEMA), "k", "ts", "id", T.token_bucket(), "allowed boolean, tokens double", "").orderBy("id").collect()
    assert [r.allowed for r in got] == [True] * 50 + [False] + [True] * 10 + [False]


def test_breaker_opens_and_recovers(spark):
    data = rows([("a", i, False) for i in range(10)] + [("a", 20, True), ("a", 40, True), ("a", 41, False)])
    got = T.stateful(spark.createDataFrame(data, SCHEMA), "k", "ts", "id", T.circuit_breaker(), "before string, after string", "").orderBy("id").collect()
    assert [r.after for r in got] == ["closed"] * 9 + ["open", "open", "closed", "closed"]


def test_batches_close_at_target_or_after_waiting(spark):
    data = rows([("a", 0, True)] * 33 + [("a", 1, True)] * 7 + [("a", 6, True)])
    got = T.stateful(spark.createDataFrame(data, SCHEMA), "k", "ts", "id", T.batcher(), "batch long, place long", "").orderBy("id").collect()
    assert [r.batch for r in got] == [0] * 32 + [1] * 8 + [2]


def test_limits(spark):
    df = spark.createDataFrame(rows([("a", 0, True)] * 61 + [("a", 60, True)]), SCHEMA)
    assert [r.allowed for r in T.limit_decisions(df, "k", "ts", "id").orderBy("id").collect()] == [True] * 60 + [False, True]
    assert sum(r.allowed for r in T.limit_decisions(df, "k", "ts", "id", 60, 10).collect()) == 10


def test_ingest_splits_all_rows(spark, tmp_path):
    data = [(None if i % 4 == 0 else "a", i, START, True) for i in range(20)]
    T.ingest(stream(spark, tmp_path, data), ["k"], f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/cp").awaitTermination()
    good, dead = (spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{x}") for x in ("good", "dead"))
    assert good.count() == 15 and dead.count() == 5 and {r.error for r in dead.collect()} == {"missing: k"}


def test_ttl_dedup_and_sessions(spark, tmp_path):
    data = rows([("a", 0, True), ("a", 10, True), ("b", 20, True), ("a", 30, True)])
    assert sorted(r.k for r in drained(spark, tmp_path, T.ttl_dedup(stream(spark, tmp_path, data), ["k"]).select("k"))) == ["a", "b"]
    s = T.idle_sessions(spark.createDataFrame(data, SCHEMA), ["k"], ttl="15 seconds").collect()
    assert sorted((r.k, r.n) for r in s) == [("a", 1), ("a", 2), ("b", 1)]


def test_late_rows_are_counted(spark, tmp_path):
    data = rows([("a", 10_000, True), ("a", 10_001, True)])
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counts = T.limit_counts(df, "k", late="10 seconds")
    T.run(counts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame(rows([("a", 0, True)]), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = T.run(counts, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert T.late_rows(q) == 1


def test_lifecycle(spark):
    df = spark.createDataFrame([("b", 1, START, "created", 0), ("b", 2, START, "failed", 3)], "k string, id long, ts timestamp, s string, n int")
    assert T.lifecycle(df, "k", "s", "ts", "id", "n").select("status", "total").first()[:2] == ("failed", 3)
    assert T.live_counters(df, "k", F.sum("n").alias("total")).first().total == 3
