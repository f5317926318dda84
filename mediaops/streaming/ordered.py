"""Stateful streams in event-time order, with late rows aside.

Rows wait in list state, by shards of keys, until the watermark has passed them; a timer at the first
waiting row then hands them on in order of time, so results depend neither on how
rows are dealt into micro-batches nor on the order inside one. Rows that come behind the
watermark are not dropped: they leave at once, marked late. What a key has to
remember is one small value, which goes once it no longer matters.
State lives in RocksDB."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, ListState, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS, PART = 1024, 50_000

#: (state, milliseconds) to (state, outputs); the state is a tuple, or None at first
Step = Callable[[tuple | None, int], tuple[tuple, tuple]]


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; each copies the session's settings as it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class InOrder(StatefulProcessor):
    """step over each key's rows in order of time; until(state): the time from which the state no longer matters.

    Calls to the state store cost far more than rows do, so they are made for a shard of keys at a time, and rows and keys' states
    go as pickled parts of up to ``PART`` rows and keys."""

    def __init__(self, keys: list[str], order: str, step: Step, columns: list[str], until: Callable[[tuple], int]):
        self.keys, self.order, self.step, self.columns, self.until = keys, order, step, columns, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "part binary")
        self.held = handle.getListState("held", "part binary")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def _wake(self, at: int) -> None:
        """One timer a shard: at its first waiting row, or at the end of its first state's life."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        new, late = [], []
        for part in rows:
            named = part[part["is_named"]]  # others are heartbeats: they move the watermark and nothing else
            of = zip(*(named[k].astype(object).where(named[k].notna(), None) for k in self.keys), strict=True)
            for row in zip(map(int, named["event_ms"]), named[self.order].tolist(), of, strict=True):
                (late if row[0] < mark else new).append(row)
        if new:
            self.waiting.appendList(_parts(new))
            self._wake(min([min(row[0] for row in new) + 1, *self.handle.listTimers()]))
        if late:
            nothing = [None] * (len(self.columns) - len(self.keys) - 2)
            yield self._frame([(*of, name, True, *nothing) for _, name, of in late])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows, states, out = _rows(self.waiting), dict(_rows(self.held)), []
        ready, rest = sorted((r for r in rows if r[0] < mark), key=itemgetter(0, 1)), [r for r in rows if r[0] >= mark]
        for at, name, of in ready:
            state = states.get(of)
            if state is not None and at >= self.until(state):
                state = None
            states[of], made = self.step(state, at)
            out.append((*of, name, False, *made))
        # the rows that still wait are not behind the watermark, so a state that ends there matters to none of them
        states = {of: state for of, state in states.items() if self.until(state) > mark}
        if ready:
            _replace(self.waiting, rest)
        _replace(self.held, list(states.items()))
        if rest or states:
            # a timer at or before the watermark fires in the next batch, so it makes progress either way
            self._wake(min(r[0] for r in rest) + 1 if rest else min(map(self.until, states.values())))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def _parts(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[i : i + PART], protocol=5),) for i in range(0, len(rows), PART)]


def _rows(kept: ListState) -> list[tuple]:
    return [row for (part,) in kept.get() for row in pickle.loads(part)] if kept.exists() else []


def _replace(kept: ListState, rows: list[tuple]) -> None:
    if rows:
        kept.put(_parts(rows))
    elif kept.exists():
        kept.clear()


def in_order(stream: DataFrame, keys: list[str], ts: str, order: str, delay: str, step: Step, outputs: str, state: str, until: Callable[[tuple], int], shards: int = SHARDS) -> DataFrame:
    """keys, ``order``, late, and the step's outputs (null for late rows) of every row.

    Late is what comes with a time before the watermark: the latest time of all earlier micro-batches less ``delay``,
    in whole milliseconds. ``order`` names a row and breaks ties of time; a row without one is a heartbeat, which moves the watermark and
    leaves no row. The watermark column itself stays below the operator, as Spark would drop late rows above it. Rows
    still waiting when a stream ends come out when it goes on, or after a heartbeat. ``state`` names the parts of a key's state. The number of
    ``shards`` that keys are dealt to by hash is fixed once a checkpoint is written; a batch reads what the shards that it touches hold."""
    kinds = dict(stream.dtypes)
    marked = stream.withColumn("_mark", F.col(ts).cast("timestamp")).withWatermark("_mark", delay)
    # keys travel as text, and a heartbeat gets some name: pandas would turn whole numbers beside a null into floating ones
    text = lambda k: F.base64(k) if kinds[k] == "binary" else F.col(k).cast("string")
    back = lambda k: F.unbase64(k) if kinds[k] == "binary" else F.col(k).cast(kinds[k])
    some = F.lit("1970-01-01" if kinds[order].startswith(("date", "timestamp")) else "0").cast(kinds[order])
    shard = F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int").alias("of_shard")
    slim = marked.select(shard, *[text(k).alias(k) for k in keys], F.coalesce(F.col(order), some).alias(order), F.col(order).isNotNull().alias("is_named"), F.unix_millis(F.col(ts).cast("timestamp")).alias("event_ms"))
    names = [o.split()[0] for o in outputs.split(", ")]
    schema = ", ".join([*[f"{k} string" for k in keys], f"{order} {kinds[order]}", "late boolean", outputs])
    processor = InOrder(keys, order, step, [*keys, order, "late", *names], until)
    done = slim.groupBy("of_shard").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return done.select(*[back(k).alias(k) for k in keys], order, "late", *names)


def expiring(ttl_ms: int, renew: bool) -> tuple[Step, str, str, Callable[[tuple], int]]:
    """fresh: the key is not remembered. It is remembered for ``ttl_ms`` from its last fresh row, or, if that renews, from its last row."""

    def step(state: tuple | None, at: int) -> tuple[tuple, tuple]:
        fresh = state is None
        return ((at + ttl_ms,) if fresh or renew else state), (fresh,)

    return step, "fresh boolean", "expiry long", lambda state: state[0]


def limits(per_minute: int, per_hour: int) -> tuple[Step, str, str, Callable[[tuple], int]]:
    """allowed: among the first of its minute, and, of those, among the first of its hour; rejected rows count for no hour."""
    minute_ms, hour_ms = 60_000, 3_600_000

    def step(state: tuple | None, at: int) -> tuple[tuple, tuple]:
        minute, hour = at // minute_ms, at // hour_ms
        last_minute, n, last_hour, m = state or (minute, 0, hour, 0)
        n, m = (n if minute == last_minute else 0) + 1, m if hour == last_hour else 0
        m += n <= per_minute
        return (minute, n, hour, m), (n <= per_minute and m <= per_hour,)

    return step, "allowed boolean", "minute long, n long, hour long, m long", lambda state: (state[2] + 1) * hour_ms


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run until there is nothing left to read, into Parquet; going on with the same checkpoint continues the state."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drained_apart(stream: DataFrame, on_time: str, late: str, checkpoint: str) -> None:
    """As ``drained``, with late rows in a table of their own; a batch that is replayed writes the same folders again."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("not late").write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        batch.filter("late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.unpersist()

    with rocksdb(stream.sparkSession):
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
