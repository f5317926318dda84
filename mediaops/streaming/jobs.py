"""Structured Streaming jobs and their batch twins.

Stateful operators are one step function each, (state, row) to (state, output), used
by ``applyInPandasWithState`` on streams and by ``mapInPandas`` on sorted tables. State is
a small tuple a key, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.predicates import split_valid
from ..operators.scans import running_sums


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp: watermarks refuse timestamp_ntz."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drain what is there, once, into Parquet."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, required: list[str], good: str, dead: str, checkpoint: str):
    """Valid rows to one table, the others with their reason to another; a batch replayed writes the same folder again."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        ok, bad = split_valid(batch, required)
        ok.write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ttl_dedup(stream: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """First row of each key within ``ttl`` (also for idempotency keys)."""
    return with_event_time(stream, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def idle_sessions(df: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """A key's activity until it idles for ``ttl``: the time to live renews with each row."""
    df = with_event_time(df, ts)
    df = df.withWatermark(ts, watermark) if watermark else df
    return df.groupBy(*keys, F.session_window(ts, ttl).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def limit_decisions(df: DataFrame, key: str, ts: str, order: str, per_minute: int = 60, per_hour: int = 1000) -> DataFrame:
    """allowed: under both limits when it comes. Rejected rows do not count, so in each minute the first ones pass, and of those in each hour."""
    slots = df.withColumn("_minute", F.date_trunc("minute", ts)).withColumn("_hour", F.date_trunc("hour", ts))
    in_minute = running_sums(slots, [key, "_minute"], [ts, order], {"_n": F.lit(1)}).withColumn("_m", F.col("_n") <= per_minute)
    in_hour = running_sums(in_minute, [key, "_hour"], [ts, order], {"_h": F.when(F.col("_m"), 1).otherwise(0)})
    return in_hour.withColumn("allowed", F.col("_m") & (F.col("_h") <= per_hour)).select(*df.columns, "allowed")


def limit_counts(stream: DataFrame, key: str, ts: str = "ts", width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    return with_event_time(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).count().select(F.col("w.start").alias("start"), key, F.col("count").alias("n"))


def late_flags(df: DataFrame, key: str, ts: str, order: str, delay: str) -> DataFrame:
    """late: behind a key's watermark, its latest time so far less ``delay``, when it arrives in ``order``."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("late", F.coalesce(F.col(ts) < F.max(ts).over(before) - F.expr(f"INTERVAL {delay}"), F.lit(False)))


def live_counters(stream: DataFrame, key: str, *sums: Column) -> DataFrame:
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *sums)


def lifecycle(df: DataFrame, key: str, status: str, ts: str, order: str, n: str) -> DataFrame:
    """Latest status of each batch, first and last time, and its sum."""
    latest = F.max_by(status, F.struct(ts, order))
    return df.groupBy(key).agg(latest.alias("status"), F.min(ts).alias("created"), F.max(ts).alias("updated"), F.sum(n).alias("total"))


# ---- stateful steps -------------------------------------------------------


def token_bucket(rate: float = 10.0, burst: float = 50.0, idle: float = 3600.0) -> Callable:
    """State (tokens, time). A row passes if a token is left; a bucket unused for ``idle`` seconds starts full."""

    def step(state: tuple | None, now: float, row) -> tuple[tuple, list[tuple]]:
        tokens, last = state if state and now - state[1] <= idle else (burst, now)
        tokens = min(burst, tokens + max(0.0, now - last) * rate)
        ok = tokens >= 1
        return (tokens - ok, max(last, now)), [(ok, round(tokens - ok, 6))]

    return step


def circuit_breaker(least: int = 10, worst: float = 0.5, base: float = 30.0, most: int = 6) -> Callable:
    """State (mode, requests, failures, trips, opened): opens for base * 2^trips seconds, then lets one request try."""

    def step(state: tuple | None, now: float, row) -> tuple[tuple, list[tuple]]:
        mode, n, bad, trips, opened = state or ("closed", 0, 0, 0, 0.0)
        before = mode
        if mode == "open" and now - opened >= base * 2 ** min(trips - 1, most):
            mode = "half_open"
        if mode != "open":
            n, bad = n + 1, bad + (not row.ok)
            if mode == "half_open":
                mode, n, bad = ("closed", 0, 0) if row.ok else ("open", n, bad)
                trips, opened = (0, opened) if mode == "closed" else (trips + 1, now)
            elif n >= least and bad / n > worst:
                mode, trips, opened = "open", trips + 1, now
        return (mode, n, bad, trips, opened), [(before, mode)]

    return step


def batcher(target: int = 32, wait: float = 5.0, least: int = 8) -> Callable:
    """State (batch, size, first time). A batch closes at ``target`` rows, or once its first row waits ``wait``
    seconds and it has max(least, target / 4) rows. Each row gets its batch's number."""
    floor = max(least, target // 4)

    def step(state: tuple | None, now: float, row) -> tuple[tuple, list[tuple]]:
        batch, n, first = state or (0, 0, now)
        if n >= target or (n >= floor and now - first >= wait):
            batch, n, first = batch + 1, 0, now
        return (batch, n + 1, first if n else now), [(batch, n + 1)]

    return step


def _seconds(ts) -> float:
    return pd.Timestamp(ts).timestamp()


def stateful(df: DataFrame, key: str, ts: str, order: str, step: Callable, outputs: str, state: str, streaming: bool = False) -> DataFrame:
    """Run a step function over each key's rows in time order: key, order column and the outputs."""
    kinds = dict(df.dtypes)
    names = [o.split()[0] for o in outputs.split(", ")]
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {outputs}"

    def over(held, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
        out = []
        for r in rows.itertuples(index=False):
            held, made = step(held, _seconds(getattr(r, ts)), r)
            out += [(getattr(r, key), getattr(r, order), *m) for m in made]
        return held, out

    if not streaming:

        def on_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # rows come key by key in time order: a task holds one key's state, never its rows
            last, held = [], None
            for rows in batches:
                out = []
                new = rows[key].ne(rows[key].shift()) & ~(rows[key].isna() & rows[key].shift().isna())
                for _, part in rows.groupby(new.cumsum(), sort=False):
                    name = part[key].iloc[0]
                    name = None if pd.isna(name) else name
                    held = held if last == [name] else None
                    held, made = over(held, part)
                    last = [name]
                    out += made
                yield pd.DataFrame(out, columns=[key, order, *names])

        return df.repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(on_table, schema)

    def on_stream(_key, batches, kept: GroupState):
        # a micro-batch may come in several pieces: one order over all of them
        rows = pd.concat(list(batches)).sort_values([ts, order])
        held, out = over(kept.get if kept.exists else None, rows)
        kept.update(tuple(held))
        yield pd.DataFrame(out, columns=[key, order, *names])

    return df.groupBy(key).applyInPandasWithState(on_stream, schema, state, "append", GroupStateTimeout.NoTimeout)


TOKEN_STATE, BREAKER_STATE, BATCH_STATE = "tokens double, last double", "mode string, n long, bad long, trips long, opened double", "batch long, n long, first double"


def late_rows(query) -> int:
    """Rows that came after the watermark and were dropped, over a finished query's progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
