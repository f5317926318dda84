"""Window operators; every order ends in a key, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import row_before, running_sums, sum_and_low


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (latest samples, caps, best of a group, first seen)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def gaps(df: DataFrame, by: list[str], ts: str, key: str, latency: Column) -> DataFrame:
    """Seconds since the row before, and idle time: that without its latency, 0 at least."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    out = row_before(df, by, [ts, key], "_before", micros).withColumn("gap", (micros - F.col("_before")) / 1e6).drop("_before")
    return out.withColumn("idle", F.greatest(F.lit(0.0), F.col("gap") - latency))


def running_success(df: DataFrame, by: list[str], ts: str, key: str, ok: Column, least: int = 10, worst: float = 0.5) -> DataFrame:
    """Success rate so far, and whether it has tripped: ``least`` requests with more failures than ``worst``."""
    out = running_sums(df, by, [ts, key], {"so_far": F.lit(1), "_ok": F.when(ok, 1).otherwise(0)})
    out = out.withColumn("success_rate", F.col("_ok") / F.col("so_far")).drop("_ok")
    return out.withColumn("tripped", (F.col("so_far") >= least) & (1 - F.col("success_rate") > worst))


def connection_tier(average: Column, success: Column, base: int = 200) -> Column:
    """Connections for a host by its average milliseconds and success rate."""
    return F.when((average < 200) & (success > 0.95), min(base, max(50, int(base * 0.15)))).when((average > 1000) | (success < 0.7), max(5, int(base * 0.05))).otherwise(max(10, int(base * 0.10)))


def floored_counter(df: DataFrame, by: list[str], ts: str, key: str, delta: Column) -> DataFrame:
    """Running sum that never goes below 0: the sum less its smallest value so far, where negative."""
    out = sum_and_low(df, by, [ts, key], delta)
    return out.withColumn("level", F.col("_sum") - F.least(F.lit(0), F.col("_low"))).drop("_sum", "_low")
