"""Exact interpolated quantiles by successive histogram refinement.

A quantile lies between two order statistics. Each pass over the rows counts what lies below a
bracket and makes an equi-depth histogram of what lies inside, a mergeable sketch of bounded
size; the next bracket is the few buckets that surely hold the wanted places. Once a bracket holds few rows, its distinct values are counted and put in
order. No group's values are ever gathered in one buffer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

BUCKETS, ACCURACY = 100, 2000
#: Rows of a bracket whose distinct values are put in order.
FEW = 100_000
ROUNDS = 12


def _inside(value: str) -> Column:
    return (F.col("_low").isNull() | (F.col(value) >= F.col("_low"))) & (F.col("_high").isNull() | (F.col(value) <= F.col("_high")))


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """One row a group of ``by`` (none: one row): for each name the quantile p, linear between the order statistics around (n - 1) p.

    Nulls are left out; a group without values has nulls, and no row if ``by`` is given. NaN counts as larger than all."""
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in wanted.items()])
    nothing = F.lit(None).cast("double")
    targets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", F.explode(names))
    at = (F.col("_n") - 1) * F.col("_t.p")
    targets = written(targets.select(*keys, F.col("_t.name").alias("_name"), "_n", (F.floor(at) + 1).alias("_r"), (at - F.floor(at)).alias("_part"), nothing.alias("_low"), nothing.alias("_high")))
    largest = targets.agg(F.max("_n")).first()[0]
    same = lambda t: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}t")) for k in keys], F.lit(True))

    def met(t: DataFrame) -> DataFrame:
        t = t.select(*[F.col(k).alias(f"{k}t") for k in keys], *[c for c in t.columns if c not in keys])
        return rows.join(t, same(t)) if keys else rows.join(F.broadcast(t))  # a row a name

    grid = [i / BUCKETS for i in range(BUCKETS + 1)]
    for _ in range(ROUNDS):
        if not largest or largest <= few:
            break
        parts = met(targets).groupBy(*keys, "_name").agg(
            *[F.first(c).alias(c) for c in ("_n", "_r", "_part", "_low", "_high")], F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(_inside("_v")).alias("_m"),
            F.percentile_approx(F.when(_inside("_v"), F.col("_v")), F.array(*map(F.lit, grid)), ACCURACY).alias("_grid"),
        )
        # a bucket's edge is off by a share of 1 / ACCURACY of the rows at most
        low = F.floor(BUCKETS * ((F.col("_r") - 1 - F.col("_below")) / F.col("_m") - 2 / ACCURACY))
        high = F.ceil(BUCKETS * ((F.col("_r") + 1 - F.col("_below")) / F.col("_m") + 2 / ACCURACY))
        new_low = F.when(low > 0, F.get("_grid", low.cast("int"))).otherwise(F.col("_low"))
        new_high = F.when(high < BUCKETS, F.get("_grid", high.cast("int"))).otherwise(F.col("_high"))
        moved = (~new_low.eqNullSafe(F.col("_low"))) | (~new_high.eqNullSafe(F.col("_high")))
        next_ = written(parts.withColumn("_moved", moved).select(*keys, "_name", "_n", "_r", "_part", new_low.alias("_low"), new_high.alias("_high"), "_moved", "_m"))
        # a bracket that no longer moves is one value, or as few as the sketch can tell apart
        largest = next_.filter((F.col("_m") > few) & F.col("_moved")).agg(F.max(F.ceil(F.col("_m") * (4 / BUCKETS)))).first()[0]
        targets = next_.drop("_moved", "_m")

    kept = F.when((F.col("_low").isNull()) | (F.col("_v") >= F.col("_low")), F.col("_v"))  # what lies below falls into one
    counts = met(targets).filter(F.col("_high").isNull() | (F.col("_v") <= F.col("_high"))).groupBy(*keys, "_name", "_r", "_part", kept.alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    cum = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ends = counts.withColumn("_cum", cum).groupBy(*keys, "_name").agg(
        F.min(F.when(F.col("_cum") >= F.col("_r"), F.col("_at"))).alias("_a"), F.min(F.when(F.col("_cum") > F.col("_r"), F.col("_at"))).alias("_b"), F.first("_part").alias("_part")
    )
    found = ends.withColumn("_q", F.when((F.col("_part") > 0) & F.col("_b").isNotNull(), F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).otherwise(F.col("_a")))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in wanted])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *wanted)
