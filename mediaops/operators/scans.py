"""Running values of keys of any size: a parallel prefix scan.

Rows are range-partitioned by (key, order), so that a hot key's rows lie in several slices,
each a stretch of its order. Running values are computed inside slices; each slice is
folded to a few numbers, the folds of a key's slices are scanned, and what comes before a
slice is added to its rows. No task holds more of a key than its slice. A slice continues
at most one key of the slice before it, so at most one row a slice is carried: that bounds the broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written

SLICE = "_slice"


def prefix_scan(df: DataFrame, by: list[str], order: list[str], local: dict[str, Callable[[WindowSpec], Column]], folds: dict[str, Column], carried: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``df`` with its ``local`` values, and the ``carried`` ones of what comes before a row's slice (null in a key's first slice).

    ``local``: columns over a window of one slice, in order, each may use those before it. ``folds``:
    aggregates of a slice. ``carried``: columns over a window of a key's earlier folds. ``order`` must tell a
    key's rows apart; rows that tie in it stay in one slice. Null keys are a key of their own."""
    parts = df.repartitionByRange(*by, *order).withColumn(SLICE, F.spark_partition_id())
    inside = Window.partitionBy(*by, SLICE).orderBy(*order)
    for name, value in local.items():
        parts = parts.withColumn(name, value(inside))
    parts = written(parts)
    each = parts.groupBy(*by, SLICE).agg(*[value.alias(name) for name, value in folds.items()])
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    kept = each.withColumn("_earlier", F.count(F.lit(1)).over(before))
    for name, value in carried.items():
        kept = kept.withColumn(name, value(before))
    kept = kept.filter("_earlier > 0").select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], F.col(SLICE).alias("_of"), *carried)
    same = F.col(SLICE) == F.col("_of")
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"_by{i}"))
    return parts.join(F.broadcast(kept), same, "left").drop("_of", *[f"_by{i}" for i in range(len(by))])


def _so_far(value: Callable[[], Column]) -> Callable[[WindowSpec], Column]:
    return lambda w: value().over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a running sum of each column, this row included; nulls count as 0."""
    values = {n: F.coalesce(v, F.lit(0)) for n, v in sums.items()}
    local = {f"_in_{n}": _so_far(lambda v=v: F.sum(v)) for n, v in values.items()}
    folds = {f"_all_{n}": F.max(F.struct(*order, f"_in_{n}"))[f"_in_{n}"] for n in sums}
    carried = {f"_to_{n}": (lambda w, n=n: F.sum(f"_all_{n}").over(w)) for n in sums}
    out = prefix_scan(df, by, order, local, folds, carried)
    return out.select(*df.columns, *[(F.col(f"_in_{n}") + F.coalesce(f"_to_{n}", F.lit(0))).alias(n) for n in sums])


def row_before(df: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """``df`` with ``name``, the value of a key's row before; null at its first row."""
    local = {"_value": lambda w: value, "_lag": lambda w: F.lag("_value").over(w), "_first": lambda w: F.row_number().over(w) == 1}
    folds = {"_last": F.max(F.struct(*order, "_value"))["_value"]}
    out = prefix_scan(df, by, order, local, folds, {"_to": lambda w: F.last("_last").over(w)})
    return out.select(*df.columns, F.when(F.col("_first"), F.col("_to")).otherwise(F.col("_lag")).alias(name))


def sum_and_low(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """``df`` with _sum, the running sum, and _low, its smallest value so far. A slice folds to its sum and its smallest prefix."""
    local = {"_in": _so_far(lambda: F.sum(F.coalesce(value, F.lit(0)))), "_in_low": _so_far(lambda: F.min("_in"))}
    folds = {"_all": F.max(F.struct(*order, "_in"))["_in"], "_least": F.min("_in")}
    # a slice's smallest prefix counts from the sum of those before it
    carried = {"_to": lambda w: F.sum("_all").over(w), "_reached": lambda w: F.min(F.col("_least") + F.coalesce("_to", F.lit(0))).over(w)}
    out = prefix_scan(df, by, order, local, folds, carried)
    total = F.col("_in") + F.coalesce("_to", F.lit(0))
    low = F.least(F.col("_in_low") + F.coalesce("_to", F.lit(0)), F.col("_reached"))
    return out.select(*df.columns, total.alias("_sum"), low.alias("_low"))
