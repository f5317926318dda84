"""Changes as rewrites: upserts, selective updates, migrations, retention. Nothing reads and overwrites one path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, change: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Latest row of each key; on equal versions the change wins."""
    both = base.withColumn("_new", F.lit(0)).unionByName(change.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*[F.col(v).desc_nulls_last() for v in version], F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def apply_updates(df: DataFrame, change: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that the change sets replace the old ones; null leaves them as they are."""
    met = df.join(change.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def soft_delete(df: DataFrame, gone: DataFrame, key: str, status: str) -> DataFrame:
    met = df.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return met.withColumn(status, F.when(F.col("_gone"), "deleted").otherwise(F.col(status))).drop("_gone")


def migrate(df: DataFrame, col: str, old, new, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with ``old`` renamed to ``new`` (not in a dry run), and counts before and after."""
    moved = df.withColumn(col, F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(F.col(col)))
    count = lambda d, label: d.agg(F.lit(label).alias("moment"), F.count_if(F.col(col) == F.lit(old)).alias("n_old"), F.count_if(F.col(col) == F.lit(new)).alias("n_new"))
    out = df if dry_run else moved
    return out, count(df, "before").unionByName(count(out, "after"))


def expired(ts: str, as_of, days: int) -> Column:
    return F.col(ts) < F.lit(as_of) - F.make_dt_interval(F.lit(days))


def retain(df: DataFrame, ts: str, as_of, days: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many go."""
    old = F.coalesce(expired(ts, as_of, days), F.lit(False))
    return df.filter(~old), df.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def failure_retention_days(days: int) -> int:
    """Failures stay four times as long, 30 days at least."""
    return max(4 * days, 30)


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def job_rollup(outcomes: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, outcomes).groupBy("policy").agg(F.sum("deleted").alias("deleted"), F.sum("kept").alias("kept"))


def retention_preview(df: DataFrame, bucket: str, size: str, old: Column) -> DataFrame:
    """Objects and bytes that would go, per bucket and in all (bucket null)."""
    return df.filter(old).rollup(bucket).agg(F.count(F.lit(1)).alias("objects"), F.sum(size).alias("bytes"))
