"""Sinks: JSON, CSV, long metrics, tenant bundles, content-addressed and sidecar records, status reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_key


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table leaves no data rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def long_metrics(sections: dict[str, DataFrame]) -> DataFrame:
    """section, key, value of one-row tables of numbers."""
    parts = []
    for name, df in sections.items():
        doubles = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        parts.append(doubles.unpivot([], doubles.columns, "key", "value").select(F.lit(name).alias("section"), "key", "value"))
    return reduce(DataFrame.unionByName, parts)


def bundle(sections: dict[str, DataFrame], tenant: str, path: str | None = None) -> DataFrame:
    """Write each section parted by tenant (if a path is given); returns tenant, section, rows."""
    if path:
        for name, df in sections.items():
            df.write.mode("overwrite").partitionBy(tenant).json(f"{path}/{name}")
    return reduce(DataFrame.unionByName, [df.groupBy(F.col(tenant).alias("tenant")).agg(F.lit(n).alias("section"), F.count(F.lit(1)).alias("n_rows")) for n, df in sections.items()])


def content_addressed(df: DataFrame, content: str, tenant: Column, extension: str = "txt") -> DataFrame:
    return df.withColumn("object_key", content_key(F.col(content), tenant, extension)).withColumn("fan_out", F.substring(F.sha2(F.col(content), 256), 1, 2))


def sidecar(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, metadata: one JSON document a record."""
    return df.select(key, F.to_json(F.struct(*fields)).alias("metadata"))


def ingest_status(df: DataFrame, key: str, valid: Column, most: int, dry_run: bool, path: str | None = None) -> DataFrame:
    """key, ok, error of each item; good ones are appended unless it is a dry run. Over ``most`` items the batch is refused."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = df.crossJoin(F.broadcast(n)).withColumn("error", F.when(F.col("_n") > most, "batch_too_large").when(~F.coalesce(valid, F.lit(False)), "invalid")).drop("_n")
    if path and not dry_run:
        out.filter("error is null").drop("error").write.mode("append").parquet(path)
    return out.select(key, F.col("error").isNull().alias("ok"), "error")


def append_by_date(df: DataFrame, ts: str, path: str) -> None:
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)
