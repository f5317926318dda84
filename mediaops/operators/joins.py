"""Joins and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import unseen as unseen


def prioritised_lookup(df: DataFrame, cache: DataFrame, first: str, second: str, payload: str) -> DataFrame:
    """Payload by the first key, else by the second; hit_kind tells which."""
    a = cache.groupBy(first).agg(F.min(payload).alias("_a"))
    b = cache.groupBy(second).agg(F.min(payload).alias("_b"))
    met = df.join(a, first, "left").join(b, second, "left")
    kind = F.when(F.col("_a").isNotNull(), first).when(F.col("_b").isNotNull(), second).otherwise("miss")
    return met.withColumn("hit_kind", kind).withColumn("hit", F.coalesce("_a", "_b")).drop("_a", "_b")


def tiered_lookup(df: DataFrame, fast: DataFrame, slow: DataFrame, key: str, value: str) -> DataFrame:
    """tier and value of each key: fast, else slow, else miss. Rows of tier slow are what to backfill."""
    met = df.join(fast.select(key, F.col(value).alias("_f")), key, "left").join(slow.select(key, F.col(value).alias("_s")), key, "left")
    return met.withColumn("tier", F.when(F.col("_f").isNotNull(), "fast").when(F.col("_s").isNotNull(), "slow").otherwise("miss")).withColumn("found", F.coalesce("_f", "_s")).drop("_f", "_s")


def merge_recipes(hosts: DataFrame, overrides: DataFrame, defaults: dict[str, object], key: str) -> DataFrame:
    """Each host's settings: an override's field, where it has one, replaces the default as a whole."""
    met = hosts.join(overrides, key, "left")
    return met.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def normalise_recipe(df: DataFrame, map_col: str, known: dict[str, str]) -> DataFrame:
    """Settings of a text map as typed columns; ``fixes`` names keys dropped and values that were not of their type."""
    unknown = F.transform(F.filter(F.map_keys(map_col), lambda k: ~k.isin(list(known))), lambda k: F.concat(F.lit("dropped:"), k))
    typed = {c: F.col(map_col)[c].try_cast(t) for c, t in known.items()}
    wrong = [F.when(F.col(map_col)[c].isNotNull() & typed[c].isNull(), F.lit(f"type:{c}")) for c in known]
    return df.select(*[c for c in df.columns if c != map_col], *[v.alias(c) for c, v in typed.items()], F.concat(F.sort_array(unknown), F.array_compact(F.array(*wrong))).alias("fixes"))


def subscriptions(events: DataFrame, endpoints: DataFrame, tenant: str, kind: str, kinds: str) -> DataFrame:
    """Each event with each endpoint of its tenant that wants its kind."""
    return events.join(endpoints, tenant).filter(F.array_contains(F.col(kinds), F.col(kind)))


def purge(tables: dict[str, DataFrame], condition: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table, and a row with the number removed for each."""
    counts = [df.agg(F.lit(n).alias("table_name"), F.count_if(condition).alias("removed"), F.count_if(~F.coalesce(condition, F.lit(False))).alias("kept")) for n, df in tables.items()]
    return {n: df.filter(~F.coalesce(condition, F.lit(False))) for n, df in tables.items()}, reduce(DataFrame.unionByName, counts)
