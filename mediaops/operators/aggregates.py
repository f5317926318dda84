"""Aggregations: usage summaries, exact rank percentiles, counters, reconciliation, elections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def request_summary(df: DataFrame, by: list[str], error: Column, time: str, *more: Column) -> DataFrame:
    """requests, errors, avg/min/max time and error_rate, per group of ``by`` (none: one row)."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(error).alias("errors"), F.avg(time).alias("avg_time"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), *more
    )
    return out.withColumn("error_rate", ratio(F.col("errors"), F.col("requests")))


def rank_percentile(df: DataFrame, by: list[str], value: str, p: float, name: str = "p", accuracy: int = 1000) -> DataFrame:
    """Exact ``sorted[int(n * p)]`` of each group of ``by`` (none: of all rows), the last value if that is past the end.

    Mergeable sketches say between which two values the place lies, wrong by a
    share of 1 / accuracy of the rows at most; twice that on either side surely holds
    it. What lies below is counted, and only the distinct values in between are put
    in order, a few thousandths of a group, however large or skewed it is."""
    rows = df.filter(F.col(value).isNotNull()).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col(value).alias("_v"))
    keys = [f"_k{i}" for i in range(len(by))]
    margin = 2 / accuracy
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))), accuracy)
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_e")).filter("_n > 0").select(*(F.col(k).alias(f"{k}b") for k in keys), "_n", F.col("_e")[0].alias("_low"), F.col("_e")[1].alias("_high"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys], F.lit(True))
    met = rows.join(bounds, same) if keys else rows.join(F.broadcast(bounds))  # one row of bounds
    place = F.least(F.floor(F.col("_n") * F.lit(p)) + 1, F.col("_n")).alias("_place")
    # values below the slice fall together into one
    at = F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_at")
    counts = met.filter(F.col("_v") <= F.col("_high")).groupBy(*keys, place, at).agg(F.count(F.lit(1)).alias("_c"))
    cum = F.sum("_c").over(Window.partitionBy(*keys, "_place").orderBy(F.col("_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("_cum", cum).filter(F.col("_cum") >= F.col("_place"))
    return hit.groupBy(*keys).agg(F.min("_at").alias(name)).select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), name)


def state_counts(df: DataFrame, state: str, states: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states])


def table_stats(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """rows, tenants, oldest, newest: one row a table, given as (rows, tenant column, time column)."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("total"), F.count_distinct(t).alias("tenants"), F.min(ts).alias("oldest"), F.max(ts).alias("newest")) for n, (df, t, ts) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def counters(df: DataFrame, scope: str, name: str, n: str) -> DataFrame:
    """Additive counters; a null counts as 0."""
    return df.groupBy(scope, name).agg(F.sum(F.coalesce(F.col(n), F.lit(0))).alias("n"))


def counter_maps(sums: DataFrame, scope: str, name: str) -> DataFrame:
    """Each scope's counters as one map; a scope has as many as there are names."""
    return sums.groupBy(scope).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n")))).alias("counters"))


def reconcile(df: DataFrame, tenant: str, n: Column) -> DataFrame:
    """Total of all rows beside the sum of tenants' totals, and the difference."""
    totals = df.rollup(tenant).agg(F.sum(n).alias("n"), F.grouping_id().alias("g"))
    return totals.agg(F.max(F.when(F.col("g") == 1, F.col("n"))).alias("total"), F.sum(F.when(F.col("g") == 0, F.col("n"))).alias("of_tenants")).withColumn("difference", F.col("total") - F.col("of_tenants"))


def site_stats(df: DataFrame, by: str, number: str, text: str, ts: str) -> DataFrame:
    """Numbers add up, texts are those of the latest row."""
    return df.groupBy(by).agg(F.sum(number).alias("total"), F.max_by(text, ts).alias("latest"))


def run_totals(df: DataFrame, found: Column, saved: Column, ts: str) -> DataFrame:
    one = df.agg(F.count_if(found).alias("found"), F.count_if(saved).alias("saved"), (F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(F.min(ts).cast("timestamp"))).alias("seconds"))
    return one.withColumn("success_fraction", ratio(F.col("saved"), F.col("found"))).withColumn("success_percent", ratio(F.col("saved") * 100, F.col("found"))).withColumn("per_second", F.when(F.col("seconds") > 0, F.col("found") / F.col("seconds")).otherwise(0.0))


def score_stats(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """n, mean, population deviation, min, max; zeros where there is nothing."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(F.count(score).alias("n"), z(F.avg(score)).alias("mean"), z(F.stddev_pop(score)).alias("std"), z(F.min(score)).alias("min"), z(F.max(score)).alias("max"))


def suggest_thresholds(stats: DataFrame) -> DataFrame:
    """One row from the statistics of same-group and cross-group pairs (``same`` true and false)."""
    one = stats.agg(*[F.max(F.when(F.col("same") == (side == "pos"), F.col(c))).alias(f"{side}_{c}") for side in ("pos", "neg") for c in ("mean", "std")])
    low, high = F.col("pos_mean") - 2 * F.col("pos_std"), F.col("neg_mean") + 2 * F.col("neg_std")
    return one.select(low.alias("conservative"), ((F.col("pos_mean") + F.col("neg_mean")) / 2).alias("balanced"), high.alias("aggressive"), F.when(low > high, "good separation").otherwise("poor separation").alias("recommendation"))


def stage_averages(df: DataFrame, stages: list[str]) -> DataFrame:
    long = df.unpivot([], stages, "stage", "value")
    return long.groupBy("stage").agg(F.round(F.avg("value"), 2).alias("avg_value"), F.count("value").alias("n"))


def health_rollup(df: DataFrame, name: str, status: str) -> DataFrame:
    worst = F.when(F.bool_or(F.col(status) == "unhealthy"), "unhealthy").when(F.bool_or(F.col(status) == "degraded"), "degraded").otherwise("healthy")
    named = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col(status) == s, F.col(name)))), ",")
    return df.agg(worst.alias("overall"), named("unhealthy").alias("unhealthy"), named("degraded").alias("degraded"), F.count(F.lit(1)).alias("checks"))


def elect_strategy(df: DataFrame, by: str, plain: str, scripted: str, factor: int = 3, least: int = 10) -> DataFrame:
    """Scripted rendering wins with ``least`` candidates and ``factor`` times the plain ones."""
    sums = df.groupBy(by).agg(F.sum(plain).alias("plain"), F.sum(scripted).alias("scripted"))
    return sums.withColumn("strategy", F.when(F.col("scripted") >= F.greatest(F.lit(least), factor * F.col("plain")), "js").otherwise("http"))


def evidence_score(repeats: Column, duration: Column, href: Column, hints: Column, srcset: Column) -> Column:
    """0 to 1 from five counts; each has a full weight from some count on and a share of it below."""
    part = lambda c, full, weight: F.when(c >= full, weight).otherwise(F.greatest(c, F.lit(0)) / full)
    r = F.when(repeats >= 12, 2.0).when(repeats >= 6, 1.0).otherwise(repeats / 12)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r + part(duration, 3, 2.0) + part(href, 3, 2.0) + part(hints, 3, 1.0) + part(srcset, 5, 1.0)) / 8))


def utilisation(df: DataFrame, by: str, capacity: int, limit: float = 75.0) -> DataFrame:
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("depth"))
    return n.withColumn("percent", F.col("depth") * 100 / capacity).withColumn("over", F.col("percent") > limit)


def centroids(df: DataFrame, group: str, vector: str, least: int = 2) -> DataFrame:
    """Unit mean vector of each group with ``least`` members or more; others are reported without one.

    Means are taken by place, so no group is gathered."""
    places = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("members"))
    made = places.groupBy(group).agg(F.max("members").alias("members"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return made.withColumn("norm", norm).select(group, "members", F.when(F.col("members") >= least, F.transform("mean", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x))).alias("centroid"))
