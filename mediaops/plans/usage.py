"""Audit and usage queries over events, orders, customers: scans, filters, aggregates, windows, sorts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import cache_key, clean_key, human_bytes, iso8601, ratio, typed
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import quantiles as Q
from ..operators import windows as W
from ..sources import readers, writers
from ..sources.shared import shared_path
from .registry import Tables, query

START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)


def error():
    return F.col("event_type") == "error"


def _k(df: DataFrame) -> DataFrame:
    return readers.json_fields(df, "props", {"k": "int"})


SUMMARY = """count(*) AS requests, count_if(event_type = 'error') AS errors, round(avg(value), 4) AS avg_time, min(value) AS min_time, max(value) AS max_time,
  round(count_if(event_type = 'error') / greatest(count(*), 1), 6) AS error_rate"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_time", F.round("avg_time", 4)).withColumn("error_rate", F.round("error_rate", 6))


P95 = """SELECT {by} min(value) AS {name} FROM (
  SELECT {by} value, sum(c) OVER (PARTITION BY {part} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(c) OVER (PARTITION BY {part}) AS n
  FROM (SELECT {by} value, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY {by} value)
) WHERE cum >= least(floor(n * {p}) + 1, n) {group}"""


@query("entry_tenant_usage", f"""WITH p AS ({P95.format(by='user_id,', part='user_id', p=0.95, name='p95', group='GROUP BY user_id')})
SELECT e.user_id, {SUMMARY}, any_value(p.p95) AS p95 FROM events e LEFT JOIN p ON p.user_id = e.user_id GROUP BY e.user_id""")
def tenant_usage(t: Tables) -> DataFrame:
    e = t.events
    return _rounded(A.request_summary(e, ["user_id"], error(), "value")).join(A.rank_percentile(e, ["user_id"], "value", 0.95, "p95"), "user_id", "left")


@query("s1_scan_projection", "SELECT event_id, user_id, event_type, value FROM events")
def s1(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value")


@query("s2_json_payload", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def s2(t: Tables) -> DataFrame:
    return _k(t.events).select("event_id", "k")


@query("s9_long_metrics", """WITH a AS (SELECT count(*)::DOUBLE AS requests, count_if(event_type = 'error')::DOUBLE AS errors, round(avg(value), 4) AS avg_time FROM events),
b AS (SELECT count(DISTINCT user_id)::DOUBLE AS tenants FROM events)
SELECT 'requests' AS section, key, value FROM (UNPIVOT a ON requests, errors, avg_time INTO NAME key VALUE value)
UNION ALL SELECT 'tenants', key, value FROM (UNPIVOT b ON tenants INTO NAME key VALUE value)""")
def s9(t: Tables) -> DataFrame:
    e = t.events
    return writers.long_metrics({"requests": e.agg(F.count(F.lit(1)).alias("requests"), F.count_if(error()).alias("errors"), F.round(F.avg("value"), 4).alias("avg_time")), "tenants": e.agg(F.count_distinct("user_id").alias("tenants"))})


@query("s8_bundle_manifest", """SELECT c_custkey AS tenant, 'customer' AS section, count(*) AS n_rows FROM customer GROUP BY 1
UNION ALL SELECT o_custkey, 'orders', count(*) FROM orders GROUP BY 1
UNION ALL SELECT o_custkey, 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def s8(t: Tables) -> DataFrame:
    o = t.orders
    return writers.bundle({"customer": t.customer.select(F.col("c_custkey").alias("tenant")), "orders": o.select(F.col("o_custkey").alias("tenant")), "lineitem": t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("tenant"))}, "tenant")


@query("s8_tenant_bundle", """SELECT c_nationkey AS tenant, 'customer' AS section, c_custkey AS item, round(c_acctbal, 2) AS amount FROM customer
UNION ALL SELECT c_nationkey, 'orders', o_orderkey, round(o_totalprice, 2) FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT c_nationkey, 'lineitem', l_orderkey * 10 + l_linenumber, round(l_extendedprice, 2) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""")
def s8_bundle(t: Tables) -> DataFrame:
    """The bundle itself: each section with its joined children, written by tenant (a nation here) and read back."""
    c = t.customer
    o = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"))
    line = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    row = lambda df, item, amount: df.select(F.col("c_nationkey").cast("long").alias("tenant"), F.expr(item).cast("long").alias("item"), F.round(amount, 2).alias("amount"))
    sections = {"customer": row(c, "c_custkey", "c_acctbal"), "orders": row(o, "o_orderkey", "o_totalprice"), "lineitem": row(line, "l_orderkey * 10 + l_linenumber", "l_extendedprice")}
    path = shared_path(t.spark)
    writers.bundle(sections, "tenant", path)
    parts = [t.spark.read.schema("item long, amount double, tenant long").json(f"{path}/{name}").withColumn("section", F.lit(name)) for name in sections]
    return reduce(DataFrame.unionByName, parts).select("tenant", "section", "item", "amount")


@query("p1_optional_filters", "SELECT event_id, user_id, ts::VARCHAR AS ts FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def p1(t: Tables) -> DataFrame:
    kept = P.optional_filters(t.events, "event_type", "ts", "purchase", START, END)
    return kept.select("event_id", "user_id", F.col("ts").cast("string").alias("ts"))


@query("p2_tenant_scope", "SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type = 'click'")
def p2(t: Tables) -> DataFrame:
    return P.scoped(t.events, 7, site="click", tenant_col="user_id", site_col="event_type").select("event_id", "event_type")


@query("p3_payload_allow_list", "SELECT ts::VARCHAR AS ts FROM events")
def p3(t: Tables) -> DataFrame:
    return P.allowed_columns(t.events).select(F.col("ts").cast("string").alias("ts"))


@query("p10_required_fields", """SELECT event_id, CASE WHEN len(m) > 0 THEN 'missing: ' || array_to_string(m, ',') END AS error
FROM (SELECT event_id, list_filter([CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN coalesce(trim(event_type), '') = '' THEN 'event_type' END, CASE WHEN k IS NULL THEN 'k' END], lambda x: x IS NOT NULL) AS m
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN (props::JSON->>'k')::INT END AS k FROM events))""")
def p10(t: Tables) -> DataFrame:
    marked = _k(t.events).withColumn("k", F.when(F.col("event_type") != "error", F.col("k")))
    good, bad = P.split_valid(marked, ["user_id", "event_type", "k"])
    return bad.select("event_id", "error").unionByName(good.select("event_id", F.lit(None).cast("string").alias("error")))


@query("p17_visible_tenants", "SELECT c_custkey, lower(c_mktsegment) AS status FROM customer WHERE lower(c_mktsegment) <> 'machinery' AND lower(c_mktsegment) = 'building'")
def p17(t: Tables) -> DataFrame:
    c = t.customer.withColumn("status", F.lower("c_mktsegment"))
    shown = c.withColumn("s", F.when(F.col("status") == "machinery", "deleted").otherwise(F.col("status")))
    return shown.filter(P.visible(F.col("s"), "building")).select("c_custkey", "status")


@query("p18_partial_index", "SELECT event_id, TRUE AS has_hash, event_type = 'error' AS is_error, coalesce((props::JSON->>'k')::INT = 0, FALSE) AS no_result FROM events")
def p18(t: Tables) -> DataFrame:
    return _k(t.events).select("event_id", *P.partial_index_flags(F.col("props"), F.when(error(), 500).otherwise(200), F.col("k")))


@query("p19_recommendations", f"""WITH p AS ({P95.format(by='user_id,', part='user_id', p=0.95, name='p95', group='GROUP BY user_id')}),
m AS (SELECT e.user_id, any_value(p95) AS p95, round(avg(value), 4) AS avg, count_if(event_type = 'error') AS errors, count(*) AS requests, count_if(value > 100) AS violations FROM events e LEFT JOIN p USING (user_id) GROUP BY e.user_id)
SELECT user_id, 'latency' AS category, 'high' AS priority FROM m WHERE p95 > 60 UNION ALL SELECT user_id, 'average', 'medium' FROM m WHERE avg > 30
UNION ALL SELECT user_id, 'reliability', 'high' FROM m WHERE errors / greatest(requests, 1) > 0.05 UNION ALL SELECT user_id, 'limits', 'medium' FROM m WHERE violations > 0""")
def p19(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("avg"), F.count_if(error()).alias("errors"), F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") > 100).alias("violations"))
    return P.recommendations(m.join(A.rank_percentile(t.events, ["user_id"], "value", 0.95, "p95"), "user_id", "left"), 60.0).select("user_id", "category", "priority")


@query("p20_threshold_status", "SELECT event_id, CASE WHEN value > 50 THEN 'warning' ELSE 'ok' END AS status FROM events")
def p20(t: Tables) -> DataFrame:
    return t.events.select("event_id", P.threshold_status(F.col("value"), 50.0).alias("status"))


@query("p21_tenant_format", "SELECT event_id, length(trim(user_id::VARCHAR)) >= 3 AS ok FROM events")
def p21(t: Tables) -> DataFrame:
    return t.events.select("event_id", P.tenant_ok(F.col("user_id")).alias("ok"))


@query("a1_request_summary", f"SELECT {SUMMARY}, count(DISTINCT user_id) AS tenants, count(DISTINCT event_type) AS methods FROM events")
def a1(t: Tables) -> DataFrame:
    return _rounded(A.request_summary(t.events, [], error(), "value", F.count_distinct("user_id").alias("tenants"), F.count_distinct("event_type").alias("methods")))


@query("a2_by_operation", "SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::INT) AS results, round(avg(value), 4) AS avg_value FROM events GROUP BY event_type")
def a2(t: Tables) -> DataFrame:
    return _k(t.events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("results"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("a3_by_tenant", f"SELECT user_id, {SUMMARY} FROM events GROUP BY user_id")
def a3(t: Tables) -> DataFrame:
    return _rounded(A.request_summary(t.events, ["user_id"], error(), "value")).orderBy(F.col("requests").desc(), "user_id")


@query("a4_hourly", "SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    return t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("a5_tenant_profile", "SELECT count(*) AS n, count_if(event_type = 'error') AS errors, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen FROM events WHERE user_id = 7")
def a5(t: Tables) -> DataFrame:
    return P.scoped(t.events, 7, tenant_col="user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(error()).alias("errors"), F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"))


@query("a6_by_status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a7_state_counts", "SELECT count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'P') AS n_p FROM orders")
def a7(t: Tables) -> DataFrame:
    return A.state_counts(t.orders, "o_orderstatus", ["O", "F", "P"])


@query("a8_table_stats", """SELECT 'events' AS table_name, count(*) AS total, count(DISTINCT user_id) AS tenants, min(ts)::VARCHAR AS oldest, max(ts)::VARCHAR AS newest FROM events
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), min(o_orderdate)::VARCHAR, max(o_orderdate)::VARCHAR FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_suppkey), min(l_shipdate)::VARCHAR, max(l_shipdate)::VARCHAR FROM lineitem""")
def a8(t: Tables) -> DataFrame:
    s = A.table_stats({"events": (t.events, "user_id", "ts"), "orders": (t.orders, "o_custkey", "o_orderdate"), "lineitem": (t.lineitem, "l_suppkey", "l_shipdate")})
    return s.withColumn("oldest", F.col("oldest").cast("string")).withColumn("newest", F.col("newest").cast("string"))


@query("a9_counters", "SELECT user_id, event_type AS name, sum(coalesce((props::JSON->>'k')::INT, 0)) AS n FROM events GROUP BY 1, 2")
def a9(t: Tables) -> DataFrame:
    return A.counters(_k(t.events).withColumnRenamed("event_type", "name"), "user_id", "name", "k")


@query("a9_counter_maps", """SELECT user_id, '{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}' AS counters
FROM (SELECT user_id, event_type AS name, sum(coalesce((props::JSON->>'k')::INT, 0)) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def a9_maps(t: Tables) -> DataFrame:
    return A.counter_maps(a9(t), "user_id", "name").select("user_id", F.to_json("counters").alias("counters"))


@query("a10_reconcile", """WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n FROM events)
SELECT (SELECT sum(n) FROM e)::BIGINT AS total, sum(n)::BIGINT AS of_tenants, ((SELECT sum(n) FROM e) - sum(n))::BIGINT AS difference FROM (SELECT user_id, sum(n) AS n FROM e GROUP BY user_id)""")
def a10(t: Tables) -> DataFrame:
    """Cost units: an error costs two."""
    return A.reconcile(t.events, "user_id", F.when(F.col("event_type") == "error", 2).otherwise(1))


@query("a11_site_stats", "SELECT user_id, sum((props::JSON->>'k')::INT) AS total, max_by(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1")
def a11(t: Tables) -> DataFrame:
    e = _k(t.events).withColumn("at", F.struct("ts", "event_id"))
    return A.site_stats(e, "user_id", "k", "event_type", "at")


@query("a12_run_totals", """SELECT *, round(saved / greatest(found, 1), 6) AS success_fraction, round(saved * 100 / greatest(found, 1), 6) AS success_percent, round(CASE WHEN seconds > 0 THEN found / seconds ELSE 0 END, 6) AS per_second
FROM (SELECT count(*) AS found, count_if(event_type = 'purchase') AS saved, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS seconds FROM events)""")
def a12(t: Tables) -> DataFrame:
    r = A.run_totals(t.events, F.lit(True), F.col("event_type") == "purchase", "ts")
    return r.select("found", "saved", "seconds", *[F.round(c, 6).alias(c) for c in ("success_fraction", "success_percent", "per_second")])


@query("a13_consistency", "SELECT count_if(keys < n) AS mismatches FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS keys, count(*) AS n FROM lineitem GROUP BY 1)")
def a13(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("keys"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("keys") < F.col("n")).alias("mismatches"))


for _p in (50, 95, 99):
    query(f"a14_p{_p}_by_tenant", P95.format(by="user_id,", part="user_id", p=_p / 100, name="p", group="GROUP BY user_id"))(lambda t, p=_p: A.rank_percentile(t.events, ["user_id"], "value", p / 100))


@query("a14_p95_all", P95.format(by="", part="1", p=0.95, name="p", group=""))
def a14_all(t: Tables) -> DataFrame:
    return A.rank_percentile(t.events, [], "value", 0.95)


@query("a15_mean_median", "SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM events GROUP BY 1")
def a15(t: Tables) -> DataFrame:
    means = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    return means.join(Q.quantiles(t.events, ["event_type"], "value", {"median": 0.5}), "event_type").select("event_type", "mean", F.round("median", 4).alias("median"))


@query("a18_retention_preview", "SELECT source AS bucket, count(*) AS objects, sum(n_chars) AS bytes FROM documents WHERE n_chars > 100 GROUP BY ROLLUP (source)")
def a18(t: Tables) -> DataFrame:
    return A_preview(t.documents.withColumnRenamed("source", "bucket"))


def A_preview(d: DataFrame) -> DataFrame:
    from ..operators.changes import retention_preview

    return retention_preview(d, "bucket", "n_chars", F.col("n_chars") > 100)


@query("a19_stage_averages", """SELECT stage, round(avg(value), 2) AS avg_value, count(value) AS n FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME stage VALUE value) GROUP BY stage""")
def a19(t: Tables) -> DataFrame:
    return A.stage_averages(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query("a20_shard_stats", "SELECT substr(md5(text), 1, 4) AS prefix, count(DISTINCT md5(text)) AS hashes, count(*) AS n FROM documents GROUP BY 1")
def a20(t: Tables) -> DataFrame:
    h = t.documents.select(F.md5(F.col("text").cast("binary")).alias("h"))
    return h.groupBy(F.substring("h", 1, 4).alias("prefix")).agg(F.count_distinct("h").alias("hashes"), F.count(F.lit(1)).alias("n"))


@query("a21_batch_stats", """SELECT count(*) AS total, count_if(o_orderstatus = 'F') AS completed, count_if(o_orderdate >= TIMESTAMP '1998-01-01') AS recent, count_if(o_orderdate >= TIMESTAMP '1997-01-01') AS last_year,
round(avg(o_totalprice), 4) AS avg_size, round(count_if(o_orderstatus = 'F') / greatest(count(*), 1), 6) AS success FROM orders""")
def a21(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderdate") >= F.lit(dt.datetime(1998, 1, 1))).alias("recent"),
        F.count_if(F.col("o_orderdate") >= F.lit(dt.datetime(1997, 1, 1))).alias("last_year"), F.round(F.avg("o_totalprice"), 4).alias("avg_size"),
        F.round(ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))), 6).alias("success"),
    )


@query("a23_health", """WITH s AS (SELECT o_orderpriority AS name, CASE WHEN avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) > 0.5 THEN 'healthy' WHEN count(*) % 2 = 0 THEN 'degraded' ELSE 'unhealthy' END AS status FROM orders GROUP BY 1)
SELECT CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'healthy' END AS overall,
coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'unhealthy'), '') AS unhealthy, coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'degraded'), '') AS degraded, count(*) AS checks FROM s""")
def a23(t: Tables) -> DataFrame:
    done = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    s = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.when(done > 0.5, "healthy").when(F.count(F.lit(1)) % 2 == 0, "degraded").otherwise("unhealthy").alias("status"))
    return A.health_rollup(s, "name", "status")


@query("a27_delivery_stats", "SELECT user_id, count_if(event_type <> 'error') AS delivered, count_if(event_type = 'error') AS failed, round(count_if(event_type <> 'error') / greatest(count(*), 1), 6) AS success_rate FROM events GROUP BY 1")
def a27(t: Tables) -> DataFrame:
    r = t.events.groupBy("user_id").agg(F.count_if(~error()).alias("delivered"), F.count_if(error()).alias("failed"))
    return r.withColumn("success_rate", F.round(ratio(F.col("delivered"), F.col("delivered") + F.col("failed")), 6))


@query("a29_best_configuration", "SELECT max_by(user_id, (r, user_id)) AS best, max(r) AS rate FROM (SELECT user_id, round(avg(value), 4) AS r FROM events GROUP BY 1)")
def a29(t: Tables) -> DataFrame:
    r = t.events.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("r"))
    return r.agg(F.max_by("user_id", F.struct("r", "user_id")).alias("best"), F.max("r").alias("rate"))


@query("a30_utilisation", "SELECT o_orderstatus, count(*) AS depth, round(count(*) * 100 / 8000, 6) AS percent, count(*) * 100 / 8000 > 75 AS over FROM orders GROUP BY 1")
def a30(t: Tables) -> DataFrame:
    return A.utilisation(t.orders, "o_orderstatus", 8000).withColumn("percent", F.round("percent", 6))


@query("a32_endpoint_metrics", f"""WITH p AS ({P95.format(by='event_type,', part='event_type', p=0.95, name='p95', group='GROUP BY event_type')})
SELECT e.event_type, {SUMMARY}, any_value(p95) AS p95 FROM events e LEFT JOIN p USING (event_type) GROUP BY e.event_type""")
def a32(t: Tables) -> DataFrame:
    return _rounded(A.request_summary(t.events, ["event_type"], error(), "value")).join(A.rank_percentile(t.events, ["event_type"], "value", 0.95, "p95"), "event_type", "left")


@query("a33_overview", "SELECT (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS tenants, (SELECT count(*) FROM orders) AS orders, (SELECT round(sum(o_totalprice), 2) FROM orders) AS amount")
def a33(t: Tables) -> DataFrame:
    e = t.events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("tenants"))
    return e.crossJoin(t.orders.agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount")))  # one row each


@query("w1_last_samples", "SELECT user_id, count(*) AS n, round(avg(value), 4) AS avg_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY 1")
def w1(t: Tables) -> DataFrame:
    return W.top_n(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("w3_gaps", """SELECT event_id, round(gap, 6) AS gap, round(greatest(0, gap - value), 6) AS idle FROM (
SELECT event_id, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) WHERE gap IS NOT NULL""")
def w3(t: Tables) -> DataFrame:
    return W.gaps(t.events, ["user_id"], "ts", "event_id", F.col("value")).filter("gap is not null").select("event_id", F.round("gap", 6).alias("gap"), F.round("idle", 6).alias("idle"))


@query("w5_best_of_group", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem WHERE l_quantity > 10) WHERE rn = 1")
def w5(t: Tables) -> DataFrame:
    return W.top_n(t.lineitem.filter("l_quantity > 10"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 1).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("w6_running_success", """SELECT event_id, so_far, round(ok / so_far, 6) AS success_rate, so_far >= 10 AND 1 - ok / so_far > 0.25 AS tripped FROM (
SELECT event_id, count(*) OVER w AS so_far, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def w6(t: Tables) -> DataFrame:
    return W.running_success(t.events, ["user_id"], "ts", "event_id", ~error(), 10, 0.25).select("event_id", "so_far", F.round("success_rate", 6).alias("success_rate"), "tripped")


@query("w7_adaptive_tier", """SELECT user_id, CASE WHEN a < 200 AND s > 0.95 THEN 50 WHEN a > 1000 OR s < 0.7 THEN 10 ELSE 20 END AS connections FROM (
SELECT user_id, avg(value) * 10 AS a, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100 GROUP BY 1)""")
def w7(t: Tables) -> DataFrame:
    last = W.top_n(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 100)
    m = last.groupBy("user_id").agg((F.avg("value") * 10).alias("a"), F.avg(F.when(~error(), 1.0).otherwise(0.0)).alias("s"))
    return m.select("user_id", W.connection_tier(F.col("a"), F.col("s")).alias("connections"))


@query("w8_latest_version", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w8(t: Tables) -> DataFrame:
    return W.top_n(t.events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 1).select("user_id", "event_type", "event_id", "value")


@query("w9_floored_counter", """SELECT event_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS level FROM (
SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)""")
def w9(t: Tables) -> DataFrame:
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return W.floored_counter(t.events, ["user_id"], "ts", "event_id", delta).select("event_id", "level")


@query("t1_newest_first", "SELECT event_id, ts::VARCHAR AS at FROM events ORDER BY ts DESC, event_id DESC")
def t1(t: Tables) -> DataFrame:
    """The whole log, newest first: a range-partitioned sort."""
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).select("event_id", F.col("ts").cast("timestamp_ntz").cast("string").alias("at"))


@query("t2_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def t2(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query("t3_top_by_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def t3(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(20)


@query("t9_largest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def t9(t: Tables) -> DataFrame:
    return t.documents.orderBy(F.col("n_chars").desc(), "doc_id").limit(10).select("doc_id", "n_chars")


@query("u1_union_all", "SELECT user_id AS id, 'event' AS kind FROM events UNION ALL SELECT o_custkey, 'order' FROM orders")
def u1(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("id"), F.lit("event").alias("kind")).unionByName(t.orders.select(F.col("o_custkey").alias("id"), F.lit("order").alias("kind")))


@query("u5_completeness", "SELECT count(*) AS missing, count(*) = 0 AS complete FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL))")
def u5(t: Tables) -> DataFrame:
    gone = t.customer.select(F.col("c_custkey").alias("user_id")).distinct().join(t.events.select("user_id").distinct(), "user_id", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("missing"), (F.count(F.lit(1)) == 0).alias("complete"))


@query("f1_cache_key", "SELECT event_id, 'emb:' || user_id || ':' || substr(sha256(event_type), 1, 16) || ':k:' || (props::JSON->>'k') AS key FROM events")
def f1(t: Tables) -> DataFrame:
    return _k(t.events).select("event_id", cache_key("emb", F.col("event_type"), F.col("user_id"), k=F.col("k")).alias("key"))


@query("f23_clean_key", "SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS name FROM customer")
def f23(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", clean_key(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name"))


@query("f24_epochs", "SELECT event_id, epoch_us(ts) AS micros, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def f24(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), iso8601(F.col("ts")).alias("iso"))


@query("f25_human_bytes", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KB', n_chars / 1024.0) END AS size FROM documents")
def f25(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", human_bytes(F.col("n_chars")).alias("size"))


@query("f27_ratio", "SELECT user_id, round(sum(value) / greatest(count_if(event_type = 'purchase'), 1), 4) AS r FROM events GROUP BY 1")
def f27(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(ratio(F.sum("value"), F.count_if(F.col("event_type") == "purchase")), 4).alias("r"))


@query("f28_typed", "SELECT event_id, CASE WHEN x SIMILAR TO '[0-9]+' THEN x::BIGINT END AS as_long, CASE WHEN x SIMILAR TO '[0-9]+' THEN NULL ELSE TRY_CAST(x AS DOUBLE) END AS as_double, CASE WHEN TRY_CAST(x AS DOUBLE) IS NULL THEN x END AS as_text FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (props::JSON->>'k') WHEN 1 THEN (event_id // 8 + 0.25)::DECIMAL(12,2)::VARCHAR ELSE event_type END AS x FROM events)")
def f28(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, F.col("k").cast("string")).when(F.col("event_id") % 3 == 1, (F.floor(F.col("event_id") / 8) + F.lit(0.25)).cast("decimal(12,2)").cast("string")).otherwise(F.col("event_type"))
    return _k(t.events).select("event_id", typed(x).alias("t")).select("event_id", "t.*")


# ---- sinks, read back -----------------------------------------------------


@query("s6_json_export", "SELECT event_id, event_type, value FROM events")
def s6(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    rows = t.events.select("event_id", "event_type", "value")
    writers.to_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("s7_csv_export", "SELECT event_id, event_type, value FROM events")
def s7(t: Tables) -> DataFrame:
    path = shared_path(t.spark)
    rows = t.events.select("event_id", "event_type", "value")
    writers.to_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("s16_audit_append", "SELECT ts::DATE::VARCHAR AS date, count(*) AS n FROM events GROUP BY 1")
def s16(t: Tables) -> DataFrame:
    """Two appends, one of errors and one of the rest, into one log parted by date."""
    path = shared_path(t.spark)
    for rows in (t.events.filter(error()), t.events.filter(~error())):
        writers.append_by_date(rows.select("event_id", "ts"), "ts", path)
    return t.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("j14_recipe_fixes", """SELECT event_id, CASE WHEN event_type <> 'error' THEN (props::JSON->>'k')::INT END AS k, array_to_string(list_filter(['dropped:kind', CASE WHEN event_type = 'error' THEN 'type:k' END], lambda x: x IS NOT NULL), ',') AS fixes FROM events""")
def j14(t: Tables) -> DataFrame:
    """Each event's payload as a settings map with a key too many; an error's value is not a number."""
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.when(error(), F.lit("n/a")).otherwise(F.col("k").cast("string")))
    fixed = J.normalise_recipe(_k(t.events).select("event_id", m.alias("m")), "m", {"k": "int"})
    return fixed.select("event_id", "k", F.array_join("fixes", ",").alias("fixes"))
