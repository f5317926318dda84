"""Joins, changes, retention, duplicates and vectors over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import changes as C
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import quantiles as Q
from ..operators import vectors as V
from ..operators import windows as W
from ..sources import writers
from ..sources.filetable import FileTable
from ..sources.shared import shared_path
from .registry import Tables, query

AS_OF = dt.datetime(2024, 1, 25)
CUTOFF = "TIMESTAMP '2024-01-25' - INTERVAL 7 DAY"


# ---- joins ----------------------------------------------------------------


@query("j1_child_parent", "SELECT l_orderkey, l_linenumber, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j1(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_totalprice")


@query("j2_top_tenants", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, c_custkey LIMIT 20")
def j2(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).orderBy(F.col("n").desc(), "c_custkey").limit(20)


@query("j3_unseen_urls", "SELECT page_id, u FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u, url FROM pages) WHERE u NOT IN (SELECT url FROM pages WHERE regexp_replace(url, '[;?#].*$', '') = url)")
def j3(t: Tables) -> DataFrame:
    p = t.pages.withColumn("u", S.normalize_url(F.col("url")))
    return J.unseen(p, p.filter("u = url").select("u"), "u").select("page_id", "u")


@query("j4_orphans", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def j4(t: Tables) -> DataFrame:
    return J.unseen(t.embeddings, t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id").select("vec_id")


@query("j5_prioritised_lookup", """WITH c AS (SELECT md5(doc_id::VARCHAR) AS uh, md5(text) AS ch, doc_id FROM documents JOIN labels USING (doc_id)),
a AS (SELECT uh, min(doc_id) AS x FROM c GROUP BY 1), b AS (SELECT ch, min(doc_id) AS x FROM c GROUP BY 1)
SELECT d.doc_id, CASE WHEN a.x IS NOT NULL THEN 'uh' WHEN b.x IS NOT NULL THEN 'ch' ELSE 'miss' END AS hit_kind, coalesce(a.x, b.x) AS hit FROM documents d LEFT JOIN a ON a.uh = md5(d.doc_id::VARCHAR) LEFT JOIN b ON b.ch = md5(d.text)""")
def j5(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("uh"), F.md5(F.col("text").cast("binary")).alias("ch"))
    cache = d.join(t.labels.select("doc_id"), "doc_id").withColumnRenamed("doc_id", "payload")
    return J.prioritised_lookup(d, cache, "uh", "ch", "payload").select("doc_id", "hit_kind", "hit")


_TIERS = """WITH f AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' AND value > 80 GROUP BY 1), s AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
m AS (SELECT c_custkey AS user_id, CASE WHEN f.v IS NOT NULL THEN 'fast' WHEN s.v IS NOT NULL THEN 'slow' ELSE 'miss' END AS tier, coalesce(f.v, s.v) AS found FROM customer LEFT JOIN f ON f.user_id = c_custkey LEFT JOIN s ON s.user_id = c_custkey)
"""


@query("j6_tiered_lookup", _TIERS + "SELECT * FROM m")
def j6(t: Tables) -> DataFrame:
    e = t.events
    fast, slow = (e.filter(c).groupBy("user_id").agg(F.max("value").alias("v")) for c in ("event_type = 'purchase' and value > 80", "event_type = 'click'"))
    return J.tiered_lookup(t.customer.select(F.col("c_custkey").alias("user_id")), fast, slow, "user_id", "v")


@query("a22_hit_rates", _TIERS + "SELECT tier, count(*) AS n, round(count(*) * 100 / greatest((SELECT count(*) FROM m), 1), 6) AS percent FROM m GROUP BY tier")
def a22(t: Tables) -> DataFrame:
    m = j6(t)
    n = m.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("_all"))).select("tier", "n", F.round(S.ratio(F.col("n") * 100, F.col("_all")), 6).alias("percent"))  # three rows


@query("j7_cached_hash", "SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def j7(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return d.join(d.join(t.labels.filter("quality = 0").select("doc_id"), "doc_id").select("h").distinct(), "h", "left_semi").select("doc_id")


@query("j11_point_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j11(t: Tables) -> DataFrame:
    return t.embeddings.join(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "label")


@query("j12_subscriptions", """WITH p AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 2 = 0 THEN ['purchase', 'error'] ELSE ['signup'] END AS kinds, c_mktsegment AS endpoint FROM customer)
SELECT event_id, endpoint FROM events JOIN p USING (user_id) WHERE list_contains(kinds, event_type)""")
def j12(t: Tables) -> DataFrame:
    p = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("purchase"), F.lit("error"))).otherwise(F.array(F.lit("signup"))).alias("kinds"), F.col("c_mktsegment").alias("endpoint"))
    return J.subscriptions(t.events, p, "user_id", "event_type", "kinds").select("event_id", "endpoint")


@query("j13_recipes", """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host FROM pages),
o AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host, max(page_id) AS max_pages FROM pages GROUP BY 1 HAVING max(page_id) % 2 = 0)
SELECT host, coalesce(max_pages, 20) AS max_pages, 'img' AS selector FROM h LEFT JOIN o USING (host)""")
def j13(t: Tables) -> DataFrame:
    p = t.pages.select(S.url_host(F.col("url")).alias("host"), "page_id")
    over = p.groupBy("host").agg(F.max("page_id").alias("max_pages")).filter("max_pages % 2 = 0").withColumn("selector", F.lit(None).cast("string"))
    return J.merge_recipes(p.select("host").distinct(), over, {"max_pages": 20, "selector": "img"}, "host")


@query("j15_probe_centroid", """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(generate_series(1, 64)) AS u(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1)
SELECT e.vec_id, round(sum(e.embedding[c.i]::DOUBLE * c.m) / any_value(n.n * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS similarity FROM embeddings e JOIN c USING (label) JOIN n USING (label) GROUP BY 1""")
def j15(t: Tables) -> DataFrame:
    c = A.centroids(t.embeddings, "label", "embedding")
    return t.embeddings.join(c, "label").select("vec_id", F.round(S.dot(S.l2_normalize(F.col("embedding")), F.col("centroid")), 4).alias("similarity"))


@query("j16_purge", "SELECT 'events' AS table_name, count_if(user_id = 7) AS removed, count_if(user_id <> 7) AS kept FROM events UNION ALL SELECT 'orders', count_if(o_custkey = 7), count_if(o_custkey <> 7) FROM orders")
def j16(t: Tables) -> DataFrame:
    return J.purge({"events": t.events.select("user_id"), "orders": t.orders.select(F.col("o_custkey").alias("user_id"))}, F.col("user_id") == 7)[1]


# ---- changes and retention ------------------------------------------------


@query("s11_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def s11(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "ts", "value")
    return C.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("s15_migration", "SELECT 'before' AS moment, count_if(event_type = 'click') AS n_old, count_if(event_type = 'tap') AS n_new FROM events UNION ALL SELECT 'after', 0, count_if(event_type = 'click') FROM events")
def s15(t: Tables) -> DataFrame:
    return C.migrate(t.events, "event_type", "click", "tap")[1]


@query("s10_content_keys", "SELECT doc_id, source || '/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || sha256(coalesce(text, '')) || '.txt' AS object_key, substr(sha256(coalesce(text, '')), 1, 2) AS fan_out FROM documents")
def s10(t: Tables) -> DataFrame:
    d = t.documents.withColumn("text", F.coalesce("text", F.lit("")))
    return writers.content_addressed(d, "text", F.col("source")).select("doc_id", "object_key", "fan_out")


@query("s12_vector_upsert", """SELECT vec_id, regexp_replace(substr(sha256(vec_id::VARCHAR), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS unit_sum FROM embeddings WHERE len(embedding) = 64 AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 1e-6""")
def s12(t: Tables) -> DataFrame:
    return V.upsertable(t.embeddings, "vec_id", "embedding", 64).select("vec_id", "point_id", F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x), 4).alias("unit_sum"))


@query("s13_sidecars", """SELECT doc_id, '{' || concat_ws(',', '"lang":' || to_json(lang), '"source":' || to_json(source), '"n_chars":' || n_chars) || '}' AS metadata FROM documents""")
def s13(t: Tables) -> DataFrame:
    return writers.sidecar(t.documents, "doc_id", ["lang", "source", "n_chars"])


@query("s14_ingest_status", "SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'invalid' END AS error FROM events")
def s14(t: Tables) -> DataFrame:
    return writers.ingest_status(t.events, "event_id", F.col("event_type") != "error", 10**12, True)


@query("p22_changes", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'deleted' WHEN c_custkey % 5 = 0 THEN 'suspended' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS c_name FROM customer""")
def p22(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_mktsegment", "c_name")
    change = c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("suspended").alias("c_mktsegment"), F.lit("renamed").alias("c_name"))
    return C.soft_delete(C.apply_updates(c, change, "c_custkey", ["c_mktsegment", "c_name"]), c.filter("c_custkey % 7 = 0"), "c_custkey", "c_mktsegment")


@query("r1_retention", f"SELECT count_if(ts < {CUTOFF}) AS deleted, count_if(ts >= {CUTOFF}) AS kept FROM events")
def r1(t: Tables) -> DataFrame:
    return C.retain(t.events, "ts", AS_OF, 7)[1]


@query("r1_kept_rows", f"SELECT event_id FROM events WHERE NOT (ts < {CUTOFF})")
def r1_kept(t: Tables) -> DataFrame:
    return C.retain(t.events, "ts", AS_OF, 7)[0].select("event_id")


@query("r2_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def r2(t: Tables) -> DataFrame:
    return C.cascade(t.lineitem, t.orders.filter("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("r3_job_rollup", f"""SELECT 'events' AS policy, count_if(ts < {CUTOFF}) AS deleted, count_if(NOT ts < {CUTOFF}) AS kept FROM events
UNION ALL SELECT 'orders', count_if(o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY), count_if(NOT o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) FROM orders""")
def r3(t: Tables) -> DataFrame:
    parts = [("events", t.events, "ts", AS_OF, 7), ("orders", t.orders, "o_orderdate", dt.datetime(1998, 1, 1), C.failure_retention_days(7))]
    return C.job_rollup([C.retain(df, ts, at, n)[1].withColumn("policy", F.lit(name)) for name, df, ts, at, n in parts]).select("policy", "deleted", "kept")


@query("r4_stale_state", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR")
def r4(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "P") & C.expired("o_orderdate", dt.datetime(1998, 1, 1), 1)).select("o_orderkey")


# ---- changes to stored tables: only touched files are rewritten -----------


def _stored(t: Tables, df: DataFrame, *by: str) -> FileTable:
    return FileTable(t.spark, shared_path(t.spark)).create(df.repartitionByRange(16, *by))


@query("s11_upsert_files", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def s11_files(t: Tables) -> DataFrame:
    """A table of users' latest events; a later event of each of some users comes as a change, some users are new."""
    e = t.events.select("user_id", "event_id", "ts", "value")
    first = (F.col("event_id") % 3 == 0) & (F.col("user_id") % 10 != 1)
    table = _stored(t, W.top_n(e.filter(first), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 1), "user_id")
    table.upsert(e.filter(~first), ["user_id"], ["ts", "event_id"])
    return table.read().select("user_id", "event_id", "value")


@query("s12_upsert_files", """SELECT vec_id, regexp_replace(substr(sha256(vec_id::VARCHAR), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id, CASE WHEN vec_id % 50 = 3 THEN -1 ELSE label END AS label
FROM embeddings WHERE len(embedding) = 64 AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 1e-6""")
def s12_files(t: Tables) -> DataFrame:
    """Points by their deterministic identifier: a change replaces one in fifty and adds one in fifty."""
    p = V.upsertable(t.embeddings, "vec_id", "embedding", 64).select("vec_id", "point_id", "unit", "label", F.lit(0).alias("version"))
    table = _stored(t, p.filter("vec_id % 50 <> 7"), "point_id")
    change = p.filter("vec_id % 50 in (3, 7)").withColumn("version", F.lit(1)).withColumn("label", F.when(F.col("vec_id") % 50 == 3, -1).otherwise(F.col("label")))
    table.upsert(change, ["point_id"], ["version"])
    return table.read().select("vec_id", "point_id", "label")


@query("p22_update_files", """SELECT c_custkey, CASE WHEN c_custkey BETWEEN 20 AND 120 THEN 'deleted' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 100 = 1 THEN 'renamed' ELSE c_name END AS c_name FROM customer""")
def p22_files(t: Tables) -> DataFrame:
    """A soft delete and a selective update."""
    table = _stored(t, t.customer.select("c_custkey", "c_mktsegment", "c_name"), "c_custkey")
    table.update(F.col("c_custkey").between(20, 120), {"c_mktsegment": F.lit("deleted")})
    table.update(F.col("c_custkey") % 100 == 1, {"c_name": F.lit("renamed")})
    return table.read()


@query("r1_retention_files", f"SELECT event_id, user_id FROM events WHERE NOT (ts < {CUTOFF})")
def r1_files(t: Tables) -> DataFrame:
    table = _stored(t, t.events, "ts")
    table.delete(C.expired("ts", AS_OF, 7))
    return table.read().select("event_id", "user_id")


# ---- quality gates --------------------------------------------------------

_GATE = {p: v for p, v in P.QUALITY_PRESETS.items()}


def _gate_sql(preset: str) -> str:
    size, sharp, a1, a2, least = _GATE[preset]
    return f"""SELECT l_orderkey, l_linenumber, array_to_string(r, ',') AS reasons, round(s, 6) AS score, len(r) = 0 AND s >= {least} AS usable FROM (
SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity * 4 < {size} THEN 'too_small' END, CASE WHEN l_extendedprice / 100 < {sharp} THEN 'not_sharp' END, CASE WHEN l_discount * 400 > {a1} THEN 'angle1_too_large' END,
CASE WHEN l_tax * 400 > {a2} THEN 'angle2_too_large' END], lambda x: x IS NOT NULL) AS r,
least(1, l_extendedprice / 100 / 500) * 0.4::DOUBLE + (1 - least(1, l_discount * 400 / {a1}::DOUBLE)) * 0.2::DOUBLE + (1 - least(1, l_tax * 400 / {a2}::DOUBLE)) * 0.2::DOUBLE + least(1, l_quantity * 4 / {max(size, 112)}::DOUBLE) * 0.2::DOUBLE AS s FROM lineitem)"""


def _gate(t: Tables, preset: str) -> DataFrame:
    size = F.col("l_quantity") * 4
    g = t.lineitem.withColumn("g", P.quality_gate(size, size, F.col("l_extendedprice") / 100, F.col("l_discount") * 400, F.col("l_tax") * 400, preset))
    return g.select("l_orderkey", "l_linenumber", F.array_join("g.reasons", ",").alias("reasons"), F.round("g.score", 6).alias("score"), "g.usable")


for _p in P.QUALITY_PRESETS:
    query(f"p12_quality_{_p}", _gate_sql(_p))(lambda t, p=_p: _gate(t, p))


@query("p13_simple_gate", "SELECT l_orderkey, l_linenumber, l_quantity >= 10 AND l_extendedprice >= 20000 AS ok FROM lineitem")
def p13(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", P.simple_gate(F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice"), 10, 20000.0).alias("ok"))


@query("p14_search_quality", "SELECT doc_id FROM labels WHERE quality = 1 AND (1 - toxic) >= 0.5")
def p14(t: Tables) -> DataFrame:
    return t.labels.filter(P.search_quality(F.col("quality") == 1, 1 - F.col("toxic"), 0.5)).select("doc_id")


# ---- duplicates -----------------------------------------------------------


def _hashes(t: Tables) -> DataFrame:
    """Each document's hash, and a twin whose last digit has one bit flipped."""
    h = F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 16)
    a = t.documents.select(F.col("doc_id").alias("id"), "lang", h.alias("h"))
    flip = F.translate(F.substring("h", 16, 1), "0123456789abcdef", "1032547698badcfe")
    return a.unionByName(a.select((F.col("id") + 10_000_000_000).alias("id"), "lang", F.concat(F.substring("h", 1, 15), flip).alias("h")))


_H = """WITH a AS (SELECT doc_id AS id, lang, substr(md5(coalesce(text, '')), 1, 16) AS h FROM documents),
x AS (SELECT * FROM a UNION ALL SELECT id + 10000000000, lang, substr(h, 1, 15) || translate(substr(h, 16, 1), '0123456789abcdef', '1032547698badcfe') FROM a)
"""
_NEAR = "EXISTS (SELECT 1 FROM x y WHERE y.lang = x.lang AND substr(y.h, 1, 4) = substr(x.h, 1, 4) AND y.id < x.id AND bit_count(xor(('0x' || x.h)::UBIGINT, ('0x' || y.h)::UBIGINT)) <= 8)"


@query("f3_hamming", _H + "SELECT p.id, bit_count(xor(('0x' || p.h)::UBIGINT, ('0x' || q.h)::UBIGINT))::INT AS d FROM x p JOIN x q ON q.id = p.id + 10000000000")
def f3(t: Tables) -> DataFrame:
    x = _hashes(t)
    return x.join(x.select((F.col("id") - 10_000_000_000).alias("id"), F.col("h").alias("h2")), "id").select("id", S.hamming_hex(F.col("h"), F.col("h2")).alias("d"))


@query("f4_prefix", "SELECT doc_id, substr(md5(text), 1, 4) AS p FROM documents")
def f4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.phash_prefix(F.md5(F.col("text").cast("binary"))).alias("p"))


_ONE = _H + ", r AS (SELECT lang, h, min(id) AS id FROM x GROUP BY lang, h)\n"


@query("j8_blocked_hamming", _ONE + "SELECT a.id AS left_key, b.id AS right_key, bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT))::INT AS distance FROM r a JOIN r b ON a.lang = b.lang AND substr(a.h, 1, 4) = substr(b.h, 1, 4) WHERE b.id < a.id AND bit_count(xor(('0x' || a.h)::UBIGINT, ('0x' || b.h)::UBIGINT)) <= 8")
def j8(t: Tables) -> DataFrame:
    """Pairs of different hashes, by the smallest row of each; j8_members tells whose hash that is."""
    one = D.representatives(_hashes(t), "lang", "h", "id")
    return D.near_pairs(one, one, "lang", "h", "id").filter("right_key < left_key")


@query("j8_members", _ONE + "SELECT x.id, r.id AS representative FROM x JOIN r ON r.lang = x.lang AND r.h = x.h")
def j8_members(t: Tables) -> DataFrame:
    x = _hashes(t)
    return x.join(D.representatives(x, "lang", "h", "id").withColumnRenamed("id", "representative"), ["lang", "h"]).select("id", "representative")


@query("d1_exact_flags", _H + "SELECT id, row_number() OVER (PARTITION BY h ORDER BY id) > 1 AS is_dup FROM x")
def d1(t: Tables) -> DataFrame:
    return D.exact_flags(_hashes(t), "h", ["id"]).select("id", "is_dup")


@query("d2_near_flags", _H + f"SELECT id, {_NEAR} AS near_dup FROM x")
def d2(t: Tables) -> DataFrame:
    return D.near_flags(_hashes(t), "lang", "h", "id").select("id", "near_dup")


_GREEDY = _H.replace("WITH a", "WITH RECURSIVE a") + """, o AS (SELECT *, ('0x' || h)::UBIGINT AS v, substr(h, 1, 4) AS p, id % 10000000000 AS sec, row_number() OVER (PARTITION BY lang, substr(h, 1, 4) ORDER BY id % 10000000000, id) AS n FROM x),
g AS (SELECT lang, p, n, id, true AS kept, [{'s': sec, 'v': v}] AS memory FROM o WHERE n = 1
UNION ALL SELECT lang, p, n, id, kept, (CASE WHEN kept THEN list_append(alive, {'s': sec, 'v': v}) ELSE alive END)[-1000:] FROM (
SELECT *, len(list_filter(alive, lambda m: bit_count(xor(m.v, v)) <= 8)) = 0 AS kept FROM (SELECT o.lang, o.p, o.n, o.id, o.v, o.sec, list_filter(g.memory, lambda m: o.sec - m.s <= 3600) AS alive FROM g JOIN o ON o.lang = g.lang AND o.p = g.p AND o.n = g.n + 1)))
SELECT id, kept FROM g"""


@query("d3_greedy", _GREEDY)
def d3(t: Tables) -> DataFrame:
    x = _hashes(t).withColumn("ts", F.timestamp_seconds(F.col("id") % 10_000_000_000))
    return D.greedy(x, "lang", "h", "ts", "id").select("id", "kept")


@query("d4_outcomes", _H.replace("x AS (", "x0 AS (") + """, x AS (SELECT * FROM x0 WHERE id % 10 <> 3), f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id) > 1 AS dup FROM x0)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN x.id % 10 = 3 THEN 'rejected' WHEN dup THEN 'dup_exact' WHEN """ + _NEAR.replace("FROM x y", "FROM x0 y").replace("AND y.id < x.id", "AND y.id < x.id AND y.id % 10 <> 3") + """ THEN 'dup_near' ELSE 'accepted' END AS outcome FROM f x) GROUP BY 1""")
def d4(t: Tables) -> DataFrame:
    return D.outcomes(_hashes(t), "lang", "h", "id", F.col("id") % 10 != 3).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("d5_seen_urls", """SELECT page_id FROM (SELECT page_id, u, row_number() OVER (PARTITION BY u ORDER BY page_id) AS rn FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE page_id % 3 <> 0))
WHERE rn = 1 AND u NOT IN (SELECT regexp_replace(url, '[;?#].*$', '') FROM pages WHERE page_id % 3 = 0)""")
def d5(t: Tables) -> DataFrame:
    """A third of the pages is history, the rest a new batch."""
    p = t.pages.select("page_id", S.normalize_url(F.col("url")).alias("u"))
    return J.unseen(W.top_n(p.filter("page_id % 3 <> 0"), ["u"], [F.col("page_id")], 1), p.filter("page_id % 3 = 0"), "u").select("page_id")


# ---- vectors --------------------------------------------------------------


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_DOT = "(round(list_dot_product({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[]), 4) + 0)"
_PAIRS = f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, {_DOT.format(a='a', b='b')} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)\n"
_STATS = _PAIRS + ", s AS (SELECT same, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max FROM p GROUP BY same)\n"


@query("f2_uuid", "SELECT vec_id, regexp_replace(substr(sha256(vec_id::VARCHAR), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM embeddings")
def f2(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", S.uuid_of(F.col("vec_id")).alias("uuid"))


@query("f5_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def f5(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(S.l2_norm(F.col("embedding")), 6).alias("norm"), F.round(S.l2_normalize(F.col("embedding"))[0], 6).alias("first"))


@query("f6_distances", f"SELECT a.vec_id, {_DOT.format(a='a', b='b')} AS cosine, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 4) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f6(t: Tables) -> DataFrame:
    e = t.embeddings
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(n, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("w")), 4).alias("cosine"), F.round(S.l2_distance(F.col("embedding"), F.col("w")), 4).alias("distance"))


@query("f7_dimension", "SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings")
def f7(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", S.has_dimension(F.col("embedding"), 64).alias("ok"))


@query("v1_exact_top_k", f"""SELECT probe_id, id, score, rank FROM (SELECT p.vec_id AS probe_id, c.vec_id AS id, {_DOT.format(a='p', b='c')} AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_DOT.format(a='p', b='c')} DESC, c.vec_id)::INT AS rank
FROM embeddings p JOIN embeddings c ON p.label = c.label AND p.vec_id <> c.vec_id WHERE p.vec_id % 100 = 0 AND {_DOT.format(a='p', b='c')} >= 0.1) WHERE rank <= 10""")
def v1(t: Tables) -> DataFrame:
    p = _points(t)
    return V.exact_top_k(p.filter("id % 100 = 0"), p, "label", 10, 0.1)


@query("v2_lsh_top_k")
def v2(t: Tables) -> DataFrame:
    p = _points(t)
    return V.lsh_top_k(p.filter("id % 100 = 0"), p, 10, 1.35)


@query("v2_sign_top_k")
def v2_sign(t: Tables) -> DataFrame:
    """By sign hashes; as many buckets are probed as sampled neighbours need."""
    p = _points(t)
    return V.sign_top_k(p.filter("id % 100 = 0"), p, 10)


@query("j10_labelled_pairs", _PAIRS + "SELECT a, b, same, score FROM p")
def j10(t: Tables) -> DataFrame:
    p = _points(t)
    return V.labelled_pairs(p.filter("id % 100 = 0"), p)


@query("v3_pairs_over_threshold", _PAIRS + "SELECT a, b, score FROM p WHERE score >= 0.25")
def v3(t: Tables) -> DataFrame:
    p = _points(t)
    return V.labelled_pairs(p.filter("id % 100 = 0"), p, threshold=0.25).select("a", "b", "score")


@query("a16_score_stats", _STATS + "SELECT same, n, round(mean, 4) AS mean, round(std, 4) AS std, min, max FROM s")
def a16(t: Tables) -> DataFrame:
    return A.score_stats(j10(t), ["same"], "score").withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("a17_percentiles", _PAIRS + "SELECT round(quantile_cont(score, 0.9), 4) AS p90, round(median(score), 4) AS median FROM p")
def a17(t: Tables) -> DataFrame:
    q = Q.quantiles(j10(t), [], "score", {"p90": 0.9, "median": 0.5})
    return q.select(F.round("p90", 4).alias("p90"), F.round("median", 4).alias("median"))


@query("v4_calibration", _STATS + """, o AS (SELECT max(mean) FILTER (same) AS pm, max(std) FILTER (same) AS ps, max(mean) FILTER (NOT same) AS nm, max(std) FILTER (NOT same) AS ns FROM s)
SELECT round(pm - 2 * ps, 4) AS conservative, round((pm + nm) / 2, 4) AS balanced, round(nm + 2 * ns, 4) AS aggressive, CASE WHEN pm - 2 * ps > nm + 2 * ns THEN 'good separation' ELSE 'poor separation' END AS recommendation FROM o""")
def v4(t: Tables) -> DataFrame:
    r = A.suggest_thresholds(A.score_stats(j10(t), ["same"], "score"))
    return r.select(*[F.round(c, 4).alias(c) for c in ("conservative", "balanced", "aggressive")], "recommendation")


_CENTRE = """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m, count(*) AS members FROM embeddings, unnest(generate_series(1, 64)) AS u(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n, any_value(members) AS members FROM c GROUP BY 1)
"""


@query("v5_centroids", _CENTRE + "SELECT label, any_value(n.members) AS members, round(sum(m / n.n), 4) AS total, round(max(m / n.n), 4) AS largest FROM c JOIN n USING (label) GROUP BY 1")
def v5(t: Tables) -> DataFrame:
    c = A.centroids(t.embeddings, "label", "embedding")
    return c.select("label", "members", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max("centroid"), 4).alias("largest"))


_SIM = _CENTRE + ", s AS (SELECT e.vec_id AS id, e.label, round(sum(e.embedding[c.i]::DOUBLE * c.m) / any_value(n.n * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS similarity FROM embeddings e JOIN c ON c.label = e.label JOIN n ON n.label = e.label GROUP BY 1, 2)\n"


def _verified(t: Tables) -> DataFrame:
    p = _points(t)
    return V.verify(p, A.centroids(p, "label", "v"), "label", 0.15)


@query("v6_verify", _SIM + "SELECT id, similarity, similarity >= 0.15 AS verified, CASE WHEN similarity < 0.15 THEN 'low_similarity' END AS reason FROM s")
def v6(t: Tables) -> DataFrame:
    return _verified(t).select("id", "similarity", "verified", "reason")


@query("v6_verify_all", _CENTRE + """SELECT id, similarity, similarity >= 0.15 AS verified, CASE WHEN similarity < 0.15 THEN 'low_similarity' END AS reason
FROM (SELECT e.vec_id AS id, round(sum(e.embedding[c.i]::DOUBLE * c.m) / any_value(n.n * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS similarity FROM embeddings e JOIN c ON c.label = e.label JOIN n ON n.label = e.label GROUP BY e.vec_id)""")
def v6_all(t: Tables) -> DataFrame:
    p = _points(t)
    return V.verify(p, A.centroids(p, "label", "v"), "label", 0.15).select("id", "similarity", "verified", "reason")


@query("v7_gated_search", _SIM + f""", r AS (SELECT s.id AS probe_id, c2.vec_id AS id, {_DOT.format(a='p', b='c2')} AS score FROM s JOIN embeddings p ON p.vec_id = s.id JOIN embeddings c2 ON c2.label = s.label AND c2.vec_id <> s.id WHERE s.similarity >= 0.15 AND s.id % 100 = 0)
SELECT probe_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id)::INT AS rank FROM r WHERE score >= 0.1) WHERE rank <= 5""")
def v7(t: Tables) -> DataFrame:
    """Queries: the rows with an id divisible by 100, if they are verified."""
    return V.gated_search(_verified(t).filter("id % 100 = 0"), _points(t), "label", 5, 0.1)


@query("t7_seeded_sample")
def t7(t: Tables) -> DataFrame:
    """A seeded sample of vectors: the same rows each time."""
    return t.embeddings.orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").limit(100).select("vec_id", "label")


@query("t7_seeded_order", "SELECT vec_id, label FROM embeddings ORDER BY sha256(vec_id || ':42'), vec_id LIMIT 100")
def t7_order(t: Tables) -> DataFrame:
    """A seeded sample by a hash that SQL has too."""
    return t.embeddings.orderBy(F.sha2(F.concat(F.col("vec_id").cast("string"), F.lit(":42")), 256), "vec_id").limit(100).select("vec_id", "label")


@query("f21_stem_groups", "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '_[^_]*$', '') AS g FROM part")
def f21(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.stem_group(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg"))).alias("g"))


@query("f22_derived_keys", """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label || '/' || md5(vec_id::VARCHAR) || '_face_' || vec_id || '.jpg' END AS crop,
CASE WHEN vec_id % 2 = 0 THEN label || '/' || md5(vec_id::VARCHAR) || '_face_' || vec_id || '_thumb.jpg' END AS thumb FROM embeddings""")
def f22(t: Tables) -> DataFrame:
    key = F.concat(F.md5(F.col("vec_id").cast("string").cast("binary")), F.when(F.col("vec_id") % 2 == 0, ":face_").otherwise(":body_"), F.col("vec_id").cast("string"))
    keys = S.derived_keys(key, F.col("label"))
    return t.embeddings.select("vec_id", keys["crop"].alias("crop"), keys["thumb"].alias("thumb"))


@query("f26_shorten", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS t FROM documents")
def f26(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.shorten(F.col("text"), 80).alias("t"))
