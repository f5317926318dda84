import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediaops.operators import aggregates as A
from mediaops.operators import changes as C
from mediaops.operators import dedup as D
from mediaops.operators import graph as G
from mediaops.operators import html as H
from mediaops.operators import joins as J
from mediaops.operators import vectors as V
from mediaops.operators import windows as W


@pytest.mark.parametrize("n", [1, 19, 20, 21, 100])
def test_rank_percentile(spark, n):
    values = [float(i % 17) for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "k string, v double")
    for p in (0.5, 0.95, 0.99, 1.0):
        want = sorted(values)[min(int(n * p), n - 1)]
        assert A.rank_percentile(df, ["k"], "v", p).first().p == A.rank_percentile(df, [], "v", p).first().p == want


def test_rank_percentile_of_large_skewed_groups(spark):
    import random

    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(20_000)] + [("hot", 1e12), ("hot", -1e12)] + [("same", 5.0)] * 6000 + [("two", float(i % 2)) for i in range(4001)] + [(None, float(i)) for i in range(50)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.001, 0.5, 0.95, 0.9999):
        got = {r.k: r.p for r in A.rank_percentile(df, ["k"], "v", p).collect()}
        for k in ("hot", "same", "two", None):
            values = sorted(v for g, v in rows if g == k)
            assert got[k] == values[min(int(len(values) * p), len(values) - 1)]
        assert "none" not in got
        values = sorted(v for _, v in rows if v is not None)
        assert A.rank_percentile(df, [], "v", p).first().p == values[int(len(values) * p)]


def test_counters_and_reconciliation(spark):
    rows = [("a", "processed", 3), ("a", "processed", None), ("b", "rejected", 2), ("b", "processed", 1)]
    df = spark.createDataFrame(rows, "scope string, name string, n int")
    assert {(r.scope, r.name): r.n for r in A.counters(df, "scope", "name", "n").collect()} == {("a", "processed"): 3, ("b", "rejected"): 2, ("b", "processed"): 1}
    assert {r.scope: r.counters for r in A.counter_maps(A.counters(df, "scope", "name", "n"), "scope", "name").collect()}["b"] == {"processed": 1, "rejected": 2}
    assert A.reconcile(df, "scope", F.col("n")).first()[:3] == (6, 6, 0)


def test_evidence_score(spark):
    rows = [(15, 5, 4, 3, 6, 1.0), (2, 0, 0, 0, 0, 2 / 12 / 8), (6, 0, 0, 0, 0, 1 / 8), (12, 2, 0, 0, 4, (2 + 2 / 3 + 4 / 5) / 8)]
    for r in spark.createDataFrame(rows, "a int, b int, c int, d int, e int, want double").select("want", A.evidence_score(*[F.col(x) for x in "abcde"]).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_centroids_need_two_members(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "g int, v array<double>")
    got = {r.g: r for r in A.centroids(df, "g", "v").collect()}
    assert got[1].centroid == pytest.approx([0.5**0.5] * 2) and got[2].centroid is None and got[2].members == 1


def test_floored_counter(spark):
    deltas = [-1, 1, 1, -5, 2, -1]
    df = spark.createDataFrame([("k", i, d) for i, d in enumerate(deltas)], "k string, ts int, d int")
    level, want = 0, []
    for d in deltas:
        level = max(0, level + d)
        want.append(level)
    assert [r.level for r in W.floored_counter(df, ["k"], "ts", "ts", F.col("d")).orderBy("ts").collect()] == want


def test_tiers(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    fast, slow = spark.createDataFrame([("a", "x")], "k string, v string"), spark.createDataFrame([("a", "y"), ("b", "z")], "k string, v string")
    assert {r.k: (r.tier, r.found) for r in J.tiered_lookup(keys, fast, slow, "k", "v").collect()} == {"a": ("fast", "x"), "b": ("slow", "z"), "c": ("miss", None)}


def test_normalise_recipe(spark):
    df = spark.createDataFrame([("h", {"pages": "7", "odd": "1"}), ("g", {"pages": "many"})], "host string, m map<string,string>")
    got = {r.host: (r.pages, r.fixes) for r in J.normalise_recipe(df, "m", {"pages": "int"}).collect()}
    assert got == {"h": (7, ["dropped:odd"]), "g": (None, ["type:pages"])}


def test_upsert_and_retention(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    change = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert {r.k: r.x for r in C.upsert(base, change, ["k"], ["v"]).collect()} == {1: "c", 2: "b", 3: "e"}
    at = dt.datetime(2024, 1, 10)
    rows = spark.createDataFrame([(1, at - dt.timedelta(days=8)), (2, at - dt.timedelta(days=7)), (3, None)], "id int, ts timestamp")
    kept, counts = C.retain(rows, "ts", at, 7)
    assert sorted(r.id for r in kept.collect()) == [2, 3] and tuple(counts.first()) == (1, 2)
    assert C.failure_retention_days(7) == 30 and C.failure_retention_days(10) == 40
    moved, report = C.migrate(base, "x", "a", "z", dry_run=True)
    assert {r.x for r in moved.collect()} == {"a", "b"} and {r.moment: r.n_new for r in report.collect()} == {"before": 0, "after": 0}


HASHES = [("t", 0, "8f373c9c3c9c3c1e"), ("t", 1, "8f373c9c3c9c3c1e"), ("t", 2, "8f373c9c3c9c3c1c"), ("t", 3, "0000000000000000"), ("u", 4, "8f373c9c3c9c3c1e"), ("t", 5, None), ("t", 6, ""), ("t", 7, "abc"), ("t", 8, "abc")]


def test_duplicates(spark):
    df = spark.createDataFrame([(t, i, h, dt.datetime(2024, 1, 1, 0, 0, i)) for t, i, h in HASHES], "tenant string, id int, h string, ts timestamp")
    assert {r.id for r in D.exact_flags(df, "h", ["id"]).filter("is_dup").collect()} == {1, 4}
    assert {r.id for r in D.near_flags(df, "tenant", "h", "id").filter("near_dup").collect()} == {1, 2}
    assert {r.id for r in D.greedy(df, "tenant", "h", "ts", "id").filter("not kept").collect()} == {1, 2}
    assert {r.id for r in D.greedy(df, "tenant", "h", "ts", "id", ttl=0).filter("not kept").collect()} == set()
    got = {r.id: r.outcome for r in D.outcomes(df, "tenant", "h", "id", F.col("id") != 3).collect()}
    assert got == {0: "accepted", 1: "dup_exact", 2: "dup_near", 3: "rejected", 4: "dup_exact", 5: "accepted", 6: "accepted", 7: "accepted", 8: "accepted"}


def test_greedy_memory_is_bounded(spark):
    df = spark.createDataFrame([("t", i, h, dt.datetime(2024, 1, 1, 0, 0, i)) for i, h in enumerate(["00000000000000ff", "000000000000ff00", "00000000000000ff"])], "tenant string, id int, h string, ts timestamp")
    assert [r.kept for r in D.greedy(df, "tenant", "h", "ts", "id", most=2).orderBy("id").collect()] == [True, True, False]
    assert [r.kept for r in D.greedy(df, "tenant", "h", "ts", "id", most=2, size=1).orderBy("id").collect()] == [True, True, True]


POINTS = [(0, [1.0, 0.0], 1), (1, [0.8, 0.6], 1), (2, [0.0, 1.0], 2), (3, [0.6, 0.8], 2)]


def test_gated_search_leaks_nothing(spark):
    df = spark.createDataFrame(POINTS, "id int, v array<double>, g int")
    centres = spark.createDataFrame([(1, [1.0, 0.0])], "g int, centroid array<double>")
    seen = V.verify(df, centres, "g", 0.8)
    assert {r.id: (r.verified, r.reason) for r in seen.collect()} == {0: (True, None), 1: (True, None), 2: (False, "identity_not_found"), 3: (False, "identity_not_found")}
    found = V.gated_search(seen, df, "g", 5, -1.0).collect()
    assert {(r.probe_id, r.id) for r in found} == {(0, 1), (1, 0)}
    low = V.verify(df, centres, "g", 0.81)
    assert {r.id for r in low.filter("reason = 'low_similarity'").collect()} == {1}
    assert V.verify(df, centres, "g", 0.1, F.col("id") == 0).filter("reason = 'quality'").count() == 1
    assert V.gated_search(low.filter("id = 1"), df, "g", 5, -1.0).count() == 0


def test_lsh_recall(spark):
    import math

    rows = [(i, [math.cos(i / 40), math.sin(i / 40), 0.1], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    exact = {(r.probe_id, r.id) for r in V.exact_top_k(df.filter("id % 20 = 0"), df, "label", 5, -2.0).collect()}
    near = {(r.probe_id, r.id) for r in V.lsh_top_k(df.filter("id % 20 = 0"), df, 5, 0.5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("length", [1.0, 40.0])
def test_lsh_stores_no_pairs(spark, length):
    """The rows of Spark's own bucket join, in one wide bucket or many, without its rows of pairs; odd vectors take no part."""
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 6)) * 12 / length
    v[100:110] = v[:10]
    rows, radius = [(i, [float(x) for x in r]) for i, r in enumerate(v)], 24 / length
    df = spark.createDataFrame(rows, "id int, v array<double>").withColumn("f", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", seed=42, numHashTables=8, bucketLength=1.0).fit(df)
    want = {}
    for r in model.approxSimilarityJoin(df.filter("id % 5 = 0"), df, radius, "d").filter("datasetA.id <> datasetB.id").selectExpr("datasetA.id a", "datasetB.id b").collect():
        want.setdefault(r.a, []).append((-float(V._rounded(v[r.a] @ v[r.b], 4)), r.b))
    odd = df.select("id", "v").union(spark.createDataFrame([(900, None), (901, [None] * 6), (902, [1.0])], "id int, v array<double>"))
    got = V.lsh_top_k(odd.filter("id % 5 = 0"), odd, 4, radius)
    found = {}
    for r in got.orderBy("probe_id", "rank").collect():
        found.setdefault(r.probe_id, []).append((-r.score, r.id))
    assert found == {a: sorted(x)[:4] for a, x in want.items()} and sum(map(len, want.values())) > 100
    assert "BatchEvalPython" not in got._jdf.queryExecution().executedPlan().toString() and "datasetA" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert V.lsh_top_k(df.limit(0), df, 4, radius).count() == 0 and V.lsh_top_k(df, df.limit(0), 4, radius).count() == 0


def test_blocks_meet_once(spark):
    """Top-k and pairs over several blocks of both sides, with a hot scope, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    v, g = rng.standard_normal((150, 8)), [1 if i % 3 else i % 5 + 2 for i in range(150)]
    df = spark.createDataFrame([(i, v[i].tolist(), g[i]) for i in range(150)] + [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [1.0] * 8, None)], "id int, v array<double>, label int")
    V.BLOCK = 16
    top = {(r.probe_id, r.rank): (r.id, r.score) for r in V.exact_top_k(df.filter("id % 2 = 0"), df, "label", 3, 0.5).collect()}
    pairs = {(r.a, r.b): (r.same, r.score) for r in V.labelled_pairs(df.filter("id % 10 = 0 and id < 900"), df.filter("id < 900")).collect()}
    V.BLOCK = 2048
    score = np.round(v @ v.T, 4)
    want = {}
    for i in range(0, 150, 2):
        best = sorted((-score[i, j], j) for j in range(150) if j != i and g[j] == g[i] and score[i, j] >= 0.5)[:3]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert {k: x[0] for k, x in top.items()} == {k: x[0] for k, x in want.items()} and all(abs(top[k][1] - want[k][1]) < 1e-9 for k in want)
    assert set(pairs) == {(i, j) for i in range(0, 150, 10) for j in range(150) if i != j}
    assert all(same == (g[i] == g[j]) and abs(s - score[i, j]) < 1.1e-4 for (i, j), (same, s) in pairs.items())


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e"), ("e", "f"), ("x", "y")]


def test_walk(spark):
    edges, seeds = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.level for r in G.walk(edges, seeds, 5).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2, "f": 3}
    assert [r.node for r in G.walk(edges, seeds, 5, 3).orderBy("level", "node").collect()] == ["a", "b", "d"]
    assert G.walk(edges, seeds, 1).count() == 3


PAGE = """<html><head><meta property="og:image" content="/og.png"><script type="application/ld+json">{"thumbnailUrl": ["//cdn.example.com/t.jpg"], "image": {"url": "/obj.jpg"}}</script>
<script type="application/ld+json">{broken</script></head><body><div class="list-item thumb"><a href="/video/1"><img src="x.gif" data-src="real.jpg" width="10" srcset="a.jpg 320w, b.jpg 640w"></a></div>
<div class="list-item thumb"><img data-src="../up.webp" width="wide"></div><div class="list-item thumb"><img style="background-image: url('/bg.png')"></div><noscript><img src="https://n.example.com/n.jpg"></noscript>
<a href="/login">in</a><a href="/trending">Trending videos</a><a href="https://other.example.org/">off</a></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "https://example.com/dir/p", PAGE), (2, "https://example.com/empty", ""), (3, None, None)], "page_id long, url string, html string")


def test_media_references(spark):
    got = {r.target: r for r in H.media_references(pages(spark)).collect()}
    assert {"https://example.com/dir/x.gif", "https://example.com/up.webp", "https://example.com/bg.png", "https://example.com/og.png", "https://cdn.example.com/t.jpg", "https://example.com/obj.jpg", "https://n.example.com/n.jpg"} <= set(got)
    assert got["https://example.com/dir/x.gif"].width == 10 and got["https://example.com/up.webp"].width is None and got["https://example.com/up.webp"].media_type == "image/webp"
    assert {r.method for r in H.first_rule(H.media_references(pages(spark))).collect()} == {"img"}


def test_json_forms(spark):
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    rows = [
        (block('[{"image": "/1.jpg"}, {"thumbnailUrl": [{"url": "//c/2.jpg"}, "3.jpg", {"x": 1}]}, 7, {"contentUrl": {"url": "/4.jpg"}}]'), ["/1.jpg", "//c/2.jpg", "3.jpg", "/4.jpg"]),
        (block('{"image": "data:x", "contentUrl": ""}') + block("{broken") + block('{"image": "/5.jpg"}'), ["/5.jpg"]), ("", []),
    ]
    for r in spark.createDataFrame(rows, "h string, want array<string>").select("want", H.jsonld_urls(F.col("h")).alias("got")).collect():
        assert r.got == r.want
    deep = ['{"a.png": [{"b": "x.png", "c": "t"}, "y.JPG?q=1"], "e": "a\\"b.gif", "f": "http:\\/\\/h\\/z.webp", "again": "x.png"}', '"one.bmp"', "broken", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in deep], "t string").select(H.json_media(F.col("t"))).collect()]
    assert got == [["x.png", "y.JPG?q=1", 'a"b.gif', "http://h/z.webp"], ["one.bmp"], [], []]


def test_durations_near_media(spark):
    card = lambda t: f'<div class="row"><div class="card"><a class="go" href="/x"><span><img src="i.jpg"></span></a><p>{t}</p></div></div>'
    html = "<html><body><main>" + card("12:34 long") + card("none") + "<section><img src='j.jpg'></section></main><i>1:2345</i></body></html>"
    nodes = H.node_signatures(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string"), "img").collect()
    assert [r.near_duration for r in nodes] == [True, False, True] and [r.video_above for r in nodes] == [True, True, False]
    e = H.selector_evidence(H.node_signatures(spark.createDataFrame([(i, "https://e.com/", html) for i in range(3)], "page_id long, url string, html string"), "img")).filter("selector like '%span img'").first()
    assert (e.repeats, e.duration, e.video_href, e.samples) == (6, 3, 6, ["i.jpg"]) and e.score == pytest.approx((1 + 2 + 2) / 8)


def test_srcset(spark):
    df = spark.createDataFrame([("a.jpg 320w, b.jpg 640w, c.jpg 640w",), ("a.jpg 1x, b.jpg 3x",), ("a.jpg",), (None,)], "s string")
    assert [r[0] for r in df.select(H.widest(F.col("s"))).collect()] == ["b.jpg", "b.jpg", "a.jpg", None]
    assert [r[0] for r in df.select(H.nearest_width(F.col("s"), 300)).collect()][:1] == ["a.jpg"]


def test_links_and_selectors(spark):
    assert {r.dst for r in H.link_edges(pages(spark)).collect()} == {"https://example.com/video/1", "https://example.com/trending"}
    assert [r.target for r in H.category_links(pages(spark)).orderBy("rank").collect()] == ["https://example.com/video/1", "https://example.com/trending"]
    best = H.listing_links(pages(spark), "trending|videos", "/(video|trending)", "nav", "login").orderBy("rank").collect()
    assert best[0].target == "https://example.com/trending" and best[0].score == 5
    nodes = H.node_signatures(pages(spark), "img").collect()
    assert nodes[0].selector.endswith("div.list-item a img") and nodes[0].href == "/video/1" and nodes[0].srcset_entries == 2
    e = H.selector_evidence(H.node_signatures(pages(spark), "img"))
    assert e.filter("selector like '%div.list-item img'").first().repeats == 2
    assert [r[0] for r in spark.createDataFrame([('{"a": [{"b": "x.png"}], "c": "y"}',), ("broken",)], "t string").select(H.json_media(F.col("t"))).collect()] == [["x.png"], []]
    assert H.extra_sources(F.col("html")) is not None and pages(spark).select(H.extra_sources(F.col("html"))).first()[0] == ["og:image", "img_srcset", "json_ld", "background", "noscript"]
