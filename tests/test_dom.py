import random
import resource

import pytest
from pyspark.sql import functions as F

from mediaops.operators import dom as D
from mediaops.operators import html as H
from mediaops.plans import QUERIES

SCHEMA = "page_id long, url string, html string, node string"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://h{i % 2}.com/", h, "x") for i, h in enumerate(htmls)], SCHEMA)


def random_page(rng, n):
    out, tags = [], ["div", "a", "p", "ul", "li", "b", "img", "br", "html"]
    for _ in range(n):
        t = rng.choice(tags)
        kind = rng.random()
        if kind < 0.6:
            out.append(f"<{t}" + rng.choice(["", ' class="list-item x"', ' class="go"', " class='ab12cd34ef card'"]) + rng.choice(["", ' href="/video/1"', ' href="/x"', " href=''"]) + ' src="s" srcset="a 1x, b 2x">')
        elif kind < 0.9:
            out.append(f"</{t}>")
        else:
            out.append(rng.choice(["text", "12:34", "a 1:23 b", "&amp;"]))
    return "".join(out)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(12)
    return pages(spark, *[random_page(rng, rng.randrange(1, 120)) for _ in range(150)], None, "", "only text 1:22", "<p>")


def test_intervals_are_nested_and_numbered(many):
    of_page = {}
    for r in D.elements(many).collect():
        of_page.setdefault(r.page_id, []).append(r)
    for rows in of_page.values():
        rows.sort(key=lambda r: r["node"])
        assert [r["node"] for r in rows] == list(range(1, len(rows) + 1)) and sorted(r["post"] for r in rows) == list(range(1, len(rows) + 1))
        for r in rows:
            above = [x for x in rows if x["node"] < r["node"] <= x["last"]]
            assert len(above) == r["depth"] - 1 and all(x["last"] >= r["last"] and x["post"] > r["post"] for x in above)


@pytest.mark.parametrize("levels", [None, 0, 2])
def test_inside_against_brute_force(many, levels):
    dom = D.elements(many)
    rows = dom.collect()
    want = sorted((y["page_id"], x["node"], y["node"]) for x in rows for y in rows if x["page_id"] == y["page_id"] and x["tag"] in ("div", "p") and x["node"] <= y["node"] <= x["last"] and (levels is None or y["depth"] - x["depth"] <= levels))
    got = D.inside(dom.filter("tag in ('div', 'p')"), dom.select("page_id", "node", "depth"), {"node": "outer"}, levels)
    assert sorted((r.page_id, r.outer, r.node) for r in got.collect()) == want


def test_signatures_equal_those_of_one_pass(many):
    simple = many.filter("html not like '%<html%'")
    columns = ["page_id", "selector", "classes", "href", "video_above", "srcset_entries", "src", "near_duration"]
    a, b = (sorted(map(str, x.select(*columns).collect())) for x in (D.signatures(D.elements(simple), ["img", "a"]), H.node_signatures(simple, "img,a")))
    assert a == b and len(a) > 20
    evidence = [sorted(map(str, H.selector_evidence(x).collect())) for x in (D.signatures(D.elements(simple), ["img"]), H.node_signatures(simple, "img"))]
    assert evidence[0] == evidence[1]


def test_deep_and_broken_pages_take_linear_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    p = D._Elements()
    p.feed("<b>" * 150_000 + "</i>" * 150_000 + "</b>" * 10)
    p.close()
    p.shut(len(p.stack))
    assert p.columns[3][-1] == 150_000 and p.columns[1][0] == 150_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000  # KB


def test_deep_nesting_is_joined_by_blocks(spark):
    dom = D.elements(pages(spark, "<div>" * 3000 + "<a href='/v/'><img></a>"))
    r = D.signatures(dom, ["img"]).first()
    assert r.selector == "div div a img" and r.href == "/v/" and r.video_above
    pairs = D.inside(dom.filter("tag = 'div'"), dom.filter("tag = 'img'").select("page_id", "node", "depth"), {"node": "outer"})
    assert pairs.agg(F.count_distinct("outer")).first()[0] == 3000


def test_no_pages(spark):
    assert D.signatures(D.elements(pages(spark)), ["img"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_scanned_over_batches_without_joins(spark, many):
    """No estimate of a page's elements decides on a broadcast; what is open goes on from batch to batch."""
    simple = many.filter("html not like '%<html%'")
    columns = ["page_id", "selector", "classes", "href", "video_above", "srcset_entries", "src", "near_duration"]
    want = sorted(map(str, H.node_signatures(simple, "p,a,b").select(*columns).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = D.signatures(D.elements(simple), ["p", "a", "b"])
        assert sorted(map(str, got.select(*columns).collect())) == want and len(want) > 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    evidence = plan(QUERIES["a24_dom_evidence"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in evidence and evidence.count("Join") <= 1 and "Generate" not in evidence


def test_every_level_of_a_deep_page(spark):
    got = D.signatures(D.elements(pages(spark, "<a href='/v/'>" + "<p class='x-y'>" * 20_000)), ["p"])
    assert got.agg(F.count("*"), F.count_if("video_above"), F.count_distinct("selector")).first()[:] == (20_000, 20_000, 4)


def test_small_estimates_lead_to_no_broadcast(spark):
    """Of f19's elements, and of pairs of elements, both of which a table of a few KB may make in millions."""
    dom = D.elements(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert "Broadcast" not in plan(D.inside(dom, dom.select("page_id", "node", "depth"), {"node": "outer"}))
    assert "Broadcast" not in plan(QUERIES["f19_dom_signatures"](spark, "/root/testdata/sf0.001"))
