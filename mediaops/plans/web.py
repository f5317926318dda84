"""Page, link, media and stream queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import dom as DOM
from ..operators import graph as G
from ..operators import html as H
from ..operators import windows as W
from ..sources import readers
from ..sources.shared import shared_path
from ..streaming import jobs as T
from ..streaming import ordered as O
from .registry import Tables, query

HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_TAG = "<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
#: every anchor: page, place, link, target (absolute and root-relative links, as the pages have)
ANCHORS = f"""WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_TAG}', 0, 'is')) AS tag, unnest(generate_series(0, len(regexp_extract_all(html, '{_TAG}', 0, 'is')) - 1)) AS pos FROM pages),
l AS (SELECT page_id, url, pos, regexp_extract(tag, '{_TAG}', 1, 'is') AS href, trim(regexp_replace(regexp_extract(tag, '{_TAG}', 2, 'is'), '<[^>]*>', '', 'g')) AS text FROM t),
a AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href AS target FROM l)
"""


@query("p4_url_class", f"""SELECT page_id, CASE WHEN s IN ('javascript', 'data', 'file', 'ftp') THEN 'MALICIOUS_SCHEME' WHEN s = '' OR h = '' THEN 'VALIDATION_ERROR' WHEN regexp_matches(lower(p), '\\.(exe|scr|apk|msi|bat|cmd|ps1|php|cgi|bin)$') THEN 'SUSPICIOUS_EXTENSION'
WHEN regexp_matches(url, '\\?([^#]*&)?(download|redirect|out|go)=[^&#]') THEN 'BAIT_QUERY_PARAM' WHEN h IN ('malware.example.com', 'phishing-site.net', 'suspicious-domain.org') THEN 'BLOCKED_HOST' WHEN regexp_matches(h, '\\.(tk|ml|ga|cf)$') THEN 'BLOCKED_TLD' ELSE 'SAFE' END AS reason
FROM (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS s, {HOST.format(u='url')} AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def p4(t: Tables) -> DataFrame:
    return t.pages.select("page_id", P.url_class(F.col("url")).alias("reason"))


@query("p5_url_class_strict", f"SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN CASE WHEN {HOST.format(u='url')} = '' THEN 'VALIDATION_ERROR' ELSE 'http' END ELSE 'UNSAFE_SCHEME' END AS kind FROM pages")
def p5(t: Tables) -> DataFrame:
    c = P.url_class(F.col("url"), strict=True)
    return t.pages.select("page_id", F.when(c.isin("UNSAFE_SCHEME", "VALIDATION_ERROR"), c).otherwise("http").alias("kind"))


@query("p6_content_class", "SELECT page_id, CASE WHEN page_id % 2 <> 0 THEN 'NOT_IMAGE_CONTENT' WHEN length(html) > 8388608 THEN 'CONTENT_TOO_LARGE' ELSE 'SAFE' END AS reason FROM pages")
def p6(t: Tables) -> DataFrame:
    """Each page as if served as HTML, with its length."""
    return t.pages.select("page_id", P.content_class(F.when(F.col("page_id") % 2 == 0, "image/png").otherwise("text/html"), F.length("html")).alias("reason"))


@query("p7_redirect_class", "SELECT page_id, CASE WHEN page_id % 5 >= 3 THEN 'TOO_MANY_REDIRECTS' WHEN url NOT SIMILAR TO '[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+.*' THEN 'REDIRECT_VALIDATION_ERROR' ELSE 'SAFE' END AS reason FROM pages")
def p7(t: Tables) -> DataFrame:
    return t.pages.select("page_id", P.redirect_class(F.col("url"), F.col("page_id") % 5).alias("reason"))


@query("p8_page_links", ANCHORS + f"SELECT page_id, pos, target FROM a WHERE {HOST.format(u='target')} = {HOST.format(u='url')} AND NOT regexp_matches(lower(target), 'javascript:|mailto:|tel:|#|\\.jpg|\\.jpeg|\\.png|\\.gif|\\.webp|\\.bmp|\\.pdf|\\.doc|\\.docx|\\.zip|\\.rar|facebook\\.com|twitter\\.com|instagram\\.com|youtube\\.com') AND NOT regexp_matches(lower(target), '\\.(exe|scr|apk|msi|bat|cmd|ps1|php|cgi|bin)$')")
def p8(t: Tables) -> DataFrame:
    return H.anchors(t.pages).filter(P.page_url(F.col("target"), F.col("url"))).select("page_id", "pos", "target")


@query("p9_media_links", ANCHORS + f"SELECT page_id, pos, target FROM a WHERE regexp_matches(target, '^https?://[^/?#]') AND NOT regexp_matches(lower(target), 'javascript:|mailto:|tel:|#|\\.pdf|\\.doc|\\.zip')")
def p9(t: Tables) -> DataFrame:
    return H.anchors(t.pages).filter(P.media_url(F.col("target"))).select("page_id", "pos", "target")


@query("p15_needs_render", "SELECT page_id, length(html) < 500 OR regexp_matches(lower(html), 'cloudflare|captcha|access denied|please enable javascript|javascript is disabled|checking your browser|ddos protection') AS needs FROM pages")
def p15(t: Tables) -> DataFrame:
    return t.pages.select("page_id", P.needs_render(F.col("html")).alias("needs"))


@query("p16_magic_types", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image/png' WHEN text LIKE 'BM%' THEN 'image/bmp' END AS kind FROM documents")
def p16(t: Tables) -> DataFrame:
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return t.documents.select("doc_id", P.sniff_type(content).alias("kind"))


@query("p11_sources", "SELECT page_id, (page_id % 3 = 0 AND page_id % 2 = 0) OR page_id % 5 = 0 AS ok, (page_id % 2 = 0) <> (page_id % 5 = 0) AS one FROM pages")
def p11(t: Tables) -> DataFrame:
    some = lambda n: F.when(F.col("page_id") % n == 0, F.col("url"))
    return t.pages.select("page_id", P.has_source(some(3), some(2), some(5)).alias("ok"), P.exactly_one(some(2), some(5)).alias("one"))


@query("f8_normalize_url", "SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages")
def f8(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.normalize_url(F.col("url")).alias("u"))


@query("f9_url_join", ANCHORS + "SELECT page_id, pos, target FROM a")
def f9(t: Tables) -> DataFrame:
    return H.anchors(t.pages).select("page_id", "pos", "target")


@query("f10_sites", f"SELECT page_id, regexp_replace({HOST.format(u='url')}, '^www\\.', '') AS site FROM pages")
def f10(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.site_of(F.lit(None).cast("string"), F.lit(""), F.col("url")).alias("site"))


@query("f11_media_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/svg+xml' END AS kind FROM pages")
def f11(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(F.lit(".JPG"), F.lit(".png"), F.lit(".svg"), F.lit(".txt")), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", S.media_type_of(F.concat(S.normalize_url(F.col("url")), ext)).alias("kind"))


@query("f12_estimated_bytes", "SELECT p_partkey, floor(p_size * 10 * 3 * 0.3)::BIGINT AS bytes FROM part")
def f12(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.estimated_bytes(S.int_or_null(F.col("p_size").cast("string")), F.lit(10)).alias("bytes"))


@query("f18_extra_sources", "SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '<noscript', 'i') THEN 'noscript' END, CASE WHEN regexp_matches(html, '<video[^>]+poster\\s*=', 'i') THEN 'poster' END], lambda x: x IS NOT NULL), ',') AS kinds FROM pages")
def f18(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(F.filter(H.extra_sources(F.col("html")), lambda x: x.isin("noscript", "poster")), ",").alias("kinds"))


@query("f20_hints", "SELECT page_id, len(regexp_extract_all(html, '\\b[0-9]{1,2}:[0-9]{2}\\b')) AS durations FROM pages")
def f20(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *H.hint_counts(F.col("html"))).select("page_id", F.col("durations").cast("long").alias("durations"))


@query("f16_script_media", """SELECT page_id, u || '/n.jpg ' || u || '/s.PNG' AS links FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL)""")
def f16(t: Tables) -> DataFrame:
    """Beside a page's own scripts, a noscript and a script that name media."""
    made = F.concat(F.col("html"), F.lit('<noscript><img src="'), "u", F.lit("/n.jpg\"></noscript><p>http://not.example.com/a.jpg</p><script>load('"), "u", F.lit("/s.PNG'); again('"), "u", F.lit("/n.jpg')</script>"))
    rows = t.pages.filter("url is not null").select("page_id", F.coalesce("html", F.lit("")).alias("html"), S.normalize_url(F.col("url")).alias("u"))
    return rows.select("page_id", F.array_join(H.script_media(made), " ").alias("links"))


@query("a34_image_counts", "SELECT page_id, len(regexp_extract_all(html, '<img[\\s>/]', 0, 'i')) AS n FROM pages")
def a34(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.image_count(F.col("html")).cast("long").alias("n"))


@query("a28_strategy", f"SELECT host, sum(len(regexp_extract_all(html, '<p[ >]')))::BIGINT AS plain, sum(len(regexp_extract_all(html, '<a ')))::BIGINT AS scripted, CASE WHEN sum(len(regexp_extract_all(html, '<a '))) >= greatest(10, 3 * sum(len(regexp_extract_all(html, '<p[ >]')))) THEN 'js' ELSE 'http' END AS strategy FROM (SELECT *, {HOST.format(u='url')} AS host FROM pages) GROUP BY host")
def a28(t: Tables) -> DataFrame:
    p = t.pages.select(S.url_host(F.col("url")).alias("host"), F.regexp_count("html", F.lit("<p[ >]")).alias("p"), F.regexp_count("html", F.lit("<a ")).alias("a"))
    return A.elect_strategy(p, "host", "p", "a")


_VOID = ", ".join(f"'{x}'" for x in sorted(H._NO_END))
#: Elements as intervals. An end tag closes the nearest open element of its name and all inside it: an element ends with its own
#: end tag (of the same name and level) or with that of an element around it, whichever comes first. Scripts, styles and comments hold no elements.
_ELEMENTS = f"""WITH h AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(script|style)[^>]*>).*?(</(script|style)>)', '\\1\\3', 'gis') AS h FROM pages),
k AS (SELECT *, x LIKE '</%' AS closes, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM (SELECT page_id, url, unnest(regexp_extract_all(h, '</?[a-zA-Z][^>]*>')) AS x, generate_subscripts(regexp_extract_all(h, '</?[a-zA-Z][^>]*>'), 1) AS i FROM h)),
d AS (SELECT page_id, i FROM (SELECT page_id, unnest(string_split_regex(h, '</?[a-zA-Z][^>]*>')) AS x, generate_subscripts(string_split_regex(h, '</?[a-zA-Z][^>]*>'), 1) AS i FROM h) WHERE regexp_matches(x, '\\b[0-9]{{1,2}}:[0-9]{{2}}\\b')),
v AS (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY i ROWS UNBOUNDED PRECEDING) + CASE WHEN closes THEN 1 ELSE 0 END AS level FROM k WHERE tag NOT IN ({_VOID})),
own AS (SELECT o.page_id, o.i, coalesce(min(c.i), 1000000000) AS own FROM v o LEFT JOIN v c ON c.page_id = o.page_id AND c.tag = o.tag AND c.level = o.level AND c.closes AND c.i > o.i WHERE NOT o.closes GROUP BY 1, 2),
o AS (SELECT k.page_id, k.url, k.i, k.x, k.tag, coalesce(own.own, k.i) AS own, row_number() OVER (PARTITION BY k.page_id ORDER BY k.i) AS node FROM k LEFT JOIN own USING (page_id, i) WHERE NOT k.closes),
e AS (SELECT x.page_id, x.url, x.i, x.x, x.tag, x.node, least(x.own, coalesce(min(y.own), 1000000000)) AS ends FROM o x LEFT JOIN o y ON y.page_id = x.page_id AND y.i < x.i AND y.own > x.i GROUP BY x.page_id, x.url, x.i, x.x, x.tag, x.node, x.own),
dom AS MATERIALIZED (SELECT e.*, (SELECT count(*) FROM e y WHERE y.page_id = e.page_id AND y.i < e.i AND y.ends > e.i) + 1 AS depth, (SELECT max(y.node) FROM e y WHERE y.page_id = e.page_id AND y.i >= e.i AND (y.i < e.ends OR y.i = e.i)) AS last,
row_number() OVER (PARTITION BY e.page_id ORDER BY e.ends, e.i DESC) AS post, (SELECT count(*) FROM d WHERE d.page_id = e.page_id AND d.i > e.i AND d.i <= e.ends) AS times_within, (SELECT count(*) FROM d WHERE d.page_id = e.page_id) AS times_in_page,
nullif(regexp_extract(x, '\\sclass\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS class, nullif(regexp_extract(x, '\\shref\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS href, nullif(regexp_extract(x, '\\ssrc\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS src FROM e)
"""


def _signatures_sql(tags: str) -> str:
    """Selector, classes, href, video_above and near_duration of the wanted elements, by ranges of the element table."""
    plain = "|".join(H.CHANCE_NAMES).replace("'", "''")
    return _ELEMENTS + f""", st AS (SELECT *, list_filter(string_split_regex(coalesce(class, ''), '\\s+'), lambda c: c <> '') AS names FROM dom),
sp AS (SELECT *, concat_ws('.', tag, coalesce(list_filter(names, lambda c: regexp_matches(c, '{H.BEM.pattern}'))[1], list_filter(names, lambda c: length(c) > 2 AND NOT regexp_matches(c, '{plain}'))[1])) AS step FROM st),
w AS (SELECT * FROM sp WHERE tag IN ({tags})),
up AS (SELECT w.page_id, w.node, list(s.step ORDER BY s.depth DESC) FILTER (s.tag <> 'html') AS steps, array_to_string(list_reverse(flatten(list(list_reverse(s.names) ORDER BY s.depth DESC) FILTER (w.depth - s.depth < 3))), ' ') AS classes,
coalesce(any_value(s.times_within) FILTER (w.depth - s.depth = 4), any_value(w.times_in_page)) > 0 AS near_duration FROM w JOIN sp s ON s.page_id = w.page_id AND w.node BETWEEN s.node AND s.last AND w.depth - s.depth <= 4 GROUP BY 1, 2),
li AS (SELECT w.page_id, w.node, arg_max(s.href, s.node) FILTER (s.href IS NOT NULL) AS href, bool_or(regexp_matches(coalesce(s.href, ''), '(?i)/(video|watch|v|id)/|embed/|player/') OR contains(lower(coalesce(s.class, '')), 'go')) AS video FROM w JOIN sp s ON s.page_id = w.page_id AND w.node > s.node AND w.node <= s.last AND s.tag = 'a' GROUP BY 1, 2),
sig AS MATERIALIZED (SELECT w.page_id, w.url, w.node, array_to_string(list_reverse(steps[1:4]), ' ') AS selector, classes, li.href, coalesce(li.video, false) AS video_above, 0 AS srcset_entries, w.src, near_duration FROM w JOIN up USING (page_id, node) LEFT JOIN li USING (page_id, node))
"""


_EVIDENCE = _signatures_sql("'a'") + f""", ev AS (SELECT {HOST.format(u='url')} AS host, selector, count(*) AS repeats, count_if(near_duration) AS duration, count_if(video_above) AS video_href,
sum(CASE WHEN classes = '' THEN 0 ELSE greatest(0, len(list_filter(string_split(classes, ' '), lambda c: regexp_matches(lower(c), '{"|".join(H.POSITIVE_HINTS)}'))) - len(list_filter(string_split(classes, ' '), lambda c: regexp_matches(lower(c), '{"|".join(H.NEGATIVE_HINTS)}')))) END)::BIGINT AS class_hits,
count_if(srcset_entries > 1) AS srcset_count, count(DISTINCT page_id) AS containers FROM sig GROUP BY 1, 2),
sc AS (SELECT *, greatest(0, least(1, (CASE WHEN repeats >= 12 THEN 2 WHEN repeats >= 6 THEN 1 ELSE repeats / 12 END + CASE WHEN duration >= 3 THEN 2 ELSE greatest(duration, 0) / 3 END + CASE WHEN video_href >= 3 THEN 2 ELSE greatest(video_href, 0) / 3 END + CASE WHEN class_hits >= 3 THEN 1 ELSE greatest(class_hits, 0) / 3 END + CASE WHEN srcset_count >= 5 THEN 1 ELSE greatest(srcset_count, 0) / 5 END) / 8)) AS score FROM ev)
"""
_A24 = _EVIDENCE + "SELECT host, selector, repeats, video_href, class_hits, srcset_count, containers, round(score, 6) AS score FROM sc"


@query("a24_selector_evidence", _A24)
def a24(t: Tables) -> DataFrame:
    """Evidence for anchors, as the pages hold no images."""
    e = H.selector_evidence(H.node_signatures(t.pages, "a"))
    return e.select("host", "selector", "repeats", "video_href", "class_hits", "srcset_count", "containers", F.round("score", 6).alias("score"))


@query("a24_dom_evidence", _A24)
def a24_dom(t: Tables) -> DataFrame:
    """The same from the element table, by ranges."""
    e = H.selector_evidence(DOM.signatures(DOM.elements(t.pages), ["a"]))
    return e.select("host", "selector", "repeats", "video_href", "class_hits", "srcset_count", "containers", F.round("score", 6).alias("score"))


@query("a25_repeated_containers", _EVIDENCE + """SELECT host, selector, rank, repeats, containers FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, selector)::INT AS rank FROM sc WHERE containers >= 3 AND repeats >= 2) WHERE rank <= 10""")
def a25(t: Tables) -> DataFrame:
    return H.repeated_containers(H.selector_evidence(H.node_signatures(t.pages, "a"))).select("host", "selector", "rank", "repeats", "containers")


@query("f19_stable_selectors", _signatures_sql("'p', 'h1'") + "SELECT selector, count(*) AS n FROM sig GROUP BY 1")
def f19(t: Tables) -> DataFrame:
    return H.node_signatures(t.pages, "p,h1").groupBy("selector").agg(F.count(F.lit(1)).alias("n"))


@query("f19_dom_elements", _ELEMENTS + "SELECT page_id, node, last, post, depth, tag, class, href FROM dom")
def f19_elements(t: Tables) -> DataFrame:
    return DOM.elements(t.pages).select("page_id", *[F.col(c).cast("long").alias(c) for c in ("node", "last", "post", "depth")], "tag", "class", "href")


@query("f19_dom_signatures", _signatures_sql("'a', 'p', 'b', 'h1', 'title'") + "SELECT page_id, node, selector, classes, href, video_above, near_duration FROM sig")
def f19_signatures(t: Tables) -> DataFrame:
    """Selector, classes and links above of each element of five kinds, by ranges of the element table."""
    s = DOM.signatures(DOM.elements(t.pages), ["a", "p", "b", "h1", "title"])
    return s.select("page_id", F.col("node").cast("long").alias("node"), "selector", "classes", "href", "video_above", "near_duration")


@query("w2_first_seen_links", ANCHORS + "SELECT page_id, target, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY pos) AS rn FROM a) WHERE rn = 1")
def w2(t: Tables) -> DataFrame:
    return W.top_n(H.anchors(t.pages), ["page_id", "target"], [F.col("pos")], 1).select("page_id", "target", "pos")


@query("w4_site_caps", f"SELECT page_id, host FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM (SELECT page_id, {HOST.format(u='url')} AS host FROM pages)) WHERE rn <= 3")
def w4(t: Tables) -> DataFrame:
    return G.host_caps(t.pages.select("page_id", S.url_host(F.col("url")).alias("host")), "host", ["page_id"], 3)


@query("u2_link_union", ANCHORS + "SELECT DISTINCT target FROM a WHERE target IS NOT NULL UNION SELECT regexp_replace(url, '#.*$', '') FROM pages")
def u2(t: Tables) -> DataFrame:
    return H.anchors(t.pages).select("target").union(t.pages.select(F.regexp_replace("url", "#.*$", ""))).distinct()


@query("u3_unchecked", ANCHORS + "SELECT DISTINCT target FROM a EXCEPT SELECT url FROM pages")
def u3(t: Tables) -> DataFrame:
    return H.anchors(t.pages).select("target").subtract(t.pages.select("url"))


@query("u4_bait_keys", "SELECT page_id, regexp_matches(url, '\\?([^#]*&)?(ref|page)=[^&#]') AS hit FROM pages")
def u4(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.arrays_overlap(S.query_keys(F.col("url")), F.array(F.lit("ref"), F.lit("page"))).alias("hit"))


@query("t8_category_links", ANCHORS + f", c AS (SELECT page_id, target, min(pos) AS pos FROM a WHERE regexp_matches(lower(href), '/category|/categories|/gallery|/galleries|/videos|/video|/new|/latest|/trending|/hot|/popular|/top') AND {HOST.format(u='target')} = {HOST.format(u='url')} AND NOT regexp_matches(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)), '/user|/profile|/login|/register|/admin') GROUP BY 1, 2)\nSELECT page_id, rank, target FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS rank FROM c) WHERE rank <= 10")
def t8(t: Tables) -> DataFrame:
    return H.category_links(t.pages)


@query("t4_listing_links", ANCHORS.replace("a AS (SELECT *,", "m AS (SELECT page_id, array_to_string(regexp_extract_all(html, '<(?:nav|ul|div)[^>]*class\\s*=\\s*[\"''][^\"'']*(?:nav|menu)[^\"'']*[\"''].*?</(?:nav|ul|div)>|<nav.*?</nav>', 0, 'is'), ' ') AS menus FROM pages), a AS (SELECT *,").replace(" AS pos, regexp_extract(tag,", " AS pos, tag, regexp_extract(tag,").replace("SELECT page_id, url, pos, regexp_extract(tag", "SELECT page_id, url, pos, tag, regexp_extract(tag") + f""", s AS (SELECT a.page_id, target,
CASE WHEN regexp_matches(text, '^(the|of|to|and)', 'i') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(href, '/(t|o|a)', 'i') THEN 2 ELSE 0 END + CASE WHEN contains(menus, tag) THEN 1 ELSE 0 END - CASE WHEN regexp_matches(text || ' ' || href, 'login|register|account', 'i') THEN 3 ELSE 0 END AS score
FROM a JOIN m USING (page_id) WHERE {HOST.format(u='target')} = {HOST.format(u='url')})
SELECT page_id, rank, target, score FROM (SELECT page_id, target, max(score)::INT AS score, row_number() OVER (PARTITION BY page_id ORDER BY max(score) DESC, target)::INT AS rank FROM s WHERE score > 0 GROUP BY 1, 2) WHERE rank <= 5""")
def t4(t: Tables) -> DataFrame:
    return H.listing_links(t.pages, "^(the|of|to|and)", "/(t|o|a)", "nav|menu", "login|register|account").select("page_id", "rank", "target", "score")


# ---- media of tags that are made of the pages' own addresses, as the pages hold no images

_SET = "u || '/a.jpg 320w, ' || u || '/b.jpg ' || (320 + 160 * (page_id % 5)) || 'w, ' || u || '/c.jpg 640w'"


def _addresses(t: Tables) -> DataFrame:
    u = S.normalize_url(F.col("url"))
    n = 320 + 160 * (F.col("page_id") % 5)
    return t.pages.filter("url is not null").select("page_id", u.alias("u"), F.concat(u, F.lit("/a.jpg 320w, "), u, F.lit("/b.jpg "), n, F.lit("w, "), u, F.lit("/c.jpg 640w")).alias("srcset"))


_ADDRESSES = f"WITH p AS (SELECT *, {_SET} AS srcset FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL)), e AS (SELECT page_id, regexp_extract(x, '^(\\S+)', 1) AS link, regexp_extract(x, ' ([0-9]+)w$', 1)::INT AS w, pos FROM (SELECT page_id, unnest(string_split(srcset, ', ')) AS x, unnest([1, 2, 3]) AS pos FROM p))\n"


@query("t5_widest", _ADDRESSES + "SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY w DESC, pos) AS rn FROM e) WHERE rn = 1")
def t5(t: Tables) -> DataFrame:
    return _addresses(t).select("page_id", H.widest(F.col("srcset")).alias("link"))


@query("t6_nearest_width", _ADDRESSES + "SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY abs(w - 640), pos) AS rn FROM e) WHERE rn = 1")
def t6(t: Tables) -> DataFrame:
    return _addresses(t).select("page_id", H.nearest_width(F.col("srcset")).alias("link"))


@query("f13_background_urls", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN u || '/0.png' WHEN 1 THEN u || '/1.png' WHEN 2 THEN u || '/2.png' END AS link FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL)""")
def f13(t: Tables) -> DataFrame:
    u, n = F.col("u"), F.col("page_id") % 4
    style = (
        F.when(n == 0, F.concat(F.lit("color: red; background-image: url('"), u, F.lit("/0.png')"))).when(n == 1, F.concat(F.lit('background: #fff url("'), u, F.lit('/1.png") no-repeat')))
        .when(n == 2, F.concat(F.lit("background-image:url("), u, F.lit("/2.png);"))).otherwise(F.lit("background: url(data:image/png;base64,AA)"))
    )
    return _addresses(t).select("page_id", S.background_url(style).alias("link"))


@query("f17_image_sources", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN u || '/src.jpg' WHEN 1 THEN u || '/lazy.jpg' WHEN 2 THEN u || '/tn.jpg' WHEN 3 THEN u || '/wide.jpg' ELSE u || '/bg.jpg' END AS link
FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL)""")
def f17(t: Tables) -> DataFrame:
    u, n = F.col("u"), F.col("page_id") % 5
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    tag = (
        F.when(n == 0, text('<img data-src="', u, '/late.jpg" src="', u, '/src.jpg">')).when(n == 1, text('<img src="data:image/gif;base64,R0" data-lazy-src="', u, '/lazy.jpg">'))
        .when(n == 2, text('<img alt="x" data-tn="', u, '/tn.jpg" srcset="', u, '/a.jpg 640w">')).when(n == 3, text('<img srcset="', u, "/a.jpg 1x, ", u, '/wide.jpg 2x">'))
        .otherwise(text('<img style="background-image: url(', u, '/bg.jpg)">'))
    )
    return _addresses(t).select("page_id", H.image_source(tag).alias("link"))


@query("f14_jsonld_media", """SELECT page_id, array_to_string([u || '/t.jpg', u || '/i.jpg', u || '/c1.jpg', u || '/c2.jpg'], ' ') AS links FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL)""")
def f14(t: Tables) -> DataFrame:
    """A list of three items, in each of the forms; a broken block beside it."""
    one = F.struct(F.concat("u", F.lit("/t.jpg")).alias("thumbnailUrl"))
    body = F.concat_ws(",", F.to_json(one), F.to_json(F.struct(F.struct(F.concat("u", F.lit("/i.jpg")).alias("url")).alias("image"))), F.to_json(F.struct(F.array(F.concat("u", F.lit("/c1.jpg")), F.concat("u", F.lit("/c2.jpg")), F.lit("data:x")).alias("contentUrl"))))
    html = F.concat(F.lit('<script type="application/ld+json">['), body, F.lit(']</script><script type="application/ld+json">{"image": </script>'))
    return _addresses(t).select("page_id", F.array_join(H.jsonld_urls(html), " ").alias("links"))


@query("f15_json_media", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE array_to_string([u || '/a.jpg', u || '/b.PNG?x=1'], ' ') END AS links FROM (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL)""")
def f15(t: Tables) -> DataFrame:
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat("u", F.lit("/a.jpg")).alias("x.jpg"), F.lit("no image").alias("t"))).alias("list"), F.concat("u", F.lit("/b.PNG?x=1")).alias("deep")).alias("a"), F.concat("u", F.lit("/a.jpg")).alias("again")))
    return _addresses(t).select("page_id", F.array_join(H.json_media(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"open": '), deep)).otherwise(deep)), " ").alias("links"))


@query("s3_objects", "SELECT name FROM (VALUES ('documents'), ('benchmark'), ('conversations'), ('customer'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) AS v(name)")
def s3(t: Tables) -> DataFrame:
    """Stored objects of the folder by extension, documents first; of a table in many files, its name once."""
    found = readers.objects(t.spark, t.folder, "*.parquet", first="documents")
    return found.select(F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1).alias("name")).filter("name <> ''").distinct()


@query("s4_lines", "SELECT trim(url) AS url FROM pages WHERE regexp_matches(url, '^https?://', 'i') AND page_id % 4 <> 0")
def s4(t: Tables) -> DataFrame:
    """A list made of the pages' addresses, with comments, blank lines and others than http."""
    n, path = F.col("page_id") % 4, shared_path(t.spark)
    line = F.when(n == 0, F.concat(F.lit("# "), "url")).when(n == 1, F.concat(F.lit("  "), "url", F.lit(" \n\nftp://x.example.com/"))).otherwise(F.col("url"))
    t.pages.filter("url is not null").select(line.alias("value")).write.text(path)
    return readers.lines(t.spark, path)


@query("g1_link_edges", ANCHORS + f"SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, regexp_replace(target, '#.*$', '') AS dst FROM a WHERE {HOST.format(u='target')} = {HOST.format(u='url')} AND NOT regexp_matches(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)), '/login|/register|/logout|/signup|/signin|/auth')")
def g1(t: Tables) -> DataFrame:
    return H.link_edges(t.pages)


@query("g2_walk", "WITH RECURSIVE" + ANCHORS.removeprefix("WITH") + f""", e AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, regexp_replace(target, '#.*$', '') AS dst FROM a WHERE {HOST.format(u='target')} = {HOST.format(u='url')} AND NOT regexp_matches(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)), '/login|/register|/logout|/signup|/signin|/auth')),
h AS (SELECT DISTINCT regexp_extract(src, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) AS src, src AS dst FROM e), b AS (SELECT * FROM e UNION SELECT * FROM h),
w AS (SELECT DISTINCT src AS node, 0 AS level FROM h UNION SELECT b.dst, w.level + 1 FROM w JOIN b ON b.src = w.node WHERE w.level < 2)
SELECT node, min(level) AS level FROM w GROUP BY node""")
def g2(t: Tables) -> DataFrame:
    """From each host's root page over its links, two levels."""
    root = F.regexp_extract("src", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    edges = H.link_edges(t.pages)
    hosts = edges.select(root.alias("src"), F.col("src").alias("dst")).distinct()
    return G.walk(edges.unionByName(hosts), hosts.select(F.col("src").alias("node")), 2)


def _with_media(t: Tables) -> DataFrame:
    """The pages, and in two of three of them an image, an og:image and a script's picture that they don't hold themselves."""
    n, u = F.col("page_id") % 3, S.normalize_url(F.col("url"))
    image = F.when(n == 0, F.concat(F.lit('<img src="data:x" data-src="'), u, F.lit('/i.jpg" width="7">'))).otherwise("")
    more = F.when(n < 2, F.concat(F.lit('<meta property="og:image" content="'), u, F.lit('/o.png"><script>x("'), u, F.lit('/i.jpg")</script>'))).otherwise("")
    return t.pages.filter("url is not null").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), image, more).alias("html"))


_MEDIA = """WITH p AS (SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS u FROM pages WHERE url IS NOT NULL), m AS (
SELECT page_id, u || '/i.jpg' AS target, CASE WHEN page_id % 3 = 0 THEN 'img' ELSE 'script' END AS method, 'image/jpeg' AS media_type, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 4 END AS priority FROM p WHERE page_id % 3 < 2
UNION ALL SELECT page_id, u || '/o.png', 'og:image', 'image/png', 2 FROM p WHERE page_id % 3 < 2)
"""


@query("g3_media_references", _MEDIA + "SELECT page_id, target, method, media_type FROM m")
def g3(t: Tables) -> DataFrame:
    return H.media_references(_with_media(t)).select("page_id", "target", "method", "media_type")


@query("g4_first_rule", _MEDIA + "SELECT page_id, target, method FROM m QUALIFY priority = min(priority) OVER (PARTITION BY page_id)")
def g4(t: Tables) -> DataFrame:
    return H.first_rule(H.media_references(_with_media(t))).select("page_id", "target", "method")


# ---- streams: the events table, drained once ------------------------------


def _events(t: Tables) -> DataFrame:
    return readers.stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema)


def _drained(t: Tables, df: DataFrame) -> DataFrame:
    out, checkpoint = shared_path(t.spark), shared_path(t.spark)
    T.run(df, out, checkpoint).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("st1_ingest_dlq", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing: kind' END AS error FROM events")
def st1(t: Tables) -> DataFrame:
    good, dead, checkpoint = (shared_path(t.spark) for _ in range(3))
    stream = _events(t).withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    T.ingest(stream, ["user_id", "kind"], good, dead, checkpoint).awaitTermination()
    read = lambda p: t.spark.read.option("recursiveFileLookup", "true").parquet(p)
    return read(dead).select("event_id", "error").unionByName(read(good).select("event_id", F.lit(None).cast("string").alias("error")))


@query("st2_drain", "SELECT event_id, user_id FROM events")
def st2(t: Tables) -> DataFrame:
    return _drained(t, _events(t).select("event_id", "user_id"))


@query("st3_ttl_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st3(t: Tables) -> DataFrame:
    """A time to live longer than the table lasts: one row a key, whatever the order."""
    return _drained(t, T.ttl_dedup(_events(t), ["user_id", "event_type"], ttl="3650 days").select("user_id", "event_type"))


@query("st4_idle_sessions", """SELECT user_id, count(*) AS n, min(ts)::VARCHAR AS first_seen FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def st4(t: Tables) -> DataFrame:
    s = T.idle_sessions(t.events, ["user_id"], ttl="6 hours")
    return s.select("user_id", "n", F.col("start").cast("timestamp_ntz").cast("string").alias("first_seen"))


@query("st5_limit_decisions", """SELECT event_id, m <= 1 AND h <= 2 AS allowed FROM (SELECT event_id, m, sum(CASE WHEN m <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS h
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS m FROM events))""")
def st5(t: Tables) -> DataFrame:
    return T.limit_decisions(t.events, "event_type", "ts", "event_id", 1, 2).select("event_id", "allowed")


def _stateful(t: Tables, step, outputs: str, key: str = "user_id") -> DataFrame:
    e = T.with_event_time(t.events).select("event_id", key, "ts", (F.col("event_type") != "error").alias("ok"))
    return T.stateful(e, key, "ts", "event_id", step, outputs, "")


@query("st6_token_bucket")
def st6(t: Tables) -> DataFrame:
    return _stateful(t, T.token_bucket(1 / 36_000, 3.0, 864_000.0), "allowed boolean, tokens double")


@query("st7_batches")
def st7(t: Tables) -> DataFrame:
    return _stateful(t, T.batcher(), "batch long, place long")


@query("st8_circuit_breaker")
def st8(t: Tables) -> DataFrame:
    return _stateful(t, T.circuit_breaker(5, 0.25), "before string, after string")


@query("s5_bounded_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s5(t: Tables) -> DataFrame:
    """Drained in batches of one file, counted over all."""
    return _drained(t, _events(t).select("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_LATE = """SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR, false) AS late FROM events"""


@query("st12_late", f"SELECT event_id, late FROM ({_LATE})")
def st12(t: Tables) -> DataFrame:
    """Rows that come over an hour behind what their user has sent before, in the order of arrival (event_id)."""
    return T.late_flags(t.events, "user_id", "ts", "event_id", "1 hour").select("event_id", "late")


@query("st9_live_counters", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def st9(t: Tables) -> DataFrame:
    """Counters in update mode; the last batch that changed a counter has its value."""
    out, checkpoint = shared_path(t.spark), shared_path(t.spark)
    live = T.live_counters(_events(t), "user_id")
    live.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    seen = t.spark.read.option("recursiveFileLookup", "true").parquet(out)
    return W.top_n(seen, ["user_id"], [F.col("batch").desc()], 1).select("user_id", "n")


@query("st10_idempotency", "SELECT DISTINCT props FROM events")
def st10(t: Tables) -> DataFrame:
    return _drained(t, T.ttl_dedup(_events(t), ["props"], ttl="3650 days").select("props"))


@query("st11_lifecycle", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status, min(ts)::VARCHAR AS created, max(ts)::VARCHAR AS updated, round(sum(value), 4) AS total FROM events GROUP BY 1")
def st11(t: Tables) -> DataFrame:
    r = T.lifecycle(t.events, "user_id", "event_type", "ts", "event_id", "value")
    return r.select("user_id", "status", F.col("created").cast("string").alias("created"), F.col("updated").cast("string").alias("updated"), F.round("total", 4).alias("total"))


# ---- streams in event-time order: the events as they might arrive, some of them late ------

BATCHES, FILES = 4, 8
#: Every ninth event arrives eight hours after its time, the others within two minutes; a batch holds what arrives in eight days. A row is late
#: if it lies over two hours behind the latest of earlier batches.
_ARRIVALS = f"""WITH RECURSIVE a AS (SELECT *, epoch_ms(ts) AS ms, greatest(0, least({BATCHES - 1}, (epoch_ms(ts) + CASE WHEN event_id % 9 = 0 THEN 28800000 ELSE event_id * 7919 % 120 * 1000 END - 1704067200000) // 691200000)) AS batch FROM events),
m AS (SELECT b.batch, max(a.ms) - 7200000 AS mark FROM (SELECT DISTINCT batch FROM a) b JOIN a ON a.batch < b.batch GROUP BY 1),
l AS (SELECT a.*, coalesce(a.ms < m.mark, false) AS late FROM a LEFT JOIN m USING (batch)),
"""


def _arriving(t: Tables) -> DataFrame:
    e = t.events
    behind = F.when(F.col("event_id") % 9 == 0, 28_800_000).otherwise(F.col("event_id") * 7919 % 120 * 1000)
    batch = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) + behind - 1_704_067_200_000) / 691_200_000)
    e = e.withColumn("batch", F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), batch)))
    path = shared_path(t.spark)
    for i in range(BATCHES):
        e.filter(F.col("batch") == i).drop("batch").repartition(FILES).write.mode("append").parquet(path)
    heartbeat = t.events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))  # one row without a name
    heartbeat.select(*[F.col(c) if c == "ts" else F.lit(None).cast(k).alias(c) for c, k in t.events.dtypes]).write.mode("append").parquet(path)
    return readers.stream(t.spark, path, t.events.schema, FILES)


def _in_order(t: Tables, keys: list[str], how: tuple) -> DataFrame:
    stream = O.in_order(_arriving(t), keys, "ts", "event_id", "2 hours", *how)
    out, checkpoint = shared_path(t.spark), shared_path(t.spark)
    O.drained(stream, out, checkpoint)
    return t.spark.read.schema(stream.schema).parquet(out)


def _expiring_sql(keys: str, ttl_ms: int) -> str:
    return _ARRIVALS + f"""r AS (SELECT event_id, {keys}, ms, row_number() OVER (PARTITION BY {keys} ORDER BY ms, event_id) AS n FROM l WHERE NOT late),
w AS (SELECT event_id, {keys}, n, ms + {ttl_ms} AS expiry, true AS fresh FROM r WHERE n = 1
UNION ALL SELECT r.event_id, {', '.join(f'r.{k}' for k in keys.split(', '))}, r.n, CASE WHEN r.ms >= w.expiry THEN r.ms + {ttl_ms} ELSE w.expiry END, r.ms >= w.expiry FROM w JOIN r ON {' AND '.join(f'r.{k} = w.{k}' for k in keys.split(', '))} AND r.n = w.n + 1)
SELECT event_id, late, fresh FROM l LEFT JOIN (SELECT event_id, fresh FROM w) USING (event_id)"""


@query("st3_expiring_keys", _expiring_sql("user_id, event_type", 172_800_000))
def st3_expiring(t: Tables) -> DataFrame:
    """De-duplication with a time to live of two days from a key's last fresh row; the table lasts a month."""
    return _in_order(t, ["user_id", "event_type"], O.expiring(172_800_000, renew=False)).select("event_id", "late", "fresh")


@query("st4_renewed_keys", _ARRIVALS + """r AS (SELECT event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM l WHERE NOT late)
SELECT event_id, late, CASE WHEN NOT late THEN coalesce(gap >= 21600000, true) END AS fresh FROM l LEFT JOIN r USING (event_id)""")
def st4_renewed(t: Tables) -> DataFrame:
    """A time to live of six hours that each row renews."""
    return _in_order(t, ["user_id"], O.expiring(21_600_000, renew=True)).select("event_id", "late", "fresh")


@query("st10_expiring_requests", _expiring_sql("props", 86_400_000))
def st10_expiring(t: Tables) -> DataFrame:
    """A request (its payload is the key) counts once a day."""
    return _in_order(t, ["props"], O.expiring(86_400_000, renew=False)).select("event_id", "late", "fresh")


@query("st5_limit_stream", _ARRIVALS + """r AS (SELECT *, row_number() OVER (PARTITION BY event_type, ms // 60000 ORDER BY ms, event_id) AS n FROM l WHERE NOT late),
h AS (SELECT event_id, n, sum(CASE WHEN n <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, ms // 3600000 ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS h FROM r)
SELECT event_id, late, n <= 1 AND h <= 2 AS allowed FROM l LEFT JOIN h USING (event_id)""")
def st5_stream(t: Tables) -> DataFrame:
    """The decisions of the batch form, made on a stream in several batches."""
    return _in_order(t, ["event_type"], O.limits(1, 2)).select("event_id", "late", "allowed")


@query("st12_late_side_table", _ARRIVALS + "s AS (SELECT event_id, CASE WHEN late THEN 'late' ELSE 'on_time' END AS side FROM l) SELECT event_id, side FROM s")
def st12_side(t: Tables) -> DataFrame:
    """Late rows in a table of their own; both tables together hold every row."""
    stream = O.in_order(_arriving(t), ["user_id"], "ts", "event_id", "2 hours", *O.limits(60, 1000))
    on_time, late, checkpoint = (shared_path(t.spark) for _ in range(3))
    O.drained_apart(stream, on_time, late, checkpoint)
    read = lambda p, side: t.spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(p).select("event_id", F.lit(side).alias("side"))
    return read(on_time, "on_time").unionByName(read(late, "late"))
