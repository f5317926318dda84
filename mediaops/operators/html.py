"""Links, media references and selector statistics from stored pages.

Attributes and anchors come out by pattern, inside the JVM. Only ancestry (which
element lies in which) needs a parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import media_url
from ..functions.scalars import background_url, int_or_null, media_type_of, url_host, url_join, url_path
from .aggregates import evidence_score

# Fixed values of the selector and link rules.
SOURCE_ATTRS = ["src", "data-src", "data-lazy-src", "data-original", "data-medium", "data-large", "data-lazy", "data-highres", "data-mediumthumb", "data-thumb", "data-image", "data-tn"]
CATEGORY_PATHS = ["/category", "/categories", "/gallery", "/galleries", "/videos", "/video", "/new", "/latest", "/trending", "/hot", "/popular", "/top"]
SKIPPED_PATHS = ["/user", "/profile", "/login", "/register", "/admin"]
AUTH_PATHS = ["/login", "/register", "/logout", "/signup", "/signin", "/auth"]
JSONLD_FIELDS = ["thumbnailUrl", "image", "contentUrl"]
POSITIVE_HINTS = ["thumb", "thumbnail", "preview", "poster", "image", "img", "pic", "picture", "cover", "artwork", "screenshot", "still", "frame", "snapshot", "gallery", "media", "visual", "display"]
NEGATIVE_HINTS = ["icon", "logo", "avatar", "profile", "social", "share", "button", "nav", "menu", "header", "footer", "sidebar", "banner", "ad", "sponsor", "sponsored", "advertisement", "promo", "promotion"]
EXTRA_SOURCES = [
    ("og:image", r"(?i)<meta[^>]+property\s*=\s*[\"']og:image[\"']"), ("image_src", r"(?i)<link[^>]+rel\s*=\s*[\"']image_src[\"']"), ("poster", r"(?i)<video[^>]+poster\s*="),
    ("img_srcset", r"(?i)<img[^>]+srcset\s*="), ("source_srcset", r"(?i)<source[^>]+srcset\s*="), ("json_ld", r"(?i)<script[^>]+application/ld\+json"),
    ("background", r"(?i)style\s*=\s*[\"'][^\"']*background"), ("noscript", r"(?i)<noscript"),
]
MEDIA_URL = r"https?://[^\s\"'<>\\)]+?\.(?:jpe?g|png|webp|gif|bmp)"
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def attr(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, null when it has none or an empty one."""
    return F.nullif(F.regexp_extract(tag, rf"(?is)(?<![\w-]){name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def anchors(pages: DataFrame, dots: bool = True, flags: Column | None = None) -> DataFrame:
    """page_id, url, pos, href, text, target: every anchor of a page with a link, in page order.

    ``flags``, an array with a place for each anchor, comes along as ``flag``."""
    tags = F.regexp_extract_all("html", F.lit(ANCHOR), 0)
    each = tags if flags is None else F.zip_with(tags, flags, lambda t, f: F.struct(t.alias("tag"), f.alias("flag")))
    rows = pages.select("page_id", "url", F.posexplode(each).alias("pos", "_a"))
    tag, more = (F.col("_a"), []) if flags is None else (F.col("_a.tag"), [F.col("_a.flag").alias("flag")])
    href, text = F.regexp_extract(tag, ANCHOR, 1), F.trim(F.regexp_replace(F.regexp_extract(tag, ANCHOR, 2), "<[^>]*>", ""))
    return rows.select("page_id", "url", "pos", href.alias("href"), text.alias("text"), tag.alias("tag"), *more).withColumn("target", url_join(F.col("url"), F.col("href"), dots))


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct links inside a host, without the ones for signing in."""
    a = anchors(pages)
    path = F.lower(url_path(F.col("target")))
    keep = (url_host(F.col("target")) == url_host(F.col("url"))) & ~path.rlike("|".join(map(re.escape, AUTH_PATHS)))
    return a.filter(keep).select(F.regexp_replace("url", "#.*$", "").alias("src"), F.regexp_replace("target", "#.*$", "").alias("dst")).distinct()


def category_links(pages: DataFrame, n: int = 10) -> DataFrame:
    """A page's first links that look like listings, same host, in page order."""
    a = anchors(pages)
    path = F.lower(url_path(F.col("target")))
    keep = F.lower("href").rlike("|".join(map(re.escape, CATEGORY_PATHS))) & (url_host(F.col("target")) == url_host(F.col("url"))) & ~path.rlike("|".join(map(re.escape, SKIPPED_PATHS)))
    first = a.filter(keep).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n).select("page_id", "rank", "target")


def listing_links(pages: DataFrame, good_text: str, good_href: str, nav_class: str, bad: str, n: int = 5) -> DataFrame:
    """A page's best n listing links: +3 for the text, +2 for the link, +1 inside a menu, -3 for a bad word."""
    menus = F.regexp_extract_all("html", F.lit(rf"(?is)<(?:nav|ul|div)[^>]*class\s*=\s*[\"'][^\"']*(?:{nav_class})[^\"']*[\"'].*?</(?:nav|ul|div)>|<nav.*?</nav>"), 0)
    a = anchors(pages.withColumn("_menus", F.concat_ws(" ", menus)), True, F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), 0), lambda t: F.col("_menus").contains(t)))
    one = lambda cond, k: F.when(cond, k).otherwise(0)
    score = one(F.col("text").rlike(f"(?i){good_text}"), 3) + one(F.col("href").rlike(f"(?i){good_href}"), 2) + one(F.col("flag"), 1) - one(F.concat_ws(" ", "text", "href").rlike(f"(?i){bad}"), 3)
    best = a.filter(url_host(F.col("target")) == url_host(F.col("url"))).withColumn("score", score).filter("score > 0").groupBy("page_id", "target").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("score").desc(), "target"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= n)


def srcset_entries(srcset: Column) -> Column:
    """array<struct<pos, url, width>> of a srcset; ``2x`` counts as 640 wide, entries without a descriptor as 0."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda e: F.trim(e)), lambda e: e != "")

    def entry(e: Column, i: Column) -> Column:
        d = F.regexp_extract(e, r"\s([0-9.]+)([wx])\s*$", 1)
        unit = F.regexp_extract(e, r"\s([0-9.]+)([wx])\s*$", 2)
        width = F.when(unit == "w", d.try_cast("double")).when(unit == "x", d.try_cast("double") * 320).otherwise(0.0)
        return F.struct(i.alias("pos"), F.regexp_extract(e, r"^(\S+)", 1).alias("url"), width.alias("width"))

    return F.transform(parts, entry)


def widest(srcset: Column) -> Column:
    """Widest entry; of equal ones the first."""
    best = F.array_max(F.transform(srcset_entries(srcset), lambda s: F.struct(s["width"].alias("w"), (-s["pos"]).alias("p"), s["url"].alias("url"))))
    return best["url"]


def nearest_width(srcset: Column, wanted: int = 640) -> Column:
    """Entry with a ``w`` descriptor nearest to a width; of equal ones the first."""
    wide = F.filter(srcset_entries(srcset), lambda s: s["width"] > 0)
    return F.array_min(F.transform(wide, lambda s: F.struct(F.abs(s["width"] - wanted).alias("d"), s["pos"].alias("pos"), s["url"].alias("url"))))["url"]


def image_source(tag: Column, order: list[str] = SOURCE_ATTRS) -> Column:
    """First source of an image tag: attributes in order, then the widest of its srcset, then its background."""
    return F.coalesce(*[F.when(~attr(tag, a).startswith("data:"), attr(tag, a)) for a in order], widest(attr(tag, "srcset")), background_url(F.regexp_extract(tag, r"(?is)style\s*=\s*\"([^\"]*)\"", 1)))


def jsonld_urls(html: Column) -> Column:
    """Media URLs of JSON-LD blocks, of an object or of every item of a list: text, object with a url, and lists of
    either. Broken JSON and ``data:`` URLs are left out."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    none = F.array().cast("array<string>")

    def of_value(v: Column) -> Column:
        one = lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$.url", "string"))
        return F.coalesce(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), F.array(one(v)))

    def of_item(item: Column) -> Column:
        return F.flatten(F.array(*[F.coalesce(of_value(F.try_variant_get(item, f"$.{f}", "variant")), none) for f in JSONLD_FIELDS]))

    def of_body(b: Column) -> Column:
        v = F.try_parse_json(b)
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        return F.flatten(F.transform(items, of_item))

    return F.array_distinct(F.filter(F.flatten(F.transform(bodies, of_body)), lambda u: u.isNotNull() & (u != "") & ~u.startswith("data:")))


def json_media(text: Column) -> Column:
    """Image-like strings at any depth of a JSON text, in its order; none of a broken one."""
    strings = F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)')
    every = F.zip_with(F.regexp_extract_all(text, strings, 1), F.regexp_extract_all(text, strings, 2), lambda x, colon: F.when(colon == "", x))
    plain = F.transform(F.array_compact(every), lambda x: F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string"))
    found = F.array_distinct(F.filter(plain, lambda x: x.rlike(r"(?i)\.(jpe?g|png|webp|gif|bmp)(\?|$)")))
    return F.when(F.try_parse_json(text).isNotNull(), found).otherwise(F.array().cast("array<string>"))


def script_media(html: Column) -> Column:
    """Media URLs that stand in scripts and in noscript parts."""
    parts = F.concat_ws("\n", F.regexp_extract_all(html, F.lit(r"(?is)<(?:noscript|script)[^>]*>(.*?)</(?:noscript|script)>"), 1))
    return F.array_distinct(F.regexp_extract_all(parts, F.lit(f"(?i){MEDIA_URL}"), 0))


def extra_sources(html: Column) -> Column:
    return F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(n)) for n, p in EXTRA_SOURCES]))


def hint_counts(html: Column) -> list[Column]:
    """Durations, video links and class hints of a page."""
    classes = F.concat_ws(" ", F.regexp_extract_all(F.lower(html), F.lit(r"class\s*=\s*[\"']([^\"']*)[\"']"), 1))
    return [
        F.regexp_count(html, F.lit(r"\b[0-9]{1,2}:[0-9]{2}\b")).alias("durations"), F.regexp_count(F.lower(html), F.lit(r"href\s*=\s*[\"'][^\"']*(/(video|watch|v|id)/|embed/|player/)")).alias("video_links"),
        F.regexp_count(classes, F.lit("|".join(POSITIVE_HINTS))).alias("positive_hints"), F.regexp_count(classes, F.lit("|".join(NEGATIVE_HINTS))).alias("negative_hints"),
    ]


def image_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<img[\s>/]"))


def media_references(pages: DataFrame) -> DataFrame:
    """page_id, target, method, priority, width, height, media_type: media of a page, each URL once by its best rule.

    Links come out of generators, which keeps their long expressions from being copied into every filter above."""
    tags = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<img[^>]*>"), 0)).alias("pos", "tag"))
    images = tags.select("page_id", "url", F.lit("img").alias("method"), F.lit(1).alias("priority"), "pos", F.explode(F.array(image_source(F.col("tag")))).alias("link"), int_or_null(attr(F.col("tag"), "width")).alias("width"), int_or_null(attr(F.col("tag"), "height")).alias("height"))

    def listed(name: str, priority: int, urls: Column) -> DataFrame:
        return pages.select("page_id", "url", F.lit(name).alias("method"), F.lit(priority).alias("priority"), F.posexplode(urls).alias("pos", "link"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))

    meta = F.regexp_extract_all("html", F.lit(r"(?is)<meta[^>]*og:image[^>]*content\s*=\s*[\"']([^\"']+)"), 1)
    every = images.unionByName(listed("og:image", 2, meta)).unionByName(listed("json_ld", 3, jsonld_urls(F.col("html")))).unionByName(listed("script", 4, script_media(F.col("html"))))
    good = every.filter("link is not null").withColumn("target", url_join(F.col("url"), F.col("link"))).filter(media_url(F.col("target")))
    rn = F.row_number().over(Window.partitionBy("page_id", "target").orderBy("priority", "pos"))
    return good.withColumn("_rn", rn).filter("_rn = 1").select("page_id", "target", "method", "priority", "width", "height", media_type_of(F.col("target")).alias("media_type"))


def first_rule(media: DataFrame) -> DataFrame:
    """Only what the first rule with any hit on its page has found."""
    return media.withColumn("_best", F.min("priority").over(Window.partitionBy("page_id"))).filter("priority = _best").drop("_best")


# How a class name of a block, element and modifier looks, and how names made by chance look.
BEM = re.compile(r"^[a-z0-9]+(?:[-_]{1,2}[a-z0-9]+)+$")
CHANCE_NAMES = [
    r"^[a-f0-9]{8,}$",
    r"^[0-9]+$",
    r"[A-Z]{3,}",
    r"_[a-f0-9]{6,}_",
    r"^[a-z]{1,2}[0-9]{4,}$",
    r"^[0-9]{4,}[a-z]{1,2}$",
]
DURATION = re.compile(r"\b[0-9]{1,2}:[0-9]{2}\b")
VIDEO_LINK = re.compile(r"/(video|watch|v|id)/|embed/|player/", re.I)
_NO_END = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _stable(tag: str, classes: list[str]) -> str:
    named = next((c for c in classes if BEM.match(c)), None) or next((c for c in classes if len(c) > 2 and not any(re.search(p, c) for p in CHANCE_NAMES)), None)
    return f"{tag}.{named}" if named else tag


class _Element:
    __slots__ = ("tag", "step", "classes", "href", "has_duration")

    def __init__(self, tag: str, classes: list[str], href: str | None):
        self.tag, self.step, self.classes, self.href, self.has_duration = tag, _stable(tag, classes), classes, href, False


class _Nodes(HTMLParser):
    """Rows of media tags: selector of up to four levels, classes of three levels, link above, whether a video link is above,
    srcset entries, source, and the element that the tag's surroundings of four levels lie in."""

    def __init__(self, wanted: frozenset[str]):
        super().__init__()
        self.wanted, self.stack, self.rows = wanted, [_Element("", [], None)], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.stack.append(_Element(tag, (a.get("class") or "").split(), a.get("href")))
        if tag in self.wanted:
            levels = [x for x in self.stack[1:] if x.tag != "html"][-4:]
            links = [x for x in self.stack[1:-1] if x.tag == "a"]
            video = any(VIDEO_LINK.search(x.href or "") or any("go" in c.lower() for c in x.classes) for x in links)
            href = next((x.href for x in reversed(links) if x.href), None)
            entries = len([e for e in (a.get("srcset") or "").split(",") if e.strip()])
            self.rows.append((" ".join(x.step for x in levels), " ".join(c for x in self.stack[1:][-3:] for c in x.classes), href, video, entries, a.get("src"), self.stack[max(len(self.stack) - 5, 0)]))
        if tag in _NO_END:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if DURATION.search(data):
            for x in self.stack:
                x.has_duration = True


def node_signatures(pages: DataFrame, wanted: str = "img,video,source") -> DataFrame:
    """page_id, url and a row for each wanted tag: selector, classes, href, video_above, srcset_entries, src, near_duration."""
    tags = frozenset(wanted.split(","))
    kind = dict(pages.dtypes)["page_id"]
    made = [("selector", pa.string()), ("classes", pa.string()), ("href", pa.string()), ("video_above", pa.bool_()), ("srcset_entries", pa.int32()), ("src", pa.string()), ("near_duration", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, html in enumerate(b.column("html").to_pylist()):
                if html:
                    p = _Nodes(tags)
                    p.feed(html)
                    p.close()
                    rows += [(*r[:-1], r[-1].has_duration) for r in p.rows]
                    at += [i] * len(p.rows)
            take = pa.array(at, pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(made)
            yield pa.record_batch({"page_id": b.column("page_id").take(take), "url": b.column("url").take(take), **{n: pa.array(c, t) for (n, t), c in zip(made, columns, strict=True)}})

    schema = f"page_id {kind}, url string, selector string, classes string, href string, video_above boolean, srcset_entries int, src string, near_duration boolean"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def selector_evidence(nodes: DataFrame) -> DataFrame:
    """host, selector, repeats, video_href, class_hits, srcset_count, score of node rows."""
    n = lambda words: F.size(F.filter(F.split("classes", " "), lambda c: F.lower(c).rlike("|".join(words))))
    hits = F.when(F.col("classes") == "", 0).otherwise(F.greatest(F.lit(0), n(POSITIVE_HINTS) - n(NEGATIVE_HINTS)))
    host = url_host(F.col("url")).alias("host")
    sums = nodes.groupBy(host, "selector").agg(
        F.count(F.lit(1)).alias("repeats"), F.count_if("near_duration").alias("duration"), F.count_if("video_above").alias("video_href"), F.sum(hits).alias("class_hits"),
        F.count_if(F.col("srcset_entries") > 1).alias("srcset_count"), F.count_distinct("page_id").alias("containers"),
    )
    # twelve samples of a selector: distinct sources are ranked, so that none is gathered whole
    rank = F.row_number().over(Window.partitionBy("host", "selector").orderBy("src"))
    some = nodes.filter("src is not null").select(host, "selector", "src").distinct().withColumn("_rank", rank).filter("_rank <= 12").groupBy("host", "selector").agg(F.sort_array(F.collect_list("src")).alias("samples"))
    met = sums.join(some, ["host", "selector"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return met.withColumn("score", evidence_score(F.col("repeats"), F.col("duration"), F.col("video_href"), F.col("class_hits"), F.col("srcset_count")))


def repeated_containers(evidence: DataFrame, containers: int = 3, nodes: int = 2, n: int = 10) -> DataFrame:
    """A host's best n selectors among those that repeat."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("score").desc(), "selector"))
    return evidence.filter((F.col("containers") >= containers) & (F.col("repeats") >= nodes)).withColumn("rank", rank).filter(F.col("rank") <= n)
