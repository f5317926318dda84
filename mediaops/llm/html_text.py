"""Main-text extraction by site style trees.

Pages of one host are merged: a presentation node is a tag path with each tag's
class, id and place among like siblings. The sequences of children seen under it are
its styles, and the distinct texts its contents. A node's importance weighs the
entropy of both over the host's pages, each relative to the largest possible for
the pages that have it: a menu looks and says the same everywhere, an article never
does. Each page then drops the branches of low importance; inside an element that
states the main content, only those that hardly vary.

Parts that differ on every page but are never article text (forms, menus, adverts,
reader comments) are told by their element or, if all words of a class or id say
so, by name. That doesn't hold for an element around the article: if a page's only
<article> or <main>, or without those most of its paragraphs, lies in it, it stays.

Statistics are sums over (host, node, content), so a host with any share of all
pages is spread by content before it is reduced to one row a node.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Nodes of lower importance are dropped where at least MIN_PAGES pages show them.
MIN_IMPORTANCE = 0.5
MIN_IMPORTANCE_STATED = 0.1  # inside <article> and <main>
MIN_PAGES = 5
GAMMA = 0.9  # to the power of a node's kinds of children: what its contents weigh, against its styles

# Fixed values of HTML: elements by how they behave.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset(
    "head title style script noscript template button select textarea input option label legend datalist dialog iframe object embed "
    "svg canvas audio video noembed noframes xmp".split()
)
_SIDE = frozenset("nav footer aside form menu search header".split())
_MAIN = frozenset("article main".split())
_PARAGRAPH = frozenset("p pre blockquote dd".split())
_ENDS_P = _BLOCK - {"html", "body"}
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
_HEADERS = frozenset("header masthead banner".split())
#: Words of a header that is an article's own.
_ARTICLE_WORDS = frozenset("article content entry post section story title".split())
#: Words that inside an article name parts of it as well: a warning, the dishes of a restaurant.
_OWN = frozenset("menu notice notices".split())
_SIDE_WORDS = _COMMENTS | _HEADERS | frozenset(
    "ad ads adbox advert adverts advertisement advertising banners sponsor sponsored promo promotion sidebar rail nav navbar navigation menu "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal "
    "overlay share sharing social related recommended recommendations pagination pager toolbar".split()
)
#: Words of a class that say nothing of what the part is.
_PLAIN_WORDS = frozenset("area bar block bottom box col column container div global group inner item items left link links list main outer page panel post posts articles stories primary reader right secondary section site slot top unit user wrap wrapper the".split())
#: Words that tell even of a paragraph or a link that it is no part of the text.
_STRONG = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe share sharing".split())
_SMALL = frozenset("p a b i em strong small figure h2 h3 h4 h5 h6".split())
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_CONTAINERS = frozenset("address article aside body center details div dl fieldset figure footer form header main menu nav ol search section table tbody td tr ul li span".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


def _attributes(attrs: str) -> tuple[str, set[str], bool]:
    """The presentation part of a tag's attributes, the words of side parts that they consist of, and whether they hide it."""
    style, side, hidden = "", set(), False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            value = " ".join(value.split())
            style += ("." if name == "class" else "#") + value
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words & _SIDE_WORDS and words <= _SIDE_WORDS | _PLAIN_WORDS or re.fullmatch("(?i)(.*[-_])?ads?([-_].*)?", one):
                    if not (words & _SIDE_WORDS <= _HEADERS and words & _ARTICLE_WORDS):
                        side |= words & _SIDE_WORDS or {"ad"}
        elif name == "role":
            side |= {value.strip().lower()} & _SIDE_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return style, side, hidden


class _Element(NamedTuple):
    """An open element: its tag, node, innermost block element and side part around it (places in the stack, and in the list of sides)."""

    tag: str
    node: int
    muted: bool
    like: dict[str, int]
    block: int
    side: int
    in_main: bool


class Page:
    """A page's nodes and blocks, in one pass. Memory is linear in the page whatever its nesting: a node holds its step and its parent, no path.

    ``parents`` and ``steps`` of each node; ``stated``: whether it lies in <article> or <main>; ``found``: node, text and
    innermost side part of each block, with whether it is a paragraph. Text is decoded, its white space is single spaces, and empty
    blocks are left out. End tags that were left out are implied as browsers imply them."""

    def __init__(self, page: str):
        self.parents, self.steps, self.stated = [-1], [""], [False]
        self.found: list[tuple[int, str, int, bool]] = []
        self.sides: list[tuple[set[str], int, bool]] = []  # what names each side part, the one around it, and whether it is too small to hold an article
        self.mains: list[int] = []  # side part around each <article> and <main>
        self.stack = [_Element("", 0, False, {}, 0, -1, False)]
        self.open: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
        self.parts: list[str] = []
        self._read(page)

    def _ended(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts.clear()
        if text:
            top = self.stack[-1]
            owner = self.stack[top.block]
            self.found.append((owner.node, text, top.side, owner.tag in _PARAGRAPH))

    def _shut(self, k: int) -> None:
        """Close the elements from place k of the stack on."""
        for x in self.stack[k:]:
            self.open[x.tag].pop()
        del self.stack[k:]

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((at[-1] for at in map(self.open.get, tags) if at), default=0)

    def _end_tag(self, tag: str) -> None:
        k = self._last((tag,))
        if tag == "p" and not k:
            self._ended()
        # a stray inline end tag closes no block
        if k and (tag in _BLOCK or k > self.stack[-1].block):
            if self.stack[-1].block >= k:
                self._ended()
            self._shut(k)

    def _start_tag(self, tag: str, attrs: str) -> bool:
        """Whether the element has content to come."""
        if tag in _BLOCK:
            self._ended()
            if tag in _ENDS_P and self.stack[self.stack[-1].block].tag == "p":
                self._shut(self.stack[-1].block)
        if tag in _CLOSED_BY:
            ends, within = map(self._last, _CLOSED_BY[tag])
            if ends and ends > within:
                self._ended()
                self._shut(ends)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            return False
        style, named, hidden = _attributes(attrs) if attrs.strip() else ("", set(), False)
        above = self.stack[-1]
        above.like[tag + style] = above.like.get(tag + style, 0) + 1
        side, in_main = above.side, above.in_main
        if in_main:  # an article's own header, a warning or a list of dishes in it
            named = named - _HEADERS - _OWN
        if tag in _SIDE and not (tag == "header" and in_main):
            named = named | {tag}
        inside = False
        if named and tag not in ("body", "html") and (tag in _CONTAINERS or tag in _SMALL and named & _STRONG):
            inside = tag not in _BLOCK  # a part of its block, which goes on after it
            if not inside:
                self.sides.append((named, side, tag in _SMALL and tag not in _CONTAINERS))
                side = len(self.sides) - 1
        if tag in _MAIN:
            self.mains.append(above.side)
        node, place = len(self.parents), len(self.stack)
        self.parents.append(above.node)
        self.steps.append(f"{tag}{style}[{above.like[tag + style]}]")
        self.stated.append(in_main or tag in _MAIN)
        self.stack.append(_Element(tag, node, above.muted or tag in _NEVER or hidden or inside, {}, place if tag in _BLOCK else above.block, side, in_main or tag in _MAIN))
        self.open.setdefault(tag, []).append(place)
        return True

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not self.stack[-1].muted:
                self.parts.append(page[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if tag == "br":
                self.parts.append(" ")
            elif tag and m[1]:
                self._end_tag(tag)
            elif tag and self._start_tag(tag, m[3]) and tag in _RAW:
                at = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at).end()
                self._shut(len(self.stack) - 1)
        self._ended()

    def blocks(self) -> list[tuple[int, str]]:
        """Node and text of each block that is not in a side part, in page order."""
        gone = self._side_parts()
        return [(node, text) for node, text, side, _ in self.found if side < 0 or not gone[side]]

    def _side_parts(self) -> list[bool]:
        """Of each side part, whether what lies in it goes: all do, but for those around the article."""
        gone = [True] * len(self.sides)
        if self.mains:
            if min(self.mains) >= 0:
                for side in self.mains:
                    while side >= 0 and gone[side] is True:
                        gone[side] = None if self.sides[side][0] & _COMMENTS else False
                        side = self.sides[side][1]
        else:
            paragraphs = any(x[3] for x in self.found)
            inside, total = [0] * len(self.sides), 0
            for _, text, side, paragraph in self.found:
                if paragraph or not paragraphs:
                    total += len(text)
                    if side >= 0:
                        inside[side] += len(text)
            for i in range(len(inside) - 1, -1, -1):
                if self.sides[i][1] >= 0:
                    inside[self.sides[i][1]] += inside[i]
            gone = [small or bool(names & _COMMENTS) or 2 * n <= total for (names, _, small), n in zip(self.sides, inside, strict=True)]
        for i, (_, around, _) in enumerate(self.sides):
            gone[i] = gone[i] is not False or (around >= 0 and bool(gone[around]))
        return gone

    def keys(self) -> list[int]:
        """A hash of each node's path: of its parent's and its own step."""
        out = [0]
        for parent, step in zip(self.parents[1:], self.steps[1:], strict=True):
            out.append(step_key(out[parent], step))
        return out


def blocks(page: str) -> list[tuple[str, str]]:
    """(node path, text) of each block of a page, in page order, without parts that are never main text; for looking at, as paths may be long."""
    p, paths = Page(page), [""]
    for parent, step in zip(p.parents[1:], p.steps[1:], strict=True):
        paths.append(f"{paths[parent]}\n{step}")
    return [(paths[node], text) for node, text in p.blocks()]


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _kind(step: str) -> str:
    """A step without its place."""
    return step[: step.rfind("[")]


def step_key(parent: int, step: str) -> int:
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + step.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BASE, _BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1


def node_contents(page: Page) -> list[tuple[int, int, int, list[int]]]:
    """Node, number and hash of all blocks below it, and its children in page order, of each node with a block below.

    A sequence's hash is a polynomial, so a node's is put together from its own blocks' and its children's: each node is looked at once.
    Its own blocks come in page order, a child where its first block lies."""
    own: dict[int, list[tuple[int, int, int]]] = {}  # (child or -1, hash, number) in page order
    known: set[int] = set()
    for node, text in page.blocks():
        own.setdefault(node, []).append((-1, _key(text) & _BITS, 1))
        while node not in known:  # children are entered once, where their first block lies
            known.add(node)
            parent = page.parents[node]
            if parent < 0:
                break
            own.setdefault(parent, []).append((node, 0, 0))
            node = parent
    done: dict[int, tuple[int, int]] = {}
    out = []
    for node in sorted(known, reverse=True):  # children have larger numbers than their parents
        total, n = 0, 0
        for child, h, many in own[node]:
            if child >= 0:
                h, many = done[child]
            total, n = (total * pow(_BASE, many, 1 << 64) + h) & _BITS, n + many
        done[node] = (total, n)
        out.append((node, n, (total * 31 + n) & _BITS, [c for c, _, _ in own[node] if c >= 0]))
    return out[::-1]


def page_contents(pages: DataFrame) -> DataFrame:
    """host, node, stated, kinds, content, style, page: hashes of each node's content and sequence of children on each page.

    A node's content is that of all blocks below it, so whole branches have an
    importance as well as their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, nodes, stated, kinds, contents, styles, keys = [], [], [], [], [], [], []
            for host, html_ in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(html_ or "")
                below, key = [x for x in node_contents(page) if x[0]], page.keys()
                whole = _key(" ".join(f"{key[x]}:{c}" for x, _, c, _ in below))
                hosts += [host] * len(below)
                nodes += [key[x] for x, *_ in below]
                stated += [page.stated[x] for x, *_ in below]
                steps = [[_kind(page.steps[c]) for c in children] for *_, children in below]
                kinds += [len(set(x)) for x in steps]
                contents += [x - (1 << 64) if x >> 63 else x for _, _, x, _ in below]
                styles += [_key(" ".join(x)) for x in steps]
                keys += [whole] * len(below)
            yield pa.record_batch({
                "host": pa.array(hosts, pa.string()), "node": pa.array(nodes, pa.int64()), "stated": pa.array(stated, pa.bool_()), "kinds": pa.array(kinds, pa.int32()),
                "content": pa.array(contents, pa.int64()), "style": pa.array(styles, pa.int64()), "page": pa.array(keys, pa.int64()),
            })

    return pages.select("host", "html").mapInArrow(run, "host string, node long, stated boolean, kinds int, content long, style long, page long")


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, stated, pages, kinds, style_entropy, content_entropy, importance: the merged tree of each host, one row a node.

    Pages of a host with the same text throughout count once."""
    seen = page_contents(pages).distinct()
    both = seen.select("host", "node", "stated", "kinds", F.explode(F.array(F.struct(F.lit(True).alias("is_style"), F.col("style").alias("value")), F.struct(F.lit(False).alias("is_style"), F.col("content").alias("value")))).alias("x"))
    counts = both.groupBy("host", "node", "stated", "x").agg(F.count(F.lit(1)).alias("c"), F.sum("kinds").alias("kinds"))
    clogc = F.col("c") * F.log("c")
    sums = counts.groupBy("host", "node", "stated").agg(
        F.sum(F.when(F.col("x.is_style"), F.col("c"))).alias("pages"), (F.sum(F.when(F.col("x.is_style"), F.col("kinds"))) / F.sum(F.when(F.col("x.is_style"), F.col("c")))).alias("kinds"),
        F.sum(F.when(F.col("x.is_style"), clogc)).alias("styles"), F.sum(F.when(~F.col("x.is_style"), clogc)).alias("contents"),
    )

    def entropy(total: str) -> Column:
        return F.when(F.col("pages") > 1, (F.log("pages") - F.col(total) / F.col("pages")) / F.log("pages")).otherwise(1.0)

    weight = F.pow(F.lit(GAMMA), F.col("kinds"))
    return sums.select("host", "node", "stated", "pages", "kinds", entropy("styles").alias("style_entropy"), entropy("contents").alias("content_entropy")).withColumn(
        "importance", (1 - weight) * F.col("style_entropy") + weight * F.col("content_entropy")
    )


def low_nodes(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, low: the nodes to drop on each host (as many as its templates have, not its pages)."""
    least = F.when(F.col("stated"), MIN_IMPORTANCE_STATED / MIN_IMPORTANCE * min_importance).otherwise(min_importance)
    low = style_tree(pages).filter((F.col("pages") >= min_pages) & (F.col("importance") < least))
    return low.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low"))


def main_text(page: str | None, low: frozenset[int]) -> str:
    """The blocks of a page that lie under no low node, one a line."""
    p = Page(page or "")
    found = p.blocks()
    if low:
        under = [False]
        for parent, key in zip(p.parents[1:], p.keys()[1:], strict=True):
            under.append(under[parent] or key in low)
        found = [(node, text) for node, text in found if not under[node]]
    return "\n".join(text for _, text in found)


def extract_pages(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has the empty text. Pages without a url form a host of
    their own. A node counts once a page, and is judged only where at least
    ``min_pages`` different pages of its host show it, so that a host with few pages
    keeps all that names and elements do not rule out. Copies of a page count once.
    Pages are read whole, in time and memory in proportion to their length, however long or deeply nested they are.
    An empty table gives no rows; further columns are ignored."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://([^/?#]*)", 1))
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    low = cut(low_nodes(mine, min_importance, min_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}
        for b in batches:
            out = []
            for host, nodes, page in zip(b.column("host").to_pylist(), b.column("low"), b.column("html").to_pylist(), strict=True):
                if host not in sets:
                    if len(sets) > 10_000:
                        sets.clear()
                    sets[host] = frozenset(nodes.as_py() or ())
                out.append(main_text(page, sets[host]))
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(out, pa.string())})

    # only small tables of low nodes are broadcast: Spark checks their size
    found = mine.join(low, "host", "left").select("page_id", "url", "host", "html", "low").mapInArrow(run, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
