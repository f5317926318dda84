"""Pages as an element table numbered by intervals, and ancestry as range conditions on it.

One pass over a page gives each element its place in order of opening, the last place inside
it, its place in order of closing and its depth. An element lies inside another if its place lies in the
other's interval; how many levels apart they are is the difference of their depths.

A range condition is joined by equality: an interval is the union of at most two dyadic
blocks a size, a place lies in one block of each size, so a page of n elements makes some 2 log n rows an
element, whatever its shape, and pairs come out once each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import _NO_END, BEM, CHANCE_NAMES, DURATION

_FIELDS = [
    ("node", pa.int32(), "int"), ("last", pa.int32(), "int"), ("post", pa.int32(), "int"), ("depth", pa.int32(), "int"), ("tag", pa.string(), "string"), ("class", pa.string(), "string"), ("href", pa.string(), "string"),
    ("src", pa.string(), "string"), ("srcset", pa.string(), "string"), ("times_before", pa.int32(), "int"), ("times_within", pa.int32(), "int"), ("times_in_page", pa.int32(), "int"),
]
SIZES = 31  # of dyadic blocks: 2^0 to 2^30 places


class _Elements(HTMLParser):
    """Columns of a page's elements. Memory is linear in the page: an element holds numbers, never its path."""

    def __init__(self):
        super().__init__()
        self.columns: list[list] = [[] for _ in _FIELDS]
        self.stack: list[int] = []
        self.open: Counter = Counter()
        self.closed = self.times = 0

    def handle_starttag(self, tag, attrs):
        a, node = dict(attrs), len(self.columns[0]) + 1
        for column, value in zip(self.columns, (node, 0, 0, len(self.stack) + 1, tag, a.get("class"), a.get("href"), a.get("src"), a.get("srcset"), self.times, 0, 0), strict=True):
            column.append(value)
        self.stack.append(node)
        self.open[tag] += 1
        if tag in _NO_END:
            self.shut(1)

    def shut(self, n: int) -> None:
        _, last, post, _, tag, *_, before, within, _ = self.columns
        for _ in range(n):
            i = self.stack.pop() - 1
            self.closed += 1
            last[i], post[i], within[i] = len(last), self.closed, self.times - before[i]
            self.open[tag[i]] -= 1

    def handle_endtag(self, tag):
        """Closes the nearest open element of that name and all that is open inside it; one without such an element counts for nothing."""
        if self.open[tag]:
            n = next(n for n, i in enumerate(reversed(self.stack), 1) if self.columns[4][i - 1] == tag)
            self.shut(n)

    def handle_data(self, data):
        self.times += bool(DURATION.search(data))


def elements(pages: DataFrame) -> DataFrame:
    """page_id, url and a row for each element: node, last, post, depth, tag, class, href, src, srcset, times_before, times_within, times_in_page.

    ``node`` counts from 1 in order of opening, ``last`` is the largest node inside the element (itself, if none),
    ``post`` counts in order of closing, ``depth`` from 1. times_within: pieces of text with a duration inside the
    element, times_before: in front of it, times_in_page: in all. What is left open ends with its parent or the page. Null
    and empty pages have no rows; any depth of nesting is read in linear memory."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, html in enumerate(b.column("html")):
                if html.is_valid and len(html.as_py()):
                    p = _Elements()
                    p.feed(html.as_py())
                    p.close()
                    p.shut(len(p.stack))
                    n = len(p.columns[0])
                    p.columns[-1] = [p.times] * n
                    at = pa.array([i] * n, pa.int32())
                    if n:
                        yield pa.record_batch({"page_id": b.column("page_id").take(at), "url": b.column("url").take(at), **{name: pa.array(c, t) for (name, t, _), c in zip(_FIELDS, p.columns, strict=True)}})

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, {', '.join(f'{n} {k}' for n, _, k in _FIELDS)}")


def _blocks_of(first: Column, end: Column) -> Column:
    """The dyadic blocks, as (size, number), whose union is the interval from ``first`` to before ``end``."""

    def of_size(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = F.floor((first + width - 1) / width), F.floor(end / width)
        left = F.when((a < b) & (a % 2 == 1), a)
        right = F.when((a < b) & (b % 2 == 1), b - 1)
        return F.array_distinct(F.array_compact(F.array(F.when(left.isNotNull(), F.struct(k.alias("size"), left.alias("number"))), F.when(right.isNotNull(), F.struct(k.alias("size"), right.alias("number"))))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIZES - 1)), of_size))


def inside(outer: DataFrame, inner: DataFrame, outer_cols: dict[str, str], levels: int | None = None) -> DataFrame:
    """Rows of ``inner`` with each element of ``outer`` of their page that they lie in, themselves included: its columns, under the names given.

    With ``levels``, only elements at most so many levels above."""
    a = outer.select(F.col("page_id").alias("_page"), F.col("depth").alias("_depth"), *[F.col(c).alias(n) for c, n in outer_cols.items()], F.explode(_blocks_of(F.col("node").cast("long"), F.col("last").cast("long") + 1)).alias("_b"))
    a = a.select("*", F.col("_b.size").alias("_size"), F.col("_b.number").alias("_number")).drop("_b")
    b = inner.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SIZES - 1)))).withColumn("_n", F.floor(F.col("node") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_s"))))
    same = (F.col("page_id") == F.col("_page")) & (F.col("_s") == F.col("_size")) & (F.col("_n") == F.col("_number"))
    if levels is not None:
        b = b.withColumn("_d", F.explode(F.sequence(F.greatest(F.col("depth") - levels, F.lit(1)), F.col("depth"))))
        same &= F.col("_d") == F.col("_depth")
    # merged, never broadcast: Spark's estimate knows nothing of how many rows the blocks make
    return b.join(a.hint("merge"), same).select(*inner.columns, *outer_cols.values())


def stable_step(tag: Column, classes: Column) -> Column:
    """Tag with the first class that is named by block and element, or else the first that does not look made by chance."""
    every = F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c != "")
    named = F.get(F.filter(every, lambda c: c.rlike(BEM.pattern)), F.lit(0))
    plain = F.get(F.filter(every, lambda c: (F.length(c) > 2) & ~c.rlike("|".join(CHANCE_NAMES))), F.lit(0))
    return F.concat_ws(".", tag, F.coalesce(named, plain))


_READ = ["page_id", "node", "last", "tag", "_step", "_names", "times_within", "times_in_page", "_to", "_video", "_wanted"]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of the wanted elements of pages that come whole and in order of opening. Only the elements that are open are held."""
    page, above = None, []
    for b in batches:
        at, made = [], []
        for i, (of, node, last, tag, step, names, times, in_page, to, video, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in _READ), strict=True)):
            if of != page:
                page, above = of, []
            while above and above[-1][0] < node:
                above.pop()
            href, seen = above[-1][5:] if above else (None, False)
            above.append((last, tag, step, names, times, href if to is None else to, seen or video))
            if wanted:
                near = above[-5:]
                steps = [x[2] for x in near if x[1] != "html"][-4:]
                at.append(i)
                made.append((" ".join(steps), " ".join(x[3] for x in near[-3:] if x[3]), href, seen, (near[0][4] if len(near) == 5 else in_page) > 0))
        selector, classes, links, videos, durations = zip(*made, strict=True) if made else [()] * 5
        own = {c: b.column(c).take(pa.array(at, pa.int32())) for c in ("page_id", "url", "node", "srcset_entries", "src")}
        text = {"selector": selector, "classes": classes, "href": links}
        yield pa.record_batch(own | {c: pa.array(x, pa.string()) for c, x in text.items()} | {"video_above": pa.array(videos, pa.bool_()), "near_duration": pa.array(durations, pa.bool_())})


def signatures(dom: DataFrame, wanted: list[str]) -> DataFrame:
    """page_id, url, node of the wanted elements with selector, classes, href, video_above, srcset_entries, src, near_duration.

    selector: steps of the element and up to three above it, ``html`` left out; classes: of the element and two above;
    href and video_above: of the links above it, the nearest first; near_duration: whether the element four levels above,
    or else the page, holds a duration. A page's elements are read once in order of opening, its intervals telling which are
    still open: time is linear in the elements whatever their nesting, memory in the depth."""
    kinds, link, own = dict(dom.dtypes), F.col("tag") == "a", F.col("tag").isin(wanted)
    video = F.coalesce(F.col("href").rlike(r"(?i)/(video|watch|v|id)/|embed/|player/"), F.lit(False)) | F.coalesce(F.lower("class").contains("go"), F.lit(False))
    names = F.array_join(F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != ""), " ")
    entries = F.size(F.filter(F.split(F.coalesce("srcset", F.lit("")), ","), lambda e: F.trim(e) != ""))
    rows = dom.filter("page_id is not null").select(
        "page_id", F.when(own, F.col("url")).alias("url"), "node", "last", "tag", stable_step(F.col("tag"), F.col("class")).alias("_step"), names.alias("_names"), "times_within", "times_in_page",
        F.when(link & (F.col("href") != ""), F.col("href")).alias("_to"), (link & video).alias("_video"), F.when(own, entries).alias("srcset_entries"), F.when(own, F.col("src")).alias("src"), own.alias("_wanted"),
    )
    schema = f"page_id {kinds['page_id']}, url string, node {kinds['node']}, srcset_entries int, src string, selector string, classes string, href string, video_above boolean, near_duration boolean"
    met = rows.repartition("page_id").sortWithinPartitions("page_id", "node").mapInArrow(_scanned, schema)
    return met.select("page_id", "url", "node", "selector", "classes", "href", "video_above", "srcset_entries", "src", "near_duration")
