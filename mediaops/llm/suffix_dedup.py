"""Repeated passages by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes over it also starts in a document with
a smaller identifier. Not every suffix has to be sorted for that. Each string of
``length`` bytes has a minimizer, the k bytes inside it with the smallest hash, and
equal strings have it at the same place. So:

1. every part of the corpus names its minimizer hashes; those that two parts (or
   two documents of one) name are shared, as few as the corpus repeats itself;
2. the strings around shared minimizers meet by hash. They are sorted as suffixes:
   a three-way multikey quicksort on 8-byte characters to a shallow depth, then
   blind tries for the groups that still agree. Strings that are equal to the end
   are repetitions, of which the smallest identifier keeps its bytes;
3. what is found goes back to the parts, which cut their documents.

Documents are dealt into parts of bounded size once; Spark reuses that exchange
for all three steps. A minimizer with over HOT occurrences is not compared in one
place. Each part first collapses its occurrences with the same surroundings to one,
then takes the strings of what is left to distinct ones, and these meet by their own
hash in a tree: FAN_IN parts at a time, and the smallest of those again. So a
passage that a third of all documents share costs each part one row a string and
each task of the tree FAN_IN of them.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LENGTH = 50
K = 20
PART_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20  # of the corpus, for each group in which minimizers meet
HOT = 4096
FAN_IN = 1024  # parts whose hot strings meet in one group
STRINGS = 400_000  # strings sorted at a time in a task
_SHALLOW = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---- deep-shallow sorting -------------------------------------------------


def _blind_trie(strings: list[bytes]) -> list[int]:
    """Order of equally long strings. Inner nodes hold the place they branch at and no text:
    a search goes down by those bytes alone and compares once, with the leaf it meets."""
    size = len(strings[0])
    root: list | tuple = [0]
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while type(node) is tuple:
            at, children = node
            node = children.get(s[at])
            if node is None:
                node = next(iter(children.values()))
        t = strings[node[0]]
        if s == t:
            node.append(k)
            continue
        d = size - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
        above, node = None, root
        while type(node) is tuple and node[0] < d:
            above, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == d:
            node[1][s[d]] = [k]
            continue
        new = (d, {s[d]: [k], t[d]: node})
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if type(node) is tuple:
            todo.extend(c for _, c in sorted(node[1].items(), reverse=True))
        else:
            out.extend(node)
    return out


def _multikey_quicksort(chars: np.ndarray) -> np.ndarray:
    """Order of the rows of ``chars``, all groups a step at a time.

    A group is split by its pivot's character into smaller, equal and larger rows;
    the equal ones go on with the next character, until they are single or at the end."""
    n, depth = chars.shape
    order = np.arange(n)
    begin, size, at = np.array([0]), np.array([n]), np.array([0])
    while True:
        some = size > 1
        begin, size, at = begin[some], size[some], at[some]
        if not len(begin):
            return order
        ends = np.cumsum(size)
        group = np.repeat(np.arange(len(size)), size)
        place = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        rows = order[place]
        char = chars[rows, at[group]]
        first, last = ends - size, ends - 1
        a, b, c = char[first], char[(first + last) // 2], char[last]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        less, more = char < pivot, char > pivot
        below, above = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(more, first, dtype=np.int64)
        same = size - below - above
        to = np.empty(len(rows), np.int64)
        for mine, start in ((less, begin), (~(less | more), begin + below), (more, begin + below + same)):
            rank = np.cumsum(mine) - mine
            to[mine] = (rank + (start - rank[first])[group])[mine]
        order[to] = rows
        deeper = at + 1 < depth
        begin, size, at = (
            np.concatenate([begin, (begin + below)[deeper], begin + below + same]), np.concatenate([below, same[deeper], above]), np.concatenate([at, at[deeper] + 1, at]),
        )


def deep_shallow_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (bytes, all of one length), and each sorted row's common prefix with the one before it."""
    n, m = rows.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.ascontiguousarray(rows[:, :_SHALLOW]).view(">u8").astype(np.uint64)
    order = _multikey_quicksort(words)
    tied = np.zeros(n, bool)
    tied[1:] = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    runs = np.array(_runs(np.cumsum(~tied)), np.int64).reshape(-1, 2)
    where, pairs = _differ(rows, order, np.flatnonzero(tied))
    settled = np.add.reduceat(np.r_[where < m, False].astype(np.int64), np.r_[0, np.cumsum(runs[:, 1] - runs[:, 0] - 1)][:-1]) == 0 if len(runs) else np.empty(0, bool)
    two = ~settled & (runs[:, 1] - runs[:, 0] == 2)
    if two.any():  # a trie of two leaves: the byte at which they part decides
        i = runs[two, 0]
        x, y = order[i], order[i + 1]
        at = where[np.searchsorted(pairs, i + 1)]
        swap = rows[x, at] > rows[y, at]
        order[i[swap]], order[i[swap] + 1] = y[swap], x[swap]
    rows = np.ascontiguousarray(rows)
    for s, e in runs[~settled & ~two].tolist():
        part = order[s:e].tolist()
        order[s:e] = [part[i] for i in _blind_trie([rows[i].tobytes() for i in part])]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = _differ(rows, order, np.arange(1, n))[0]
    return order, lcp


def _differ(rows: np.ndarray, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places ``at`` of the order: the first byte in which the row differs from the one before (their length if in none), and ``at``."""
    out = np.empty(len(at), np.int64)
    for s in range(0, len(at), 50_000):
        i = at[s : s + 50_000]
        differ = rows[order[i]] != rows[order[i - 1]]
        out[s : s + 50_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out, at


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of runs of two or more equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], len(values)]
    long = ends - starts > 1
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


# ---- minimizers -----------------------------------------------------------


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    step = data.astype(np.uint64) * _M1 + _M2
    step ^= step >> np.uint64(29)
    out, span, m = None, 0, 1
    while k:
        if k & 1:
            n = len(data) - (span + m) + 1
            out = step[:n].copy() if out is None else out[:n] * _M2 + step[span : span + n]
            span += m
        k >>= 1
        if k:
            n = len(data) - 2 * m + 1
            step = step[:n] * _M1 + step[m : m + n]
            step ^= step >> np.uint64(31)
            m *= 2
    out ^= out >> np.uint64(32)
    out *= _M2
    out ^= out >> np.uint64(29)
    return out


def minimizers(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """text, place, hash, lo, hi of each minimizer: it belongs to the strings that begin lo to hi bytes before it.

    Every string of ``length`` bytes of every text belongs to exactly one; of equal
    hashes the leftmost counts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens)
    width = length - k + 1
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(len(data) - length + 1, 0), 1 << 20):
        piece = data[at : at + (1 << 20) + length - 1]
        h = _hashes(piece, k)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if width > span:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        place = (key & low).astype(np.int64)
        start = np.arange(at, at + len(place))
        owner = np.searchsorted(ends, start, side="right")
        inside = start + length <= ends[owner]
        start, place = start[inside], place[inside]
        if not len(start):
            continue
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.r_[first[1:], len(start)] - 1
        a = place[first] + at
        for x, y in zip(found, (a, h[place[first]], a - start[last], a - start[first]), strict=True):
            x.append(y)
    a, h, lo, hi = map(np.concatenate, found)
    text = np.searchsorted(ends, a, side="right")
    return text, a - (ends - lens)[text], h, lo, hi


# ---- the three steps ------------------------------------------------------


def _part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A part's rows in one order each time: rank of the identifier order, validity, texts."""
    texts = [t.as_buffer().to_pybytes() for t in table["text"].cast(pa.large_binary()).combine_chunks()]
    ids = table["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    # a null identifier is larger than all others
    return np.array([np.iinfo(np.int64).max if ids[i] is None else ids[i] for i in order], np.int64), np.array(order, np.int64), [texts[i] for i in order]


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays, one after the other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in columns))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _pack_names(names: np.ndarray) -> bytes:
    """Ascending numbers as differences, in four bytes where those do."""
    steps = np.diff(names, prepend=np.uint64(0))
    return b"4" + steps.astype(np.uint32).tobytes() if not len(steps) or steps.max() < 1 << 32 else b"8" + steps.tobytes()


def _unpack_names(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob[1:], np.uint32 if blob[:1] == b"4" else np.uint64).astype(np.uint64), dtype=np.uint64)


def _name(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 40-bit name of a hash; buckets grow with the corpus, so names stay about as rare in each."""
    return ((h & np.uint64((1 << 24) - 1)) % np.uint64(buckets)).astype(np.int64), h >> np.uint64(24)


def _cuts(by: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of runs of equal values."""
    starts = np.flatnonzero(np.r_[True, np.diff(by) > 0]) if len(by) else np.empty(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True)) if len(starts) else []


def _sorted_shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shared hashes' names, each after its bucket, in order; and whether they are hot."""
    names = [_unpack_names(x) for x in table["shared"].to_pylist()]
    bucket = np.repeat(table["bucket"].to_numpy().astype(np.uint64), list(map(len, names)))
    h = (np.concatenate([np.empty(0, np.uint64), *names]) << np.uint64(24)) | bucket
    hot = np.frombuffer(b"".join(table["hot"].to_pylist()), np.uint8)
    order = np.argsort(h)
    return h[order], hot[order]


class _Record:
    """Fixed-width records of a string around a minimizer: the minimizer and what follows, then what comes before, backwards."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.before = length, k, length - k
        self.width = length + self.before
        self.kind = np.dtype([("doc", "<i8"), ("text", "<i4"), ("place", "<i4"), ("lo", "u1"), ("hi", "u1"), ("bytes", "u1", (self.width,))])

    def make(self, docs: np.ndarray, texts: list[bytes], text: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text), self.kind)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(bytes(self.before) + b"".join(texts) + bytes(self.length), np.uint8)
        begin = (np.cumsum(lens) - lens)[text] + place  # of the bytes before the minimizer, in the padded data
        around = np.lib.stride_tricks.sliding_window_view(data, self.width)
        reach = np.arange(self.width)
        step = np.where(reach < self.length, reach, self.length - 1 - reach).astype(np.int8)
        for name, x in (("doc", docs[text]), ("text", text), ("place", place), ("lo", lo), ("hi", hi)):
            out[name] = x
        for s in range(0, len(text), 50_000):
            e = s + 50_000
            used = (step[None, :] >= -hi[s:e, None].astype(np.int8)) & (step[None, :] < (self.length - lo[s:e]).astype(np.int8)[:, None])
            raw = around[begin[s:e]]
            out["bytes"][s:e] = np.concatenate([raw[:, self.before :], raw[:, : self.before][:, ::-1]], axis=1) * used
        return out

    def pack(self, records: np.ndarray) -> bytes:
        """Compressed column by column."""
        return len(records).to_bytes(8, "little") + _pack(*(records[x] for x in self.kind.names))

    def unpack(self, blob: bytes) -> np.ndarray:
        out, data, at = np.zeros(int.from_bytes(blob[:8], "little"), self.kind), _unpack(blob[8:]), 0
        for x in self.kind.names:
            kind = out[x].dtype
            size = out[x].size * kind.itemsize
            out[x] = np.frombuffer(data[at : at + size], kind).reshape(out[x].shape)
            at += size
        return out

    def string(self, rows: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The ``length`` bytes that begin ``back`` bytes before each row's minimizer."""
        natural = np.concatenate([rows[:, self.length :][:, ::-1], rows[:, : self.length]], axis=1).ravel()
        return np.lib.stride_tricks.sliding_window_view(natural, self.length)[np.arange(len(rows)) * self.width + self.before - back]


_FOUND = np.dtype([("text", "<i4"), ("place", "<i4"), ("mask", "<u8")])
_ROWS = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("records", pa.binary()), ("found", pa.binary()), ("string", pa.binary()), ("doc", pa.int64())])


def _rows(**columns: pa.Array) -> pa.Table:
    """A table of _ROWS; what is not given is null."""
    n = len(columns["part"])
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


def _found(records: np.ndarray, mask: np.ndarray) -> bytes:
    out = np.zeros(len(records), _FOUND)
    out["text"], out["place"], out["mask"] = records["text"], records["place"], mask
    return out.tobytes()


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct row, and the number of each row's."""
    _, first, kind = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, kind


def _minima(kind: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    return least


def _hot_strings(records: np.ndarray, shape: _Record) -> tuple[bytes, pa.Table]:
    """What a part's records of hot minimizers settle among themselves, as found; and string, doc, found of each
    distinct string, for its smallest document here."""
    first, kind = _distinct(np.concatenate([records["bytes"], records["lo"][:, None], records["hi"][:, None]], axis=1))
    least = _minima(kind, records["doc"], len(first))
    kinds, lead = records[first], records["doc"] == least[kind]
    lo, hi = records["lo"].astype(np.int64), records["hi"].astype(np.int64)
    mask = np.where(lead, 0, (np.int64(1) << (hi + 1)) - (np.int64(1) << lo))
    by = np.flatnonzero(lead)[np.argsort(kind[lead], kind="stable")]  # leading records, kind after kind
    ends = np.cumsum(np.bincount(kind[by], minlength=len(first)))
    strings, docs, found = [], [], []
    for back in range(shape.before + 1):  # equal strings have their minimizer at the same place
        some = np.flatnonzero((kinds["lo"] <= back) & (kinds["hi"] >= back))
        if not len(some):
            continue
        text = shape.string(kinds["bytes"][some], np.full(len(some), back))
        where, number = _distinct(text)
        lowest = _minima(number, least[some], len(where))
        own = least[some] == lowest[number]
        size = np.diff(ends, prepend=0)[some]
        at = by[np.repeat(ends[some] - np.cumsum(size), size) + np.arange(size.sum())]  # their records, in order of ``some``
        of, keeps = np.repeat(number, size), np.repeat(own, size)
        mask[at[~keeps]] |= np.int64(1) << back
        at, of = at[keeps], of[keeps]
        at = at[np.argsort(of, kind="stable")]
        count = np.bincount(of, minlength=len(where))
        strings.append(text[where])
        docs.append(lowest)
        raw, edge = _found(records[at], np.full(len(at), np.int64(1) << back)), _FOUND.itemsize * np.r_[0, np.cumsum(count)]
        found += [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    hit = mask > 0
    table = pa.table({
        "string": pa.array([x.tobytes() for block in strings for x in block], pa.binary()), "doc": pa.array(np.concatenate(docs)), "found": pa.array(found, pa.binary()),
    })
    return _found(records[hit], mask[hit]), table


def _least(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each row's group; groups are numbered from 0 in order."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.minimum.reduceat(doc, starts)[group]


def repeated(records: np.ndarray, shape: _Record) -> np.ndarray:
    """A bit mask for each record: bit b is set if its string that begins b bytes before the minimizer
    also stands in a record of a smaller document."""
    n, length, k = len(records), shape.length, shape.k
    keys = np.concatenate([records["bytes"], records["lo"][:, None], records["hi"][:, None]], axis=1)
    order, lcp = deep_shallow_sort(keys)
    same = np.cumsum(np.r_[1, lcp[1:] < keys.shape[1]]) - 1 if n else np.empty(0, np.int64)
    docs = records["doc"][order]
    least = _least(same, docs) if n else docs
    lo, hi = records["lo"][order].astype(np.int64), records["hi"][order].astype(np.int64)
    every = ((np.int64(1) << (hi + 1)) - 1) & ~((np.int64(1) << lo) - 1)
    mask = np.where(docs > least, every, 0)

    # one record of each kind goes on, where its minimizer has others that can reach a whole string with it
    first = np.flatnonzero(np.r_[True, np.diff(same) > 0]) if n else np.empty(0, np.int64)
    right = lcp[first] if n else lcp  # with the kind before
    after = np.r_[right[1:], 0] if n else right
    right = np.maximum(np.where(np.arange(len(first)) > 0, right, 0), after)
    kinds = records["bytes"][order[first]]
    crowd = np.flatnonzero(right >= k)
    left_keys = np.concatenate([kinds[crowd, :k], kinds[crowd, length:]], axis=1)
    left_order, left_lcp = deep_shallow_sort(left_keys)
    left = np.zeros(len(crowd), np.int64)
    if len(crowd):
        left[left_order] = np.maximum(left_lcp, np.r_[left_lcp[1:], 0]) - k
    crowd = crowd[np.minimum(right[crowd], length) + left >= length]
    more = np.zeros(len(first), np.int64)
    group = np.cumsum(np.r_[0, lcp[first][1:] < k])[crowd] if n else crowd
    per = hi[first][crowd] - lo[first][crowd] + 1
    # whole minimizers at a time, about STRINGS strings
    ends = np.cumsum(per)
    edges = np.flatnonzero(np.diff(group) > 0) + 1
    at = 0
    while at < len(crowd):
        reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRINGS, side="right"))
        after = edges[edges >= max(reach, at + 1)]
        end = int(after[0]) if len(after) else len(crowd)
        some, n_some = crowd[at:end], per[at:end]
        who = np.repeat(some, n_some)
        back = np.arange(n_some.sum()) - np.repeat(np.cumsum(n_some) - n_some, n_some) + np.repeat(lo[first][some], n_some)
        s_order, s_lcp = deep_shallow_sort(shape.string(kinds[who], back))
        equal = np.cumsum(np.r_[1, s_lcp[1:] < length]) - 1
        s_docs = least[first][who[s_order]]
        hit = s_order[s_docs > _least(equal, s_docs)]
        np.bitwise_or.at(more, who[hit], np.int64(1) << back[hit])
        at = end
    mask |= more[same] if n else mask
    out = np.zeros(n, np.int64)
    out[order] = mask
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, hot: int = HOT, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (array of begin, end).

    Texts are taken as UTF-8 bytes (null: empty) and whole; strings never cross
    documents and are judged on the input. A null identifier is larger than all
    others; rows of one identifier do not remove each other's bytes. Texts shorter
    than ``length`` bytes stay as they are. A very long text is read whole: one that is longer than a part
    is held by one task with its minimizers. An empty table gives no rows; further columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = max(1, -(-total // part_bytes)), max(1, -(-total // (part_bytes * BUCKET_BYTES // PART_BYTES)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    shape = _Record(length, k)

    def name(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, texts = _part(table)
        text, _, h, _, _ = minimizers(texts, length, k)
        bucket, names = _name(h, buckets)
        order = np.lexsort((names, bucket)) if buckets > 1 else np.argsort(names)
        bucket, names, text = bucket[order], names[order], text[order]
        first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (bucket[1:] != bucket[:-1])]) if len(names) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(names)])
        several = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first) if len(first) else np.empty(0, bool)
        bucket, names = bucket[first], names[first]
        cuts = _cuts(bucket)
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "bucket": pa.array([int(bucket[s]) for s, _ in cuts], pa.int64()),
            "names": pa.array([_pack_names(names[s:e]) for s, e in cuts], pa.binary()),
            "counts": pa.array([np.minimum(count[s:e], 65535).astype(np.uint16).tobytes() for s, e in cuts], pa.binary()),
            "several": pa.array([several[s:e].astype(np.uint8).tobytes() for s, e in cuts], pa.binary()),
        })

    def share(table: pa.Table) -> pa.Table:
        names = [_unpack_names(x) for x in table["names"].to_pylist()]
        h = np.concatenate(names)
        part = np.repeat(table["part"].to_numpy(), list(map(len, names)))
        count = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint16)
        several = np.frombuffer(b"".join(table["several"].to_pylist()), np.uint8)
        order = np.argsort(h, kind="stable")
        h, part, count, several = h[order], part[order], count[order], several[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[first, len(h)])
        shared = np.repeat((n > 1) | (np.add.reduceat(several.astype(np.int64), first) > 0), n)
        many = np.repeat(np.add.reduceat(count.astype(np.int64), first) > hot, n)
        h, part, many = h[shared], part[shared], many[shared]
        by = np.argsort(part, kind="stable")
        cuts = _cuts(part[by])
        return pa.table({
            "part": pa.array([int(part[by[s]]) for s, _ in cuts], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(cuts), pa.int64()),
            "shared": pa.array([_pack_names(h[by[s:e]]) for s, e in cuts], pa.binary()), "hot": pa.array([many[by[s:e]].astype(np.uint8).tobytes() for s, e in cuts], pa.binary()),
        })

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, _, texts = _part(left)
        number = left["part"][0].as_py() if left.num_rows else 0
        known, is_hot = _sorted_shared(right)
        text, place, h, lo, hi = minimizers(texts, length, k)
        bucket, names = _name(h, buckets)
        full = (names << np.uint64(24)) | bucket.astype(np.uint64)
        at = np.minimum(np.searchsorted(known, full), max(len(known) - 1, 0))
        keep = known[at] == full if len(known) else np.zeros(len(h), bool)
        text, place, bucket, lo, hi, at = (x[keep] for x in (text, place, bucket, lo, hi, at))
        far = is_hot[at] > 0 if len(at) else np.zeros(0, bool)
        out = shape.make(ids, texts, text[~far], place[~far], lo[~far], hi[~far])
        bucket = bucket[~far]
        by = np.argsort(bucket, kind="stable")
        cuts = _cuts(bucket[by])
        tables = [_rows(
            part=pa.array([number] * len(cuts), pa.int32()), bucket=pa.array([int(bucket[by[s]]) for s, _ in cuts], pa.int64()),
            records=pa.array([shape.pack(out[by[s:e]]) for s, e in cuts], pa.binary()),
        )]
        if far.any():
            settled, hot_rows = _hot_strings(shape.make(ids, texts, text[far], place[far], lo[far], hi[far]), shape)
            tables.append(_rows(part=pa.array([number], pa.int32()), bucket=pa.array([number % buckets], pa.int64()), found=pa.array([settled], pa.binary())))
            tables.append(_rows(part=pa.array([number] * hot_rows.num_rows, pa.int32()), bucket=_meeting(hot_rows["string"], number // fan_in), **{c: hot_rows[c] for c in hot_rows.column_names}))
        return pa.concat_tables(tables)

    def _meeting(strings: pa.ChunkedArray, band: int) -> pa.Array:
        """The bucket in which equal strings of a band of parts meet."""
        data = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
        h = _hashes(data, length)[::length] if len(data) else np.empty(0, np.uint64)
        return pa.array(((h + np.uint64(band) * _M1) % np.uint64(buckets)).astype(np.int64))

    def meet(table: pa.Table) -> pa.Table:
        """Compare a bucket's records, and settle its hot strings; of these, the smallest of each goes on."""
        tables = [table.filter(pc.and_(pc.is_null(table["records"]), pc.is_null(table["string"])))]
        some = table.filter(pc.is_valid(table["records"]))
        if some.num_rows:
            blobs = [shape.unpack(x) for x in some["records"].to_pylist()]
            part = np.repeat(some["part"].to_numpy(), list(map(len, blobs)))
            records = np.concatenate(blobs)
            mask = repeated(records, shape)
            hit = np.flatnonzero(mask)
            hit = hit[np.argsort(part[hit], kind="stable")]
            cuts = _cuts(part[hit])
            to = [int(part[hit[s]]) for s, _ in cuts]
            tables.append(_rows(part=pa.array(to, pa.int32()), bucket=pa.array([p % buckets for p in to], pa.int64()), found=pa.array([_found(records[hit[s:e]], mask[hit[s:e]]) for s, e in cuts], pa.binary())))
        some = table.filter(pc.is_valid(table["string"]))
        if some.num_rows:
            some = some.sort_by([("string", "ascending"), ("doc", "ascending")])
            strings, doc = some["string"].to_pylist(), some["doc"].to_numpy()
            new = np.r_[True, np.fromiter(map(ne, strings[1:], strings), bool, len(strings) - 1)]
            least = doc[new][np.cumsum(new) - 1]
            tables.append(some.filter(pa.array(doc > least)).set_column(4, "string", pa.nulls(int((doc > least).sum()), pa.binary())))
            tables.append(some.filter(pa.array(doc == least)))
        return pa.concat_tables(x.select(_ROWS.names).cast(_ROWS) for x in tables)

    def again(level: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            out = meet(table)
            bands = out["part"].to_numpy() // fan_in**level
            bucket = out["bucket"].to_numpy().copy()
            mine = pc.is_valid(out["string"]).to_numpy()
            for band in np.unique(bands[mine]).tolist():
                here = mine & (bands == band)
                bucket[here] = _meeting(out["string"].filter(pa.array(here)), band).to_numpy()
            return out.set_column(1, "bucket", pa.array(bucket))

        return run

    def cut_texts(left: pa.Table, right: pa.Table) -> pa.Table:
        _, order, texts = _part(left)
        ids = left["doc_id"].take(pa.array(order))
        found = np.frombuffer(b"".join(right["found"].to_pylist()), _FOUND)
        found = found[np.argsort(found["text"], kind="stable")]
        bounds = np.searchsorted(found["text"], np.arange(len(texts) + 1))
        n_bytes, n_removed, spans, kept = [], [], [], []
        for i, text in enumerate(texts):
            mine = found[bounds[i] : bounds[i + 1]]
            n_bytes.append(len(text))
            if not len(mine):
                n_removed.append(0)
                spans.append([])
                kept.append(text)
                continue
            change = np.zeros(len(text) + 1, np.int64)
            for b in range(length - k + 1):
                starts = mine["place"][mine["mask"] >> np.uint64(b) & np.uint64(1) > 0] - b
                np.add.at(change, starts, 1)
                np.add.at(change, starts + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            n_removed.append(int(gone.sum()))
            spans.append([{"begin": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        return pa.table({
            "doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(list(map(len, spans)), pa.int64()),
            "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        })

    by_part = dealt.groupBy("part")
    named = by_part.applyInArrow(name, "part int, bucket long, names binary, counts binary, several binary")
    shared = named.groupBy("bucket").applyInArrow(share, "part int, bucket long, shared binary, hot binary")
    columns = "part int, bucket long, records binary, found binary, string binary, doc long"
    met = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(send, columns)
    level = 1
    while fan_in**level < parts:
        level += 1
        met = met.groupBy("bucket").applyInArrow(again(level), columns)
    found = met.groupBy("bucket").applyInArrow(meet, columns).filter("string is null").select("part", "found")
    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(
        cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<begin:long,end:long>>"
    )


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut_docs = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut_docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
