"""Near copies by the share of common word shingles: SimHash and MinHash bands, then an exact check.

A text is its set of five-word shingles. Sixteen bands of four minima each bring
two texts with a Jaccard similarity of 0.8 together with probability
1 - (1 - 0.8^4)^16 = 0.9998, more similar ones oftener. Texts whose SimHash fingerprints of
the same shingles differ in at most four bits meet by pigeonhole blocks; few pairs at
0.8 are that close, so the bands bring the others together. What meets is only a
candidate: it is linked if the sets themselves are similar enough.

Texts of one set are one node. Each bucket's nodes are first compared with one of
them, its centre, which joins a group of copies of any size at the cost of one
comparison each. Of buckets that this leaves in several groups, blocks of nodes meet
with blocks of those outside the largest group; a task compares their sketches, then
the sets of those that may be near, and hands on links that span the groups, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import _LOWER, majority, near_links

WIDTH, BANDS, ROWS = 5, 16, 4
#: Similarity from which texts are near copies, as a fraction of whole numbers.
NEAR = (4, 5)
#: Bits that the sketches of candidates may differ in, of 256: four of each of 64 minima. At a similarity of 0.8
#: they differ in 25.6 on average, with a deviation of 7.3.
SKETCH_BITS = 56
#: Nodes of a bucket on either side of a comparison, and about how many shingles (8 bytes each) these have together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MARKS = [f"s{i}" for i in range(4)]


def hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of a text's shingles in order, repeats too; a shorter text is one shingle."""
    words = text.translate(_LOWER).split()  # on the six ASCII spaces
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Ascending XXH64 of a text's different shingles."""
    return np.unique(hashes(text, width))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of 64 hash functions over a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[at : at + 2048] * _TIMES + _PLUS).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key of each band; the band's number is part of it."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def marks(low: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, in four longs."""
    nibbles = (low * _TIMES[0] >> np.uint64(60)).astype(np.uint8).reshape(-1, 2)
    return (nibbles[:, 0] | nibbles[:, 1] << 4).view(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def sketches(rows: DataFrame) -> DataFrame:
    """row, id (of the text's set), n (its size), fp (SimHash), s0 to s3, keys of every row of row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, fp, keys, bits = [], [], [], [np.empty(0, np.int64)], []
            for t in _texts(b.column("text")):
                h = hashes(t)
                s = np.unique(h)
                fp.append(majority(h))
                low = minima(s)
                ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                keys.append(band_keys(low))
                bits.append(marks(low))
            four = np.array(bits, np.int64).reshape(-1, 4)
            yield pa.record_batch({
                "row": b.column("row"), "id": pa.array(ids, pa.binary()), "n": pa.array(n, pa.int32()), "fp": pa.array(np.array(fp, np.uint64).view(np.int64)), **{m: pa.array(four[:, i].copy()) for i, m in enumerate(_MARKS)},
                "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys))),
            })

    return rows.select(F.col("row").cast("string").alias("row"), "text").mapInArrow(run, f"row string, id binary, n int, fp long, {', '.join(f'{m} long' for m in _MARKS)}, keys array<long>")


def _sets(rows: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, shingles of the nodes ``ids``; only their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t).view(np.int64) for t in _texts(part.column("text"))]
                ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                yield pa.record_batch({"id": part.column("id"), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))})

    needed = ids.select("id").distinct().join(nodes.select("id", "row"), "id")
    return cut(rows.select(F.col("row").cast("string").alias("row"), "text").join(needed, "row").select("id", "text").mapInArrow(run, "id binary, shingles array<long>"))


def _may_be_near(x: str, y: str) -> Column:
    differ = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in _MARKS), F.lit(0))
    sizes = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (differ <= SKETCH_BITS) & (F.least(*sizes) * NEAR[1] >= F.greatest(*sizes) * NEAR[0])


_KEY = ["key", "i", "j"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, i, j of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy() for c in _KEY]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]
        starts = [*np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            name = tuple(int(c[s]) for c in columns)
            if name != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    right = run["is_right"].to_numpy()
    return np.flatnonzero(~right), np.flatnonzero(right)


def _groups(run: pa.Table) -> np.ndarray:
    return run["group"].combine_chunks().dictionary_encode().indices.to_numpy()


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run, the nodes whose sketch may be near one of another group on the other side."""
    for run in _runs(batches):
        left, right = _sides(run)
        if not len(left) or not len(right):
            continue
        group, n, marks_ = _groups(run), run["n"].to_numpy(), np.stack([run[m].to_numpy() for m in _MARKS], axis=1)
        x, y = n[left][:, None].astype(np.int64), n[right][None, :].astype(np.int64)
        may = (group[left][:, None] != group[right][None, :]) & (np.minimum(x, y) * NEAR[1] >= np.maximum(x, y) * NEAR[0])
        differ = sum(np.bitwise_count(marks_[left, k][:, None] ^ marks_[right, k][None, :]).astype(np.int16) for k in range(len(_MARKS)))
        may &= differ <= SKETCH_BITS
        keep = np.r_[left[may.any(axis=1)], right[may.any(axis=0)]]
        if len(keep):
            yield from run.take(pa.array(keep)).select([*_KEY, "is_right", "id", "group"]).combine_chunks().to_batches()


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left and right, as products of incidence matrices."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    column, owner = column[several], owner[several]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    for at in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        out += held[left] @ held[right].T
    return out


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of each run that span its groups, between nodes whose sets are near."""
    for run in _runs(batches):
        left, right = _sides(run)
        group, ids = _groups(run), run["id"].to_pylist()
        sets = [np.asarray(s) for s in run["shingles"].combine_chunks().to_numpy(zero_copy_only=False)]
        size = np.array([len(s) for s in sets])
        near = _common(sets, left, right) * sum(NEAR) >= (size[left][:, None] + size[right][None, :]) * NEAR[0]
        x, y = np.nonzero(near & (group[left][:, None] != group[right][None, :]))
        x, y = left[x], right[y]
        _, first = np.unique(group[x].astype(np.int64) * len(ids) + group[y], return_index=True)
        root = list(range(len(ids)))

        def find(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        found = []
        for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """id, centre: nodes of one fingerprint with one of them, and those that hang fingerprints within four bits together."""
    prints = cut(nodes.groupBy("fp").agg(F.min("id").alias("centre")))
    same = nodes.join(prints, "fp").filter("id <> centre").select("id", "centre")
    first = prints.select(F.col("fp").alias("a"), F.col("centre").alias("id"))
    near = near_links(prints.select("fp")).distinct().join(first, "a").join(prints.withColumnRenamed("fp", "b"), "b")
    return same.unionByName(near.select("id", "centre"))


def _links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    thin = nodes.select(F.explode("keys").alias("key"), "id")
    several = thin.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = cut(thin.join(several, "key"))
    # a node near the middle of a group lies in many of its buckets
    standing = met.join(met.groupBy("id").agg(F.sum("size").alias("standing")), "id")
    centres = standing.groupBy("key").agg(F.max(F.struct("standing", "id"))["id"].alias("centre"))
    node = F.struct("id", "n", *_MARKS)
    met = cut(met.join(centres, "key").select("key", "id", "centre"))
    candidates = met.filter("id <> centre").select("id", "centre").unionByName(_simhash_pairs(nodes)).distinct()
    first = candidates.join(nodes.select("id", node.alias("node")), "id").join(nodes.select(F.col("id").alias("centre"), node.alias("hub")), "centre")
    pairs = cut(first.filter(_may_be_near("node", "hub")).select(F.col("centre").alias("a"), F.col("id").alias("b")))
    sets = _sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")), nodes)
    x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    common, both = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    links = cut(pairs.join(y, "b").join(x, "a").filter(common * sum(NEAR) >= both * NEAR[0]).select("a", "b"))

    groups = components(links).select(F.col("node").alias("id"), "component")
    rest = met.filter("id <> centre").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))
    rest = cut(rest.join(nodes.select("id", "n", *_MARKS), "id"))
    of_group = rest.groupBy("key", "group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    of_bucket = of_group.groupBy("key").agg(F.max_by(F.struct("group", "size", "shingles"), F.struct("size", "group")).alias("most"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))

    def blocks_of(size: Column, shingles_: Column) -> Column:
        return F.ceil(F.greatest(size / BLOCK, shingles_ / BLOCK_SHINGLES)).cast("int")

    outside = blocks_of(F.col("size") - F.col("most.size"), F.col("shingles") - F.col("most.shingles"))
    apart = of_bucket.filter("size > most.size").select("key", F.col("most.group").alias("most"), blocks_of(F.col("size"), F.col("shingles")).alias("_i"), outside.alias("_j"))
    rest = rest.join(apart, "key")
    columns = [*_KEY, "is_right", "id", "group", "n", *_MARKS]

    def spread(side: DataFrame, own: str, other: str, is_right: bool) -> DataFrame:
        """Each node in its block of this side, once for each block of the other."""
        placed = side.withColumn(own, F.pmod(F.xxhash64("id"), f"_{own}").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)))
        return placed.withColumn("is_right", F.lit(is_right)).select(*columns)

    blocks = spread(rest, "i", "j", False).unionByName(spread(rest.filter("group <> most"), "j", "i", True))
    may = cut(blocks.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_plausible, "key long, i int, j int, is_right boolean, id binary, group binary"))
    sets = _sets(rows, may, nodes)
    more = may.join(sets, "id").repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_spanning, "a binary, b binary")
    return links.unionByName(more)


def _nodes(sketched: DataFrame) -> DataFrame:
    """One row a set: its smallest row, size, marks and keys."""
    return cut(sketched.groupBy("id").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", *_MARKS, "keys"))))


def jaccard_links(rows: DataFrame) -> DataFrame:
    """Links a, b between rows of row, text (as strings) that hang all near ones together; rows of one set are
    linked to the smallest."""
    sketched = cut(sketches(rows))
    nodes = _nodes(sketched)
    names = nodes.select("id", F.col("row").alias("first"))
    links = _links(rows, nodes).join(names.select(F.col("id").alias("a"), F.col("first").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("first").alias("y")), "b")
    same = sketched.join(names, "id").filter("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    return links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)


def jaccard_groups(rows: DataFrame) -> DataFrame:
    """row (as string), group of every row of row, text: near copies have one group, other rows each their own.

    A null text counts as empty; all texts without words are one group. An empty
    table gives no rows; further columns are ignored. Whole texts are read; of a very
    long one a task holds the text and its set of shingles, and blocks of sets that are compared
    have about 16 MB on either side, or are one set."""
    sketched = cut(sketches(rows))
    linked = components(_links(rows, _nodes(sketched))).select(F.col("node").alias("id"), "component")
    return sketched.join(linked, "id", "left").select("row", F.coalesce("component", "id").alias("group"))
