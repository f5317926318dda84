"""SimHash near-duplicates by pigeonhole blocks.

64-bit fingerprints are cut into 4 + j blocks. Two fingerprints that differ in at
most 4 bits agree on at least j blocks, so they share the key made of those
blocks. Equal keys meet in one partition, the Hamming distance is verified there,
and only a spanning forest of each key's links goes on, never all pairs. j follows
from the number of distinct fingerprints, so keys stay longer than needed to tell
them apart; every j finds the same links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text: bit i is set if over half the shingles' XXH64 have it."""
    words = text.translate(_LOWER).split()  # on the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    votes, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        spans = zip(starts[at : at + 65_536].tolist() if n > 1 else starts, ends[at : at + 65_536].tolist() if n > 1 else ends, strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """Unsigned number whose bits are set in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (as signed long) of every row; a null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in texts], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(j: int, radius: int) -> list[int]:
    """One mask for each way to choose j of radius + j blocks, as signed longs."""
    m = radius + j
    at = [round(BITS * i / m) for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]
    masks = (sum(blocks[i] for i in c) for c in combinations(range(m), j))
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def _forest(run: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span each run's components. ``run`` is ascending; runs of over 64 go one by one."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    i = np.flatnonzero(np.repeat(sizes, sizes) <= 64)
    lag = 1
    while len(i):
        i = i[i + lag < len(run)]
        i = i[run[i] == run[i + lag]]
        hit = i[_near(fp[i], fp[i + lag], radius)]
        yield fp[hit], fp[hit + lag]
        lag += 1
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        left = fp[s : s + n]
        while len(left):
            root, left = left[0], left[1:]
            todo = [root]
            while todo and len(left):
                hit = _near(left, todo.pop(), radius)
                if hit.any():
                    got, left = left[hit], left[~hit]
                    todo.extend(got)
                    yield np.full(len(got), root), got


def _verify(radius: int, most: int) -> Callable:
    """Rows sorted by key to links (a, b); members of runs over ``most`` come back with b null."""

    def links(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*_forest(keys, fp, radius), (fp[:0], fp[:0]), strict=True))
        if len(a):
            pairs = np.unique(np.stack([np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))]), axis=1)
            yield pa.record_batch({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    def put_off(fp: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array(fp.view(np.int64)), "b": pa.nulls(len(fp), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_k, kept_f, n_runs, last, too_long = np.empty(0, np.int64), np.empty(0, np.uint64), 0, None, False
        for b in batches:
            if not b.num_rows:
                continue
            i, k, f = (b.column(c).to_numpy() for c in ("i", "k", "fp"))
            new = np.r_[last is None or (i[0], k[0]) != last, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]
            keys, last = n_runs + np.cumsum(new), (i[-1], k[-1])
            if too_long:  # the open run has outgrown the limit: its rows pass through
                more = keys == n_runs
                if more.any():
                    yield put_off(f[more].view(np.uint64))
                keys, f = keys[~more], f[~more]
                if not len(keys):
                    continue
                too_long = False
            kept_k, kept_f, n_runs = np.r_[kept_k, keys], np.r_[kept_f, f.view(np.uint64)], int(keys[-1])
            whole = kept_k < n_runs
            if whole.sum() >= 100_000:
                yield from links(kept_k[whole], kept_f[whole])
                kept_k, kept_f = kept_k[~whole], kept_f[~whole]
            if (kept_k == n_runs).sum() > most:
                tail = kept_k == n_runs
                yield put_off(kept_f[tail])
                kept_k, kept_f, too_long = kept_k[~tail], kept_f[~tail], True
        yield from links(kept_k, kept_f)

    return run


def near_links(prints: DataFrame, radius: int = 4, most: int = 20_000) -> DataFrame:
    """Links a, b (distinct signed fingerprints in ``fp``) that span all pairs within ``radius`` bits.

    A key with over ``most`` fingerprints is not compared in one task: two
    fingerprints are within radius 4 exactly if some value lies within 2 bits of
    both, so its members meet at those midpoints instead, spread over all
    partitions, and link to the smallest there."""
    n = prints.count()
    j = next((j for j in range(1, 5) if 2.0 ** (BITS * j / (radius + j)) >= 4.0 * n), 5)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks(j, radius))]))
    met = (
        prints.select("fp", keys.alias("key")).select("key.i", "key.k", "fp")
        .repartition("i", "k").sortWithinPartitions("i", "k")
        .mapInArrow(_verify(radius, most), "a long, b long")
    )
    found = cut(met)
    links = found.filter("b is not null")
    put_off = found.filter("b is null").select("a").distinct()
    if put_off.isEmpty():
        return links
    half = [sum(1 << b for b in c) for r in range(radius // 2 + 1) for c in combinations(range(BITS), r)]
    half = [x - (1 << 64) if x >> 63 else x for x in half]
    flips = F.broadcast(prints.sparkSession.createDataFrame([(half,)], "flips array<long>"))
    around = put_off.join(flips).select("a", F.explode("flips").alias("x")).select("a", F.col("a").bitwiseXOR(F.col("x")).alias("mid"))
    hub = around.groupBy("mid").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "b")
    return links.unionByName(around.join(hub, "mid").filter("a <> b").select("a", "b").distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, most: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest identifier reachable over links of at most
    ``radius`` (an even number) differing bits. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows with a null identifier take
    part, but name no component unless they are alone (then it is null). Repeated
    rows share their component; an empty table gives no rows; further columns are
    ignored. Whole texts are read, however long; of one a task holds the text, its words and a number for each shingle."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(near_links(prints.select("fp"), radius, most))
    named = prints.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = cut(named.join(smallest, "component").select("fp", "component_id"))
    return rows.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
