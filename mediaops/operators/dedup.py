"""Duplicates by hash: exact, near within a block, and greedy.

Near duplicates share a tenant and a hash prefix by definition; close hashes with
another prefix are not looked for. The block is the join's equality, so rows are
compared inside blocks only, and crowded blocks are split further."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hamming_hex, phash_prefix


def wellformed(h: str) -> Column:
    return F.coalesce(F.length(h) >= 4, F.lit(False))


def exact_flags(df: DataFrame, h: str, order: list[str]) -> DataFrame:
    """is_dup: an earlier row has the same hash. Hashes that are null or under 4 digits are never duplicates.

    The earliest row of a hash is a minimum, so a hot hash is reduced before it
    shuffles; rows that agree in ``order`` too are told apart by none of them."""
    place = F.struct(*order)
    first = df.filter(wellformed(h)).groupBy(F.col(h).alias("_h")).agg(F.min(place).alias("_first"))
    met = df.join(first, F.col(h) == F.col("_h"), "left")
    return met.withColumn("is_dup", F.coalesce(wellformed(h) & (place != F.col("_first")), F.lit(False))).drop("_h", "_first")


def _segments(h: str, n: int, bits: int) -> Column:
    """The bits of a 16-digit hash behind its first ``bits``, in n segments of nearly equal width."""
    rest, width = F.conv(F.substring(h, bits // 4 + 1, 16 - bits // 4), 16, 10).cast("long"), 64 - bits
    ends = [width * i // n for i in range(n + 1)]
    return F.array(*[F.shiftright(rest, x).bitwiseAND(F.lit((1 << (y - x)) - 1)) for x, y in zip(ends, ends[1:], strict=False)])


def _subkeys(h: str, most: int, bits: int) -> Column:
    """A number for each two of ``most + 2`` segments. Hashes within ``most`` bits have two segments in common, so they share a number."""
    n = most + 2
    two = [(i, j) for i in range(n) for j in range(i)]
    s = _segments(h, n, bits)
    return F.array(*[F.lit(place).cast("long") * (1 << 40) + s[i] * (1 << 20) + s[j] for place, (i, j) in enumerate(two)])


CROWDED = 1000  # hashes of a tenant and prefix from which their block is split


def near_pairs(left: DataFrame, right: DataFrame, tenant: str, h: str, key: str, most: int = 8, bits: int = 16, crowded: int = CROWDED) -> DataFrame:
    """Pairs (left key, right key, distance) of equal tenant and prefix within ``most`` bits.

    Give one row a hash (see ``representatives``): equal hashes would meet all with all. A block with many hashes
    is not compared all with all: behind the prefix, hashes this near have two of ``most + 2`` segments in common, and only
    those that do meet, in blocks by tenant, prefix and these two. That takes hashes of 16 digits; the few of
    another length in a crowded block meet all of it."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        return df.filter(wellformed(h)).select(F.col(tenant).alias("_t"), F.col(key).alias(f"{side}_key"), F.lower(h).alias(f"_{side}"), phash_prefix(F.lower(h), bits).alias("_p"))

    a, b = rows(left, "left"), rows(right, "right")
    full = b.groupBy("_t", "_p").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).select("_t", "_p", F.lit(True).alias("_full"))
    a, b = (x.join(full, ["_t", "_p"], "left").withColumn("_full", F.coalesce("_full", F.lit(False))) for x in (a, b))
    split_a, split_b = (F.col("_full") & (F.length(c) == 16) for c in ("_left", "_right"))

    def distances(met: DataFrame) -> DataFrame:
        return met.withColumn("distance", hamming_hex(F.col("_left"), F.col("_right"))).filter(F.col("distance") <= most).select("left_key", "right_key", "distance")

    plain = distances(a.filter(~split_a).join(b.drop("_full"), ["_t", "_p"])).unionByName(distances(a.filter(split_a).join(b.filter(~split_b).drop("_full"), ["_t", "_p"])))
    if most + 2 > 64 - bits:
        return distances(a.join(b.drop("_full"), ["_t", "_p"]))
    x, y = (df.filter(cond).withColumn("_k", F.explode(_subkeys(c, most, bits))).drop("_full") for df, cond, c in ((a, split_a, "_left"), (b, split_b, "_right")))
    return plain.unionByName(distances(x.join(y, ["_t", "_p", "_k"])).distinct())


def representatives(df: DataFrame, tenant: str, h: str, key: str) -> DataFrame:
    """The smallest key of each hash of a tenant; with ``df`` itself, the membership of all rows."""
    return df.filter(wellformed(h)).groupBy(tenant, h).agg(F.min(key).alias(key))


def near_flags(df: DataFrame, tenant: str, h: str, key: str, most: int = 8) -> DataFrame:
    """near_dup: a row with a smaller key in the same block is within ``most`` bits.

    Equal hashes meet once: blocks hold distinct hashes with their smallest key."""
    first = df.groupBy(tenant, h).agg(F.min(key).alias(key))
    prefix = phash_prefix(F.lower(h))
    heads = first.filter(wellformed(h)).groupBy(F.col(tenant).alias("_t"), prefix.alias("_p")).agg(F.min(F.struct(key, h)).alias("_head"))
    met = first.filter(wellformed(h)).withColumn("_q", prefix).join(heads, (F.col(tenant) == F.col("_t")) & (F.col("_q") == F.col("_p")))
    by_head = (F.col(key) > F.col(f"_head.{key}")) & (hamming_hex(F.col(h), F.col(f"_head.{h}")) <= most)
    # a block's first hash settles those around it; only the others look for an earlier one
    settled = met.filter(by_head).select(F.col(key).alias("_k"))
    open_ = met.filter(~by_head).select(tenant, h, key)
    earlier = near_pairs(open_, first, tenant, h, key, most).filter("right_key < left_key").select(F.col("left_key").alias("_k")).unionByName(settled).distinct()
    near = first.join(earlier, F.col(key) == F.col("_k"), "left").select(tenant, h, F.col(key).alias("_first"), F.col("_k").isNotNull().alias("_near"))
    met = df.alias("d").join(near.alias("n"), F.col(f"d.{tenant}").eqNullSafe(F.col(f"n.{tenant}")) & F.col(f"d.{h}").eqNullSafe(F.col(f"n.{h}")), "left")
    flag = wellformed(f"d.{h}") & (F.coalesce(F.col("_near"), F.lit(False)) | (F.col(f"d.{key}") > F.col("_first")))
    return met.select("d.*", F.coalesce(flag, F.lit(False)).alias("near_dup"))


class _Memory:
    """The latest hashes of a block with their times, oldest first, as 64-bit words in flat arrays; all are compared in one step."""

    def __init__(self, size: int):
        self.size, self.start, self.end = size, 0, 0
        self.at, self.words = np.zeros(2 * size), np.zeros((2 * size, 1), np.uint64)

    def split(self, digits: str) -> np.ndarray:
        n = -(-len(digits) // 16)
        if n > self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, n - self.words.shape[1])))
        value = int(digits, 16)
        return np.array([value >> 64 * i & (1 << 64) - 1 for i in range(self.words.shape[1])], np.uint64)

    def forget(self, now: float, ttl: float) -> None:
        while self.start < self.end and now - self.at[self.start] > ttl:
            self.start += 1

    def near(self, words: np.ndarray, most: int) -> bool:
        return bool((np.bitwise_count(self.words[self.start : self.end] ^ words).sum(axis=1) <= most).any())

    def add(self, now: float, words: np.ndarray) -> None:
        if self.end - self.start == self.size:
            self.start += 1
        if self.end == len(self.at):  # move what is held to the front
            n = self.end - self.start
            self.at[:n], self.words[:n] = self.at[self.start : self.end].copy(), self.words[self.start : self.end].copy()
            self.start, self.end = 0, n
        self.at[self.end], self.words[self.end] = now, words
        self.end += 1


def greedy(df: DataFrame, tenant: str, h: str, ts: str, key: str, most: int = 8, size: int = 1000, ttl: int = 3600) -> DataFrame:
    """kept: no remembered hash of the block is within ``most`` bits. Only kept rows are remembered, the ``size``
    latest of a block and for ``ttl`` seconds; the oldest is forgotten first. Blocks are independent.

    Rows pass in order, batch by batch; a task holds a block's memory, never its rows."""
    kinds = dict(df.dtypes)
    fields = f"{key} {kinds[key]}, {tenant} {kinds[tenant]}, {h} string, kept boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, memory = None, _Memory(size)
        for pdf in batches:
            kept = []
            for name, p, now, x in zip(pdf[tenant], pdf["_p"], pdf["_at"], pdf[h], strict=True):
                here = (None if pd.isna(name) else name, p)
                if here != block:
                    block, memory = here, _Memory(size)
                if x is None or len(x) < 4:
                    kept.append(True)
                    continue
                memory.forget(now, ttl)
                words = memory.split(x)
                new = not memory.near(words, most)
                kept.append(new)
                if new:
                    memory.add(now, words)
            yield pdf.assign(kept=kept)[[key, tenant, h, "kept"]]

    prefix = F.coalesce(phash_prefix(F.lower(h)), F.lit(""))
    rows = df.select(key, tenant, h, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), prefix.alias("_p")).withColumn("_at", F.col("_us") / 1e6)
    return rows.repartition(tenant, "_p").sortWithinPartitions(tenant, "_p", "_us", key).mapInPandas(run, fields)


def outcomes(df: DataFrame, tenant: str, h: str, key: str, good: Column, most: int = 8) -> DataFrame:
    """outcome of each row: rejected, dup_exact, dup_near or accepted, tested in that order."""
    exact = exact_flags(df, h, [key]).withColumn("_good", good)
    near = near_flags(df.filter(good), tenant, h, key, most).select(F.col(key).alias("_k"), "near_dup")
    kind = F.when(~F.col("_good"), "rejected").when(F.col("is_dup"), "dup_exact").when(F.col("near_dup"), "dup_near").otherwise("accepted")
    return exact.join(near, F.col(key) == F.col("_k"), "left").withColumn("outcome", kind).drop("_k", "_good", "near_dup", "is_dup")
