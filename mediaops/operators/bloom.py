"""A Bloom filter as a table of 64-bit words: built by partial aggregation, looked up by a broadcast join.

A key sets four bits of one word, so a lookup touches one row. With 16 bits a key about one
foreign key in a hundred passes; no key that was put in ever fails. All of it
are built-in expressions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, PROBES = 16, 4
#: Most words of a filter that is broadcast: 16 bytes each as rows, 16 MB in all.
MAX_WORDS = 1 << 20


def word_of(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(words))


def mask_of(key: Column) -> Column:
    """The key's bits in its word: six bits of a second hash for each probe."""
    h = F.xxhash64(key, F.lit(2))
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return reduce(Column.bitwiseOR, one)


def words_for(keys: DataFrame, key: str) -> int:
    """Words of a filter of the keys, from their approximate number."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    return max(1, -(-n * BITS_A_KEY // 64))


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """_word, _bits of the filter of all keys that are not null; tasks merge their bits before they shuffle. Filters of equal size merge by another ``build`` or by ``merged``."""
    put = keys.filter(F.col(key).isNotNull()).select(word_of(F.col(key), words).alias("_word"), mask_of(F.col(key)).alias("_mask"))
    return put.groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one size (a day's keys into the history's)."""
    return reduce(DataFrame.unionByName, filters).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def hits(df: DataFrame, key: str, filter_: DataFrame, words: int) -> DataFrame:
    """Rows whose key may be in the filter. The filter is broadcast, so it must have at most MAX_WORDS words."""
    if words > MAX_WORDS:
        raise ValueError(f"a filter of {words} words is too large to broadcast")
    met = df.withColumn("_at", word_of(F.col(key), words)).join(F.broadcast(filter_), F.col("_at") == F.col("_word"))
    return met.filter(F.col("_bits").bitwiseAND(mask_of(F.col(key))) == mask_of(F.col(key))).select(*df.columns)


def history_hits(df: DataFrame, seen: DataFrame, key: str, most: int = MAX_WORDS) -> DataFrame | None:
    """The keys of a large history that may be in ``df``, found where the history lies; None if ``df`` has too many keys for a filter.

    Only these keys shuffle: about the ones in common, and a hundredth of the rest."""
    words = words_for(df, key)
    if words > most:
        return None
    return hits(seen.select(key).filter(F.col(key).isNotNull()), key, build(df, key, words), words)


def unseen(df: DataFrame, seen: DataFrame, key: str, most: int = MAX_WORDS) -> DataFrame:
    """Rows of ``df`` whose key the history lacks; a row without a key is unseen.

    A Bloom filter of the batch's keys thins the history before the anti join, which decides;
    a batch with too many keys for a broadcast is joined with the whole history."""
    may = history_hits(df, seen, key, most)
    may = seen.select(key) if may is None else may
    return df.join(may.distinct(), key, "left_anti")


def share_read(df: DataFrame, seen: DataFrame, key: str, most: int = MAX_WORDS) -> DataFrame:
    """One row: history (rows), passed (those that the filter lets through to the join) and their share."""
    may = history_hits(df, seen, key, most)
    may = seen.select(key) if may is None else may
    both = seen.agg(F.count(F.lit(1)).alias("history")).crossJoin(may.agg(F.count(F.lit(1)).alias("passed")))  # one row each
    return both.withColumn("share", F.col("passed") / F.greatest("history", F.lit(1)))
