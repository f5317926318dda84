"""Mixing sources to target weights by Sainte-Lague apportionment.

The total is cut into equal blocks of words. Blocks go to sources, and a source's
blocks to its shards, by highest quotients v / (2k + 1), so quotas are whole
numbers. Inside a shard, documents stand in a seeded order; whole passes over the
shard come first, the rest of the quota is a seeded run of consecutive blocks.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 64
#: A source of n words has the square root of n / SHARD_WORDS shards, so shards and their words grow alike.
SHARD_WORDS = 131_072


def _number(*parts: Column) -> Column:
    """A seeded number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def apportion(df: DataFrame, within: list[str], votes: str, seats: str, ties: list[str]) -> DataFrame:
    """Add ``quota``: Sainte-Lague seats of each row, per group ``within``.

    Quotients rank per group, but only those near the cut: a row with share s of
    the votes gets between s(M - n/2) - 1/2 and s(M + n/2) + 1/2 of M seats among
    n rows, so about four candidates a row decide. A group without votes gets no
    seats."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    share = F.col(votes) / F.col("_sum")
    spread = (
        df.withColumn("_sum", F.sum(votes).over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_lo", F.when(F.col("_sum") > 0, F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2) - 0.5))).otherwise(0).cast("long"))
        .withColumn("_hi", F.when(F.col("_sum") > 0, F.greatest(F.lit(0), F.ceil(share * (F.col(seats) + F.col("_n") / 2) + 0.5))).otherwise(0).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_lo").over(group))
    )
    ranked = spread.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn(
        "_rank", F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *ties, "_k"))
    )
    won = (F.col("_rank") <= F.col("_open")) & (F.col(votes) > 0)
    keys = [c for c in df.columns]
    return ranked.groupBy(*keys).agg((F.first("_lo") + F.count_if(won)).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: int = 2) -> DataFrame:
    """pos, source, source_size, target: one row a source.

    Sources in code-point order (null last) take the weights in turn and share
    ``factor`` times all words; a target stops at ``most`` times its source's
    words and the excess is shared again by weight. That process ends where every
    target is min(cap, level x weight), and the level follows from the sources in
    order of cap / weight."""
    every = Window.partitionBy(F.lit(0))
    pos = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("pos", pos)
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("pos") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("goal", factor * F.sum("source_size").over(every))
    )
    before = every.orderBy(F.col("cap") / F.col("w"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        sources.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_after", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("cap_before") * F.col("w") + F.col("cap") * F.col("w_after") <= F.col("goal") * F.col("w"))
        .withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("goal") - F.col("full_cap")) * F.col("w") / F.col("open_w"))
    return levelled.select("pos", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
        weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source.

    ``size`` counts words (null text: 0). ``taken`` words of a document go into
    the mix, repeats counted, at most ``most`` times its size; a source's taken
    words are its quota of blocks, so they miss the target by less than a block
    plus a block for each shard filled to the brim. A null source is a source of
    its own. Empty documents take nothing; an empty table gives no rows. Repeated
    rows count each for itself. The same input and seed give the same result.
    Further columns are ignored, but for ``row_col``, a name of the row, which comes
    along as ``row``. Texts are only counted, so very long ones take no memory.
    """
    sizes = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        # of the text too: rows without an identifier, or of one, are spread like others
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.md5(text_of().cast("binary"))).alias("name"), *([F.col(row_col).cast("string").alias("row")] if row_col else []),
    ))
    targets = source_targets(sizes, weights, factor, most)
    quotas = apportion(
        targets.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5)), [], "target", "seats", ["pos"]
    ).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / shard_words))).cast("long"))
    quotas = cut(quotas.select("pos", "source", "source_size", "target", F.col("quota").alias("source_quota"), "n_shards"))

    placed = (
        sizes.withColumnRenamed("source", "src")
        .join(quotas, F.col("src").eqNullSafe(F.col("source")))
        .withColumn("shard", _number(F.col("name"), F.lit(f"shard{seed}")) % F.col("n_shards"))
        .select("doc_id", "name", *(["row"] if row_col else []), "source", "size", "pos", "source_size", "target", "source_quota", "shard")
    )
    shards = placed.groupBy("pos", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shares = apportion(shards, ["pos"], "shard_size", "source_quota", ["shard"]).select("pos", "shard", "shard_size", "quota")

    within = Window.partitionBy("pos", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.least(F.col("quota") * block, most * F.col("shard_size"))
    n, c, size = F.col("shard_size"), F.col("at"), F.col("size")
    passes = F.when(n > 0, F.floor(words / n)).otherwise(0).cast("long")
    run_end = F.col("start") + F.col("rest")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(c + size, hi) - F.greatest(c, lo))

    return (
        placed.join(shares, ["pos", "shard"])
        .withColumn("turn", F.md5(F.concat_ws(":", "name", F.lit(f"turn{seed}"))))
        .withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("passes", passes)
        .withColumn("rest", words - F.col("passes") * n)
        .withColumn("start", F.when(n > 0, (_number(F.col("pos").cast("string"), F.col("shard").cast("string"), F.lit(f"start{seed}")) % F.ceil(n / block)) * block).otherwise(0))
        .withColumn("taken", (F.col("passes") * size + overlap(F.col("start"), F.least(run_end, n)) + overlap(F.lit(0), run_end - n)).cast("long"))
        .select("doc_id", "size", "source_size", "target", "taken", "source", *(["row"] if row_col else []))
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sizes GROUP BY source
), s1 AS (
  SELECT *, [3, 1, 2][((pos - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS goal FROM s0
), s2 AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS w_after FROM s1
  WINDOW b AS (ORDER BY cap::DOUBLE / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (SELECT *, cap_before * w + cap * w_after <= goal * w AS filled FROM s2
), s4 AS (
  SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()::DOUBLE AS full_cap, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ()::DOUBLE AS open_w FROM s3
), t AS (
  SELECT pos, source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (goal - full_cap) * w / open_w END AS target,
         greatest(1, ceil(sqrt(source_size::DOUBLE / {SHARD_WORDS})))::BIGINT AS n_shards FROM s4
), m AS (SELECT floor(sum(target) / {BLOCK_WORDS} + 0.5)::BIGINT AS seats, greatest(sum(target), 1) AS total, count(*) AS n FROM t
), won AS (
  SELECT pos, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, pos, k) AS rk, seats, target
  FROM t, m, unnest(generate_series(0, ceil(target / total * (seats + n / 2.0) + 0.5)::BIGINT)) AS u(k)
), q AS (
  SELECT t.*, (SELECT count(*) FROM won WHERE won.pos = t.pos AND rk <= seats AND won.target > 0) AS quota FROM t
), placed AS (
  SELECT doc_id, name, q.source, size, pos, source_size, target, quota,
         ('0x' || substr(md5(name || ':shard42'), 1, 8))::BIGINT % n_shards AS shard
  FROM sizes JOIN q ON sizes.source IS NOT DISTINCT FROM q.source
), sh AS (SELECT pos, shard, any_value(quota) AS quota, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY pos)::DOUBLE AS total,
         count(*) OVER (PARTITION BY pos) AS parts FROM placed GROUP BY pos, shard
), shwon AS (
  SELECT pos, shard, n, quota, row_number() OVER (PARTITION BY pos ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard, k) AS rk
  FROM sh, unnest(generate_series(0, ceil(n / greatest(total, 1) * (quota + parts / 2.0) + 0.5)::BIGINT)) AS u(k)
), shq AS (
  SELECT sh.pos, sh.shard, sh.n, (SELECT count(*) FROM shwon x WHERE x.pos = sh.pos AND x.shard = sh.shard AND rk <= x.quota AND x.n > 0) AS quota FROM sh
), f AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, p.source, h.n, least(h.quota * {BLOCK_WORDS}, 2 * h.n) AS words,
         coalesce(sum(p.size) OVER (PARTITION BY p.pos, p.shard ORDER BY md5(name || ':turn42'), doc_id, p.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         CASE WHEN h.n > 0 THEN ('0x' || substr(md5(p.pos || ':' || p.shard || ':start42'), 1, 8))::BIGINT % ceil(h.n / {float(BLOCK_WORDS)})::BIGINT * {BLOCK_WORDS} ELSE 0 END AS st
  FROM placed p JOIN shq h USING (pos, shard)
), g AS (SELECT *, CASE WHEN n > 0 THEN words // n ELSE 0 END AS passes, words - (CASE WHEN n > 0 THEN words // n ELSE 0 END) * n AS rest FROM f)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (passes * size + greatest(0, least(c + size, least(st + rest, n)) - greatest(c, st)) + greatest(0, least(c + size, st + rest - n) - c))::BIGINT AS taken,
       source
FROM g
"""
