"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (large) or smaller (small) neighbours to the smallest."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    low = low.withColumn("low", F.least("u", "low"))
    moved = both.join(low, "u").filter("v > u" if large else "v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns a, b (links in any direction) to node, component (its smallest node).

    Each round writes its links to the shared folder; the rounds grow with the
    logarithm of the longest chain. A node's links are never gathered: minima are
    pre-aggregated and joined back. Nodes without a link do not appear."""
    e = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        e = cut(_star(_star(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
        seen = tuple(now)
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
