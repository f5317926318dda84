"""Bounded walk over a link table, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 3, budget: int | None = None) -> DataFrame:
    """node, level of what is reached from ``seeds`` (node) over ``edges`` (src, dst) in ``depth`` steps, each node once.

    With a budget, the first nodes by level and name are kept. Each level is one
    join of the frontier and one anti join with the visited, and is written once; the visited are
    the levels' tables together, none of which is written again."""
    visited = written(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    frontier = visited
    for level in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(visited.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.orderBy("level", "node").limit(budget) if budget is not None else visited


def host_caps(pages: DataFrame, host: str, order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return pages.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
