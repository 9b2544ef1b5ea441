"""Closures over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

CAP = 1 << 20
#: Tables of equal weight that are merged into one.
TIER = 8


def reachable(edges: DataFrame, seeds: DataFrame, cap: int = CAP) -> DataFrame:
    """edges (src, dst), seeds (seed, node) -> (seed, node, level): the shortest level of each node. A frontier join a level;
    visited nodes are left out, so diamonds count once. Each level is a table; TIER tables of as many levels are merged, so a level reads
    some TIER * log(depth) tables, and a row is written again log(depth) times."""
    frontier = written(seeds.select("seed", "node", F.lit(0).alias("level")).distinct(), "frontier")
    tables = [(1, frontier)]  # how many levels each holds
    level = 0
    while level < cap:
        level += 1
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, [t for _, t in tables]).select("seed", "node")
        step = step.join(seen, ["seed", "node"], "left_anti")
        frontier = written(step.withColumn("level", F.lit(level)), "frontier")
        if not frontier.limit(1).count():
            return reduce(DataFrame.unionByName, [t for _, t in tables])
        tables.append((1, frontier))
        while len(tables) >= TIER and tables[-TIER][0] == tables[-1][0]:
            merged = written(reduce(DataFrame.unionByName, [t for _, t in tables[-TIER:]]), "visited")
            tables[-TIER:] = [(tables[-1][0] * TIER, merged)]
    raise ValueError("the graph is deeper than the cap")
