"""Distributed connected components by alternating large and small stars.

Every round joins nodes to the least neighbour they know, with a partial
aggregation before each shuffle, written before a plain equi-join whose hot
keys adaptive execution may then split. Rounds are cut by tables in the shared
folder. Nothing but one row of counts goes to the driver. Without edges the
result is empty; a null id is no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import Scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node but the centres has one edge, to a centre."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    each = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge that is not its component's least.

    ``edges`` has integer columns a and b; loops and repeats are allowed. The
    component is the least id that can be reached. A node that is absent from
    the result is its own component.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.table(pairs, "edges")
    for _ in range(rounds):
        if _is_forest_of_stars(now):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        # large star: every larger neighbour goes to the least of the neighbourhood
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        large = scratch.table(large, "large")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
