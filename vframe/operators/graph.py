"""Records that refer to records: cycles and their paths.

Structs cannot hold a cycle, so graphs are edges (parent, field, child). Edges
that lead to no cycle are taken away first, so that a graph without cycles is
never walked, however often its records are shared. A walk from each start
then takes one step a round and ends where it comes back to a record that it
has passed.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.errors import CircularReferenceError
from vframe.sources.scratch import folder


def step(path: Column, field: Column, key: Column | None = None) -> Column:
    """A path one step on: ``a.b``, ``a[0]`` or ``a['k']``."""
    named = F.when(path == "", field).otherwise(F.concat(path, F.lit("."), field))
    if key is None:
        return named
    index = F.when(key.rlike("^[0-9]+$"), F.concat(F.lit("["), key, F.lit("]"))).otherwise(F.concat(F.lit("['"), key, F.lit("']")))
    return F.when(key.isNull(), named).otherwise(F.concat(named, index))


def lasting(edges: DataFrame) -> DataFrame:
    """The edges from which a walk can go on for ever: into a cycle, or within one.

    Each round takes away the edges to records that refer to nothing, and is
    written to the shared folder; there are as many rounds as the longest way
    that leads to no cycle.
    """
    spark, root, left, n = edges.sparkSession, folder(edges.sparkSession, "edges"), edges, None
    for i in itertools.count():
        left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select(edges.columns).write.parquet(f"{root}/{i}")
        left = spark.read.schema(edges.schema).parquet(f"{root}/{i}")
        if n == (n := left.count()):
            return left


def returns(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, steps and path of each way from a start back to a record on it.

    ``edges`` has parent, field, key (null for a plain field) and child;
    ``starts`` has id. Walks go on until none is left: none passes a record
    twice, so they end. Each round is written to the shared folder.
    """
    spark, root, edges = edges.sparkSession, folder(edges.sparkSession, "walks"), lasting(edges)
    walks = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("seen"), F.lit("").alias("path"))
    rounds: list[str] = []
    schema = None
    while schema is None or not walks.isEmpty():
        stepped = walks.join(edges, walks["node"] == edges["parent"]).select(
            "start", F.col("child").alias("node"), "seen", step(F.col("path"), F.col("field"), F.col("key")).alias("path"), F.array_contains("seen", F.col("child")).alias("back")
        )
        stepped = stepped.select("start", "node", F.size("seen").alias("steps"), F.when(F.col("back"), F.col("seen")).otherwise(F.concat("seen", F.array("node"))).alias("seen"), "path", "back")
        rounds.append(f"{root}/{len(rounds)}")
        stepped.write.parquet(rounds[-1])
        schema = stepped.schema
        walks = spark.read.schema(schema).parquet(rounds[-1]).filter(~F.col("back")).select("start", "node", "seen", "path")
    return spark.read.schema(schema).parquet(*rounds).filter("back").select("start", "node", "steps", "path")


def cycles(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start and path of each way from a start back to a record on it.

    Records that are shared, but not on their own path, are no cycle.
    """
    return returns(edges, starts).select("start", "path")


def check(edges: DataFrame, starts: DataFrame) -> None:
    """Raises with the path of a cycle, if there is one."""
    row = cycles(edges, starts).orderBy(F.length("path"), "path").first()
    if row is not None:
        raise CircularReferenceError(row["path"])


def key_to_path(key: Column) -> Column:
    """A map key as part of a path in a store: percent, slash and dot are escaped."""
    return F.replace(F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("."), F.lit("%2E"))


def path_to_key(part: Column) -> Column:
    return F.replace(F.replace(F.replace(part, F.lit("%2E"), F.lit(".")), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))
