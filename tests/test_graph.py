"""Cycles, key escapes and the data source."""

import pytest
from pyspark.sql import functions as F

from vframe.errors import CircularReferenceError
from vframe.operators import graph
from vframe.sources import datasource


def test_cycles(spark):
    edges = spark.createDataFrame([(1, "partner", None, 2), (2, "partner", None, 1), (3, "children", "0", 4), (4, "children", "0", 3), (5, "by", "self", 5), (6, "left", None, 7), (6, "right", None, 7)], "parent int, field string, key string, child int")
    starts = spark.createDataFrame([(1,), (3,), (5,), (6,)], "id int")
    assert sorted(map(tuple, graph.cycles(edges, starts).collect())) == [(1, "partner.partner"), (3, "children[0].children[0]"), (5, "by['self']")]
    with pytest.raises(CircularReferenceError, match="partner.partner"):
        graph.check(edges, starts.filter("id = 1"))
    graph.check(edges, starts.filter("id = 6"))


def test_long_cycle(spark):
    edges = spark.createDataFrame([(i, "next", None, (i + 1) % 104) for i in range(104)], "parent int, field string, key string, child int").coalesce(1)
    starts = spark.createDataFrame([(0,)], "id int").coalesce(1)
    assert sorted(map(tuple, graph.cycles(edges, starts).collect())) == [(0, ".".join(["next"] * 104))]


def test_keys(spark):
    df = spark.createDataFrame([("a/b.c%d%2E",)], ["k"])
    row = df.select(graph.key_to_path(F.col("k")).alias("p"), graph.path_to_key(graph.key_to_path(F.col("k"))).alias("k")).first()
    assert tuple(row) == ("a%2Fb%2Ec%25d%252E", "a/b.c%d%2E")


def test_data_source(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\n---\nname: y\n")
    (tmp_path / "b.toml").write_text('name = "z"\n')
    datasource.register(spark)
    rows = spark.read.format("vframe").load(str(tmp_path)).collect()
    assert sorted(r["doc"] for r in rows) == ['{"name": "x"}', '{"name": "y"}', '{"name": "z"}']


def test_shared_records_without_a_cycle_are_not_walked(spark):
    """Twenty diamonds in a row: 2 ** 20 ways, none of which comes back; then a cycle at their end."""
    rows = [(3 * i, f, None, 3 * i + j) for i in range(20) for f, j in (("left", 1), ("right", 2))] + [(3 * i + j, "next", None, 3 * i + 3) for i in range(20) for j in (1, 2)]
    schema = "parent bigint, field string, key string, child bigint"
    edges = spark.createDataFrame(rows, schema)
    assert graph.lasting(edges).count() == 0
    starts = spark.createDataFrame([(0,)], "id bigint")
    assert graph.cycles(edges, starts).count() == 0
    looped = spark.createDataFrame([(1, "a", None, 2), (2, "b", None, 3), (3, "c", "k", 2), (3, "d", None, 4)], schema)
    assert [tuple(r) for r in graph.cycles(looped, spark.createDataFrame([(1,)], "id bigint")).collect()] == [(1, "a.b.c['k']")]
