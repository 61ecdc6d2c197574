"""Chunked arrays, sessions, nested migration of typed columns, polymorphism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vframe.errors import BackendError, VersionError
from vframe.functions.types import NdArray
from vframe.operators import arrays
from vframe.plans import nested
from vframe.plans.migration import Migration
from vframe.plans.record import RecordType
from vframe.streaming.session import Session


@pytest.mark.parametrize(("shape", "dtype", "axis"), [((0,), "int16", 0), ((0, 50), "float32", 0), ((6, 0, 3), "complex64", 1), ((0, 70_000), "float64", 0), ((0,), "uint8", 0)])
def test_chunks_aim_at_their_bytes(shape, dtype, axis):
    row = arrays.ITEM_BYTES[dtype]
    for i, n in enumerate(shape):
        row *= 1 if i == axis else n
    rows = arrays.chunk_rows(shape, dtype, axis)
    assert rows == 1 if row > arrays.CHUNK_BYTES else rows * row <= arrays.CHUNK_BYTES < (rows + 1) * row
    assert arrays.chunk_rows(shape, dtype, axis, 7) == 7


def test_axis_and_shape_of_appends():
    assert [arrays.append_axis(s) for s in ((0, 9), (8, 0, 2), (3, 5), ())] == [0, 1, 0, 0]
    assert [arrays.append_axis((2, 3, 4), i) for i in (-1, 1, -3)] == [2, 1, 0]
    for bad in ((0, 2, 0), (0, 0)):
        with pytest.raises(BackendError, match="several"):
            arrays.append_axis(bad)
    with pytest.raises(BackendError, match="out of range"):
        arrays.append_axis((2, 2), 2)
    assert arrays.appended_shape((7, 2, 3), (7, 9, 3), 1) == (7, 11, 3)
    for more in ((7, 9, 4), (7, 9)):
        with pytest.raises(BackendError):
            arrays.appended_shape((7, 2, 3), more, 1)


def test_slices_after_short_appends(spark, tmp_path):
    base = spark.createDataFrame([(1, [float(i) for i in range(10)])], "id bigint, a array<double>")
    now = arrays.to_chunks(base, "id", "a", 4, "float64")
    have = [float(i) for i in range(10)]
    for more in ([10.0], [11.0, 12.0, 13.0, 14.0], [], [15.0] * 6):
        df = spark.createDataFrame([(1, more)], "doc_id bigint, vals array<double>")
        now = now.unionByName(arrays.append(now, df, "a", 4, "float64"))
        have += more
    now = spark.createDataFrame(now.collect(), now.schema)
    for low in range(0, len(have) + 2, 3):
        for high in range(low, len(have) + 3, 2):
            got = arrays.read_slice(now, low, high, 4).collect()
            assert (got[0]["vals"] if got else []) == have[low:high]
    changed = {r["start"]: r["vals"] for r in arrays.update(now, 11, 13, F.lit(-1.0), 4).collect()}
    assert changed[11] == [-1.0, -1.0, 13.0, 14.0]


@pytest.fixture
def chunks(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, []), (3, [5.0])], "id bigint, a array<double>")
    return arrays.to_chunks(df, "id", "a", 4, "float64")


def values(df):
    return {r["doc_id"]: r["vals"] for r in df.collect()}


def test_chunks(spark, chunks):
    assert values(arrays.joined(chunks)) == {1: [float(i) for i in range(10)], 2: [], 3: [5.0]}
    assert values(arrays.read_slice(chunks, 3, 6, 4))[1] == [3.0, 4.0, 5.0]
    assert values(arrays.joined(arrays.resize(chunks, 6, 4))) == {1: [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 2: [0.0] * 6, 3: [5.0] + [0.0] * 5}
    more = spark.createDataFrame([(1, [99.0]), (4, [7.0])], "doc_id bigint, vals array<double>")
    grown = values(arrays.joined(chunks.unionByName(arrays.append(chunks, more, "a", 4, "float64"))))
    assert grown[1][-1] == 99.0 and len(grown[1]) == 11 and grown[4] == [7.0]
    assert {r["chunk_no"]: r["vals"] for r in arrays.update(chunks.filter("doc_id = 1"), 2, 5, F.lit(-1.0), 4).collect()} == {0: [0.0, 1.0, -1.0, -1.0], 1: [-1.0, 5.0, 6.0, 7.0]}


RUN = RecordType("Run", 1, {"name": str, "tags": list[str], "by": dict[str, int], "data": NdArray("float64")}, register=False)


def state(s):
    return {(r["field"], r["key"], r["idx"]): r["value"] for r in s.state().collect()}


def test_session(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with Session(spark, RUN, path, chunk_rows=4) as s:
        s.set("name", "a")
        s.set("name", "b")
        tags = s.list("tags")
        tags.extend(["x", "y"])
        tags[-1] = "z"
        by = s.map("by")
        by.update({"k": 1, "gone": 2})
        del by["gone"]
        s.append("data", [1.0, 2.0, 3.0])
        with pytest.raises(BackendError):
            tags.pop()
    with Session(spark, RUN, path, mode="resume", chunk_rows=4) as s:
        s.list("tags").append("w")
        s.append("data", [4.0, 5.0])
        s.flush()
        assert state(s) == {("name", None, None): '"b"', ("tags", None, 0): '"x"', ("tags", None, 1): '"z"', ("tags", None, 2): '"w"', ("by", "k", None): "1"}
        assert values(s.array("data")) == {0: [1.0, 2.0, 3.0, 4.0, 5.0]}
    with pytest.raises(BackendError):
        s.set("name", "closed")
    with pytest.raises(BackendError), Session(spark, RUN, path, mode="read") as r:
        r.set("name", "c")
    with pytest.raises(Exception, match="(?i)already exists"), Session(spark, RUN, path):
        pass
    with pytest.raises(VersionError), Session(spark, RecordType("Run", 2, RUN.fields, register=False), path, mode="resume"):
        pass
    with pytest.warns(UserWarning, match="data"), Session(spark, RUN, path, mode="overwrite") as s:
        s.set("name", "n")


def test_session_of_several_axes(spark, tmp_path):
    record = RecordType("Grid", 1, {"name": str, "rows": NdArray("int32"), "columns": NdArray("float64"), "flat": NdArray("float32"), "tags": list[str]}, register=False)
    path, rng = f"file://{tmp_path}/g", np.random.default_rng(4)
    rows, columns = [rng.integers(0, 99, (n, 3)) for n in (4, 1, 6)], [rng.random((2, n, 3)) for n in (5, 2, 1)]
    with Session(spark, record, path, chunk_rows={"rows": 3, "columns": 2}, axis={"columns": 1}) as s:
        s.populate({"name": "g", "rows": rows[0], "columns": columns[0], "flat": [1.5, 2.5], "tags": ["a", "b"]})
        s.append("rows", rows[1])
    for i in (1, 2):
        with Session(spark, record, path, mode="resume", chunk_rows={"rows": 3, "columns": 2}) as s:  # the axis is kept
            s.append("columns", columns[i])
    with Session(spark, record, path, mode="resume", chunk_rows=3) as s:
        s.append("rows", rows[2])
        with pytest.raises(BackendError):
            s.append("rows", np.zeros((2, 4)))
    with Session(spark, record, path, mode="read") as s:
        assert (s.ndarray("rows") == np.concatenate(rows)).all() and (s.ndarray("columns") == np.concatenate(columns, axis=1)).all()
        assert s.ndarray("flat").tolist() == [1.5, 2.5] and s.ndarray("rows").dtype == np.int32
        assert state(s) == {("name", None, None): '"g"', ("tags", None, 0): '"a"', ("tags", None, 1): '"b"'}
        assert {r["start"] for r in s.chunks("rows").collect()} == {0, 3, 4, 5, 8}


def test_polymorphic(spark):
    animal = RecordType("Animal", 1, {"name": str}, register=False)
    dog = RecordType("Dog", 2, {"sound": str}, base=animal, migrations={1: Migration().rename("bark", "sound")}, register=False, old_names=("Hound",))
    cat = RecordType("Cat", 1, {"lives": int}, base=animal, register=False)
    rock = RecordType("Rock", 1, {"name": str}, register=False)
    df = spark.sql(
        """SELECT 'Hound' AS object, named_struct('_v', 1, 'name', 'rex', 'bark', 'woof', 'sound', cast(null AS string), 'lives', cast(null AS bigint)) AS x
        UNION ALL SELECT 'Cat', named_struct('_v', 1, 'name', 'tom', 'bark', null, 'sound', null, 'lives', 9L)"""
    )
    made = nested.dispatch(F.col("x"), df.schema["x"].dataType, F.col("object"), [dog, cat, rock], base=animal)
    assert sorted(tuple(r) for r in df.select(made.alias("y")).select("y.*").collect()) == [("Cat", "tom", None, 9), ("Dog", "rex", "woof", None)]
    bad = df.withColumn("object", F.lit("Rock"))
    with pytest.raises(Exception, match="not a Animal"):
        bad.select(made).collect()
    with pytest.raises(Exception, match="unknown record type"):
        df.withColumn("object", F.lit("Bird")).select(made).collect()
