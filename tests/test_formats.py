"""Round trips through every format, envelopes, polymorphic loads and policies."""

import datetime as dt
import decimal
import enum
import json
import typing
import uuid

import pytest
from pyspark.sql import functions as F

from vframe.errors import BackendError
from vframe.functions.types import NdArray
from vframe.operators.policy import Fallback
from vframe.plans.migration import Migration
from vframe.plans.record import RecordType
from vframe.sources import formats, text


class Grade(enum.Enum):
    FIRST = "a"
    SECOND = "b"


STOP = RecordType("Stop", 1, {"km": float, "pause": int}, register=False)
#: One field for each kind of type.
TRIP = RecordType(
    "Trip",
    1,
    {
        "carrier": str, "seats": int, "fare": float, "night": bool, "grade": Grade, "leaves": dt.datetime, "sold": dt.date, "lasts": dt.timedelta, "at": dt.time,
        "ticket": uuid.UUID, "tax": decimal.Decimal, "way": typing.Literal["rail", "road"], "words": list[str], "held": list[bool], "codes": set[str], "ids": frozenset[int],
        "by_class": dict[str, int], "by_coach": dict[int, str], "origin": STOP, "stops": list[STOP], "seal": bytes, "wave": complex, "remark": str | None,
    },
    register=False,
)


@pytest.fixture(scope="module")
def trips(spark):
    """An ordinary row, one of extremes, and one of empty values and nulls."""
    return spark.sql(
        """SELECT * FROM VALUES
        ('Nord', 84L, 19.75D, false, 'b', timestamp_ntz'2031-02-28 23:59:59.125', date'2030-12-31', interval '1 05:00:07.5' day to second, '04:05:06', 'a1b2c3d4-0000-4000-8000-00000000beef', 3.140BD, 'rail',
         array('quiet', 'é"\\n'), array(false), array('k', 'l'), array(-4L, 9L), map('one', 1L, 'two', 2L), map(3L, 'c'), named_struct('km', 0.25D, 'pause', 4L),
         array(named_struct('km', 7.0D, 'pause', 0L), named_struct('km', -1.5D, 'pause', 2L)), X'00FF7E', named_struct('re', -0.5D, 'im', 8.0D), 'x'),
        ('', 9223372036854775807L, 1.7976931348623157E308D, true, 'a', timestamp_ntz'0001-01-01 00:00:00', date'9999-12-31', interval '-2 00:00:00' day to second, '23:59:59.999999', 'ffffffff-ffff-4fff-8fff-ffffffffffff', -99999999999999999999.000000000000000001BD, 'road',
         array('', 'null', 'yes', '007'), array(true, true), array('0'), array(0L), map('', -9223372036854775808L), map(-1L, ''), named_struct('km', -0.0D, 'pause', -1L),
         array(named_struct('km', 1E-300D, 'pause', 9007199254740993L)), X'', named_struct('re', 0.0D, 'im', -0.0D), ''),
        ('Zähl \u2028 µ', 0L, 0.1D, true, 'a', timestamp_ntz'1970-01-01 00:00:00.000001', date'1969-12-31', interval '0 00:00:00' day to second, '00:00:00', '00000000-0000-4000-8000-000000000000', 0BD, 'rail',
         array(), array(), array(), array(), map(), map(), named_struct('km', 2.0D, 'pause', 1L), array(), X'41', named_struct('re', 1.0D, 'im', 1.0D), cast(null AS string))
        AS t(carrier, seats, fare, night, grade, leaves, sold, lasts, at, ticket, tax, way, words, held, codes, ids, by_class, by_coach, origin, stops, seal, wave, remark)"""
    ).withColumn("tax", F.col("tax").cast("decimal(38,18)"))


@pytest.mark.parametrize("fmt", ["json", "yaml", "toml", "parquet"])
def test_round_trip(spark, trips, tmp_path, fmt):
    record = TRIP if fmt != "toml" else RecordType("Trip", 1, TRIP.fields, {"remark": None}, register=False)  # TOML has no null
    typed = record.migrate(trips, 1)
    formats.save(typed, record, f"{tmp_path}/x", format=fmt)
    order = lambda df: sorted(df.collect(), key=lambda r: r["ticket"])
    assert order(formats.load(spark, record, f"{tmp_path}/x", format=fmt)) == order(typed)


def test_large_files_are_split(spark, tmp_path):
    record = RecordType("Line", 1, {"k": int, "s": str}, register=False)
    rows = spark.range(0, 4000, 1, 1).select(F.col("id").alias("k"), F.lit("x" * 60).alias("s"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for fmt in ("json", "yaml", "toml"):
        formats.save(rows, record, f"{tmp_path}/{fmt}", format=fmt)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        try:
            got = formats.load(spark, record, f"{tmp_path}/{fmt}", format=fmt)
            parts = got.select(F.spark_partition_id().alias("p"), "k").groupBy("p").agg(F.count("*").alias("n")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(parts) > 3 and sum(r["n"] for r in parts) == 4000


def test_json_of_several_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n  "name": "one",\n  "retries": 2\n}\n')
    assert formats.load(spark, CONFIG, str(tmp_path / "p.json")).collect() == [("one", False, 2)]
    (tmp_path / "q.jsonl").write_text('{"name": "one"}\n{"name":\n')
    with pytest.raises(Exception, match="not an object"):
        formats.load(spark, CONFIG, str(tmp_path / "q.jsonl")).collect()


def test_arrays_in_text(spark, tmp_path):
    record = RecordType("Wave", 1, {"n": int, "a": NdArray("float64")}, register=False)
    blob = json.dumps(text.array_to_blob("float64", [2, 2], [1.5, float("nan"), float("inf"), -2.0]))
    (tmp_path / "w.json").write_text('{"n":1,"a":%s}\n{"n":2,"a":%s}\n' % (blob, blob.replace("__ver_ndarray__", "__ndarray__")))
    for r in formats.load(spark, record, str(tmp_path / "w.json")).collect():
        assert r["a"]["shape"] == [2, 2] and r["a"]["data"][0] == 1.5 and r["a"]["data"][1] != r["a"]["data"][1] and r["a"]["data"][2:] == [float("inf"), -2.0]


def test_data_source_shares_files_out(tmp_path):
    from vframe.sources.datasource import DocumentReader

    for i in range(5):
        (tmp_path / f"{i}.yaml").write_text(f"a: {i}\n---\na: {i + 10}\n")
    (tmp_path / "_hidden.yaml").write_text("a: 1\n")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        reader = DocumentReader({"path": path})
        parts = reader.partitions()
        assert len(parts) == 1 and sorted(json.loads(d)["a"] for p in parts for _, d in reader.read(p)) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def doc(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


CONFIG = RecordType("SimpleConfig", 1, {"name": str, "debug": bool, "retries": int}, {"debug": False, "retries": 3}, register=False)


def test_literal_documents(spark, tmp_path):
    plain = '{"name":"test","debug":true,"retries":5%s}'
    load = lambda body: formats.load(spark, CONFIG, doc(tmp_path, "a.json", body))
    want = [("test", True, 5)]
    assert load(plain % "") .collect() == want
    assert load(plain % ',"extra":1,"__record__":{"object":"SimpleConfig","version":1,"hash":""}').collect() == want
    assert load(plain % ',"__OBJECT__":"SimpleConfig","__VERSION__":1').collect() == want
    with pytest.raises(Exception, match="newer than 1"):
        load(plain % ',"__record__":{"version":999}').collect()
    with pytest.raises(Exception, match="document format"):
        load(plain % ',"__record__":{"version":1,"format":2}').collect()
    with pytest.raises(Exception, match="not an object"):
        load("[1, 2]").collect()
    assert formats.load(spark, CONFIG, doc(tmp_path, "b.yaml", "name: test\n# retries: 9\n")).collect() == [("test", False, 3)]
    assert formats.load(spark, CONFIG, doc(tmp_path, "c.TOML", 'name = "test"\nretries = 7\n')).collect() == [("test", False, 7)]
    with pytest.raises(BackendError, match="h5py"):
        formats.format_for("x.h5")
    with pytest.raises(BackendError, match="no format"):
        formats.format_for("x.csv")


def test_envelope_names_as_fields(spark, tmp_path):
    inner = RecordType("Clash", 1, {"object": str, "version": str, "hash": int}, register=False)
    r = RecordType("Outer", 1, {"object": str, "inner": inner}, register=False)
    body = {"object": "mine", "inner": {"object": "o", "version": "v", "hash": 3, "__record__": {"object": "Clash", "version": 1}}, "__record__": {"object": "Outer", "version": 1}}
    row = formats.load(spark, r, doc(tmp_path, "a.json", json.dumps(body))).first()
    assert row["object"] == "mine" and tuple(row["inner"]) == ("o", "v", 3)


def test_nested_versions(spark, tmp_path):
    child = RecordType("Child", 2, {"name": str}, migrations={1: Migration().rename("title", "name")}, register=False)
    r = RecordType("Parent", 1, {"one": child, "many": list[child], "by": dict[str, child]}, {"by": {}}, register=False)
    old, new = {"title": "t", "__record__": {"object": "Child", "version": 1}}, {"name": "n", "__record__": {"object": "Child", "version": 2}}
    row = formats.load(spark, r, doc(tmp_path, "a.json", json.dumps({"one": old, "many": [old, new], "by": {"k": old}}))).first()
    assert row["one"]["name"] == "t" and [x["name"] for x in row["many"]] == ["t", "n"] and row["by"]["k"]["name"] == "t"
    later = {"one": {"name": "x", "__record__": {"object": "Child", "version": 3}}, "many": []}
    with pytest.raises(Exception, match="newer than 2"):
        formats.load(spark, r, doc(tmp_path, "b.json", json.dumps(later))).collect()


def test_literals(spark, tmp_path):
    strict = RecordType("L", 1, {"mode": typing.Literal["fast", "slow"]}, register=False)
    with pytest.raises(Exception, match="not one of"):
        formats.load(spark, strict, doc(tmp_path, "a.json", '{"mode":"banana"}')).collect()
    loose = RecordType("L", 1, {"mode": typing.Annotated[typing.Literal["fast", "slow"], Fallback("fast")]}, register=False)
    assert formats.load(spark, loose, doc(tmp_path, "a.json", '{"mode":"banana"}')).collect() == [("fast",)]
    off = RecordType("L", 1, {"mode": typing.Literal["fast", "slow"]}, validate_literals=False, register=False)
    assert formats.load(spark, off, doc(tmp_path, "a.json", '{"mode":"banana"}')).collect() == [("banana",)]


def test_comment_defaults():
    body = {"name": "test", "debug": False, "retries": 3, "__record__": {"object": "S", "version": 1}}
    out = text.to_yaml(body, {"debug": False, "retries": 3}, "__record__")
    assert "name: test\n" in out and "# debug: false\n" in out and "# retries: 3\n" in out and "\n__record__:\n" in out
    out = text.to_toml(body, {"debug": False, "retries": 3}, "__record__")
    assert 'name = "test"\n' in out and "# debug = false\n" in out and "\n[__record__]\n" in out


def test_toml_has_no_null():
    assert "gone" not in text.to_toml({"gone": None, "x": 1}, {}, "__record__")
    with pytest.raises(BackendError):
        text.to_toml({"x": [1, None]}, {}, "__record__")


def test_array_blobs():
    blob = text.array_to_blob("int16", [2, 2], [1, 2, 3, 4])
    assert text.plain(blob) == {"dtype": "int16", "shape": [2, 2], "data": [1, 2, 3, 4]}
    assert text.plain({"__ver_json__": '{"a": 1}'}) == {"a": 1}


def test_pruned_arrays(spark, tmp_path):
    r = RecordType("Arr", 1, {"name": str, "data": NdArray("float64")}, register=False)
    body = {"name": "a", "data": {"dtype": "float64", "shape": [2], "data": [1.0, 2.0]}}
    path = doc(tmp_path, "a.json", json.dumps(body))
    assert formats.load(spark, r, path, metadata_only=True).columns == ["name"]
    assert formats.load(spark, r, path, preload=[]).columns == ["name"]
    assert formats.load(spark, r, path).first()["data"]["data"] == [1.0, 2.0]


PLAIN_AND_ODD = [
    {"k": 1, "name": "linen rose", "brand": "Brand#23", "price": 903.25, "__record__": {"object": "part", "version": 1, "hash": "1a2b3c4d"}},
    {"k": -3, "name": "-Infinity", "price": 1e22, "__record__": {"object": "part", "version": 1, "hash": "12345678"}},
    {"name": "yes", "a": "Null", "b": "12", "c": "1e5", "d": "a: b", "e": "a #b", "f": "", "g": "x " * 60, "h": [1, "No", None], "i": {}, "j": {"t": {"u": 0.5}}},
    {"name": "Zähl \u2028 µ", "a": "a\x85b", "b": "\U0001f600", "c": "\t", "d": "0x1F", "e": "2031-02-28", "f": "0012e4", "g": "a\nb\n", "yes": 1, "h": -0.0},
]


@pytest.mark.parametrize("body", PLAIN_AND_ODD)
def test_yaml_is_what_a_yaml_reader_takes(body):
    import yaml

    for defaults in ({}, {"name": body["name"]}):
        out = text.to_yaml(body, defaults, "__record__")
        left = {k: v for k, v in body.items() if k not in defaults}
        assert yaml.safe_load(out) == left and [json.loads(x) for x in text.from_yaml(out)] == [left]


@pytest.mark.parametrize("body", ["a: 1\n  b: 2\n", "a: x\n  y\n", "a:\nb: 1\n", "a: 010\n", "a: 'x'\n# n\na: 2\n", "a: 1\n---\nb: 2\n", "a:\n  b: 1\n c: 2\n", "a: b: c\n", "a:\tx\n", "a: |\n  b: 1\n", "- a: 1\n"])
def test_yaml_reads_as_before(body):
    import yaml

    def old():
        return [json.dumps(x) for x in yaml.safe_load_all(body) if isinstance(x, dict) or x / 0]

    try:
        want = old()
    except Exception:  # noqa: BLE001
        with pytest.raises(Exception):  # noqa: B017
            text.from_yaml(body)
    else:
        assert text.from_yaml(body) == want


def test_plain_yaml_is_quick():
    import time

    def seconds(f):
        began = time.process_time()
        for _ in range(300):
            f()
        return time.process_time() - began

    import yaml

    for body in PLAIN_AND_ODD[:2]:
        out = text.to_yaml(body, {}, "__record__")
        assert seconds(lambda: text.to_yaml(body, {}, "__record__")) < 0.2 * seconds(lambda: yaml.safe_dump(body))
        assert seconds(lambda: text.from_yaml(out)) < 0.2 * seconds(lambda: yaml.safe_load(out))


def test_rows_of_one_scan_are_written_by_several_tasks(spark, tmp_path):
    record = RecordType("Row", 1, {"k": int, "s": str}, register=False)
    spark.range(0, 100_000, 1, 1).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s")).write.parquet(f"{tmp_path}/rows")
    for fmt in ("yaml", "toml"):
        formats.save(spark.read.parquet(f"{tmp_path}/rows").coalesce(1), record, f"{tmp_path}/{fmt}", format=fmt)
        assert len(list((tmp_path / fmt).glob("part-*"))) > 1
        got = formats.load(spark, record, f"{tmp_path}/{fmt}", format=fmt)
        assert got.agg(F.count("*"), F.countDistinct("k"), F.sum("k")).first() == (100_000, 100_000, 4_999_950_000)


@pytest.mark.parametrize("fmt", ["json", "yaml", "toml"])
def test_arrays_are_opened_once(spark, tmp_path, fmt):
    record = RecordType("Wave", 1, {"n": int, "a": NdArray("float64")}, register=False)
    rows = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("n"), F.struct(F.lit("float64").alias("dtype"), F.array(F.lit(3)).alias("shape"), F.array(F.col("id") + 0.5, F.lit(float("nan")), F.lit(-2.0)).alias("data")).alias("a")
    )
    formats.save(rows, record, f"{tmp_path}/x", format=fmt, mark_arrays=True)
    got = formats.load(spark, record, f"{tmp_path}/x", format=fmt)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    x = F.col("a.data")
    assert got.filter((x[0] == F.col("n") + 0.5) & F.isnan(x[1]) & (x[2] == -2) & (F.col("a.shape")[0] == 3)).agg(F.count("*"), F.countDistinct("n")).first() == (3000, 3000)


def test_pieces_hold_each_text_once():
    import pandas as pd

    n = formats.PIECE
    for sizes in ([], [0], [n + 5], [1, n, 1, n - 1, 1, 2 * n, 0, 0, None, 3]):
        texts = pd.Series([None if k is None else "x" * k for k in sizes], dtype=object)
        found = list(formats._pieces(texts))
        assert [v for p in found for v in p] == list(texts)
        assert all(len(p) == 1 or sum(len(v or "") for v in p) <= n for p in found)
