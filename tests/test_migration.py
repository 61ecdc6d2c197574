"""Each edit on typed columns and on VARIANT documents, chains, gates and errors."""

import json

import pytest
from pyspark.sql import functions as F

from vframe.errors import MigrationError, UnknownFieldError, UpgradeRequiredError, VersionError
from vframe.plans.migration import Migration, migration
from vframe.plans.record import RecordType


def rec(version, fields, steps=None, defaults=None, **options):
    return RecordType("R", version, fields, defaults, migrations=steps, register=False, **options)


def typed(spark, record, row, **options):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1).select(F.lit(1).alias("_none"))
    layouts = None if row else {1: []}
    return record.migrate(df, 1, layouts=layouts, **options).first().asDict()


def variant(spark, record, row, version=1, **options):
    doc = dict(row, __record__={"object": "R", "version": version})
    df = spark.createDataFrame([(json.dumps(doc),)], ["j"]).select(F.parse_json("j").alias("doc"))
    return record.load_variant(df, **options).first().asDict()


UNIT = {"amount": lambda c: F.regexp_extract(c, r"([0-9.]+)", 1), "unit": lambda c: F.regexp_extract(c, "([a-z]+)$", 1)}

CASES = {
    "rename": (Migration().rename("sku", "item"), {"sku": "B-7"}, {"item": str}, {"item": "B-7"}),
    "rename takes the place of another": (Migration().rename("net", "total"), {"net": 310, "total": 372}, {"total": int}, {"total": 310}),
    "rename what is absent": (Migration().rename("sku", "item"), {"item": "C-1"}, {"item": str}, {"item": "C-1"}),
    "add": (Migration().add("currency", default="EUR"), {"total": 12}, {"total": int, "currency": str}, {"total": 12, "currency": "EUR"}),
    "add leaves what is there": (Migration().add("currency", default="EUR"), {"currency": "SEK"}, {"currency": str}, {"currency": "SEK"}),
    "add of a factory": (Migration().add("notes", default=list), {"total": 3}, {"total": int, "notes": list[str]}, {"total": 3, "notes": []}),
    "drop": (Migration().drop("cache"), {"cache": "x", "total": 9}, {"total": int}, {"total": 9}),
    "drop what is absent": (Migration().drop("cache").drop("lock"), {"total": 9}, {"total": int}, {"total": 9}),
    "convert": (Migration().convert("weight", via=lambda c: c / 1000), {"weight": 2500.0}, {"weight": float}, {"weight": 2.5}),
    "derive keeps its source": (Migration().derive("gross", from_="net", via=lambda c: c * 12, as_type=int), {"net": 30}, {"net": int, "gross": int}, {"net": 30, "gross": 360}),
    "split": (Migration().split("size", into=UNIT, as_type=str), {"size": "7.5kg"}, {"amount": float, "unit": str}, {"amount": 7.5, "unit": "kg"}),
    "merge": (Migration().merge(["lat", "lon"], into="place", via=lambda *c: F.concat_ws(",", *c), as_type=str), {"lat": "48.1", "lon": "11.6"}, {"place": str}, {"place": "48.1,11.6"}),
    "merge of what there is": (Migration().merge(["street", "floor", "door"], into="address", via=lambda *c: F.concat_ws(" / ", *c), as_type=str), {"street": "Quay 3", "door": "4b"}, {"address": str}, {"address": "Quay 3 / 4b"}),
    "edits in a row": (Migration().rename("qty", "count").convert("count", via=lambda c: c * 6).derive("dozens", from_="count", via=lambda c: F.floor(c / 12), as_type=int), {"qty": 4}, {"count": int, "dozens": int}, {"count": 24, "dozens": 2}),
    "one step then another": (Migration().drop("b").then(Migration().rename("a", "b")).then(Migration().add("a", default=0)), {"a": 8, "b": 1}, {"a": int, "b": int}, {"a": 0, "b": 8}),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("how", [typed, variant])
def test_edit(spark, name, how):
    step, row, fields, want = CASES[name]
    assert how(spark, rec(2, fields, {1: step}), row) == want


def test_null_is_present(spark):
    r = rec(2, {"k": int}, {1: Migration().add("k", default=7)})
    assert variant(spark, r, {"k": None}) == {"k": None}
    assert variant(spark, r, {}) == {"k": 7}


def test_stored_null_of_a_struct(spark):
    inner = rec(2, {"k": int, "m": int}, {1: Migration().add("k", default=7).add("m", default=8)})
    outer = RecordType("Outer", 1, {"x": inner}, register=False)
    df = spark.sql("SELECT named_struct('_v', 1, 'k', cast(null AS bigint)) AS x")
    assert outer.migrate(df, 1).select("x.*").first().asDict() == {"k": None, "m": 8}


def test_sensor_of_four_versions(spark):
    steps = {
        1: Migration().rename("celsius", "kelvin").convert("kelvin", via=lambda c: c + 273),
        2: Migration().split("site", into={"building": lambda c: F.split(c, ":")[0], "room": lambda c: F.split(c, ":")[1]}, as_type=str).drop("firmware"),
        3: Migration().add("offset", default=-3).derive("corrected", from_="kelvin", via=lambda c: c - 3, as_type=int),
    }
    r = rec(4, {"building": str, "room": int, "kelvin": int, "corrected": int, "offset": int}, steps)
    want = {"building": "N", "room": 12, "kelvin": 300, "corrected": 297, "offset": -3}
    assert variant(spark, r, {"celsius": 27, "site": "N:12", "firmware": "a"}, 1) == want
    assert variant(spark, r, {"kelvin": 300, "site": "N:12"}, 2) == want
    assert variant(spark, r, {"kelvin": 300, "building": "N", "room": 12}, 3) == want
    assert variant(spark, r, {**want, "offset": None}, 4) == {**want, "offset": None}


def test_imperative(spark):
    @migration(1)
    def shipped(ctx):
        ctx["days"] = F.when(ctx["express"].cast("boolean"), ctx.pop("days").cast("int") - 2).otherwise(7)
        ctx.drop("express")

    assert typed(spark, rec(2, {"days": int}, [shipped]), {"express": True, "days": 5}) == {"days": 3}
    assert variant(spark, rec(2, {"days": int}, [shipped]), {"express": False, "days": 5}) == {"days": 7}


def test_gates(spark):
    r = rec(2, {"x": int}, {1: Migration().requires_upgrade().add("x", default=1)})
    with pytest.raises(UpgradeRequiredError):
        typed(spark, r, {})
    assert typed(spark, r, {}, upgrade=True) == {"x": 1}
    with pytest.raises(VersionError):
        r.migrate(spark.range(1), 3)
    with pytest.raises(Exception, match="newer than 2"):
        variant(spark, r, {"x": 1}, 9)
    with pytest.raises(MigrationError):
        rec(3, {"x": int}, {2: Migration()}).migrate(spark.range(1), 1)


def test_unknown_and_missing(spark):
    r = rec(2, {"x": int}, {1: Migration().drop("gone")}, unknown="error")
    assert variant(spark, r, {"x": 1, "gone": 2}) == {"x": 1}
    with pytest.raises(Exception, match="unknown fields more"):
        variant(spark, r, {"x": 1, "more": 2})
    doc = spark.range(1).select(F.parse_json(F.lit('{"x":1,"y":2,"more":3}')).alias("doc"))
    two = rec(1, {"x": int, "y": int}, unknown="error")
    for read in (lambda df: df.count(), lambda df: df.select("y").collect()):
        with pytest.raises(Exception, match="unknown fields more"):
            read(two.load_variant(doc))
    with pytest.raises(UnknownFieldError):
        typed(spark, r, {"x": 1, "more": 2})
    with pytest.raises(Exception, match="R.x is missing"):
        variant(spark, rec(1, {"x": int}), {})


def test_one_projection(spark):
    r = rec(3, {"c": int}, {1: Migration().rename("a", "b").add("z", default=1), 2: Migration().rename("b", "c").drop("z")})
    plan = r.migrate(spark.createDataFrame([(1, 2)], "a bigint, other bigint"), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "other" not in plan.splitlines()[0]
