"""One query for each operator over the driver's tables, each with its SQL.

Tables act as documents of one record type; where versions are mixed, a
row's version is made from its key.
"""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import pathlib
import re
import typing
import uuid
import warnings
from collections.abc import Callable
from typing import Any, Literal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.errors import BackendError
from vframe.functions import codecs
from vframe.functions.types import NdArray
from vframe.operators import arrays, graph, policy
from vframe.plans import nested
from vframe.plans.migration import Context, Migration, migration
from vframe.plans.record import RecordType, fingerprint, registered
from vframe.sources import envelope as env
from vframe.sources import formats, text
from vframe.sources.scratch import folder
from vframe.streaming.session import Session, append_stream, last_values

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLES[fn.__name__] = " ".join(sql.split())
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _record(version: int, fields: dict[str, Any], migrations: dict | None = None, defaults: dict | None = None, **options: Any) -> RecordType:
    return RecordType(options.pop("name", "Row"), version, fields, defaults, migrations=migrations, register=False, **options)


# migrations


@query("SELECT c_custkey AS custkey, c_name AS name, cast(c_nationkey AS bigint) AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer")
def migrate_rename(spark, d):
    m = Migration().rename("c_custkey", "custkey").rename("c_name", "name").rename("c_nationkey", "nationkey").rename("c_acctbal", "acctbal").rename("c_mktsegment", "segment")
    r = _record(2, {"custkey": int, "name": str, "nationkey": int, "acctbal": float, "segment": str}, {1: m})
    return r.migrate(_t(spark, d, "customer"), 1)


@query("SELECT p_partkey, p_name AS p_brand FROM part")
def migrate_rename_collision(spark, d):
    r = _record(2, {"p_partkey": int, "p_brand": str}, {1: Migration().rename("p_name", "p_brand")})
    return r.migrate(_t(spark, d, "part"), 1)


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE cast(s_nationkey AS bigint) END AS rating FROM supplier")
def migrate_add(spark, d):
    df = _t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("rating"), (F.col("s_suppkey") % 2 + 1).alias("_v"))
    r = _record(2, {"s_suppkey": int, "s_name": str, "rating": int}, {1: Migration().add("rating", default=5)})
    return r.migrate(df, "_v", layouts={1: ["s_suppkey", "s_name"]})


def _event_docs(spark, d) -> DataFrame:
    """Events as documents: k is null, absent or there in turn."""
    e, k = _t(spark, d, "events"), F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 3 == 0, F.lit(',"k":null')).when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(',"k":'), k))
    return e.select(F.parse_json(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), body, F.lit(',"__record__":{"object":"Event","version":1}}'))).alias("doc"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE cast(json_extract(props, '$.k') AS bigint) END AS k FROM events")
def migrate_add_null_present(spark, d):
    return _record(2, {"id": int, "k": int}, {1: Migration().add("k", default=7)}, name="Event").load_variant(_event_docs(spark, d))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def migrate_drop(spark, d):
    r = _record(2, {"o_orderkey": int, "o_orderstatus": str}, {1: Migration().drop("o_totalprice").drop("o_comment")}, unknown="error")
    return r.migrate(_t(spark, d, "orders"), 1, layouts={1: ["o_orderkey", "o_orderstatus", "o_totalprice"]})


@query("SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS o_totalprice FROM orders")
def migrate_convert(spark, d):
    r = _record(2, {"o_orderkey": int, "o_totalprice": int}, {1: Migration().convert("o_totalprice", via=lambda c: F.floor(c))})
    return r.migrate(_t(spark, d, "orders"), 1)


@query("SELECT o_orderkey, cast(year(o_orderdate) AS bigint) AS o_year FROM orders")
def migrate_derive(spark, d):
    r = _record(2, {"o_orderkey": int, "o_year": int}, {1: Migration().derive("o_year", from_="o_orderdate", via=F.year)})
    return r.migrate(_t(spark, d, "orders"), 1)


@query("SELECT o_orderkey, cast(split_part(o_orderpriority, '-', 1) AS bigint) AS rank, substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS label FROM orders")
def migrate_split(spark, d):
    into = {"rank": lambda c: F.split(c, "-", 2)[0], "label": lambda c: F.split(c, "-", 2)[1]}
    r = _record(2, {"o_orderkey": int, "rank": int, "label": str}, {1: Migration().split("o_orderpriority", into=into)})
    return r.migrate(_t(spark, d, "orders"), 1)


@query("SELECT cast(n_nationkey AS bigint) AS n_nationkey, n_name || '/' || r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def migrate_merge(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    r = _record(2, {"n_nationkey": int, "place": str}, {1: Migration().merge(["n_name", "r_name", "absent"], into="place", via=lambda *c: F.concat_ws("/", *c))})
    return r.migrate(both, 1)


ORDER_STEPS = {
    1: Migration().rename("o_orderkey", "id").rename("o_custkey", "customer"),
    2: Migration().convert("o_totalprice", via=lambda c: F.floor(c)).rename("o_totalprice", "price").drop("o_orderstatus"),
    3: Migration().split("o_orderpriority", into={"rank": lambda c: F.split(c, "-", 2)[0], "label": lambda c: F.split(c, "-", 2)[1]}).add("currency", default="USD"),
}


@query(
    """SELECT o_orderkey AS id, o_custkey AS customer, cast(floor(o_totalprice) AS bigint) AS price, cast(split_part(o_orderpriority, '-', 1) AS bigint) AS rank,
    substr(o_orderpriority, instr(o_orderpriority, '-') + 1) AS label, 'USD' AS currency FROM orders"""
)
def migrate_chain_mixed(spark, d):
    """Orders of versions 1 to 3 in one table, each by its own chain, in one projection."""
    o = _t(spark, d, "orders")
    v = (F.col("o_orderkey") % 3 + 1).cast("int")
    df = o.select(*o.columns, F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.floor("o_totalprice").alias("price"), v.alias("_v"))
    first = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    layouts = {1: first, 2: ["id", "customer", *first[2:]], 3: ["id", "customer", "price", "o_orderpriority"]}
    r = _record(4, {"id": int, "customer": int, "price": int, "rank": int, "label": str, "currency": str}, ORDER_STEPS, name="Order")
    return r.migrate(df, "_v", layouts=layouts)


@query("SELECT c_custkey AS id, upper(c_name) AS title FROM customer")
def migrate_then(spark, d):
    m = Migration().rename("c_custkey", "id").then(Migration().rename("c_name", "name").rename("name", "title")).then(Migration().convert("title", via=F.upper))
    return _record(2, {"id": int, "title": str}, {1: m}).migrate(_t(spark, d, "customer"), 1)


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN value * 100 ELSE value END AS value FROM events")
def migrate_imperative(spark, d):
    @migration(1)
    def cents(ctx: Context) -> None:
        ctx["value"] = F.when(ctx["event_type"] == "purchase", ctx["value"] * 100).otherwise(ctx["value"])
        ctx.drop("event_type")

    return _record(2, {"event_id": int, "value": float}, [cents]).migrate(_t(spark, d, "events"), 1)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE cast(floor(o_totalprice) AS bigint) END AS price FROM orders")
def migrate_upgrade_gate(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("price"), (F.col("o_orderkey") % 2 + 1).alias("_v"))
    r = _record(3, {"id": int, "price": int}, {1: Migration().add("price", default=0).requires_upgrade(), 2: Migration()})
    return r.migrate(o, "_v", layouts={1: ["id"]}, upgrade=True)


# nested values


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, cast(0 AS bigint) AS rank FROM customer")
def nested_struct(spark, d):
    profile = _record(3, {"name": str, "segment": str, "rank": int}, {1: Migration().rename("title", "name"), 2: Migration().add("rank", default=0)}, name="Profile")
    old = F.struct(F.struct(F.lit("Profile").alias("object"), F.lit(1).alias("version"), F.lit("").alias("hash")).alias("_env"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    df = _t(spark, d, "customer").select("c_custkey", old.alias("profile"))
    r = _record(1, {"c_custkey": int, "profile": profile}, name="Customer")
    return r.migrate(df, 1).select("c_custkey", "profile.*")


def _lines(spark, d) -> DataFrame:
    """Orders with their lines; odd lines are of version 1, which calls the quantity qty."""
    odd = F.col("l_linenumber") % 2 == 1
    line = F.struct(
        F.when(odd, 1).otherwise(2).alias("_v"), F.col("l_linenumber").alias("line"), F.when(odd, F.col("l_quantity")).alias("qty"), F.when(~odd, F.floor("l_quantity")).alias("quantity")
    )
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))


LINE_STEPS = {1: Migration().rename("qty", "quantity").convert("quantity", via=lambda c: F.floor(c).cast("bigint"))}


@query("SELECT l_orderkey, cast(count(*) AS bigint) AS n, cast(sum(cast(trunc(l_quantity) AS bigint)) AS bigint) AS quantity FROM lineitem GROUP BY l_orderkey")
def nested_list(spark, d):
    line = _record(2, {"line": int, "quantity": int}, LINE_STEPS, name="Line")
    df = _lines(spark, d)
    new = nested.migrate_list(F.col("lines"), df.schema["lines"].dataType, line, {1: ["line", "qty"], 2: ["line", "quantity"]})
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + x["quantity"])
    return df.select("l_orderkey", new.alias("lines")).select("l_orderkey", F.size("lines").cast("bigint").alias("n"), total.alias("quantity"))


@query("SELECT l_orderkey, cast(l_linenumber AS bigint) AS line, cast(sum(cast(trunc(l_quantity) AS bigint)) AS bigint) AS quantity FROM lineitem GROUP BY ALL")
def nested_map(spark, d):
    item = _record(2, {"quantity": int}, {1: Migration().rename("qty", "quantity")}, name="Item")
    per = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line")).agg(F.sum(F.floor("l_quantity")).cast("bigint").alias("qty"))
    value = F.struct(F.lit(1).alias("_v"), "qty")
    df = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("line", value.alias("v")))).alias("m"))
    new = nested.migrate_map(F.col("m"), df.schema["m"].dataType, item)
    return df.select("l_orderkey", F.explode(new).alias("line", "v")).select("l_orderkey", "line", "v.quantity")


def _kinds() -> list[RecordType]:
    shown = _record(2, {"amount": float}, {1: Migration().rename("value", "amount")}, name="Shown", old_names=("view", "click"))
    bought = _record(3, {"amount": float, "cents": int}, {1: Migration().rename("value", "amount"), 2: Migration().derive("cents", from_="amount", via=lambda c: F.floor(c * 100))}, name="Bought", old_names=("purchase",))
    other = _record(1, {"value": float}, name="Other", old_names=("signup", "logout", "login", "refund", "search", "error"))
    return [shown, bought, other]


@query(
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'Shown' WHEN event_type = 'purchase' THEN 'Bought' ELSE 'Other' END AS object,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN value END AS amount, CASE WHEN event_type = 'purchase' THEN cast(floor(value * 100) AS bigint) END AS cents,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN value END AS value FROM events"""
)
def poly_dispatch(spark, d):
    df = _t(spark, d, "events").select("event_id", "event_type", F.struct(F.lit(1).alias("_v"), "value").alias("body"))
    made = nested.dispatch(F.col("body"), df.schema["body"].dataType, F.col("event_type"), _kinds())
    return df.select("event_id", made.alias("x")).select("event_id", "x.*")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'Shown' WHEN event_type = 'purchase' THEN 'Bought' ELSE 'Other' END AS object FROM events")
def old_names(spark, d):
    df = _t(spark, d, "events").select("event_id", "event_type", F.struct(F.lit(1).alias("_v"), "value").alias("body"))
    return df.select("event_id", nested.dispatch(F.col("body"), df.schema["body"].dataType, F.col("event_type"), _kinds())["object"].alias("object"))


# envelopes


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS version FROM events")
def missing_envelope(spark, d):
    e = _t(spark, d, "events")
    doc = F.when(F.col("event_id") % 2 == 0, F.lit('{"a":1}')).otherwise(F.lit('{"a":1,"__record__":{"object":"E","version":2}}'))
    return e.select("event_id", policy.assume_version(env.read(F.parse_json(doc), "version"), 3).alias("version"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'New' ELSE 'Old' END AS object, CASE event_id % 3 WHEN 0 THEN 5 ELSE 4 END AS version, 1 AS n_fields FROM events")
def legacy_envelope(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id") % 3
    doc = (
        F.when(k == 0, F.lit('{"a":1,"__OBJECT__":"Old","__VERSION__":4,"__record__":{"object":"New","version":5}}'))
        .when(k == 1, F.lit('{"a":1,"__OBJECT__":"Old","__VERSION__":4}'))
        .otherwise(F.lit('{"a":1,"__record__":{"__OBJECT__":"Old","__VERSION__":4}}'))
    )
    v = F.parse_json(doc)
    return e.select("event_id", env.read(v, "object").alias("object"), env.read(v, "version").alias("version"), F.size(env.field_names(v)).alias("n_fields"))


# formats


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def json_variant(spark, d):
    return _t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def _round_trip(spark, d, name: str, fields: dict[str, Any], fmt: str, **options: Any) -> DataFrame:
    r = _record(1, fields, name=name, **{k: options.pop(k) for k in ("defaults", "skip_defaults") if k in options})
    path = folder(spark, fmt)
    formats.save(r.migrate(_t(spark, d, name), 1), r, path, format=fmt, **options)
    return formats.load(spark, r, path, format=fmt)


@query("SELECT event_id, ts, cast(user_id AS bigint) AS user_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def json_roundtrip(spark, d):
    r = _record(1, {"event_id": int, "ts": dt.datetime, "user_id": int, "event_type": str, "value": float | None}, name="Event")
    path = folder(spark, "json")
    formats.save(_t(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))), r, path, format="json")
    return formats.load(spark, r, path, format="json")


PART = {"p_partkey": int, "p_name": str, "p_brand": str, "p_size": int, "p_retailprice": float}
PART_SQL = "SELECT p_partkey, p_name, p_brand, cast(p_size AS bigint) AS p_size, p_retailprice FROM part"


@query(PART_SQL)
def yaml_roundtrip(spark, d):
    return _round_trip(spark, d, "part", PART, "yaml")


@query(PART_SQL)
def toml_roundtrip(spark, d):
    return _round_trip(spark, d, "part", PART, "toml")


def _written(spark, d, fmt: str, **options: Any) -> DataFrame:
    """The texts of saved parts, one a row: p_partkey and text. Ten is the default of p_size."""
    r = _record(1, {"p_partkey": int, "p_size": int}, name="Part", defaults={"p_size": 10}, **{k: options.pop(k) for k in ("skip_defaults",) if k in options})
    path = folder(spark, fmt)
    formats.save(r.migrate(_t(spark, d, "part"), 1), r, path, format=fmt, **options)
    between = {"json": "\n", "yaml": "---\n", "toml": "# ---\n"}[fmt]
    texts = spark.read.text(path, lineSep=between).filter(F.trim("value") != "")
    return texts.select(F.regexp_extract("value", r"p_partkey\W+(\d+)", 1).cast("bigint").alias("p_partkey"), F.col("value").alias("text"))


@query("SELECT p_partkey, p_size <> 10 AS has_size, p_size <> 10 AS has_it_by_name FROM part")
def skip_defaults(spark, d):
    """Fields at their default are not in the document that is written."""
    size = F.get_json_object("text", "$.p_size").isNotNull()
    return _written(spark, d, "json", skip_defaults=True).select("p_partkey", size.alias("has_size"), F.contains("text", F.lit("p_size")).alias("has_it_by_name"))


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN '# p_size: 10' ELSE 'p_size: ' || p_size END AS line FROM part")
def yaml_comment_defaults(spark, d):
    return _written(spark, d, "yaml", comment_defaults=True).select("p_partkey", F.regexp_extract("text", r"(?m)^.*p_size.*$", 0).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN '# p_size = 10' ELSE 'p_size = ' || p_size END AS line FROM part")
def toml_comment_defaults(spark, d):
    return _written(spark, d, "toml", comment_defaults=True).select("p_partkey", F.regexp_extract("text", r"(?m)^.*p_size.*$", 0).alias("line"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS is_nan, p_partkey % 3 = 1 AS is_infinite, CASE WHEN p_partkey % 3 = 2 THEN p_retailprice END AS price FROM part")
def text_not_finite(spark, d):
    """Doubles that are no number or not finite, through YAML."""
    value = F.when(F.col("p_partkey") % 3 == 0, float("nan")).when(F.col("p_partkey") % 3 == 1, float("-inf")).otherwise(F.col("p_retailprice"))
    r, path = _record(1, {"p_partkey": int, "price": float}, name="Priced"), folder(spark, "nan")
    formats.save(_t(spark, d, "part").select("p_partkey", value.alias("price")), r, path, format="yaml")
    x = F.col("price")
    return formats.load(spark, r, path, format="yaml").select("p_partkey", F.isnan(x).alias("is_nan"), (x == float("-inf")).alias("is_infinite"), F.when(~F.isnan(x) & (x > 0), x).alias("price"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def parquet_roundtrip(spark, d):
    return _round_trip(spark, d, "orders", {"o_orderkey": int, "o_totalprice": float, "o_orderdate": dt.datetime}, "parquet", compression=formats.ZSTD_BEST)


@query("SELECT CASE WHEN event_type = 'purchase' THEN 'Bought' ELSE 'Seen' END AS object, count(*) AS n FROM events GROUP BY ALL")
def load_dynamic(spark, d):
    path = folder(spark, "dynamic")
    e = _t(spark, d, "events")
    for name, part in (("Bought", e.filter("event_type = 'purchase'")), ("Seen", e.filter("event_type <> 'purchase'"))):
        r = RecordType(name, 1, {"event_id": int, "value": float})
        formats.save(r.migrate(part, 1), r, path, format="parquet", mode="append")
    out = None
    for name, df in sorted(formats.load_dynamic(spark, path, format="parquet").items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("object"), "n").filter("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


# pruning and arrays


@query("SELECT vec_id, cast(label AS bigint) AS label FROM embeddings")
def select_preload(spark, d):
    r = _record(1, {"vec_id": int, "label": int, "embedding": NdArray("float32")}, defaults={"embedding": None})
    df = _t(spark, d, "embeddings")
    return r.migrate(df, 1, layouts={1: ["vec_id", "label"]}).select(*formats.selected(r, None, metadata_only=True))


def _chunked(spark, d, rows: int = 16) -> DataFrame:
    """The embeddings as a stored chunk table."""
    path = folder(spark, "chunks")
    arrays.to_chunks(_t(spark, d, "embeddings").filter(F.col("embedding").isNotNull()), "vec_id", "embedding", rows, "float32").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT vec_id AS doc_id, cast(embedding[19] AS double) AS first, cast(embedding[30] AS double) AS last, len(embedding[19:30]) AS n FROM embeddings")
def array_slice(spark, d):
    got = arrays.read_slice(_chunked(spark, d), 18, 30, 16)
    return got.select("doc_id", F.get("vals", F.lit(0)).cast("double").alias("first"), F.get("vals", F.lit(11)).cast("double").alias("last"), F.size("vals").cast("bigint").alias("n"))


@query("SELECT vec_id, cast(embedding[4] AS double) AS fourth, cast(embedding[len(embedding)] AS double) AS last, len(embedding[5:8]) AS n FROM embeddings")
def array_list_access(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", arrays.element(e, 3).cast("double").alias("fourth"), arrays.element(e, -1).cast("double").alias("last"), F.size(F.slice(e, 5, 4)).cast("bigint").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, bool_or(l_linenumber = 1) AS has_first FROM lineitem GROUP BY l_orderkey")
def array_dict_access(spark, d):
    per = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    m = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "part"))).alias("m"))
    return m.select("l_orderkey", F.size(F.map_keys("m")).cast("bigint").alias("n"), F.map_contains_key("m", 1).alias("has_first"))


@query("SELECT vec_id AS doc_id, len(embedding) + 2 AS n, cast(embedding[1] AS double) AS first, CAST(2 AS double) AS last FROM embeddings")
def array_append(spark, d):
    chunks = _chunked(spark, d)
    more = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vals"))
    whole = arrays.joined(chunks.unionByName(arrays.append(chunks, more, "embedding", 16, "float32")))
    return whole.select("doc_id", F.size("vals").cast("bigint").alias("n"), F.get("vals", F.lit(0)).cast("double").alias("first"), arrays.element(F.col("vals"), -1).cast("double").alias("last"))


@query("SELECT vec_id AS doc_id, cast(20 AS bigint) AS cut, cast(embedding[20] AS double) AS last_cut, cast(70 AS bigint) AS grown, cast(0 AS double) AS last_grown FROM embeddings")
def array_resize(spark, d):
    chunks = _chunked(spark, d)
    cut, grown = (arrays.joined(arrays.resize(chunks, n, 16)) for n in (20, 70))
    last = arrays.element(F.col("vals"), -1).cast("double")
    a = cut.select("doc_id", F.size("vals").cast("bigint").alias("cut"), last.alias("last_cut"))
    return a.join(grown.select("doc_id", F.size("vals").cast("bigint").alias("grown"), last.alias("last_grown")), "doc_id")


@query("SELECT vec_id AS doc_id, cast(embedding[17] AS double) AS before, cast(9 AS double) AS changed, cast(embedding[21] AS double) AS after FROM embeddings")
def array_update(spark, d):
    chunks = _chunked(spark, d)
    new = arrays.update(chunks, 17, 20, F.lit(9.0), 16)
    whole = arrays.joined(chunks.join(new.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_anti").unionByName(new.select(chunks.columns)))
    at = lambda i, n: F.get("vals", F.lit(i)).cast("double").alias(n)
    return whole.select("doc_id", at(16, "before"), at(18, "changed"), at(20, "after"))


ARRAY_SQL = "SELECT vec_id, cast(embedding[2] AS double) AS second, cast(embedding[len(embedding)] AS double) AS last, len(embedding) AS n FROM embeddings"


def _text_arrays(spark, d, fmt: str) -> DataFrame:
    """Embeddings as marked archives in text documents, read back."""
    r, path = _record(1, {"vec_id": int, "embedding": NdArray("float32")}, name="Vector"), folder(spark, fmt)
    e = F.col("embedding")
    array = F.struct(F.lit("float32").alias("dtype"), F.array(F.size(e)).alias("shape"), e.alias("data"))
    formats.save(_t(spark, d, "embeddings").filter(e.isNotNull()).select("vec_id", array.alias("embedding")), r, path, format=fmt, mark_arrays=True)
    data = F.col("embedding.data")
    return formats.load(spark, r, path, format=fmt).select("vec_id", F.get(data, F.lit(1)).cast("double").alias("second"), arrays.element(data, -1).cast("double").alias("last"), F.get("embedding.shape", F.lit(0)).cast("bigint").alias("n"))


@query(ARRAY_SQL)
def json_ndarray(spark, d):
    return _text_arrays(spark, d, "json")


@query(ARRAY_SQL)
def yaml_ndarray(spark, d):
    return _text_arrays(spark, d, "yaml")


@query(
    """SELECT vec_id AS doc_id, list_transform(list_concat(embedding, [1.5, 2.5, 3.5, 4.5, 5.5])[len(embedding) - 1 : len(embedding) + 4], lambda x: cast(x AS double)) AS slice,
    list_transform(list_concat(embedding[1 : len(embedding) - 1], [9, 9, 9, 3.5, 4.5, 5.5])[len(embedding) - 2 :], lambda x: cast(x AS double)) AS updated FROM embeddings"""
)
def array_append_slice(spark, d):
    """Two appends, which leave short chunks behind, then a slice and an update over them."""
    chunks = _chunked(spark, d)
    n = _t(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    for more in ((1.5,), (2.5, 3.5, 4.5, 5.5)):
        ids = _t(spark, d, "embeddings").filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("doc_id"), F.array(*map(F.lit, more)).cast("array<float>").alias("vals"))
        chunks = chunks.unionByName(arrays.append(chunks, ids, "embedding", 16, "float32"))
    new = arrays.update(chunks, n - 1, n + 2, F.lit(9.0), 16)
    after = chunks.join(new.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_anti").unionByName(new.select(chunks.columns))
    doubles = F.col("vals").cast("array<double>")
    part = arrays.read_slice(chunks, n - 2, n + 4, 16).select("doc_id", doubles.alias("slice"))
    return part.join(arrays.read_slice(after, n - 3, n + 5, 16).select("doc_id", doubles.alias("updated")), "doc_id")


@query(ARRAY_SQL.replace("vec_id, cast", "vec_id AS doc_id, cast"))
def dtype_cast(spark, d):
    """Doubles that a session takes for an array of float32."""
    r, path = _record(1, {"embedding": NdArray("float32")}, name="Held"), folder(spark, "dtype")
    more = _t(spark, d, "embeddings").filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vals"))
    with Session(spark, r, path, chunk_rows=16) as s:
        s.append("embedding", more)
        whole = s.array("embedding")
    e = F.col("vals")
    return whole.select("doc_id", F.get(e, F.lit(1)).cast("double").alias("second"), arrays.element(e, -1).cast("double").alias("last"), F.size(e).cast("bigint").alias("n"))


# codecs


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS iso, ts FROM events")
def codec_datetime(spark, d):
    iso = codecs.encode_timestamp(F.col("ts"))
    return _t(spark, d, "events").select("event_id", iso.alias("iso"), codecs.decode_timestamp(iso).alias("ts"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, cast(o_orderdate AS date) AS day FROM orders")
def codec_date(spark, d):
    iso = codecs.encode_date(F.col("o_orderdate").cast("date"))
    return _t(spark, d, "orders").select("o_orderkey", iso.alias("iso"), iso.cast("date").alias("day"))


@query("SELECT o_orderkey, cast(o_orderkey * 37 + 0.5 AS double) AS seconds FROM orders")
def codec_timedelta(spark, d):
    stored = codecs.decode_interval(F.col("o_orderkey") * 37 + 0.5)
    return _t(spark, d, "orders").select("o_orderkey", codecs.encode_interval(stored).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar) AS cents FROM lineitem")
def codec_decimal(spark, d):
    stored = F.round(F.col("l_extendedprice") * 100).cast("decimal(38,18)")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", codecs.encode(stored, decimal.Decimal).alias("cents"))


@query("SELECT doc_id, base64(encode(text)) AS wire, text FROM documents")
def codec_base64(spark, d):
    wire = codecs.encode_binary(F.encode("text", "UTF-8"))
    return _t(spark, d, "documents").select("doc_id", wire.alias("wire"), F.decode(codecs.decode_binary(wire), "UTF-8").alias("text"))


@query("SELECT vec_id, cast(embedding[1] AS double) AS re, cast(embedding[2] AS double) AS im FROM embeddings")
def codec_complex(spark, d):
    pair = codecs.decode_complex(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")))
    back = codecs.encode_complex(pair)
    return _t(spark, d, "embeddings").select("vec_id", F.get(back, F.lit(0)).alias("re"), F.get(back, F.lit(1)).alias("im"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def set_canonical(spark, d):
    got = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return got.select("user_id", F.array_join(codecs.encode(F.col("kinds"), set[str]), ",").alias("kinds"))


@query("SELECT user_id, cast(event_type AS varchar) AS key, count(*) AS n FROM events GROUP BY user_id, event_type")
def map_keys_cast(spark, d):
    per = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode(codecs.encode(F.col("m"), dict[str, int])).alias("key", "n"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'BIGINT' ELSE 'STRING' END AS kind, CASE WHEN event_id % 2 = 0 THEN cast(event_id AS varchar) ELSE event_type END AS value FROM events")
def union_decode(spark, d):
    """A field of two types: the first that a value reads as."""
    body = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    docs = _t(spark, d, "events").select(F.parse_json(F.to_json(F.struct(F.col("event_id").alias("id"), body.alias("u")))).alias("doc"))
    got = _record(1, {"id": int, "u": int | str}, name="Either").load_variant(docs)
    return got.select("id", F.schema_of_variant("u").alias("kind"), F.variant_get("u", "$", "string").alias("value"))


@query(
    """SELECT p_partkey AS id, printf('%02d:%02d:%02d', p_partkey % 24, p_partkey % 60, p_size % 60) AS at, '/' || p_brand || '/' || p_partkey AS path,
    printf('%08d-0000-4000-8000-%012d', p_partkey, p_partkey) AS uid, '^' || p_brand || '$' AS pattern, p_partkey % 2 = 0 AS flag FROM part"""
)
def codec_text_types(spark, d):
    """Times, paths, unique ids, patterns and Booleans, through JSON."""
    key = F.col("p_partkey")
    rows = _t(spark, d, "part").select(
        key.alias("id"),
        F.format_string("%02d:%02d:%02d", key % 24, key % 60, F.col("p_size") % 60).alias("at"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), key.cast("string")).alias("path"),
        F.format_string("%08d-0000-4000-8000-%012d", key, key).alias("uid"),
        F.concat(F.lit("^"), "p_brand", F.lit("$")).alias("pattern"),
        (key % 2 == 0).alias("flag"),
    )
    r, out = _record(1, {"id": int, "at": dt.time, "path": pathlib.PurePosixPath, "uid": uuid.UUID, "pattern": re.Pattern, "flag": bool}, name="Texts"), folder(spark, "texts")
    formats.save(rows, r, out, format="json")
    return formats.load(spark, r, out, format="json")


class Cents:
    """A type of the user's own: an amount in whole cents."""


codecs.register_converter(Cents, T.LongType(), lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("bigint"), F.pmod(c, F.lit(100))), lambda v: F.round(v.cast("double") * 100).cast("bigint"), wire="string")


@query("SELECT p_partkey, cast(round(p_retailprice * 100) AS bigint) AS price FROM part")
def converter_custom(spark, d):
    r = _record(1, {"p_partkey": int, "price": Cents}, name="Priced")
    path = folder(spark, "cents")
    rows = _t(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"))
    formats.save(rows, r, path, format="json")
    return formats.load(spark, r, path, format="json")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'new' END AS status, o_totalprice AS price FROM orders")
def parquet_mixed_versions(spark, d):
    """A store with files of two versions, read at the later one."""
    path, o = folder(spark, "mixed"), _t(spark, d, "orders")
    old = _record(1, {"key": int, "price": float}, name="Stored")
    new = _record(2, {"id": int, "status": str, "price": float}, {1: Migration().rename("key", "id").add("status", default="new")}, name="Stored")
    formats.save(o.filter("o_orderkey % 2 = 1").selectExpr("o_orderkey AS key", "o_totalprice AS price"), old, path, format="parquet")
    formats.save(o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price"), new, path, format="parquet", mode="append")
    return formats.load(spark, new, path, format="parquet")


STORED_NULL_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE o_custkey END AS k FROM orders"


def _old_orders(spark, d, narrow: RecordType, wide: RecordType, path: str, made: Callable[[RecordType, DataFrame], DataFrame]) -> None:
    """A store of version 1 whose files have a field k, null or not, or have none."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 2, F.col("o_custkey")).alias("k"))
    for part, r in ((o.filter("id % 3 = 0").drop("k"), narrow), (o.filter("id % 3 <> 0"), wide)):
        formats.save(made(r, part), r, path, format="parquet", mode="append")


@query(STORED_NULL_SQL)
def add_null_present_parquet(spark, d):
    """A stored null is present, in a file that has the column."""
    path, step = folder(spark, "nulls"), {1: Migration().add("k", default=7)}
    narrow, wide = (_record(1, f, name="Old") for f in ({"id": int}, {"id": int, "k": int | None}))
    _old_orders(spark, d, narrow, wide, path, lambda r, df: df)
    return formats.load(spark, _record(2, {"id": int, "k": int | None}, step, name="Old"), path, format="parquet")


@query(STORED_NULL_SQL)
def add_null_present_nested(spark, d):
    """The same of records inside a record."""
    path, step = folder(spark, "nulls"), {1: Migration().add("k", default=7)}
    inner = [_record(1, f, name="In") for f in ({"id": int}, {"id": int, "k": int | None})]
    narrow, wide = (_record(1, {"x": r}, name="Out") for r in inner)
    _old_orders(spark, d, narrow, wide, path, lambda r, df: df.select(F.struct(*df.columns).alias("x")))
    new = _record(2, {"id": int, "k": int | None}, step, name="In")
    return formats.load(spark, _record(1, {"x": new}, name="Out"), path, format="parquet").select("x.*")


@query("SELECT c_custkey AS id, upper(c_name) AS name, cast(c_nationkey AS bigint) + 1 AS nation, 'none' AS note FROM customer")
def nested_deep(spark, d):
    """Records in lists in maps in records, each level of an old version."""
    leaf = _record(2, {"nation": int, "note": str}, {1: Migration().convert("nation", via=lambda c: c + 1).add("note", default="none")}, name="Leaf")
    twig = _record(2, {"name": str, "leaves": list[leaf]}, {1: Migration().rename("title", "name").convert("name", via=F.upper)}, name="Twig")
    tree = _record(2, {"id": int, "twigs": dict[str, twig]}, {1: Migration().rename("key", "id")}, name="Tree")
    old = lambda name: F.struct(F.lit(name).alias("object"), F.lit(1).alias("version")).alias("__record__")
    low = F.struct(F.col("c_nationkey").alias("nation"), old("Leaf"))
    mid = F.struct(F.col("c_name").alias("title"), F.array(low).alias("leaves"), old("Twig"))
    doc = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.create_map(F.lit("t"), mid).alias("twigs"), old("Tree")))
    got = tree.load_variant(_t(spark, d, "customer").select(F.parse_json(doc).alias("doc")))
    t = F.element_at("twigs", "t")
    return got.select("id", t["name"].alias("name"), F.inline(t["leaves"]))


@query("SELECT p_name AS key, replace(replace(replace(p_name || '/a.b%', '%', '%25'), '/', '%2F'), '.', '%2E') AS part, p_name || '/a.b%' AS back FROM part")
def key_escapes(spark, d):
    part = graph.key_to_path(F.concat("p_name", F.lit("/a.b%")))
    return _t(spark, d, "part").select(F.col("p_name").alias("key"), part.alias("part"), graph.path_to_key(part).alias("back"))


# policies


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'BUILDING' END AS segment FROM customer")
def literal_fallback(spark, d):
    from typing import Annotated

    kind = Annotated[Literal["BUILDING", "MACHINERY"], policy.Fallback("BUILDING")]
    r = _record(2, {"c_custkey": int, "segment": kind}, {1: Migration().rename("c_mktsegment", "segment")})
    return r.migrate(_t(spark, d, "customer"), 1)


class Status(enum.Enum):
    OPEN = "O"
    FINISHED = "F"
    __fallback__ = "O"


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'O' END AS o_orderstatus FROM orders")
def enum_fallback(spark, d):
    return _record(1, {"o_orderkey": int, "o_orderstatus": Status}).migrate(_t(spark, d, "orders"), 1)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'extra' ELSE '' END AS unknown FROM events")
def unknown_keys(spark, d):
    doc = F.parse_json(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"extra":1,'), F.substr("props", F.lit(2), F.length("props")))).otherwise(F.col("props")))
    return _t(spark, d, "events").select("event_id", F.array_join(policy.unknown_names(env.field_names(doc), ["k"]), ",").alias("unknown"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN cast(event_id AS varchar) END AS kept, event_id % 2 = 0 AS written FROM events")
def unknown_preserve(spark, d):
    """Undeclared fields are kept and written again."""
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("more")))
    r, path = _record(1, {"id": int}, name="Open", unknown="preserve"), folder(spark, "preserve")
    got = r.load_variant(_t(spark, d, "events").select(F.parse_json(doc).alias("doc")))
    formats.save(got, r, path, format="json")
    back = formats.load(spark, r, path, format="json")
    more = F.variant_get(F.try_element_at("_rest", F.lit("more")), "$", "string")
    return back.select("id", more.alias("kept"), more.isNotNull().alias("written"))


def _fails(action: Callable[[], Any], message: str) -> bool:
    try:
        action()
    except Exception as e:  # noqa: BLE001
        return message in str(e)
    return False


@query(
    """SELECT * FROM (VALUES ('unknown, counted', true), ('unknown, another field', true), ('unknown, nested', true), ('unknown, ignored', false), ('newer, counted', true),
    ('newer, typed and counted', true), ('missing', true), ('missing, nested', true), ('literal', true), ('literal, unchecked', false), ('enumeration', true), ('later format', true),
    ('record as key', true), ('no chain', true), ('upgrade', true), ('hash', true), ('name taken', true), ('two steps', true), ('no array of that name', true), ('width', true)) t(what, raised)"""
)
def errors_raised(spark, d):
    """What has to be an error is one, whatever is read of a row; and what is allowed is none."""
    region = _t(spark, d, "region")
    docs = region.select(F.parse_json(F.lit('{"a":1,"u":2,"more":3}')).alias("doc"))
    both = {"a": int, "u": int}
    strict, open_ = (_record(1, both, unknown=u) for u in ("error", "ignore"))
    outer = _record(1, {"x": _record(1, both, unknown="error")})
    inside = region.select(F.parse_json(F.lit('{"x":{"a":1,"u":2,"more":3}}')).alias("doc"))
    newer = region.select(F.parse_json(F.lit('{"a":1,"u":2,"__record__":{"version":9}}')).alias("doc"))
    later = region.select(F.parse_json(F.lit('{"a":1,"u":2,"__record__":{"version":1,"format":9}}')).alias("doc"))
    few = region.select(F.parse_json(F.lit('{"a":1}')).alias("doc"))
    few_inside = region.select(F.parse_json(F.lit('{"x":{"a":1}}')).alias("doc"))
    word = region.select(F.parse_json(F.lit('{"w":"banana"}')).alias("doc"))
    kind = Literal["fast", "slow"]
    gated = _record(2, {"a": int}, {1: Migration().requires_upgrade()})
    RecordType("Taken", 1, {"a": int}, old_names=("TakenBefore",))

    def width():
        return region.select(arrays.checked_width(F.array("r_regionkey"), 2).alias("x")).agg(F.max("x")).collect()

    cases = {
        "unknown, counted": _fails(lambda: strict.load_variant(docs).count(), "unknown fields more"),
        "unknown, another field": _fails(lambda: strict.load_variant(docs).select("u").collect(), "unknown fields more"),
        "unknown, nested": _fails(lambda: outer.load_variant(inside).select("x.u").collect(), "unknown fields more"),
        "unknown, ignored": _fails(lambda: open_.load_variant(docs).collect(), ""),
        "newer, counted": _fails(lambda: open_.load_variant(newer).count(), "newer than 1"),
        "newer, typed and counted": _fails(lambda: open_.migrate(region.select(F.lit(1).alias("a"), F.lit(2).alias("u"), F.lit(9).alias("_v")), "_v").count(), "newer than 1"),
        "missing": _fails(lambda: open_.load_variant(few).collect(), "u is missing"),
        "missing, nested": _fails(lambda: _record(1, {"x": open_}).load_variant(few_inside).collect(), "u is missing"),
        "literal": _fails(lambda: _record(1, {"w": kind}).load_variant(word).collect(), "banana"),
        "literal, unchecked": _fails(lambda: _record(1, {"w": kind}, validate_literals=False).load_variant(word).collect(), ""),
        "enumeration": _fails(lambda: _record(1, {"w": Size}).load_variant(word).collect(), "banana"),
        "later format": _fails(lambda: open_.load_variant(later).collect(), "document format"),
        "record as key": _fails(lambda: _record(1, {"m": dict[open_, int]}), "key of a map"),
        "no chain": _fails(lambda: _record(3, both, {2: Migration()}).migrate(region, 1), "version"),
        "upgrade": _fails(lambda: gated.migrate(region.select(F.lit(1).alias("a")), 1), "upgrade"),
        "hash": _fails(lambda: _record(1, both, hash="000000"), "000000"),
        "name taken": _fails(lambda: RecordType("TakenBefore", 1, {"a": int}), "taken"),
        "two steps": _fails(lambda: RecordType("Twice", 2, {"a": int}, migrations=[migration(1)(lambda c: None), migration(1)(lambda c: None)], register=False), "two migrations"),
        "no array of that name": _fails(lambda: formats.selected(open_, ["absent"], False), "absent"),
        "width": _fails(width, "is not 2"),
    }
    return spark.createDataFrame(list(cases.items()), "what string, raised boolean")


class Size(enum.Enum):
    SMALL = "s"
    LARGE = "l"


# The payloads that fingerprints are made of.
@query(
    """SELECT n, substr(sha256(payload), 1, 6) AS hash FROM (VALUES (0, 'area:float,rooms:int'), (1, 'labels:list[str],owner:Union[None, str]'), (2, 'by:dict[str, int],flags:set[bool]'),
    (3, 'at:datetime.datetime,day:datetime.date'), (4, 'mode:typing.Literal[fast, slow],raw:bytes'), (5, 'pair:tuple[int, str],price:decimal.Decimal')) t(n, payload)"""
)
def fingerprint_hash(spark, d):
    """Fingerprints of record types by their fields' canonical names."""
    fields = (
        {"rooms": int, "area": float}, {"owner": typing.Optional[str], "labels": list[str]}, {"by": dict[str, int], "flags": set[bool]},
        {"day": dt.date, "at": dt.datetime}, {"mode": Literal["fast", "slow"], "raw": bytes}, {"price": decimal.Decimal, "pair": tuple[int, str]},
    )
    return spark.createDataFrame([(i, fingerprint(f)) for i, f in enumerate(fields)], "n int, hash string")


@query("SELECT name, loaded FROM (VALUES ('none', 'vec_id,label,embedding'), ('metadata', 'vec_id,label'), ('by name', 'vec_id,label,embedding'), ('no array', 'vec_id,label')) t(name, loaded)")
def preload_names(spark, d):
    """The columns of a load by what is asked for."""
    r, path = _record(1, {"vec_id": int, "label": int, "embedding": NdArray("float32")}, name="Vec"), folder(spark, "vec")
    e = F.struct(F.lit("float32").alias("dtype"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("data"))
    formats.save(_t(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), e.alias("embedding")), r, path, format="parquet")
    asked = {"none": {}, "metadata": {"metadata_only": True}, "by name": {"preload": ["embedding"]}, "no array": {"preload": []}}
    return spark.createDataFrame([(n, ",".join(formats.load(spark, r, path, format="parquet", **o).columns)) for n, o in asked.items()], "name string, loaded string")


class Percent:
    """A type with the value protocol: it is stored as a share and written with its sign."""

    stored = T.DoubleType()
    to_value = staticmethod(lambda c: F.concat(F.round(c * 100, 2).cast("string"), F.lit("%")))
    from_value = staticmethod(lambda v: F.rtrim(v.cast("string"), F.lit("%")).cast("double") / 100)


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(l_discount, 4) AS discount FROM lineitem")
def value_protocol(spark, d):
    wire = codecs.encode(F.col("l_discount"), Percent)
    back = codecs.converter_for(Percent).decode(wire)
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(back, 4).alias("discount"))


@query("SELECT r_regionkey AS id, r_name AS name, r_regionkey % 2 = 0 AS flag FROM region")
def marked_json(spark, d):
    """Values that a text format holds as marked JSON, of either mark, opened by the reader."""
    inner = F.to_json(F.struct(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("flag")))
    mark = F.when(F.col("r_regionkey") % 2 == 0, F.lit(text.JSON_MARKS[0])).otherwise(F.lit(text.JSON_MARKS[1]))
    quoted = F.replace(F.replace(inner, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    doc = F.concat(F.lit("---\nid: "), F.col("r_regionkey").cast("string"), F.lit("\nx:\n  "), mark, F.lit(': "'), quoted, F.lit('"\n'))
    path = folder(spark, "yaml")
    _t(spark, d, "region").select(doc.alias("value")).write.text(path)
    r = _record(1, {"id": int, "x": _record(1, {"name": str, "flag": bool})})
    return formats.load(spark, r, path, format="yaml").select(F.col("id").cast("int").alias("id"), "x.*")


@query("SELECT cast(n_nationkey AS bigint) AS n_nationkey, n_name FROM nation")
def data_source(spark, d):
    """Documents through ``spark.read.format("vframe")``."""
    from vframe.sources import datasource

    r, path = _record(1, {"n_nationkey": int, "n_name": str}, name="Nation"), folder(spark, "source")
    formats.save(r.migrate(_t(spark, d, "nation"), 1), r, path, format="yaml")
    datasource.register(spark)
    docs = spark.read.format("vframe").option("type", "yaml").load(path)
    return r.load_variant(docs.select(F.parse_json("doc").alias("doc")))


@query(
    """SELECT * FROM (VALUES ('a.json', 'json'), ('b.JSONL', 'jsonl'), ('c.yml', 'yaml'), ('d.YAML', 'yaml'), ('e.toml', 'toml'), ('f.parquet/', 'parquet'), ('s3://x/y.z/g.yaml', 'yaml'),
    ('h.txt as toml', 'toml'), ('i.h5', 'none'), ('j.csv', 'none'), ('k', 'none')) t(path, format)"""
)
def format_suffixes(spark, d):
    """The format of a path by its suffix, or as told; none where there is no reader."""

    def of(path: str) -> str:
        place, _, told = path.partition(" as ")
        try:
            return formats.format_for(place, told or None).name
        except BackendError:
            return "none"

    paths = ("a.json", "b.JSONL", "c.yml", "d.YAML", "e.toml", "f.parquet/", "s3://x/y.z/g.yaml", "h.txt as toml", "i.h5", "j.csv", "k")
    return spark.createDataFrame([(p, of(p)) for p in paths], "path string, format string")


@query(
    """SELECT * FROM (VALUES ('name', 'Seen'), ('version', '3'), ('old names', 'Old,Older'), ('fields', 'id,at,data'), ('lazy', 'data'), ('first version', '1'), ('is a', 'true'),
    ('is no', 'false'), ('registered', 'true'), ('steps from 1', '2'), ('ops', 'Rename,Add,RequiresUpgrade'), ('hash', '%s'), ('schema', 'id:bigint,at:timestamp_ntz,data:struct')) t(what, value)"""
    % fingerprint({"id": int, "at": dt.datetime, "data": NdArray("float32")})
)
def introspection(spark, d):
    """What a record type tells of itself."""
    base = _record(1, {"id": int}, name="Base")
    steps = {1: Migration().rename("key", "id").add("at", default=None).requires_upgrade(), 2: Migration()}
    r = RecordType("Seen", 3, {"at": dt.datetime, "data": NdArray("float32")}, base=base, old_names=("Old", "Older"), migrations=steps)
    meta = r.metadata()
    found = {
        "name": meta["name"], "version": meta["version"], "old names": ",".join(meta["old_names"]), "fields": ",".join(r.fields), "lazy": ",".join(r.arrays()), "first version": r.first_version(),
        "is a": r.is_a(base), "is no": base.is_a(r), "registered": registered()["Older"] is r, "steps from 1": len(r.steps(1)), "ops": ",".join(type(o).__name__ for o in steps[1].ops), "hash": meta["hash"],
        "schema": ",".join(f"{f.name}:{f.dataType.simpleString().split('<')[0]}" for f in r.struct().fields),
    }
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in found.items()], "what string, value string")


# sessions


def _session_record() -> RecordType:
    return _record(1, {"title": str, "limit": int, "tags": list[str], "by": dict[str, int], "data": NdArray("float64")}, name="Ledger", defaults={"limit": 5})


@query(
    """SELECT 'title' AS field, NULL AS key, NULL AS idx, '"' || (SELECT max(r_name) FROM region) || '"' AS value UNION ALL SELECT 'limit', NULL, NULL, '8'
    UNION ALL SELECT 'tags', NULL, r_regionkey, CASE WHEN r_regionkey = 1 THEN '"changed"' ELSE '"' || r_name || '"' END FROM region UNION ALL SELECT 'tags', NULL, 5, '"more"'
    UNION ALL SELECT 'by', r_name, NULL, cast(r_regionkey * 10 AS varchar) FROM region WHERE r_regionkey <> 2"""
)
def session_state(spark, d):
    """Scalars, a list and a map of a session that is closed and taken up again."""
    r, path = _session_record(), folder(spark, "session")
    rows = _t(spark, d, "region").orderBy("r_regionkey").collect()  # five
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with Session(spark, r, path) as s:
            s.set("title", "first")
            s.set("limit", 8)
            s.list("tags").extend(x["r_name"] for x in rows)
            s.map("by").update({x["r_name"]: x["r_regionkey"] for x in rows})
        with Session(spark, r, path, mode="resume") as s:
            s.set("title", max(x["r_name"] for x in rows))
            tags, by = s.list("tags"), s.map("by")
            tags[1] = "changed"
            tags.append("more")
            by.update({x["r_name"]: x["r_regionkey"] * 10 for x in rows})
            del by[rows[2]["r_name"]]
        with Session(spark, r, path, mode="read") as s:
            return s.state().select("field", "key", F.col("idx").cast("int").alias("idx"), "value")


@query("SELECT vec_id AS doc_id, list_transform(list_concat(embedding, embedding[1:3]), lambda x: cast(x AS double)) AS vals FROM embeddings")
def session_append(spark, d):
    """Arrays that a session appends to, before and after it is taken up again."""
    r, path = _session_record(), folder(spark, "session")
    e = _t(spark, d, "embeddings").filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vals"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with Session(spark, r, path, chunk_rows=16) as s:
            s.append("data", e)
        with Session(spark, r, path, mode="resume", chunk_rows=16) as s:
            s.append("data", e.withColumn("vals", F.slice("vals", 1, 3)))
            return s.array("data")


@query(
    """SELECT r_regionkey * 2 AS pos, cast(r_regionkey AS bigint) AS a, cast(length(r_name) AS bigint) AS b FROM region
    UNION ALL SELECT r_regionkey * 2 + 1, r_regionkey * 10, length(r_name) FROM region"""
)
def session_axes(spark, d):
    """An array of two axes that grows along the second, filled from an instance and by sessions that took it up again."""
    r, path = _record(1, {"title": str, "grid": NdArray("int64")}, name="Grid"), folder(spark, "session")
    rows = _t(spark, d, "region").orderBy("r_regionkey").collect()  # five
    pairs = [np.array([[x["r_regionkey"], x["r_regionkey"] * 10], [len(x["r_name"])] * 2]) for x in rows]
    with Session(spark, r, path, axis={"grid": 1}, chunk_rows=3) as s:
        s.populate({"title": "g", "grid": pairs[0]})
    for one in pairs[1:]:
        with Session(spark, r, path, mode="resume", chunk_rows=3) as s:
            s.append("grid", one)
    with Session(spark, r, path, mode="read") as s:
        flat = s.chunks("grid").select("start", F.posexplode("vals").alias("i", "v"))
    at = (F.col("start") + F.floor(F.col("i") / 2)).cast("int")
    each = flat.groupBy(at.alias("pos")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("b"))
    return each.select("pos", "a", "b")


@query(
    """SELECT * FROM (VALUES ('created twice', true), ('resumed, none there', true), ('resumed, another version', true), ('resumed, the same', false), ('written while read', true),
    ('written when closed', true), ('overwritten', false), ('unknown field', true), ('list shrinks', true), ('list by slice', true), ('warns of what is not set', true)) t(what, raised)"""
)
def session_modes(spark, d):
    r, path, other = _session_record(), folder(spark, "session"), _record(2, _session_record().fields, name="Ledger")

    def opened(mode: str, record: RecordType = r, place: str = path, then: Callable[[Session], Any] = lambda s: s.set("title", "t")) -> Any:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            with Session(spark, record, place, mode=mode) as s:
                then(s)
        return s

    closed = opened("create")

    def slice_(s: Session) -> None:
        s.list("tags")[0:1] = ["x"]

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        with Session(spark, r, folder(spark, "session")) as s:
            s.set("title", "t")
    cases = {
        "created twice": _fails(lambda: opened("create"), "already exists"),
        "resumed, none there": _fails(lambda: opened("resume", place=f"{path}-none"), "no session"),
        "resumed, another version": _fails(lambda: opened("resume", other), "not migrated"),
        "resumed, the same": _fails(lambda: opened("resume"), ""),
        "written while read": _fails(lambda: opened("read"), "reading only"),
        "written when closed": _fails(lambda: closed.set("title", "x"), "closed"),
        "overwritten": _fails(lambda: opened("overwrite"), ""),
        "unknown field": _fails(lambda: opened("resume", then=lambda s: s.set("absent", 1)), "no field absent"),
        "list shrinks": _fails(lambda: opened("resume", then=lambda s: s.list("tags").pop()), "only grows"),
        "list by slice": _fails(lambda: opened("resume", then=slice_), "slice"),
        "warns of what is not set": any("tags" in str(w.message) and "limit" not in str(w.message) for w in said),
    }
    return spark.createDataFrame(list(cases.items()), "what string, raised boolean")


@query("SELECT event_id, ts, value FROM events")
def session_resume_stream(spark, d):
    """Two runs of one stream; the second starts where the first ended."""
    source, path, checkpoint = (folder(spark, n) for n in ("source", "stream", "checkpoint"))
    e = _t(spark, d, "events").select("event_id", "ts", "value")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.filter(part).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(e.schema).parquet(source), path, checkpoint)
    return spark.read.schema(e.schema).parquet(path)


@query(
    """SELECT user_id, event_type, value FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS last FROM events
    GROUP BY user_id, event_type) WHERE last % 7 <> 0"""
)
def session_upsert(spark, d):
    e = _t(spark, d, "events")
    return last_values(e, ["user_id", "event_type"], F.struct("ts", "event_id"), F.col("value"), F.col("event_id") % 7 == 0)


@query("SELECT conv_id, cast(turn % 3 AS bigint) AS idx, arg_max(text, turn) AS value FROM conversations GROUP BY conv_id, turn % 3")
def session_list_setitem(spark, d):
    log = _t(spark, d, "conversations").select("conv_id", (F.col("turn") % 3).alias("idx"), "turn", "text")
    return last_values(log, ["conv_id", "idx"], F.col("turn"), F.col("text"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), w AS (SELECT a AS start, b AS node, 1 AS depth, [a, b] AS seen FROM e
    UNION ALL SELECT w.start, e.b, w.depth + 1, list_append(w.seen, e.b) FROM w JOIN e ON w.node = e.a WHERE w.node <> w.start AND w.depth < 25)
    SELECT cast(start AS bigint) AS start, cast(min(depth) AS bigint) AS depth FROM w WHERE node = start GROUP BY start"""
)
def cycle_detect(spark, d):
    """Records that reach themselves, and in how many steps."""
    edges = _t(spark, d, "nation").selectExpr("n_nationkey AS parent", "'next' AS field", "cast(null AS string) AS key", "(n_nationkey * 7 + 3) % 25 AS child")
    found = graph.returns(edges, edges.select(F.col("parent").alias("id"))).filter(F.col("node") == F.col("start"))
    return found.groupBy(F.col("start").cast("bigint").alias("start")).agg(F.min("steps").cast("bigint").alias("depth"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

