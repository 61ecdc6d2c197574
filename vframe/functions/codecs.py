"""Codecs between stored values and their wire form, as Column expressions.

The wire form is what a text document holds: numbers, strings, booleans,
arrays and objects. ``encode`` gives it for a typed column; ``decode`` takes a
VARIANT to a typed column.
"""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import json
import re
import typing
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.errors import ConverterError, fail
from vframe.functions.types import Aware, NdArray, allowed, is_union, members, spark_type, unwrap

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Converter:
    """Column functions of a type of the user's own; ``stored`` is its Spark type, ``wire`` that of its wire form."""

    stored: T.DataType
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    subclasses: bool = False
    wire: str | None = None


_CONVERTERS: dict[type, Converter] = {}


def register_converter(tp: type, stored: T.DataType, encode: Callable[[Column], Column], decode: Callable[[Column], Column], *, subclasses: bool = False, wire: str | None = None) -> None:
    """Registers a type; an exact match goes before a base class, base classes in order."""
    _CONVERTERS[tp] = Converter(stored, encode, decode, subclasses, wire)


def converter_for(tp: Any) -> Converter | None:
    if tp in _CONVERTERS:
        return _CONVERTERS[tp]
    if isinstance(tp, type):
        if hasattr(tp, "to_value") and hasattr(tp, "from_value") and hasattr(tp, "stored"):
            return Converter(tp.stored, tp.to_value, tp.from_value)
        for base, found in _CONVERTERS.items():
            if found.subclasses and issubclass(tp, base):
                return found
    return None


# scalars


def encode_timestamp(c: Column) -> Column:
    """ISO 8601, with microseconds only where there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def decode_timestamp(c: Column) -> Column:
    return F.to_timestamp_ntz(c)


def encode_aware(c: Column) -> Column:
    return F.concat(encode_timestamp(F.to_utc_timestamp(c, F.current_timezone())), F.lit("+00:00"))


def encode_date(c: Column) -> Column:
    return c.cast("string")


def encode_interval(c: Column) -> Column:
    """Seconds of a day-time interval."""
    part = [F.extract(F.lit(x), c).cast("double") for x in ("DAY", "HOUR", "MINUTE", "SECOND")]
    return part[0] * 86400 + part[1] * 3600 + part[2] * 60 + part[3]


def decode_interval(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def encode_binary(c: Column) -> Column:
    """Base64 without line ends."""
    return F.regexp_replace(F.base64(c), "[\\r\\n]", "")


def decode_binary(c: Column) -> Column:
    return F.unbase64(c)


def encode_complex(c: Column) -> Column:
    return F.array(c["re"], c["im"])


def decode_complex(c: Column) -> Column:
    return F.struct(F.get(c, F.lit(0)).alias("re"), F.get(c, F.lit(1)).alias("im"))


def decode_uuid(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(UUID_PATTERN), F.lower(c)).otherwise(fail(ConverterError, "not a UUID: ", c).cast("string"))


def canonical_set(c: Column) -> Column:
    """Distinct elements in order of their text."""
    return F.array_sort(F.array_distinct(c), lambda x, y: F.when(x.cast("string") < y.cast("string"), -1).when(x.cast("string") > y.cast("string"), 1).otherwise(0))


def literal(value: Any, tp: Any = None) -> Column:
    """A Python default as a column of a type's storage."""
    if callable(value) and not isinstance(value, (type, enum.Enum)):
        value = value()
    if value in (list, dict, set, frozenset, tuple):
        value = value()
    stored = None if tp is None else spark_type(tp)

    def plain(v: Any) -> Column:
        if isinstance(v, enum.Enum):
            v = v.value
        if isinstance(v, (set, frozenset)):
            v = sorted(v, key=repr)
        if isinstance(v, (list, tuple)):
            return F.array(*map(plain, v)) if v else F.array()
        if isinstance(v, dict):
            return F.create_map(*(x for k, w in v.items() for x in (plain(k), plain(w)))) if v else F.create_map()
        if isinstance(v, complex):
            return F.struct(F.lit(v.real).alias("re"), F.lit(v.imag).alias("im"))
        if isinstance(v, (uuid.UUID, re.Pattern, dt.time)) or hasattr(v, "__fspath__"):
            v = v.pattern if isinstance(v, re.Pattern) else v.isoformat() if isinstance(v, dt.time) else str(v)
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("bigint")
        return F.lit(v)

    c = plain(value)
    if isinstance(stored, T.VariantType):
        return F.lit(None).cast("variant") if value is None else F.parse_json(F.lit(json.dumps(value.value if isinstance(value, enum.Enum) else value)))
    return c if stored is None else c.cast(stored)


# typed column to wire form


def encode(c: Column, tp: Any) -> Column:
    """The wire form of a stored column, for ``to_json``."""
    tp = unwrap(tp)
    if tp == Aware:
        return encode_aware(c)
    if own := converter_for(tp):
        return own.encode(c)
    if hasattr(tp, "record_name"):
        fields = [encode(c[f], t).alias(f) for f, t in tp.fields.items()]
        return F.when(c.isNotNull(), F.struct(*fields, tp.envelope_struct()))
    if is_union(tp):
        inner = members(tp)
        return encode(c, inner[0]) if len(inner) == 1 else c
    origin, args = typing.get_origin(tp), typing.get_args(tp)
    if origin in (set, frozenset):
        return F.transform(canonical_set(c), lambda x: encode(x, args[0]))
    if origin in (list, tuple):
        return F.transform(c, lambda x: encode(x, args[0]))
    if origin is dict:
        return F.transform_values(F.transform_keys(c, lambda k, _: encode(k, args[0]).cast("string")), lambda _, v: encode(v, args[1]))
    if tp is dt.datetime:
        return encode_timestamp(c)
    if tp is dt.date:
        return encode_date(c)
    if tp is dt.timedelta:
        return encode_interval(c)
    if tp is bytes:
        return encode_binary(c)
    if tp is decimal.Decimal:
        return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    if tp is complex:
        return encode_complex(c)
    return c


# VARIANT to typed column


def _get(v: Column, stored: str) -> Column:
    return F.variant_get(v, "$", stored)


def decode(v: Column, tp: Any, validate: bool = True) -> Column:
    """A typed column from a VARIANT; a JSON null gives null for any type."""
    from vframe.operators.policy import validated

    noted, tp = tp, unwrap(tp)
    if tp == Aware:
        return _get(v, "string").cast("timestamp")
    if own := converter_for(tp):
        return own.decode(_get(v, own.wire or own.stored.simpleString()))
    if hasattr(tp, "record_name"):
        return tp.decode_variant(v)
    if is_union(tp):
        inner = members(tp)
        if len(inner) == 1:
            return decode(v, inner[0], validate)
        return union(v, tp)
    if allowed(tp):
        return validated(_get(v, spark_type(tp).simpleString()), noted, validate)
    origin, args = typing.get_origin(tp), typing.get_args(tp)
    if origin in (list, tuple, set, frozenset):
        elements = F.transform(_get(v, "array<variant>"), lambda x: decode(x, args[0], validate))
        return canonical_set(elements) if origin in (set, frozenset) else elements
    if origin is dict:
        entries = F.map_entries(_get(v, "map<string,variant>"))
        pairs = F.transform(entries, lambda e: F.struct(e["key"].cast(spark_type(args[0])).alias("key"), decode(e["value"], args[1], validate).alias("value")))
        return F.map_from_entries(pairs)
    if isinstance(tp, NdArray):
        return decode_array(v, tp)
    if tp is dt.datetime:
        return decode_timestamp(_get(v, "string"))
    if tp is dt.date:
        return _get(v, "string").cast("date")
    if tp is dt.timedelta:
        return decode_interval(_get(v, "double"))
    if tp is bytes:
        return decode_binary(_get(v, "string"))
    if tp is decimal.Decimal:
        return _get(v, "string").cast(spark_type(tp))
    if tp is complex:
        return decode_complex(_get(v, "array<double>"))
    if tp is uuid.UUID:
        return decode_uuid(_get(v, "string"))
    stored = spark_type(tp)
    return v if isinstance(stored, T.VariantType) else _get(v, stored.simpleString())


def decode_array(v: Column, tp: NdArray) -> Column:
    """Of an object of dtype, shape and data, or of a plain list."""
    element = spark_type(tp)["data"].dataType.elementType.simpleString()
    plain = F.try_variant_get(v, "$", f"array<{element}>")
    data = F.coalesce(plain, F.try_variant_get(v, "$.data", f"array<{element}>"))
    shape = F.coalesce(F.try_variant_get(v, "$.shape", "array<int>"), F.array(F.size(plain)))
    made = F.struct(F.lit(tp.dtype).alias("dtype"), shape.alias("shape"), data.alias("data"))
    return F.when(data.isNotNull(), made)


def union(v: Column, tp: Any) -> Column:
    """The first member that a value decodes to, back as a VARIANT; else the value."""
    tried = []
    for t in members(tp):
        stored = spark_type(t)
        if isinstance(stored, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
            continue
        tried.append(F.parse_json(F.to_json(F.struct(F.try_variant_get(v, "$", stored.simpleString()).alias("x")))))
    found = [F.when(F.try_variant_get(x, "$.x", "string").isNotNull(), F.variant_get(x, "$.x", "variant")) for x in tried]
    return F.coalesce(*found, v) if found else v
