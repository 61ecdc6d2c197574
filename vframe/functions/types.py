"""Declared types, their canonical names and their Spark types.

Types are written as Python annotations. A nested record is written as its
record type. ``spark_type`` decides how a value is stored in a DataFrame;
types without one of their own (``Any``, unions) are VARIANT.
"""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import pathlib
import re
import types
import typing
import uuid
from typing import Any

from pyspark.sql import types as T

#: Annotation of an aware datetime, stored as an instant.
Aware = typing.Annotated[dt.datetime, "aware"]

_SCALARS: dict[Any, T.DataType] = {
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bool: T.BooleanType(),
    bytes: T.BinaryType(),
    dt.datetime: T.TimestampNTZType(),
    dt.date: T.DateType(),
    dt.time: T.StringType(),
    dt.timedelta: T.DayTimeIntervalType(),
    uuid.UUID: T.StringType(),
    decimal.Decimal: T.DecimalType(38, 18),
    complex: T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    re.Pattern: T.StringType(),
    pathlib.Path: T.StringType(),
    pathlib.PurePosixPath: T.StringType(),
    pathlib.PureWindowsPath: T.StringType(),
    type(None): T.StringType(),
}

#: Element types of arrays. Unsigned elements take the next wider type.
DTYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
    "complex64": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "complex128": _SCALARS[complex],
}


class NdArray:
    """The annotation of an n-dimensional array: ``NdArray("float64")``."""

    def __init__(self, dtype: str = "float64"):
        if dtype not in DTYPES:
            raise TypeError(f"no such element type: {dtype}")
        self.dtype = dtype

    def __eq__(self, other: object) -> bool:
        return isinstance(other, NdArray) and other.dtype == self.dtype

    def __hash__(self) -> int:
        return hash(self.dtype)


def unwrap(tp: Any) -> Any:
    """The type under ``Annotated``, but for aware datetimes."""
    while typing.get_origin(tp) is typing.Annotated and tp != Aware:
        tp = typing.get_args(tp)[0]
    return tp


def is_union(tp: Any) -> bool:
    return typing.get_origin(tp) in (typing.Union, types.UnionType)


def members(tp: Any) -> list[Any]:
    """A union's types but None."""
    return [a for a in typing.get_args(tp) if a is not type(None)]


def canonical(tp: Any) -> str:
    """A type's name in fingerprints."""
    if typing.get_origin(tp) is typing.Annotated:
        return canonical(typing.get_args(tp)[0])
    if tp is None or tp is type(None):
        return "None"
    if isinstance(tp, str):
        return tp
    if isinstance(tp, typing.ForwardRef):
        return tp.__forward_arg__
    if isinstance(tp, NdArray):
        return f"ndarray[tuple[typing.Any, Ellipsis], numpy.dtype[numpy.{tp.dtype}]]"
    if is_union(tp):
        return f"Union[{', '.join(sorted(map(canonical, typing.get_args(tp))))}]"
    origin, args = typing.get_origin(tp), typing.get_args(tp)
    if origin is typing.Literal:
        return f"typing.Literal[{', '.join(str(a) for a in args)}]"
    if origin is not None:
        inner = ", ".join("Ellipsis" if a is ... else canonical(a) for a in args)
        return f"{canonical(origin)}[{inner}]" if args else canonical(origin)
    if tp is ...:
        return "Ellipsis"
    if hasattr(tp, "record_name"):
        return tp.record_name
    module = getattr(tp, "__module__", "")
    name = getattr(tp, "__qualname__", repr(tp))
    if tp is typing.Any:
        return "typing.Any"
    return name if module == "builtins" else f"{module}.{name}"


def allowed(tp: Any) -> list[Any] | None:
    """The values of a literal or enumeration."""
    tp = unwrap(tp)
    if typing.get_origin(tp) is typing.Literal:
        return list(typing.get_args(tp))
    if isinstance(tp, type) and issubclass(tp, enum.Enum):
        return [m.value for m in tp]
    return None


def is_array(tp: Any) -> bool:
    """Whether a field holds arrays and is left out of scans of scalars."""
    tp = unwrap(tp)
    if is_union(tp):
        return any(map(is_array, members(tp)))
    if isinstance(tp, NdArray):
        return True
    args = typing.get_args(tp)
    return typing.get_origin(tp) in (list, tuple, dict) and bool(args) and is_array([a for a in args if a is not ...][-1])


def spark_type(tp: Any) -> T.DataType:
    """How values of a type are stored."""
    tp = unwrap(tp)
    if tp == Aware:
        return T.TimestampType()
    if hasattr(tp, "record_name"):
        return tp.struct()
    if isinstance(tp, NdArray):
        return T.StructType(
            [T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(DTYPES[tp.dtype]))]
        )
    if is_union(tp):
        inner = members(tp)
        return spark_type(inner[0]) if len(inner) == 1 else T.VariantType()
    if values := allowed(tp):
        return spark_type(type(values[0]))
    origin, args = typing.get_origin(tp), typing.get_args(tp)
    if origin in (list, tuple, set, frozenset):
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if tp in _SCALARS:
        return _SCALARS[tp]
    if isinstance(tp, type):
        for base, found in _SCALARS.items():
            if isinstance(base, type) and base is not type(None) and issubclass(tp, base):
                return found
        from vframe.functions.codecs import converter_for

        if own := converter_for(tp):
            return own.stored
    return T.VariantType()
