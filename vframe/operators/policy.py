"""What happens to values and fields that a record type does not expect."""

from __future__ import annotations

import enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vframe.errors import ConverterError, UnknownFieldError, fail
from vframe.functions.types import allowed, spark_type, unwrap

_FALLBACKS: dict[Any, Any] = {}


class Fallback:
    """Annotation of a literal or enumeration: the value for those not allowed."""

    def __init__(self, value: Any):
        self.value = value.value if isinstance(value, enum.Enum) else value


def fallback_of(tp: Any) -> Fallback | None:
    import typing

    if typing.get_origin(tp) is typing.Annotated:
        for m in typing.get_args(tp)[1:]:
            if isinstance(m, Fallback):
                return m
    own = getattr(unwrap(tp), "__fallback__", None)
    return Fallback(own) if own is not None else None


def with_fallback(c: Column, values: list[Any], fallback: Any) -> Column:
    """Values that are not allowed become ``fallback``; null stays."""
    return F.when(c.isNull() | c.isin(values), c).otherwise(F.lit(fallback))


def validated(c: Column, tp: Any, validate: bool = True) -> Column:
    """Only allowed values of a literal or enumeration, by its fallback or an error."""
    values, own = allowed(tp), fallback_of(tp)
    if values is None or not validate:
        return c
    if own is not None:
        return with_fallback(c, values, own.value)
    bad = fail(ConverterError, c, " is not one of ", ", ".join(map(str, values)))
    return F.when(c.isNull() | c.isin(values), c).otherwise(bad.cast(spark_type(tp)))


def unknown_names(names: Column, known: list[str]) -> Column:
    return F.array_except(names, F.array(*(F.lit(k) for k in known)).cast("array<string>"))


def check_unknown(names: Column, known: list[str], policy: str, where: str) -> Column | None:
    """A condition that is true, or raises where there are unknown names; None if that is no error."""
    if policy != "error":
        return None
    extra = unknown_names(names, known)
    return F.when(F.size(extra) == 0, F.lit(True)).otherwise(fail(UnknownFieldError, where, " has unknown fields ", F.array_join(extra, ", ")).cast("boolean"))


def assume_version(version: Column, assumed: int) -> Column:
    """The version of documents that state none."""
    return F.coalesce(version.cast("int"), F.lit(assumed))
