"""Exceptions. Errors that depend on data are raised on executors by
``raise_error`` with the class name in front of the message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class VframeError(Exception):
    """Base of all."""


class HashMismatchError(VframeError):
    """A record's declared fingerprint is not that of its fields."""

    def __init__(self, name: str, declared: str, computed: str):
        super().__init__(f"{name}: declared fingerprint {declared!r}, computed {computed!r}")
        self.name, self.declared, self.computed = name, declared, computed


class VersionError(VframeError):
    """A document is newer than its record type."""


class MigrationError(VframeError):
    """A step of a migration chain is missing or cannot be applied."""


class ArrayNotLoadedError(VframeError, AttributeError):
    """An array was left out of the scan."""


class UpgradeRequiredError(VframeError):
    """A step asks for an explicit upgrade."""


class UnknownFieldError(VframeError):
    """A document has fields that its record type does not."""


class ConverterError(VframeError):
    """A value cannot be encoded or decoded."""


class BackendError(VframeError):
    """A source or sink cannot be read or written."""


class CircularReferenceError(VframeError):
    """A record contains itself."""

    def __init__(self, path: str):
        super().__init__(f"circular reference at {path}")
        self.path = path


def fail(error: type[VframeError], *message: Column | str) -> Column:
    """An expression that raises when it is evaluated."""
    parts = [F.lit(f"{error.__name__}: "), *(m if isinstance(m, Column) else F.lit(m) for m in message)]
    return F.raise_error(F.concat(*(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))


def raised(stored: object, error: type[VframeError], *message: Column | str) -> Column:
    """The same, as an expression of a type."""
    return fail(error, *message).cast(stored)
