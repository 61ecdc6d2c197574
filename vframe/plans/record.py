"""Record types: fields, version, fingerprint, policies, and their registry."""

from __future__ import annotations

import hashlib
import typing
import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.errors import BackendError, HashMismatchError, MigrationError, UnknownFieldError, UpgradeRequiredError, VersionError, fail, raised
from vframe.functions import codecs
from vframe.functions.types import allowed, canonical, is_array, is_union, members, spark_type, unwrap
from vframe.operators import policy
from vframe.plans.migration import Cell, Frame, Migration, Step, chain, run
from vframe.sources import envelope as env

_REGISTRY: dict[str, RecordType] = {}
#: The column of undeclared fields that are preserved.
REST = "_rest"
_lenient = False


def ignore_hash_errors(on: bool = True) -> None:
    """Warn of fingerprints that do not match, do not raise."""
    global _lenient
    _lenient = on


def registered() -> dict[str, RecordType]:
    """Record types by name and old name."""
    return dict(_REGISTRY)


def fingerprint(fields: dict[str, Any]) -> str:
    """Six hexadecimal digits of the fields' names and types."""
    payload = ",".join(f"{n}:{canonical(t)}" for n, t in sorted(fields.items()))
    return hashlib.sha256(payload.encode()).hexdigest()[:6]


def fingerprint_column(payload: Column) -> Column:
    """The same of a column of payloads."""
    return F.substring(F.sha2(payload, 256), 1, 6)


class RecordType:
    """A schema with a version.

    ``migrations`` maps a version to the step that leads to the next.
    ``base`` is a record type whose fields and defaults come first.
    ``unknown`` is "ignore", "error" or "preserve"; the last keeps undeclared
    fields of whole documents in a column ``_rest`` (a map of VARIANT), which
    writers of text formats put back.
    """

    def __init__(
        self,
        record_name: str,
        version: int,
        fields: dict[str, Any],
        defaults: dict[str, Any] | None = None,
        *,
        hash: str | None = None,
        old_names: tuple[str, ...] = (),
        register: bool = True,
        skip_defaults: bool = False,
        unknown: str = "ignore",
        validate_literals: bool = True,
        migrations: dict[int, Step] | list[Callable] | None = None,
        base: RecordType | None = None,
        envelope_key: str = env.ENVELOPE,
    ):
        self.record_name, self.version, self.old_names = record_name, version, tuple(old_names)
        self.fields = {**(base.fields if base else {}), **{n: t for n, t in fields.items() if not n.startswith("_") and typing.get_origin(t) is not typing.ClassVar}}
        self.defaults = {**(base.defaults if base else {}), **(defaults or {})}
        self.base, self.skip_defaults, self.unknown, self.validate_literals, self.envelope_key = base, skip_defaults, unknown, validate_literals, envelope_key
        if len({n.lower() for n in self.fields}) < len(self.fields):
            raise BackendError(f"{record_name}: fields differ only in case")
        for n, t in self.fields.items():
            if typing.get_origin(unwrap(t)) is dict and hasattr(unwrap(typing.get_args(unwrap(t))[0]), "record_name"):
                raise BackendError(f"{record_name}.{n}: a record cannot be the key of a map")
        self.migrations: dict[int, Step] = {}
        steps = migrations.items() if isinstance(migrations, dict) else [(m.from_version, m) for m in migrations or ()]
        for v, step in steps:
            if v in self.migrations:
                raise MigrationError(f"{record_name}: two migrations from version {v}")
            self.migrations[v] = step
        if hash is not None and hash != self.hash:
            error = HashMismatchError(record_name, hash, self.hash)
            if not _lenient:
                raise error
            warnings.warn(str(error), stacklevel=2)
        if register:
            names = (record_name, *self.old_names)
            if taken := [n for n in names if n in _REGISTRY and _REGISTRY[n].record_name != record_name]:
                raise BackendError(f"{record_name}: name {taken[0]!r} is taken")
            _REGISTRY.update(dict.fromkeys(names, self))

    @property
    def hash(self) -> str:
        return fingerprint(self.fields)

    def metadata(self) -> dict[str, Any]:
        return {"name": self.record_name, "version": self.version, "hash": self.hash, "old_names": self.old_names, "unknown": self.unknown}

    def is_a(self, other: RecordType) -> bool:
        return self is other or self.base is not None and self.base.is_a(other)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t), True, {"type": canonical(t)}) for n, t in self.fields.items()])

    def arrays(self) -> list[str]:
        """The fields that scans of scalars leave out."""
        return [n for n, t in self.fields.items() if is_array(t)]

    def envelope_struct(self) -> Column:
        return F.struct(F.lit(self.record_name).alias("object"), F.lit(self.version).alias("version"), F.lit(self.hash).alias("hash")).alias(self.envelope_key)

    # migration

    def steps(self, version: int) -> list[Step]:
        return chain(self.record_name, self.migrations, version, self.version)

    def first_version(self) -> int:
        """The oldest version that a whole chain leads from."""
        v = self.version
        while v - 1 in self.migrations:
            v -= 1
        return v

    def _gate(self, version: int, upgrade: bool) -> None:
        if not upgrade and any(isinstance(s, Migration) and s.asks_upgrade for s in self.steps(version)):
            raise UpgradeRequiredError(f"{self.record_name}: version {version} asks for an explicit upgrade")

    def finished(self, frame: Frame, validate: bool | None = None) -> list[Column]:
        """The declared fields of a frame, with defaults for what is absent."""
        out = []
        check = self.validate_literals if validate is None else validate
        for name, tp in self.fields.items():
            cell = frame.get(name)
            stored = spark_type(tp)
            if name in self.defaults:
                default = codecs.literal(self.defaults[name], tp)
            else:
                default = raised(stored, BackendError, f"{self.record_name}.{name} is missing")
            if cell is None or cell.present is False:
                value = default
            else:
                value = self._decoded(cell, tp, check).cast(stored) if not isinstance(stored, T.VariantType) else self._decoded(cell, tp, check)
                if cell.present is not True:
                    value = F.when(cell.present, value).otherwise(default)
            out.append(value.alias(name))
        return out

    def _decoded(self, cell: Cell, tp: Any, validate: bool) -> Column:
        if cell.is_variant:
            return codecs.decode(cell.value, tp, validate)
        plain = unwrap(tp)
        if is_union(plain) and len(members(plain)) == 1:
            plain = members(plain)[0]
        if hasattr(plain, "record_name") and isinstance(cell.stored, T.StructType):
            from vframe.plans.nested import migrate_struct

            return migrate_struct(cell.value, cell.stored, plain)
        origin, args = typing.get_origin(plain), typing.get_args(plain)
        if origin in (list, tuple, set, frozenset) and hasattr(unwrap(args[0]), "record_name") and isinstance(cell.stored, T.ArrayType):
            from vframe.plans.nested import migrate_list

            return migrate_list(cell.value, cell.stored, unwrap(args[0]))
        if origin is dict and hasattr(unwrap(args[1]), "record_name") and isinstance(cell.stored, T.MapType):
            from vframe.plans.nested import migrate_map

            return migrate_map(cell.value, cell.stored, unwrap(args[1]))
        return policy.validated(cell.value, tp, validate) if allowed(plain) else cell.value

    def known(self, frame: Frame) -> list[str]:
        return [*self.fields, *frame.removed]

    def migrate(
        self,
        df: DataFrame,
        version: str | int | None = None,
        *,
        layouts: dict[int, list[str]] | None = None,
        assume: int | None = None,
        upgrade: bool = False,
        sparse: bool = False,
        names: str | None = None,
        keep: tuple[str, ...] = (),
    ) -> DataFrame:
        """Rows of typed columns brought to this version, in one projection.

        ``version`` is a column or a number; ``layouts`` names the columns
        that rows of a version really have, by default all of ``df``. In a
        ``sparse`` frame, where files of several versions were merged, older
        rows have the columns that the array column ``names`` lists; where it
        is null, those that are not null themselves.
        Versions later than this one are an error when a row has one, also
        where no field is read.
        """
        columns = {f.name: f.dataType for f in df.schema.fields if f.name not in (version, names) and f.name not in keep}

        def present(n: str, v: int) -> Column | bool:
            if not sparse or v == self.version:
                return True
            filled = F.col(f"`{n}`").isNotNull()
            return F.coalesce(F.array_contains(F.col(names), n), filled) if names else filled

        def frame(v: int) -> list[Column]:
            self._gate(v, upgrade)
            have = (layouts or {}).get(v, list(columns))
            if sparse and v == self.version:
                have = [n for n in have if n in self.fields]
            f = Frame({n: Cell(F.col(f"`{n}`"), present(n, v), columns[n]) for n in have}, types=self.fields)
            run(self.steps(v), f)
            if self.unknown == "error" and (extra := set(f.cells) - set(self.fields)):
                raise UnknownFieldError(f"{self.record_name} has unknown fields {', '.join(sorted(extra))}")
            return self.finished(f)

        kept = [F.col(f"`{k}`") for k in keep]
        if version is None or isinstance(version, int):
            v = version or assume or self.version
            if v > self.version:
                raise VersionError(f"{self.record_name}: version {v} is newer than {self.version}")
            return df.select(*kept, *frame(v))
        at = policy.assume_version(F.col(version), assume or self.version)
        branches = {v: frame(v) for v in self._open(upgrade)}
        return df.filter(self._admitted(at, dict.fromkeys(branches))).select(*kept, *self._by_version(at, branches))

    def _open(self, upgrade: bool) -> list[int]:
        found = []
        for v in range(self.first_version(), self.version + 1):
            try:
                self._gate(v, upgrade)
                found.append(v)
            except UpgradeRequiredError:
                continue
        return found

    def _no_branch(self, at: Column, stored: T.DataType) -> Column:
        newer = fail(VersionError, f"{self.record_name}: version ", at, f" is newer than {self.version}")
        older = fail(MigrationError, f"{self.record_name}: no migration from version ", at, " or it asks for an upgrade")
        return F.when(at > self.version, newer.cast(stored)).otherwise(older.cast(stored))

    def _admitted(self, at: Column, checks: dict[int, Column | None]) -> Column:
        """A condition that is true, or raises: for versions without a branch, or by the check of theirs.

        As a filter or round a whole value it holds whatever is read of a row.
        """
        case = F.when(F.lit(False), F.lit(True))
        for v, check in checks.items():
            case = case.when(at == v, F.lit(True) if check is None else check)
        return case.otherwise(self._no_branch(at, T.BooleanType()))

    def _by_version(self, at: Column, branches: dict[int, list[Column]]) -> list[Column]:
        """Each field as a choice by version, with an error for versions that have no branch."""
        out = []
        for i, (name, tp) in enumerate(self.fields.items()):
            stored = spark_type(tp)
            values = {v: b[i].cast(stored) if not isinstance(stored, T.VariantType) else b[i] for v, b in branches.items()}
            bad = self._no_branch(at, stored)
            case = None
            for v, c in values.items():
                case = F.when(at == v, c) if case is None else case.when(at == v, c)
            out.append((bad if case is None else case.otherwise(bad)).alias(name))
        return out

    def variant_frame(self, v: Column) -> Frame:
        def source(name: str) -> Cell:
            got = F.variant_get(v, env.path(name), "variant")
            return Cell(got, got.isNotNull(), T.VariantType())

        return Frame({}, source, self.fields)

    def _variant_fields(self, v: Column, version: int, upgrade: bool) -> tuple[list[Column], Column | None, Frame]:
        """The fields of a document of a version, the check of its names, and the frame."""
        self._gate(version, upgrade)
        f = run(self.steps(version), self.variant_frame(v))
        check = policy.check_unknown(env.field_names(v, self.envelope_key), self.known(f), self.unknown, self.record_name)
        return self.finished(f), check, f

    def load_variant(self, df: DataFrame, doc: str = "doc", *, assume: int | None = None, upgrade: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        """Rows of documents in a VARIANT column, typed and at this version."""
        v = F.col(doc)
        at = policy.assume_version(env.read(v, "version", self.envelope_key), assume or self.version)
        later = env.read(v, "format", self.envelope_key)
        at = F.when(later.isNull(), at).otherwise(raised("int", BackendError, "document format ", later, " is newer than this reader"))
        made = {k: self._variant_fields(v, k, upgrade) for k in self._open(upgrade)}
        rest = []
        if self.unknown == "preserve":
            case = F.lit(None).cast("map<string,variant>")
            for k, (_, _, f) in made.items():
                case = F.when(at == k, self._rest(v, f)).otherwise(case)
            rest = [case.alias(REST)]
        admitted = df.filter(self._admitted(at, {k: check for k, (_, check, _) in made.items()}))
        return admitted.select(*(F.col(f"`{k}`") for k in keep), *self._by_version(at, {k: x[0] for k, x in made.items()}), *rest)

    def _rest(self, v: Column, frame: Frame) -> Column:
        """The fields of a document that the record type does not know."""
        known = F.array(*(F.lit(k) for k in (*self.known(frame), *env.keys(self.envelope_key))))
        return F.map_filter(F.variant_get(v, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(known, k))

    def decode_variant(self, v: Column) -> Column:
        """A nested document as a struct at this version; its own envelope tells its version."""
        at = policy.assume_version(env.read(v, "version", self.envelope_key), self.version)
        found = {k: self._variant_fields(v, k, False) for k in self._open(False)}
        made = F.struct(*self._by_version(at, {k: x[0] for k, x in found.items()}))
        there = v.isNotNull() & F.schema_of_variant(v).isin("VOID").eqNullSafe(F.lit(False))
        return F.when(there, F.when(self._admitted(at, {k: check for k, (_, check, _) in found.items()}), made))


def record(version: int, *, name: str | None = None, **options: Any) -> Callable[[type], RecordType]:
    """Makes a record type of a class with annotations and defaults.

    Functions marked with ``migration(n)`` and migrations named ``v1``, ``v2``
    ... in an inner class ``Migrate`` are its steps.
    """

    def make(cls: type) -> RecordType:
        fields: dict[str, Any] = {}
        defaults: dict[str, Any] = {}
        for c in reversed(cls.__mro__[:-1]):
            hints = typing.get_type_hints(c, include_extras=True) if c.__dict__.get("__annotations__") or hasattr(c, "__annotate__") else {}
            fields |= hints
            defaults |= {n: c.__dict__[n] for n in hints if n in c.__dict__}
        steps: dict[int, Step] = {}
        for n, m in vars(getattr(cls, "Migrate", type("Migrate", (), {}))).items():
            if isinstance(m, Migration) and n[:1] == "v" and n[1:].isdigit():
                v = int(n[1:])
            elif hasattr(m, "from_version"):
                v = m.from_version
            else:
                continue
            if v in steps:
                raise MigrationError(f"{cls.__name__}: two migrations from version {v}")
            steps[v] = m
        return RecordType(name or cls.__name__, version, fields, defaults, migrations=steps, **options)

    return make
