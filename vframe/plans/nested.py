"""The same migrations inside structs, arrays, maps and polymorphic values.

A nested value carries its own envelope, ``_env`` (object, version, hash), or
is taken to be current. A field that the struct's type has is present, null or
not, unless the layout of its version is given or the envelope lists the names
of the fields that the value was stored with (``_env.fields``), as stores do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.errors import BackendError, raised
from vframe.functions.types import spark_type
from vframe.operators import policy
from vframe.plans.migration import Cell, Frame, run
from vframe.plans.record import RecordType

Layouts = dict[int, list[str]]


def version_of(value: Column, stored: T.StructType, record: RecordType) -> Column:
    for f in stored.fields:
        if f.name in ("_env", record.envelope_key) and isinstance(f.dataType, T.StructType):
            return policy.assume_version(value[f.name]["version"], record.version)
        if f.name == "_v":
            return policy.assume_version(value["_v"], record.version)
    return F.lit(record.version)


def _listed(value: Column, stored: T.StructType, record: RecordType) -> Column | None:
    """The names of the fields that a value was stored with, where stores note them."""
    for f in stored.fields:
        if f.name in ("_env", record.envelope_key) and isinstance(f.dataType, T.StructType) and "fields" in f.dataType.names:
            return value[f.name]["fields"]
    return None


def _fields(value: Column, stored: T.StructType, record: RecordType, version: int, layouts: Layouts | None) -> list[Column]:
    names = {f.name: f.dataType for f in stored.fields if f.name not in ("_env", "_v", record.envelope_key)}
    given = (layouts or {}).get(version)
    if given is not None:
        cells = {n: Cell(value[n], True, names[n]) for n in given}
    else:
        listed = _listed(value, stored, record)
        cells = {n: Cell(value[n], True if listed is None else F.coalesce(F.array_contains(listed, n), value[n].isNotNull()), t) for n, t in names.items()}
    frame = Frame(cells, types=record.fields)
    return record.finished(run(record.steps(version), frame))


def migrate_struct(value: Column, stored: T.StructType, record: RecordType, layouts: Layouts | None = None) -> Column:
    """A struct at the record's version."""
    at = version_of(value, stored, record)
    branches = {v: _fields(value, stored, record, v, layouts) for v in range(record.first_version(), record.version + 1)}
    return F.when(value.isNotNull(), F.struct(*record._by_version(at, branches)))


def migrate_list(value: Column, stored: T.ArrayType, record: RecordType, layouts: Layouts | None = None) -> Column:
    """Every element by its own version."""
    return F.transform(value, lambda x: migrate_struct(x, stored.elementType, record, layouts))


def migrate_map(value: Column, stored: T.MapType, record: RecordType, layouts: Layouts | None = None) -> Column:
    return F.transform_values(value, lambda _, x: migrate_struct(x, stored.valueType, record, layouts))


def superset(records: list[RecordType]) -> T.StructType:
    """A struct that holds any of the records, with the name of the one it is."""
    fields: dict[str, T.DataType] = {}
    for r in records:
        for n, t in r.fields.items():
            stored = spark_type(t)
            if fields.setdefault(n, stored) != stored:
                raise BackendError(f"field {n} has two types among {', '.join(x.record_name for x in records)}")
    return T.StructType([T.StructField("object", T.StringType()), *(T.StructField(n, t) for n, t in fields.items())])


def dispatch(value: Column, stored: T.StructType, object_: Column, records: list[RecordType], base: RecordType | None = None, layouts: dict[str, Layouts] | None = None) -> Column:
    """A polymorphic value as the superset struct, each record type by its own migrations.

    ``object_`` is the stored name; old names count. Names of no record type,
    or of one that is not of ``base``, are an error when a row has one.
    """
    target = superset(records)
    case: Column | None = None
    for r in records:
        names = [r.record_name, *r.old_names]
        if base is not None and not r.is_a(base):
            made = raised(target, BackendError, object_, f" is not a {base.record_name}")
        else:
            own = migrate_struct(value, stored, r, (layouts or {}).get(r.record_name))
            made = F.struct(F.lit(r.record_name).alias("object"), *((own[f.name] if f.name in r.fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields[1:]))
        case = F.when(object_.isin(names), made) if case is None else case.when(object_.isin(names), made)
    unknown = raised(target, BackendError, "unknown record type ", object_)
    return case.otherwise(unknown)  # type: ignore[union-attr]
