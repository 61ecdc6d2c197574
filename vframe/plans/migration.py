"""Migrations: ordered edits of a record's fields, kept as symbols.

A :class:`Frame` maps field names to cells, a Column and whether the field is
present. Presence is not nullness: a field may be there and null. It is a
Python bool where the layout is known and a Column where only the document
tells. Edits change the frame, never the data; what is left at the end is one
projection, which Catalyst prunes and folds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.errors import MigrationError

Presence = bool | Column


@dataclass
class Cell:
    value: Column
    present: Presence = True
    stored: T.DataType | None = None  #: where it is known

    @property
    def is_variant(self) -> bool:
        return isinstance(self.stored, T.VariantType)


def either(a: Presence, b: Presence) -> Presence:
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def choose(present: Presence, cell: Cell, other: Cell | None, tp: Any = None) -> Cell:
    """``cell`` where ``present``, else ``other``; a VARIANT that meets a typed value is decoded as ``tp``."""
    if present is True or other is None and present is False:
        return cell
    if present is False:
        return other  # type: ignore[return-value]
    if other is None:
        return Cell(F.when(present, cell.value), present, cell.stored)
    if cell.is_variant != other.is_variant:
        cell, other = (_decoded(c, o.stored, tp) if c.is_variant else c for c, o in ((cell, other), (other, cell)))
    return Cell(F.when(present, cell.value).otherwise(other.value), either(present, other.present), cell.stored or other.stored)


def _decoded(cell: Cell, stored: T.DataType | None, tp: Any) -> Cell:
    from vframe.functions.codecs import decode

    if tp is not None:
        return Cell(decode(cell.value, tp), cell.present, stored)
    if stored is None:
        raise MigrationError("a typed and an untyped value meet; state the type with as_type")
    return Cell(F.variant_get(cell.value, "$", stored.simpleString()), cell.present, stored)


class Frame:
    def __init__(self, cells: dict[str, Cell], source: Callable[[str], Cell] | None = None, types: dict[str, Any] | None = None):
        self.cells = dict(cells)
        self.source = source
        self.types = types or {}
        self.removed: set[str] = set()

    def get(self, name: str) -> Cell | None:
        if name not in self.cells and name not in self.removed and self.source:
            self.cells[name] = self.source(name)
        return self.cells.get(name)

    def set(self, name: str, cell: Cell) -> None:
        self.cells[name] = cell

    def pop(self, name: str) -> Cell | None:
        cell = self.get(name)
        self.cells.pop(name, None)
        self.removed.add(name)
        return cell

    def typed(self, cell: Cell, name: str, as_type: Any) -> Column:
        """The value that a function gets: a VARIANT is cast where its type is known."""
        from vframe.functions.codecs import decode

        tp = as_type if as_type is not None else self.types.get(name)
        if not cell.is_variant or tp is None:
            return cell.value
        if isinstance(tp, str):
            return F.variant_get(cell.value, "$", tp)
        return decode(cell.value, tp)


@dataclass(frozen=True)
class Rename:
    old: str
    new: str

    def apply(self, f: Frame) -> None:
        cell = f.pop(self.old)
        if cell is None or cell.present is False:
            return
        before = f.get(self.new)
        f.removed.discard(self.new)
        f.set(self.new, choose(cell.present, cell, before, f.types.get(self.new)))


@dataclass(frozen=True)
class Add:
    field: str
    default: Any

    def apply(self, f: Frame) -> None:
        from vframe.functions.codecs import literal
        from vframe.functions.types import spark_type

        cell = f.get(self.field)
        if cell is not None and cell.present is True:
            return
        f.removed.discard(self.field)
        tp = f.types.get(self.field)
        made = Cell(literal(self.default, tp), True, spark_type(tp) if tp is not None else _natural(self.default))
        if cell is None or cell.present is False:
            f.set(self.field, made)
        else:
            f.set(self.field, choose(cell.present, cell, made, tp))


def _natural(value: Any) -> T.DataType | None:
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value))


@dataclass(frozen=True)
class Drop:
    field: str

    def apply(self, f: Frame) -> None:
        f.pop(self.field)


@dataclass(frozen=True)
class Convert:
    field: str
    via: Callable[[Column], Column]
    reverse: Callable[[Column], Column] | None = None
    as_type: Any = None

    def apply(self, f: Frame) -> None:
        cell = f.get(self.field)
        if cell is not None and cell.present is not False:
            f.set(self.field, Cell(self.via(f.typed(cell, self.field, self.as_type)), cell.present))


@dataclass(frozen=True)
class Derive:
    field: str
    from_: str
    via: Callable[[Column], Column]
    as_type: Any = None

    def apply(self, f: Frame) -> None:
        cell = f.get(self.from_)
        if cell is not None and cell.present is not False:
            made = Cell(self.via(f.typed(cell, self.from_, self.as_type)), cell.present)
            before = f.get(self.field)
            f.removed.discard(self.field)
            f.set(self.field, choose(cell.present, made, before, f.types.get(self.field)))


@dataclass(frozen=True)
class Split:
    field: str
    into: dict[str, Callable[[Column], Column]]
    as_type: Any = None

    def apply(self, f: Frame) -> None:
        cell = f.pop(self.field)
        if cell is None or cell.present is False:
            return
        value = f.typed(cell, self.field, self.as_type)
        for name, via in self.into.items():
            before = f.get(name)
            f.removed.discard(name)
            f.set(name, choose(cell.present, Cell(via(value), cell.present), before, f.types.get(name)))


@dataclass(frozen=True)
class Merge:
    fields: tuple[str, ...]
    into: str
    via: Callable[..., Column]
    as_type: Any = None

    def apply(self, f: Frame) -> None:
        found = [(n, c) for n in self.fields if (c := f.pop(n)) is not None and c.present is not False]
        if not found:
            return
        values = [(f.typed(c, n, self.as_type), c.present) for n, c in found]
        open_ = [i for i, (_, p) in enumerate(values) if p is not True]
        if len(open_) > 6:
            raise MigrationError(f"merge into {self.into}: too many fields of unknown presence")
        out: Cell | None = f.get(self.into)
        # one branch for each set of fields that may be there
        for chosen in itertools.product((False, True), repeat=len(open_)):
            there = dict(zip(open_, chosen, strict=True))
            args = [v for i, (v, _) in enumerate(values) if there.get(i, True)]
            if not args:
                continue
            when: Presence = True
            for i, yes in there.items():
                p = values[i][1] if yes else ~values[i][1]  # type: ignore[operator]
                when = p if when is True else when & p
            out = choose(when, Cell(self.via(*args), when), out, f.types.get(self.into))
        f.removed.discard(self.into)
        if out is not None:
            f.set(self.into, out)


@dataclass(frozen=True)
class RequiresUpgrade:
    def apply(self, f: Frame) -> None:
        """Checked before a chain is compiled."""


@dataclass(frozen=True)
class Migration:
    """A chain of edits; each method gives a longer one."""

    steps: tuple[Any, ...] = field(default=())

    @property
    def ops(self) -> list[Any]:
        return list(self.steps)

    def _and(self, op: Any) -> Migration:
        return Migration((*self.steps, op))

    def rename(self, old: str, new: str) -> Migration:
        return self._and(Rename(old, new))

    def add(self, name: str, *, default: Any) -> Migration:
        return self._and(Add(name, default))

    def drop(self, name: str) -> Migration:
        return self._and(Drop(name))

    def convert(self, name: str, *, via: Callable[[Column], Column], reverse: Any = None, as_type: Any = None) -> Migration:
        return self._and(Convert(name, via, reverse, as_type))

    def derive(self, name: str, *, from_: str, via: Callable[[Column], Column], as_type: Any = None) -> Migration:
        return self._and(Derive(name, from_, via, as_type))

    def split(self, name: str, *, into: dict[str, Callable[[Column], Column]], as_type: Any = None) -> Migration:
        return self._and(Split(name, dict(into), as_type))

    def merge(self, names: list[str], *, into: str, via: Callable[..., Column], as_type: Any = None) -> Migration:
        return self._and(Merge(tuple(names), into, via, as_type))

    def requires_upgrade(self) -> Migration:
        return self._and(RequiresUpgrade())

    def then(self, other: Migration) -> Migration:
        return Migration((*self.steps, *other.steps))

    def apply(self, f: Frame) -> None:
        for op in self.steps:
            op.apply(f)

    @property
    def asks_upgrade(self) -> bool:
        return any(isinstance(op, RequiresUpgrade) for op in self.steps)


class Context:
    """What an imperative migration works on: names and Columns."""

    def __init__(self, frame: Frame):
        self._frame = frame

    def __getitem__(self, name: str) -> Column:
        cell = self._frame.get(name)
        if cell is None or cell.present is False:
            raise KeyError(name)
        return self._frame.typed(cell, name, None)

    def __setitem__(self, name: str, value: Any) -> None:
        self._frame.removed.discard(name)
        self._frame.set(name, Cell(value if isinstance(value, Column) else F.lit(value)))

    def has(self, name: str) -> Column:
        """Whether a field is there, as a Column."""
        cell = self._frame.get(name)
        return F.lit(False) if cell is None else F.lit(cell.present) if isinstance(cell.present, bool) else cell.present

    def __contains__(self, name: str) -> bool:
        cell = self._frame.get(name)
        if cell is not None and not isinstance(cell.present, bool):
            raise MigrationError(f"only a document tells whether it has {name}; use has()")
        return cell is not None and cell.present is True

    def pop(self, name: str) -> Column:
        value = self[name]
        self._frame.pop(name)
        return value

    def drop(self, name: str) -> None:
        self._frame.pop(name)

    def keys(self) -> Iterator[str]:
        return iter([k for k, c in self._frame.cells.items() if c.present is not False])

    def to_dict(self) -> dict[str, Column]:
        return {k: self._frame.cells[k].value for k in self.keys()}


Step = Migration | Callable[[Context], None]


def migration(from_version: int) -> Callable[[Callable[[Context], None]], Callable[[Context], None]]:
    """Marks a function of a :class:`Context` as the step from a version to the next."""

    def mark(fn: Callable[[Context], None]) -> Callable[[Context], None]:
        fn.from_version = from_version  # type: ignore[attr-defined]
        return fn

    return mark


def chain(name: str, steps: dict[int, Step], start: int, end: int) -> list[Step]:
    """The steps from a version to another, each there."""
    found = []
    for v in range(start, end):
        if v not in steps:
            raise MigrationError(f"{name}: no migration from version {v} to {v + 1}")
        found.append(steps[v])
    return found


def run(steps: list[Step], frame: Frame) -> Frame:
    for step in steps:
        if isinstance(step, Migration):
            step.apply(frame)
        else:
            step(Context(frame))
    return frame
