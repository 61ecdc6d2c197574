"""Fingerprints, the registry, and types."""

import enum
import typing

import pytest

from vframe.errors import BackendError, HashMismatchError
from vframe.functions.types import NdArray, canonical, is_array
from vframe.plans.migration import Migration
from vframe.plans.record import RecordType, fingerprint, record, registered


@pytest.mark.parametrize(
    ("fields", "want"),
    [
        ({"name": str, "debug": bool, "retries": int}, "ed3a90"),
        ({"label": str, "description": str | None}, "36e64d"),
        ({"x": float, "y": float}, "e37514"),
        ({"tags": list[str], "scores": list[float]}, "2086ae"),
        ({"name": str, "mode": typing.Literal["fast", "slow"]}, "3c2d1b"),
        ({"name": str, "data": NdArray("float64")}, "c0dc53"),
        ({"name": str, "children": "list[_Node]"}, "b54495"),
    ],
)
def test_fingerprint(fields, want):
    assert fingerprint(fields) == want


def test_record_names_stand_for_records():
    inner = RecordType("Inner", 1, {"x": float, "y": float}, register=False)
    assert fingerprint({"name": str, "point": inner}) == "db925f"
    assert canonical(typing.Annotated[int, "note"]) == "int"


def test_declared_fingerprint():
    RecordType("A1", 1, {"x": float, "y": float}, hash="e37514", register=False)
    with pytest.raises(HashMismatchError):
        RecordType("A1", 1, {"x": float}, hash="e37514", register=False)


def test_registry():
    a = RecordType("Registered", 1, {"x": int}, old_names=("Before",))
    assert registered()["Before"] is a
    with pytest.raises(BackendError):
        RecordType("Other", 1, {"x": int}, old_names=("Before",))


def test_class_decorator_inherits():
    class Base:
        x: int
        y: int = 2

    class Child(Base):
        z: str = "z"

        class Migrate:
            v1 = Migration().rename("w", "z")

    r = record(2, register=False)(Child)
    assert list(r.fields) == ["x", "y", "z"]
    assert r.defaults == {"y": 2, "z": "z"}
    assert list(r.migrations) == [1]


def test_map_keys_and_case():
    inner = RecordType("Key", 1, {"x": int}, register=False)
    with pytest.raises(BackendError):
        RecordType("M", 1, {"m": dict[inner, int]}, register=False)
    with pytest.raises(BackendError):
        RecordType("M", 1, {"m": int, "M": int}, register=False)


def test_arrays_are_heavy():
    class Color(enum.Enum):
        RED = "r"

    assert is_array(NdArray()) and is_array(list[NdArray()]) and is_array(dict[str, NdArray()]) and not is_array(list[int])
    assert not is_array(Color)
