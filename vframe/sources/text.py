"""YAML and TOML documents in plain Python, for Arrow UDFs.

A file may hold several documents: YAML between lines of ``---``, TOML
between lines of ``# ---``, which are comments to other readers.
"""

from __future__ import annotations

import base64
import datetime as dt
import io
import json
import math
import re
import tomllib
from functools import cache
from typing import Any

import numpy as np

from vframe.errors import BackendError

# Marks of values that a text format cannot hold itself.
JSON_MARKS = ("__ver_json__", "__json__")
NDARRAY_MARKS = ("__ver_ndarray__", "__ndarray__")
TOML_BREAK = "# ---"

# YAML's plain parts: names, numbers, words that begin with a letter, and digests, which may begin with digits.
_NAME = r"[A-Za-z_][A-Za-z0-9_]{0,99}"
_WORD = r"(?:-?[A-Za-z_\u00c0-\u024f][A-Za-z0-9_\u00c0-\u024f.+/=#-]*|(?:[1-9][0-9]*|0[0-9]+)[A-Za-z][A-Za-z0-9]*)"
_WORDS = rf"{_WORD}(?: [A-Za-z0-9_\u00c0-\u024f]+)*"
_INT = r"-?(?:0|[1-9][0-9]*)"
_FLOAT = r"-?(?:0|[1-9][0-9]*)\.[0-9]+(?:e[+-][0-9]+)?"
_IS_NAME, _IS_WORD, _IS_WORDS = (re.compile(x) for x in (_NAME, _WORD, _WORDS))
_YAML_LINE = re.compile(rf"( *)(?:({_NAME}):(?: (?:({_WORDS})|({_INT})|({_FLOAT})|'([A-Za-z0-9]+)'))?|#[ -~]*)")
_IS_INT = re.compile("[1-9][0-9]*")
#: Words with a meaning of their own, in any case.
_MEANT = {"true", "false", "null", "yes", "no", "on", "off"}
_CONSTANTS = {"true": True, "false": False, "null": None}
#: Columns up to which no line is folded.
_WIDTH = 78


def plain(x: Any) -> Any:
    """A parsed value as JSON: native dates become ISO text, marked JSON is unwrapped, arrays are opened.

    Values that are not finite become text, which a field of floats reads back.
    """
    if isinstance(x, dict):
        for mark in JSON_MARKS:
            if set(x) == {mark}:
                return plain(json.loads(x[mark]))
        if any(x.get(mark) for mark in NDARRAY_MARKS) and isinstance(x.get("data"), str):
            return plain(array_from_blob(x))
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if isinstance(x, (dt.datetime, dt.date, dt.time)):
        return x.isoformat()
    if isinstance(x, float) and not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    return x


def array_from_blob(x: dict) -> dict:
    """A base64 archive of one array as dtype, shape and data."""
    with np.load(io.BytesIO(base64.b64decode(x["data"])), allow_pickle=False) as archive:
        a = archive[archive.files[0]]
    flat = a.ravel()
    data = [[v.real, v.imag] for v in flat.tolist()] if np.iscomplexobj(a) else flat.tolist()
    return {"dtype": str(a.dtype), "shape": list(a.shape), "data": data}


def array_to_blob(dtype: str, shape: list[int], data: list) -> dict:
    a = np.array(data, dtype=dtype).reshape(shape)
    out = io.BytesIO()
    np.savez(out, a)
    return {NDARRAY_MARKS[0]: True, "dtype": dtype, "shape": list(shape), "data": base64.b64encode(out.getvalue()).decode()}


def marked(doc: str, fields: list[str]) -> str:
    """A document with the arrays of some fields as marked archives."""
    x = json.loads(doc)
    for f in fields:
        if isinstance(v := x.get(f), dict) and isinstance(v.get("data"), list):
            x[f] = array_to_blob(v["dtype"], v["shape"], [complex(*p) if isinstance(p, list) else p for p in v["data"]])
    return json.dumps(x)


def opened(doc: str | None) -> str | None:
    """A document with its marked archives opened; null stays."""
    return None if doc is None else json.dumps(plain(json.loads(doc)))


def _roots(found: list[Any]) -> list[str]:
    for x in found:
        if not isinstance(x, dict):
            raise BackendError(f"a document is not an object but {type(x).__name__}")
    return [json.dumps(plain(x)) for x in found]


def from_json(text: str) -> list[str]:
    found = json.loads(text)
    return _roots(found if isinstance(found, list) else [found])


def _plain_yaml(text: str) -> dict | None:
    """One document of plain lines, mappings and comments; None for all else, which a YAML reader takes."""
    root: dict = {}
    at, holds = [(0, root)], None  # the mappings that are open, by their indent; one that is named, but has no line yet
    lines = text.split("\n")
    for line in lines[lines[0] == "---" :]:
        if not line:
            continue
        found = _YAML_LINE.fullmatch(line)
        if found is None:
            return None
        margin, name, words, whole, real, quoted = found.groups()
        if name is None:
            continue
        indent = len(margin)
        if holds is not None:
            if indent <= at[-1][0]:
                return None
            at.append((indent, holds))
        else:
            while indent < at[-1][0]:
                at.pop()
        if indent != at[-1][0] or name.lower() in _MEANT:
            return None
        holds = None
        if words is not None:
            if words.lower() not in _MEANT:
                value: Any = words
            elif words in _CONSTANTS:
                value = _CONSTANTS[words]
            else:
                return None
        elif whole is not None:
            value = int(whole)
        elif real is not None:
            value = float(real)
        elif quoted is not None:
            value = quoted
        else:
            value = holds = {}
        at[-1][1][name] = value
    return root if root and holds is None else None


def from_yaml(text: str) -> list[str]:
    if (one := _plain_yaml(text)) is not None:
        return _roots([one])
    import yaml

    if "\t" in text:  # where the C library takes more
        found = list(yaml.safe_load_all(text))
    else:
        found = list(yaml.load_all(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
    return _roots([x for x in found if x is not None])


def from_toml(text: str) -> list[str]:
    parts, held = [], []
    for line in text.split("\n"):  # no other line end: a string may hold those
        if line.strip() == TOML_BREAK:
            parts.append("\n".join(held))
            held = []
        else:
            held.append(line)
    parts.append("\n".join(held))
    return _roots([tomllib.loads(p) for p in parts if p.strip()])


def _comment(text: str) -> str:
    return "".join(f"# {line}\n" for line in text.rstrip("\n").split("\n"))


def _yaml_scalar(v: Any, room: int) -> str | None:
    """A scalar as YAML writers have it, where that is plain and nothing is folded within ``room`` columns."""
    if isinstance(v, str):
        if _IS_INT.fullmatch(v) and len(v) < room:
            return f"'{v}'"
        plain = (_IS_WORD.fullmatch(v) or len(v) < room and _IS_WORDS.fullmatch(v)) and v.lower() not in _MEANT
        return v if plain else None
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float) and math.isfinite(v):
        out = repr(v)
        return out if "." in out else out.replace("e", ".0e")
    return None


def _yaml_lines(k: str, v: Any, margin: str = "") -> str | None:
    """An entry's lines; None where a YAML writer is needed."""
    if not isinstance(k, str) or not _IS_NAME.fullmatch(k) or k.lower() in _MEANT:
        return None
    if isinstance(v, dict) and v:
        inner = [_yaml_lines(n, w, margin + "  ") for n, w in v.items()]
    elif isinstance(v, list) and v:
        inner = [None if (x := _yaml_scalar(w, _WIDTH - len(margin) - 2)) is None else f"{margin}- {x}\n" for w in v]
    else:
        one = _yaml_scalar(v, _WIDTH - len(margin) - len(k) - 2)
        return None if one is None else f"{margin}{k}: {one}\n"
    return None if None in inner else f"{margin}{k}:\n" + "".join(inner)


@cache
def _yaml_dumper() -> type:
    """The C library's writer, where it is installed."""
    import yaml

    return getattr(yaml, "CSafeDumper", yaml.SafeDumper)


def to_yaml(doc: dict, defaults: dict, key: str) -> str:
    """A document in its keys' order, envelope last; fields at their default are comments."""

    def dumped(k: str, v: Any) -> str:
        if (plain := _yaml_lines(k, v)) is not None:
            return plain
        import yaml

        return yaml.dump({k: v}, Dumper=_yaml_dumper(), default_flow_style=False, sort_keys=False, allow_unicode=True)

    def block(k: str, v: Any, default: Any, has: bool) -> str:
        if not has or v != default:
            return dumped(k, v)
        if isinstance(v, dict) and key in v:  # a nested record keeps its envelope
            inner = "".join(dumped(n, w) if n == key else _comment(dumped(n, w)) for n, w in v.items())
            return f"{k}:\n" + "".join(f"  {line}\n" for line in inner.rstrip("\n").split("\n"))
        return _comment(dumped(k, v))

    names = [k for k in doc if k != key] + [key] * (key in doc)
    return "".join(block(k, doc[k], defaults.get(k), k in defaults and k != key) for k in names)


def _toml_key(k: str) -> str:
    return k if k and all(c.isalnum() and c.isascii() or c in "_-" for c in k) else json.dumps(k)


def _toml_value(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return repr(v) if math.isfinite(v) else ("nan" if math.isnan(v) else "inf" if v > 0 else "-inf")
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(v, list):
        if any(x is None for x in v):
            raise BackendError("TOML has no null, and a list cannot leave it out")
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(w)}" for k, w in v.items() if w is not None) + "}"
    raise BackendError(f"TOML cannot hold {type(v).__name__}")


def to_toml(doc: dict, defaults: dict, key: str, at: tuple[str, ...] = ()) -> str:
    """Values first, then the envelope, then tables; nulls are left out."""
    out = []
    tables = []
    for k, v in doc.items():
        if isinstance(v, dict):
            tables.append((k, v))
        elif v is not None:
            line = f"{_toml_key(k)} = {_toml_value(v)}\n"
            out.append(_comment(line) if k in defaults and defaults[k] == v else line)
    tables.sort(key=lambda kv: kv[0] != key)
    for k, v in tables:
        name = (*at, k)
        inner = {} if k == key else d if isinstance(d := defaults.get(k), dict) else {}
        out.append(f"\n[{'.'.join(map(_toml_key, name))}]\n" + to_toml(v, inner, key, name))
    return "".join(out)
