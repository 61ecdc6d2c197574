"""The envelope of a document: its object name, version and fingerprint.

It is an object under one key, by default ``__record__``; a reader of files
that name it otherwise passes their key. Older files hold the values under
upper-case dunder keys beside the fields; the wrapper goes before them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVELOPE = "__record__"

# The keys of older files.
LEGACY = {"object": "__OBJECT__", "version": "__VERSION__", "hash": "__HASH__", "format": "__FORMAT__"}

_STORED = {"object": "string", "version": "int", "hash": "string", "format": "int"}


def path(*names: str) -> str:
    """A VARIANT path of names, whatever they hold."""
    return "$" + "".join("['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']" for n in names)


def read(v: Column, name: str, key: str = ENVELOPE) -> Column:
    """One of object, version, hash and format, from the wrapper or an older layout."""
    stored = _STORED[name]
    places = (path(key, name), path(key, LEGACY[name]), path(LEGACY[name]))
    return F.coalesce(*(F.try_variant_get(v, p, stored) for p in places))


def envelope(v: Column, key: str = ENVELOPE) -> Column:
    return F.struct(*(read(v, n, key).alias(n) for n in ("object", "version", "hash")))


def keys(key: str = ENVELOPE) -> tuple[str, ...]:
    """The keys of envelopes, the wrapper's and those of older files."""
    return key, *LEGACY.values()


def field_names(v: Column, key: str = ENVELOPE) -> Column:
    """A document's keys without those of envelopes."""
    own = F.array(*(F.lit(k) for k in keys(key)))
    return F.array_except(F.json_object_keys(F.to_json(v)), own)
