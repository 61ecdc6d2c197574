"""Reading and writing record documents.

Text formats become one VARIANT for each document, which the record type's
migrations and codecs turn into typed columns; from there on all is Catalyst.
Parquet holds typed columns and is read and pruned natively.
"""

from __future__ import annotations

import enum
import json
import os
import typing
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.errors import ArrayNotLoadedError, BackendError, raised
from vframe.functions import codecs
from vframe.functions.types import is_array, is_union, members, unwrap
from vframe.plans.record import REST, RecordType, registered
from vframe.sources import envelope as env
from vframe.sources import text


#: Letters of documents that a Python worker handles together.
PIECE = 1 << 20


@dataclass(frozen=True)
class Format:
    """``read`` gives rows of _path and doc (VARIANT), with marked arrays opened where ``opens`` says so; ``write`` takes JSON texts."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    write: Callable[[DataFrame, str, str, dict, str], None] | None = None
    opens: bool = False


_FORMATS: dict[str, Format] = {}


def register_format(extensions: list[str], fmt: Format) -> None:
    _FORMATS.update(dict.fromkeys([e.lower().lstrip(".") for e in extensions], fmt))


def format_for(path: str, explicit: str | None = None) -> Format:
    """By name, or by the path's suffix, whatever its case."""
    ending = (explicit or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if ending in ("h5", "hdf5"):
        try:
            import h5py  # noqa: F401
        except ImportError:
            raise BackendError("reading .h5 files needs h5py, which is not installed; use parquet") from None
    if ending not in _FORMATS:
        raise BackendError(f"no format for {path!r}; there are {', '.join(sorted(_FORMATS))}")
    return _FORMATS[ending]


def _texts(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True, **options).select(F.input_file_name().alias("_path"), "value")


def _pieces(texts: pd.Series) -> Iterator[pd.Series]:
    """A batch in pieces of a megabyte, or of one text, so that a worker holds no more results than those of a piece."""
    size = texts.str.len().fillna(0).cumsum().to_numpy()
    low = 0
    while low < len(texts):
        high = max(low + 1, int(size.searchsorted((size[low - 1] if low else 0) + PIECE, side="right")))
        yield texts.iloc[low:high]
        low = high


def _parsed(parse: Callable[[str], list[str]], between: str) -> Callable[[SparkSession, str], DataFrame]:
    """Reads files of documents with a line ``between`` them; large files are split there."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def documents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield from (x.map(parse) for x in _pieces(b))

    def read(spark: SparkSession, path: str) -> DataFrame:
        rows = _texts(spark, path, lineSep=f"\n{between}\n").select("_path", F.explode(documents("value")).alias("json"))
        return rows.select("_path", F.parse_json("json").alias("doc"))

    return read


def _objects(rows: DataFrame, hint: str) -> DataFrame:
    """Rows of _path and value (JSON) as documents; anything but an object is an error."""
    rows = rows.select("_path", F.try_parse_json("value").alias("doc"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False))
    bad = F.parse_json(raised("string", BackendError, "the document is not an object in ", F.col("_path"), hint))
    return rows.select("_path", F.when(is_object, F.col("doc")).otherwise(bad).alias("doc"))


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A document a line; large files are split between lines."""
    return _objects(_texts(spark, path).filter(F.trim("value") != ""), "; documents of several lines are read as json-file")


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    """A document a file, over any number of lines."""
    return _objects(_texts(spark, path, wholetext=True), "")


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """By lines or by files, as the first line that is read is a whole document or not."""
    first = _texts(spark, path).filter(F.trim("value") != "").select("value").first()
    try:
        by_line = first is None or isinstance(json.loads(first["value"]), dict)
    except ValueError:
        by_line = False
    return (_read_lines if by_line else _read_files)(spark, path)


def _write_json(docs: DataFrame, path: str, mode: str, defaults: dict, key: str) -> None:
    docs.write.mode(mode).text(path)


def _writer(emit: Callable[[dict, dict, str], str], between: str) -> Callable[[DataFrame, str, str, dict, str], None]:
    def write(docs: DataFrame, path: str, mode: str, defaults: dict, key: str) -> None:
        @F.pandas_udf(T.StringType())
        def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                for part in _pieces(b):
                    yield part.map(lambda x: between + "\n" + emit(json.loads(x), defaults, key))

        docs.select(rendered("value").alias("value")).write.mode(mode).text(path)

    return write


register_format(["json"], Format("json", _read_json, _write_json))
register_format(["jsonl"], Format("jsonl", _read_lines, _write_json))
register_format(["json-file"], Format("json-file", _read_files))
register_format(["yaml", "yml"], Format("yaml", _parsed(text.from_yaml, "---"), _writer(text.to_yaml, "---"), opens=True))
register_format(["toml"], Format("toml", _parsed(text.from_toml, text.TOML_BREAK), _writer(text.to_toml, text.TOML_BREAK), opens=True))
register_format(["parquet"], Format("parquet", lambda spark, path: spark.read.option("mergeSchema", "true").parquet(path)))


# arrays in text formats


def _has_arrays(tp: Any) -> bool:
    tp = unwrap(tp)
    return is_array(tp) or any(map(_has_arrays, tp.fields.values() if hasattr(tp, "record_name") else typing.get_args(tp)))


@F.pandas_udf(T.StringType())
def _opened(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield from (x.map(text.opened, na_action="ignore") for x in _pieces(b))


_opened = _opened.asNondeterministic()  # or the check of a row's version, which reads the document, would open it once more


def open_arrays(docs: DataFrame) -> DataFrame:
    """Documents with their marked arrays as dtype, shape and data; only documents with a mark go to Python."""
    rows = docs.withColumn("_json", F.to_json("doc"))
    marked = F.lit(False)
    for mark in text.NDARRAY_MARKS:
        marked = marked | F.contains("_json", F.lit(mark))
    rows = rows.withColumn("_json", _opened(F.when(marked, F.col("_json"))))
    return rows.withColumn("doc", F.when(F.col("_json").isNull(), F.col("doc")).otherwise(F.parse_json("_json"))).drop("_json")


# compression of the native store


_GZIP_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


@dataclass(frozen=True)
class Compression:
    algorithm: str | None
    level: int | None = None

    def options(self) -> dict[str, str]:
        if self.algorithm is None:
            return {"compression": "none"}
        out = {"compression": self.algorithm}
        if self.level is not None and self.algorithm in ("zstd", "gzip"):
            if self.algorithm == "zstd":
                out["parquet.compression.codec.zstd.level"] = str(self.level)
            else:
                out["zlib.compress.level"] = _GZIP_LEVELS[self.level]
        return out


GZIP_DEFAULT = Compression("gzip", 4)
ZSTD_DEFAULT = Compression("zstd", 3)
ZSTD_FAST = Compression("zstd", 1)
ZSTD_BEST = Compression("zstd", 9)
BLOCK_DEFAULT = Compression("zstd", 5)
LZ4 = Compression("lz4")
UNCOMPRESSED = Compression(None)


# load


def selected(record: RecordType, preload: list[str] | str | None, metadata_only: bool) -> list[str]:
    """The columns of a load: scalars, and the arrays that are asked for by name or by ``*``."""
    arrays = record.arrays()
    if metadata_only:
        return [n for n in record.fields if n not in arrays]
    if preload == "*" or preload is None:
        return list(record.fields)
    if missing := [n for n in preload if n not in record.fields]:
        raise ArrayNotLoadedError(f"{record.record_name} has no field {missing[0]}")
    return [n for n in record.fields if n not in arrays or n in preload]


def load(
    spark: SparkSession,
    record: RecordType,
    path: str,
    *,
    format: str | None = None,
    preload: list[str] | str | None = None,
    metadata_only: bool = False,
    upgrade: bool = False,
    assume: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """The documents under a path as rows of the record type.

    ``strict`` keeps to documents that name this record type. Nothing is read
    until an action, and then only the columns that it needs.
    """
    fmt = format_for(path, format)
    if fmt.name == "parquet":
        df = fmt.read(spark, path)
        names = None
        if "_env" in df.columns:
            df = df.withColumn("_v", F.col("_env.version"))
            if "fields" in df.schema["_env"].dataType.names:
                names, df = "_names", df.withColumn("_names", F.col("_env.fields"))
            if strict:
                df = df.filter(F.col("_env.object").isin(record.record_name, *record.old_names))
            df = df.drop("_env")
        mixed = "_v" in df.columns
        out = record.migrate(df, "_v" if mixed else None, assume=assume, upgrade=upgrade, sparse=mixed, names=names)
    else:
        docs = fmt.read(spark, path)
        if not fmt.opens and any(map(_has_arrays, record.fields.values())):
            docs = open_arrays(docs)
        if strict:
            docs = docs.filter(env.read(F.col("doc"), "object", record.envelope_key).isin(record.record_name, *record.old_names))
        out = record.load_variant(docs, assume=assume, upgrade=upgrade)
    return out.select(*selected(record, preload, metadata_only), *(c for c in out.columns if c == REST))


def load_dynamic(spark: SparkSession, path: str, *, format: str | None = None, base: RecordType | None = None, key: str = env.ENVELOPE, **options: Any) -> dict[str, DataFrame]:
    """A frame for each record type that the documents name.

    The names, as many as there are record types, go to the driver.
    """
    fmt, types = format_for(path, format), registered()
    docs = fmt.read(spark, path)
    name = F.col("_env.object") if fmt.name == "parquet" else env.read(F.col("doc"), "object", key)
    out: dict[str, list[str]] = {}
    for (stored,) in docs.select(name.alias("object")).distinct().collect():
        record = types.get(stored)
        if record is None:
            raise BackendError(f"no record type is named {stored!r}")
        if base is not None and not record.is_a(base):
            raise BackendError(f"{stored!r} is not a {base.record_name}")
        out.setdefault(record.record_name, []).append(stored)
    return {n: load(spark, types[n], path, format=format, strict=True, **options) for n in out}


# save


def wire_default(value: Any) -> Any:
    """A default in the form that a document has it."""
    value = value() if callable(value) and not isinstance(value, enum.Enum) else value
    if isinstance(value, enum.Enum):
        return value.value
    if isinstance(value, (set, frozenset)):
        return [wire_default(v) for v in sorted(value, key=repr)]
    if isinstance(value, (list, tuple)):
        return [wire_default(v) for v in value]
    if isinstance(value, dict):
        return {str(k): wire_default(v) for k, v in value.items()}
    return value if isinstance(value, (int, float, str, bool, type(None))) else str(value)


def document(record: RecordType, skip_defaults: bool | None = None, rest: bool = False) -> Column:
    """A row's document as JSON; its fields in order, the envelope last.

    With ``skip_defaults`` top-level fields at their default are left out; with
    ``rest`` the fields that a load preserved come before the envelope.
    """
    skip = record.skip_defaults if skip_defaults is None else skip_defaults
    parts = []
    for n, t in record.fields.items():
        one = F.to_json(F.struct(codecs.encode(F.col(f"`{n}`"), t).alias(n)), {"ignoreNullFields": "false"})
        inner = F.substr(one, F.lit(2), F.length(one) - 2)
        if skip and n in record.defaults:
            default = F.to_json(F.struct(codecs.encode(codecs.literal(record.defaults[n], t), t).alias(n)), {"ignoreNullFields": "false"})
            inner = F.when(one != default, inner)
        parts.append(inner)
    if rest:
        kept = F.to_json(F.col(REST))
        parts.append(F.when(F.size(REST) > 0, F.substr(kept, F.lit(2), F.length(kept) - 2)))
    envelope = F.to_json(F.struct(record.envelope_struct()))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, F.substr(envelope, F.lit(2), F.length(envelope) - 2)), F.lit("}"))


def _envelope(record: RecordType) -> Column:
    """The envelope of a store, which lists the fields, as files of several versions are merged when read."""
    return F.struct(F.lit(record.record_name).alias("object"), F.lit(record.version).alias("version"), F.lit(record.hash).alias("hash"), F.lit(list(record.fields)).alias("fields"))


def _stored(c: Column, tp: Any) -> Column:
    """A column for a store: records inside it get an envelope."""
    tp = unwrap(tp)
    origin, args = typing.get_origin(tp), typing.get_args(tp)
    if is_union(tp) and len(members(tp)) == 1:
        return _stored(c, members(tp)[0])
    if hasattr(tp, "record_name"):
        return F.when(c.isNotNull(), F.struct(*(_stored(c[n], t).alias(n) for n, t in tp.fields.items()), _envelope(tp).alias("_env")))
    if origin in (list, tuple, set, frozenset) and hasattr(unwrap(args[0]), "record_name"):
        return F.transform(c, lambda x: _stored(x, args[0]))
    if origin is dict and hasattr(unwrap(args[1]), "record_name"):
        return F.transform_values(c, lambda _, x: _stored(x, args[1]))
    return c


def save(
    df: DataFrame,
    record: RecordType,
    path: str,
    *,
    format: str | None = None,
    mode: str = "errorifexists",
    comment_defaults: bool = False,
    compression: Compression = GZIP_DEFAULT,
    mark_arrays: bool | None = None,
) -> None:
    """Rows of the record type as documents, or as Parquet with their envelope.

    Arrays become marked archives, as ``mark_arrays`` says; by default in YAML
    and TOML, while JSON keeps them as dtype, shape and data.
    """
    fmt = format_for(path, format)
    if fmt.name == "parquet":
        fields = [_stored(F.col(f"`{n}`"), t).alias(n) for n, t in record.fields.items()]
        df.select(*fields, _envelope(record).alias("_env")).write.mode(mode).options(**compression.options()).parquet(path)
        return
    if fmt.write is None:
        raise BackendError(f"format {fmt.name} cannot be written")
    defaults = {n: wire_default(v) for n, v in record.defaults.items()} if comment_defaults else {}
    arrays, rendered = record.arrays(), fmt.name in ("yaml", "toml")
    marks = bool(arrays) and (rendered if mark_arrays is None else mark_arrays)
    if rendered or marks:  # a small file may hold many rows: Python takes them on all cores, whatever the scan's tasks
        df = df.hint("rebalance")
    docs = df.select(document(record, rest=REST in df.columns).alias("value"))
    if marks:

        @F.pandas_udf(T.StringType())
        def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                for part in _pieces(b):
                    yield part.map(lambda x: text.marked(x, arrays))

        docs = docs.select(marked("value").alias("value"))
    fmt.write(docs, path, mode, defaults, record.envelope_key)


def rewrite(spark: SparkSession, record: RecordType, source: str, target: str, **options: Any) -> None:
    """Documents brought to the current version, in a new place."""
    save(load(spark, record, source, upgrade=True), record, target, **options)


__all__ = ["Compression", "Format", "format_for", "load", "load_dynamic", "register_format", "rewrite", "save"]
