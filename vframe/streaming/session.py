"""Sessions: a record that grows in place and can be taken up again.

A session keeps under its path an envelope, a log of changes to scalars, lists
and maps, and chunk rows for arrays. An array of several axes grows along one,
which its first append settles and later sessions keep; a chunk holds whole
slices along it, flat. All writes are appends of whole batches,
so a lost executor or driver leaves the last flushed state. The current state
is the last change for each key.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vframe.errors import BackendError, VersionError
from vframe.functions.types import is_array, spark_type
from vframe.operators import arrays
from vframe.plans.record import RecordType
from vframe.sources.formats import GZIP_DEFAULT, Compression, wire_default

LOG = "field string, key string, idx bigint, seq bigint, op string, value string"


def last_values(log: DataFrame, keys: list[str], seq: Column, value: Column, deleted: Column | None = None) -> DataFrame:
    """The last change of each key, without keys whose last change deletes them.

    ``seq`` must tell any two changes of a key apart. One partial aggregation,
    so a key with many changes costs no more than one row a partition.
    """
    gone = F.lit(False) if deleted is None else deleted
    last = log.groupBy(*keys).agg(F.max_by(F.struct(value.alias("value"), gone.alias("gone")), seq).alias("last"))
    return last.filter(~F.col("last.gone")).select(*keys, F.col("last.value").alias("value"))


class TrackedList:
    """A list field: append, extend, and assignment by index. Nothing else can be logged."""

    def __init__(self, session: Session, field: str):
        self._session, self._field = session, field
        self._n = session._length(field)

    def __len__(self) -> int:
        return self._n

    def append(self, value: Any) -> None:
        self.extend([value])

    def extend(self, values: Iterable[Any]) -> None:
        for v in values:
            self._session._change(self._field, "set", v, idx=self._n)
            self._n += 1

    def __setitem__(self, i: int, value: Any) -> None:
        if not isinstance(i, int):
            raise BackendError("a slice of a session's list cannot be assigned")
        at = i + self._n if i < 0 else i
        if not 0 <= at < self._n:
            raise IndexError(i)
        self._session._change(self._field, "set", value, idx=at)

    def _refuse(self, *_: Any, **__: Any) -> None:
        raise BackendError("a session's list only grows or changes by index")

    insert = pop = remove = sort = reverse = __delitem__ = clear = _refuse


class TrackedDict:
    """A map field: assignment, deletion and update by key."""

    def __init__(self, session: Session, field: str):
        self._session, self._field = session, field

    def __setitem__(self, key: Any, value: Any) -> None:
        self._session._change(self._field, "set", value, key=str(key))

    def __delitem__(self, key: Any) -> None:
        self._session._change(self._field, "delete", None, key=str(key))

    def update(self, values: dict) -> None:
        for k, v in values.items():
            self[k] = v


class Session:
    """``mode`` is create, overwrite, resume or read.

    ``chunk_rows`` is a number for all arrays or one for each field; ``axis``
    names the axis along which a field's array grows, where its first append
    does not tell.
    """

    def __init__(
        self, spark: SparkSession, record: RecordType, path: str, mode: str = "create", compression: Compression = GZIP_DEFAULT,
        chunk_rows: int | dict[str, int] | None = None, axis: dict[str, int] | None = None,
    ):
        if mode not in ("create", "overwrite", "resume", "read"):
            raise BackendError(f"no such mode: {mode}")
        self.spark, self.record, self.path, self.mode, self.compression, self.chunk_rows = spark, record, path.rstrip("/"), mode, compression, chunk_rows
        self.axis = dict(axis or {})
        self._held: list[tuple] = []
        self._closed, self._seq = False, 0

    def _write(self, df: DataFrame, name: str, mode: str = "append") -> None:
        df.write.mode(mode).options(**self.compression.options()).parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def __enter__(self) -> Session:
        envelope = self.spark.range(1).select(self.record.envelope_struct().alias("_env")).select("_env.*")
        if self.mode == "create":
            self._write(envelope, "envelope", "errorifexists")
        elif self.mode == "overwrite":
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            self._write(envelope, "envelope", "errorifexists")
        else:
            if not self._exists("envelope"):
                raise BackendError(f"no session at {self.path}")
            stored = self.spark.read.parquet(f"{self.path}/envelope").first()
            own = (self.record.record_name, self.record.version, self.record.hash)
            if self.mode == "resume" and tuple(stored) != own:
                raise VersionError(f"the session holds {tuple(stored)}, not {own}; sessions are not migrated")
            if self._exists("log"):
                self._seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self.flush()
            self._warn()
        self._closed = True

    def _warn(self) -> None:
        if self.mode == "read":
            return
        state = {r["field"] for r in self.log().select("field").distinct().collect()} if self._exists("log") else set()
        if self._exists("chunks"):
            state |= {r["field"] for r in self.spark.read.parquet(f"{self.path}/chunks").select("field").distinct().collect()}
        if unset := [n for n in self.record.fields if n not in state and n not in self.record.defaults]:
            warnings.warn(f"{self.record.record_name}: required fields were not set: {', '.join(unset)}", stacklevel=3)

    def _open(self) -> None:
        if self._closed:
            raise BackendError("the session is closed")
        if self.mode == "read":
            raise BackendError("the session is open for reading only")

    def _change(self, field: str, op: str, value: Any, key: str | None = None, idx: int | None = None) -> None:
        self._open()
        if field not in self.record.fields:
            raise BackendError(f"{self.record.record_name} has no field {field}")
        self._held.append((field, key, idx, self._seq, op, json.dumps(wire_default(value))))
        self._seq += 1

    def set(self, field: str, value: Any) -> None:
        """A scalar's value, a whole list or a whole map."""
        if isinstance(value, (list, tuple)):
            self._change(field, "clear", None)
            for i, v in enumerate(value):
                self._change(field, "set", v, idx=i)
        elif isinstance(value, dict):
            self._change(field, "clear", None)
            TrackedDict(self, field).update(value)
        else:
            self._change(field, "set", value)

    def populate(self, values: dict[str, Any]) -> None:
        """Everything that an instance holds: arrays are appended, all else is set."""
        for field, value in values.items():
            if is_array(self.record.fields.get(field)):
                self.append(field, value)
            else:
                self.set(field, value)

    def list(self, field: str) -> TrackedList:
        return TrackedList(self, field)

    def map(self, field: str) -> TrackedDict:
        return TrackedDict(self, field)

    def _length(self, field: str) -> int:
        self.flush()
        if not self._exists("log"):
            return 0
        n = self._live().filter((F.col("field") == field) & F.col("idx").isNotNull()).agg(F.max("idx")).first()[0]
        return 0 if n is None else n + 1

    def append(self, field: str, values: DataFrame | np.ndarray | list, doc_id: int = 0) -> None:
        """More elements of an array: a frame of doc_id and vals (one axis), or an array of the driver's.

        An array has any number of axes; all but the one that grows must be as
        they were.
        """
        self._open()
        tp = self.record.fields[field]
        element = spark_type(tp)["data"].dataType.elementType
        own = self.chunk_rows.get(field) if isinstance(self.chunk_rows, dict) else self.chunk_rows
        before = self._exists("chunks")
        if not isinstance(values, DataFrame):
            new = np.asarray(values, dtype=tp.dtype)
            if new.ndim > 1:
                self._append_slices(field, new, doc_id, own)
                return
            values = self.spark.createDataFrame([(doc_id, new.tolist())], f"doc_id bigint, vals array<{element.simpleString()}>")
        more = values.select("doc_id", F.col("vals").cast(f"array<{element.simpleString()}>").alias("vals"))
        rows = arrays.chunk_rows((0,), tp.dtype, 0, own)
        if before:
            self._write(arrays.append(self.chunks(field), more, field, rows, tp.dtype), "chunks")
        else:
            self._write(arrays.to_chunks(more.withColumnRenamed("vals", field), "doc_id", field, rows, tp.dtype), "chunks")

    def _append_slices(self, field: str, new: np.ndarray, doc_id: int, rows: int | None) -> None:
        tp = self.record.fields[field]
        last = self.chunks(field).filter(F.col("doc_id") == doc_id).orderBy(F.desc("chunk_no")).select("shape", "chunk_no").first() if self._exists("chunks") else None
        stored = self._axis(field)
        if last is None:
            axis = stored if stored is not None else arrays.append_axis(new.shape, self.axis.get(field))
            have, number = tuple(0 if i == axis else n for i, n in enumerate(new.shape)), 0
        else:
            axis, have, number = stored or 0, tuple(last["shape"]), last["chunk_no"] + 1
        if stored is None:
            self._change(field, "axis", axis)
            self.flush()
        shape = arrays.appended_shape(have, new.shape, axis)
        moved = np.moveaxis(new, axis, 0)
        step = arrays.chunk_rows(shape, tp.dtype, axis, rows)
        found = [(doc_id, field, number + i, have[axis] + low, tp.dtype, list(shape), moved[low : low + step].ravel().tolist()) for i, low in enumerate(range(0, len(moved), step))]
        element = spark_type(tp)["data"].dataType.elementType.simpleString()
        schema = f"doc_id bigint, field string, chunk_no int, start int, dtype string, shape array<int>, vals array<{element}>"
        if found:
            self._write(self.spark.createDataFrame(found, schema), "chunks")

    def _axis(self, field: str) -> int | None:
        """The axis that an earlier append settled."""
        if not self._exists("log"):
            return None
        row = self.log().filter((F.col("field") == field) & (F.col("op") == "axis")).orderBy("seq").first()
        return None if row is None else int(json.loads(row["value"]))

    def ndarray(self, field: str, doc_id: int = 0) -> np.ndarray:
        """One array as it is now, in the driver."""
        if self._closed:
            raise BackendError("the session is closed")
        parts = self.chunks(field).filter(F.col("doc_id") == doc_id).orderBy("chunk_no").select("shape", "vals").collect()
        dtype = self.record.fields[field].dtype
        if not parts:
            return np.zeros(0, dtype=dtype)
        shape, axis = tuple(parts[-1]["shape"]), self._axis(field) or 0
        flat = np.array([x for p in parts for x in p["vals"]], dtype=dtype)
        return np.moveaxis(flat.reshape((shape[axis], *(n for i, n in enumerate(shape) if i != axis))), 0, axis)

    def flush(self) -> None:
        if self._held:
            self._write(self.spark.createDataFrame(self._held, LOG), "log")
            self._held = []

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def _live(self) -> DataFrame:
        """Changes since each field's last clearing."""
        log = self.log()
        cleared = log.filter(F.col("op") == "clear").groupBy("field").agg(F.max("seq").alias("since"))
        # a row for each field at most
        return log.join(F.broadcast(cleared), "field", "left").filter(~F.col("op").isin("clear", "axis") & (F.col("seq") > F.coalesce("since", F.lit(-1)))).drop("since")

    def state(self) -> DataFrame:
        """field, key, idx and value (JSON) as they are now."""
        return last_values(self._live(), ["field", "key", "idx"], F.col("seq"), F.col("value"), F.col("op") == "delete")

    def chunks(self, field: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks").filter(F.col("field") == field)

    def array(self, field: str) -> DataFrame:
        """doc_id and vals of an array field as it is now."""
        if self._closed:
            raise BackendError("the session is closed")
        return arrays.joined(self.chunks(field))


def append_stream(stream: DataFrame, path: str, checkpoint: str, compression: Compression = GZIP_DEFAULT) -> None:
    """Appends what a stream has now; with the same checkpoint a later call takes up where it ended."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query = writer.options(**compression.options()).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
