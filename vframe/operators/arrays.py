"""Large arrays as rows of chunks.

A chunk row has doc_id, field, chunk_no, start (its first row along the append
axis), dtype, shape (of the whole array when the chunk was written) and vals.
Slices read the chunks they touch: the condition on start is pushed to the
Parquet scan. Appends leave short chunks behind, so positions tell where a
chunk is, numbers only its place in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.errors import BackendError, fail

#: Bytes that a chunk aims at.
CHUNK_BYTES = 256 * 1024

ITEM_BYTES = {"int8": 1, "uint8": 1, "bool": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8, "complex64": 8, "complex128": 16}


def append_axis(shape: tuple[int, ...], axis: int | None = None) -> int:
    """The axis that grows: as told, else the only empty one, else the first."""
    if axis is not None:
        if shape and not -len(shape) <= axis < len(shape):
            raise BackendError(f"axis {axis} is out of range for shape {shape}")
        return axis % len(shape) if shape else axis
    empty = [i for i, n in enumerate(shape) if n == 0]
    if len(empty) > 1:
        raise BackendError(f"shape {shape} has several empty axes; state the one to append along")
    return empty[0] if empty else 0


def chunk_rows(shape: tuple[int, ...], dtype: str, axis: int = 0, rows: int | None = None) -> int:
    """Rows of a chunk along the append axis."""
    if rows is not None:
        return rows
    row = ITEM_BYTES[dtype]
    for i, n in enumerate(shape):
        row *= n if i != axis else 1
    return max(1, CHUNK_BYTES // row) if row else 1


def appended_shape(before: tuple[int, ...], more: tuple[int, ...], axis: int) -> tuple[int, ...]:
    """The shape after an append; the other axes must agree."""
    if len(before) != len(more) or any(a != b for i, (a, b) in enumerate(zip(before, more, strict=True)) if i != axis):
        raise BackendError(f"cannot append shape {more} to {before} along axis {axis}")
    return tuple(a + (more[i] if i == axis else 0) for i, a in enumerate(before))


def to_chunks(df: DataFrame, id_col: str, array_col: str, rows: int, dtype: str) -> DataFrame:
    """One-dimensional arrays of a column as chunk rows."""
    n = F.size(array_col)
    numbers = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / rows).cast("int"))
    made = F.transform(numbers, lambda k: F.struct(k.alias("chunk_no"), (k * rows).alias("start"), F.slice(F.col(array_col), k * rows + 1, F.lit(rows)).alias("vals")))
    flat = df.select(F.col(id_col).alias("doc_id"), F.array(n).alias("shape"), F.inline(made))
    return flat.select("doc_id", F.lit(array_col).alias("field"), "chunk_no", "start", F.lit(dtype).alias("dtype"), "shape", "vals")


def read_slice(chunks: DataFrame, start: int, stop: int, rows: int) -> DataFrame:
    """doc_id and vals of [start, stop) of every array, from the chunks it touches.

    ``rows`` is the most that a chunk holds. An array that ends before
    ``start`` gives no row or an empty one.
    """
    near = _touched(chunks, start, stop, rows)
    low = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    high = F.least(F.lit(stop) - F.col("start"), F.size("vals"))
    part = F.slice(F.col("vals"), low + 1, F.greatest(high - low, F.lit(0)))
    return joined(near.select("doc_id", "chunk_no", part.alias("vals")))


def _touched(chunks: DataFrame, start: int, stop: int, rows: int) -> DataFrame:
    return chunks.filter((F.col("start") > start - rows) & (F.col("start") < max(stop, start + 1)))


def joined(chunks: DataFrame) -> DataFrame:
    """doc_id and vals of whole arrays, chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "vals")))
    return chunks.groupBy("doc_id").agg(F.flatten(F.transform(parts, lambda c: c["vals"])).alias("vals"))


def append(chunks: DataFrame, more: DataFrame, field: str, rows: int, dtype: str) -> DataFrame:
    """New chunk rows for ``more`` (doc_id, vals), after what each array has.

    The last chunk is not refilled: an append only adds rows. Lengths come
    from the stored shapes; no value is read.
    """
    ends = chunks.groupBy("doc_id").agg(F.max(F.get("shape", F.lit(0))).alias("n"), (F.max("chunk_no") + 1).alias("next"))
    own = to_chunks(more.withColumnRenamed("vals", "_vals"), "doc_id", "_vals", rows, dtype).join(ends, "doc_id", "left")
    base, first = F.coalesce("n", F.lit(0)), F.coalesce("next", F.lit(0))
    shape = F.array(base + F.get("shape", F.lit(0)))
    number, start = (F.col("chunk_no") + first).cast("int"), (F.col("start") + base).cast("int")
    return own.select("doc_id", F.lit(field).alias("field"), number.alias("chunk_no"), start.alias("start"), F.lit(dtype).alias("dtype"), shape.alias("shape"), "vals")


def resize(chunks: DataFrame, n: int, rows: int, fill: Column | None = None) -> DataFrame:
    """Arrays cut or filled (with zero) to ``n``: chunks beyond go, the last is trimmed or padded."""
    zero = F.lit(0.0) if fill is None else fill
    kept = chunks.filter(F.col("start") < n)
    last = F.max("chunk_no").over(_by_doc())
    out = kept.withColumn("_last", F.col("chunk_no") == last)
    cut = F.slice(F.col("vals"), 1, F.least(F.size("vals"), F.lit(n) - F.col("start")))
    missing = F.greatest(F.lit(n) - F.col("start") - F.size("vals"), F.lit(0))
    full = F.when(F.col("_last"), F.concat(cut, F.array_repeat(zero, missing).cast(chunks.schema["vals"].dataType))).otherwise(cut)
    return out.select("doc_id", "field", "chunk_no", "start", "dtype", F.array(F.lit(n)).alias("shape"), full.alias("vals"))


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def update(chunks: DataFrame, start: int, stop: int, value: Column, rows: int) -> DataFrame:
    """The touched chunks with elements in [start, stop) replaced, to be written over the old ones."""
    near = _touched(chunks, start, stop, rows)
    changed = F.transform("vals", lambda x, i: F.when((F.col("start") + i >= start) & (F.col("start") + i < stop), value).otherwise(x))
    return near.withColumn("vals", changed.cast(chunks.schema["vals"].dataType))


def element(array: Column, i: int) -> Column:
    """By position, from the end if negative; null out of range."""
    return F.get(array, F.lit(i)) if i >= 0 else F.get(array, F.size(array) + i)


def checked_width(array: Column, width: int) -> Column:
    """An array, or an error if it has another length."""
    return F.when(array.isNull() | (F.size(array) == width), array).when(fail(BackendError, "length ", F.size(array), f" is not {width}").cast("string").isNull(), array)
