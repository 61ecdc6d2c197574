"""Groups out of a sorted stream of Arrow batches.

A partition that is dealt and sorted by a key holds each of its groups whole
and in one run, so a Python worker can take them in turn without a call from
the JVM for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the row where each starts, and the end.

    The first ``keys`` columns are the key, of integers without nulls. Only
    the group at a batch's end is held over to the next.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in range(keys):
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] and batch.column(k)[-1] == batch.column(k)[0] for k in range(keys)):
            held.append(batch)  # a long group goes on
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table)
        if at[-1]:
            yield table.slice(0, at[-1]), at
        held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts(table), table.num_rows)


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            at = np.frombuffer(c.buffers()[1], dtype=np.int32, count=len(c) + 1, offset=4 * c.offset)
            parts.append(np.frombuffer(c.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(c), width))
    return np.concatenate(parts) if parts else np.zeros((0, width), dtype=dtype)
