"""Approximate nearest neighbours by cross-polytope hashing.

A hash applies three rounds of random signs and a fast Hadamard transform to a
unit vector and takes the nearest signed axis. A table's cell is one hash or,
as the rows grow, several together, so that cells do not grow with the table.
Every row is indexed in every table. A query probes the cells of a table in
order of nearness, which is the sum of what each hash's axis falls short of
the nearest, squared; how many is fitted: on a bounded sample of rows the
smallest number is taken that reaches ``recall`` against brute force. Cells
hold blocks of a bounded number of rows (a large cell has several), queries
stream past a block, and each keeps its best of a block; the candidates are
scored exactly, in double precision, on the original vectors. A query whose
cells hold fewer than k other rows is compared with all rows, in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors of another
length than the query's are no candidates; rows that share an id count once,
with the nearest; ties go to the smaller id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vframe.llm import vectors
from vframe.llm.common import Scratch, parts
from vframe.llm.streams import runs

#: Rows that the number of probes is fitted on, and the queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 16_384, 512
#: Rows of a cell that are searched together.
BLOCK = 8192
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 15
#: Rows of a cell that another hash divides, and the most probes of a table with several hashes.
PER_CELL, MOST_PROBES = 64, 1024
#: Where queries are compared with all rows, a block has no fewer than this.
LEAST_BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Unit rows under a table's pseudo-rotation, padded to a power of two."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, n])
    for _ in range(3):
        y = hadamard(y * rng.choice((-1.0, 1.0), n))
    return y


def hashes(rows: int, width: int) -> int:
    """How many hashes a cell of so many rows' table has."""
    axes = 2 << max(0, int(width - 1).bit_length())
    return max(1, int(np.log(max(rows / PER_CELL, 1)) / np.log(axes)))


def cells(x: np.ndarray, tables: int, seed: int, m: int = 1) -> np.ndarray:
    """The cell of each row in each table: of each of its hashes the nearest axis, or the axis + n if negative."""
    out = np.zeros((len(x), tables), dtype=np.int64)
    for t in range(tables):
        for h in range(m):
            y = rotated(x, t * m + h, seed)
            axis = np.abs(y).argmax(axis=1)
            out[:, t] = out[:, t] * 2 * y.shape[1] + axis + y.shape[1] * (y[np.arange(len(y)), axis] < 0)
    return out


def probes(x: np.ndarray, tables: int, seed: int, count: int, m: int = 1) -> np.ndarray:
    """The ``count`` nearest cells of each row in each table, nearest first."""
    found = []
    for t in range(tables):
        cell, off = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for h in range(m):
            y = rotated(x, t * m + h, seed)
            both = np.concatenate((y, -y), axis=1)
            axis = np.argsort(-both, axis=1, kind="stable")[:, :count]
            value = np.take_along_axis(both, axis, axis=1)
            cell = (cell[:, :, None] * both.shape[1] + axis[:, None, :]).reshape(len(x), -1)
            off = (off[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(len(x), -1)
            order = np.argsort(off, axis=1, kind="stable")[:, :count]
            cell, off = np.take_along_axis(cell, order, axis=1), np.take_along_axis(off, order, axis=1)
        found.append(cell)
    return np.stack(found, axis=1)


def best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, id, score) of each query's ``k`` nearest other ids, each by its nearest row.

    All rows that rounding could put among the ``k`` nearest are scored
    exactly, so many pairs at a time that ties of any number take bounded memory.
    """
    near = vectors.units(queries) @ vectors.units(rows).T
    near[own[:, None] == ids[None, :]] = -np.inf
    by_id = near
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1)) if len(ids) else order
    if len(first) < len(ids):
        by_id = np.maximum.reduceat(near[:, order], first, axis=1)
    if by_id.shape[1] > k:
        least = np.maximum(np.partition(by_id, -k, axis=1)[:, -k] - 1e-9, -2.0)
    else:
        least = np.full(len(near), -2.0)
    wanted = near >= least[:, None]
    held = np.cumsum(wanted.sum(axis=1))
    out, low = [], 0
    while low < len(near):
        high = max(low + 1, int(np.searchsorted(held, (held[low - 1] if low else 0) + PAIRS, side="right")))
        q, r = np.nonzero(wanted[low:high])
        out.append(_nearest(q + low, r, queries, rows, ids, k))
        low = high
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), ids[:0], np.zeros(0))


def _nearest(q: np.ndarray, r: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of queries and rows, each query's ``k`` nearest ids with their exact scores."""
    score = vectors.cosine(queries[q], rows[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    _, once = np.unique(np.stack((q, ids[r])), axis=1, return_index=True)
    once.sort()
    q, r, score = q[once], r[once], score[once]
    kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[kept], ids[r[kept]], score[kept]


def fit_probes(ids: np.ndarray, sample: np.ndarray, tables: int, seed: int, k: int, recall: float, m: int = 1) -> int | None:
    """The smallest number of probes a table that reaches ``recall`` on the sample; None if no number of them does."""
    n = min(SAMPLE_QUERIES, len(sample))
    x = vectors.units(sample)
    q, found, _ = best(sample[:n], ids[:n], sample, ids, k)
    place = {v: i for i, v in enumerate(ids.tolist())}
    cell = cells(x, tables, seed, m)
    r = np.array([place[v] for v in found.tolist()], dtype=np.int64)
    need = np.full(len(q), np.inf)
    for low in range(0, n, 16):
        order = probes(x[low : low + 16], tables, seed, 1 << 30 if m == 1 else MOST_PROBES, m)
        for i in np.flatnonzero((q >= low) & (q < low + 16)).tolist():
            hit = order[q[i] - low] == cell[r[i]][:, None]
            need[i] = np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, np.inf).min()
    if not len(need):
        return 1
    least = np.sort(need)[max(0, int(np.ceil(recall * len(need))) - 1)]
    return None if np.isinf(least) else int(least)


def _index(tables: int, seed: int, m: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in vectors.by_width(b.column(1)):
                found = cells(vectors.units(x), tables, seed, m[x.shape[1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)),
                        pa.array(np.full(len(rows), x.shape[1], np.int32)),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, tables, dtype=np.int32)), pa.array(found.ravel())),
                    ],
                    names=["vec_id", "width", "vector", "cells"],
                )

    return run


def _probe(tables: int, seed: int, count: dict[int, int], m: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column(1).to_numpy()
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                for i in range(0, len(own), 16):
                    rows = own[i : i + 16]
                    x = np.stack([np.frombuffer(b.column(2)[int(r)].as_buffer(), "<f4") for r in rows])
                    found = probes(vectors.units(x), tables, seed, count[w], m[w])
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), found.shape[2]), len(rows))
                    each = pa.array(np.repeat(rows, found.shape[1] * found.shape[2]))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(each), b.column(1).take(each), b.column(2).take(each), pa.array(table), pa.array(found.reshape(-1))],
                        names=["vec_id", "width", "vector", "table", "cell"],
                    )

    return run


def _search(k: int):
    """Over rows (width, table, cell, block, is_query, vec_id, vector), sorted by the first five."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_ids, held = None, None, None
        for table, at in runs(batches, 5):
            whole = [table.column(i).to_numpy() for i in range(6)]
            raw = table.column(6)
            out = []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                now = tuple(int(whole[i][low]) for i in range(4))
                x = np.stack([np.frombuffer(v.as_buffer(), "<f4") for v in raw.slice(low, high - low)])
                ids = whole[5][low:high]
                if not whole[4][low]:
                    key, held_ids, held = now, ids, x
                elif key == now:
                    for i in range(0, len(x), 256):
                        q, v, s = best(x[i : i + 256], ids[i : i + 256], held, held_ids, k)
                        out.append((ids[i + q], v, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(
    data: DataFrame, is_query: Column, k: int = 5, tables: int = 4, recall: float = 0.97, seed: int = 11, scratch: Scratch | None = None
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row
    of ``data`` (vec_id, embedding) for which ``is_query`` holds."""
    spark = data.sparkSession
    scratch = scratch or Scratch(spark)
    read = vectors.read(data)
    totals = dict(read.groupBy(F.size("embedding")).count().collect())  # a row for each length of vectors
    m, count = {w: hashes(n, w) for w, n in totals.items()}, {}
    for width, n in totals.items():
        drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec_id"), 11) / float(1 << 53) < SAMPLE_ROWS / n
        sample = read.filter((F.size("embedding") == width) & drawn).select("vec_id", F.xxhash64("vec_id").alias("h"), "embedding").collect()
        sample.sort(key=lambda r: (r["h"], r["vec_id"], r["embedding"]))
        x, ids = np.array([r["embedding"] for r in sample], dtype=np.float32).reshape(-1, width), np.array([r["vec_id"] for r in sample], dtype=np.int64)
        while (found := fit_probes(ids, x, tables, seed, k, recall, m[width])) is None:
            m[width] -= 1  # with one hash all cells can be probed
        count[width] = found
    indexed = scratch.table(read.mapInArrow(_index(tables, seed, m), "vec_id bigint, width int, vector binary, cells array<bigint>"), "indexed")
    rows = indexed.select("vec_id", "width", "vector", F.posexplode("cells").alias("table", "cell"))
    counts = indexed.select("width", F.posexplode("cells").alias("table", "cell")).groupBy("width", "table", "cell").count()
    # as many rows as cells are occupied; broadcast by Spark where it is small
    blocks = scratch.table(counts.select("width", "table", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "blocks")
    asked = indexed.filter(is_query).select("vec_id", "width", "vector").mapInArrow(
        _probe(tables, seed, count, m), "vec_id bigint, width int, vector binary, table int, cell bigint"
    )
    cell, key = ["width", "table", "cell"], ["width", "table", "cell", "block", "is_query"]
    placed = rows.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("is_query", F.lit(0))
    probing = asked.join(blocks, cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_query", F.lit(1))
    both = placed.select(*key, "vec_id", "vector").unionByName(probing.select(*key, "vec_id", "vector"))
    result = scratch.table(_ranked(_searched(both, key, k), k), "found")
    # queries that found fewer than k of the rows there are
    counted = result.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    sizes = spark.createDataFrame([(w, n, max(-(-n // BLOCK), min(parts(spark), -(-n // LEAST_BLOCK)))) for w, n in totals.items()], "width int, total bigint, blocks int")
    n = F.coalesce("n", F.lit(0))
    short = indexed.filter(is_query).select("vec_id", "width", "vector").join(counted, "vec_id", "left").join(F.broadcast(sizes), "width")
    short = scratch.table(short.filter((n < k) & (n < F.col("total") - 1)).select("vec_id", "width", "vector", "blocks"), "short")
    if short.isEmpty():
        return result
    none = [F.lit(0).alias("table"), F.lit(0).cast("bigint").alias("cell")]
    all_rows = indexed.join(F.broadcast(sizes), "width").join(F.broadcast(short.select("width").distinct()), "width")
    placed = all_rows.select("width", *none, F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("is_query"), "vec_id", "vector")
    asking = short.select("width", *none, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("is_query"), "vec_id", "vector")
    return _ranked(result.drop("rank").unionByName(_searched(placed.unionByName(asking), key, k)), k)


def _searched(both: DataFrame, key: list[str], k: int) -> DataFrame:
    """query_id, vec_id and score of each query's best of each block."""
    placed = both.repartition(parts(both.sparkSession), *key[:4]).sortWithinPartitions(*key)
    return placed.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
