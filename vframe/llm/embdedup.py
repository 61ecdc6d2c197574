"""Embedding near-duplicates: random-hyperplane signs, exact cosines, components.

Equal vectors are one class, which goes on as one row. Each table hashes a
vector to the signs of its products with ``bits`` random directions. A pair
at the threshold's angle shares a table with probability p ** bits; the
number of tables follows from the chosen miss probability and the bits grow
with the logarithm of the rows, so cells stay small. To a cell go the signs of
all tables, a few dozen bytes, and not the vectors: a pair whose signs differ
in more places than pairs at the threshold's angle ever do (by eight standard
deviations) is no link. Only rows that still have a partner are sent again
with their vectors, and compared in blocks of bounded size as matrix products
in double precision. A block gives each row its number of links (a pair
counts in the first table it shares only) and its component within the block,
never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, link with nothing and are kept as their
own component; vectors of different lengths do not link; repeated rows count
as links of each other and each give a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm import vectors
from vframe.llm.common import Scratch, parts
from vframe.llm.components import components
from vframe.llm.streams import runs

#: Rows of a cell that are compared together.
BLOCK = 1024


def plan(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for so many rows."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(12, math.ceil(math.log2(max(rows, 1) / 16))))
    return bits, math.ceil(math.log(miss) / math.log(1 - p**bits))


def most_apart(threshold: float, n: int) -> int:
    """Of ``n`` signs, as many as a pair at the threshold's angle may differ in."""
    p = math.acos(threshold) / math.pi
    return math.ceil(n * p + 8 * math.sqrt(n * p * (1 - p)))


def signs(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The signs of each row, rows x tables x bits."""
    rng = np.random.default_rng([seed, x.shape[1]])
    planes = rng.standard_normal((x.shape[1], tables * bits))
    return (x @ planes > 0).reshape(len(x), tables, bits)


def cells(found: np.ndarray) -> np.ndarray:
    """The cell of each row in each table."""
    return (found << np.arange(found.shape[2])).sum(axis=2).astype("<i4")


def _hash(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in vectors.by_width(b.column(2)):
                found = signs(vectors.units(x), bits, tables, seed)
                at, packed = cells(found), np.packbits(found.reshape(len(x), -1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)),
                        b.column(1).take(pa.array(rows)),
                        pa.array(np.full(len(rows), x.shape[1], np.int32)),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.array([v.tobytes() for v in packed], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, tables, dtype=np.int32)), pa.array(at.ravel())),
                    ],
                    names=["rep", "copies", "width", "vector", "signs", "cells"],
                )

    return run


CELL = "width int, table int, cell int, i int, j int, block int, rep bigint"


def _partnered(apart: int):
    """Over rows of CELL and their signs, sorted by the first five: those with a partner that may be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, at in runs(batches, 5):
            first, second, block = (data.column(i).to_numpy() for i in (3, 4, 5))
            raw, kept = data.column(7).to_pylist(), []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                packed = np.frombuffer(b"".join(raw[low:high]), dtype=np.uint8).reshape(high - low, -1)
                packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
                differ = np.zeros((len(packed), len(packed)), dtype=np.int32)
                for word in packed.T:
                    differ += np.bitwise_count(word[:, None] ^ word[None, :])
                near = differ <= apart
                np.fill_diagonal(near, False)
                if first[low] != second[low]:
                    near &= block[low:high, None] != block[None, low:high]
                kept.append(low + np.flatnonzero(near.any(axis=1)))
            if kept:
                yield from data.select(range(7)).take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``threshold`` or more."""
    near = vectors.units(x) @ vectors.units(y).T
    out = near >= threshold
    for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-12), strict=True):
        out[i, j] = vectors.cosine(x[i : i + 1], y[j : j + 1])[0] >= threshold
    return out


def _compare(threshold: float, bits: int, tables: int):
    """Over rows of CELL, copies, vector and signs, sorted by the first five: rep, links and the least rep it is joined to in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, at in runs(batches, 5):
            column = [data.column(i).to_numpy() for i in range(8)]
            _, table, _, first, second, block, rep, copies = column
            raw, packed = data.column(8), data.column(9)
            out = []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                ids, n = rep[low:high], copies[low:high]
                x = np.stack([np.frombuffer(v.as_buffer(), "<f4") for v in raw.slice(low, high - low)])
                links = linked(x, x, threshold)
                if first[low] != second[low]:
                    side = block[low:high]
                    links &= side[:, None] != side[None, :]
                links &= ids[:, None] != ids[None, :]
                if not links.any():
                    continue
                least = ids.copy()
                while True:  # labels spread over the block's links
                    step = np.minimum(least, np.where(links, least[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (step == least).all():
                        break
                    least = step
                own = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in packed.slice(low, high - low)])
                own = cells(np.unpackbits(own, axis=1)[:, : tables * bits].reshape(len(ids), tables, bits))
                for t in range(int(table[low])):
                    links &= own[:, t][:, None] != own[:, t][None, :]
                total = (links * n[None, :]).sum(axis=1)
                some = (total > 0) | (least != ids)
                out.append((ids[some], total[some], least[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "links", "least"])

    return run


def find_duplicates(data: DataFrame, threshold: float = 0.95, miss: float = 1e-4, seed: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``data`` (vec_id, embedding)."""
    spark = data.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.read(data).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(seed), "embedding").alias("h2"))
    # a class has the same 128 bits of hash; its least id stands for it, and only that row's vector goes on
    keys = scratch.table(rows.drop("embedding"), "keys")
    classes = scratch.table(keys.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = scratch.table(keys.join(classes, ["h1", "h2"]).select("vec_id", "rep", "copies").distinct(), "members")
    stands = rows.join(classes.withColumn("vec_id", F.col("rep")), ["vec_id", "h1", "h2"])
    stands = stands.groupBy("rep", "h1", "h2").agg(F.first("copies").alias("copies"), F.first("embedding").alias("embedding"))
    bits, tables = plan(keys.count(), threshold, miss)
    hashed = stands.select("rep", "copies", "embedding").mapInArrow(
        _hash(bits, tables, seed), "rep bigint, copies bigint, width int, vector binary, signs binary, cells array<int>"
    )
    hashed = scratch.table(hashed, "hashed")
    cell = ["width", "table", "cell"]
    key = [*cell, "i", "j"]
    spread = hashed.select("rep", "signs", "width", F.posexplode("cells").alias("table", "cell"))
    # cells of several blocks; few, for the cells are made to hold some dozens of rows
    large = hashed.select("width", F.posexplode("cells").alias("table", "cell")).groupBy(*cell).count()
    large = large.filter(F.col("count") > BLOCK).select(*cell, F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    spread = spread.join(large, cell, "left").withColumn("blocks", F.coalesce("n", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(*cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "signs")
    spread = spread.repartition(parts(spark), *key).sortWithinPartitions(*key)
    near = scratch.table(spread.mapInArrow(_partnered(most_apart(threshold, bits * tables)), CELL), "near")
    near = near.join(hashed.select("rep", "copies", "vector", "signs"), "rep").select(*near.columns, "copies", "vector", "signs")
    near = near.repartition(parts(spark), *key).sortWithinPartitions(*key)
    found = near.mapInArrow(_compare(threshold, bits, tables), "rep bigint, links bigint, least bigint")
    found = scratch.table(found, "links")
    links = scratch.table(found.groupBy("rep").agg(F.sum("links").alias("links")), "sums")
    joined = scratch.table(components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), scratch), "components")
    known = members.join(links, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    known = known.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    ids = data.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    component = F.coalesce("c", "vec_id")
    return ids.join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
