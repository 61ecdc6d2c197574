"""Mixture-controlled packing by deficit round-robin.

Documents are dealt to shards by a hash, encoded, and kept as chunks of a
bounded number of tokens. Within a chunk every source has a queue. Each window
gives every source a quantum, its target share of the window, on top of the
deficit it carries; the source is served up to that, and what an empty queue
could not use stays owed to it. A chunk starts with the deficits that all
chunks before it leave: what its sources should have had of those tokens less
what they had, known from token counts alone, so chunks are packed in
parallel. A shard's rows are sorted by a hash, so a rerun packs alike. What remains at a chunk's end is cut into sequences whose lengths
are powers of two, which need no padding.

Defined cases: a null text is an empty one and has only the end id; a null
source is a source of its own; repeated rows are packed each; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vframe.llm.common import Scratch, batch_rows, parts
from vframe.llm.encoding import encoder

CHUNKS = (
    "shard int, chunk int, within bigint, doc_id array<bigint>, source array<string>, n array<bigint>, "
    "before_source array<string>, before_n array<bigint>, ids binary"
)
PIECES = "doc_id bigint, source string, within bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: A chunk is closed by the document that takes it here.
CHUNK_TOKENS = 1 << 20


def _chunks(path: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        shard, chunk, total = TaskContext.get().partitionId(), 0, 0
        names, sources, counts, ids = [], [], [], []
        before: dict[str | None, int] = {}
        group = None

        def close() -> pa.RecordBatch:
            keys, n = list(before), np.concatenate(counts)
            of = [x for part in sources for x in part]
            row = {
                "shard": pa.array([shard], pa.int32()),
                "chunk": pa.array([chunk], pa.int32()),
                "within": pa.array([group], pa.int64()),
                "doc_id": pa.array([[x for part in names for x in part]], pa.list_(pa.int64())),
                "source": pa.array([of], pa.list_(pa.string())),
                "n": pa.array([n], pa.list_(pa.int64())),
                "before_source": pa.array([keys], pa.list_(pa.string())),
                "before_n": pa.array([[before[k] for k in keys]], pa.list_(pa.int64())),
                "ids": pa.array([b"".join(ids)], pa.binary()),
            }
            for s, x in zip(of, n.tolist(), strict=True):
                before[s] = before.get(s, 0) + x
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for b in batches:
            for low, high, found, n in own.encode(b.column(2)):
                ends = np.cumsum(n + 1)
                found = np.insert(found, np.cumsum(n), end_id).astype(width)
                groups = b.column(3).slice(low, high - low).to_numpy()
                change = np.append(np.flatnonzero(groups[1:] != groups[:-1]) + 1, high - low)
                place = 0  # of the slice's rows that are in a chunk
                while place < high - low:
                    if names and groups[place] != group:
                        yield close()
                        chunk, total = chunk + 1, 0
                        names, sources, counts, ids = [], [], [], []
                    group = int(groups[place])
                    done = int(ends[place - 1]) if place else 0
                    to = min(int(change[np.searchsorted(change, place, side="right")]), int(np.searchsorted(ends, done + CHUNK_TOKENS - total)) + 1)
                    names.append(b.column(0).slice(low + place, to - place).to_pylist())
                    sources.append(b.column(1).slice(low + place, to - place).to_pylist())
                    counts.append(n[place:to] + 1)
                    ids.append(found[done : int(ends[to - 1])].tobytes())
                    total, place = total + int(ends[to - 1]) - done, to
                    if total >= CHUNK_TOKENS:
                        yield close()
                        chunk, total = chunk + 1, 0
                        names, sources, counts, ids = [], [], [], []
        if names:
            yield close()

    return run


def allot(size: int, share: np.ndarray, deficit: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Tokens that each source gives to a window of ``size``; ``deficit`` is carried on.

    One round gives each source its quantum; further rounds share out what
    empty queues left.
    """
    deficit += share * size
    given = np.zeros(len(left), dtype=np.int64)
    owed = np.minimum(np.floor(np.maximum(deficit, 0)).astype(np.int64), left)
    if owed.sum() > size:
        owed = np.floor(owed * (size / owed.sum())).astype(np.int64)
    given += owed
    while (room := size - int(given.sum())) > 0:
        open_ = left > given
        weight = np.where(open_, share, 0.0)
        total = weight.sum()
        weight = weight / total if total > 0 else open_ / open_.sum()
        more = np.minimum(np.floor(weight * room).astype(np.int64), left - given)
        if not more.any():  # single tokens to those that are owed most
            order = np.argsort(-np.where(open_, deficit - given, -np.inf), kind="stable")
            more[order[: min(room, int(open_.sum()))]] = 1
        given += more
    deficit -= given
    return given


def lengths(total: int, window: int) -> list[int]:
    """Whole windows, then a power of two for each binary digit of the rest."""
    rest = total % window
    return [window] * (total // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_chunk(counts: np.ndarray, queue_of: np.ndarray, share: np.ndarray, deficit: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document's index, start, length, sequence, offset) of each piece of a chunk."""
    queues = [np.flatnonzero(queue_of == k).tolist() for k in range(len(share))]
    left = np.array([counts[q].sum() for q in queues], dtype=np.int64)
    at = [[0, 0] for _ in queues]
    deficit, pieces = deficit.astype(np.float64), []
    for sequence, size in enumerate(lengths(int(counts.sum()), window)):
        given, offset = allot(size, share, deficit, left), 0
        left -= given
        for k in np.flatnonzero(given).tolist():
            need, queue, place = int(given[k]), queues[k], at[k]
            while need:
                doc = queue[place[0]]
                n = min(need, int(counts[doc]) - place[1])
                pieces.append((doc, place[1], n, sequence, offset))
                need, offset, place[1] = need - n, offset + n, place[1] + n
                if place[1] == counts[doc]:
                    place[0], place[1] = place[0] + 1, 0
    return pieces


def _pack(window: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                row = {c: b.column(c)[0] for c in ("shard", "chunk")}
                shard, chunk = row["shard"].as_py(), row["chunk"].as_py()
                counts = np.asarray(b.column("n").flatten())
                names, sources = b.column("doc_id")[0].as_py(), b.column("source")[0].as_py()
                before = dict(zip(b.column("before_source")[0].as_py(), b.column("before_n")[0].as_py(), strict=True))
                ids = np.frombuffer(b.column("ids")[0].as_py(), dtype=width).astype("<u4")
                plan = {x["source"]: x for x in b.column("plan")[0].as_py()}
                keys = sorted(set(sources), key=lambda s: (s is None, s or ""))
                number = {s: k for k, s in enumerate(keys)}
                goal, gone = np.array([plan[s]["share"] for s in keys]), sum(before.values())
                deficit = np.array([plan[s]["carried"] + plan[s]["share"] * gone - before.get(s, 0) for s in keys])
                pieces = pack_chunk(counts, np.array([number[s] for s in sources]), goal, deficit, window)
                docs, start, length, sequence, offset = np.array(pieces, dtype=np.int64).T
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))[docs] + start
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(first.tolist(), (first + length).tolist(), strict=True)]
                docs_ = docs.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in docs_], pa.int64()),
                        pa.array([sources[d] for d in docs_], pa.string()),
                        pa.array(np.full(len(docs_), b.column("within")[0].as_py())),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(counts[docs]),
                        pa.array((shard << 44) + (chunk << 24) + sequence),
                        pa.array(offset),
                    ],
                    names=["doc_id", "source", "within", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 4096,
    weights: dict[str | None, float] | None = None,
    within: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text, source), each id in one piece.

    Documents of different values of the integer column ``within``, such as a
    mixture's output shard, are in different sequences; null counts as -1, and
    without a column all are 0.

    ``weights`` are the sources' target shares; by default their shares of all
    tokens, the only ones that every window can keep to the end. Tokens are
    counted by shard and source, and each shard gets a row with what every
    source that it holds is owed; of this only the sum of all weights goes through
    the driver.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    width = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
        (F.coalesce(F.col(within).cast("bigint"), F.lit(-1)) if within else F.lit(0).cast("bigint")).alias("within"),
    )
    dealt = rows.repartition(parts(spark), "within", F.pmod(key, F.lit(1 << 16))).sortWithinPartitions("within", key, "doc_id", "source")
    with batch_rows(spark, 2048, 4 << 20):
        chunks = scratch.table(dealt.mapInArrow(_chunks(tokenizer, end_id, width), CHUNKS), "chunks")
    flat = chunks.select("shard", F.explode(F.arrays_zip("source", "n")).alias("x"))
    had = scratch.table(flat.groupBy("shard", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n")), "had")
    plan = chunks.join(scratch.table(_owed(had, weights), "plan"), "shard")
    return plan.select(*chunks.columns, "plan").mapInArrow(_pack(window, width), PIECES)


def _owed(had: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """shard and plan: of each source that it holds, its share and what shards before it leave owed."""
    if weights is None:
        weight = had.groupBy("source").agg(F.sum("n").cast("double").alias("weight"))
    else:
        given = had.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        weight = had.select("source").distinct().join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weight.agg(F.sum("weight")).first()[0]
    weight = weight.select(F.col("source").alias("name"), (F.col("weight") / (total or 1.0)).alias("share"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = had.groupBy("shard").agg(F.sum("n").alias("tokens"))
    gone = F.coalesce(F.sum("tokens").over(earlier.orderBy("shard")), F.lit(0)).alias("gone")  # one row a shard
    own = F.coalesce(F.sum("n").over(earlier.partitionBy("source").orderBy("shard")), F.lit(0))
    rows = had.withColumn("own", own).join(shards.select("shard", gone), "shard").join(weight, F.col("source").eqNullSafe(F.col("name")))
    entry = F.struct("source", "share", (F.col("share") * F.col("gone") - F.col("own")).alias("carried"))
    return rows.groupBy("shard").agg(F.collect_list(entry).alias("plan"))
