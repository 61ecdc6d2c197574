"""Token ids as a Parquet list column with selective reads.

Documents are dealt by ranges of their id, whose bounds are drawn from the ids
alone, and sorted, so the files hold them in ascending order; an id that is as
frequent as several ranges has them all. Ids use dictionary encoding (a token id needs the bits of
the vocabulary, not 32), document ids and positions use delta encoding, row
groups are small and carry page indexes, so a reader of a few documents or of
metadata alone skips the token pages.

Defined cases: a null text is an empty one and has only the end id; a null
document id sorts first; rows with the same id are all kept, ordered by text
within their file; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vframe.llm.common import batch_rows, parts
from vframe.llm.encoding import encoder

SCHEMA = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>"

#: Of the Parquet writer. The column settings follow the ``#``.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_shard": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for batch in batches:
            for low, high, ids, n in own.encode(batch.column(1)):
                ends = np.cumsum(n + 1)
                values = np.insert(ids, np.cumsum(n), end_id).astype("<i4", copy=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.full(high - low, shard, dtype=np.int32)),
                        pa.array(start + ends - n - 1),
                        pa.array(n + 1),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values)),
                    ],
                    names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def ranged(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt to ``shards`` ranges of doc_id, null first.

    The bounds are quantiles of doc_id, read without the texts. A value that
    is several bounds is dealt over their ranges by a hash of the text.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint"))
    share = [(i + 1) / shards for i in range(shards - 1)]
    bounds = docs.select(F.percentile_approx(key, share, 100 * shards).alias("b")).first()["b"] if share else None
    if not bounds:
        return docs.coalesce(1) if share else docs.repartition(1)
    held = F.lit(bounds)
    below, most = F.size(F.filter(held, lambda b: b < key)), F.size(F.filter(held, lambda b: b <= key))
    spread = F.when(below == most, below).otherwise(below + F.pmod(F.xxhash64("text"), most - below + 1).cast("int"))
    return docs.repartitionById(shards, spread)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the store at ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = ranged(rows, shards or parts(spark)).sortWithinPartitions("doc_id", "text")
    with batch_rows(spark, 2048, 4 << 20):
        dealt.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with ``start``, the ids of all documents before each.

    One total for each shard goes through the driver: as many numbers as the
    store has shards, whatever its size.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r[0], r[1]) for r in rows.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before, offsets = 0, []
    for shard, n in totals:
        offsets.append((shard, before))
        before += n
    offset = spark.createDataFrame(offsets, "shard int, shard_start bigint")
    start = F.col("shard_start") + F.col("start_in_shard")
    return rows.join(F.broadcast(offset), "shard").withColumn("start", start).drop("shard_start")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        at = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids, from a store's rows."""
    return tokens.select("doc_id", "start", F.size("ids").cast("bigint").alias("n_tokens"), "ids").mapInArrow(
        _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
