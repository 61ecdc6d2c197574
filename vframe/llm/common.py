"""Scratch storage and small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vframe.sources.scratch import folder, folder_root


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may name none: there a local folder is made
    and recorded in the session. On a cluster that is an error, as every
    executor would write to its own disk.
    """
    root = folder_root(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables in the shared folder that cut lineage and survive lost executors.

    A table stays until :meth:`drop`, or else until the driver ends. A caller
    that has written an operator's result calls it; results that are still
    lazy need their tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        checkpoint_root(spark)
        self.root = folder(spark, "tables")
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        p = f"{self.root}/{name}-{len(self.paths)}"
        self.paths.append(p)
        return p

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        p = self.path(name)
        df.write.options(**{"compression": "zstd", **options}).parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.clear()


@contextmanager
def batch_rows(spark: SparkSession, rows: int, size: int = 16 << 20) -> Iterator[None]:
    """Within it, actions hand Python workers Arrow batches of so many rows and bytes at most, where rows may be large."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parts(spark: SparkSession) -> int:
    """Partitions for shuffles whose number must be stated."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
