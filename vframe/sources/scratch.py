"""A folder that all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from vframe.errors import BackendError


def folder_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one in a session on one machine that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise BackendError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder(spark: SparkSession, name: str) -> str:
    """A new path in that folder, which goes when the driver ends."""
    found = f"{folder_root(spark).rstrip('/')}/vframe-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{found}/data"
