"""A Spark data source of record documents: ``spark.read.format("vframe")``.

Options: ``path`` (a file or folder in any store that Arrow opens: local,
hdfs, s3, gs), ``type`` (json, yaml or toml; by default the suffix). Files are
shared out among partitions by their bytes; a row has _path and doc, the
document's JSON. Text formats that Spark can split are better read with
``formats.load``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vframe.errors import BackendError
from vframe.sources import text

PARSERS = {"json": text.from_json, "yaml": text.from_yaml, "yml": text.from_yaml, "toml": text.from_toml}
#: Bytes of files that a partition has, and its files, besides its first.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 1000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of each document file, in order."""
    store, place = _store(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    found = store.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.type = options.get("path", ""), options.get("type")

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = []
        room = 0
        for name, size in _files(self.path):
            if size > room or len(groups[-1]) >= PARTITION_FILES:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(name)
            room -= size
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        store, _ = _store(self.path)
        for name in partition.value:
            ending = (self.type or os.path.splitext(name)[1].lstrip(".")).lower()
            if ending not in PARSERS:
                raise BackendError(f"no document type for {name!r}")
            with store.open_input_stream(name) as f:
                for doc in PARSERS[ending](f.read().decode("utf-8")):
                    yield name, doc


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vframe"

    def schema(self) -> str:
        return "_path string, doc string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
