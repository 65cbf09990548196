"""A directory as a Spark data source: ``spark.read.format("quern_directory").load(path)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quern import schema as S
from quern.sources.files import FILES_PER_TASK, INCLUDE, walk


class Batch(InputPartition):
    """Files that one task reads."""

    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class DirectoryReader(DataSourceReader):
    """Walks on the driver, with pruning, and reads in batches of files on the executors."""

    def __init__(self, root: str, include: tuple[str, ...]):
        self.root, self.include = root, include

    def partitions(self) -> list[Batch]:
        names, _ = walk(self.root, self.include)
        return [Batch(names[i : i + FILES_PER_TASK]) for i in range(0, len(names), FILES_PER_TASK)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        base = self.root if os.path.isdir(self.root) else os.path.dirname(self.root)
        for name in partition.names:
            text = None
            try:
                with open(os.path.join(base, name), "rb") as f:
                    raw = f.read(S.TEXT_BYTES + 1)
                text = raw.decode() if len(raw) <= S.TEXT_BYTES else None
            except (OSError, UnicodeDecodeError):
                pass
            yield name, text


class DirectorySource(DataSource):
    """Files under a path as rows (name, text). Option ``include``: comma-separated endings."""

    @classmethod
    def name(cls) -> str:
        return "quern_directory"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        include = self.options.get("include")
        return DirectoryReader(self.options["path"], tuple(include.split(",")) if include else INCLUDE)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DirectorySource)
