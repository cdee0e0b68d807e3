"""Events of Parquet files as a stream with offsets: files that are added to a folder are read once, in order of their names.

An offset is a number of files and, of the next one, of row groups; a row group is a partition of a micro-batch. After a failure Spark
asks for the same pair of offsets again and gets the same rows, since files don't change. Progress that Spark has committed is
written to `progress`, if given, by renaming a finished file. Files have to come with names behind those already read, and to be
there whole (written aside and renamed). The first micro-batch after a start takes all there is, later ones groupsPerTrigger. The folder is a path that driver and executors share, or a URI that Arrow's file systems open.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "lacuna_events"


class RowGroup(InputPartition):
    def __init__(self, path: str, number: int) -> None:
        self.path, self.number = path, number


class Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.folder = schema.names, options["path"]
        self.most, self.progress = int(options.get("groupspertrigger", "64")), options.get("progress")
        self.at: dict[str, int] | None = None
        self.sizes: dict[str, int] = {}

    def _fs(self) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, folder = self._fs()
        if system.get_file_info(folder).type == fs.FileType.File:
            return [folder]
        found = system.get_file_info(fs.FileSelector(folder))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def _groups(self, path: str) -> int:
        import pyarrow.parquet as pq

        if path not in self.sizes:
            self.sizes[path] = pq.ParquetFile(path, filesystem=self._fs()[0]).metadata.num_row_groups
        return self.sizes[path]

    def _between(self, start: dict[str, int], end: dict[str, int] | None) -> Iterator[tuple[str, int, dict[str, int]]]:
        """Row groups from an offset on, each with the offset behind it."""
        files = self._files()
        for f in range(start["files"], len(files)):
            for g in range(start["groups"] if f == start["files"] else 0, self._groups(files[f])):
                if end and (f, g) >= (end["files"], end["groups"]):
                    return
                last = g + 1 == self._groups(files[f])
                yield files[f], g, {"files": f + last, "groups": 0 if last else g + 1}

    def initialOffset(self) -> dict[str, int]:
        return {"files": 0, "groups": 0}

    def latestOffset(self) -> dict[str, int]:
        """The next groupsPerTrigger row groups. A reader that has just begun isn't told where its query stands, and an offset before
        that would be read as progress: its first answer is the end of what there is, which nothing can lie behind."""
        most = self.most if self.at else None
        self.at = self.at or self.initialOffset()
        for n, (_, _, behind) in enumerate(self._between(self.at, None), 1):
            self.at = behind
            if n == most:
                break
        return self.at

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[RowGroup]:
        self.at = max(self.at or end, end, key=lambda o: (o["files"], o["groups"]))  # after a restart, go on from here
        return [RowGroup(path, g) for path, g, _ in self._between(start, end)]

    def read(self, partition: RowGroup) -> Iterator[Any]:
        import pyarrow.parquet as pq

        file = pq.ParquetFile(partition.path, filesystem=self._fs()[0])
        yield from file.read_row_group(partition.number, columns=self.names).select(self.names).to_batches()

    def commit(self, end: dict[str, int]) -> None:
        if self.progress:
            draft = f"{self.progress}.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as file:
                json.dump(end, file)
            os.replace(draft, self.progress)


class Events(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(schema, {k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """The columns of `schema` of a folder's Parquet files as a stream. Options: groupsPerTrigger, progress."""
    spark.dataSource.register(Events)
    return spark.readStream.format(NAME).schema(schema).options(**options).load(folder)
