"""Versioned vector collections: a version is written once, then a pointer to it is replaced."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VectorStore:
    """A folder of vectors_vN, vectors_vN_meta and CURRENT, which names the live version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.sc().hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def live(self) -> int | None:
        if not self._exists("CURRENT"):
            return None
        stream = self._fs.open(self._path(f"{self.folder}/CURRENT"))
        try:
            return int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def next_version(self) -> int:
        if not self._fs.exists(self._path(self.folder)):
            return 1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return 1 + max((int(n[9:]) for n in names if n.startswith("vectors_v") and n[9:].isdigit()), default=0)

    def write(self, points: DataFrame, meta: dict[str, Any]) -> int:
        """Write a new version of (point_id, vector, ...) with its meta row, then make it live."""
        version = self.next_version()
        points.write.parquet(f"{self.folder}/vectors_v{version}")
        row = self.spark.createDataFrame([(json.dumps(meta),)], "meta string")
        row.coalesce(1).write.parquet(f"{self.folder}/vectors_v{version}_meta")
        self.flip(version)
        return version

    def flip(self, version: int) -> None:
        draft = self._path(f"{self.folder}/.CURRENT-{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(str(version), "utf-8"))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.sc().hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._path(f"{self.folder}/CURRENT"), overwrite)

    def meta(self, version: int | None = None) -> dict[str, Any] | None:
        version = self.live() if version is None else version
        if version is None or not self._exists(f"vectors_v{version}_meta"):
            return None
        return json.loads(self.spark.read.parquet(f"{self.folder}/vectors_v{version}_meta").first()["meta"])

    def read(self, version: int | None = None) -> DataFrame:
        version = self.live() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], "point_id bigint, vector array<float>").where(F.lit(False))
        return self.spark.read.parquet(f"{self.folder}/vectors_v{version}")
