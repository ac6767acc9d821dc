"""Batches that readers see whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from millrace.runtime import get_file, names_in, put_file

BATCH = "batch_id"


def batch_key(batch_id: int, step: int = 0) -> str:
    """Names of batches in their order; steps lie between a batch and the next one."""
    return f"{batch_id:012d}-{step:06d}"


@dataclass(frozen=True)
class Published:
    """Tables written in batches, each under a new folder that a manifest names.

    The manifest of a batch appears by one rename after all its tables are written, and readers
    take only folders that a manifest names.  A batch that was published already is left alone, so
    a repeated one changes nothing; what a failed attempt wrote is never read.
    """

    spark: SparkSession
    path: str

    @property
    def _manifests(self) -> str:
        return f"{self.path}/manifests"

    def stage(self, tables: Mapping[str, DataFrame], key: str) -> str:
        """Write the tables of a batch to a folder that nobody reads yet; gives its name."""
        folder = f"{key}-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/data/{folder}/{name}")
        return folder

    def publish(self, key: str, folder: str) -> bool:
        """Make a staged folder the batch; False if the batch has one already."""
        return put_file(self.spark, f"{self._manifests}/{key}", json.dumps({"folder": folder}))

    def keys(self) -> list[str]:
        """The published batches, in order."""
        return [n for n in names_in(self.spark, self._manifests) if not n.startswith(("_", "."))]

    def add(self, tables: Mapping[str, DataFrame], key: str) -> None:
        if key not in self.keys():
            self.publish(key, self.stage(tables, key))

    def read(self, table: str, schema: str, keys: list[str] | None = None) -> DataFrame:
        """Rows of the batches (all published ones, unless named)."""
        keys = self.keys() if keys is None else keys
        folders = [json.loads(get_file(self.spark, f"{self._manifests}/{k}"))["folder"] for k in keys]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}/{table}" for f in folders])

    def writer(self, stream: DataFrame, checkpoint: str, table: str = "rows") -> DataStreamWriter:
        def write(batch: DataFrame, batch_id: int) -> None:
            self.add({table: batch}, batch_key(batch_id))

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
