"""A table of documents by id: written in idempotent batches, read as the newest per id."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import latest
from millrace.runtime import get_file, names_in, put_file, remove

BATCH = "batch_id"


@dataclass(frozen=True)
class DocumentIndex:
    """Later writes of an id replace earlier ones.

    A batch appends its newest row per id under its own batch folder, and writing the same
    batch again replaces that folder: a repeated batch changes nothing.  Nothing else is
    rewritten, so a batch costs what the batch holds; reading resolves the ids.
    """

    spark: SparkSession
    path: str
    id_columns: Sequence[str]
    newer: Sequence[str]

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        newest = latest.newest_per(rows, list(self.id_columns), list(self.newer))
        newest.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")

    def read(self) -> DataFrame:
        stored = self.spark.read.parquet(self.path)
        return latest.newest_per(
            stored, list(self.id_columns), [*self.newer, BATCH]
        ).drop(BATCH)

    def compact(self, target: str) -> "DocumentIndex":
        """The same index with one row per id, as a new table."""
        self.read().write.mode("overwrite").parquet(f"{target}/{BATCH}=0")
        return DocumentIndex(self.spark, target, self.id_columns, self.newer)


BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketedIndex:
    """Later writes of an id replace earlier ones; ids live in buckets by their hash.

    A batch adds one run, its newest row per id, to every bucket it touches.  A bucket with more
    than ``most_runs`` runs is merged into one, and no other bucket is rewritten.  So a batch costs
    what it holds and, once in ``most_runs`` times, what its buckets hold; reading resolves at most
    ``most_runs`` runs of a bucket, however many batches there were.  Which runs make up the index
    is said by a version file that appears by one rename: readers see a batch whole or not at all,
    and a repeated batch changes nothing.  Take so many buckets that one of them fits a task.
    """

    spark: SparkSession
    path: str
    id_columns: Sequence[str]
    newer: Sequence[str]
    buckets: int = 256
    most_runs: int = 4

    def _versions(self) -> list[str]:
        return [n for n in names_in(self.spark, f"{self.path}/versions") if n.isdigit()]

    def _state(self, version: str | None = None) -> dict:
        """The last batch and the runs of each bucket."""
        versions = [version] if version else self._versions()[-1:]
        if not versions:
            return {"version": -1, "batch": -1, "runs": {}}
        return json.loads(get_file(self.spark, f"{self.path}/versions/{versions[0]}"))

    def _paths(self, runs: dict[str, list[str]]) -> list[str]:
        return [f"{self.path}/runs/{run}/{BUCKET}={b}" for b, names in sorted(runs.items()) for run in names]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.id_columns), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> list[str]:
        """Write a run; gives the buckets it touches."""
        folder = f"{self.path}/runs/{name}"
        # a task per bucket, more for a large one
        rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return [n.removeprefix(f"{BUCKET}=") for n in names_in(self.spark, folder) if n.startswith(f"{BUCKET}=")]

    def _newest(self, runs: dict[str, list[str]]) -> DataFrame:
        stored = self.spark.read.parquet(*self._paths(runs))
        return latest.newest_per(stored, list(self.id_columns), [*self.newer, BATCH])

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        state = self._state()
        if batch_id <= state["batch"]:
            return
        version, runs = state["version"] + 1, state["runs"]
        newest = latest.newest_per(rows, list(self.id_columns), list(self.newer))
        name = f"{version:012d}-{uuid.uuid4().hex}"
        touched = self._write(newest.withColumn(BATCH, F.lit(batch_id).cast("bigint")), name)
        for b in touched:
            runs.setdefault(b, []).append(name)
        full = {b: runs[b] for b in touched if len(runs[b]) > self.most_runs}
        if full:
            merged = f"{name}-merged"
            self._write(self._newest(full), merged)
            runs |= {b: [merged] for b in full}
        text = json.dumps({"version": version, "batch": batch_id, "runs": runs})
        put_file(self.spark, f"{self.path}/versions/{version:012d}", text)

    def read(self) -> DataFrame:
        """The newest row of each id; buckets of one run are taken as they are."""
        return self._read(self._state()["runs"])

    def _read(self, runs: dict[str, list[str]]) -> DataFrame:
        several = {b: r for b, r in runs.items() if len(r) > 1}
        single = {b: r for b, r in runs.items() if len(r) == 1}
        parts = [self._newest(several)] if several else []
        parts += [self.spark.read.parquet(*self._paths(single))] if single else []
        if not parts:
            raise ValueError("the index holds no batch yet")
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return whole.drop(BATCH)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The rows of some ids (their columns as in the index); other buckets are not read."""
        ids = ids.select(*self.id_columns).distinct()
        wanted = {str(r[0]) for r in ids.select(self._bucket()).distinct().collect()}  # buckets at most
        runs = self._state()["runs"]
        found = {b: r for b, r in runs.items() if b in wanted}
        return self._read(found or runs).join(ids, list(self.id_columns), "left_semi")

    def runs_per_bucket(self) -> dict[int, int]:
        return {int(b): len(r) for b, r in self._state()["runs"].items()}

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` versions reads, and the versions before them."""
        versions = self._versions()
        used: dict[str, set[str]] = {}
        for version in versions[-keep:]:
            for b, names in self._state(version)["runs"].items():
                for name in names:
                    used.setdefault(name, set()).add(f"{BUCKET}={b}")
        for name in names_in(self.spark, f"{self.path}/runs"):
            if name not in used:
                remove(self.spark, f"{self.path}/runs/{name}")
                continue
            for b in names_in(self.spark, f"{self.path}/runs/{name}"):
                if b.startswith(f"{BUCKET}=") and b not in used[name]:
                    remove(self.spark, f"{self.path}/runs/{name}/{b}")
        for version in versions[:-keep]:
            remove(self.spark, f"{self.path}/versions/{version}")
