"""Late rows per key on streams, with marks that lie in buckets and are given up in time."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.functions.time import micros_of
from millrace.operators import ordered as o
from millrace.runtime import get_file, names_in, put_file, remove
from millrace.streaming.runs import BATCH, Folder

MICROS = 1_000_000


@dataclass(frozen=True)
class Version:
    """What a batch starts from: the newest time of all (microseconds), and per bucket the folder
    of its marks with the newest of them."""

    top: int | None = None
    buckets: Mapping[str, tuple[str, int]] = field(default_factory=dict)


@dataclass(frozen=True)
class KeyMarks:
    """``late`` for every row of a stream: older than the newest time of its key so far, in arrival
    order, by more than the delay.  The mark moves with every row, not once a batch.

    Marks are kept in ``buckets`` by the hash of the key.  A batch reads and rewrites the buckets
    of its own keys only; a version, put in place by one rename, names the folder of each bucket.
    Versions go by batch, so a repeated batch starts from the same marks; what only versions before
    the last two name is removed.

    Marks more than ``forget_seconds`` older than the newest time of all are given up when their
    bucket is rewritten, and with a bucket, unread, when all its marks are that old.  A row that is older than that by more than the delay is late
    whatever its key, so a key that was given up lets nothing older in again.  Where rows come in
    at most ``forget_seconds`` after newer ones of any key, no row is judged differently for it.

    Rows without a time are not late and move no mark; a null key is a key.
    """

    folder: Folder
    by: Sequence[str]
    arrival: Sequence[str]
    ts: str
    delay_seconds: int
    forget_seconds: int
    buckets: int = 64

    def _version_path(self, batch_id: int) -> str:
        return f"{self.folder.path}/versions/{batch_id:012d}"

    def version(self, batch_id: int) -> Version | None:
        """The marks after a batch; None if it has put none in place."""
        spark, name = self.folder.spark, f"{batch_id:012d}"
        if name not in names_in(spark, f"{self.folder.path}/versions"):
            return None
        read = json.loads(get_file(spark, self._version_path(batch_id)))
        return Version(read["top"], {b: tuple(v) for b, v in read["buckets"].items()})

    def last(self) -> Version:
        """The newest version."""
        names = [n for n in names_in(self.folder.spark, f"{self.folder.path}/versions") if n.isdigit()]
        return self.version(int(names[-1])) if names else Version()

    def marks(self, like: DataFrame, version: Version, only: Sequence[str] | None = None) -> DataFrame:
        """``by`` and ``mark`` of the buckets (all, unless named) of a version."""
        fields = [*like.select(*self.by).schema, like.select(F.col(self.ts).alias("mark")).schema["mark"]]
        schema = type(like.schema)(fields)
        named = version.buckets if only is None else [b for b in only if b in version.buckets]
        paths = [version.buckets[b][0] for b in named]
        spark = self.folder.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets))

    def judged(self, rows: DataFrame, marks: DataFrame, floor: int | None) -> DataFrame:
        """``rows`` with ``late``, given the marks of the batches before."""
        micros = micros_of(rows, self.ts)
        seq = o.ordered(rows, self.by, self.arrival).add(_top=o.running_max(self.ts))
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in self.by]
        found = seq.df.alias("r").join(marks.alias("m"), same, "left").select("r.*", F.col("m.mark").alias("_mark"))
        oldest = micros(F.greatest("_top", "_mark")) - self.delay_seconds * MICROS
        oldest = F.greatest(oldest, F.lit(floor).cast("bigint"))
        late = F.coalesce(micros(self.ts) < oldest, F.lit(False))
        return found.withColumn("late", late).drop("_top", "_mark")

    def _next(self, rows: DataFrame, before: Version, marks: DataFrame, batch_id: int, top: int | None, touched) -> None:
        """Write the marks of the touched buckets and put the version of the batch in place."""
        spark, micros = self.folder.spark, micros_of(rows, self.ts)
        if f"{batch_id:012d}" in names_in(spark, f"{self.folder.path}/versions"):
            return  # a repeated batch
        horizon = None if top is None else top - self.forget_seconds * MICROS
        newest = (
            rows.select(*self.by, F.col(self.ts).alias("mark"))
            .unionByName(marks)
            .where(F.col("mark").isNotNull())
            .groupBy(*self.by)
            .agg(F.max("mark").alias("mark"))
        )
        if horizon is not None:
            newest = newest.where(micros("mark") >= horizon)
        path = f"{self.folder.path}/marks/{batch_id:012d}"
        newest.withColumn("_bucket", self._bucket()).repartition(F.col("_bucket")).write.mode("overwrite").partitionBy(
            "_bucket"
        ).parquet(path)
        written = {n.split("=")[1]: f"{path}/{n}" for n in names_in(spark, path) if n.startswith("_bucket=")}
        now = Version(top, {b: (p, 0) for b, p in written.items()})
        ends = self.marks(rows, now).groupBy(self._bucket().alias("b")).agg(F.max(micros("mark")).alias("mark"))
        kept = {b: v for b, v in before.buckets.items() if b not in touched and v[1] >= horizon}
        kept |= {str(r["b"]): (written[str(r["b"])], r["mark"]) for r in ends.collect()}  # one row a bucket
        put_file(spark, self._version_path(batch_id), json.dumps({"top": top, "buckets": kept}))

    def _forget(self, batch_id: int, before: Version) -> None:
        """Remove the version two batches back, and folders that ``before``, the one after it, does
        not name."""
        old = self.version(batch_id - 2)
        if old is None:
            return
        used = {path for path, _ in before.buckets.values()}
        for path, _ in old.buckets.values():
            if path not in used:
                remove(self.folder.spark, path)
        remove(self.folder.spark, self._version_path(batch_id - 2))

    def writer(self, stream: DataFrame) -> DataStreamWriter:
        def process(batch: DataFrame, batch_id: int) -> None:
            before = self.version(batch_id - 1) or Version()
            rows = batch.persist()  # read for its buckets, its judgement and its marks
            try:
                micros = micros_of(rows, self.ts)
                seen = rows.groupBy(self._bucket().alias("b")).agg(F.max(micros(self.ts)).alias("top")).collect()
                touched = [str(r["b"]) for r in seen]  # one row a bucket
                tops = [t for t in [before.top, *(r["top"] for r in seen)] if t is not None]
                marks = self.marks(rows, before, touched)
                span = (self.forget_seconds + self.delay_seconds) * MICROS
                floor = None if before.top is None else before.top - span
                self.judged(rows, marks, floor).write.mode("overwrite").parquet(
                    f"{self.folder.output}/{BATCH}={batch_id}"
                )
                self._next(rows, before, marks, batch_id, max(tops, default=None), touched)
                self._forget(batch_id, before)
            finally:
                rows.unpersist()

        return stream.writeStream.option("checkpointLocation", self.folder.checkpoint).foreachBatch(process)
