"""Starting, draining, finishing and restarting streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.runtime import work_dir

# Fixed value: after any event time (and still a time to pandas); a row at this time closes every window and session.
END_OF_TIME = "2200-01-01 00:00:00"
BATCH = "batch_id"


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time with a watermark; a TIMESTAMP_NTZ column is read as UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there, then stop; a later call with the same checkpoint goes on."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the queries started inside; what was there before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@dataclass(frozen=True)
class Folder:
    """Output and checkpoint of one streaming query, below the shared folder."""

    spark: SparkSession
    path: str

    @classmethod
    def new(cls, spark: SparkSession, purpose: str) -> "Folder":
        return cls(spark, work_dir(spark, purpose))

    @property
    def output(self) -> str:
        return f"{self.path}/output"

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"

    def landing(self, name: str) -> str:
        return f"{self.path}/landing-{name}"

    def append_to(self, stream: DataFrame) -> DataStreamWriter:
        """The exactly-once file sink."""
        return (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", self.checkpoint)
            .option("path", self.output)
        )

    def read(self, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.output)


def each_batch(
    stream: DataFrame,
    folder: Folder,
    operator: Callable[[DataFrame], DataFrame],
    mode: str = "append",
) -> DataStreamWriter:
    """A batch operator on every micro-batch.

    The result goes to a folder of the batch number and replaces it, so a repeated batch
    leaves the table as it was.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder.output}/{BATCH}={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", folder.checkpoint)
        .foreachBatch(write)
    )


def read_batches(folder: Folder, schema: str) -> DataFrame:
    """What ``each_batch`` wrote, with the number of the batch."""
    return folder.spark.read.schema(f"{schema}, {BATCH} BIGINT").parquet(folder.output)


def end_marks(spark: SparkSession, folder: Folder, schema: str, name: str = "end") -> DataFrame:
    """A stream that stays empty until ``mark_end`` is called; union it to the input.

    Needed where the input ends and what is still open must come out.
    """
    path = folder.landing(name)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def mark_end(spark: SparkSession, folder: Folder, schema: str, ts: str, name: str = "end") -> None:
    """Write one row without a key at the end of time; drain once more afterwards."""
    row = spark.range(1).select(F.lit(END_OF_TIME).cast("timestamp").alias(ts))
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = dict(c.split(" ") for c in schema.split(", "))
    row.select(
        *[
            F.col(ts).cast(kinds[c]).alias(c) if c == ts else F.lit(None).cast(kinds[c]).alias(c)
            for c in columns
        ]
    ).write.mode("append").parquet(folder.landing(name))


def run_restarting(
    start: Callable[[], StreamingQuery],
    least_wait: float = 1.0,
    most_wait: float = 10.0,
    most_restarts: int = 10,
    within_seconds: float = 60.0,
    sleep: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Run until a query ends well; after a failure start again from its checkpoint.

    Waits grow from ``least_wait`` to ``most_wait``.  More than ``most_restarts`` failures
    within the time span raise the last one.
    """
    wait, failures = least_wait, []
    while True:
        try:
            query = start()
            query.awaitTermination()
            return query
        except StreamingQueryException:
            now = time.monotonic()
            failures = [t for t in failures if now - t < within_seconds] + [now]
            if len(failures) > most_restarts:
                raise
            sleep(wait)
            wait = min(wait * 2, most_wait)
