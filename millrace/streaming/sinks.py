"""Several consumers of one stream, and directory ingest."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from millrace.runtime import Limits, estimated_bytes
from millrace.sources.index import BucketedIndex, DocumentIndex
from millrace.streaming.runs import BATCH, Folder


def to_all(
    stream: DataFrame, folder: Folder, consumers: Mapping[str, Callable[[DataFrame], DataFrame]]
) -> DataStreamWriter:
    """Every consumer gets every row; each writes its own table, once per batch.

    The batch is computed once: it is kept (memory, then disk) while the consumers run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        shared = batch.persist()
        try:
            for name, consumer in consumers.items():
                target = f"{folder.output}/{name}/{BATCH}={batch_id}"
                consumer(shared).write.mode("overwrite").parquet(target)
        finally:
            shared.unpersist()

    return stream.writeStream.option("checkpointLocation", folder.checkpoint).foreachBatch(write)


def to_index(
    stream: DataFrame, folder: Folder, index: DocumentIndex | BucketedIndex
) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", folder.checkpoint).foreachBatch(
        index.upsert
    )


def without_listed(
    stream: DataFrame, folder: Folder, read_list: Callable[[SparkSession], DataFrame], on: str
) -> DataStreamWriter:
    """Drop rows on an exclusion list that is read anew for each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        listed = read_list(batch.sparkSession).select(on).distinct()
        limits = Limits.of(batch.sparkSession)
        if estimated_bytes(listed) <= limits.small_bytes:
            listed = listed.hint("broadcast")
        batch.join(listed, on, "left_anti").write.mode("overwrite").parquet(
            f"{folder.output}/{BATCH}={batch_id}"
        )

    return stream.writeStream.option("checkpointLocation", folder.checkpoint).foreachBatch(write)


def read_directory(
    spark: SparkSession,
    path: str,
    pattern: str = "*",
    archive: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Lines of the text files of a folder and its subfolders, each file taken once, also later
    ones.  Long files are read in pieces, so no file has to fit a row.

    With an archive folder, files are moved there after the batch that follows theirs, so
    count processed files by ``file`` and not by what has been moved.
    """
    reader = (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).selectExpr("value AS line", "_metadata.file_path AS file")


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
