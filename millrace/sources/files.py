"""Files as tables: inventory, archives, one output per value, counted splits, JSON rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ordered as o

# Objects are small and slow to put, so that tasks differ.
TASKS_PER_CORE = 4
ENTRY_SCHEMA = "archive STRING, name STRING, content BINARY"


def inventory(spark: SparkSession, folder: str, pattern: str = "*.zip", depth: int = 2) -> DataFrame:
    """Files down to a depth, oldest first.  The contents are not read."""
    levels = ["/*" * d for d in range(depth)]
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    paths = [f"{folder}{level}/{pattern}" for level in levels]
    existing = [p for p in paths if _matches(spark, p)]
    if not existing:
        return spark.createDataFrame([], "path STRING, modificationTime TIMESTAMP, length BIGINT")
    files = found.load(existing).select("path", "modificationTime", "length")
    return files.orderBy(F.col("modificationTime").asc_nulls_last(), "path")


def read_objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Objects below a folder of any file system Spark reaches: path, time, length, content.

    Counting or listing them does not read the contents.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )


def put_text_objects(df: DataFrame, folder: str, name: str, text: str) -> None:
    """One text object per row, in a folder of its name.

    Rows are dealt out to all cores, and each task puts its objects in their place when it ends, as
    single puts do; else the driver would move them one by one.  A job that fails may leave objects.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    writer = df.select(name, text).repartition(cores * TASKS_PER_CORE).write.mode("append")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(name).text(folder)


def _matches(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def expand_archives(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Zip archives (one per row) to their entries; of equal names the first counts."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["content"]):
                seen = set()
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():  # entry by entry: one unpacked at a time
                        if info.is_dir() or info.filename in seen:
                            continue
                        seen.add(info.filename)
                        yield pd.DataFrame(
                            {
                                "archive": [archive],
                                "name": [info.filename],
                                "content": [z.read(info)],
                            }
                        )

    picked = archives.select(F.col(name).alias("archive"), F.col(content).alias("content"))
    return picked.mapInPandas(expand, ENTRY_SCHEMA)


def pack_archives(entries: DataFrame, most_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Entries (archive, name, content) to zip archives (archive, part, content).

    An archive is cut into parts of about ``most_bytes``, so that no task ever holds more
    than one part, however large the archive is.
    """
    sized = entries.select("archive", "name", "content", F.octet_length("content").alias("_b"))
    placed = o.ordered(sized, "archive", "name").add(_upto=o.running_sum("_b"))
    parted = placed.df.select(
        "archive",
        # the part is that of the entry's first byte
        F.floor((F.col("_upto") - F.col("_b")) / most_bytes).cast("int").alias("part"),
        "name",
        "content",
    )

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, data in zip(rows["name"], rows["content"]):
                z.writestr(zipfile.ZipInfo(entry), data)
        return pd.DataFrame(
            {"archive": [key[0]], "part": [key[1]], "content": [buffer.getvalue()]}
        )

    sorted_rows = lambda key, rows: pack(key, rows.sort_values("name"))
    return parted.groupBy("archive", "part").applyInPandas(
        sorted_rows, "archive STRING, part INT, content BINARY"
    )


def write_per_value(df: DataFrame, path: str, key: str, files_per_value: int | None = None) -> None:
    """One folder per value of the key, replacing what was there.

    Rows are gathered by value in pieces of about the advisory size of a partition, so a heavy
    value takes as many tasks as it needs.  ``files_per_value`` names a number of pieces instead.
    """
    if files_per_value is None:
        gathered = df.hint("rebalance", key)
    else:
        others = [c for c in df.columns if c != key]
        gathered = df.repartition(F.col(key), F.pmod(F.xxhash64(*others), F.lit(files_per_value)))
    gathered.write.mode("overwrite").partitionBy(key).parquet(path)


def split_with_counts(df: DataFrame, path: str, key: str, count: str = "n_rows") -> None:
    """One folder per value, with the number of its rows in the folder name.

    Counts are aggregated and joined back instead of counted over a window, which would
    put a heavy value into one task.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    df.join(counts, df[key].eqNullSafe(counts[key])).drop(counts[key]).write.mode(
        "overwrite"
    ).partitionBy(key, count).parquet(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_rows(spark: SparkSession, path: str, schema: str, order_by: str) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(order_by)
