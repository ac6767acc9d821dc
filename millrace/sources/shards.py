"""A log in shards: each read on from its own place, a bounded number of rows a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_to_shards(rows: DataFrame, path: str, shard: str, order_by: str, most_rows: int) -> None:
    """Append rows to the folders ``shard=...`` of a log, in files of at most ``most_rows``.

    Rows are spread by range of shard and order, so that a shard with most of the rows is written
    by many tasks.  A null shard is a folder of its own, which ``read_shards`` does not read.
    """
    spread = rows.repartitionByRange(shard, order_by).sortWithinPartitions(shard, order_by)
    spread.withColumnRenamed(shard, "shard").write.mode("append").option("maxRecordsPerFile", most_rows).partitionBy("shard").parquet(path)


def read_shards(
    spark: SparkSession, path: str, schema: str, shards: list, files: int = 1
) -> DataFrame:
    """The named shards as one stream, from their first row on.

    Every shard is a source of its own in the query's checkpoint: it has its own offset, takes
    at most ``files`` files a batch (with ``append_to_shards``: that many times its rows), and goes
    on from there after a restart.  A shard that has run dry holds up no other.  Adding a shard
    needs a new checkpoint, as a changed set of sources always does.
    """
    one = lambda s: (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .parquet(f"{path}/shard={s}")
        .withColumn("shard", F.lit(s))
    )
    return reduce(DataFrame.unionByName, map(one, shards))
