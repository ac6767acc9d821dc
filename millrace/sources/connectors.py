"""Databases, topics and binary record formats.

None of these has a counterpart on the build machine: there is no database to connect to,
and the topic and binary-record packages are not part of the installation.  The functions
are thin on purpose; what the operators need from a topic is its row schema, and the
tests use file tables of that schema instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a topic row.
TOPIC_SCHEMA = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)


def jdbc_read_options(
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_size: int = 1000,
) -> dict[str, str]:
    """Options of a partitioned read: each task reads a range of ``column`` through a cursor."""
    if lower >= upper or partitions < 1:
        raise ValueError("a partitioned read needs lower < upper and at least one partition")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_read_options(**options)).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 10_000, mode: str = "append"):
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_size))
        .mode(mode)
        .save()
    )


def read_topic_stream(
    spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None
) -> DataFrame:
    """A topic from its earliest offset; the checkpoint of the query keeps the position."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("kafka.isolation.level", "read_committed")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load()


def write_topic_stream(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return (
        df.select("key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def read_topic_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Topic rows that land as files, with the same columns as the topic itself."""
    reader = spark.readStream.schema(TOPIC_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def as_topic_rows(
    df: DataFrame, topic: str, key: Column, value: Column, partitions: int, offset: Column, ts: Column
) -> DataFrame:
    """Rows in the topic schema; equal keys share a partition."""
    return df.select(
        key.cast("string").cast("binary").alias("key"),
        value.cast("string").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(F.xxhash64(key.cast("string")), F.lit(partitions)).cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        ts.cast("timestamp").alias("timestamp"),
    )


def from_binary_records(column: Column, schema_json: str) -> Column:
    """Avro records; needs the optional package on the cluster's class path."""
    from pyspark.sql.avro.functions import from_avro

    return from_avro(column, schema_json)


def to_binary_records(column: Column, schema_json: str) -> Column:
    from pyspark.sql.avro.functions import to_avro

    return to_avro(column, schema_json)
