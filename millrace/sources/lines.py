"""Delimited lines: scan, parse with rejects, ordered search, ordered write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from millrace.functions.numbers import PATTERNS, number_in
from millrace.operators import ordered as o
from millrace.operators import sequence as sq

ORDER = ("file", "block", "line_no")


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row per line (``line``); an unterminated last line is kept."""
    reader = spark.read
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(path).withColumnRenamed("value", "line")


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the columns ``file``, ``block`` and ``line_no`` that give their order.

    A block of a file is read front to back by one task, so the id grows within it; only
    its order within (file, block) means anything.
    """
    return read_lines(spark, path).select(
        "line",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def over_long(lines: DataFrame, most: int, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Lines within the length limit, and the rest as rejects."""
    fits = F.length(line) <= most
    return lines.where(fits), lines.where(~fits).withColumn(
        "error", F.lit(f"line is longer than {most}")
    )


def _typed(text: Column, kind: DataType, clean: bool = False) -> Column:
    name = kind.simpleString()
    return number_in(text, name) if name in PATTERNS and not clean else text.try_cast(kind)


def pick_fields(
    lines: DataFrame,
    schema: str | StructType,
    positions: Sequence[int] | None = None,
    separator: str = ",",
    line: str = "line",
    clean: bool = False,
) -> DataFrame:
    """Only some trimmed fields by position; missing or mistyped ones are null.

    The line is split no further than the last position asked for, all inside generated
    code - several times faster than a full reader of the format.  ``clean`` expects
    mistyped numbers to be rare: they are still null, but cost more, and the others less.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = list(positions) if positions is not None else list(range(len(schema)))
    parts = F.split(F.col(line), _literal(separator), max(at) + 2)
    others = [c for c in lines.columns if c != line]
    return lines.select(
        *others,
        *[
            _typed(F.trim(F.get(parts, F.lit(i))), f.dataType, clean).alias(f.name)
            for i, f in zip(at, schema)
        ],
    )


def parse_fields(
    lines: DataFrame, schema: str | StructType, separator: str = ",", line: str = "line"
) -> DataFrame:
    """Positional, trimmed fields; a field that is missing or has another type is null.

    ``error`` is null for a clean line, else it names the first bad field.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # the texts first, in a projection of their own, so that each is made once
    parts = F.split(F.col(line), _literal(separator))
    others = [c for c in lines.columns if c != line]
    texts = lines.select(
        *others,
        F.col(line).alias("raw"),
        F.transform(parts, lambda p: F.trim(p)).alias("_parts"),
    )
    raw = [F.get("_parts", F.lit(i)) for i in range(len(schema))]
    typed = [_typed(r, f.dataType).alias(f.name) for r, f in zip(raw, schema)]
    bad = F.coalesce(
        *[
            F.when(
                _typed(r, f.dataType).isNull() & (F.coalesce(r, F.lit("")) != ""),
                F.lit(f"{f.name} has another type"),
            )
            for r, f in zip(raw, schema)
        ],
        F.when(F.size("_parts") < len(schema), F.lit("fields are missing")),
    )
    return texts.select(*others, "raw", *typed, bad.alias("error"))


def _literal(separator: str) -> str:
    """The separator as a split pattern; a single character is split on without a regex."""
    if len(separator) == 1:
        return separator if separator.isalnum() or separator in " ,;:_-=/~'\"\t" else "\\" + separator
    return "\\Q" + separator + "\\E"


def read_delimited(
    spark: SparkSession, path: str, schema: str | StructType, separator: str = ",", header: bool = False
) -> DataFrame:
    """Spark's own reader with a fixed schema; malformed rows keep what could be read."""
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def write_ordered_lines(
    df: DataFrame, path: str, line: Column | str, order_by: Sequence[str], parts: int | None = None,
    compression: str = "none",
) -> None:
    """Text whose part files, taken in name order, are the document.

    Range-partitioned and sorted in parallel; no single task sees everything.
    """
    text = F.col(line) if isinstance(line, str) else line
    ranged = (
        df.repartitionByRange(parts, *order_by) if parts else df.repartitionByRange(*order_by)
    )
    ranged.sortWithinPartitions(*order_by).select(text.alias("value")).write.option(
        "compression", compression
    ).text(path)


def after_marker(lines: DataFrame, marker: str, wanted: str, line: str = "line") -> DataFrame:
    """Lines that contain ``wanted``, from the first line on that contains ``marker``."""
    seq = o.ordered(lines, (), ORDER)
    rest = sq.drop_while(seq, ~F.contains(line, F.lit(marker)))
    return rest.where(F.contains(line, F.lit(wanted)))
