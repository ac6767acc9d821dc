"""Routing rows: errors as data, fan-out of functions, assignment to targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators import ordered as o

Names = Sequence[str] | str
ERROR = "error"


def with_error(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = ERROR) -> DataFrame:
    """The reason of the first rule that a row breaks; null for valid rows."""
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(broken, F.lit(text)).otherwise(reason)
    return df.withColumn(name, reason)


def divert(routed: DataFrame, name: str = ERROR) -> tuple[DataFrame, DataFrame]:
    """Valid rows and invalid rows (with their reason) of one parent."""
    return routed.where(F.col(name).isNull()).drop(name), routed.where(F.col(name).isNotNull())


def dead_letters(
    df: DataFrame, failed: Column, trace_id: str, error_type: Column, message: Column
) -> DataFrame:
    """Failed rows as they go to the error table: payload, trace id, correlation id, reason."""
    return df.where(failed).select(
        "*",
        F.col(trace_id).cast("string").alias("correlation_id"),
        error_type.alias("error_type"),
        message.alias("error_message"),
    )


def collect_where(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """Filter and project in one step."""
    return df.where(condition).select(*columns)


def beside(df: DataFrame, name: str, function: Callable[[Column], Column], value: str) -> DataFrame:
    """The row with the result of a function next to it."""
    return df.withColumn(name, function(F.col(value)))


def through_all(
    df: DataFrame, value: str, functions: Sequence[Callable[[Column], Column]], name: str = "result"
) -> DataFrame:
    """Every row through every function: one scan, one output row per function."""
    if not functions:
        raise ValueError("at least one function is needed")
    results = F.array(
        *[F.struct(F.lit(i).alias("branch"), f(F.col(value)).alias(name)) for i, f in enumerate(functions)]
    )
    return df.withColumn("_r", F.explode(results)).select(*df.columns, "_r.*")


def round_robin(df: DataFrame, order_by: Names, targets: int, name: str = "target") -> DataFrame:
    """Targets 0..n-1 in turn, the first row to target 0."""
    seq = o.ordered(df, (), order_by).add(_i=o.index())
    return seq.with_columns(**{name: F.pmod(F.col("_i"), F.lit(targets))}).df.drop("_i")


def weighted_round_robin(
    df: DataFrame, order_by: Names, weights: dict[str, int], name: str = "target"
) -> DataFrame:
    """Targets in turn, each as often as its weight; the first row takes slot 1, not 0.

    The slot is compared with the running weights, so the cost does not grow with them.
    """
    total = sum(weights.values())
    slot = F.pmod(F.col("_i") + 1, F.lit(total))
    choice, upper = None, 0
    for target, weight in weights.items():
        upper += weight
        choice = (
            F.when(slot < upper, F.lit(target))
            if choice is None
            else choice.when(slot < upper, F.lit(target))
        )
    seq = o.ordered(df, (), order_by).add(_i=o.index())
    return seq.with_columns(**{name: choice}).df.drop("_i")


def least_loaded(loads: DataFrame, target: str, load: str) -> DataFrame:
    """The target with the smallest load; the lowest id wins a tie."""
    rank = F.struct(load, target)
    return loads.agg(F.min_by(target, rank).alias(target), F.min(load).alias(load))


def tap(df: DataFrame, name: str | Observation, *metrics: Column) -> DataFrame:
    """Observe metrics of the rows that pass, without changing them.

    Given an ``Observation``, its ``get`` has the metrics once the rows have passed.
    """
    return df.observe(name, *metrics)


def concat(first: DataFrame, *others: DataFrame, name: str = "part") -> DataFrame:
    """All rows of the first input before all of the second: the part leads the order."""
    whole = first.withColumn(name, F.lit(0))
    for i, df in enumerate(others, start=1):
        whole = whole.unionByName(df.withColumn(name, F.lit(i)))
    return whole
