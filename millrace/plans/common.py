"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import ordered as o
from millrace.operators.ordered import Ordered
from millrace.sources.tables import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def user_events(spark: SparkSession, sf_dir: str, *columns: str) -> Ordered:
    """Events per user in time order; only the named columns are read besides the keys."""
    df = events(spark, sf_dir).select("user_id", "ts", "event_id", *columns)
    return o.ordered(df, "user_id", ["ts", "event_id"])
