"""Newest, oldest and last-known rows per slot - aggregates with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.time import slot_start
from millrace.operators import ordered as o

Names = Sequence[str] | str

# Spark limits ranked groups before the shuffle up to this rank (its own default).
GROUP_LIMIT = 1000


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _pick(df: DataFrame, by: Names, order_by: Names, newest: bool) -> DataFrame:
    by, rest = _list(by), [c for c in df.columns if c not in _list(by)]
    choose = F.max_by if newest else F.min_by
    row = choose(F.struct(*rest), F.struct(*_list(order_by))).alias("_row")
    return df.groupBy(*by).agg(row).select(*by, "_row.*")


def newest_per(df: DataFrame, by: Names, order_by: Names) -> DataFrame:
    return _pick(df, by, order_by, newest=True)


def oldest_per(df: DataFrame, by: Names, order_by: Names) -> DataFrame:
    return _pick(df, by, order_by, newest=False)


def with_slot(df: DataFrame, ts: str, width: str, name: str = "slot") -> DataFrame:
    """The start of each row's time slot; rows without a time share the null slot."""
    return df.withColumn(name, slot_start(ts, width))


def conflate(df: DataFrame, by: Names, ts: str, width: str, order_by: Names) -> DataFrame:
    """Only the newest row per key and time slot."""
    return newest_per(with_slot(df, ts, width), [*_list(by), "slot"], order_by)


def sample_first(df: DataFrame, by: Names, ts: str, width: str, order_by: Names) -> DataFrame:
    """At most one row per key and time slot: the first."""
    return oldest_per(with_slot(df, ts, width), [*_list(by), "slot"], order_by)


def keep_newest(df: DataFrame, by: Names, order_by: Names, n: int) -> DataFrame:
    """Last ``n`` rows per key.

    Spark limits each group before the shuffle while ``n`` is small, so a heavy key sends
    ``n`` rows per task.  A large ``n`` is a position in the order, counted from the end.
    """
    by, order_by = _list(by), _list(order_by)
    if n > GROUP_LIMIT:
        placed = o.ordered(df, by, order_by).add(_i=o.index()).df
        sizes = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(
            F.count(F.lit(1)).alias("_n")
        )
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
        kept = placed.join(sizes, same).where(F.col("_i") >= F.col("_n") - n)
        return kept.select(*df.columns)
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def kth_smallest(
    df: DataFrame, by: Names, value: str, k: int, tie: Names = (), small_k: int = GROUP_LIMIT
) -> DataFrame:
    """k-th smallest value per key (1-based); keys with fewer rows give none.

    For a small k each task sends its k smallest; a large k is a position in the order.
    """
    if k <= small_k:
        w = Window.partitionBy(*_list(by)).orderBy(value, *_list(tie))
        ranked = df.withColumn("_rn", F.row_number().over(w))
        return ranked.where(F.col("_rn") <= k).where(F.col("_rn") == k).drop("_rn")
    seq = o.ordered(df, by, [value, *_list(tie)]).add(_rn=o.index())
    return seq.where(F.col("_rn") == k - 1).df.drop("_rn")


def retained(df: DataFrame, topic: Names, ts: str, order_by: Names, since: Column) -> DataFrame:
    """What a subscriber joining at ``since`` gets: last value per topic, then later rows."""
    before = newest_per(df.where(F.col(ts) <= since), topic, order_by)
    return (
        before.select(*df.columns)
        .withColumn("retained", F.lit(True))
        .unionByName(df.where(F.col(ts) > since).withColumn("retained", F.lit(False)))
    )


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of an order (planned as take-ordered, not as a full sort)."""
    return df.orderBy(*order).limit(n)


def merge_by_priority(
    df: DataFrame, source: str, order_by: Names, weights: dict[str, int], n: int
) -> DataFrame:
    """The first ``n`` rows when sources are drained in proportion to their weight.

    A row's turn is its position in its source divided by the weight; equal turns go to
    the larger weight.  Sources without a weight take no part.
    """
    weight = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col(source)]
    weighed = df.where(F.col(source).isin(*weights))
    if n > GROUP_LIMIT:
        placed = o.ordered(weighed, source, _list(order_by)).add(position=o.index()).df
        numbered = placed.withColumn("position", (F.col("position") + 1).cast("int"))
    else:
        w = Window.partitionBy(source).orderBy(*_list(order_by))
        numbered = weighed.withColumn("position", F.row_number().over(w))
    ranked = numbered.where(F.col("position") <= n)  # no source gives more than n of the n rows
    return (
        ranked.withColumn("weight", weight)
        .withColumn("turn", F.col("position") / F.col("weight"))
        .orderBy("turn", F.col("weight").desc(), source)
        .limit(n)
    )
