"""Aggregates.  All of them combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import lower_median, medians_by
from millrace.functions.numbers import floor_2, integer_average
from millrace.functions.time import slot_start
from millrace.operators import ordered as o
from millrace.operators import sequence as sq

Names = Sequence[str] | str

def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def delay_average(df: DataFrame, by: Names, delay: str) -> DataFrame:
    """Count, sum and integer average of the positive values per key."""
    return (
        df.where(F.col(delay) > 0)
        .groupBy(*_list(by))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(delay).cast("bigint").alias("total"))
        .withColumn("average", integer_average("total", "n"))
    )


def min_mean_max(
    df: DataFrame, by: Names, value: str, seed_zero: bool = False
) -> DataFrame:
    """Count, minimum, mean and maximum per key, sorted by key.  Values are summed as they are.

    ``seed_zero`` starts minimum and maximum at 0, so that 0 counts as seen.
    """
    low, high = F.min(value), F.max(value)
    if seed_zero:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    return (
        df.groupBy(*_list(by))
        .agg(
            F.count(value).alias("n"),
            low.alias("lowest"),
            high.alias("highest"),
            F.avg(value).alias("mean"),
        )
        .orderBy(*_list(by))
    )


def partials(df: DataFrame, by: Names, value: str) -> DataFrame:
    """Mergeable state per key: count, total, lowest, highest.  Can be stored and merged later."""
    return df.groupBy(*_list(by)).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def merge_partials(states: DataFrame, by: Names) -> DataFrame:
    return states.groupBy(*_list(by)).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    )


def count_words(words: DataFrame, word: str, ignore: Sequence[str] = ()) -> DataFrame:
    return (
        words.where(~F.col(word).isin(*ignore)) if ignore else words
    ).groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def empty_safe_sum(
    df: DataFrame,
    value: Column | str,
    name: str = "total",
    by: Names = (),
    where: Column | None = None,
) -> DataFrame:
    """Sum of the rows for which ``where`` holds, 0 for none: one row, or one per key."""
    v = F.col(value) if isinstance(value, str) else value
    total = F.sum(v if where is None else F.when(where, v))
    return df.groupBy(*_list(by)).agg(F.coalesce(total, F.lit(0)).alias(name))


def median_of_medians(
    df: DataFrame, by: Names, order_by: Names, value: str, batch: int = 100, group: int = 5
) -> DataFrame:
    """Approximate median of each batch of rows: medians of fives, repeated.

    Batches hold at most ``batch`` values, which bounds the arrays.  Levels of medians are
    taken while more than ``group`` values remain.
    """
    by = _list(by)
    batched = sq.chunks(o.ordered(df, by, order_by).add(_pos=o.index()), batch, "batch_no").df
    listed = batched.groupBy(*by, "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("v")))).alias("_rows"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("_m", F.transform("_rows", lambda r: r["v"]))
    # the first level always runs: fives are formed even of a short batch
    listed = listed.withColumn("_m", medians_by("_m", group))
    most = -(-batch // group)
    while most > group:
        listed = listed.withColumn(
            "_m", F.when(F.size("_m") > group, medians_by("_m", group)).otherwise(F.col("_m"))
        )
        most = -(-most // group)
    return listed.withColumn("median", lower_median("_m")).drop("_rows", "_m")


def series_count(df: DataFrame, series: Names, ts: str, since: Column, until: Column) -> DataFrame:
    """Number of series with a point in the time range; 0 for none."""
    return (
        df.where((F.col(ts) >= since) & (F.col(ts) <= until))
        .agg(F.count_distinct(*[F.col(c) for c in _list(series)]).alias("n_series"))
    )


def merge_points(
    df: DataFrame, identity: Names, fields: Sequence[str], newer: Names
) -> DataFrame:
    """Points of one identity merged: per field the newest value that is not null."""
    rank = F.struct(*_list(newer))
    return df.groupBy(*_list(identity)).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    )


def downsample(df: DataFrame, by: Names, ts: str, width: str, value: str) -> DataFrame:
    """One observation per key and time slot: mean, extremes, count, first and last time.

    Rows without a time make up a slot of their own, the null slot.
    """
    return (
        df.groupBy(*_list(by), slot_start(ts, width).alias("slot"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.avg(value).alias("mean"),
        )
    )


def batch_means(
    df: DataFrame,
    by: Names,
    order_by: Names,
    ts: str,
    value: str,
    ident: str,
    size: int = 100,
    width: str = "1 second",
) -> DataFrame:
    """Mean per size-or-time batch, cut to two decimals, with the running count per key.

    A batch is attributed to the id of its first row.
    """
    by = _list(by)
    batched = sq.timed_chunks(df, by, order_by, ts, size, width)
    means = (
        batched.groupBy(*by, "bucket", "chunk_no")
        .agg(
            F.min_by(ident, F.struct(*_list(order_by))).alias("first_id"),
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("_m"),
        )
        # the order of a sum of doubles shows in far places: those go before the cut
        .withColumn("mean", floor_2(F.round("_m", 9)))
        .drop("_m")
    )
    return o.ordered(means, by, ["bucket", "chunk_no"]).add(measured=o.running_sum("n")).df


def deltas(df: DataFrame, by: Names, order_by: Names, value: str, name: str = "delta") -> DataFrame:
    """Change against the value before; the first value counts from 0."""
    seq = o.ordered(df, by, order_by).add(_p=o.lag(value))
    return seq.with_columns(
        **{name: F.col(value) - F.coalesce(F.col("_p"), F.lit(0))}
    ).df.drop("_p")


def running_maps(
    df: DataFrame,
    by: Names,
    order_by: Names,
    key: str,
    value: str,
    keys: Sequence[str] | None = None,
    most_columns: int = 64,
) -> DataFrame:
    """After each row, the map of all keys so far with their newest value (``so_far``).

    Each sequence starts with the empty map: one more row, null in all columns but ``by``.
    A row without a key stays and adds no entry.
    Few keys: one last-known column per key, so no list of past rows is kept.  ``keys``
    names them; otherwise they are looked up if there are at most ``most_columns``.  More
    keys: one row per (row, key of its sequence), the newest value per key looked up as of
    each row, and the entries put together per row; that is as large as the maps are.
    """
    by, order_by = _list(by), _list(order_by)
    if keys is None:
        named = df.where(F.col(key).isNotNull()).select(key).distinct()
        found = named.limit(most_columns + 1).collect()
        keys = sorted(r[0] for r in found) if len(found) <= most_columns else None
    if keys is None:
        mapped = _running_maps_long(df, by, order_by, key, value)
    else:
        mapped = _running_maps_wide(df, by, order_by, key, value, keys)
    starts = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in by]
    starts = starts.select(*by, *nulls, _no_entries(df, key, value).alias("so_far"))
    return mapped.select(*df.columns, "so_far").unionByName(starts)


def _no_entries(df: DataFrame, key: str, value: str) -> Column:
    none = F.struct(
        F.lit(None).cast(df.schema[key].dataType).alias("key"),
        F.lit(None).cast(df.schema[value].dataType).alias("value"),
    )
    return F.map_from_entries(F.filter(F.array(none), lambda e: F.lit(False)))


def _running_maps_wide(
    df: DataFrame, by: list[str], order_by: list[str], key: str, value: str, keys: Sequence[str]
) -> DataFrame:
    slots = {f"_k{i}": k for i, k in enumerate(keys)}
    if not slots:
        return df.withColumn("so_far", _no_entries(df, key, value))
    boxed = F.struct(F.col(key).alias("key"), F.col(value).alias("value"))
    seq = o.ordered(df, by, order_by).with_columns(
        **{s: F.when(F.col(key) == k, boxed) for s, k in slots.items()}
    )
    seq = seq.add(**{f"{s}_": o.last_known(s) for s in slots})
    entries = F.filter(F.array(*[f"{s}_" for s in slots]), lambda e: e.isNotNull())
    return seq.with_columns(so_far=F.map_from_entries(entries)).df.drop(
        *slots, *[f"{s}_" for s in slots]
    )


def _null_safe(columns: Sequence[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns], F.lit(True)
    )


def _running_maps_long(
    df: DataFrame, by: list[str], order_by: list[str], key: str, value: str
) -> DataFrame:
    row_id = [*by, *order_by]
    firsts = df.where(F.col(key).isNotNull()).groupBy(
        *[F.col(c).alias(f"_f_{c}") for c in by], F.col(key).alias("_key")
    ).agg(F.min(F.struct(*order_by)).alias("_first"))
    # only the keys that are in the map of the row: the output, entry by entry
    seen = F.struct(*order_by) >= F.col("_first")
    wide = df.select(*row_id, key, value).join(firsts, _null_safe(by, "_f_") & seen)
    boxed = F.when(F.col(key) == F.col("_key"), F.struct(F.col(value).alias("v")))
    filled = o.ordered(wide.withColumn("_own", boxed), [*by, "_key"], order_by).add(
        _newest=o.last_known("_own")
    )
    entry = F.struct(F.col("_key").alias("key"), F.col("_newest")["v"].alias("value"))
    maps = filled.df.groupBy(*[F.col(c).alias(f"_m_{c}") for c in row_id]).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_map")
    )
    return df.join(maps, _null_safe(row_id, "_m_"), "left").withColumn(
        "so_far", F.coalesce("_map", _no_entries(df, key, value))
    )


def coverage(
    df: DataFrame, by: Names, branch: str, order_by: Names, branches: int
) -> DataFrame:
    """Distinct branches seen per key and when the last missing one came (null: not all)."""
    by = _list(by)
    firsts = df.groupBy(*by, branch).agg(F.min(F.struct(*_list(order_by))).alias("_first"))
    return firsts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"),
        F.max("_first").alias("_last"),
    ).select(
        *by,
        "seen",
        (F.col("seen") == branches).alias("complete"),
        F.when(F.col("seen") == branches, F.col("_last")[_list(order_by)[0]]).alias("complete_at"),
    )


def throughput(df: DataFrame, ts: str, width: str, by: Names = ()) -> DataFrame:
    """Elements per time slot; those without a time are counted in the null slot."""
    return df.groupBy(*_list(by), slot_start(ts, width).alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )


def overall_rate(count: Column, elapsed_ms: Column, least_seconds: int = 5) -> Column:
    """Elements per whole second; 0 below the least measuring time."""
    seconds = F.floor(elapsed_ms / 1000)
    return F.when(seconds < least_seconds, F.lit(0)).otherwise(integer_average(count, seconds))
