"""Array columns: parts, pairs, order statistics of small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(values: Column | str) -> Column:
    return F.try_element_at(_col(values), F.lit(1))


def last(values: Column | str) -> Column:
    return F.try_element_at(_col(values), F.lit(-1))


def without_head(values: Column | str) -> Column:
    v = _col(values)
    return F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))


def pairs(values: Column | str) -> Column:
    """Array of the structs (a, b) with a before b in the list."""
    v = _col(values)
    per_head = F.transform(
        v,
        lambda x, i: F.transform(
            F.slice(v, i + 2, F.size(v)), lambda y: F.struct(x.alias("a"), y.alias("b"))
        ),
    )
    return F.flatten(per_head)


def fold_sum(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def lower_median(values: Column | str) -> Column:
    """Middle element of the sorted array, the lower one of an even count."""
    v = F.array_sort(_col(values))
    return F.element_at(v, F.floor((F.size(v) + 1) / 2).cast("int"))


def medians_by(values: Column | str, size: int) -> Column:
    """Lower medians of consecutive slices of ``size`` elements."""
    v = _col(values)
    starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
    return F.transform(starts, lambda i: lower_median(F.slice(v, i * size + 1, size)))
