"""Running computations over rows in an explicit order, safe for heavy keys.

A plain ``Window.partitionBy(key).orderBy(...)`` sends all rows of a key to one task.
That is the best plan as long as no key is too heavy, and it is what is used then: one
exchange and one sort, shared by every running column added to the same ``Ordered``.

When a key (or the whole table, if no key is given) has more rows than a task should
hold, it is cut into consecutive blocks of bounded size, by ranges of the first order
column or, where that cannot be, by range partitions of all order columns.  Every running
column is then computed

1. inside each block, by the same window expressions, and
2. across blocks, from one summary row per (key, block) - counts, sums, last values -
   scanned in block order and joined back.  There are about ``rows / rows_per_task``
   summary rows of heavy keys, which is what bounds the broadcast.

Light keys keep block -1 and take the plain path in the same plan.  Very large inputs have two
levels: range partitions, and blocks of bounded size inside each.  Their summaries are joined
without a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.time import micros_of
from millrace.runtime import Limits, estimated_bytes, pin

BLOCK = "_block"
LIGHT = -1
# More partitions would cost more in shuffle files than they save, and more lookup rows are not
# broadcast.  Blocks do not grow beyond it: partitions are then cut into several blocks each.
MOST_BLOCKS = 20_000
# Several small blocks share a task; that evens out how they fall into tasks by hash.
BLOCKS_PER_TASK = 4
# Histogram bins per block.
BINS_PER_BLOCK = 8


@dataclass(frozen=True)
class Running:
    """A running column: its form inside a block and how blocks are put together."""

    local: Callable[[Window], Column]  # over the rows of one block
    summary: Callable[[Column], Column]  # aggregate of one block, given the order struct
    carry: Callable[[Column, Window], Column]  # scan of the summaries, blocks before this one
    combine: Callable[[Column, Column], Column]  # (local, carried) -> value
    plain: Callable[[Window], Column]  # the whole thing when the key is one block


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _boxed(c: Column) -> Column:
    # A struct is never null, so "no such row" and "row with a null" stay apart.
    return F.struct(c.alias("v"))


def index() -> Running:
    """0-based position."""
    return Running(
        local=lambda w: F.row_number().over(w).cast("bigint"),
        summary=lambda order: F.count(F.lit(1)),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        combine=lambda here, past: here + F.coalesce(past, F.lit(0)) - 1,
        plain=lambda w: F.row_number().over(w).cast("bigint") - 1,
    )


def running_sum(value: Column | str) -> Running:
    v = _col(value)
    return Running(
        local=lambda w: F.sum(v).over(_upto(w)),
        summary=lambda order: F.sum(v),
        carry=lambda s, w: F.sum(s).over(_before(w)),
        combine=lambda here, past: F.coalesce(here + past, here, past),
        plain=lambda w: F.sum(v).over(_upto(w)),
    )


def running_product(value: Column | str) -> Running:
    v = _col(value)
    return Running(
        local=lambda w: F.product(v).over(_upto(w)),
        summary=lambda order: F.product(v),
        carry=lambda s, w: F.product(s).over(_before(w)),
        combine=lambda here, past: F.coalesce(here * past, here, past),
        plain=lambda w: F.product(v).over(_upto(w)),
    )


def running_max(value: Column | str) -> Running:
    v = _col(value)
    return Running(
        local=lambda w: F.max(v).over(_upto(w)),
        summary=lambda order: F.max(v),
        carry=lambda s, w: F.max(s).over(_before(w)),
        combine=lambda here, past: F.greatest(here, past),
        plain=lambda w: F.max(v).over(_upto(w)),
    )


def running_min(value: Column | str) -> Running:
    v = _col(value)
    return Running(
        local=lambda w: F.min(v).over(_upto(w)),
        summary=lambda order: F.min(v),
        carry=lambda s, w: F.min(s).over(_before(w)),
        combine=lambda here, past: F.least(here, past),
        plain=lambda w: F.min(v).over(_upto(w)),
    )


def last_known(value: Column | str) -> Running:
    """Newest non-null value at or before the row."""
    v = _col(value)
    return Running(
        local=lambda w: F.last(v, ignorenulls=True).over(_upto(w)),
        summary=lambda order: F.max_by(v, F.when(v.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        combine=lambda here, past: F.coalesce(here, past),
        plain=lambda w: F.last(v, ignorenulls=True).over(_upto(w)),
    )


def first_value(value: Column | str) -> Running:
    """Value of the first row of the sequence."""
    v = _col(value)
    return Running(
        local=lambda w: F.first(_boxed(v)).over(_upto(w)),
        summary=lambda order: F.min_by(_boxed(v), order),
        carry=lambda s, w: F.first(s).over(_before(w)),
        combine=lambda here, past: F.coalesce(past, here)["v"],
        plain=lambda w: F.first(v).over(_upto(w)),
    )


def lag(value: Column | str) -> Running:
    """Value of the row before; null for the first row."""
    v = _col(value)
    return Running(
        local=lambda w: F.lag(_boxed(v)).over(w),
        summary=lambda order: F.max_by(_boxed(v), order),
        carry=lambda s, w: F.lag(s).over(w),
        combine=lambda here, past: F.coalesce(here, past)["v"],
        plain=lambda w: F.lag(v).over(w),
    )


def lead(value: Column | str) -> Running:
    """Value of the row after; null for the last row."""
    v = _col(value)
    return Running(
        local=lambda w: F.lead(_boxed(v)).over(w),
        summary=lambda order: F.min_by(_boxed(v), order),
        carry=lambda s, w: F.lead(s).over(w),
        combine=lambda here, coming: F.coalesce(here, coming)["v"],
        plain=lambda w: F.lead(v).over(w),
    )


@dataclass(frozen=True)
class Ordered:
    """Rows of ``rows`` per ``by`` in the total order ``order_by`` (ascending)."""

    rows: DataFrame
    by: tuple[str, ...]
    order_by: tuple[str, ...]
    blocked: bool
    wide: bool = False  # more blocks than a broadcast should hold

    def _small(self, summaries: DataFrame) -> DataFrame:
        return summaries if self.wide else F.broadcast(summaries)

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(BLOCK)

    def add(self, **columns: Running) -> "Ordered":
        """Add running columns; those of one call share one pass."""
        return self._blocked_add(columns) if self.blocked else self._plain_add(columns)

    def select(self, *columns: Column | str) -> "Ordered":
        """Row-wise projection; keys and order columns must stay."""
        kept = [F.col(BLOCK)] if self.blocked else []
        return self._with(self.rows.select(*columns, *kept))

    def where(self, condition: Column | str) -> "Ordered":
        return self._with(self.rows.where(condition))

    def with_columns(self, **columns: Column) -> "Ordered":
        return self._with(self.rows.withColumns(columns))

    def drop(self, *columns: str) -> "Ordered":
        return self._with(self.rows.drop(*columns))

    def _with(self, rows: DataFrame) -> "Ordered":
        return Ordered(rows, self.by, self.order_by, self.blocked, self.wide)

    def number_groups(
        self, name: str, columns: Sequence[str], starts: Callable[[Column, Column], Column]
    ) -> "Ordered":
        """Number groups of consecutive rows from 0.

        A row starts a new group where ``starts(previous, this)`` holds; both are structs of
        the named columns.  The first row starts group 0.  One pass over the blocks: their
        summaries hold the starts inside and the rows at both ends.
        """
        this = F.struct(*columns)
        keys = [*self.by, BLOCK] if self.blocked else list(self.by)
        w = Window.partitionBy(*keys).orderBy(*self.order_by)
        started = lambda a, b: F.when(
            a.isNotNull() & F.coalesce(starts(a, b), F.lit(False)), 1
        ).otherwise(0)
        marked = self.rows.withColumn("_prev", F.lag(this).over(w)).withColumn(
            "_start", started(F.col("_prev"), this)
        )
        local = F.sum("_start").over(_upto(w))
        if not self.blocked:
            return self._with(marked.withColumn(name, local).drop("_prev", "_start"))

        order = F.struct(*self.order_by)
        summaries = (
            marked.where(F.col(BLOCK) > LIGHT)
            .groupBy(*keys)
            .agg(
                F.sum("_start").alias("_s"),
                F.min_by(this, order).alias("_first"),
                F.max_by(this, order).alias("_last"),
            )
        )
        across = Window.partitionBy(*self.by).orderBy(BLOCK)
        seams = summaries.withColumn("_before", F.lag("_last").over(across)).withColumn(
            "_seam", started(F.col("_before"), F.col("_first"))
        )
        past = F.sum("_seam").over(_upto(across)) + F.coalesce(
            F.sum("_s").over(_before(across)), F.lit(0)
        )
        carried = seams.select(*[F.col(k).alias(f"_k_{k}") for k in keys], past.alias("_c"))
        joined = marked.withColumn("_l", local).join(
            self._small(carried), self._same_block(), "left"
        )
        return self._with(
            joined.select(
                *[c for c in self.rows.columns if c != name],
                (F.col("_l") + F.coalesce(F.col("_c"), F.lit(0))).alias(name),
            )
        )

    def ahead(self, name: str, value: Column | str, size: int, first: str) -> "Ordered":
        """The values of each row and of the ``size - 1`` rows after it, as an array that is
        shorter at the end of a sequence; ``first`` tells the first row of a sequence.

        One pass over the blocks: their summaries hold their first ``size - 1`` values, and a
        block gets those of the blocks after it.
        """
        this = _boxed(_col(value))
        keys = [*self.by, BLOCK] if self.blocked else list(self.by)
        w = Window.partitionBy(*keys).orderBy(*self.order_by)
        near = self.rows.withColumns(
            {"_ahead": F.collect_list(this).over(w.rowsBetween(0, size - 1)), "_rn": F.row_number().over(w)}
        )
        values = lambda boxes: F.transform(boxes, lambda s: s["v"])
        is_first = F.col("_rn") == 1
        if not self.blocked:
            done = near.withColumns({name: values(F.col("_ahead")), first: is_first})
            return self._with(done.drop("_ahead", "_rn"))

        by_place = lambda a, b: a["_rn"] - b["_rn"]
        heads = (
            near.where((F.col(BLOCK) > LIGHT) & (F.col("_rn") < max(size, 2)))
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_rn", this.alias("box"))), by_place).alias("_heads"))
            .withColumn("_heads", F.transform("_heads", lambda h: h["box"]))
        )
        across = Window.partitionBy(*self.by).orderBy(BLOCK)
        coming = F.flatten(F.collect_list("_heads").over(across.rowsBetween(1, max(size - 1, 1))))
        carried = heads.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.slice(coming, 1, size - 1).alias("_coming"),
            (F.row_number().over(across) == 1).alias("_leads"),
        )
        joined = near.join(self._small(carried), self._same_block(), "left")
        whole = F.when(F.col("_coming").isNull(), F.col("_ahead")).otherwise(
            F.slice(F.concat("_ahead", "_coming"), 1, size)
        )
        return self._with(
            joined.select(
                *[c for c in self.rows.columns if c not in (name, first)],
                values(whole).alias(name),
                (is_first & F.coalesce("_leads", F.lit(True))).alias(first),
            )
        )

    def _same_block(self) -> Column:
        keys = [*self.by, BLOCK]
        return reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        )

    def _plain_add(self, columns: dict[str, Running]) -> "Ordered":
        w = Window.partitionBy(*self.by).orderBy(*self.order_by)
        return self._with(self.rows.withColumns({n: r.plain(w) for n, r in columns.items()}))

    def _blocked_add(self, columns: dict[str, Running]) -> "Ordered":
        keys = [*self.by, BLOCK]
        order = F.struct(*self.order_by)
        inside = Window.partitionBy(*keys).orderBy(*self.order_by)
        local = self.rows.withColumns({f"_l_{n}": r.local(inside) for n, r in columns.items()})

        summaries = (
            self.rows.where(F.col(BLOCK) > LIGHT)
            .groupBy(*keys)
            .agg(*[r.summary(order).alias(f"_s_{n}") for n, r in columns.items()])
        )
        across = Window.partitionBy(*self.by).orderBy(BLOCK)
        carried = summaries.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            *[r.carry(F.col(f"_s_{n}"), across).alias(f"_c_{n}") for n, r in columns.items()],
        )
        joined = local.join(self._small(carried), self._same_block(), "left")
        return self._with(
            joined.select(
                *[c for c in self.rows.columns if c not in columns],
                *[
                    r.combine(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
                    for n, r in columns.items()
                ],
            )
        )


def ordered(
    df: DataFrame, by: Sequence[str] | str = (), order_by: Sequence[str] | str = ()
) -> Ordered:
    """Look at ``df`` as sequences per ``by`` in the order ``order_by``.

    ``order_by`` must be a total order within a key (end it with a unique column).
    Without ``by`` the whole table is one sequence.  An input that is costly to make
    should be a table: looking for heavy keys reads it once more.
    """
    by = (by,) if isinstance(by, str) else tuple(by)
    order_by = (order_by,) if isinstance(order_by, str) else tuple(order_by)
    if not order_by:
        raise ValueError("rows have no order of their own: name the order columns")
    plain = Ordered(df, by, order_by, blocked=False)
    limits = Limits.of(df.sparkSession)
    if estimated_bytes(df) <= limits.small_bytes and _estimate_counts(df, by):
        return plain

    # One column-pruned pass with map-side counts; at most rows / rows_per_task keys remain.
    place = _place(df, order_by[0])
    ends = [f(place).alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"))] if place is not None else []
    heavy = pin(
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), *ends)
        .where(F.col("_n") > limits.rows_per_task),
        "heavy-keys",
    )
    total, keys = heavy.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if total == 0:
        return plain
    # heavy keys, blocks and bins of these are all fewer than this
    wide = BLOCKS_PER_TASK * total // limits.rows_per_task + keys > MOST_BLOCKS
    rows = None
    if place is not None and not wide:
        rows = _value_blocks(df, by, place, heavy, limits)
    if rows is None:
        rows = _range_blocks(df, by, order_by, heavy, total, wide, limits)
    return Ordered(rows, by, order_by, blocked=True, wide=wide)


def _estimate_counts(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether the size estimate says something about the rows.

    Catalyst takes a generator for one that gives a row each, so below one rows are counted; and
    a table without a key, all one sequence, may be many rows of few bytes.
    """
    if "Generate " in df._jdf.queryExecution().optimizedPlan().toString():
        return False
    return bool(by) or estimated_bytes(df) <= Limits.of(df.sparkSession).small_bytes // 8


def _place(df: DataFrame, column: str) -> Column | None:
    """The column as a number in the same order; None where there is none (texts, say)."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros_of(df, column)(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    return None


def _match(by: Sequence[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in by], F.lit(True)
    )


def _prefixed(df: DataFrame, by: Sequence[str], prefix: str, *rest: Column | str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in by], *rest)


def _value_blocks(
    df: DataFrame, by: tuple[str, ...], place: Column, heavy: DataFrame, limits: Limits
) -> DataFrame | None:
    """Blocks by ranges of the first order column.  The block is a function of the row.

    A histogram of the heavy keys, finer than needed, is put together to blocks of about
    equal size; rows find their block through two broadcast lookups.  Nothing is shuffled
    or written but the small tables, and light rows pass through the same plan.
    None when single places hold too many rows to be cut this way.
    """
    per_block = -(-limits.rows_per_task // BLOCKS_PER_TASK)
    meta = heavy.select(
        *by,
        "_lo",
        ((F.ceil(F.col("_n") / per_block) * BINS_PER_BLOCK) / (F.col("_hi") - F.col("_lo") + 1)).alias(
            "_scale"
        ),
    )
    if by:
        known = F.broadcast(_prefixed(meta, by, "_h_", "_lo", "_scale"))
        placed = df.join(known, _match(by, "_h_"), "left")
    else:  # one sequence: its two numbers are constants
        low, scale = meta.first()
        placed = df.withColumns({"_lo": F.lit(low), "_scale": F.lit(scale)})
    # rows without a place come first in the order, as the smallest do
    binned = placed.withColumn(
        "_bin",
        F.when(
            F.col("_lo").isNotNull(),
            F.coalesce(F.floor((place - F.col("_lo")) * F.col("_scale")), F.lit(0)),
        ),
    ).drop(*[f"_h_{k}" for k in by], "_lo", "_scale")

    counts = binned.where(F.col("_bin").isNotNull()).groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_n")
    )
    upto = F.sum("_n").over(_upto(Window.partitionBy(*by).orderBy("_bin")))
    bins = pin(
        counts.select(*by, "_bin", "_n", F.floor((upto - F.col("_n")) / per_block).cast("int").alias(BLOCK)),
        "bins",
    )
    if bins.agg(F.max("_n")).first()[0] > max(limits.rows_per_task, 2 * per_block):
        return None
    lookup = F.broadcast(_prefixed(bins, by, "_b_", F.col("_bin").alias("_b_bin"), BLOCK))
    same = _match(by, "_b_") & (F.col("_bin") == F.col("_b_bin"))
    return (
        binned.join(lookup, same, "left")
        .withColumn(BLOCK, F.coalesce(F.col(BLOCK), F.lit(LIGHT)))
        .drop("_bin", "_b_bin", *[f"_b_{k}" for k in by])
    )


def _range_blocks(
    df: DataFrame,
    by: tuple[str, ...],
    order_by: tuple[str, ...],
    heavy: DataFrame,
    total: int,
    wide: bool,
    limits: Limits,
) -> DataFrame:
    """Blocks by range partitions of all order columns, for any type and any ties.

    Where there would be too many partitions, each is sorted and cut into blocks by position; the
    block is then the upper part of the row's place (partition, position).  The block of a row
    depends on sampled bounds, so the heavy rows are written once.
    """
    # Twice as many blocks as needed on average: the bounds come from a sample.
    n = min(max(2, -(-2 * total // limits.rows_per_task)), MOST_BLOCKS)
    known = _prefixed(heavy, by, "_h_")
    known = known if wide else F.broadcast(known)
    heavy_rows = df.join(known, _match(by, "_h_"), "left_semi") if by else df
    ranged = heavy_rows.repartitionByRange(n, *by, *order_by)
    if wide:
        ranged = ranged.sortWithinPartitions(*by, *order_by)
        bits = max(limits.rows_per_task.bit_length() - 1, 0)
        block = F.shiftright(F.monotonically_increasing_id(), bits)
    else:
        block = F.spark_partition_id().cast("bigint")
    blocks = pin(ranged.withColumn(BLOCK, block), "blocks")
    if not by:
        return blocks
    light = df.join(known, _match(by, "_h_"), "left_anti")
    return light.withColumn(BLOCK, F.lit(LIGHT).cast("bigint")).unionByName(blocks)
