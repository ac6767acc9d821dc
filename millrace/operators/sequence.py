"""Sequence operators: runs, sessions, chunks, folds - all on ``ordered`` rows.

Group numbers are 0-based and grow in row order.  Group-building operators return the
rows with their group number; ``summarise`` reduces them with map-side partial
aggregation, so a group of any size never sits in one task as a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.time import micros_of, slot_start
from millrace.operators import ordered as o
from millrace.operators.ordered import Ordered

Names = Sequence[str] | str
MICROS = 1_000_000
BEATS = 10_000


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def row_index(seq: Ordered, name: str = "idx") -> Ordered:
    """0-based position of each row."""
    return seq.add(**{name: o.index()})


def sliding(seq: Ordered, value: str, size: int, name: str = "win") -> DataFrame:
    """Arrays of ``size`` consecutive values, one step apart.

    There are ``size - 1`` fewer windows than rows; a sequence shorter than ``size``
    gives one short window.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    seen = seq.ahead(name, value, size, "_is_first")
    return seen.where((F.size(name) == size) | F.col("_is_first")).df.drop("_is_first")


def drop_consecutive_duplicates(seq: Ordered, value: str) -> DataFrame:
    """Keep the first row of each run of equal values (nulls equal nulls)."""
    marked = seq.with_columns(_v=F.struct(F.col(value).alias("v"))).add(_p=o.lag("_v"))
    keep = F.col("_p").isNull() | ~F.col("_p")["v"].eqNullSafe(F.col(value))
    return marked.where(keep).df.drop("_v", "_p")


def runs(seq: Ordered, key: str, name: str = "run_no") -> Ordered:
    """A new group whenever the key differs from the row before."""
    return seq.number_groups(name, [key], lambda a, b: ~a[key].eqNullSafe(b[key]))


def sessions(
    seq: Ordered, ts: str, gap_seconds: float, name: str = "session_no"
) -> Ordered:
    """A new group when the time since the row before is at least the gap."""
    gap, micros = int(gap_seconds * MICROS), micros_of(seq.rows, ts)
    return seq.number_groups(name, [ts], lambda a, b: micros(b[ts]) - micros(a[ts]) >= gap)


def number_sessions(seq: Ordered, at: str, gap: int, name: str = "session_no") -> Ordered:
    """Sessions over plain numbers, with the same rule: a gap equal to the limit splits."""
    return seq.number_groups(name, [at], lambda a, b: b[at] - a[at] >= gap)


def scenes(
    seq: Ordered, start: str, end: str, max_gap: int, name: str = "scene_no"
) -> Ordered:
    """Intervals (numbers) grouped while the next start is closer than the gap to the last end.

    The end of the row before counts, not the largest end so far.
    """
    return seq.number_groups(name, [start, end], lambda a, b: b[start] - a[end] >= max_gap)


def flush_batches(
    seq: Ordered, ts: str, flush: Column, idle_seconds: float, name: str = "batch_no"
) -> DataFrame:
    """Item rows with their batch: closed by a flush row, or by a pause of the idle time.

    Flush rows are no items, and a batch without items does not exist, so the numbers are
    those of the item rows only.
    """
    idle, micros = int(idle_seconds * MICROS), micros_of(seq.rows, ts)
    closed = seq.with_columns(_f=flush).number_groups(
        "_raw",
        [ts, "_f"],
        lambda a, b: a["_f"] | (micros(b[ts]) - micros(a[ts]) >= idle),
    )
    items = closed.where(~F.col("_f"))
    return items.number_groups(name, ["_raw"], lambda a, b: a["_raw"] != b["_raw"]).df.drop(
        "_f", "_raw"
    )


def marker_chunks(seq: Ordered, terminator: Column, name: str = "chunk_no") -> Ordered:
    """Chunks that end with a terminator row, which stays in its chunk."""
    return (
        seq.with_columns(_t=terminator)
        .number_groups(name, ["_t"], lambda a, b: a["_t"])
        .drop("_t")
    )


def changed_seconds(
    seq: Ordered, ts: str, unit: str = "second", drop_last: bool = False, name: str = "group_no"
) -> DataFrame:
    """A new group whenever the time unit changes.

    ``drop_last`` leaves out the final row of each sequence, as counting over pairs does.
    """
    unit_of = lambda s: F.date_trunc(unit, s[ts])
    grouped = seq.number_groups(name, [ts], lambda a, b: unit_of(a) != unit_of(b))
    if drop_last:
        grouped = grouped.add(_nt=o.lead(ts)).where(F.col("_nt").isNotNull()).drop("_nt")
    return grouped.df


def chunks(seq: Ordered, size: int, name: str = "chunk_no") -> Ordered:
    """Consecutive groups of ``size`` rows; the last one may be short."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return (
        seq.add(_i=o.index())
        .with_columns(**{name: F.floor(F.col("_i") / size).cast("bigint")})
        .drop("_i")
    )


def timed_chunks(
    df: DataFrame,
    by: Names,
    order_by: Names,
    ts: str,
    size: int,
    width: str,
    bucket: str = "bucket",
    name: str = "chunk_no",
) -> DataFrame:
    """Chunks of at most ``size`` rows that do not reach over a time bucket.

    Rows without a time share the null bucket.
    """
    by = [by] if isinstance(by, str) else list(by)
    bucketed = df.withColumn(bucket, slot_start(ts, width))
    return chunks(o.ordered(bucketed, [*by, bucket], order_by), size, name).df


def summarise(
    df: DataFrame, by: Names, group: str, *aggregates: Column
) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by, group).agg(*aggregates)


def fold_text(
    df: DataFrame,
    by: Names,
    position: str,
    text: Column | str,
    separator: str = " ",
    leading: bool = False,
    name: str = "folded",
    part: str = "part",
    part_bytes: int = 64 * 1024 * 1024,
    head: str = "",
    tail: str = "",
) -> DataFrame:
    """Concatenate texts per group in the order of a position, between ``head`` and ``tail``.

    A text that gets longer than ``part_bytes`` goes on in the next part (0, 1, ...), so
    no task gathers more than that of a group however large it is; the parts put together
    are the whole text, separators included.  The head is in the first part only, the tail in
    the last.
    """
    by = [by] if isinstance(by, str) else list(by)
    value = F.col(text) if isinstance(text, str) else text
    sized = df.select(*by, position, value.alias("_t")).withColumn(
        "_b", F.coalesce(F.octet_length("_t"), F.lit(0)) + len(separator)
    )
    running = {"_upto": o.running_sum("_b")} | ({"_next": o.lead(position)} if tail else {})
    placed = o.ordered(sized, by, position).add(**running).df
    last = F.max(F.col("_next").isNull()) if tail else F.lit(False)
    start = F.floor((F.col("_upto") - F.col("_b")) / part_bytes).cast("int")
    listed = F.array_sort(F.collect_list(F.struct(position, "_t")))
    joined = F.array_join(F.transform(listed, lambda s: s["_t"]), separator)
    folded = placed.groupBy(*by, start.alias(part)).agg(
        joined.alias(name), last.alias("_last")
    )
    first = F.col(part) == 0
    before = F.when(first, F.lit(head + separator if leading else head)).otherwise(F.lit(separator))
    after = F.when(F.col("_last"), F.lit(tail)).otherwise(F.lit(""))
    return folded.withColumn(name, F.concat(before, name, after)).drop("_last")


def take_while(seq: Ordered, holds: Column) -> DataFrame:
    """Rows before the first one for which the condition does not hold."""
    failed = _flag(~F.coalesce(holds, F.lit(False)))
    return seq.with_columns(_n=failed).add(_m=o.running_max("_n")).where("_m = 0").df.drop("_n", "_m")


def drop_while(seq: Ordered, holds: Column) -> DataFrame:
    """Rows from the first one for which the condition does not hold."""
    failed = _flag(~F.coalesce(holds, F.lit(False)))
    return seq.with_columns(_n=failed).add(_m=o.running_max("_n")).where("_m = 1").df.drop("_n", "_m")


def running_fold(
    seq: Ordered, value: str, name: str = "folded", kind: str = "sum", step: str = "step"
) -> DataFrame:
    """Running sum or product; step 0 is the zero of the fold, before any row.

    Returns keys, step and the folded value: one more row than the input per sequence.
    """
    forms = {"sum": (o.running_sum, 0), "product": (o.running_product, 1)}
    form, zero = forms[kind]
    done = seq.add(**{step: o.index(), name: form(value)}).df
    at = F.struct((F.col(step) + 1).alias(step), F.col(name).alias(name))
    start = F.struct(
        F.lit(0).cast("bigint").alias(step), F.lit(zero).cast(done.schema[name].dataType).alias(name)
    )
    # the first row also brings the zero: no second look at the input
    steps = F.when(F.col(step) == 0, F.array(start, at)).otherwise(F.array(at))
    return done.select(*seq.by, F.explode(steps).alias("_s")).select(*seq.by, "_s.*")


def special_first(seq: Ordered, first: Column, rest: Column, name: str = "treated") -> DataFrame:
    """One expression for the first row of each sequence, another for the rest."""
    return (
        seq.add(_i=o.index())
        .with_columns(**{name: F.when(F.col("_i") == 0, first).otherwise(rest)})
        .df.drop("_i")
    )


def head_with_rest(seq: Ordered, value: str, name: str = "head") -> DataFrame:
    """The first value attached to every later row."""
    return seq.add(_i=o.index(), **{name: o.first_value(value)}).where("_i > 0").df.drop("_i")


def dedupe_with_reset(
    df: DataFrame, key: Names, order_by: Names, count: int | None = None
) -> DataFrame:
    """First occurrence per key; after ``count`` occurrences a key is forgotten.

    Without a count every key passes once.
    """
    seq = o.ordered(df, key, order_by).add(_n=o.index())
    keep = F.col("_n") == 0 if count is None else F.pmod(F.col("_n"), F.lit(count)) == 0
    return seq.where(keep).df.drop("_n")


def cache_outcome(
    df: DataFrame,
    key: Names,
    order_by: Names,
    ts: str,
    idle_seconds: int,
    update: Column | None = None,
    update_idle_seconds: int | None = None,
    name: str = "outcome",
) -> DataFrame:
    """``miss`` for the first access of a key or one after the idle time, else ``hit``.

    Reading renews the idle time.  Rows marked as updates load the entry themselves and
    may keep it for another idle time.
    """
    is_update = F.coalesce(update, F.lit(False)) if update is not None else F.lit(False)
    seq = o.ordered(df, key, order_by).with_columns(_u=is_update).add(_pt=o.lag(ts), _pu=o.lag("_u"))
    span = lambda seconds: F.lit(seconds * MICROS).cast("bigint")
    allowed = F.when(F.col("_pu"), span(update_idle_seconds or idle_seconds)).otherwise(
        span(idle_seconds)
    )
    micros = micros_of(df, ts)
    kept = micros(ts) - micros("_pt") < allowed
    outcome = (
        F.when(F.col("_u"), "update").when(F.coalesce(kept, F.lit(False)), "hit").otherwise("miss")
    )
    return seq.with_columns(**{name: outcome}).df.drop("_u", "_pt", "_pu")


def replace_or_append(
    seq: Ordered, replaces: Column, size: Column, name: str = "size"
) -> DataFrame:
    """Length of a list after each row: a replacing row sets it, others add to it.

    Rows that only read have size 0 and do not replace; null before the first change.
    """
    marked = seq.with_columns(_r=replaces, _z=size).add(_all=o.running_sum("_z"))
    base = F.when(F.col("_r"), F.col("_all") - F.col("_z"))
    touched = F.when(F.col("_r") | (F.col("_z") > 0), 1)
    done = marked.with_columns(_b=base, _t=touched).add(
        _base=o.last_known("_b"), _seen=o.last_known("_t")
    )
    length = F.col("_all") - F.coalesce(F.col("_base"), F.lit(0))
    return done.with_columns(**{name: F.when(F.col("_seen").isNotNull(), length)}).df.drop(
        "_r", "_z", "_all", "_b", "_t", "_base", "_seen"
    )


def heartbeats(
    seq: Ordered, ts: str, every_seconds: int, name: str = "beat"
) -> DataFrame:
    """Times t+d, t+2d, ... strictly before the next row, for idle stretches longer than d.

    The beats of a stretch are made in blocks of ``BEATS``, so a long stretch is no long array.
    """
    micros = micros_of(seq.rows, ts)
    ahead = seq.add(_nt=o.lead(ts)).df
    gap = micros("_nt") - 1 - micros(ts)
    counted = ahead.withColumn("_n", F.floor(gap / (every_seconds * MICROS)).cast("bigint"))
    blocks = counted.where(F.col("_n") > 0).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / BEATS)))
    )
    first, upto = F.col("_b") * BEATS + 1, F.least((F.col("_b") + 1) * BEATS, F.col("_n"))
    beats = blocks.withColumn("_k", F.explode(F.sequence(first, upto)))
    later = F.make_dt_interval(secs=(F.col("_k") * every_seconds).cast("decimal(18,6)"))
    return beats.withColumn(name, F.col(ts) + later).drop("_nt", "_n", "_b", "_k")


def late_rows(
    seq: Ordered, ts: str, delay_seconds: int, name: str = "late"
) -> DataFrame:
    """Mark rows older than the newest time seen so far (in arrival order) minus the delay."""
    micros = micros_of(seq.rows, ts)
    mark = micros("_max") - delay_seconds * MICROS
    return (
        seq.add(_max=o.running_max(ts))
        .with_columns(**{name: micros(ts) < mark})
        .df.drop("_max")
    )
